"""Reviewer verdicts on flagged flows: candidates, prompt text, budget, parsing, labels.

No provider is called here. Prompts are a column to send, and answers are a table of
raw texts to parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netspark.functions.text import fixed, utc_text, when_chain
from netspark.params import VerdictParams
from netspark.schemas import (
    ATTACK,
    ATTACK_TYPES,
    CONFIDENCES,
    PROMOTED_COLUMNS,
    PROMOTING_CONFIDENCES,
    REAL_ATTACK_TYPES,
    SUSPICIOUS,
)

PROTOCOL_NAMES = {6: "TCP", 17: "UDP", 1: "ICMP"}

# Our own wording; pass another text to ``prompts`` to change it.
GUIDANCE = "\n".join(
    [
        "Decide from the measurements above. The statistical verdict only says that the flow is unusual.",
        "A few packets to a common service port are normally benign.",
        "Hundreds of packets per second for seconds on end, nearly all forward, suggest a flood:",
        "syn_flood for TCP with mostly SYN, else ddos. A low forward share with a high ACK ratio is a transfer.",
        "A very low iat_cv means scripted timing; bursts of ordinary traffic are irregular.",
        "Answer with one JSON object holding attack_type, confidence and reasoning.",
        f"attack_type is one of: {', '.join(ATTACK_TYPES)}. confidence is one of: high, medium, low.",
    ]
)


def flagged(verdict: Column) -> Column:
    return verdict.isin(SUSPICIOUS, ATTACK)


def candidates(results: DataFrame, p: VerdictParams = VerdictParams()) -> DataFrame:
    """Flagged flows worth a review: every ATTACK, and scores strictly below the limit."""
    return results.filter(
        flagged(F.col("verdict")) & ((F.col("verdict") == ATTACK) | (F.col("score") < p.min_score))
    )


def protocol_name(protocol: Column) -> Column:
    return when_chain([(protocol == n, name) for n, name in PROTOCOL_NAMES.items()], protocol.cast("string"))


def prompts(flows: DataFrame, guidance: str = GUIDANCE) -> DataFrame:
    """(flow_id, prompt): the flow's measurements in words, then the guidance."""

    def text(name: str) -> Column:
        return F.col(name).cast("string")

    def line(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    tcp = F.col("protocol") == 6
    counts = line(text("fwd_packets"), " forward")
    lines = [
        line("Protocol: ", protocol_name(F.col("protocol"))),
        line("Source: ", F.col("src_ip"), ":", text("src_port")),
        line("Destination: ", F.col("dst_ip"), ":", text("dst_port")),
        line("Duration: ", fixed(F.col("duration_seconds"), 3), " seconds"),
        line("Total packets: ", text("total_packets"), " (", counts, ", ", text("bwd_packets"), " backward)"),
        line("Packet rate: ", fixed(F.col("packets_per_second"), 1), " packets/second"),
        line("Byte rate: ", fixed(F.col("bytes_per_second"), 1), " bytes/second"),
        line(
            "Forward packet share: ", fixed(F.col("fwd_packet_share"), 2), " (", counts, " / ",
            text("bwd_packets"), " backward)",
        ),
        F.when(
            tcp,
            line(
                "TCP flags seen: SYN=", text("syn_count"), ", ACK=", text("ack_count"),
                ", FIN=", text("fin_count"), ", RST=", text("rst_count"),
            ),
        ),
        F.when(tcp, line("SYN ratio (SYN packets / total): ", fixed(F.col("syn_ratio"), 2))),
        F.when(tcp, line("ACK ratio (ACK packets / total): ", fixed(F.col("ack_ratio"), 2))),
        line("Zero-payload packet ratio: ", fixed(F.col("zero_payload_ratio"), 2)),
        line(
            "Inter-arrival time: mean=", fixed(F.col("iat_mean"), 4), "s, std=", fixed(F.col("iat_std"), 4),
            "s, cv=", fixed(F.col("iat_cv"), 2),
        ),
        line("Statistical verdict: ", F.col("verdict"), ", raw score=", fixed(F.col("score"), 4)),
        F.lit(guidance),
    ]
    return flows.select("flow_id", F.concat_ws("\n", *lines).alias("prompt"))


def admit(rows: DataFrame, order: str = "finish_seq", p: VerdictParams = VerdictParams()) -> DataFrame:
    """Add ``admitted``: the first ``calls_per_minute`` rows of each minute get a call.

    The rank filter is limited inside each map task before the shuffle, so a minute
    holding most of the rows still ships only its first few. The admitted rows are
    bounded by the calendar and joined back.
    """
    minute = F.floor(F.col("ts_us") / F.lit(60_000_000))
    first = Window.partitionBy("_minute").orderBy(order)
    winners = (
        rows.select(order, minute.alias("_minute"))
        .withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") <= p.calls_per_minute)
        .select(order, F.lit(True).alias("admitted"))
    )
    return rows.join(winners, order, "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def parse_verdicts(responses: DataFrame) -> DataFrame:
    """Raw answers to (available, attack_type, confidence, review_reasoning, error).

    Code fence lines are dropped first. Anything but a JSON object with a listed
    attack type is unavailable; an unlisted confidence becomes ``unknown``.
    """
    text = F.trim(F.col("raw_text"), F.lit(" \t\r\n"))
    unfenced = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.startswith(F.trim(x), F.lit("```"))), "\n")
    body = F.when(F.startswith(text, F.lit("```")), F.trim(unfenced, F.lit(" \t\r\n"))).otherwise(text)
    parsed = responses.withColumn("_json", F.try_parse_json(body))
    for name in ("attack_type", "confidence", "reasoning"):
        parsed = parsed.withColumn(f"_{name}", F.try_variant_get("_json", f"$.{name}", "string"))
    known = F.coalesce(F.col("_attack_type").isin(*ATTACK_TYPES), F.lit(False))
    shown = F.coalesce(F.concat(F.lit("'"), F.col("_attack_type"), F.lit("'")), F.lit("None"))
    return parsed.select(
        "flow_id",
        known.alias("available"),
        F.when(known, F.col("_attack_type")).alias("attack_type"),
        F.when(known & F.col("_confidence").isin(*CONFIDENCES), F.col("_confidence")).otherwise("unknown").alias("confidence"),
        F.when(known, F.col("_reasoning")).alias("review_reasoning"),
        F.when(F.col("_json").isNull(), "Could not parse LLM response as JSON")
        .when(~known, F.concat(F.lit("LLM returned an unrecognised attack_type: "), shown))
        .alias("error"),
    )


def reviews(review_candidates: DataFrame, parsed: DataFrame) -> DataFrame:
    """Candidates with their parsed answer; one that was never answered is unavailable."""
    joined = review_candidates.join(parsed, "flow_id", "left")
    return joined.withColumn("error", F.when(F.col("available").isNull(), "no response").otherwise(F.col("error"))).withColumn(
        "confidence", F.coalesce("confidence", F.lit("unknown"))
    ).withColumn("available", F.coalesce("available", F.lit(False)))


def label(results: DataFrame, parsed: DataFrame, p: VerdictParams = VerdictParams()) -> DataFrame:
    """Flagged flows with label, source, confidence, reasoning and the stored verdict.

    A reviewed attack type with high or medium confidence promotes SUSPICIOUS to
    ATTACK; nothing is ever downgraded.
    """
    rows = results.filter(flagged(F.col("verdict")))
    asked = (F.col("verdict") == ATTACK) | F.coalesce(F.col("score") < p.min_score, F.lit(False))
    joined = rows.join(parsed, "flow_id", "left")
    answered = F.coalesce(F.col("available"), F.lit(False))
    error = F.coalesce("error", F.lit("no response"))
    labelled = joined.select(
        *rows.columns,
        F.when(asked & answered, F.col("attack_type")).otherwise("unknown").alias("label"),
        when_chain([(~asked, "auto"), (answered, "llm")], "llm_failed").alias("label_source"),
        F.when(asked & answered, F.col("confidence")).otherwise("unknown").alias("confidence"),
        when_chain([(~asked, None), (answered, F.col("review_reasoning"))], error).alias("reasoning"),
    )
    promoted = (
        (F.col("verdict") == SUSPICIOUS)
        & F.col("label").isin(*REAL_ATTACK_TYPES)
        & F.col("confidence").isin(*PROMOTING_CONFIDENCES)
    )
    return labelled.withColumn("stored_verdict", F.when(promoted, ATTACK).otherwise(F.col("verdict")))


def iso_text(ts_us: Column) -> Column:
    """ISO-8601 UTC text with microseconds."""
    plain = utc_text(ts_us)
    fraction = F.lpad(F.pmod(ts_us, F.lit(1_000_000)).cast("string"), 6, "0")
    return F.concat(F.substring(plain, 1, 10), F.lit("T"), F.substring(plain, 12, 8), F.lit("."), fraction, F.lit("+00:00"))


def labelled_rows(labelled: DataFrame, feature_columns: list[str], id_column: str = "flow_id") -> DataFrame:
    """Rows of the labelled table: the features as JSON, nine of them also as columns."""
    promoted = [(F.col(c) if c in labelled.columns else F.lit(None)).alias(c) for c in PROMOTED_COLUMNS]
    return labelled.select(
        F.col(id_column).alias("id"),
        iso_text(F.col("ts_us")).alias("timestamp"),
        "label", "label_source", "confidence",
        F.col("score").alias("anomaly_score"),
        F.col("stored_verdict").alias("verdict"),
        "reasoning",
        F.to_json(F.struct(*feature_columns), {"ignoreNullFields": "false"}).alias("all_features"),
        *promoted,
    )


def _tracker_label(rows: DataFrame, name: str, features: Column, reasoning: Column) -> DataFrame:
    have = set(rows.columns)
    kinds = {
        "src_ip": "string", "dst_ip": "string", "src_port": "int", "dst_port": "int", "protocol": "int",
        "total_packets": "bigint", "packets_per_second": "double", "syn_ratio": "double", "zero_payload_ratio": "double",
    }
    identity = {"ddos": [], "port_scan": ["src_ip"], "brute_force": ["src_ip", "dst_ip", "dst_port"]}[name]
    promoted = [
        (F.col(c) if c in identity and c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in PROMOTED_COLUMNS
    ]
    return rows.select(
        F.col("finish_seq").alias("id"),
        iso_text(F.col("ts_us")).alias("timestamp"),
        F.lit(name).alias("label"),
        F.lit(f"{name}_tracker").alias("label_source"),
        F.lit("high").alias("confidence"),
        F.lit(None).cast("double").alias("anomaly_score"),
        F.lit(ATTACK).alias("verdict"),
        reasoning.alias("reasoning"),
        F.to_json(features).alias("all_features"),
        *promoted,
    )


def tracker_labels(
    ddos: DataFrame, port_scan: DataFrame, brute_force: DataFrame, seconds: dict[str, float]
) -> DataFrame:
    """Labelled rows for changes into ATTACK, with a small feature object describing the window.

    Inputs are transitions of the three window detectors; ``seconds`` holds their windows.
    """

    def text(name: str) -> Column:
        return F.col(name).cast("string")

    def within(detector: str) -> Column:
        return F.lit(f" within a {seconds[detector]:.0f}s window ")

    def features(kind: str, detector: str, **columns: str) -> Column:
        named = [F.col(source).alias(target) for target, source in columns.items()]
        return F.struct(
            F.lit(kind).alias("detection_type"), F.lit(float(seconds[detector])).alias("window_seconds"), *named
        )

    flood = _tracker_label(
        ddos, "ddos",
        features(
            "aggregate_ddos", "ddos",
            total_flows_in_window="total_flows", distinct_sources_in_window="distinct_sources",
        ),
        F.concat(
            F.lit("Aggregate rate tracker: "), text("total_flows"), F.lit(" flows from "), text("distinct_sources"),
            F.lit(" distinct sources"), within("ddos"), F.lit("(both thresholds exceeded)."),
        ),
    )
    targets = F.when(F.col("distinct_targets") == 1, " target").otherwise(" targets")
    scans = _tracker_label(
        port_scan, "port_scan",
        features(
            "port_scan", "port_scan", src_ip="src_ip",
            distinct_ports_in_window="distinct_ports", distinct_targets_in_window="distinct_targets",
        ),
        F.concat(
            F.lit("Port scan tracker: source "), F.col("src_ip"), F.lit(" touched "), text("distinct_ports"),
            F.lit(" distinct destination ports across "), text("distinct_targets"), targets, within("port_scan"),
            F.lit("(threshold exceeded)."),
        ),
    )
    guesses = _tracker_label(
        brute_force, "brute_force",
        features(
            "brute_force", "brute_force", src_ip="src_ip", dst_ip="dst_ip", dst_port="dst_port",
            attempts_in_window="attempts",
        ),
        F.concat(
            F.lit("Brute-force tracker: source "), F.col("src_ip"), F.lit(" made "), text("attempts"),
            F.lit(" connection attempts to "), F.col("dst_ip"), F.lit(":"), text("dst_port"), within("brute_force"),
            F.lit(
                "(threshold exceeded). Note: reflects connection rate only, not a confirmed authentication failure."
            ),
        ),
    )
    return flood.unionByName(scans).unionByName(guesses)

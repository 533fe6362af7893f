"""Detector results to one evidence table.

``arrival_seq`` is the flow's finish order times eight plus the detector's place in
the reporting order, so evidence of all detectors has one total order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.functions.text import fixed, float_text, when_chain
from netspark.schemas import ATTACK, DETECTORS, NORMAL, SUSPICIOUS, UNAVAILABLE, WARMING_UP


def _text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def evidence_id(detector: Column) -> Column:
    """Deterministic, so a rerun or a retried micro-batch writes the same ids."""
    parts = [_text(c) for c in ("src_ip", "dst_ip", "dst_port", "ts_us", "arrival_seq")]
    return F.sha2(F.concat_ws("/", detector, *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def with_id(rows: DataFrame) -> DataFrame:
    """Evidence, or a bridge, with its ids in front; rows without a detector are actions and have none."""
    return rows.select(F.when(F.col("detector").isNotNull(), evidence_id(F.col("detector"))).alias("evidence_id"), "*")


def _shape(
    results: DataFrame,
    detector: str,
    verdict: Column,
    reasoning: Column,
    payload: Column,
    src_ip: Column | None = None,
    dst_ip: Column | None = None,
    dst_port: Column | None = None,
    attack_type: Column | None = None,
) -> DataFrame:
    def or_null(column: Column | None, kind: str) -> Column:
        return (F.lit(None) if column is None else column).cast(kind)

    rank = DETECTORS.index(detector)
    shaped = results.select(
        (F.col("finish_seq") * 8 + rank).cast("bigint").alias("arrival_seq"),
        F.lit(detector).alias("detector"),
        F.col("ts_us"),
        verdict.alias("verdict"),
        reasoning.alias("reasoning"),
        or_null(src_ip, "string").alias("src_ip"),
        or_null(dst_ip, "string").alias("dst_ip"),
        or_null(dst_port, "int").alias("dst_port"),
        F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"),
        or_null(attack_type, "string").alias("attack_type"),
    )
    return shaped.select(evidence_id(F.col("detector")).alias("evidence_id"), "*")


def from_anomaly(results: DataFrame, feature_columns: list[str]) -> DataFrame:
    score = F.coalesce(fixed(F.col("score"), 3), F.lit("N/A"))
    reasoning = F.when(F.col("verdict") == WARMING_UP, "Still warming up - no baseline yet.").otherwise(
        F.concat(F.lit("Isolation Forest score "), score, F.lit(" against learned baseline."))
    )
    payload = F.struct("verdict", "score", F.struct(*feature_columns).alias("features"))
    return _shape(
        results, "anomaly", F.col("verdict"), reasoning, payload,
        F.col("src_ip"), F.col("dst_ip"), F.col("dst_port"),
    )


def from_ddos(results: DataFrame, window_seconds: float) -> DataFrame:
    window = F.lit(float(window_seconds))
    reasoning = F.concat(
        _text("total_flows"), F.lit(" flows from "), _text("distinct_sources"),
        F.lit(" distinct sources in a "), float_text(window), F.lit("s window."),
    )
    payload = F.struct(
        "verdict",
        window.alias("window_seconds"),
        F.col("total_flows").alias("total_flows_in_window"),
        F.col("distinct_sources").alias("distinct_sources_in_window"),
    )
    return _shape(results, "ddos", F.col("verdict"), reasoning, payload)


def from_port_scan(results: DataFrame, window_seconds: float) -> DataFrame:
    window = F.lit(float(window_seconds))
    reasoning = F.concat(
        _text("distinct_ports"), F.lit(" distinct ports touched"),
        # Unknown for normal rows where only flagged ones have details.
        F.coalesce(F.concat(F.lit(" across "), _text("distinct_targets"), F.lit(" targets")), F.lit("")),
        F.lit(" in a "), float_text(window), F.lit("s window."),
    )
    payload = F.struct(
        "verdict",
        "src_ip",
        window.alias("window_seconds"),
        F.col("distinct_ports").alias("distinct_ports_in_window"),
        F.col("distinct_targets").alias("distinct_targets_in_window"),
        (F.col("scan_start_us") / F.lit(1e6)).alias("scan_start_timestamp"),
        (F.col("scan_end_us") / F.lit(1e6)).alias("scan_end_timestamp"),
        "duration_seconds",
        "ports_per_second",
        "confidence_pct",
    )
    return _shape(results, "port_scan", F.col("verdict"), reasoning, payload, src_ip=F.col("src_ip"))


def from_brute_force(results: DataFrame, window_seconds: float) -> DataFrame:
    window = F.lit(float(window_seconds))
    reasoning = F.concat(
        _text("attempts"), F.lit(" attempts in "), float_text(window),
        F.lit("s window (offence #"), _text("repeat_offender_count"), F.lit(")."),
    )
    payload = F.struct(
        "verdict", "src_ip", "dst_ip", "dst_port",
        F.col("attempts").alias("attempts_in_window"),
        window.alias("window_seconds"),
        "repeat_offender_count",
    )
    return _shape(
        results, "brute_force", F.col("verdict"), reasoning, payload,
        F.col("src_ip"), F.col("dst_ip"), F.col("dst_port"),
    )


def reviewer_verdict(available: Column, attack_type: Column) -> Column:
    """What a review says about the flow: a missing answer is never a clean bill of health."""
    return when_chain(
        [(~available, UNAVAILABLE), (attack_type == "benign", NORMAL), (attack_type == "unknown", SUSPICIOUS)], ATTACK
    )


def from_reviews(reviews: DataFrame) -> DataFrame:
    """``reviews``: flow identity plus available, attack_type, confidence, review_reasoning, error."""
    named = F.concat(F.lit("LLM classified this flow as "), F.col("attack_type"), F.lit("."))
    stated = F.when(F.col("review_reasoning") != "", F.col("review_reasoning"))
    reasoning = F.when(
        ~F.col("available"), F.concat(F.lit("LLM analysis unavailable: "), F.col("error"))
    ).otherwise(F.coalesce(stated, named))
    payload = F.struct(
        "available", "attack_type", "confidence", F.col("review_reasoning").alias("reasoning"), "error"
    )
    return _shape(
        reviews, "llm", reviewer_verdict(F.col("available"), F.col("attack_type")), reasoning, payload,
        F.col("src_ip"), F.col("dst_ip"), F.col("dst_port"), F.col("attack_type"),
    )


def evidence(*parts: DataFrame) -> DataFrame:
    """The union of the detectors' evidence: a concatenation of scans, no shuffle."""
    return reduce(DataFrame.unionByName, parts)

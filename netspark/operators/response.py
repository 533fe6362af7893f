"""Response decisions as tables: attack events, block decisions and intervals, alert limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.functions.ip import is_address, is_loopback, is_private
from netspark.functions.text import float_text, when_chain
from netspark.operators.scan import SEQUENCE_CHUNKS, Running, scan
from netspark.params import AlertParams, BlockParams
from netspark.schemas import ATTACK
from netspark.session import stage

MULTIPLE_SOURCES = "multiple-sources"
NOT_ONE_SOURCE = "a distributed flood has no one source to block"


def block_skip_reason(ip: Column, p: BlockParams = BlockParams()) -> Column:
    """Why an address is not blocked, first reason first; null when it may be."""
    return when_chain(
        [
            (is_loopback(ip), "loopback is not blocked"),
            (ip.isin(*p.own_addresses), "one of our own addresses"),
            (ip.isin(*(p.whitelist or ("",))), "on the list of allowed addresses"),
            (~is_address(ip), F.concat(F.lit("not an address: "), ip)),
            (
                is_private(ip) & F.lit(not p.block_private_ranges),
                "private addresses are left alone",
            ),
        ]
    )


def block_minutes(offences: Column, p: BlockParams = BlockParams()) -> Column:
    """Base duration, scaled for each offence after the first, up to a limit."""
    scale = F.least(F.lit(p.escalation_multiplier) * (offences - 1), F.lit(p.escalation_max_multiplier))
    return F.when(offences <= 1, F.lit(p.duration_minutes)).otherwise(F.lit(p.duration_minutes) * scale)


def attack_events(
    flows: DataFrame | None = None,
    ddos: DataFrame | None = None,
    port_scan: DataFrame | None = None,
    brute_force: DataFrame | None = None,
    windows: dict[str, float] | None = None,
) -> DataFrame:
    """Per-flow ATTACK verdicts and changes into ATTACK of the window detectors.

    ``seq`` orders events the way a flow's detectors report them. A distributed flood
    has no single source.
    """
    windows = windows or {}

    def text(name: str) -> Column:
        return F.col(name).cast("string")

    def seconds(detector: str) -> Column:
        return F.lit(f"{windows.get(detector, 0):.0f}s.")

    def shape(rows: DataFrame, rank: int, kind: Column, src: Column, reasoning: Column, offences: Column) -> DataFrame:
        return rows.select(
            (F.col("finish_seq") * 8 + rank).alias("seq"),
            "ts_us",
            src.alias("src_ip"),
            kind.alias("attack_type"),
            reasoning.alias("reasoning"),
            offences.cast("bigint").alias("repeat_offender_count"),
        )

    none = F.lit(0)
    parts = []
    if flows is not None:
        kind = F.lit("anomaly_flood")
        if "predicted_label" in flows.columns:
            kind = F.coalesce("predicted_label", kind)
        reasoning = F.concat(
            F.lit("Per-flow ATTACK verdict (score="), F.coalesce(float_text(F.col("score")), F.lit("None")), F.lit(").")
        )
        parts.append(shape(flows.filter(F.col("verdict") == ATTACK), 0, kind, F.col("src_ip"), reasoning, none))
    if ddos is not None:
        reasoning = F.concat(
            text("total_flows"), F.lit(" flows from "), text("distinct_sources"), F.lit(" distinct sources in "),
            seconds("ddos"),
        )
        parts.append(shape(ddos, 2, F.lit("ddos"), F.lit(MULTIPLE_SOURCES), reasoning, none))
    if port_scan is not None:
        reasoning = F.concat(
            F.lit("Touched "), text("distinct_ports"), F.lit(" distinct ports across "), text("distinct_targets"),
            F.lit(" targets in "), seconds("port_scan"),
        )
        parts.append(shape(port_scan, 3, F.lit("port_scan"), F.col("src_ip"), reasoning, none))
    if brute_force is not None:
        reasoning = F.concat(
            text("attempts"), F.lit(" connection attempts to "), F.col("dst_ip"), F.lit(":"), text("dst_port"),
            F.lit(" in "), seconds("brute_force"),
        )
        parts.append(
            shape(brute_force, 4, F.lit("brute_force"), F.col("src_ip"), reasoning, F.col("repeat_offender_count"))
        )
    return reduce(DataFrame.unionByName, parts)


def block_decisions(events: DataFrame, p: BlockParams = BlockParams()) -> DataFrame:
    """Each event with its skip reason, duration and outcome."""
    skip = F.when(F.col("src_ip") == MULTIPLE_SOURCES, F.lit(NOT_ONE_SOURCE)).otherwise(
        block_skip_reason(F.col("src_ip"), p)
    )
    recorded = F.col("skip_reason").isNull()
    return (
        events.withColumn("skip_reason", skip)
        .withColumn("duration_minutes", F.when(recorded, block_minutes(F.col("repeat_offender_count"), p)))
        .withColumn("applied", recorded & F.lit(not p.dry_run))
        .withColumn("dry_run", F.lit(p.dry_run))
        .withColumn("expires_us", F.col("ts_us") + (F.col("duration_minutes") * 60_000_000).cast("bigint"))
    )


def block_actions(decisions: DataFrame, unblocks: DataFrame | None = None, p: BlockParams = BlockParams()) -> DataFrame:
    """The audit trail: one row per recorded block or unblock."""
    reason = F.concat(F.col("attack_type"), F.lit(": "), F.coalesce("reasoning", F.lit("no additional detail")))
    blocks = decisions.filter("skip_reason is null").select(
        "seq", "ts_us", F.lit("block").alias("action"), F.col("src_ip").alias("ip"), reason.alias("reason"), "dry_run",
        F.lit(p.backend).alias("backend"), "expires_us",
    )
    if unblocks is None:
        return blocks
    manual = unblocks.select(
        "seq", "ts_us", F.lit("unblock").alias("action"), "ip", F.lit("manual").alias("reason"),
        F.lit(p.dry_run).alias("dry_run"), F.lit(p.backend).alias("backend"), F.lit(None).cast("bigint").alias("expires_us"),
    )
    return blocks.unionByName(manual)


def block_intervals(actions: DataFrame) -> DataFrame:
    """(ip, valid_from_us, valid_to_us): each block holds until it expires or the next action on its address."""
    known = scan(
        actions, ["ip"], "seq", {"next_us": Running("last", "ts_us", inclusive=False)}, SEQUENCE_CHUNKS, reverse=True
    )
    return known.filter("action = 'block'").select(
        "seq", "ip", F.col("ts_us").alias("valid_from_us"), F.least("expires_us", "next_us").alias("valid_to_us")
    )


def blocked_as_of(actions: DataFrame, at_us: int) -> DataFrame:
    """(ip, seconds_remaining): addresses whose latest action by ``at_us`` is an unexpired block."""
    latest = actions.filter(F.col("ts_us") <= at_us).groupBy("ip").agg(
        F.max_by(F.struct("action", "expires_us"), "seq").alias("last")
    )
    left = (F.col("last.expires_us") - F.lit(at_us)) / F.lit(1e6)
    return latest.filter((F.col("last.action") == "block") & (F.col("last.expires_us") > at_us)).select(
        "ip", F.round(left, 1).alias("seconds_remaining")
    )


# ---- alert rate limit -----------------------------------------------------------
def rate_limited_alerts(events: DataFrame, p: AlertParams = AlertParams()) -> DataFrame:
    """Add ``sent``: an event is sent iff its source sent none in the last ``rate_limit_seconds``.

    Greedy per source, yet cut into independent bursts: an event at least the limit
    after the one before it is always sent. A burst shorter than the limit sends only
    its first event. Other bursts are solved by pointer doubling, so no group is ever
    held in one task or row.
    """
    limit = p.rate_limit_us
    times = events.groupBy("src_ip", "ts_us").agg(F.min("seq").alias("seq"))
    previous = scan(times, ["src_ip"], "ts_us", {"prev_us": Running("last", "ts_us", inclusive=False)})
    starts = F.col("prev_us").isNull() | (F.col("ts_us") - F.col("prev_us") >= limit)
    marked = previous.withColumn("burst_start", F.when(starts, F.col("ts_us")))
    bursts = stage(
        scan(marked, ["src_ip"], "ts_us", {"burst": Running("last", "burst_start")}).select("src_ip", "ts_us", "burst"),
        "bursts",
    )
    ends = bursts.groupBy("src_ip", "burst").agg(F.max("ts_us").alias("end_us"))
    heads = ends.select("src_ip", F.col("burst").alias("ts_us"))
    long = ends.filter(F.col("end_us") - F.col("burst") >= limit)
    sent = heads.unionByName(_double_pointers(bursts.join(long, ["src_ip", "burst"]), limit))
    sent = sent.distinct().join(times, ["src_ip", "ts_us"]).select("seq", F.lit(True).alias("sent"))
    return events.join(sent, "seq", "left").withColumn("sent", F.coalesce("sent", F.lit(False)))


def _double_pointers(rows: DataFrame, limit: int) -> DataFrame:
    """Times on each burst's chain head -> first time at least ``limit`` later -> ...

    Each round doubles the length of the pointers and the number of marked times, so
    a chain of n links takes log2(n) rounds of equi joins.
    """
    steps = F.array(
        F.struct(F.col("ts_us").alias("t"), F.col("ts_us").alias("node"), F.lit(None).cast("bigint").alias("asks")),
        F.struct((F.col("ts_us") + limit).alias("t"), F.lit(None).cast("bigint").alias("node"), F.col("ts_us").alias("asks")),
    )
    points = rows.select("src_ip", F.inline(steps)).groupBy("src_ip", "t").agg(
        F.max("node").alias("node"), F.max("asks").alias("asks")
    )
    links = scan(points, ["src_ip"], "t", {"next": Running("last", "node")}, reverse=True)
    links = stage(
        links.filter("asks is not null and next is not null").select("src_ip", F.col("asks").alias("ts_us"), "next"),
        "links",
    )
    marked = stage(rows.select("src_ip", F.col("burst").alias("ts_us")).distinct(), "marked")
    while not links.isEmpty():
        reached = marked.join(links, ["src_ip", "ts_us"]).select("src_ip", F.col("next").alias("ts_us"))
        marked = stage(marked.unionByName(reached).distinct(), "marked")
        ahead = links.select("src_ip", F.col("ts_us").alias("next"), F.col("next").alias("after"))
        links = stage(
            links.join(ahead, ["src_ip", "next"]).select("src_ip", "ts_us", F.col("after").alias("next")), "links"
        )
    return marked


def alert_messages(events: DataFrame, brand: str = "netspark") -> DataFrame:
    """Subject and body per event. Optional columns: ``location``, and ``detail`` (already formatted lines)."""
    have = set(events.columns)
    location = F.coalesce("location", F.lit("location unknown")) if "location" in have else F.lit("location unknown")
    verdict = F.col("verdict") if "verdict" in have else F.lit(ATTACK)
    subject = F.concat(F.lit(f"[{brand}] "), verdict, F.lit(": "), F.col("attack_type"), F.lit(" from "), F.col("src_ip"))
    lines = [
        F.concat(F.lit(f"{brand} detected a confirmed "), F.lower(verdict), F.lit(".")),
        F.lit(""),
        F.concat(F.lit("Attack type : "), F.col("attack_type")),
        F.concat(F.lit("Source IP   : "), F.col("src_ip")),
        F.concat(F.lit("Location    : "), location),
        F.when(F.col("reasoning") != "", F.concat(F.lit("\nReasoning: "), F.col("reasoning"))),
    ]
    if "detail" in have:
        lines.append(F.when(F.col("detail") != "", F.concat(F.lit("\nAdditional detail:\n"), F.col("detail"))))
    return events.select("seq", subject.alias("subject"), F.concat_ws("\n", *lines).alias("body"))

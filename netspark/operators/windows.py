"""Sliding-window detectors: distributed flood, port scan, password guessing.

The window ending at ``t`` is the closed range [t - W, t]; rows at equal times all
count. Distinct counts are exact: an entity is in the window while its trailing row
count is above zero, so distinct counts are running sums of those crossings. Every
stage is a ``scan`` over summed changes, linear in the events and safe for a hot
source. No stage joins events with events.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.functions.ip import ip_number
from netspark.functions.text import when_chain
from netspark.operators.scan import TIME_CHUNKS, SEQUENCE_CHUNKS, Running, crossing, scan, window_chunks, window_deltas
from netspark.params import BruteForceParams, DdosParams, EvidenceParams, PortScanParams
from netspark.schemas import ATTACK, NORMAL, SUSPICIOUS
from netspark.session import stage


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# ---- distributed flood ----------------------------------------------------------
def ddos_verdict(flows: Column, sources: Column, p: DdosParams) -> Column:
    return when_chain(
        [
            ((flows >= p.attack_flows) & (sources >= p.attack_sources), ATTACK),
            ((flows >= p.suspicious_flows) | (sources >= p.suspicious_sources), SUSPICIOUS),
        ],
        NORMAL,
    )


def ddos_counts(new_flows: DataFrame, check_times: DataFrame, p: DdosParams) -> DataFrame:
    """Flows and distinct sources in the window ending at each distinct ``ts_us`` of ``check_times``."""
    sourced = new_flows.select(F.coalesce("src_ip", F.lit("")).alias("src_ip"), "ts_us")
    per_source = window_deltas(sourced, ["src_ip"], "ts_us", p.window_us)
    seen = scan(per_source, ["src_ip"], "t", {"n": Running("sum", "change")}, window_chunks(p.window_us))
    changes = seen.select("t", "change", crossing(F.col("n"), F.col("change")).alias("source_change"))
    points = check_times.select(F.col("ts_us").alias("t")).select(
        "t", F.lit(0).alias("change"), F.lit(0).alias("source_change"), F.lit(1).alias("checked")
    )
    swept = (
        _union([changes.withColumn("checked", F.lit(0)), points])
        .groupBy("t")
        .agg(
            F.sum("change").alias("change"),
            F.sum("source_change").alias("source_change"),
            F.max("checked").alias("checked"),
        )
    )
    counted = scan(
        swept, [], "t",
        {"total_flows": Running("sum", "change"), "distinct_sources": Running("sum", "source_change")}, also=("checked",),
    )
    return counted.filter("checked = 1").select(F.col("t").alias("ts_us"), "total_flows", "distinct_sources")


def ddos_windows(new_flows: DataFrame, checks: DataFrame | None = None, p: DdosParams = DdosParams()) -> DataFrame:
    """Window counts and verdict for each check row (default: each new flow, at its own time)."""
    checks = new_flows if checks is None else checks
    counts = ddos_counts(new_flows, checks, p)
    return checks.join(counts, "ts_us").withColumn(
        "verdict", ddos_verdict(F.col("total_flows"), F.col("distinct_sources"), p)
    )


# ---- port scan ------------------------------------------------------------------
def port_scan_verdict(ports: Column, p: PortScanParams) -> Column:
    return when_chain([(ports >= p.attack_ports, ATTACK), (ports >= p.suspicious_ports, SUSPICIOUS)], NORMAL)


def port_scan_confidence(ports: Column, p: PortScanParams) -> Column:
    share = F.least(F.lit(100.0), ports / F.lit(float(p.attack_ports)) * F.lit(100.0))
    return F.when(port_scan_verdict(ports, p) == NORMAL, F.lit(0.0)).otherwise(share)


def host_number(ip: Column) -> Column:
    """A long per host: the address itself, or a hash well above all addresses for other text."""
    return F.coalesce(ip_number(ip), F.lit(1 << 33) + F.xxhash64(ip).bitwiseAND((1 << 40) - 1))


#: Stands for a missing port among the keys.
NO_PORT = -1


def _known(rows: DataFrame, *keys: str) -> DataFrame:
    """Stored host numbers and ports are never null, which a stored table doesn't tell."""
    return rows.withColumns({c: F.coalesce(c, F.lit(NO_PORT)) for c in keys})


def _port_changes(new_flows: DataFrame, p: PortScanParams) -> DataFrame:
    """(src, t, port_change): distinct ports of a source entering and leaving its window."""
    per_port = window_deltas(new_flows, ["src", "dst_port"], "ts_us", p.window_us)
    seen = scan(per_port, ["src", "dst_port"], "t", {"n": Running("sum", "change")}, window_chunks(p.window_us))
    return seen.select("src", "t", crossing(F.col("n"), F.col("change")).alias("port_change"))


def _target_changes(new_flows: DataFrame, p: PortScanParams) -> DataFrame:
    """(src, t, port_change, target_change) with scan targets told from incidental contacts.

    A destination is a target while the source touches two or more of its ports, or
    touches one of its ports that is also open on another destination. For a
    (source, port) the destinations in the window are known by count and by the sum
    of their numbers, so when the count is one the sum names the only destination.
    A contact is shared while it is present and not the only one, which turns both
    conditions into running counts per (source, destination).
    """
    contact = ["src", "dst", "dst_port"]
    chunks = window_chunks(p.window_us)
    seen = scan(
        window_deltas(new_flows, contact, "ts_us", p.window_us), contact, "t", {"n": Running("sum", "change")}, chunks
    )
    # Read by two branches below, as are the host counts: written once, not computed twice.
    presence = stage(
        seen.select(*contact, "t", crossing(F.col("n"), F.col("change")).alias("d")).filter("d <> 0"), "presence"
    )
    presence = _known(presence, *contact)

    by_port = presence.groupBy("src", "dst_port", "t").agg(
        F.sum("d").alias("d_hosts"), F.sum(F.col("d") * F.col("dst")).alias("d_sum")
    )
    hosts = stage(
        scan(
            by_port, ["src", "dst_port"], "t",
            {"hosts": Running("sum", "d_hosts"), "host_sum": Running("sum", "d_sum")}, chunks,
        ),
        "hosts",
    )
    hosts = _known(hosts, "src", "dst_port")
    port_changes = hosts.select("src", "t", crossing(F.col("hosts"), F.col("d_hosts")).alias("port_change"))
    hosts_before, sum_before = F.col("hosts") - F.col("d_hosts"), F.col("host_sum") - F.col("d_sum")
    only = F.array(
        F.struct(F.when(hosts_before == 1, sum_before).alias("dst"), F.lit(1).alias("d_shared")),
        F.struct(F.when(F.col("hosts") == 1, F.col("host_sum")).alias("dst"), F.lit(-1).alias("d_shared")),
    )
    only_changes = _known(hosts.select("src", "t", F.inline(only)).filter("dst is not null"), "dst")

    by_target = (
        _union(
            [
                presence.select("src", "dst", "t", F.col("d").alias("d_ports"), F.col("d").alias("d_shared")),
                only_changes.select("src", "dst", "t", F.lit(0).alias("d_ports"), "d_shared"),
            ]
        )
        .groupBy("src", "dst", "t")
        .agg(F.sum("d_ports").alias("d_ports"), F.sum("d_shared").alias("d_shared"))
    )
    contacts = scan(
        by_target, ["src", "dst"], "t",
        {"ports": Running("sum", "d_ports"), "shared": Running("sum", "d_shared")}, chunks,
    )

    def is_target(ports: Column, shared: Column) -> Column:
        return ((ports >= 2) | (shared >= 1)).cast("int")

    after = is_target(F.col("ports"), F.col("shared"))
    before = is_target(F.col("ports") - F.col("d_ports"), F.col("shared") - F.col("d_shared"))
    target_changes = contacts.select("src", "t", (after - before).alias("target_change"))
    return _union([port_changes, target_changes])


def _span_marks(new_flows: DataFrame, p: PortScanParams) -> DataFrame:
    """Marks whose latest value is the first (``first_mark``) or last (``last_mark``) event in the window.

    The first event in the window changes to its successor just after it expires.
    """
    times = new_flows.select("src", F.col("ts_us").alias("t")).distinct()
    chained = scan(times, ["src"], "t", {"next_t": Running("last", "t", inclusive=False)}, window_chunks(p.window_us), reverse=True)
    steps = F.array(
        F.struct(F.col("t").alias("t"), F.lit(None).cast("bigint").alias("first_mark"), F.col("t").alias("last_mark")),
        F.struct(
            (F.col("t") + F.lit(p.window_us + 1)).alias("t"),
            F.col("next_t").alias("first_mark"),
            F.lit(None).cast("bigint").alias("last_mark"),
        ),
    )
    first = times.groupBy("src").agg(F.min("t").alias("t")).withColumn("first_mark", F.col("t"))
    return _union([chained.select("src", F.inline(steps)), first])


def port_scan_windows(
    new_flows: DataFrame,
    checks: DataFrame | None = None,
    p: PortScanParams = PortScanParams(),
    detail: bool | str = True,
) -> DataFrame:
    """Distinct ports, verdict and confidence per check row; ``detail`` adds targets, span and rate, or ``"targets"`` alone.

    ``detail="flagged"`` works them out for rows whose verdict is not normal and leaves them null on all others.
    """
    if detail == "flagged":
        return _flagged_port_scan_windows(new_flows, new_flows if checks is None else checks, p)
    span = detail and detail != "targets"
    checks = (new_flows if checks is None else checks).withColumn("src", host_number(F.col("src_ip")))
    hosts = [host_number(F.col(f"{end}_ip")).alias(end) for end in ("src", "dst")]
    events = _known(new_flows.select(*hosts, "dst_port", "ts_us"), "dst_port")
    if detail:
        # Narrow, and read by three branches: written once.
        events = _known(stage(events, "contacts"), "src", "dst", "dst_port")
        parts = [_target_changes(events, p)] + ([_span_marks(events, p)] if span else [])
    else:
        parts = [_port_changes(events, p)]
    points = checks.select("src", F.col("ts_us").alias("t"), F.lit(1).alias("checked"))
    zero = F.lit(0)
    changes = _union([*parts, points])
    for name in ("port_change", "target_change", "checked"):
        changes = changes.withColumn(name, F.coalesce(F.col(name), zero) if name in changes.columns else zero)
    sums = [F.sum("port_change").alias("port_change"), F.max("checked").alias("checked")]
    running = {"distinct_ports": Running("sum", "port_change")}
    if detail:
        sums.append(F.sum("target_change").alias("target_change"))
        running["distinct_targets"] = Running("sum", "target_change")
    if span:
        sums += [F.max("first_mark").alias("first_mark"), F.max("last_mark").alias("last_mark")]
        running |= {"scan_start_us": Running("last", "first_mark"), "scan_end_us": Running("last", "last_mark")}
    swept = changes.groupBy("src", "t").agg(*sums)
    counted = scan(swept, ["src"], "t", running, window_chunks(p.window_us), also=("checked",)).filter("checked = 1")
    counted = counted.select("src", F.col("t").alias("ts_us"), *running)
    result = checks.join(counted, ["src", "ts_us"]).drop("src")
    if span:
        inside = F.col("distinct_ports") > 0
        seconds = F.when(inside, (F.col("scan_end_us") - F.col("scan_start_us")) / F.lit(1e6)).otherwise(F.lit(0.0))
        rate = F.when(inside, F.col("distinct_ports") / F.greatest(seconds, F.lit(0.001))).otherwise(F.lit(0.0))
        result = (
            result.withColumn("duration_seconds", seconds)
            .withColumn("ports_per_second", rate)
            .withColumn("scan_start_us", F.when(inside, F.col("scan_start_us")))
            .withColumn("scan_end_us", F.when(inside, F.col("scan_end_us")))
        )
    ports = F.col("distinct_ports")
    return result.withColumn("verdict", port_scan_verdict(ports, p)).withColumn(
        "confidence_pct", port_scan_confidence(ports, p)
    )


def _flagged_port_scan_windows(new_flows: DataFrame, checks: DataFrame, p: PortScanParams) -> DataFrame:
    """Port counts for all rows, then the sweep over targets for what the flagged rows can see.

    Windows that end in a bucket of one window's width begin in that bucket or the one before, so a contact matters only
    if its source has a flagged check in its own bucket or the next. Contacts beyond a window leave its counts before it
    is checked, so the counts over this part of the contacts are those over all of them. The (source, bucket) pairs are few
    where scans are few; the semi-join is an equi join in which a source is spread over its buckets.
    """
    counted = stage(port_scan_windows(new_flows, checks, p, detail=False), "port-counts")
    flagged = counted.filter(F.col("verdict") != NORMAL)
    detailed = port_scan_windows(contacts_seen(new_flows, flagged, p), flagged.select(*checks.columns), p)
    return detailed.unionByName(counted.filter(F.col("verdict") == NORMAL), allowMissingColumns=True)


def contacts_seen(new_flows: DataFrame, checks: DataFrame, p: PortScanParams) -> DataFrame:
    """The flows that port-scan windows of these checks can hold: of their sources, in a check's bucket or the one before."""
    bucket = F.col("ts_us") - F.pmod(F.col("ts_us"), F.lit(p.window_us))
    seen = checks.select(F.col("src_ip").alias("_src"), F.explode(F.array(bucket, bucket - F.lit(p.window_us))).alias("_seen")).distinct()
    same = F.col("src_ip").eqNullSafe(F.col("_src")) & (F.col("_bucket") == F.col("_seen"))
    return new_flows.withColumn("_bucket", bucket).join(seen, same, "left_semi").drop("_bucket")


# ---- password guessing ----------------------------------------------------------
TRIPLE = ["src_ip", "dst_ip", "dst_port"]


def brute_force_verdict(attempts: Column, p: BruteForceParams) -> Column:
    return when_chain(
        [(attempts >= p.attack_attempts, ATTACK), (attempts >= p.suspicious_attempts, SUSPICIOUS)], NORMAL
    )


def brute_force_counts(attempts: DataFrame, p: BruteForceParams) -> DataFrame:
    """Attempts in the window and episode number at each distinct attempt time of a triple."""
    deltas = window_deltas(attempts, TRIPLE, "ts_us", p.window_us, arrivals=True)
    chunks = window_chunks(p.window_us)
    counted = scan(deltas, TRIPLE, "t", {"attempts": Running("sum", "change")}, chunks, also=("arrivals",)).filter("arrivals > 0")
    flagged = counted.select(*TRIPLE, "t", "attempts", (F.col("attempts") >= p.attack_attempts).cast("int").alias("hot"))
    previous = scan(flagged, TRIPLE, "t", {"was_hot": Running("last", "hot", inclusive=False)}, chunks)
    rising = previous.withColumn(
        "rise", ((F.col("hot") == 1) & (F.coalesce("was_hot", F.lit(0)) == 0)).cast("int")
    )
    return scan(rising, TRIPLE, "t", {"repeat_offender_count": Running("sum", "rise")}, chunks).select(
        *TRIPLE, F.col("t").alias("ts_us"), "attempts", "repeat_offender_count"
    )


def watched(dst_port: Column, p: BruteForceParams) -> Column:
    return dst_port.isin(*p.watched_ports)


def brute_force_windows(attempts: DataFrame, p: BruteForceParams = BruteForceParams()) -> DataFrame:
    """Attempts in the window, verdict and episode number for each attempt on a watched port.

    ``attempts`` has one row per flow with ``ts_us`` at the flow's last packet.
    """
    kept = attempts.filter(watched(F.col("dst_port"), p))
    result = kept.join(brute_force_counts(kept, p), [*TRIPLE, "ts_us"])
    return result.withColumn("verdict", brute_force_verdict(F.col("attempts"), p))


# ---- verdict changes, running summaries -----------------------------------------
def with_previous_verdict(results: DataFrame, keys: list[str], order: str, widths=SEQUENCE_CHUNKS) -> DataFrame:
    previous = scan(results, keys, order, {"_prev": Running("last", "verdict", inclusive=False)}, widths)
    return previous.withColumn("previous_verdict", F.coalesce("_prev", F.lit(NORMAL))).drop("_prev")


def verdict_transitions(
    results: DataFrame, keys: list[str], order: str, to: str | None = ATTACK, widths=SEQUENCE_CHUNKS
) -> DataFrame:
    """Rows whose verdict differs from the key's previous one; ``to`` keeps changes into that verdict."""
    changed = with_previous_verdict(results, keys, order, widths).filter("verdict <> previous_verdict")
    return changed if to is None else changed.filter(F.col("verdict") == to)


def evidence_buffer(evidence: DataFrame, p: EvidenceParams = EvidenceParams()) -> DataFrame:
    """Evidence of the last ``buffer_seconds`` before the newest row, oldest arrival first."""
    first = evidence.agg(F.max("ts_us") - F.lit(int(p.buffer_seconds * 1e6))).scalar()
    recent = F.col("ts_us") >= first
    if "event_date" in evidence.columns:  # stored evidence: only the folders of those days are read
        day = F.floor(first / F.lit(86_400_000_000)).cast("int")
        recent = recent & (F.col("event_date") >= F.date_add(F.lit("1970-01-01").cast("date"), day))
    return evidence.filter(recent).orderBy("arrival_seq")


def running_summary(results: DataFrame, order: str, every: int = 50, widths=SEQUENCE_CHUNKS) -> DataFrame:
    """Per-verdict running counts at every ``every``-th result in ``order``."""
    verdicts = {"normal": NORMAL, "suspicious": SUSPICIOUS, "attack": ATTACK, "warming_up": "WARMING_UP"}
    counted = results.select(
        order, F.lit(1).alias("one"),
        *[(F.col("verdict") == v).cast("int").alias(f"is_{name}") for name, v in verdicts.items()],
    )
    out = {"flows_seen": Running("sum", "one")} | {n: Running("sum", f"is_{n}") for n in verdicts}
    return scan(counted, [], order, out, widths).filter(F.col("flows_seen") % every == 0).select(
        "flows_seen", *verdicts
    )

"""Reports and query views over incidents and evidence. Rendered texts are tables of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.functions.text import cef_extension, cef_header, pad, utc_text, when_chain
from netspark.operators.incidents import attached_evidence, latest_only, open_incidents, timeline, timeline_text
from netspark.operators.techniques import TECHNIQUES
from netspark.params import ExportParams
from netspark.schemas import AGGREGATE_KEY, ATTACK, NORMAL, OPEN, SUSPICIOUS, TIERS, WARMING_UP

# ---- fixed values: SIEM severities
VERDICT_SEVERITY = {SUSPICIOUS: 5, ATTACK: 9}
TIER_SEVERITY = {"LOW": 2, "MEDIUM": 5, "HIGH": 8, "CRITICAL": 10}


def _comma(names: str) -> Column:
    return F.array_join(F.col(names), ",")


def _source(aggregate: str) -> Column:
    return F.when(F.col("key") == AGGREGATE_KEY, F.lit(aggregate)).otherwise(F.col("key"))


# ---- logs -----------------------------------------------------------------------
def detections_log(results: DataFrame, log_normal: bool = False) -> DataFrame:
    """Results worth a log line: never WARMING_UP, NORMAL only on request."""
    kept = [SUSPICIOUS, ATTACK] + ([NORMAL] if log_normal else [])
    return results.filter(F.col("verdict").isin(*kept))


def event_log(evidence: DataFrame, bridge: DataFrame, incident_table: DataFrame) -> DataFrame:
    """evidence_created, incident_opened / incident_updated and incident_resolved events."""
    created = evidence.select(
        F.lit("evidence_created").alias("event_type"), "arrival_seq", "ts_us", "evidence_id", "detector", "verdict",
        "src_ip", "dst_ip", "dst_port", "reasoning",
    )
    lifecycle = attached_evidence(bridge).select(
        F.when(F.col("is_new"), "incident_opened").otherwise("incident_updated").alias("event_type"),
        "arrival_seq", "ts_us", "incident_id", "key", "verdict",
    )
    resolutions = bridge.filter("kind = 'action' and status_after = 'RESOLVED'").select("arrival_seq", "incident_id", "key")
    totals = incident_table.select("incident_id", "highest_verdict", "evidence_count")
    resolved = resolutions.join(totals, "incident_id").withColumn("event_type", F.lit("incident_resolved"))
    return created.unionByName(lifecycle, allowMissingColumns=True).unionByName(resolved, allowMissingColumns=True)


# ---- CSV views ------------------------------------------------------------------
def incidents_csv(incident_table: DataFrame) -> DataFrame:
    return incident_table.select(
        "incident_id",
        _source("aggregate (DDoS)").alias("source"),
        "status", "risk_score", "risk_tier", "highest_verdict",
        _comma("detectors_involved").alias("detectors_involved"),
        _comma("techniques").alias("mitre_techniques"),
        "evidence_count",
        utc_text(F.col("first_seen_us")).alias("first_seen"),
        utc_text(F.col("last_seen_us")).alias("last_seen"),
    )


def evidence_csv(bridge: DataFrame) -> DataFrame:
    return attached_evidence(bridge).select(
        "incident_id", "evidence_id", "detector", "verdict", utc_text(F.col("ts_us")).alias("timestamp"),
        "src_ip", "dst_ip", "dst_port", "reasoning",
    )


# ---- CEF lines ------------------------------------------------------------------
def _cef(p: ExportParams, signature: Column, name: Column, severity: Column, fields: dict[str, Column]) -> Column:
    header = [F.lit("CEF:0")] + [cef_header(F.lit(x)) for x in (p.vendor, p.product, p.version)]
    header += [cef_header(signature), cef_header(name), severity.cast("string")]
    return F.concat(F.concat_ws("|", *header), F.lit("|"), cef_extension(fields))


def _millis(ts_us: Column) -> Column:
    return F.floor(ts_us / F.lit(1000)).cast("bigint")


def evidence_cef(evidence: DataFrame, p: ExportParams = ExportParams()) -> DataFrame:
    verdict, detector = F.col("verdict"), F.col("detector")
    severity = when_chain([(verdict == v, s) for v, s in VERDICT_SEVERITY.items()], 0)
    line = _cef(
        p,
        F.concat(detector, F.lit("."), verdict),
        F.concat(F.lit(f"{p.brand} "), detector, F.lit(" finding: "), verdict),
        severity,
        {
            "rt": _millis(F.col("ts_us")), "src": F.col("src_ip"), "dst": F.col("dst_ip"), "dpt": F.col("dst_port"),
            "msg": F.col("reasoning"), "externalId": F.col("evidence_id"),
            "cs1Label": F.lit("detector"), "cs1": detector,
        },
    )
    return evidence.select("evidence_id", line.alias("line"))


def incidents_cef(incident_table: DataFrame, p: ExportParams = ExportParams()) -> DataFrame:
    severity = when_chain([(F.col("risk_tier") == t, s) for t, s in TIER_SEVERITY.items()], 0)
    techniques = _comma("techniques")
    line = _cef(
        p,
        F.concat(F.lit("incident."), F.col("status")),
        F.concat(F.lit(f"{p.brand} incident ("), F.col("risk_tier"), F.lit("): "), F.col("key")),
        severity,
        {
            "rt": _millis(F.col("last_seen_us")),
            "src": F.when(F.col("key") != AGGREGATE_KEY, F.col("key")),
            "msg": F.col("risk_explanation"), "externalId": F.col("incident_id"),
            "cn1Label": F.lit("riskScore"), "cn1": F.col("risk_score"),
            "cs1Label": F.lit("detectorsInvolved"), "cs1": _comma("detectors_involved"),
            "cs2Label": F.lit("incidentStatus"), "cs2": F.col("status"),
            "cs3Label": F.lit("mitreTechniques"), "cs3": F.when(techniques != "", techniques),
        },
    )
    return incident_table.select("incident_id", line.alias("line"))


# ---- query views ----------------------------------------------------------------
def summary(incident_table: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(item, value): open incidents, open incidents by tier with every tier present, blocked addresses."""
    opened = open_incidents(latest_only(incident_table)).agg(
        F.count(F.lit(1)).alias("open_incidents"), *[F.count_if(F.col("risk_tier") == t).alias(t) for t in TIERS]
    )
    pairs = ", ".join(f"'tier_{t}', {t}" for t in TIERS)
    rows = opened.selectExpr(f"stack({len(TIERS) + 1}, 'open_incidents', open_incidents, {pairs}) as (item, value)")
    if blocked is None:
        return rows
    return rows.unionByName(blocked.agg(F.count(F.lit(1)).alias("value")).select(F.lit("blocked_ips").alias("item"), "value"))


def incident_list(incident_table: DataFrame, include_resolved: bool = False) -> DataFrame:
    latest = latest_only(incident_table)
    return latest if include_resolved else open_incidents(latest)


def incident_detail(bridge: DataFrame, incident_table: DataFrame, key: str) -> DataFrame:
    """The newest incident of one key with its evidence, one row per evidence row; no incident, no rows."""
    wanted = latest_only(incident_table.filter(F.col("key") == key)).drop("key", "incident_no")
    by = [c for c in ("sensor_id",) if c in bridge.columns and c in incident_table.columns]
    return timeline(bridge.filter(F.col("key") == key), by).join(wanted, [*by, "incident_id"])


def by_risk(incident_table: DataFrame, limit: int | None = None) -> DataFrame:
    """Most severe first; ``limit`` makes it a top-k."""
    ordered = incident_table.orderBy(F.desc("risk_score"), "key", "incident_no")
    return ordered if limit is None else ordered.limit(limit)


def fleet_summary(incident_table: DataFrame) -> DataFrame:
    """The one-page overview as (section, risk_score, key, incident_no, line).

    Print in the order section, risk_score descending, key, incident_no: heading and
    totals, table head, then a row per incident.
    """
    totals = incident_table.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == OPEN).alias("open"))
    bold = F.concat(
        F.lit("**"), F.col("n").cast("string"), F.lit(" total incidents, "), F.col("open").cast("string"),
        F.lit(" currently open.**"),
    )
    top = F.when(F.col("n") > 0, F.concat_ws("\n", F.lit("# Incident summary"), F.lit(""), bold, F.lit(""),
                 F.lit("| Source | Status | Risk | Detectors | Last seen |"), F.lit("|---|---|---|---|---|"))
                 ).otherwise("# Incident summary\n\nNo incidents recorded.")
    heading = totals.select(
        F.lit(0).alias("section"), F.lit(None).cast("int").alias("risk_score"), F.lit(None).cast("string").alias("key"),
        F.lit(None).cast("bigint").alias("incident_no"), top.alias("line"),
    )
    cells = F.concat_ws(
        " | ",
        _source("Aggregate (DDoS)"),
        F.col("status"),
        F.concat(F.col("risk_score").cast("string"), F.lit(" ("), F.col("risk_tier"), F.lit(")")),
        F.array_join("detectors_involved", ", "),
        utc_text(F.col("last_seen_us")),
    )
    rows = incident_table.select(
        F.lit(1).alias("section"), "risk_score", "key", "incident_no", F.concat(F.lit("| "), cells, F.lit(" |")).alias("line")
    )
    return heading.unionByName(rows)


def case_files(bridge: DataFrame, incident_table: DataFrame) -> DataFrame:
    """A Markdown case file per incident as (incident_id, section, line_order, line).

    Print in that order: head and techniques, risk, the timeline lines, then the closing fence.
    """
    facts = {t[0]: f"- **{t[0]}** — {t[1]} ({t[2]})" for t in TECHNIQUES}
    lookup = F.create_map(*[F.lit(x) for pair in facts.items() for x in pair])
    known = F.array_join(F.transform("techniques", lambda t: F.element_at(lookup, t)), "\n")
    none = "- No technique could be confidently attributed (see risk explanation below)."
    involved = F.array_join("detectors_involved", ", ")
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("# Incident report — "), F.col("incident_id")),
        F.lit(""),
        F.concat(F.lit("- **Source:** "), _source("Aggregate (cross-source DDoS)")),
        F.concat(F.lit("- **Status:** "), F.col("status")),
        F.concat(F.lit("- **Risk:** "), F.col("risk_score").cast("string"), F.lit("/100 ("), F.col("risk_tier"), F.lit(")")),
        F.concat(F.lit("- **Highest verdict recorded:** "), F.col("highest_verdict")),
        F.concat(F.lit("- **Detectors involved:** "), F.when(involved != "", involved).otherwise("none")),
        F.concat(F.lit("- **First seen:** "), utc_text(F.col("first_seen_us"))),
        F.concat(F.lit("- **Last seen:** "), utc_text(F.col("last_seen_us"))),
        F.lit("\n## MITRE ATT&CK techniques\n"),
        F.when(F.size("techniques") > 0, known).otherwise(none),
        F.lit("\n## Risk explanation\n"),
        F.col("risk_explanation"),
        F.lit("\n## Timeline\n\n```"),
    )

    def part(section: int, order: Column, line: Column) -> list[Column]:
        return [
            F.col("incident_id"), F.lit(section).alias("section"), order.cast("bigint").alias("line_order"), line.alias("line")
        ]

    top = incident_table.select(*part(0, F.lit(0), head))
    body = timeline_text(bridge, incident_table).select(*part(1, F.col("line_order"), F.col("line")))
    end = incident_table.select(*part(2, F.lit(0), F.lit("```")))
    return top.unionByName(body).unionByName(end)


# ---- session report -------------------------------------------------------------
def verdict_counts(results: DataFrame) -> DataFrame:
    """(verdict, flows) for every verdict, zero included."""
    verdicts = [WARMING_UP, NORMAL, SUSPICIOUS, ATTACK]
    counts = results.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in verdicts])
    pairs = ", ".join(f"'{v}', {v}" for v in verdicts)
    return counts.selectExpr(f"stack({len(verdicts)}, {pairs}) as (verdict, flows)")


def attack_outcomes(decisions: DataFrame) -> DataFrame:
    """A line per attack event with its block outcome."""
    outcome = F.when(F.col("applied"), "BLOCKED").otherwise(
        F.concat(F.lit("NOT BLOCKED ("), F.coalesce("skip_reason", F.lit("None")), F.lit(")"))
    )
    line = F.concat(
        F.lit("  ["), F.substring(utc_text(F.col("ts_us")), 12, 8), F.lit("] "), pad(F.col("attack_type"), 12),
        F.lit(" src="), pad(F.col("src_ip"), 17), F.lit(" "), outcome,
    )
    return decisions.select("seq", "attack_type", "src_ip", outcome.alias("outcome"), "reasoning", line.alias("line"))


def still_blocked(blocked: DataFrame) -> DataFrame:
    """Blocked addresses, longest remaining first."""
    return blocked.orderBy(F.desc("seconds_remaining"), "ip")


# ---- labelled summary -----------------------------------------------------------
def label_counts(labelled: DataFrame, column: str = "label") -> DataFrame:
    return labelled.groupBy(column).agg(F.count(F.lit(1)).alias("samples")).orderBy(F.desc("samples"), column)


def labelled_summary(labelled: DataFrame) -> DataFrame:
    """(section, name, samples, share): the total, the usable share, counts by label and by source.

    Both groupings come from one pass over the rows.
    """
    grouped = labelled.rollup("label_source", "label").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    total = F.max(F.when(F.col("level") == 3, F.col("n")))
    usable = F.coalesce(F.max(F.when((F.col("level") == 1) & (F.col("label_source") == "llm"), F.col("n"))), F.lit(0))
    head = grouped.agg(total.alias("total"), usable.alias("usable")).selectExpr(
        "stack(2, 'all', 'total', total, 100.0D, 'all', 'usable', usable, usable / total * 100) "
        "as (section, name, samples, share)"
    )
    by_label = grouped.filter("level = 0").groupBy(F.col("label").alias("name")).agg(F.sum("n").alias("samples"))
    by_source = grouped.filter("level = 1").select(F.col("label_source").alias("name"), F.col("n").alias("samples"))
    no_share = F.lit(None).cast("double").alias("share")
    return (
        head.unionByName(by_label.select(F.lit("label").alias("section"), "name", "samples", no_share))
        .unionByName(by_source.select(F.lit("source").alias("section"), "name", "samples", no_share))
    )

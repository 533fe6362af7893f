"""Evidence to incidents, fused risk, timelines.

An incident belongs to a source, or to the aggregate key when evidence names none.
SUSPICIOUS and ATTACK open one when none is open; UNAVAILABLE only attaches to an
open one; other verdicts never count. Operators resolve and reopen by key. The fold
is two ``scan`` calls: the state before each row, then the number of openings so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.functions.text import pad, utc_text, when_chain
from netspark.operators.scan import SEQUENCE_CHUNKS, Running, scan
from netspark.operators.techniques import TECHNIQUES, technique_id
from netspark.schemas import AGGREGATE_KEY, ATTACK, DETECTORS, OPEN, RESOLVED, SUSPICIOUS, UNAVAILABLE

# ---- fixed values ---------------------------------------------------------------
TRUST = {"ddos": 1.0, "port_scan": 1.0, "brute_force": 1.0, "anomaly": 0.5, "llm": 1.2}
POINTS = {SUSPICIOUS: 15, ATTACK: 30, UNAVAILABLE: 0}
CORROBORATION_BONUS = 10
SEVERITY = [UNAVAILABLE, SUSPICIOUS, ATTACK]
TIER_BOUNDS = [(24, "LOW"), (49, "MEDIUM"), (79, "HIGH"), (100, "CRITICAL")]
# ---------------------------------------------------------------------------------


def opens_incident(verdict: Column) -> Column:
    return verdict.isin(SUSPICIOUS, ATTACK)


def never_counts(verdict: Column) -> Column:
    return verdict.isin("NORMAL", "WARMING_UP")


def incident_key(src_ip: Column) -> Column:
    return F.coalesce(src_ip, F.lit(AGGREGATE_KEY))


def incident_id(key: Column, number: Column, sensor: Column | None = None) -> Column:
    parts = [key, number.cast("string")] + ([] if sensor is None else [sensor])
    return F.substring(F.sha2(F.concat_ws("#", *parts), 256), 1, 32)


def correlate(evidence: DataFrame, actions: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """The bridge: each attached evidence row, and each effective action, with its incident.

    Adds ``key``, ``incident_no``, ``incident_id``, ``kind`` ('evidence' or 'action'),
    ``is_new`` (the row opened the incident) and ``status_after``. ``keys`` names
    further grouping columns, such as a sensor, that keep sources apart.
    """
    extra = list(keys or [])
    by = ["key", *extra]
    rows = evidence.withColumn("key", incident_key(F.col("src_ip"))).filter(~never_counts(F.col("verdict")))
    rows = rows.withColumn("kind", F.lit("evidence")).withColumn(
        "sets", F.when(opens_incident(F.col("verdict")), F.lit(OPEN))
    )
    if actions is not None:
        # An action before the key's first opening changes nothing.
        first = rows.filter(F.col("sets").isNotNull()).groupBy(*by).agg(F.min("arrival_seq").alias("_first"))
        effective = actions.join(first, by).filter(F.col("arrival_seq") > F.col("_first"))
        sets = when_chain([(F.col("action") == "resolve", RESOLVED), (F.col("action") == "reopen", OPEN)])
        acted = effective.select("arrival_seq", *by, F.lit("action").alias("kind"), sets.alias("sets"))
        rows = rows.unionByName(acted, allowMissingColumns=True)

    known = scan(rows, by, "arrival_seq", {"state_before": Running("last", "sets", False)}, SEQUENCE_CHUNKS)
    opens = (F.col("kind") == "evidence") & F.col("sets").isNotNull()
    attached = opens | (F.col("kind") == "action") | (F.col("state_before") == OPEN)
    is_new = opens & (F.col("state_before").isNull() | (F.col("state_before") == RESOLVED))
    kept = known.filter(F.coalesce(attached, F.lit(False))).withColumn("_new", F.coalesce(is_new, F.lit(False)).cast("int"))
    numbered = scan(kept, by, "arrival_seq", {"incident_no": Running("sum", "_new")}, SEQUENCE_CHUNKS)
    sensor = F.concat_ws("#", *extra) if extra else None
    return numbered.select(
        *[c for c in evidence.columns if c not in by],
        *by,
        "incident_no",
        incident_id(F.col("key"), F.col("incident_no"), sensor).alias("incident_id"),
        "kind",
        (F.col("_new") == 1).alias("is_new"),
        F.coalesce("sets", "state_before").alias("status_after"),
    )


def attached_evidence(bridge: DataFrame) -> DataFrame:
    return bridge.filter("kind = 'evidence'")


# ---- risk -----------------------------------------------------------------------
def points(verdict: Column) -> Column:
    return when_chain([(verdict == v, p) for v, p in POINTS.items()], 0)


def risk_score(worst: dict[str, Column]) -> Column:
    """Worst points per detector times its trust, plus a bonus per further detector; ties to even, at most 100."""
    total, detectors = F.lit(0.0), F.lit(0)
    for detector, value in worst.items():
        value = F.coalesce(value, F.lit(0))
        total = total + value * F.lit(TRUST[detector])
        detectors = detectors + (value > 0).cast("int")
    total = total + F.greatest(detectors - 1, F.lit(0)) * CORROBORATION_BONUS
    return F.least(F.lit(100), F.bround(total, 0)).cast("int")


def risk_tier(score: Column) -> Column:
    return when_chain([(score <= bound, tier) for bound, tier in TIER_BOUNDS], "CRITICAL")


def contributing(worst: dict[str, Column]) -> Column:
    named = [F.when(F.coalesce(v, F.lit(0)) > 0, F.lit(d)) for d, v in sorted(worst.items())]
    return F.array_compact(F.array(*named))


def explanation(names: Column) -> Column:
    return F.when(F.size(names) == 0, "No corroborating evidence contributed to this score.").otherwise(
        F.concat(
            F.size(names).cast("string"), F.lit(" detector(s) corroborating ("),
            F.array_join(names, ", "), F.lit(")."),
        )
    )


def _worst_columns(prefix: str = "worst") -> dict[str, Column]:
    return {d: F.col(f"{prefix}_{d}") for d in DETECTORS}


def incidents(bridge: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per incident with span, detectors, risk and techniques.

    A single grouped aggregate of bounded state: detectors and techniques are fixed
    vocabularies, so each is a conditional min or max and nothing is collected.
    """
    extra = list(keys or [])
    shown = F.col("kind") == "evidence"
    tagged = bridge.withColumn("_points", F.when(shown, points(F.col("verdict")))).withColumn(
        "_technique", F.when(shown, technique_id(F.col("detector"), F.col("attack_type")))
    )
    seq = F.col("arrival_seq")
    rank = when_chain([(F.col("verdict") == v, i) for i, v in enumerate(SEVERITY)])
    grouped = tagged.groupBy("incident_id", "key", "incident_no", *extra).agg(
        F.max_by("status_after", "arrival_seq").alias("status"),
        F.min_by("ts_us", F.when(shown, seq)).alias("first_seen_us"),
        F.max(F.when(shown, F.col("ts_us"))).alias("last_seen_us"),
        F.count_if(shown).alias("evidence_count"),
        F.max(F.when(shown, rank)).alias("_rank"),
        *[F.max(F.when(F.col("detector") == d, F.col("_points"))).alias(f"worst_{d}") for d in DETECTORS],
        *[F.min(F.when(F.col("_technique") == t[0], seq)).alias(f"_seen_{i}") for i, t in enumerate(TECHNIQUES)],
    )
    worst = _worst_columns()
    names = contributing(worst)
    seen = F.array_compact(
        F.array(
            *[
                F.when(F.col(f"_seen_{i}").isNotNull(), F.struct(F.col(f"_seen_{i}").alias("seq"), F.lit(t[0]).alias("id")))
                for i, t in enumerate(TECHNIQUES)
            ]
        )
    )
    involved = F.array_compact(F.array(*[F.when(worst[d].isNotNull(), F.lit(d)) for d in sorted(DETECTORS)]))
    score = risk_score(worst)
    return grouped.select(
        "incident_id", "key", "incident_no", *extra, "status", "first_seen_us", "last_seen_us",
        involved.alias("detectors_involved"),
        "evidence_count",
        F.get(F.array(*[F.lit(v) for v in SEVERITY]), F.col("_rank")).alias("highest_verdict"),
        score.alias("risk_score"),
        risk_tier(score).alias("risk_tier"),
        names.alias("contributing_detectors"),
        explanation(names).alias("risk_explanation"),
        F.transform(F.array_sort(seen), lambda x: x["id"]).alias("techniques"),
    )


def latest_only(incident_table: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The newest incident of each key; ``keys`` tell apart what shares one, as the sensor does in merged tables."""
    if keys is None:
        keys = [c for c in ("sensor_id",) if c in incident_table.columns]
    newest = incident_table.groupBy(*keys, "key").agg(F.max("incident_no").alias("incident_no"))
    return incident_table.join(newest, [*keys, "key", "incident_no"])


def open_incidents(incident_table: DataFrame) -> DataFrame:
    return incident_table.filter(F.col("status") == OPEN)


def by_key(incident_table: DataFrame, key: str) -> DataFrame:
    return latest_only(incident_table.filter(F.col("key") == key))


def incident_techniques(bridge: DataFrame) -> DataFrame:
    """(incident, technique, first_seq): order by ``first_seq`` for first-seen order."""
    tagged = attached_evidence(bridge).withColumn("technique_id", technique_id(F.col("detector"), F.col("attack_type")))
    return (
        tagged.filter("technique_id is not null")
        .groupBy("incident_id", "key", "technique_id")
        .agg(F.min("arrival_seq").alias("first_seq"))
    )


def running_risk(bridge: DataFrame) -> DataFrame:
    """The incident's risk score and tier right after each attached evidence row."""
    rows = attached_evidence(bridge).select(
        "incident_id", "arrival_seq",
        *[F.when(F.col("detector") == d, points(F.col("verdict"))).alias(f"p_{d}") for d in DETECTORS],
    )
    out = {f"worst_{d}": Running("max", f"p_{d}") for d in DETECTORS}
    running = scan(rows, ["incident_id"], "arrival_seq", out, SEQUENCE_CHUNKS)
    score = risk_score(_worst_columns())
    return running.select(
        "incident_id", "arrival_seq", score.alias("risk_score"), risk_tier(score).alias("risk_tier")
    )


# ---- timelines ------------------------------------------------------------------
def timeline(bridge: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Evidence per incident, in arrival order (not time order)."""
    return attached_evidence(bridge).select(
        *(also or []), "incident_id", "key", "arrival_seq", "ts_us", "detector", "verdict", "reasoning",
        "src_ip", "dst_ip", "dst_port", "evidence_id",
    )


HEADER_ORDER = -1


def timeline_text(bridge: DataFrame, incident_table: DataFrame) -> DataFrame:
    """The rendered timeline, one row per line: (incident_id, line_order, line).

    A header per incident, then one line per evidence row. Sort by
    (incident_id, line_order) to print; no incident is ever held as one value.
    """
    header = F.concat(
        F.lit("Incident "), F.col("incident_id"), F.lit(" ("), F.col("key"), F.lit(") — status="),
        F.col("status"), F.lit(", highest_verdict="), F.col("highest_verdict"),
    )
    mark = F.lit("?")
    entry = F.concat(
        F.lit("  ["), utc_text(F.col("ts_us")), F.lit("] "), pad(F.col("detector"), 12), F.lit(" "),
        pad(F.col("verdict"), 10), F.lit(" "), F.coalesce("src_ip", mark), F.lit(" -> "),
        F.coalesce("dst_ip", mark), F.lit(":"), F.coalesce(F.col("dst_port").cast("string"), mark),
        F.lit("  ("), F.col("reasoning"), F.lit(")"),
    )
    headers = incident_table.select("incident_id", F.lit(HEADER_ORDER).cast("bigint").alias("line_order"), header.alias("line"))
    entries = attached_evidence(bridge).select("incident_id", F.col("arrival_seq").alias("line_order"), entry.alias("line"))
    return headers.unionByName(entries)


def merge_sensors(tables: dict[str, DataFrame]) -> DataFrame:
    """Incident tables of several sensors as one view, told apart by (sensor_id, incident_id)."""
    tagged = [df.withColumn("sensor_id", F.lit(sensor)) for sensor, df in tables.items()]
    merged = tagged[0]
    for df in tagged[1:]:
        merged = merged.unionByName(df)
    return merged

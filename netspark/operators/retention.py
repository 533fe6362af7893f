"""Retention: what to keep of the evidence and labelled tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netspark.operators.incidents import AGGREGATE_KEY
from netspark.params import RetentionParams

DAY_US = 86_400_000_000
BULK = ["NORMAL", "WARMING_UP"]
FINDINGS = ["SUSPICIOUS", "ATTACK", "UNAVAILABLE"]


def day_of(micros: int) -> Column:
    """The day column of stored evidence at this time."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.lit(micros // DAY_US).cast("int"))


def old_bulk(now_us: int, p: RetentionParams = RetentionParams()) -> Column:
    cutoff = now_us - int(p.bulk_days * DAY_US)
    return F.col("verdict").isin(*BULK) & (F.col("ts_us") < cutoff)


def old_finding(now_us: int, p: RetentionParams = RetentionParams()) -> Column:
    cutoff = now_us - int(p.finding_days * DAY_US)
    return F.col("verdict").isin(*FINDINGS) & (F.col("ts_us") < cutoff)


def with_open_flag(evidence: DataFrame, incident_table: DataFrame) -> DataFrame:
    """Mark rows whose key has an open incident (a row without source counts for the aggregate key).

    Rows without source are told by one value and take no part in the join.
    """
    open_keys = incident_table.filter("status = 'OPEN'").select(F.col("key").alias("_key")).distinct()
    aggregate = open_keys.agg(F.coalesce(F.bool_or(F.col("_key") == AGGREGATE_KEY), F.lit(False))).scalar()
    flagged = open_keys.withColumn("key_is_open", F.lit(True))
    sourced = evidence.filter(F.col("src_ip").isNotNull()).join(flagged, F.col("src_ip") == F.col("_key"), "left").drop("_key")
    sourced = sourced.withColumn("key_is_open", F.coalesce("key_is_open", F.lit(False)))
    return sourced.unionByName(evidence.filter(F.col("src_ip").isNull()).withColumn("key_is_open", aggregate))


def evidence_tier(evidence: DataFrame, incident_table: DataFrame, now_us: int, p: RetentionParams = RetentionParams()) -> DataFrame:
    """Add ``removed_by``: 'bulk', 'finding' or null. Findings of an open incident stay."""
    return with_open_flag(evidence, incident_table).withColumn(
        "removed_by",
        F.when(old_bulk(now_us, p), "bulk").when(old_finding(now_us, p) & ~F.col("key_is_open"), "finding"),
    ).drop("key_is_open")


#: Characters of the timestamp text that name a day, and a second: what is counted before rows are ranked.
_CUTS = (10, 19)


def kept_samples(labelled: DataFrame, p: RetentionParams = RetentionParams()) -> DataFrame:
    """The newest ``samples_per_label`` rows of each label, by timestamp text then id.

    Counts per label and day say which days stay whole, which go, and on which one the cap falls. On that day
    the same is done by seconds, and only the rows of the second on which the cap falls are ranked. So a label
    with most of the rows is counted map-side and never gathered.
    """
    rest = labelled.withColumn("_room", F.lit(p.samples_per_label).cast("bigint"))
    kept = []
    for cut in _CUTS:
        part = F.coalesce(F.substring("timestamp", 1, cut), F.lit(""))
        rest = rest.withColumn("_part", part)
        sizes = rest.groupBy("label", "_room", "_part").agg(F.count(F.lit(1)).alias("_n"))
        newer = Window.partitionBy("label").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
        left = F.col("_room") - F.coalesce(F.sum("_n").over(newer), F.lit(0))
        told = sizes.withColumn("_left", left).filter("_left > 0")
        told = told.select(F.col("label").alias("_label"), F.col("_part").alias("_in"), "_left", (F.col("_n") <= F.col("_left")).alias("_whole"))
        joined = rest.join(told, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_part") == F.col("_in"))).drop("_label", "_in", "_part", "_room")
        kept.append(joined.filter("_whole").drop("_left", "_whole"))
        rest = joined.filter("not _whole").drop("_whole").withColumnRenamed("_left", "_room")
    newest = Window.partitionBy("label").orderBy(F.desc("timestamp"), F.desc("id"))
    last = rest.withColumn("_rank", F.row_number().over(newest)).filter("_rank <= _room").drop("_rank", "_room")
    return kept[0].unionByName(kept[1]).unionByName(last)


def retain(
    evidence: DataFrame, labelled: DataFrame, incident_table: DataFrame, now_us: int, p: RetentionParams = RetentionParams()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evidence kept, labelled kept, rows removed per tier)."""
    tiers = evidence_tier(evidence, incident_table, now_us, p)
    samples = kept_samples(labelled, p)
    stats = retention_stats(tiers, labelled, p)
    return tiers.filter("removed_by is null").drop("removed_by"), samples, stats


def retention_stats(tiers: DataFrame, labelled: DataFrame, p: RetentionParams = RetentionParams()) -> DataFrame:
    """(tier, removed): the overflow of a label follows from its count, so nothing is ranked."""
    from_evidence = tiers.agg(
        F.count_if(F.col("removed_by") == "bulk").alias("bulk_evidence"),
        F.count_if(F.col("removed_by") == "finding").alias("finding_evidence"),
    ).selectExpr("stack(2, 'bulk_evidence', bulk_evidence, 'finding_evidence', finding_evidence) as (tier, removed)")
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    overflow = counts.agg(
        F.coalesce(F.sum(F.greatest(F.col("n") - p.samples_per_label, F.lit(0))), F.lit(0)).alias("removed")
    ).select(F.lit("training_samples").alias("tier"), "removed")
    return from_evidence.unionByName(overflow)

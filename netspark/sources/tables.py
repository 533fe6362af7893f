"""The stored tables: evidence by day, labelled rows, audit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netspark.operators.retention import DAY_US, day_of, evidence_tier
from netspark.params import RetentionParams
from netspark.schemas import FEATURE_COLUMNS
from netspark.session import stage


def append_evidence(evidence: DataFrame, path: str) -> None:
    """Append, partitioned by event day so that retention and time filters prune folders."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts_us") / F.lit(86_400_000_000)).cast("int"))
    evidence.withColumn("event_date", day).write.mode("append").partitionBy("event_date").parquet(path)


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def rewrite_evidence(
    spark: SparkSession, path: str, incident_table: DataFrame, now_us: int, p: RetentionParams = RetentionParams()
) -> list[str]:
    """Apply retention to the stored evidence; gives the days that went entirely.

    Only days that may hold old rows are read and written. What stays of them is staged first, then put in
    place of their folders, then folders of which nothing stays are dropped; a rerun after a loss in between
    finds old rows again and goes on.
    """
    newest_cut = now_us - int(min(p.bulk_days, p.finding_days) * DAY_US)
    old = read_evidence(spark, path).filter(F.col("event_date") <= day_of(newest_cut))
    kept = stage(evidence_tier(old, incident_table, now_us, p).filter("removed_by is null").drop("removed_by"), "kept-evidence")
    days = {r[0] for r in old.select("event_date").distinct().collect()}  # a row per day
    left = {r[0] for r in kept.select("event_date").distinct().collect()}
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)
    gone = sorted(str(day) for day in days - left)
    for day in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/event_date={day}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return gone


def rewrite_labelled(spark: SparkSession, path: str, keep) -> None:
    """Replace the labelled rows by ``keep(rows)``: the sample cap, or a clean-up of stale or wrong labels."""
    kept = stage(keep(read_labelled(spark, path)), "kept-labelled")
    kept.write.mode("overwrite").partitionBy("label_source").parquet(path)


def append_labelled(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("compression", "zstd").partitionBy("label_source").parquet(path)


def read_labelled(spark: SparkSession, path: str, confidence: str | None = None) -> DataFrame:
    """All rows, or those of exactly one confidence; the filter reaches the scan."""
    rows = spark.read.parquet(path)
    return rows if confidence is None else rows.filter(F.col("confidence") == confidence)


def with_features(labelled: DataFrame) -> DataFrame:
    """Stored features decoded to a struct of doubles."""
    schema = ", ".join(f"`{c}` double" for c in FEATURE_COLUMNS)
    return labelled.withColumn("features", F.from_json("all_features", schema))


def append_audit(actions: DataFrame, path: str) -> None:
    """Block and unblock actions as JSON lines."""
    actions.write.mode("append").json(path)

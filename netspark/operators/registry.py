"""Model versions as tables: when to retrain, registration, promotion, pruning.

``versions`` has one row per trained model, and ``promotions`` is an append-only log
(version, promoted_seq) whose latest row names the active model; promoting an older
version is a rollback. Both have as many rows as training runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netspark.params import TrainingParams


class UnknownVersion(ValueError):
    pass


def active_version(promotions: DataFrame) -> DataFrame:
    """One row: the active version, null when nothing was promoted."""
    return promotions.agg(F.max_by("version", "promoted_seq").alias("version"))


def retrain_due(
    labelled: DataFrame, versions: DataFrame, promotions: DataFrame, p: TrainingParams = TrainingParams()
) -> DataFrame:
    """One row (samples, last_samples, new_samples, due).

    ``samples`` counts every reviewed row, while a version records the rows it was
    trained on after filtering, so stale rows bring the next run forward.
    """
    last = versions.join(active_version(promotions), "version").agg(
        F.coalesce(F.max("sample_count"), F.lit(0)).alias("last")
    )
    counted = labelled.filter(F.col("label_source").isin(*p.sources)).agg(F.count(F.lit(1)).alias("samples"))
    new = F.col("samples") - F.col("last_samples")
    return (
        counted.withColumn("last_samples", last.scalar())
        .withColumn("new_samples", new)
        .withColumn("due", F.col("new_samples") >= p.retrain_threshold)
    )


def auto_promotions(versions: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """The promotion log: registrations that promote themselves, and manual promotions, in order.

    A version is promoted on registration when none is active or when it beats the active one.
    ``manual`` has (version, after_version): ``version`` was promoted by hand right after ``after_version``
    was registered. From then on it is the one to beat, so each manual promotion starts a new stretch
    and within a stretch the active score is the best so far.
    """
    known = versions.select("version", "f1_macro")
    rows = known.select(F.col("version").alias("at"), F.lit(0).alias("by_hand"), "version", "f1_macro")
    if manual is not None:
        rows = rows.unionByName(
            manual.join(known, "version").select(F.col("after_version").alias("at"), F.lit(1).alias("by_hand"), "version", "f1_macro")
        )
    in_order = Window.partitionBy(F.lit(0)).orderBy("at", "by_hand", "version")
    rows = rows.withColumn("promoted_seq", F.row_number().over(in_order).cast("bigint"))
    by_seq = Window.partitionBy(F.lit(0)).orderBy("promoted_seq")
    rows = rows.withColumn("_stretch", F.sum("by_hand").over(by_seq))
    before = Window.partitionBy("_stretch").orderBy("promoted_seq").rowsBetween(Window.unboundedPreceding, -1)
    best = F.max("f1_macro").over(before)
    promoted = (F.col("by_hand") == 1) | F.col("_best").isNull() | (F.col("f1_macro") > F.col("_best"))
    return rows.withColumn("_best", best).filter(promoted).select("version", "promoted_seq")


def register(versions: DataFrame, candidate: DataFrame) -> DataFrame:
    """Append a candidate; the active pointer stays."""
    return versions.unionByName(candidate.withColumn("promoted", F.lit(False)))


def promote(versions: DataFrame, promotions: DataFrame, version: str) -> DataFrame:
    """The promotion log with ``version`` on top."""
    if versions.filter(F.col("version") == version).isEmpty():
        raise UnknownVersion(f"model version {version!r} not found")
    on_top = promotions.agg((F.coalesce(F.max("promoted_seq"), F.lit(0)) + 1).alias("promoted_seq"))
    return promotions.unionByName(on_top.select(F.lit(version).alias("version"), "promoted_seq"))


def list_versions(versions: DataFrame, promotions: DataFrame) -> DataFrame:
    """All versions, newest first, with the active one flagged."""
    active = active_version(promotions).withColumnRenamed("version", "_active")
    flagged = versions.join(active, F.col("version") == F.col("_active"), "left")
    return flagged.withColumn("promoted", F.col("_active").isNotNull()).drop("_active").orderBy(F.desc("version"))


def prune(versions: DataFrame, promotions: DataFrame, keep: DataFrame) -> DataFrame:
    """Versions to delete: neither in ``keep`` nor active."""
    active = active_version(promotions).filter("version is not null")
    protected = keep.select("version").unionByName(active)
    return versions.join(protected, "version", "left_anti")

"""Places of rows in a sorted table, without a window over the table or over a large group.

Rows are range-partitioned and sorted; a row's place is its place in its partition plus what the partitions before it
hold. Only counts per partition and group are summed over, so the largest window has a row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netspark.llm.common import cut

_LOW = (1 << 33) - 1


def ranked(rows: DataFrame, keys: list[Column], within: list[str] | None = None, weight: str | None = None, place: str = "place", total: str = "total") -> DataFrame:
    """The rows with `place`, the number (or the sum of `weight`) of rows before each in the order of `keys`, and `total`, that of all.

    With `within`, the columns that `keys` must begin with, both are told for each of their values by itself. The rows are
    checkpointed with their order, so a lost executor can't change it. `rows` is read twice, for the ranges and for the
    order: checkpoint what is dear. Rows that are equal in all keys come in any order: add a key where that matters.
    """
    groups = [F.col(f"`{c}`") for c in within or []]
    names = [f"_g{i}" for i in range(len(groups))]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The id counts from the partition's number times 2^33 on.
    marked = cut(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    amount = F.col(f"`{weight}`").cast("bigint") if weight else F.lit(1).cast("bigint")
    sums = marked.groupBy(part.alias("_part"), *(g.alias(n) for g, n in zip(groups, names, strict=True))).agg(F.min("_at").alias("_first"), F.sum(amount).alias("_held"))
    own = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    offsets = sums.withColumns(
        {
            "_before": F.sum("_held").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_held"),
            "_total": F.sum("_held").over(own),
        }
    )
    same = part == F.col("_part")
    for g, n in zip(groups, names, strict=True):
        same = same & g.eqNullSafe(F.col(n))
    if weight:
        run = Window.partitionBy(part, *groups).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        marked = marked.withColumn("_run", F.sum(amount).over(run) - amount)
    inside = F.col("_run") if weight else F.col("_at") - F.col("_first")
    kept = [F.col(f"`{c}`") for c in rows.columns]
    return marked.join(offsets, same).select(*kept, (F.col("_before") + inside).alias(place), F.col("_total").alias(total))

"""Ordered running values per key that no hot key can pin to one task.

A plain ``Window.partitionBy(key).orderBy(ts)`` sorts a whole key in one task, so
one source or one elephant flow holding a third of the rows would stall the job.
``scan`` cuts every key into chunks of its order column, computes the running
value inside each chunk, computes the same running value over the (much smaller)
per-chunk totals, and adds what was carried in. Order values are unique within a
key, so a chunk of width ``w`` never holds more than ``w`` rows, whatever the skew.

The totals are a grouped aggregate with map-side combine; the carry is an equi
join on (keys, chunk). The totals of one key are bounded by the calendar (or the
sequence range) and not by the rows; a further width repeats the cut on them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Microsecond order columns: 2^24 us (16.8 s) chunks, so a year is under two million totals.
TIME_CHUNKS = (1 << 24,)
# Windows of their own length: one key's rows of this many windows are a chunk, so that a quiet key has one or two.
WINDOWS_PER_CHUNK = 4
# Sequence numbers: at most 2^20 rows a chunk, so 10^12 rows are under a million totals.
SEQUENCE_CHUNKS = (1 << 20,)


@dataclass(frozen=True)
class Running:
    """One running column: ``sum``, ``max``, or ``last`` non-null value of ``column``.

    ``inclusive`` takes the current row in; otherwise only rows strictly before it.
    """

    kind: str
    column: str
    inclusive: bool = True


def window_chunks(window_us: int) -> tuple[int, ...]:
    """The chunk width for changes that a window's length lies between: a key with a row a window or fewer would
    otherwise have a total per row, which is dealt three times more.
    """
    return (max(TIME_CHUNKS[0], 1 << (window_us * WINDOWS_PER_CHUNK).bit_length()),)


def scan(
    df: DataFrame,
    keys: list[str],
    order: str,
    out: dict[str, Running],
    widths: tuple[int, ...] = TIME_CHUNKS,
    reverse: bool = False,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """Add each ``out`` column. ``keys`` are non-null; ``order`` is a long, unique per key.

    Where ``df`` has the keys, the order, the running columns and ``also`` (what else the caller reads of the result) and
    nothing more, rows and totals are read from one exchange; rows without an order value then have no place. It is
    one only if Spark knows that the keys are not null.
    """
    if reverse:
        flipped = scan(df.withColumn("_rev", -F.col(order)), keys, "_rev", out, widths, also=(*also, order))
        return flipped.drop("_rev")
    return _scan(df, keys, order, out, widths, 0, also)


def _scan(df, keys, order, out, widths, level, also=()) -> DataFrame:
    if not widths:
        window = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
        return df.select("*", *[_local(r, window).alias(name) for name, r in out.items()])

    chunk = f"_chunk{level}"
    by = [*keys, chunk]
    chunked = df.withColumn(chunk, F.expr(f"`{order}` div {widths[0]}L"))
    shared = level == 0 and set(df.columns) <= {*keys, order, *also, *(r.column for r in out.values())}
    if shared:
        chunked = chunked.filter(F.col(chunk).isNotNull()).repartition(*by)
    window = Window.partitionBy(*by).orderBy(order)
    local = chunked.select("*", *[_local(r, window).alias(f"_l{level}_{n}") for n, r in out.items()])

    sums = [_total(r, order).alias(f"_t{level}_{n}") for n, r in out.items()]
    if shared:
        # Totals that read every column are not given an exchange of their own with fewer.
        sums.append(F.max(F.hash(*df.columns)).alias("_all"))
    totals = chunked.groupBy(*by).agg(*sums)
    if shared:
        totals = totals.filter("_all is not null").drop("_all")
    carry_out = {f"_c{level}_{n}": Running(r.kind, f"_t{level}_{n}", False) for n, r in out.items()}
    carried = _scan(totals, keys, chunk, carry_out, widths[1:], level + 1).select(*by, *carry_out)

    # A chunk that carries nothing in (every key's first, so most) needs no partner.
    brings = [F.col(c) != 0 if r.kind == "sum" else F.col(c).isNotNull() for c, r in carry_out.items()]
    joined = local.join(carried.filter(reduce(Column.__or__, brings)), by, "left")
    results = [
        _combine(r.kind, F.col(f"_c{level}_{n}"), F.col(f"_l{level}_{n}")).alias(n) for n, r in out.items()
    ]
    return joined.select(*df.columns, *results)


def _local(r: Running, window) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow if r.inclusive else -1)
    if r.kind == "sum":
        return F.coalesce(F.sum(r.column).over(frame), F.lit(0))
    if r.kind == "max":
        return F.max(r.column).over(frame)
    return F.last(r.column, ignorenulls=True).over(frame)


def _total(r: Running, order: str) -> Column:
    if r.kind == "sum":
        return F.coalesce(F.sum(r.column), F.lit(0))
    if r.kind == "max":
        return F.max(r.column)
    return F.max_by(r.column, F.when(F.col(r.column).isNotNull(), F.col(order)))


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + local
    if kind == "max":
        return F.greatest(carried, local)
    return F.coalesce(local, carried)


def window_deltas(events: DataFrame, keys: list[str], ts: str, window_us: int, arrivals: bool = False) -> DataFrame:
    """Row-count changes of the closed trailing window: +1 at ts, -1 just after ts + W.

    Columns: keys, ``t``, ``change``, and on request ``arrivals`` (rows at ``t``).
    Changes at one instant are summed first, with map-side combine, so rows at equal
    times all count for each other.
    """
    steps = F.array(
        F.struct(F.col(ts).alias("t"), F.lit(1).alias("change")),
        F.struct((F.col(ts) + F.lit(window_us + 1)).alias("t"), F.lit(-1).alias("change")),
    )
    sums = [F.sum("change").alias("change")]
    if arrivals:
        sums.append(F.count_if(F.col("change") > 0).alias("arrivals"))
    return events.select(*keys, F.inline(steps)).groupBy(*keys, "t").agg(*sums)


def crossing(after: Column, change: Column) -> Column:
    """+1 where a running count leaves zero, -1 where it returns to zero, else 0."""
    return (after > 0).cast("int") - ((after - change) > 0).cast("int")

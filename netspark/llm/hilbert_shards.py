"""Sharding by Hilbert-curve order: several metadata dimensions become cells, rows are sorted by their cell's place on
the curve, and the order is cut into runs. A run covers few cells that lie side by side, so the ranges of language,
source and size in a shard's files are narrow and a reader that asks for some of them skips the other shards.

Dimensions are quantised by rows: a value's cell is the share of rows with smaller values, so a hot value takes the room
that its rows take. Only the first value of each cell (`cells` per dimension) goes to the driver. The curve is a finite
automaton over the bits of the cells, from the highest down; its two tables are built from the rule of the curve.

Laws: `rows` cuts into runs whose counts are at most one apart, `bytes` where the sum of sizes passes each share of the
total (off by one document's size at most). Everything is DataFrame functions.

A null text has no bytes and the crc32 of no bytes; a null language or source, or a null number, comes before all others. Empty
texts have size 1. Rows with the same cell come in order of doc_id (nulls first), checksum and hash, so copies with ids of
their own are in a defined order; rows that are wholly alike may swap places. Long texts are read once, for their size,
checksum and hash; of long languages and sources the first KEY characters count. An empty table gives no rows.
Only doc_id, text, lang and source are read, so other columns may have any name; `write` keeps them all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.llm.common import cut
from netspark.llm.ranks import ranked

#: Characters of a text dimension that count.
KEY = 64


@dataclass(frozen=True)
class HilbertParams:
    shards: int = 8
    law: str = "rows"
    #: Cells per dimension, as a power of two.
    bits: int = 6


def text_key(column: str) -> Column:
    """A text as a sort key in which null comes first."""
    return F.coalesce(F.concat(F.lit("="), F.left(F.col(column).cast("string"), F.lit(KEY))), F.lit(""))


def number_key(column: str) -> Column:
    """A whole number as a sort key in which null comes first: digits of one length."""
    moved = (F.col(column).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string")
    return F.coalesce(F.lpad(moved, 20, "0"), F.lit(""))


#: What the curve runs over, and how its values are made sort keys.
DIMENSIONS = {"lang": text_key, "source": text_key, "size": number_key}


def automaton(dimensions: int) -> tuple[list[int], list[int]]:
    """(digit, next state) by state * 2^dimensions + the bits of the coordinates.

    A state is the corner at which a cube is entered, times `dimensions`, plus the axis along which it is left. A cube's
    corners are visited in Gray-code order, turned and mirrored by the state; state 0 is the whole cube's.
    """
    n, ones = dimensions, (1 << dimensions) - 1
    left = lambda v, k: ((v << k % n) | (v >> (n - k % n))) & ones
    gray = lambda i: i ^ (i >> 1)
    order = {gray(i): i for i in range(1 << n)}
    trailing = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  set bits at the low end
    digits, states = [], []
    for entry in range(1 << n):
        for axis in range(n):
            for corner in range(1 << n):
                digit = order[left(corner ^ entry, n - (axis + 1) % n)]
                begin = gray((digit - 1) // 2 * 2) if digit else 0
                turn = 0 if digit == 0 else trailing(digit - 1 if digit % 2 == 0 else digit) % n
                digits.append(digit)
                states.append((entry ^ left(begin, axis + 1)) * n + (axis + turn + 1) % n)
    return digits, states


def curve_index(cells: list[Column], bits: int) -> Column:
    """Place of a cell on the Hilbert curve through the cube of 2^bits cells a side."""
    n = len(cells)
    if n * bits > 62:
        raise ValueError("an index has at most 62 bits")
    digits, states = (F.array(*(F.lit(x) for x in table)) for table in automaton(n))

    def corner(i: Column) -> Column:
        out = F.lit(0)
        for k, cell in enumerate(cells):
            bit = F.call_function("shiftright", cell.cast("int"), i).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.call_function("shiftleft", bit, F.lit(k)))
        return out

    def step(at: Column, low: Column) -> Column:
        entry = at["state"] * F.lit(1 << n) + low
        return F.struct(
            (at["index"] * F.lit(1 << n).cast("bigint") + F.get(digits, entry)).alias("index"),
            F.get(states, entry).alias("state"),
        )

    corners = F.transform(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), corner)
    start = F.struct(F.lit(0).cast("bigint").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(corners, start, step, lambda at: at["index"])


def edges(rows: DataFrame, names: list[str], cells: int) -> dict[str, list[str]]:
    """For each key column the first values of its cells, in order: at most `cells` each."""
    tall = rows.select(F.explode(F.array(*(F.struct(F.lit(name).alias("dimension"), F.col(name).alias("value")) for name in names))).alias("x")).select("x.*")
    counts = cut(tall.groupBy("dimension", "value").agg(F.count("*").alias("rows")))
    placed = ranked(counts, [F.col("dimension"), F.col("value")], ["dimension"], "rows")
    first = placed.groupBy("dimension", F.expr(f"place * {cells} div total").alias("cell")).agg(F.min("value").alias("value"))
    found: dict[str, list[str]] = {name: [] for name in names}
    for row in first.collect():
        found[row["dimension"]].append(row["value"])
    return {name: sorted(values, key=str.encode) for name, values in found.items()}


def _cell(key: Column, firsts: list[str], cells: int) -> Column:
    """The cell of a value: how many cells begin at or before it, spread over the side of the cube."""
    if len(firsts) < 2:
        return F.lit(0)
    begun = F.size(F.filter(F.array(*(F.lit(x) for x in firsts)), lambda first: first <= key)) - F.lit(1)
    return F.floor(begun * F.lit(cells) / F.lit(len(firsts))).cast("int")


def assigned(docs: DataFrame, params: HilbertParams = HilbertParams(), carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, curve (the place on the curve), shard and slot (place in the shard) of every row, the keys of
    DIMENSIONS as key_*; with `carry` the whole row as `doc`."""
    if params.law not in ("rows", "bytes"):
        raise ValueError(f"no such law: {params.law}")
    cells = 1 << params.bits
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")] if carry else []
    measured = docs.select(
        F.col("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text).cast("bigint") + F.lit(1)).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text, F.col("lang").cast("string"), F.col("source").cast("string")).alias("hash"),
        *whole,
    )
    # The last key parts rows that are alike in everything, so that many of them spread over many ranges.
    keyed = cut(measured.select("doc_id", "size", "text_crc32", "hash", *(key(name).alias(f"key_{name}") for name, key in DIMENSIONS.items()), F.monotonically_increasing_id().alias("copy"), *(["doc"] if carry else [])))
    names = [f"key_{name}" for name in DIMENSIONS]
    firsts = edges(keyed, names, cells)
    placed = keyed.withColumn("curve", curve_index([_cell(F.col(name), firsts[name], cells) for name in names], params.bits))
    order = [F.col(c) for c in ("curve", "doc_id", "text_crc32", "hash", "copy")]
    rows = ranked(placed, order, weight="size" if params.law == "bytes" else None)
    cutted = rows.withColumn("shard", F.expr(f"cast(place * cast({params.shards} as decimal(20,0)) div total as int)"))
    if params.law == "rows":
        # The first place of shard s is the least one with place * shards >= s * total.
        slot = F.expr(f"cast(place - (shard * cast(total as decimal(20,0)) + {params.shards - 1}) div {params.shards} as bigint)")
        out = cutted.withColumn("slot", slot)
    else:
        out = ranked(cut(cutted.drop("place", "total")), [F.col("shard"), *order], ["shard"], place="slot")
    return out.select("doc_id", "size", "text_crc32", *names, "curve", "shard", "slot", *(["doc"] if carry else []))


def ranges(rows: DataFrame) -> DataFrame:
    """For each shard its rows, bytes, and the least and greatest key of each dimension, by which a reader skips shards."""
    names = [f"key_{name}" for name in DIMENSIONS]
    bounds = [f(name).alias(f"{kind}_{name}") for name in names for kind, f in (("least", F.min), ("most", F.max))]
    return rows.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *bounds)


def write(docs: DataFrame, path: str, params: HilbertParams = HilbertParams()) -> None:
    """All columns of the documents as Parquet, a folder per shard, each file a run of the curve in order."""
    shard = "shard"
    while shard in docs.columns:
        shard += "_"
    rows = assigned(docs, params, carry=True).select(F.col("shard").alias("_shard"), F.col("slot").alias("_slot"), "doc")
    runs = rows.repartitionByRange(F.col("_shard"), F.col("_slot")).sortWithinPartitions("_shard", "_slot")
    runs.select(F.col("_shard").alias(shard), *(F.col(f"doc.`{c}`").alias(c) for c in docs.columns)).write.partitionBy(shard).parquet(path)


def shards(docs: DataFrame, params: HilbertParams = HilbertParams()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: these laws move rows when shards are added) and curve."""
    return assigned(docs, params).select(
        "doc_id", "size", "text_crc32", F.lit(params.law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )

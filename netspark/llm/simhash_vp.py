"""SimHash near-duplicates through vantage-point trees.

Fingerprints are 64-bit. Two that differ in at most `bits` bits differ in at most `bits // 2` within one of their
halves, so there is a tree per half, which is searched with that smaller radius, and each find is checked on all 64
bits. A node of a tree has a vantage fingerprint and the median distance to it: residents within the median go
inside, the others outside, and by the triangle inequality a query has to look inside only if it is nearer than the
median plus the radius, outside only if it is farther than the median less the radius. Where a half can't part the
residents (many equal halves), the node measures all 64 bits with the whole radius.

The upper levels come from a bounded sample and name the shards: every fingerprint lives in one shard of each tree and
is sent as a query to the shards that its ball overlaps. Inside a shard the same recursion goes on over arrays. A shard
gives a spanning forest of its links, never all pairs of a dense group. Equal fingerprints are one node from the start.

Words are runs without space and \\t-\\r, after A-Z is lower-cased; a null or empty text has no words and fingerprint zero.
A document of fewer words than a shingle has one shingle. Repeated rows are copies like any others. A null doc_id
counts for nothing in the smallest id, so a component of such rows alone has a null component_id.
An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netspark.llm.common import cut, slices
from netspark.llm.components import components

SHINGLE, SEED, BITS = 3, 42, 3
#: Fingerprints wanted in a shard; the sample (a few MB on the driver at most) limits how many shards there can be.
SHARD, SAMPLES_PER_SHARD, MOST_SAMPLES = 20_000, 32, 1 << 18
#: Residents of a leaf inside a shard, which are compared with its queries directly.
LEAF = 64
SLICE = 8 << 20
ALL = 0xFFFFFFFFFFFFFFFF
HALVES = (0xFFFFFFFF00000000, 0x00000000FFFFFFFF)
_BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Bits that are set in over half the hashes of the text's shingles."""
    plain = b" ".join((text or "").encode().lower().split())
    if not plain:
        return 0
    gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32).tolist()
    starts, ends = [0, *(g + 1 for g in gaps)], [*gaps, len(plain)]
    if len(starts) <= width:
        starts, ends = [0], [len(plain)]
    else:
        starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _BLOCK):
        some = np.array([hashed(plain[a:b], SEED) for a, b in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK], strict=True)], ">u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and `bits`, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE):
            bits = np.array([fingerprint(x) for x in part.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits)], names=[key, "bits"])

    chosen = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, bits bigint")


@dataclass
class Node:
    """A vantage point, or a leaf (shard) if there is none."""

    shard: int = -1
    mask: int = ALL
    vantage: int = 0
    median: int = 0
    radius: int = 0
    inside: Node | None = None
    outside: Node | None = None


def distance(values: np.ndarray, vantage: int, mask: int) -> np.ndarray:
    return np.bitwise_count((values ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int16)


def parted(values: np.ndarray, mask: int, bits: int) -> tuple[Node, np.ndarray] | None:
    """A vantage point that parts the values, and their distances to it; None if all of them are equal."""
    for measure in (mask, ALL):
        vantage = int(values[len(values) // 2])
        away = distance(values, vantage, measure)
        if away.max() > away.min():
            median = min(int(np.median(away)), int(away.max()) - 1)
            return Node(mask=measure, vantage=vantage, median=median, radius=bits if measure == ALL else bits // 2), away
    return None


def grow(sample: np.ndarray, mask: int, bits: int, least: int, shards: list[int]) -> Node:
    """The upper tree over a sample; leaves are numbered in `shards`."""
    split = parted(sample, mask, bits) if len(sample) > least else None
    if split is None:
        shards.append(len(shards))
        return Node(shard=shards[-1])
    node, away = split
    node.inside = grow(sample[away <= node.median], node.mask, bits, least, shards)
    node.outside = grow(sample[away > node.median], node.mask, bits, least, shards)
    return node


def route(node: Node, values: np.ndarray, at: np.ndarray, home: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, places, lives there) for every shard that a ball around a value overlaps."""
    if len(at) == 0:
        return
    if node.inside is None:
        yield node.shard, at, home
        return
    away = distance(values[at], node.vantage, node.mask)
    near, far = away <= node.median + node.radius, away > node.median - node.radius
    yield from route(node.inside, values, at[near], (home & (away <= node.median))[near])
    yield from route(node.outside, values, at[far], (home & (away > node.median))[far])


class Forest:
    """Components among the places of an array, from links given bit by bit."""

    def __init__(self, size: int):
        self.label, self.held, self.waiting = np.arange(size), [], 0

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.waiting += len(a)
        if self.waiting > 1 << 20:
            self.settle()

    def settle(self) -> np.ndarray:
        if self.held:
            a, b = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held, self.waiting, label = [], 0, self.label
            while True:
                low = np.minimum(label[a], label[b])
                if (label[a] == low).all() and (label[b] == low).all():
                    break
                for end in (a, b):
                    np.minimum.at(label, label[end], low)
                while (label[label] != label).any():
                    label = label[label]
            self.label = label
        return self.label


def search(values: np.ndarray, queries: np.ndarray, residents: np.ndarray, mask: int, bits: int, found: Forest) -> None:
    """Link each query with the residents within `bits` bits; both are places of `values`."""
    if len(queries) == 0 or len(residents) == 0:
        return
    split = parted(values[residents], mask, bits) if len(residents) > LEAF else None
    if split is None:
        for start in range(0, len(queries), _BLOCK // LEAF):
            some = queries[start : start + _BLOCK // LEAF]
            for first in range(0, len(residents), LEAF):
                block = residents[first : first + LEAF]
                q, r = np.nonzero(np.bitwise_count(values[some][:, None] ^ values[block][None, :]) <= bits)
                found.link(some[q], block[r])
        return
    node, away = split
    to = distance(values[queries], node.vantage, node.mask)
    inside, near = residents[away <= node.median], queries[to <= node.median + node.radius]
    if node.mask == ALL and node.median <= bits:
        # All of these residents are linked through the vantage point; only the others have to be compared with them.
        centre = residents[away == 0][:1]
        hub = residents[away <= bits]
        found.link(hub, np.broadcast_to(centre, hub.shape))
        linked = queries[to <= bits]
        found.link(linked, np.broadcast_to(centre, linked.shape))
        near = queries[(to > bits) & (to <= node.median + node.radius)]
    search(values, near, inside, node.mask, bits, found)
    search(values, queries[to > node.median - node.radius], residents[away > node.median], node.mask, bits, found)


def links(distinct: DataFrame, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """(a, b): links between distinct fingerprints `bits`, enough to connect all that are within `bits` bits."""
    shards = max(1, math.ceil(distinct.count() / shard))
    size = min(MOST_SAMPLES, shards * SAMPLES_PER_SHARD)
    sample = [r[0] for r in distinct.orderBy(F.xxhash64("bits"), "bits").limit(size).collect()] if shards > 1 else []
    trees = []
    for mask in HALVES:
        least = max(SAMPLES_PER_SHARD, len(sample) // shards)
        trees.append((mask, grow(np.array(sample, np.int64).view(np.uint64), mask, bits, least, []) if sample else Node(shard=0)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for tree, (_, root) in enumerate(trees):
                for place, at, home in route(root, values, np.arange(len(values)), np.ones(len(values), bool)):
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, tree, np.int32)), pa.array(np.full(n, place, np.int32)), pa.array(values[at].view(np.int64)), pa.array(home)],
                        names=["tree", "shard", "bits", "home"],
                    )

    def within(table: pa.Table) -> pa.Table:
        mask = HALVES[table.column("tree")[0].as_py()]
        values = table.column("bits").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy(zero_copy_only=False)
        found = Forest(len(values))
        search(values, np.arange(len(values)), np.flatnonzero(home), mask, bits, found)
        label = found.settle()
        a = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": values[a].view(np.int64), "b": values[label[a]].view(np.int64)})

    dealt = distinct.select("bits").mapInArrow(deal, "tree int, shard int, bits bigint, home boolean")
    return dealt.groupBy("tree", "shard").applyInArrow(within, "a bigint, b bigint")


def _named(marked: DataFrame, bits: int, shard: int) -> DataFrame:
    """bits, label and component_id of every distinct fingerprint of `marked` (doc_id, bits)."""
    distinct = cut(marked.groupBy("bits").agg(F.min("doc_id").alias("doc_id")))
    labels = components(links(distinct, bits, shard))
    whole = distinct.join(labels, distinct["bits"] == labels["node"], "left")
    whole = whole.select("bits", "doc_id", F.coalesce("label", "bits").alias("label"))
    smallest = whole.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return whole.join(smallest, "label").select("bits", "label", "component_id")


def near_duplicates(docs: DataFrame, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    marked = cut(fingerprints(docs))
    named = _named(marked, bits, shard)
    return marked.join(named, "bits").select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def _row_key(doc_id, bits):
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), bits)


def keep_one(docs: DataFrame, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns.

    Of rows that share that id and their fingerprint one stays, and of a component without ids one row of its smallest
    fingerprint.
    """
    name = "_key"
    while name in docs.columns:
        name += "_"
    text = docs.columns.index("text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE):
            found = np.array([fingerprint(x) for x in part.column(text).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], names=[*part.schema.names, name])

    marked = cut(fingerprints(docs))
    named = _named(marked, bits, shard)
    first = marked.join(named, "bits").filter("doc_id = component_id or component_id is null and bits = label")
    kept = first.select(_row_key(F.col("doc_id"), F.col("bits")).alias("kept")).distinct()
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    keyed = docs.mapInArrow(mark, schema).withColumn(name, _row_key(F.col("doc_id"), F.col(f"`{name}`")))
    # Repeated rows are cut down in each task before they are shuffled.
    return keyed.dropDuplicates([name]).join(kept, F.col(f"`{name}`") == kept["kept"], "left_semi").drop(name)

"""A Merkle manifest of a dataset with retained SHA-256 states: parents keep a copy of the hash state before each child slot.

A node is the SHA-256 of its children's digests as hex text. Such a digest is 64 bytes, exactly one block of SHA-256, so the
state before child slot i is the chaining value after i blocks: 32 bytes that can be stored in a table, copied and
resumed anywhere. Folding a changed leaf upwards resumes, in every parent, the state before its slot, and hashes only the
replacement and the siblings to its right; what is left of the slot is not read again.

Leaves ascend by doc_id in a tree per language; the trees' roots, by language, are the leaves of one more tree. A tree is
built in rounds: blocks of `arity ** depth` leaves next to each other become a subtree each, one stored row with its leaves'
digests and its parents' states, and the subtrees' roots are the next round's leaves. So the work of a hot language is spread over its
blocks, a task holds one block, and a hundred billion documents take four rounds. Proofs come down the same rounds: each block
hands its leaves the path from its own root upwards.

SHA-256 runs over a whole block at once, as 32-bit arrays. Leaves are hashed by Spark, whole texts included.

Null values of the five columns count as `-`, and a null language is a tree of its own, the first one. A null doc_id comes
first in its tree; equal ids are ordered by their leaf digest, and rows that are wholly alike have equal leaves
and may swap places. Empty and very long texts are hashed like others. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.llm.common import cut
from netspark.llm.ranks import ranked

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@dataclass(frozen=True)
class MerkleParams:
    #: Children of a parent.
    arity: int = 2
    #: Levels of a block: a block has arity ** depth leaves.
    depth: int = 11


# ---- SHA-256 over arrays: a state is (8, n) and a block (16, n) of unsigned 32-bit integers.


def _primes(count: int) -> list[int]:
    found: list[int] = []
    n = 2
    while len(found) < count:
        if all(n % p for p in found):
            found.append(n)
        n += 1
    return found


def _root_bits(n: int, power: int) -> int:
    """The first 32 bits of the fraction of n ** (1 / power), exactly."""
    scaled, low, high = n << 32 * power, 0, n << 32
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**power <= scaled else (low, middle - 1)
    return low & 0xFFFFFFFF


#: The standard's start and round constants: fractions of square and cube roots of the first primes.
START = np.array([_root_bits(p, 2) for p in _primes(8)], np.uint32)
ROUNDS = np.array([_root_bits(p, 3) for p in _primes(64)], np.uint32)


def _right(x: np.ndarray, k: int) -> np.ndarray:
    return (x >> np.uint32(k)) | (x << np.uint32(32 - k))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The state after one more block, for every column; a state or block of one column goes with all of the other."""
    w = [block[i] for i in range(16)]
    for i in range(16, 64):
        x, y = w[i - 15], w[i - 2]
        w.append(w[i - 16] + (_right(x, 7) ^ _right(x, 18) ^ (x >> np.uint32(3))) + w[i - 7] + (_right(y, 17) ^ _right(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        one = h + (_right(e, 6) ^ _right(e, 11) ^ _right(e, 25)) + (g ^ (e & (f ^ g))) + (ROUNDS[i] + w[i])
        two = (_right(a, 2) ^ _right(a, 13) ^ _right(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return np.stack(np.broadcast_arrays(a, b, c, d, e, f, g, h)) + state


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8).astype(np.uint32)
_PAIR = (_HEX[np.arange(256) >> 4] << np.uint32(8)) | _HEX[np.arange(256) & 15]
#: Two digest bytes as four characters.
_FOUR = (_PAIR[np.arange(1 << 16) >> 8] << np.uint32(16)) | _PAIR[np.arange(1 << 16) & 255]


def as_block(digest: np.ndarray) -> np.ndarray:
    """Digests (8, n) as the blocks (16, n) of their hex text."""
    out = np.empty((16, digest.shape[1]), np.uint32)
    out[0::2], out[1::2] = _FOUR[digest >> np.uint32(16)], _FOUR[digest & np.uint32(0xFFFF)]
    return out


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of messages of `blocks` whole blocks (n) that have led to `state` (8, n)."""
    last = np.zeros((16, state.shape[1]), np.uint32)
    bits = blocks.astype(np.uint64) * np.uint64(512)
    last[0], last[14], last[15] = 1 << 31, (bits >> np.uint64(32)).astype(np.uint32), (bits & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return compress(state, last)


def start(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, axis=1)


def pack(digests: np.ndarray) -> bytes:
    return np.ascontiguousarray(digests.T).astype(">u4").tobytes()


def as_text(digests: np.ndarray) -> pa.Array:
    raw = pack(digests).hex()
    return pa.array([raw[i : i + 64] for i in range(0, len(raw), 64)], pa.string())


def unpack(buffer: bytes | pa.Buffer) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(buffer, ">u4").reshape(-1, 8).T).astype(np.uint32)


# ---- Trees in a block, and paths.


@dataclass
class Level:
    """One level of parents: the children (8, n) below them and the state before each child's slot (8, n)."""

    children: np.ndarray
    states: np.ndarray


def grow(leaves: np.ndarray, arity: int, levels: int | None) -> tuple[list[Level], np.ndarray]:
    """The levels above `leaves` (8, n), up to one node (or `levels` of them), and that node (8, 1)."""
    found: list[Level] = []
    nodes = leaves
    while nodes.shape[1] > 1 if levels is None else len(found) < levels:
        n = nodes.shape[1]
        parents = -(-n // arity)
        states, now = np.empty_like(nodes), start(parents)
        sizes = np.full(parents, arity, np.int64)
        sizes[-1] = n - (parents - 1) * arity
        blocks = as_block(nodes)
        for slot in range(arity):
            here = np.arange(slot, n, arity)
            states[:, here] = now[:, : len(here)]
            now[:, : len(here)] = compress(now[:, : len(here)], blocks[:, here])
        found.append(Level(nodes, states))
        nodes = finish(now, sizes)
    return found, nodes


#: A step of a path, from the bottom up: the slot, the number of children, the state before the slot, the siblings.
def steps(levels: list[Level], arity: int, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For the leaves `at` of a block, level by level: slot (n), children (n), state before the slot (8, n), children's digests by slot."""
    for level in levels:
        n = level.children.shape[1]
        slot, first = at % arity, at - at % arity
        count = np.minimum(n - first, arity)
        yield slot, count, level.states[:, at], [level.children[:, np.minimum(first + s, n - 1)] for s in range(arity)]
        at = at // arity


def path_bytes(slot: int, count: int, state: np.ndarray, children: np.ndarray) -> bytes:
    """A stored step: slot, number of children, state before the slot, digests of all children."""
    return np.array([slot, count], ">u4").tobytes() + pack(state.reshape(8, 1)) + pack(children)


def path_steps(path: bytes, arity: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """The steps of a stored path, the same for n leaves; siblings and state have one column."""
    at = 0
    while at < len(path):
        slot, count = np.frombuffer(path, ">u4", 2, at).astype(np.int64)
        state = unpack(path[at + 8 : at + 40])
        children = unpack(path[at + 40 : at + 40 + 32 * count])
        yield np.full(n, slot), np.full(n, count), state, [children[:, min(s, count - 1) : min(s, count - 1) + 1] for s in range(arity)]
        at += 40 + 32 * int(count)


def _some(state: np.ndarray, which: np.ndarray, block: np.ndarray) -> np.ndarray:
    """`state` with the block taken in where `which` says so."""
    if which.all():
        return compress(state, block)
    if not which.any():
        return state
    state = state.copy()
    state[:, which] = compress(state[:, which], block[:, which] if block.shape[1] > 1 else block)
    return state


class Climb:
    """Leaves on their way up: folded digests and the running hash of the siblings met."""

    def __init__(self, leaves: np.ndarray):
        self.digest, self.proof, self.met = leaves, start(leaves.shape[1]), np.zeros(leaves.shape[1], np.int64)

    def step(self, slot: np.ndarray, count: np.ndarray, state: np.ndarray, children: list[np.ndarray]) -> None:
        n = self.digest.shape[1]
        blocks = [as_block(c) for c in children]
        now = compress(np.broadcast_to(state, (8, n)), as_block(self.digest))
        for s, block in enumerate(blocks):
            now = _some(now, (s > slot) & (s < count), block)
            other = (s != slot) & (s < count)
            self.proof = _some(self.proof, other, block)
            self.met += other
        self.digest = finish(now, count)

    def proofs(self) -> np.ndarray:
        return finish(self.proof, self.met)


# ---- The manifest as tables.


def _field(column: str) -> Column:
    value = F.col(column).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(changed: dict[str, Column] | None = None) -> Column:
    """Digest of a row's five columns; `changed` replaces what some count as."""
    return F.sha2(F.concat(*((changed or {}).get(c, _field(c)) for c in FIELDS)), 256)


def tree_of(lang: str = "lang") -> Column:
    """Sort key of a row's tree: null comes first, then the languages bytewise."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit(""))


BLOCK = "tree string, block long, n int, levels int, leaves binary, carried binary, root binary, states binary"


def _blocks(nodes: DataFrame, params: MerkleParams) -> DataFrame:
    """One row per block of `nodes` (tree, place, total, node, carried): its leaves, what each of them carries, its parents' states and its root."""
    size, arity, depth = params.arity**params.depth, params.arity, params.depth

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        tree, block, total = (table.column(c)[0].as_py() for c in ("tree", "block", "total"))
        leaves = unpack(b"".join(table.column("node").to_pylist()))
        # In a tree of one block the subtree ends at its root; in others it takes all levels of a block.
        levels, root = grow(leaves, arity, depth if total > size else None)
        states = b"".join(pack(level.states) for level in levels)
        row = [tree, block, leaves.shape[1], len(levels), pack(leaves), b"".join(table.column("carried").to_pylist()), pack(root), states]
        return pa.Table.from_pylist([dict(zip(kinds.names, row, strict=True))], schema=kinds)

    kinds = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("levels", pa.int32()), *((c, pa.binary()) for c in ("leaves", "carried", "root", "states"))])
    numbered = nodes.withColumn("block", F.expr(f"place div {size}"))
    return cut(numbered.groupBy("tree", "block").applyInArrow(run, BLOCK))


def _levels(row: dict, arity: int) -> list[Level]:
    """A stored block's levels: children are its leaves, then, level by level, what the stored states lead to."""
    nodes, at, found = unpack(row["leaves"]), 0, []
    for _ in range(row["levels"]):
        n = nodes.shape[1]
        states = unpack(row["states"][at : at + 32 * n])
        at += 32 * n
        found.append(Level(nodes, states))
        # The last child's state, resumed with that child, gives the parent.
        last = np.minimum(np.arange(0, n, arity) + arity, n) - 1
        nodes = finish(compress(states[:, last], as_block(nodes[:, last])), last % arity + 1)
    return found


@dataclass
class Manifest:
    """Blocks of each round, from the leaves up, and the blocks of the tree over the subroots; roots by tree and the root."""

    rounds: list[DataFrame]
    over: list[DataFrame]
    subroots: DataFrame
    root: DataFrame


def _rounds(nodes: DataFrame, params: MerkleParams) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every round and (tree, node) of the roots."""
    found = []
    while True:
        blocks = _blocks(nodes, params)
        found.append(blocks)
        counts = blocks.groupBy("tree").agg(F.count("*").alias("total"))
        open_trees = counts.filter("total > 1")
        if open_trees.isEmpty():
            return found, _roots(found)
        # Trees that have come to one block are done; the others' blocks are numbered already.
        nodes = blocks.join(open_trees, "tree").select("tree", F.col("block").alias("place"), "total", F.col("root").alias("node"), F.lit(b"").alias("carried"))


def _roots(rounds: list[DataFrame]) -> DataFrame:
    """(tree, node): of each tree the root of its last round's only block."""
    tops = None
    for number, blocks in enumerate(rounds):
        some = blocks.select("tree", F.lit(number).alias("round"), "block", F.col("root").alias("node"))
        tops = some if tops is None else tops.union(some)
    last = tops.groupBy("tree").agg(F.max("round").alias("round"))
    return cut(tops.join(last, ["tree", "round"]).filter("block = 0").select("tree", "node"))


def manifest(rows: DataFrame, params: MerkleParams = MerkleParams()) -> Manifest:
    """The manifest of `rows`: tree (a sort key), doc_id, leaf (hex) and carried (32 bytes that stay with the leaf)."""
    rows = cut(rows.select("tree", "doc_id", "leaf", "carried", F.monotonically_increasing_id().alias("copy")))
    placed = ranked(rows, [F.col(c) for c in ("tree", "doc_id", "leaf", "copy")], ["tree"])
    # A leaf keeps its doc_id, whether it has one, and what it carries.
    kept = F.concat(F.unhex(F.lpad(F.hex(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))), 16, "0")), F.when(F.col("doc_id").isNull(), F.lit(b"\0")).otherwise(F.lit(b"\1")), F.col("carried"))
    leaves = placed.select("tree", "place", "total", F.unhex("leaf").alias("node"), kept.alias("carried"))
    rounds, subroots = _rounds(leaves, params)
    tops = ranked(subroots, [F.col("tree")]).select(F.lit("").alias("tree"), "place", "total", "node", F.encode("tree", "utf-8").alias("carried"))
    tops = tops.withColumn("carried", F.concat(F.unhex(F.lpad(F.hex(F.length("carried")), 8, "0")), "carried"))
    over, root = _rounds(tops, params)
    return Manifest(rounds, over, subroots, root)


def _names(row: dict) -> list[str]:
    """The trees that the leaves of a block of the upper tree stand for."""
    out, at, raw = [], 0, row["carried"]
    for _ in range(row["n"]):
        size = int.from_bytes(raw[at : at + 4], "big")
        out.append(raw[at + 4 : at + 4 + size].decode())
        at += 4 + size
    return out


def _down(blocks: DataFrame, paths: DataFrame, params: MerkleParams, named: bool) -> DataFrame:
    """(tree, block, path) of each leaf of `blocks`, which is a block of the round below, from the (tree, block, path) of the blocks.

    With `named` the leaves are the trees' roots, which are all their trees' last block, 0.
    """
    arity = params.arity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels, n = _levels(row, arity), row["n"]
                size = arity**params.depth
                names = _names(row) if named else [row["tree"]] * n
                places = [0] * n if named else range(row["block"] * size, row["block"] * size + n)
                parts = [[] for _ in range(n)]
                for slot, count, state, children in steps(levels, arity, np.arange(n)):
                    for i in range(n):
                        own = np.stack([children[s][:, i] for s in range(count[i])], axis=1)
                        parts[i].append(path_bytes(slot[i], count[i], state[:, i], own))
                above = row["path"] or b""
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array([b"".join(p) + above for p in parts], pa.binary())],
                    names=["tree", "block", "path"],
                )

    return cut(blocks.join(paths, ["tree", "block"], "left").mapInArrow(run, "tree string, block long, path binary"))


def paths(made: Manifest, params: MerkleParams = MerkleParams()) -> DataFrame:
    """(tree, block, path) from every block of leaves up to the root."""
    spark = made.subroots.sparkSession
    found = spark.createDataFrame([("", 0, b"")], "tree string, block long, path binary")
    for blocks in reversed(made.over):
        found = _down(blocks, found, params, named=blocks is made.over[0])
    # Of a tree that was done earlier, block 0 of an earlier round is the root: it gets the path of the subroot there.
    for number in range(len(made.rounds) - 1, 0, -1):
        blocks = made.rounds[number]
        below = _down(blocks, found, params, named=False)
        done = found.join(blocks.select("tree").distinct(), "tree", "left_anti")
        found = cut(below.unionByName(done))
    return found


FOLDED = "tree string, doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"


def fold(made: Manifest, params: MerkleParams = MerkleParams()) -> DataFrame:
    """tree, doc_id, leaf, subroot, proof_sha256 and folded_root of every leaf: its carried digest climbs to the root in its place."""
    arity = params.arity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n"]
                carried = np.frombuffer(row["carried"], np.uint8).reshape(n, 41)
                ids = np.ascontiguousarray(carried[:, :8]).view(">i8").reshape(-1).astype(np.int64)
                climb = Climb(unpack(np.ascontiguousarray(carried[:, 9:]).tobytes()))
                for step in steps(_levels(row, arity), arity, np.arange(n)):
                    climb.step(*step)
                for step in path_steps(row["path"] or b"", arity, n):
                    climb.step(*step)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["tree"]] * n, pa.string()),
                        pa.array(ids, mask=carried[:, 8] == 0),
                        as_text(unpack(row["leaves"])),
                        pa.array([row["subroot"].hex()] * n, pa.string()),
                        as_text(climb.proofs()),
                        as_text(climb.digest),
                    ],
                    names=["tree", "doc_id", "leaf", "subroot", "proof_sha256", "folded_root"],
                )

    # What all leaves of a tree share is joined to its paths, the smallest rows; blocks move once, by their own number.
    shared = paths(made, params).join(made.subroots.select("tree", F.col("node").alias("subroot")), "tree")
    blocks = made.rounds[0].join(shared, ["tree", "block"])
    return blocks.mapInArrow(run, FOLDED)


def tampered() -> Column:
    """The leaf of a row whose n_chars is one more, where 7 divides the crc32 of its doc_id."""
    more = (F.col("n_chars").cast("bigint") + 1).cast("string")
    value = F.coalesce(F.concat(F.octet_length(more).cast("string"), F.lit(":"), more), F.lit("-"))
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return F.when(F.coalesce(hit, F.lit(False)), leaf({"n_chars": value})).otherwise(leaf())


def digests(docs: DataFrame, params: MerkleParams = MerkleParams()) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document."""
    chosen = docs.select(*FIELDS)
    made = manifest(chosen.select(tree_of().alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf().alias("leaf"), F.unhex(tampered()).alias("carried")), params)
    root = made.root.select(F.lower(F.hex("node")).alias("root")).first()
    top = F.lit(root["root"] if root else None).cast("string")
    return fold(made, params).select("doc_id", "leaf", "subroot", top.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == top).alias("verified"))

"""A random forest and one-vs-rest gradient boosting over rows that a task holds as bins.

The rules are those of Spark's learners: at most 32 bins a feature with thresholds midway between neighbouring values, Gini gain
with class weights, a Poisson bag and ceil(sqrt(features)) drawn features a node for the forest; logistic loss, variance
gain over all features and a learning rate of 0.1 for the boosting, in which the first tree counts whole; the first of equal gains wins.

Spark's learners run two stages per level and group of nodes and send a histogram per open node through them; a forest that
grows until its leaves are pure has about as many nodes as rows, and boosting has thousands of levels. Here each row is its bins, a byte
per feature, and goes once to each task. Tasks grow whole trees: a forest's trees are dealt over them, and each class is boosted in one.
Rows are put in the order of their ids and contents first, so models don't follow files or partitions; draws are seeded by tree.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty

MAX_BINS = 32
#: Rows from which thresholds are taken, as many as Spark's learners take.
THRESHOLD_ROWS = 10_000
LEARNING_RATE = 0.1
#: Marks in a tree's ``feature`` for a leaf of one class, whose number stands in ``bin``, and for one of several.
PURE, MIXED = 255, 254
_EPSILON = np.finfo(float).eps


# ---- bins -------------------------------------------------------------------
def thresholds(values: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Per column the values midway between neighbours: between all, or where an equal share of the weight ends."""
    out = []
    for column in values.T:
        distinct, of = np.unique(column, return_inverse=True)
        middle = (distinct[:-1] + distinct[1:]) / 2
        if len(middle) >= MAX_BINS:
            count = np.cumsum(np.bincount(of, weights))
            stride = weights.sum() / MAX_BINS
            target, chosen = stride, []
            for index in range(1, len(distinct)):
                if abs(count[index - 1] - target) < abs(count[index] - target):
                    chosen.append(index - 1)
                    target += stride
            middle = middle[chosen]
        out.append(middle)
    return out


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of each value, feature by feature: (features, rows) bytes."""
    out = np.empty((len(cuts), len(values)), np.uint8)
    for f, cut in enumerate(cuts):
        out[f] = np.searchsorted(cut, values[:, f], "left")
    return out


# ---- the forest --------------------------------------------------------------
def _best_splits(node: np.ndarray, nodes: int, rows: np.ndarray, label: np.ndarray, count: np.ndarray, bins: np.ndarray,
                 drawn: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, bin) of each node's best split; ``node`` is sorted. Counts are whole numbers, so no sum is rounded."""
    classes = len(weight)
    starts = np.searchsorted(node, np.arange(nodes))
    whole = np.bincount(node * classes + label, count, nodes * classes).reshape(nodes, classes)
    heavy = whole * weight
    total = heavy.sum(1)
    impurity = 1 - ((heavy / total[:, None]) ** 2).sum(1)
    gain, feature, at = np.full(nodes, -np.inf), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    hot = np.empty((len(node), classes))
    for j in range(drawn.shape[1]):
        own = bins[drawn[node, j], rows].astype(np.int64)
        key = ((node * MAX_BINS + own) << 32) | np.arange(len(node))
        key.sort()
        order, key = key & 0xFFFFFFFF, key >> 32
        ends = np.flatnonzero((key[1:] != key[:-1]) & (key[1:] // MAX_BINS == key[:-1] // MAX_BINS))
        if len(ends) == 0:
            continue
        hot[:] = 0
        hot[np.arange(len(node)), label[order]] = count[order]
        run = np.cumsum(hot, axis=0)
        of = key[ends] // MAX_BINS
        before = np.where((starts[of] > 0)[:, None], run[starts[of] - 1], 0)
        left = (run[ends] - before) * weight
        right = (whole[of] - (run[ends] - before)) * weight
        sums = left.sum(1), right.sum(1)
        shares = [x / (sums[0] + sums[1]) for x in sums]
        impure = [1 - ((side / s[:, None]) ** 2).sum(1) for side, s in zip((left, right), sums, strict=True)]
        here = impurity[of] - shares[0] * impure[0] - shares[1] * impure[1]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        top = np.maximum.reduceat(here, first)
        size = np.diff(np.append(first, len(of)))
        hits = np.flatnonzero(here == np.repeat(top, size))
        one = hits[np.append(True, of[hits[1:]] != of[hits[:-1]])]
        mine = of[one]
        # Among equal gains the lower feature wins, as features are drawn in order.
        better = here[one] > gain[mine]
        one, mine = one[better], mine[better]
        gain[mine], feature[mine], at[mine] = here[one], drawn[mine, j], key[ends[one]] % MAX_BINS
    return gain, feature, at


def grow_tree(bins: np.ndarray, label: np.ndarray, count: np.ndarray, weight: np.ndarray, depth: int, subset: int, draws: np.random.Generator) -> bytes:
    """A packed classification tree over the rows whose ``count`` is above zero."""
    features, classes = len(bins), len(weight)
    rows = np.flatnonzero(count)
    node, label, count = np.zeros(len(rows), np.int64), label[rows].astype(np.int64), count[rows]
    levels, nodes = [], 1
    for level in range(depth + 1):
        sums = np.bincount(node * classes + label, count, nodes * classes).reshape(nodes, classes)
        feature, at = np.full(nodes, MIXED), np.zeros(nodes, np.int64)
        open_ = (sums > 0).sum(1) > 1
        if level < depth and open_.any():
            some = open_[node]
            node, rows, label, count = node[some], rows[some], label[some], count[some]
            known = np.flatnonzero(open_)
            number = np.cumsum(open_) - 1
            drawn = np.tile(np.arange(features), (len(known), 1))
            if subset < features:
                drawn = np.sort(np.argpartition(draws.random((len(known), features)), subset, axis=1)[:, :subset], axis=1)
            gain, best, cut = _best_splits(number[node], len(known), rows, label, count, bins, drawn, weight)
            split = known[gain > 0]
            feature[split], at[split] = best[gain > 0], cut[gain > 0]
            some = (feature < MIXED)[node]
            node, rows, label, count = node[some], rows[some], label[some], count[some]
            child = 2 * (np.cumsum(feature < MIXED) - 1)
            node = child[node] + (bins[feature[node], rows] > at[node])
            order = np.argsort(node, kind="stable")
            node, rows, label, count = node[order], rows[order], label[order], count[order]
            nodes = 2 * len(split)
        else:
            nodes = 0
        levels.append((feature, at, sums))
        if nodes == 0:
            break
    return _packed(levels, weight)


def _packed(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], weight: np.ndarray) -> bytes:
    """Nodes level by level: feature and bin, and the shares of leaves of several classes. Leaves that are siblings and predict the same become one."""
    kept = [np.ones(len(feature), bool) for feature, _, _ in levels]
    for above, below in zip(range(len(levels) - 2, -1, -1), range(len(levels) - 1, 0, -1), strict=True):
        feature, leaf, guess = levels[above][0], levels[below][0] >= MIXED, (levels[below][2] * weight).argmax(1)
        inner = np.flatnonzero(feature < MIXED)
        same = leaf[0::2] & leaf[1::2] & (guess[0::2] == guess[1::2])
        feature[inner[same]] = MIXED
        kept[below] &= np.repeat(~same, 2)
    feature, at, sums = (np.concatenate([level[k][keep] for level, keep in zip(levels, kept, strict=True)]) for k in range(3))
    # A node that was merged lost its whole subtree: both children were leaves.
    shares = sums * weight
    shares = shares / shares.sum(1, keepdims=True) if len(shares) else shares
    pure = (feature == MIXED) & ((sums > 0).sum(1) == 1)
    feature[pure], at[pure] = PURE, sums[pure].argmax(1)
    raw = [np.array([len(feature)], "<i8"), feature.astype(np.uint8), at.astype(np.uint8), shares[feature == MIXED].astype("<f8")]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(x.tobytes() for x in raw))


def tree_shares(packed: bytes, bins: np.ndarray, classes: int) -> np.ndarray:
    """The share of each class in the leaf that each row (features, rows) comes to."""
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    feature, at = np.frombuffer(raw, np.uint8, n, 8), np.frombuffer(raw, np.uint8, n, 8 + n)
    inner = feature < MIXED
    first = 2 * np.cumsum(inner) - 1
    place = np.zeros(bins.shape[1], np.int64)
    rows = np.flatnonzero(inner[place])
    while len(rows):
        here = place[rows]
        place[rows] = first[here] + (bins[feature[here], rows] > at[here])
        rows = rows[inner[place[rows]]]
    leaf, out = feature[place], np.zeros((bins.shape[1], classes))
    pure = np.flatnonzero(leaf == PURE)
    out[pure, at[place[pure]]] = 1.0
    mixed = np.flatnonzero(leaf == MIXED)
    shares = np.frombuffer(raw, "<f8", offset=8 + 2 * n).reshape(-1, classes)
    out[mixed] = shares[(np.cumsum(feature == MIXED) - 1)[place[mixed]]]
    return out


# ---- boosting ----------------------------------------------------------------
def _regression_tree(bins: np.ndarray, wide: list[int], target: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bin, value) of a whole binary tree of ``depth`` levels in heap order, and the leaf of each row.

    A node that isn't split sends all rows left: its bin is beyond every row's.
    """
    inner = (1 << depth) - 1
    feature, at, value = np.zeros(inner, np.uint8), np.full(inner, MAX_BINS, np.uint8), np.zeros(1 << depth)
    node, rows, leaf = np.zeros(len(target), np.int64), np.arange(len(target)), np.zeros(len(target), np.int64)
    square = target * target
    for level in range(depth):
        open_nodes = 1 << level
        n, total = np.bincount(node, minlength=open_nodes).astype(float), np.bincount(node, target[rows], open_nodes)
        squares = np.bincount(node, square[rows], open_nodes)
        held = np.maximum(n, 1)
        spread = (squares - total * total / held) / held
        gain, best, cut = np.zeros(open_nodes), np.zeros(open_nodes, np.int64), np.full(open_nodes, MAX_BINS)
        every, these = len(rows) == len(target), target[rows]
        # Below this, what is left of a sum of equal targets is rounding.
        least = np.maximum(spread, squares / held * 1e-14)
        for f, width in enumerate(wide):
            if width < 2:
                continue
            key = node * width + (bins[f] if every else bins[f, rows])
            left = np.bincount(key, minlength=open_nodes * width).reshape(open_nodes, width).cumsum(1)[:, :-1].astype(float)
            left_sum = np.bincount(key, these, open_nodes * width).reshape(open_nodes, width).cumsum(1)[:, :-1]
            right, right_sum = n[:, None] - left, total[:, None] - left_sum
            with np.errstate(divide="ignore", invalid="ignore"):
                here = np.where((left > 0) & (right > 0), left_sum * left_sum / left + right_sum * right_sum / right, -np.inf)
            one = here.argmax(1)
            won = (here[np.arange(open_nodes), one] - total * total / held) / held
            # Gains that differ by rounding alone are equal, and the first of equals wins.
            better = won > gain + 1e-12 * least
            gain[better], best[better], cut[better] = won[better], f, one[better]
        split = (gain > 0) & (spread > squares / held * 1e-14)
        cut[~split] = MAX_BINS
        first = open_nodes - 1
        feature[first : first + open_nodes], at[first : first + open_nodes] = best, cut
        # What a node predicts is kept in its leftmost leaf; rows of nodes that aren't split are done.
        value[np.arange(open_nodes) << (depth - level)] = np.where(n > 0, total / held, value[np.arange(open_nodes) << (depth - level)])
        stay = split[node]
        leaf[rows[~stay]] = node[~stay] << (depth - level)
        node, rows = node[stay], rows[stay]
        node = 2 * node + (bins[best[node], rows] > cut[node])
    if len(rows):
        n = np.bincount(node, minlength=len(value))
        total = np.bincount(node, target[rows], len(value))
        value[n > 0] = total[n > 0] / n[n > 0]
        leaf[rows] = node
    return feature, at, value, leaf


def boost(bins: np.ndarray, wide: list[int], positive: np.ndarray, rounds: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bin, value) of the trees, one after another; values hold the weight of their tree."""
    sign = np.where(positive, 1.0, -1.0)
    margin, target, trees = np.zeros(len(sign)), sign, []
    for number in range(rounds):
        feature, at, value, leaf = _regression_tree(bins, wide, target, depth)
        value = value * (1.0 if number == 0 else LEARNING_RATE)
        margin = margin + value[leaf]
        with np.errstate(over="ignore"):
            target = 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))
        trees.append((feature, at, value))
    return tuple(np.stack(x) for x in zip(*trees, strict=True))


def margins(trees: tuple[np.ndarray, np.ndarray, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """The sum over boosted trees for each row (features, rows)."""
    rows, out = np.arange(bins.shape[1]), np.zeros(bins.shape[1])
    for feature, at, value in zip(*trees, strict=True):
        node = np.zeros(len(rows), np.int64)
        for _ in range((len(feature) + 1).bit_length() - 1):
            node = 2 * node + 1 + (bins[feature[node], rows] > at[node])
        out += value[node - len(feature)]
    return out


# ---- on Spark ----------------------------------------------------------------
@dataclass
class BinnedModel:
    """A fitted model with `transform`, which adds `probability` or `rawPrediction` (an array) and `prediction`."""

    shaping: object  # makes the column `features`
    output: str
    cuts: list[np.ndarray]
    trees: Broadcast  # a list of packed trees, or of boosted trees by class
    classes: int

    def scores(self, values: np.ndarray) -> np.ndarray:
        bins = binned(values, self.cuts)
        if self.output == "rawPrediction":
            return np.stack([margins(trees, bins) for trees in self.trees.value], axis=1)
        votes = np.zeros((len(values), self.classes))
        for tree in self.trees.value:
            votes += tree_shares(tree, bins, self.classes)
        return votes / votes.sum(1, keepdims=True)

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        scorer = BinnedModel(None, self.output, self.cuts, self.trees, self.classes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = scorer.scores(_matrix(batch.column("_features"), len(scorer.cuts)))
                offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * scorer.classes)
                columns = [batch.column(i) for i in range(batch.num_columns - 1)]
                columns += [pa.ListArray.from_arrays(offsets, pa.array(found.ravel())), pa.array(found.argmax(1).astype(float))]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], scorer.output, "prediction"])

        shaped = self.shaping.transform(df).select(*df.columns, vector_to_array("features").alias("_features"))
        schema = ty.StructType([*df.schema.fields, ty.StructField(self.output, ty.ArrayType(ty.DoubleType())), ty.StructField("prediction", ty.DoubleType())])
        return shaped.mapInArrow(run, schema)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _cuts(rows: DataFrame, samples: int, weighted: bool, seed: int) -> list[np.ndarray]:
    """Thresholds from all rows, or from about `THRESHOLD_ROWS` whose ids are drawn."""
    if samples > THRESHOLD_ROWS:
        rows = rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(samples)) < THRESHOLD_ROWS)
    table = rows.select("values", F.col("weight") if weighted else F.lit(1.0).alias("weight")).toArrow()
    values = table.column("values").combine_chunks()
    width = len(values[0]) if len(values) else 0
    return thresholds(_matrix(values, width), table.column("weight").to_numpy())


def _dealt(rows: DataFrame, cuts: list[np.ndarray], copies: int, work: Callable[[int, np.ndarray, np.ndarray, np.ndarray], Iterator]) -> list:
    """What ``work(number, bins, label, weight of each class)`` yields in ``copies`` tasks, each of which gets all rows once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binned(_matrix(batch.column("values"), len(cuts)), cuts)
            columns = [batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("id", "label_index", "weight")]
            body = [x.astype(k).tobytes() for x, k in zip(columns, ("<i8", "u1", "<f8"), strict=True)]
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "body": [zstandard.ZstdCompressor(level=1).compress(b"".join([*body, bins.tobytes()]))]})

    def run(number: int, parts: Iterator) -> Iterator:
        ids, labels, weights, held = [], [], [], []
        for _, (n, body) in parts:
            raw = zstandard.ZstdDecompressor().decompress(bytes(body))
            ids.append(np.frombuffer(raw, "<i8", n))
            labels.append(np.frombuffer(raw, "u1", n, 8 * n))
            weights.append(np.frombuffer(raw, "<f8", n, 9 * n))
            held.append(np.frombuffer(raw, "u1", offset=17 * n).reshape(len(cuts), n))
        id_, label, weight, bins = np.concatenate(ids), np.concatenate(labels), np.concatenate(weights), np.concatenate(held, axis=1)
        del ids, labels, weights, held
        content = np.zeros(len(id_), np.uint64)
        for row in bins:
            content = (content ^ row) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        order = np.lexsort((content, label, id_))
        of_class = np.zeros(int(label.max()) + 1)
        of_class[label] = weight
        return work(number, np.ascontiguousarray(bins[:, order]), label[order], of_class)

    blocks = rows.select("id", "label_index", "weight", "values").mapInArrow(pack, "n bigint, body binary").rdd
    return blocks.flatMap(lambda row: [(k, (row["n"], row["body"])) for k in range(copies)]).partitionBy(copies, int).mapPartitionsWithIndex(run).collect()


def fit_forest(shaping, rows: DataFrame, samples: int, classes: int, trees: int, depth: int, seed: int) -> BinnedModel:
    """``rows``: id, label_index, weight and values (the shaped features), all of which are read by every task."""
    context = rows.sparkSession.sparkContext
    cuts = _cuts(rows, samples, True, seed)
    copies = min(trees, 2 * context.defaultParallelism)
    # A tree alone is drawn nothing for but its bag, as Spark has it.
    subset = math.ceil(math.sqrt(len(cuts))) if trees > 1 else len(cuts)

    def work(number: int, bins: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Iterator[tuple[int, bytes]]:
        for tree in range(number, trees, copies):
            draws = np.random.Generator(np.random.PCG64([seed, tree]))
            yield tree, grow_tree(bins, label, draws.poisson(1.0, len(label)), weight, depth, subset, draws)

    grown = dict(_dealt(rows, cuts, copies, work))
    return BinnedModel(shaping, "probability", cuts, context.broadcast([grown[tree] for tree in range(trees)]), classes)


def fit_boosting(shaping, rows: DataFrame, samples: int, classes: int, rounds: int, depth: int, seed: int) -> BinnedModel:
    cuts = _cuts(rows, samples, False, seed)
    wide = [len(cut) + 1 for cut in cuts]

    def work(number: int, bins: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Iterator[tuple[int, tuple]]:
        yield number, boost(bins, wide, label == number, rounds, depth)

    boosted = dict(_dealt(rows, cuts, classes, work))
    return BinnedModel(shaping, "rawPrediction", cuts, rows.sparkSession.sparkContext.broadcast([boosted[k] for k in range(classes)]), classes)

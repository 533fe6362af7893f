import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netspark.operators import anomaly as A
from netspark.params import AnomalyParams
from netspark.schemas import FEATURE_COLUMNS


def feature_rows(n, seed=0, **changed):
    rng = np.random.default_rng(seed)
    data = {c: rng.normal(10, 1, n) for c in FEATURE_COLUMNS}
    data |= {"total_packets": rng.integers(2, 15, n), "packets_per_second": rng.uniform(1, 50, n), "protocol": np.full(n, 6)}
    data |= {k: np.full(n, v) for k, v in changed.items()}
    frame = pd.DataFrame(data)
    frame.insert(0, "finish_seq", np.arange(n))
    return frame


def walk(nodes, point):
    """One point down one tree, node by node."""
    by_id = nodes.set_index("node_id")
    at = 1
    while by_id.loc[at, "feature"] >= 0:
        at = 2 * at + int(point[int(by_id.loc[at, "feature"])] > by_id.loc[at, "threshold"])
    return by_id.loc[at, "path"]


def drawn_tree(points, seed, tree):
    """The same tree, grown by recursion in plain Python."""
    limit = math.ceil(math.log2(max(len(points), 2)))

    def digits(*parts):
        return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()

    def grow(node, here, depth):
        low, high = here.min(axis=0), here.max(axis=0)
        varying = [j for j in range(points.shape[1]) if high[j] > low[j]]
        if depth == limit or not varying:
            return {node: (-1, 0.0, depth + A.average_path(len(here)))}
        j = min(varying, key=lambda j: digits(seed, tree, node, j))
        at = low[j] + int(digits(seed, tree, node, "threshold")[:13], 16) / 2**52 * (high[j] - low[j])
        at = low[j] if at >= high[j] else at
        right = here[:, j] > at
        return {node: (j, at, 0.0)} | grow(2 * node, here[~right], depth + 1) | grow(2 * node + 1, here[right], depth + 1)

    return grow(1, points, 0)


def grow(spark, points, trees, seed):
    rows = spark.createDataFrame([(i, points.tolist()) for i in range(trees)], "tree_id int, points array<array<double>>")
    made = A.grown(F.col("points"), F.col("tree_id"), seed, A.depth_limit(len(points)), points.shape[1])
    return rows.select("tree_id", F.explode(made).alias("n")).select("tree_id", "n.*").toPandas()


def test_trees_equal_a_plain_recursion(spark):
    rng = np.random.default_rng(5)
    ties = rng.integers(0, 3, size=(37, 4)).astype(float)  # equal rows and constant sides
    for points in (rng.normal(size=(40, 5)), ties, np.ones((6, 2)), rng.normal(size=(1, 3))):
        nodes = grow(spark, points, 8, 7)
        for tree in range(8):
            got = {r.node_id: (r.feature, r.threshold, r.path) for r in nodes[nodes.tree_id == tree].itertuples()}
            want = drawn_tree(points, 7, tree)
            assert got.keys() == want.keys()
            for node in want:
                assert got[node][0] == want[node][0] and np.allclose(got[node][1:], want[node][1:])


def test_forest_scores_equal_node_walk(spark):
    rng = np.random.default_rng(1)
    nodes = grow(spark, rng.normal(size=(40, 5)), 12, 7)
    probes = rng.normal(size=(9, 5)) * 2
    got = A.Forest.from_nodes(nodes, 40).score_samples(probes, batch=4)
    want = [
        -(2 ** (-np.mean([walk(nodes[nodes.tree_id == i], p) for i in range(12)]) / A.average_path(40))) for p in probes
    ]
    assert np.allclose(got, want)
    assert nodes.groupby("tree_id").size().max() <= 2 * 40 - 1


def test_neighbouring_values_split_into_two_sides(spark):
    points = np.array([[1.0], [np.nextafter(1.0, 2.0)]])
    nodes = grow(spark, points, 50, 3)
    assert (nodes.groupby("tree_id").size() == 3).all()
    assert (nodes[nodes.feature >= 0].threshold < points[1, 0]).all()


def test_average_path():
    assert [A.average_path(n) for n in (0, 1, 2)] == [0, 0, 1]
    assert math.isclose(A.average_path(256), 2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256, rel_tol=1e-9)


def test_lifecycle(spark, tmp_path):
    p = AnomalyParams(trees=60)
    normal = feature_rows(60)
    odd = feature_rows(1, 3, total_packets=10, **{c: 90.0 for c in FEATURE_COLUMNS[10:40]})
    flood = feature_rows(1, 4, total_packets=4000, packets_per_second=8000.0)
    short = feature_rows(1, 5, total_packets=19, packets_per_second=8000.0)
    frame = pd.concat([normal, odd, flood, short], ignore_index=True)
    frame["finish_seq"] = np.arange(len(frame))
    features = spark.createDataFrame(frame)
    model = A.fit_baseline(features, p)
    got = A.score(features, model).orderBy("finish_seq").collect()
    assert [r["verdict"] for r in got[:29]] == ["WARMING_UP"] * 29 and got[28]["score"] is None
    assert got[29]["score"] is not None and got[29]["verdict"] != "WARMING_UP"
    later = [r["score"] for r in got[30:60]]
    assert got[60]["score"] < min(later) and got[60]["verdict"] == "SUSPICIOUS"
    assert got[61]["verdict"] == "ATTACK" and got[62]["verdict"] != "ATTACK"
    assert model.nodes.groupby("tree_id").size().max() <= 2 * model.sample_size - 1

    model.save(spark, str(tmp_path / "m"))
    again = A.score(features, A.BaselineModel.load(spark, str(tmp_path / "m"))).orderBy("finish_seq").collect()
    assert [r["score"] for r in again] == [r["score"] for r in got]
    assert A.fit_baseline(features, p).offset == model.offset


def test_large_baseline_is_sampled_per_tree(spark):
    p = AnomalyParams(warmup_flows=80, max_samples=16, trees=10)
    model = A.fit_baseline(spark.createDataFrame(feature_rows(90)), p)
    assert model.sample_size == 16 and model.nodes.groupby("tree_id").size().max() <= 31


def test_too_few_flows(spark):
    with pytest.raises(ValueError):
        A.fit_baseline(spark.createDataFrame(feature_rows(5)))


def test_column_filter(spark):
    frame = feature_rows(30)
    varying = FEATURE_COLUMNS[:10]
    for c in FEATURE_COLUMNS[10:]:
        frame[c] = 0.1
    stats = A.baseline_statistics(spark.createDataFrame(frame))
    kept = {r["feature"] for r in A.kept_columns(stats).collect()}
    assert kept == set(varying) - {"protocol"}
    for c in FEATURE_COLUMNS[4:]:
        frame[c] = 0.1
    kept = [r["feature"] for r in A.kept_columns(A.baseline_statistics(spark.createDataFrame(frame))).collect()]
    assert len(kept) == 8 and set(FEATURE_COLUMNS[1:4]) <= set(kept)


def test_verdict_of_a_given_score(spark):
    rows = [(None, 50, 5000.0), (0.1, 50, 5000.0), (-0.02, 5, 5000.0), (-0.015, 5, 1.0)]
    df = spark.createDataFrame(rows, "score double, total_packets int, packets_per_second double")
    assert [r[0] for r in df.select(A.anomaly_verdict(F.col("score"))).collect()] == ["WARMING_UP", "ATTACK", "SUSPICIOUS", "NORMAL"]

"""The forest and the boosting against Spark's own learners where nothing is drawn, and that models don't follow partitions."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from netspark.operators import trees as R, training as T
from netspark.params import TrainingParams
from tests.test_training import labelled


def table(spark, n=400, classes=3):
    draws = np.random.default_rng(5)
    values = np.round(draws.normal(size=(n, 4)), 2)
    label = (values[:, 0] + draws.normal(size=n) > 0).astype(int) + (values[:, 1] * values[:, 2] > 0.4)
    label = label % classes
    weight = n / np.bincount(label)[label] / classes
    rows = [(i, float(c), float(w), *map(float, v)) for i, (c, w, v) in enumerate(zip(label, weight, values))]
    return spark.createDataFrame(rows, "id long, label_index double, weight double, a double, b double, c double, d double").coalesce(1)


@pytest.fixture(scope="module")
def shaped(spark):
    rows = table(spark)
    shaping = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features")]).fit(rows)
    ready = shaping.transform(rows)
    return rows, shaping, ready, ready.select("id", "label_index", "weight", vector_to_array("features").alias("values")).cache()


def test_a_tree_is_sparks_tree(spark, shaped):
    rows, shaping, ready, values = shaped
    for depth in (2, 5, 30):
        spark_tree = RandomForestClassifier(numTrees=1, maxDepth=depth, seed=1, bootstrap=False, featureSubsetStrategy="all", weightCol="weight", labelCol="label_index")
        want = [r[0] for r in spark_tree.fit(ready).transform(ready).orderBy("id").select(vector_to_array("probability")).collect()]
        cuts = R._cuts(values, 400, True, 1)
        collected = values.orderBy("id").collect()
        bins = R.binned(np.array([r["values"] for r in collected]), cuts)
        label = np.array([int(r["label_index"]) for r in collected])
        weight = np.array([next(r["weight"] for r in collected if r["label_index"] == c) for c in range(3)])
        tree = R.grow_tree(bins, label, np.ones(400, np.int64), weight, depth, 4, np.random.default_rng(0))
        assert np.allclose(R.tree_shares(tree, bins, 3), want, atol=1e-9)


def test_boosting_is_sparks_boosting(spark, shaped):
    rows, shaping, ready, values = shaped
    learner = OneVsRest(classifier=GBTClassifier(maxIter=6, maxDepth=3, seed=1), labelCol="label_index", featuresCol="features")
    want = [r for r in learner.fit(ready).transform(ready).orderBy("id").select(vector_to_array("rawPrediction").alias("m"), "prediction").collect()]
    model = R.fit_boosting(shaping, values, 400, 3, 6, 3, 1)
    got = model.transform(rows).orderBy("id").collect()
    assert np.allclose([r["rawPrediction"] for r in got], [r["m"] for r in want], atol=1e-9)
    assert [r["prediction"] for r in got] == [r["prediction"] for r in want]


def test_models_do_not_follow_partitions(spark, shaped):
    rows, shaping, _, values = shaped
    for fit in (lambda v: R.fit_forest(shaping, v, 400, 3, 7, 6, 3), lambda v: R.fit_boosting(shaping, v, 400, 3, 4, 3, 3)):
        one, other = (m.transform(rows).orderBy("id").select(m.output).collect() for m in (fit(values), fit(values.orderBy(F.desc("d")).repartition(5))))
        assert one == other


def test_thresholds_share_the_weight():
    values = np.repeat(np.arange(100.0), 2)[:, None]
    cuts = R.thresholds(values, np.ones(200))[0]
    assert len(cuts) == 31 and set(np.diff(cuts)) <= {3.0, 4.0}
    assert R.thresholds(np.array([[1.0], [1.0], [3.0]]), np.ones(3))[0].tolist() == [2.0]
    assert R.binned(np.array([[2.0], [2.1], [0.0]]), [np.array([2.0])]).tolist() == [[0, 1, 0]]


def test_training_runs_no_stage_per_level(spark):
    """200 trees and 200 rounds ran thousands of stages; now their number does not follow trees, rounds or depth."""
    df = labelled(spark, [(("ddos", "benign")[i % 2], "llm", False, i % 7) for i in range(80)])
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for group, size in (("few", 3), ("many", 40)):
        spark.sparkContext.setJobGroup(group, group)
        model = T.train_best(df, TrainingParams(trees=size, boosting_rounds=size, boosting_depth=4))
        assert len(model.model.trees.value) == (size if model.name == "RandomForest" else 2)
        jobs.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_flagged_flows_are_classified_in_batches(spark):
    """Predictions are a map over the flows: every column stays, and only flagged flows to one host are scored."""
    df = labelled(spark, [("ddos", "llm", False, 0)] * 30 + [("benign", "llm", False, 50)] * 30)
    best = T.train_best(df, TrainingParams(trees=5, boosting_rounds=2, forest_depth=3, boosting_depth=3))
    flows = T.sample_features(df, ["dst_ip"]).selectExpr(
        "* except (dst_ip)", "if(id % 10 = 0, '224.0.0.1', dst_ip) dst_ip", "if(id % 2 = 0, 'ATTACK', 'NORMAL') verdict", "array(id, null) kept"
    )
    found = T.classify_flagged(flows, best.model, best.labels)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert sorted(r["id"] for r in got) == [i for i in range(60) if i % 2 == 0 and i % 10]
    assert all(r["predicted_label"] == r["label"] and r["kept"] == [r["id"], None] for r in got)
    assert T.classify_flagged(flows.filter("id < 0"), best.model, best.labels).collect() == []
    # The same model from Spark's learners, which many rows go to.
    other = T.train_best(df, TrainingParams(trees=5, boosting_rounds=2, forest_depth=3, boosting_depth=3), held_rows=0)
    assert (other.name, other.f1_macro) == (best.name, best.f1_macro) and not hasattr(other.model, "cuts")
    assert all(r["predicted_label"] == r["label"] for r in T.classify_flagged(flows, other.model, other.labels).collect())

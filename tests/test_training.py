import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from netspark.operators import registry as G, retention as Ret, training as T, verdicts as V
from netspark.operators.incidents import correlate, incidents
from netspark.params import RetentionParams, TrainingParams, VerdictParams
from netspark.schemas import EVIDENCE, FEATURE_COLUMNS, STALE_MARKER_KEYS
from netspark.sources.tables import append_labelled, read_labelled, with_features

LABELLED = "id bigint, timestamp string, label string, label_source string, confidence string, all_features string, dst_ip string"


def labelled(spark, rows):
    """rows: (label, source, stale, shift)"""
    out = []
    for i, (label, source, stale, shift) in enumerate(rows):
        features = {"src_ip": "a", **{c: float(j + shift + i % 3) for j, c in enumerate(FEATURE_COLUMNS)}}
        if stale:
            features = {k: v for k, v in features.items() if k not in STALE_MARKER_KEYS}
        out.append((i, f"2026-01-01T00:00:{i:05d}", label, source, "high", json.dumps(features), "10.0.0.1"))
    return spark.createDataFrame(out, LABELLED)


def test_stale_rows_are_left_out(spark):
    rows = [(("ddos", "benign")[i % 2], "llm", i < 700, 0) for i in range(740)] + [("ddos", "ddos_tracker", False, 0)] * 5
    df = labelled(spark, rows)
    assert T.training_set(df).count() == 40
    assert T.stale_rows(df).count() == 700 and T.drop_stale(df).count() == 45
    assert [(r["samples"], r["tag"], r["n_keys"]) for r in T.schema_split(df).collect()] == [(700, "stale", 41), (40, "current", 44)]


def test_shortfalls(spark):
    few = labelled(spark, [("ddos", "llm", False, 0)] * 5)
    one = labelled(spark, [("ddos", "llm", False, 0)] * 15)
    sparse = labelled(spark, [("ddos", "llm", False, 0)] * 15 + [("benign", "llm", False, 0)])
    for df in (few, one, sparse):
        with pytest.raises(T.NotEnoughData):
            T.training_set(df)


def test_split_sizes():
    assert [T.split_size(n, k) for n, k in ((100, 3), (10, 4), (8, 4), (25, 2))] == [20, 4, 4, 5]
    with pytest.raises(T.NotEnoughData):
        T.split_size(5, 3)
    for counts in ({"a": 80, "b": 15, "c": 5}, {"a": 2, "b": 2, "c": 90}, {"a": 5, "b": 5}):
        quota = T.split_quotas(counts)
        assert sum(quota.values()) == T.split_size(sum(counts.values()), len(counts))
        assert all(1 <= quota[c] < n for c, n in counts.items())


def test_stratified_split_is_exact_and_repeatable(spark):
    df = labelled(spark, [("ddos", "llm", False, 0)] * 70 + [("benign", "llm", False, 5)] * 20 + [("port_scan", "llm", False, 9)] * 10)
    split = T.stratified_split(df)
    counts = {(r["label"], r["in_test"]): r["count"] for r in split.groupBy("label", "in_test").count().collect()}
    assert {k[0]: v for k, v in counts.items() if k[1]} == {"ddos": 14, "benign": 4, "port_scan": 2}
    again = T.stratified_split(df.repartition(7))
    assert {r["id"] for r in split.filter("in_test").collect()} == {r["id"] for r in again.filter("in_test").collect()}


def test_split_takes_the_smallest_draws(spark):
    """Every class size against a plain sort; copies of an id stay together."""
    for sizes in ({"a": 9000, "b": 40, "c": 2}, {"a": 5, "b": 5}):
        rows = [(i, label) for label, n in sizes.items() for i in range(n)]
        quotas = T.split_quotas(sizes)
        want = set()
        for label, n in sizes.items():
            drawn = sorted(range(n), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())
            want |= {(i, label) for i in drawn[: quotas[label]]}
        got = T.stratified_split(spark.createDataFrame(rows, "id long, label string").repartition(5)).filter("in_test").collect()
        assert {(r["id"], r["label"]) for r in got} == want and len(got) == len(want)
    copies = spark.createDataFrame([(7, "a")] * 10 + [(8, "b"), (9, "b")], "id long, label string")
    assert [r[0] for r in T.stratified_split(copies).filter("label = 'a'").select("in_test").distinct().collect()] == [True]


def test_train_and_classify(spark):
    df = labelled(spark, [("ddos", "llm", False, 0)] * 30 + [("benign", "llm", False, 50)] * 30)
    best = T.train_best(df, TrainingParams(trees=5, boosting_rounds=2, forest_depth=3, boosting_depth=3))
    assert (best.name, best.f1_macro, best.labels, best.samples) == ("RandomForest", 1.0, ["benign", "ddos"], 60)
    got = T.classify(T.sample_features(df), best.model, best.labels).collect()
    assert all(r["predicted_label"] == r["label"] for r in got)
    assert all(abs(sum(r["probabilities"].values()) - 1) < 1e-9 for r in got)


def test_class_report(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")]
    df = spark.createDataFrame(pairs, "label string, predicted_label string")
    got = {r["label"]: (r["precision"], r["recall"], round(r["f1"], 6), r["support"]) for r in T.class_report(T.confusion(df)).collect()}
    assert got == {"a": (0.75, 0.75, 0.75, 4), "b": (2 / 3, 1.0, 0.8, 2), "c": (0.0, 0.0, 0.0, 1)}
    assert abs(T.macro_f1(df) - (0.75 + 0.8) / 3) < 1e-9


def versions(spark):
    rows = [("20260101_000000", 100, 0.5), ("20260102_000000", 150, 0.4), ("20260103_000000", 180, 0.7), ("20260104_000000", 190, 0.7)]
    return spark.createDataFrame([(v, "t", n, "s", "RandomForest", f, False) for v, n, f in rows],
                                 "version string, trained_at string, sample_count int, feature_schema_version string, model_name string, f1_macro double, promoted boolean")


def test_registry(spark):
    known = versions(spark)
    log = G.auto_promotions(known)
    assert [r["version"][:8] for r in log.orderBy("promoted_seq").collect()] == ["20260101", "20260103"]
    assert G.active_version(log).first()[0] == "20260103_000000"
    back = G.promote(known, log, "20260101_000000")
    assert [r["version"] for r in G.list_versions(known, back).filter("promoted").collect()] == ["20260101_000000"]
    with pytest.raises(G.UnknownVersion):
        G.promote(known, log, "nope")
    gone = G.prune(known, log, known.filter("version = '20260102_000000'"))
    assert sorted(r["version"][:8] for r in gone.collect()) == ["20260101", "20260104"]
    due = lambda n: G.retrain_due(labelled(spark, [("ddos", "llm", False, 0)] * n), known, log).first()
    assert (due(279)["due"], due(280)["due"], due(280)["new_samples"]) == (False, True, 100)
    empty = spark.createDataFrame([], "version string, promoted_seq bigint")
    assert G.retrain_due(labelled(spark, [("ddos", "llm", False, 0)] * 100), known, empty).first()["due"] is True


def test_sample_cap_drops_the_oldest(spark):
    df = labelled(spark, [("ddos", "llm", False, 0)] * 600 + [("benign", "llm", False, 0)] * 30)
    kept = Ret.kept_samples(df, RetentionParams(samples_per_label=500))
    assert {r["id"] for r in kept.collect()} == set(range(100, 630))


def test_evidence_retention_protects_open_incidents(spark):
    day = 86_400_000_000
    rows = [("e1", 1, "ddos", 0, "ATTACK", "r", "x"), ("e2", 2, "ddos", 0, "ATTACK", "r", None), ("e3", 3, "ddos", 0, "NORMAL", "r", "x"),
            ("e4", 4, "ddos", 95 * day, "ATTACK", "r", "y")]
    ev = spark.createDataFrame([(*r, None, None, "{}", None) for r in rows], EVIDENCE)
    acts = spark.createDataFrame([(9, "x", "resolve")], "arrival_seq bigint, key string, action string")
    samples = labelled(spark, [("ddos", "llm", False, 0)] * 3)
    for actions, left in ((None, {"e1", "e2", "e4"}), (acts, {"e2", "e4"})):
        kept, _, stats = Ret.retain(ev, samples, incidents(correlate(ev, actions)), 100 * day, RetentionParams(samples_per_label=2))
        assert {r["evidence_id"] for r in kept.collect()} == left
        removed = {r["tier"]: r["removed"] for r in stats.collect()}
        assert removed == {"bulk_evidence": 1, "finding_evidence": 3 - len(left), "training_samples": 1}


def test_sample_cap_equals_a_global_rank(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), f"2026-01-0{rng.randint(1, 4)}T00:00:0{rng.randint(0, 3)}.{rng.randint(0, 2)}" if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, label string, timestamp string")
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    for cap in (1, 7, 60, 500):
        got = [r["id"] for r in Ret.kept_samples(df, RetentionParams(samples_per_label=cap)).collect()]
        want = []
        for label in ("a", "b", None):
            of = sorted((r for r in rows if r[1] == label), key=lambda r: (r[2] or "", r[0]), reverse=True)
            want += [r[0] for r in of[:cap]]
        assert sorted(got) == sorted(want)
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))


def test_promotion_after_a_rollback(spark):
    known = spark.createDataFrame([("v1", 0.5), ("v2", 0.9), ("v3", 0.7), ("v4", 0.6), ("v5", 0.8)], "version string, f1_macro double")
    manual = spark.createDataFrame([("v1", "v2")], "version string, after_version string")
    log = G.auto_promotions(known, manual).orderBy("promoted_seq").collect()
    assert [r["version"] for r in log] == ["v1", "v2", "v1", "v3", "v5"]
    assert [r["version"] for r in G.auto_promotions(known).orderBy("promoted_seq").collect()] == ["v1", "v2"]


def test_parse_answers(spark):
    texts = [
        ' {"attack_type": "ddos", "confidence": "high", "reasoning": "r"} ', '```json\n{"attack_type": "benign", "confidence": "?"}\n```',
        '{"attack_type": "worm"}', "not json", "[1]", '{"confidence": "low"}',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "flow_id bigint, raw_text string")
    got = [(r["available"], r["attack_type"], r["confidence"], r["error"]) for r in V.parse_verdicts(df).orderBy("flow_id").collect()]
    assert got[0] == (True, "ddos", "high", None) and got[1] == (True, "benign", "unknown", None)
    assert got[2][3] == "LLM returned an unrecognised attack_type: 'worm'" and got[3][3].startswith("Could not parse")
    assert not got[4][0] and got[5][3].endswith("None")


def test_labels_and_promotion(spark):
    results = spark.createDataFrame(
        [(1, "SUSPICIOUS", -0.05), (2, "SUSPICIOUS", -0.05), (3, "SUSPICIOUS", -0.02), (4, "ATTACK", 0.5), (5, "NORMAL", -0.9), (6, "SUSPICIOUS", -0.05)],
        "flow_id bigint, verdict string, score double",
    )
    answer = '{"attack_type": "%s", "confidence": "%s", "reasoning": "r"}'
    raw = [(1, answer % ("ddos", "medium")), (2, answer % ("ddos", "low")), (3, answer % ("ddos", "high")), (4, answer % ("benign", "high")), (6, "oops")]
    parsed = V.parse_verdicts(spark.createDataFrame(raw, "flow_id bigint, raw_text string"))
    got = {r["flow_id"]: (r["label"], r["label_source"], r["stored_verdict"]) for r in V.label(results, parsed).collect()}
    assert got == {
        1: ("ddos", "llm", "ATTACK"), 2: ("ddos", "llm", "SUSPICIOUS"), 3: ("unknown", "auto", "SUSPICIOUS"),
        4: ("benign", "llm", "ATTACK"), 6: ("unknown", "llm_failed", "SUSPICIOUS"),
    }


def test_budget_takes_the_first_of_each_minute(spark):
    df = spark.createDataFrame([(i, (i // 10) * 60_000_000 + i) for i in range(30)], "finish_seq bigint, ts_us bigint")
    got = V.admit(df, p=VerdictParams(calls_per_minute=4)).filter("admitted").collect()
    assert sorted(r["finish_seq"] for r in got) == [0, 1, 2, 3, 10, 11, 12, 13, 20, 21, 22, 23]


def test_labelled_table_round_trip(spark, tmp_path):
    df = labelled(spark, [("ddos", "llm", False, 0)] * 3).withColumn(
        "confidence", F.when(F.col("id") == 0, "low").otherwise("high")
    )
    append_labelled(df, str(tmp_path / "t"))
    append_labelled(df.withColumn("id", F.col("id") + 10), str(tmp_path / "t"))
    high = read_labelled(spark, str(tmp_path / "t"), "high")
    assert sorted(r["id"] for r in high.collect()) == [1, 2, 11, 12]
    assert "PushedFilters: [IsNotNull(confidence), EqualTo(confidence,high)]" in high._jdf.queryExecution().executedPlan().toString()
    assert with_features(high).first()["features"]["protocol"] is not None


def test_training_tasks_follow_the_rows():
    assert [T.training_tasks(n) for n in (0, 10, 20_000, 20_001, 1_000_000)] == [1, 1, 1, 2, 50]

from netspark.operators import scan as S
from netspark.operators.evidence import evidence_id
from netspark.plans.tables import Tables
from netspark.session import SHUFFLED_PER_PARTITION, STORED_PER_PARTITION, small_partitions
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_evidence_is_stored_without_ids(spark):
    tables = Tables(spark, DATA)
    tables.build_evidence = lambda: spark.createDataFrame(
        [("id", 8, "anomaly", 5, "ATTACK", "r", "10.0.0.1", "10.0.0.2", 22, "{}", None)],
        "evidence_id string, arrival_seq bigint, detector string, ts_us bigint, verdict string, reasoning string, "
        "src_ip string, dst_ip string, dst_port int, payload string, attack_type string",
    )
    stored = {}
    tables._staged = lambda name, build: stored.setdefault(name, build())
    got = tables.evidence()
    assert got.columns[0] == "evidence_id" and got.filter(F.col("evidence_id") != evidence_id(F.col("detector"))).isEmpty()
    bridge = tables.bridge()
    assert "evidence_id" not in stored["evidence"].columns and not {"evidence_id", "payload"} & set(stored["bridge"].columns)
    assert bridge.first()["evidence_id"] == got.first()["evidence_id"]


def test_evidence_of_single_flows_needs_no_window_detector(spark):
    tables = Tables(spark, DATA)
    tables.ddos = tables.port_scan = tables.brute_force = None
    got = tables.flow_evidence()
    assert "RepartitionByExpression [arrival_seq" in got._jdf.queryExecution().optimizedPlan().toString()
    tables = Tables(spark, DATA)
    tables.evidence()  # stored from here on
    columns = ["arrival_seq", "detector", "payload"]
    want = tables.evidence().filter("detector in ('anomaly', 'llm')").select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == sorted(map(tuple, tables.flow_evidence().collect()))


def test_partitions_grow_with_the_input(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        (tmp_path / "big").write_bytes(bytes(40 * STORED_PER_PARTITION))
        small_partitions(spark, [str(tmp_path / "big")])
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == str(SHUFFLED_PER_PARTITION)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_quiet_key_has_few_totals(spark):
    day = 86_400_000_000
    (width,) = S.window_chunks(day)
    assert 4 * day <= width <= 8 * day and S.window_chunks(1_000_000) == S.TIME_CHUNKS
    rows = spark.range(0, 30).select(F.lit("a").alias("k"), (F.col("id") * day).alias("t"), F.lit(1).alias("change"))
    totals = rows.groupBy("k", F.expr(f"t div {width}L")).count().count()
    assert totals <= 8
    got = S.scan(rows, ["k"], "t", {"n": S.Running("sum", "change")}, (width,)).orderBy("t").collect()
    assert [r["n"] for r in got] == list(range(1, 31))


def unshared(spark) -> tuple[Tables, dict]:
    """Tables that see nothing stored by other tests."""
    tables, stored = Tables(spark, DATA), {}

    def staged(name, build):
        if name not in stored:
            stored[name] = build().localCheckpoint()
        return stored[name]

    tables._staged, tables._is_stored = staged, stored.__contains__
    return tables, stored


def rows(df) -> list:
    return sorted(map(str, df.collect()))


def test_started_flows_and_features_come_from_one_grouping(spark):
    from netspark.operators.flows import started_flows

    tables, stored = unshared(spark)
    started, features = tables.started(), tables.features()
    assert set(stored) == {"packets", "all_flows"}
    other, kept = unshared(spark)
    assert rows(features) == rows(other.features()) and "features" in kept
    assert rows(started.select("flow_id", "ts_us", "src_ip", "dst_ip", "dst_port")) == rows(started_flows(tables.packets()))
    assert rows(other.started()) == rows(started) and "all_flows" not in kept


def test_risk_reads_no_scan_targets(spark, monkeypatch):
    from netspark.operators import incidents, windows

    tables, _ = unshared(spark)
    want = incidents.incidents(incidents.correlate(tables.packet_evidence())).select("key", "evidence_count", "risk_score")
    want = rows(want)
    monkeypatch.setattr(windows, "_target_changes", None)
    monkeypatch.setattr(windows, "_span_marks", None)
    narrow = tables.packet_evidence(detail=False)
    assert not {"payload", "reasoning"} & set(narrow.columns)
    assert rows(incidents.incidents(incidents.correlate(narrow)).select("key", "evidence_count", "risk_score")) == want


def test_reviewed_rows_need_no_tracker(spark):
    other, _ = unshared(spark)
    want = rows(other.labelled().filter("label_source = 'llm'"))
    tables, stored = unshared(spark)
    tables.transitions = None
    assert rows(tables.reviewed()) == want == rows(other.reviewed())
    assert "labelled" not in stored and "features" in stored


def test_labels_need_no_features_and_targets(spark):
    columns = ["id", "timestamp", "label", "label_source"]
    other, _ = unshared(spark)
    want = rows(other.labelled().select(columns))
    tables, stored = unshared(spark)
    tables.port_scan = None
    assert rows(tables.labels()) == want == rows(other.labels())
    assert stored["labels"].columns == columns and "labelled" not in stored


def test_scan_changes_know_their_targets_from_few_contacts(spark):
    from netspark.operators import windows

    data = DATA.replace("0.001", "0.01")
    tables, stored = unshared(spark)
    tables.sf_dir = data
    got = tables.transitions()["port_scan"]
    assert "port_scan" not in stored and "port_scan_targets" not in stored
    whole = windows.verdict_transitions(tables.port_scan(), ["src_ip"], "finish_seq").select(*got.columns)
    assert rows(got) == rows(whole) and not got.isEmpty()

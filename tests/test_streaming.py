import random

from pyspark.sql import functions as F

from netspark.operators import incidents as I, response as R, windows as W
from netspark.operators.features import flow_features
from netspark.operators.flows import flows, with_flow_id
from netspark.params import AlertParams, BruteForceParams, DdosParams, FlowParams, PortScanParams
from netspark.schemas import EVIDENCE, FEATURE_COLUMNS, PACKETS
from netspark.streaming import stateful, windows as SW
from netspark.streaming.flows import heartbeat, stream_flows, stream_flows_once, stream_flows_reordered, streamed_features
from tests.test_flows import random_packets
from tests.test_windows import FLOWS, random_flows

S = 1_000_000


def values(df, *columns):
    rows = df.select(*columns).collect()
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


def run(stream, out, checkpoint):
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def arriving(df, path, parts, order):
    """The table cut into files, read one file per micro-batch in arrival order."""
    ranked = df.collect()
    ranked.sort(key=lambda r: r[order])
    size = -(-len(ranked) // parts)
    for i in range(parts):
        part = df.sparkSession.createDataFrame(ranked[i * size : (i + 1) * size], df.schema)
        part.coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


FLOW_COLUMNS = ["flow_id", "finish_seq", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "start_us", "last_us", "finished_cleanly", "total_packets"]


def test_flows_and_features_equal_batch(spark):
    packets = spark.createDataFrame(random_packets(11, 300), PACKETS)
    p = FlowParams(idle_timeout_seconds=1.5)
    streamed = stream_flows_once(packets, p)
    batch = with_flow_id(packets, p)
    assert values(streamed, *FLOW_COLUMNS) == values(flows(batch), *FLOW_COLUMNS)
    assert values(streamed_features(streamed), "flow_id", *FEATURE_COLUMNS) == values(flow_features(batch), "flow_id", *FEATURE_COLUMNS)


def test_flows_span_micro_batches(spark, tmp_path):
    """State carries an open flow over several batches; only flows done by the end are out."""
    packets = spark.createDataFrame(random_packets(12, 240), PACKETS)
    p = FlowParams(idle_timeout_seconds=1.5)
    source = arriving(packets, str(tmp_path / "in"), 4, "arrival_seq")
    streamed = run(stream_flows(source, p, "5 seconds"), str(tmp_path / "out"), str(tmp_path / "state"))
    done, every = values(streamed, *FLOW_COLUMNS), values(flows(with_flow_id(packets, p)), *FLOW_COLUMNS)
    assert set(done) <= set(every)
    assert {r for r in every if r[9]} <= set(done) and len(done) > len([r for r in every if r[9]])


def test_keys_that_share_a_bucket_stay_apart(spark, tmp_path):
    """One bucket for all keys: open flows of several batches, one call a batch, and flows end although others go on."""
    rows = random_packets(13, 240)
    packets = spark.createDataFrame(rows, PACKETS)
    p = FlowParams(idle_timeout_seconds=1.5)
    source = arriving(packets, str(tmp_path / "in"), 4, "arrival_seq")
    beat = heartbeat(packets, 100 * S)
    streamed = stream_flows(source, p, "5 seconds", buckets=1)
    run(streamed, str(tmp_path / "out"), str(tmp_path / "state"))
    beat.write.mode("append").parquet(str(tmp_path / "in"))
    streamed = run(streamed, str(tmp_path / "out"), str(tmp_path / "state"))
    batch = with_flow_id(packets, p)
    assert values(streamed, *FLOW_COLUMNS) == values(flows(batch), *FLOW_COLUMNS)
    assert values(streamed_features(streamed), "flow_id", *FEATURE_COLUMNS) == values(flow_features(batch), "flow_id", *FEATURE_COLUMNS)


def shuffled(rows, delay_us, seed):
    """Arrival order in which a row is behind others by less than the delay."""
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: r[2] + rng.randrange(delay_us))


def test_window_detectors_equal_batch(spark, tmp_path):
    """Ten micro-batches whose rows come up to five seconds late and out of order; the last flows only close what is before."""
    rows = random_flows(21, 200) + [(float(i), "10.0.0.7", "192.168.0.9", 9000 + i) for i in range(20, 26)]
    flows = [(i, i, int(t * 10) * 100_000, s, d, p) for i, (t, s, d, p) in enumerate(rows)]
    late = shuffled(flows, 5 * S, 1)
    assert late != sorted(flows, key=lambda r: r[2])
    ends = [(9000 + i, 9000 + i, (200 + 100 * i) * S, "end", "end", 1) for i in range(2)]
    order = [(*r, i) for i, r in enumerate(late + ends)]
    source = arriving(spark.createDataFrame(order, FLOWS + ", seq bigint"), str(tmp_path / "in"), 10, "seq").drop("seq")
    table = spark.createDataFrame(flows, FLOWS)
    ddos, scan = DdosParams(10.0, 40, 3, 30, 3), PortScanParams(10.0, 5, 3)
    for name, window, detect, columns in (
        ("ddos", ddos.window_us, lambda f, c: W.ddos_windows(f, c, ddos), ["flow_id", "total_flows", "distinct_sources", "verdict"]),
        ("scan", scan.window_us, lambda f, c: W.port_scan_windows(f, c, scan), ["flow_id", "distinct_ports", "distinct_targets", "verdict"]),
    ):
        base = f"{tmp_path}/{name}"
        q = SW.start_window_detector(source, f"{base}/out", f"{base}/state", window, detect, "5 seconds", 4, availableNow=True)
        q.awaitTermination()
        found = spark.read.parquet(f"{base}/out").filter("flow_id < 9000")
        assert values(found, *columns) == values(detect(table, table), *columns)
        kept = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
        assert not any(p["numRowsDroppedByWatermark"] for p in kept)
        # What lies behind the watermark leaves the state.
        assert kept[-1]["numRowsTotal"] < max(p["numRowsTotal"] for p in kept)


def test_flows_after_their_bucket_are_dropped(spark, tmp_path):
    times = [1, 2, 50, 51, 3, 120, 300]  # seconds; the fifth comes when its bucket has closed
    rows = [(i, i, t * S, "a", "b", 1, i) for i, t in enumerate(times)]
    source = arriving(spark.createDataFrame(rows, FLOWS + ", seq bigint"), str(tmp_path / "in"), 7, "seq").drop("seq")
    p = DdosParams(10.0)
    q = SW.start_window_detector(source, f"{tmp_path}/out", f"{tmp_path}/state", p.window_us, lambda f, c: W.ddos_windows(f, c, p), salts=2, availableNow=True)
    q.awaitTermination()
    found = {r.flow_id: r.total_flows for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {0: 1, 1: 2, 2: 1, 3: 2, 5: 1}


def test_brute_force_equals_batch(spark, tmp_path):
    rows = sorted(random_flows(22, 200, 120.0))
    table = spark.createDataFrame([(i, i, int(t * 10) * 100_000 + i, s, d, p) for i, (t, s, d, p) in enumerate(rows)], FLOWS)
    p = BruteForceParams(8.0, 3, 2)
    source = arriving(table, str(tmp_path / "in"), 4, "ts_us")
    got = run(stateful.stream_brute_force(source, p), str(tmp_path / "out"), str(tmp_path / "state"))
    columns = ["flow_id", "attempts", "repeat_offender_count", "verdict"]
    assert values(got, *columns) == values(W.brute_force_windows(table, p), *columns)


def test_incidents_equal_batch(spark, tmp_path):
    rng = random.Random(3)
    order = rng.sample(range(2000), 300)
    verdicts = ["NORMAL", "SUSPICIOUS", "ATTACK", "UNAVAILABLE"]
    ev = spark.createDataFrame(
        [(f"e{s}", s, "ddos", s * S, rng.choice(verdicts), "r", rng.choice(["a", "b", None]), None, None, "{}", None) for s in order[:240]], EVIDENCE
    )
    acts = spark.createDataFrame(
        [(s, rng.choice(["a", "b", "c", "__aggregate__"]), rng.choice(["resolve", "reopen"])) for s in order[240:]], "arrival_seq bigint, key string, action string"
    )
    both = ev.withColumn("key", F.lit(None).cast("string")).withColumn("action", F.lit(None).cast("string")).unionByName(acts, allowMissingColumns=True)
    source = arriving(both, str(tmp_path / "in"), 3, "arrival_seq")
    got = run(stateful.stream_correlate(source), str(tmp_path / "out"), str(tmp_path / "state"))
    columns = ["arrival_seq", "key", "incident_no", "incident_id", "kind", "is_new", "status_after"]
    assert values(got, *columns) == values(I.correlate(ev, acts), *columns)


def run_in_rocksdb(stream, out, checkpoint):
    with SW.rocksdb_state(stream.sparkSession):
        q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out), q


def test_alerts_equal_batch_and_leave_the_state(spark, tmp_path):
    rng = random.Random(4)
    times = rng.sample(range(5000), 200)
    rows = [(t, t * 1000, rng.choice(["a", "b"]) if t < 2500 else "c") for t in times]
    table = spark.createDataFrame(rows, "seq bigint, ts_us bigint, src_ip string")
    p = AlertParams(rate_limit_seconds=0.07)
    source = arriving(table, str(tmp_path / "in"), 5, "ts_us")
    got, q = run_in_rocksdb(stateful.stream_alerts(source, p), str(tmp_path / "out"), str(tmp_path / "state"))
    assert values(got, "seq", "sent") == values(R.rate_limited_alerts(table, p), "seq", "sent")
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(kept) >= 2 and kept[-1] <= 1  # a and b went quiet


def test_transitions_equal_batch_over_restarts(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, (i + 1) * S, f"k{rng.randrange(4)}", rng.choice(["NORMAL", "NORMAL", "SUSPICIOUS", "ATTACK"])) for i in range(160)]
    schema = "flow_id bigint, ts_us bigint, src_ip string, verdict string"
    table = spark.createDataFrame(rows, schema)
    for name, keys, to in (("keyed", ["src_ip"], "ATTACK"), ("global", [], None)):
        base = f"{tmp_path}/{name}"
        for part in (rows[:90], rows[90:]):  # the second run goes on from the first one's checkpoint
            source = arriving(spark.createDataFrame(part, schema), f"{base}/in", 2, "flow_id")
            got, _ = run_in_rocksdb(stateful.stream_transitions(source, keys, "flow_id", to), f"{base}/out", f"{base}/state")
        columns = ["flow_id", "src_ip", "verdict", "previous_verdict"]
        assert values(got, *columns) == values(W.verdict_transitions(table, keys, "flow_id", to), *columns)


def test_idle_keys_are_normal_again(spark, tmp_path):
    rows = [(0, 1, "k", "ATTACK"), (1, 1 * S, "other", "NORMAL"), (2, 100 * S, "other", "NORMAL"), (3, 101 * S, "other", "NORMAL"), (4, 102 * S, "k", "ATTACK")]
    source = arriving(spark.createDataFrame(rows, "flow_id bigint, ts_us bigint, src_ip string, verdict string"), str(tmp_path / "in"), 5, "flow_id")
    got, _ = run_in_rocksdb(stateful.stream_transitions(source, ["src_ip"], "flow_id", idle_seconds=30.0), str(tmp_path / "out"), str(tmp_path / "state"))
    assert values(got, "flow_id") == [(0,), (4,)]


def test_flows_of_shuffled_micro_batches_equal_batch(spark, tmp_path):
    """Ten micro-batches with packets up to four seconds late; the watermark moves, and open flows end at their timers."""
    rows = random_packets(13, 300)
    rng = random.Random(7)
    late = sorted(rows, key=lambda r: r[1] + rng.randrange(4 * S))
    packets = spark.createDataFrame(rows, PACKETS)
    p = FlowParams(idle_timeout_seconds=1.5)
    ends = [tuple(r) for k in (100, 200) for r in heartbeat(packets, k * S).collect()]
    order = spark.createDataFrame([(*r, i) for i, r in enumerate(late + ends)], PACKETS + ", _order bigint")
    source = arriving(order, str(tmp_path / "in"), 10, "_order").drop("_order")
    streamed, q = run_in_rocksdb(stream_flows_reordered(source, p, "5 seconds"), str(tmp_path / "out"), str(tmp_path / "state"))
    streamed = streamed.filter("protocol >= 0")
    batch = with_flow_id(packets, p)
    assert values(streamed, *FLOW_COLUMNS) == values(flows(batch), *FLOW_COLUMNS)
    assert values(streamed_features(streamed), "flow_id", *FEATURE_COLUMNS) == values(flow_features(batch), "flow_id", *FEATURE_COLUMNS)
    kept = [x["stateOperators"][0] for x in q.recentProgress if x["stateOperators"]]
    assert len(kept) >= 10 and not any(x["numRowsDroppedByWatermark"] for x in kept)

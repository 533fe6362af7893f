import random
import statistics

from netspark.operators.features import flow_features, packet_features, timing_in_arrival_order
from netspark.operators.flows import flows, new_flow_events, started_flows, with_direction, with_flow_id
from netspark.operators.scan import SEQUENCE_CHUNKS
from netspark.params import FlowParams
from netspark.schemas import FEATURE_COLUMNS, IDENTITY_COLUMNS, PACKETS


def packet(seq, t, protocol, src, dst, flags=None, size=60, header=20, payload=20):
    return (seq, int(round(t * 1e6)), protocol, src[0], dst[0], src[1], dst[1], size, header, payload, flags)


A, B = ("192.168.1.50", 51000), ("93.184.216.34", 443)


def assembled(spark, packets, params=FlowParams()):
    return with_flow_id(spark.createDataFrame(packets, PACKETS), params)


def ordered(df):
    return df.orderBy("finish_seq").collect()


def test_replay_of_two_conversations(spark):
    packets = [
        packet(1, 1000.0, 6, A, B, "S"), packet(2, 1000.02, 6, B, A, "SA"), packet(3, 1000.021, 6, A, B, "A"),
        packet(4, 1000.5, 6, A, B, "FA"), packet(5, 1001.0, 17, A, B), packet(6, 1001.01, 17, B, A),
    ]
    got = ordered(flows(assembled(spark, packets)))
    assert [(r["protocol"], r["total_packets"], r["finished_cleanly"]) for r in got] == [(6, 4, True), (17, 2, False)]


def test_closed_flows_come_first(spark):
    packets = [packet(1, 2.0, 17, A, B), packet(2, 1.0, 6, A, B, "S"), packet(3, 1.1, 6, A, B, "FA")]
    assert [r["protocol"] for r in ordered(flows(assembled(spark, packets)))] == [6, 17]


def test_answer_to_a_close_is_a_new_flow_the_other_way(spark):
    packets = [packet(1, 1.0, 6, A, B, "S"), packet(2, 1.1, 6, A, B, "FA"), packet(3, 1.2, 6, B, A, "FA")]
    sessions = assembled(spark, packets)
    assert [(r["src_ip"], r["dst_port"]) for r in ordered(flows(sessions))] == [(A[0], 443), (B[0], 51000)]
    assert new_flow_events(sessions).count() == 2
    assert flow_features(sessions).count() == 1


def test_udp_and_icmp_never_close(spark):
    host = (A[0], 0), (B[0], 0)
    packets = [packet(i, float(i), 17, A, B) for i in range(4)] + [packet(10 + i, float(i), 1, *host) for i in range(3)]
    assert sorted(r["total_packets"] for r in ordered(flows(assembled(spark, packets)))) == [3, 4]


def test_duration_and_schema(spark):
    packets = [packet(1, 5000.0, 6, A, B, "S"), packet(2, 5003.5, 6, A, B, "FA")]
    row = flow_features(assembled(spark, packets)).collect()[0]
    assert (row["start_us"], row["last_us"], row["duration_seconds"]) == (5_000_000_000, 5_003_500_000, 3.5)
    identity = {*IDENTITY_COLUMNS, "flow_id", "finish_seq", "start_us", "last_us", "finished_cleanly"}
    assert set(row.asDict()) - identity == set(FEATURE_COLUMNS) and len(FEATURE_COLUMNS) == 44


def test_one_packet_has_no_features(spark):
    assert flow_features(assembled(spark, [packet(1, 1.0, 6, A, B, "S")])).count() == 0


def sequential(packets, idle_us=None):
    """Packet-at-a-time assembly: a dict of open flows."""
    active, done = {}, []
    for p in sorted(packets):
        seq, ts, proto, sip, dip, sport, dport, size, header, payload, flags = p
        key = (*sorted([(sip, sport), (dip, dport)]), proto)
        flow = active.get(key)
        if flow and idle_us is not None and ts - flow["packets"][-1][1] >= idle_us:
            done.append(active.pop(key))
            flow = None
        if flow is None:
            flow = active[key] = {"src": (sip, sport), "dst": (dip, dport), "packets": [], "clean": False, "proto": proto}
        flow["packets"].append(p)
        if flags and ("F" in flags or "R" in flags):
            flow["clean"] = True
            done.append(active.pop(key))
    return done + list(active.values())


def random_packets(seed, n=400):
    rng = random.Random(seed)
    hosts = [("10.0.0.1", 5), ("10.0.0.2", 5), ("9.0.0.1", 70), ("10.0.0.1", 80)]
    rows = []
    for seq in range(n):
        src, dst = rng.choice(hosts), rng.choice(hosts)
        proto = rng.choice([6, 6, 17])
        flags = rng.choice(["S", "SA", "A", "PA", "FA", "R", "U"]) if proto == 6 else None
        rows.append(packet(seq * 7, 100 + seq * 0.1 + rng.uniform(-0.3, 0.3), proto, src, dst, flags, rng.randint(40, 1500), 20, rng.choice([0, 30, 99])))
    return rows


def expected_features(flow):
    rows = flow["packets"]
    forward = [p for p in rows if (p[3], p[5]) == flow["src"]]
    gaps = [max(b[1] - a[1], 0) / 1e6 for a, b in zip(rows, rows[1:])]
    tcp = [p for p in rows if p[10] is not None]
    std = lambda v: statistics.stdev(v) if len(v) > 1 else 0.0
    sizes = [p[7] for p in forward]
    mean = statistics.mean(gaps)
    return {
        "total_packets": len(rows), "fwd_packets": len(forward), "fwd_bytes": sum(sizes), "bwd_packets": len(rows) - len(forward),
        "fwd_pkt_len_mean": statistics.mean(sizes), "fwd_pkt_len_std": std(sizes), "iat_mean": mean, "iat_std": std(gaps),
        "iat_cv": std(gaps) / mean if mean > 0 else 0.0, "iat_max": max(gaps), "iat_min": min(gaps),
        "ack_count": sum("A" in p[10] for p in tcp), "urg_count": sum("U" in p[10] for p in tcp),
        "syn_ratio": sum("S" in p[10] for p in tcp) / len(tcp) if tcp else 0.0,
        "zero_payload_ratio": sum(p[9] == 0 for p in rows) / len(rows),
    }


def test_random_packets_equal_sequential_assembly(spark):
    for seed, idle in ((1, None), (2, 1.5)):
        packets = random_packets(seed)
        want = {f["packets"][0][0]: f for f in sequential(packets, None if idle is None else int(idle * 1e6))}
        sessions = assembled(spark, packets, FlowParams(idle_timeout_seconds=idle))
        got = {r["flow_id"]: r for r in flows(sessions).collect()}
        assert {k: (len(f["packets"]), f["clean"], f["src"][0], f["packets"][-1][1]) for k, f in want.items()} == {
            k: (r["total_packets"], r["finished_cleanly"], r["src_ip"], r["last_us"]) for k, r in got.items()
        }
        features = {r["flow_id"]: r for r in flow_features(sessions).collect()}
        assert set(features) == {k for k, f in want.items() if len(f["packets"]) > 1}
        for k, row in features.items():
            for name, value in expected_features(want[k]).items():
                assert abs(row[name] - value) < 1e-6, (k, name)


def test_direction_per_packet(spark):
    packets = random_packets(3, 200)
    want = {}
    for f in sequential(packets):
        for p in f["packets"]:
            want[p[0]] = "forward" if (p[3], p[5]) == f["src"] else "backward"
    got = {r["arrival_seq"]: r["direction"] for r in with_direction(assembled(spark, packets)).collect()}
    assert got == want


def test_flows_are_hashed_not_sorted(spark):
    sessions = assembled(spark, random_packets(3))
    for df in (flows(sessions), flow_features(sessions)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_timing_on_a_rounding_edge_is_summed_in_arrival_order(spark):
    """Long and short gaps in days far apart: their parts are summed apart, and the mean of five lies on an edge."""
    gaps = [16_329_599_700_100, 100_000, 116_300, 147_600, 250]
    times = [sum(gaps[:i]) for i in range(len(gaps) + 1)]
    rows = [packet((i // 2) << 24 | i, t / 1e6, 17, ("10.0.0.1", 5000), ("10.0.0.2", 53)) for i, t in enumerate(times)]
    rows += [packet(100 + i, i * 0.00025, 17, ("10.0.0.3", 5000), ("10.0.0.2", 53)) for i in range(3)]
    rows += [packet(200 + i, i * 0.3, 17, ("10.0.0.4", 5000), ("10.0.0.2", 53)) for i in range(3)]
    packets = spark.createDataFrame(rows, PACKETS)
    plain = flow_features(with_flow_id(packets))
    off = plain.withColumn("iat_mean", plain.iat_mean * (1 + 2**-51))
    mended = {r.src_ip: r for r in timing_in_arrival_order(off, packets, {"iat_mean": 4, "iat_cv": 2}).collect()}
    assert len(mended) == 3 and mended["10.0.0.3"].iat_mean == (0.00025 + 0.00025) / 2
    total = 0.0
    for gap in gaps:
        total += gap / 1e6
    assert mended["10.0.0.1"].iat_mean == total / len(gaps)
    assert mended["10.0.0.4"].iat_mean == next(r.iat_mean for r in off.collect() if r.src_ip == "10.0.0.4")
    assert sorted(mended["10.0.0.1"].asDict()) == sorted(off.columns)


def test_flows_grouped_in_place_equal_those_grouped_again(spark):
    """Some keys lie in one chunk of arrival numbers, some in several, one has no protocol."""
    packets = [(p[0] * (SEQUENCE_CHUNKS[0] // 500), *p[1:]) for p in random_packets(4)]
    packets += [packet(SEQUENCE_CHUNKS[0] * 9 + i, 300 + i / 10, 6, A, B, "A" if i % 5 else "F") for i in range(12)]
    packets += [(SEQUENCE_CHUNKS[0] * 9 + 20 + i, 5 + i, None, *p[3:]) for i, p in enumerate(random_packets(4, 5))]
    packets = [p if len(p) == 11 else (p[0], p[1], None, *random_packets(4, 1)[0][3:]) for p in packets]
    table = spark.createDataFrame(packets, PACKETS)
    for params in (FlowParams(), FlowParams(idle_timeout_seconds=1.5)):
        sessions = with_flow_id(table, params)

        def rows(df):
            return {r["flow_id"]: {k: round(v, 6) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in df.collect()}

        assert rows(packet_features(table, params)) == rows(flow_features(sessions))
        assert rows(started_flows(table, params)) == rows(new_flow_events(sessions))


def test_packets_are_dealt_once(spark, tmp_path):
    """Packets, their chunks and the few keys in several chunks read one exchange; whole flows need no other."""
    spark.createDataFrame(random_packets(5), PACKETS).write.parquet(str(tmp_path / "packets"))
    table = spark.read.parquet(str(tmp_path / "packets"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = packet_features(table)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    wide = [line for line in plan.splitlines() if "ReusedExchange" in line and "tcp_flags" in line]
    assert len(wide) >= 2

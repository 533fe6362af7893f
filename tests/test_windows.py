import random

from netspark.operators import windows as W
from netspark.params import BruteForceParams, DdosParams, EvidenceParams, PortScanParams

S = 1_000_000
FLOWS = "flow_id bigint, finish_seq bigint, ts_us bigint, src_ip string, dst_ip string, dst_port int"


def new_flows(spark, rows):
    """rows: (seconds, src, dst, port)"""
    return spark.createDataFrame([(i, i, int(round(t * S)), s, d, p) for i, (t, s, d, p) in enumerate(rows)], FLOWS)


def checks(spark, rows):
    return spark.createDataFrame([(i, int(round(t * S)), s) for i, (t, s) in enumerate(rows)], "check_id bigint, ts_us bigint, src_ip string")


def random_flows(seed, n, span=60.0):
    rng = random.Random(seed)
    times = [round(rng.uniform(0, span), 1) for _ in range(n)]  # tenths, so equal times happen
    return [
        (t, f"10.0.0.{rng.choice([1, 1, 1, 2, 3])}", f"192.168.0.{rng.randint(1, 5)}", rng.choice([22, 80, 443, 3389, 8000, 8001]))
        for t in times
    ]


def in_window(rows, t, w):
    return [r for r in rows if round((t - w) * S) <= round(r[0] * S) <= round(t * S)]


def brute_targets(rows):
    ports, hosts = {}, {}
    for _, _, d, p in rows:
        ports.setdefault(d, set()).add(p)
        hosts.setdefault(p, set()).add(d)
    return sum(len(ps) >= 2 or any(len(hosts[p]) >= 2 for p in ps) for ps in ports.values())


def test_ddos_equals_brute_force(spark):
    rows = random_flows(1, 300)
    p = DdosParams(10.0, 60, 3, 50, 3)
    got = W.ddos_windows(new_flows(spark, rows), None, p).orderBy("flow_id").collect()
    for (t, *_), r in zip(rows, got):
        seen = in_window(rows, t, 10)
        assert (r["total_flows"], r["distinct_sources"]) == (len(seen), len({x[1] for x in seen}))


def test_one_source_is_suspicious_many_are_attack(spark):
    one = [(i / 1000, "10.0.0.1", "192.168.0.1", 80) for i in range(600)]
    many = [(i / 1000, f"10.0.0.{i % 30}", "192.168.0.1", 80) for i in range(600)]
    for rows, verdict in ((one, "SUSPICIOUS"), (many, "ATTACK")):
        got = W.ddos_windows(new_flows(spark, rows)).orderBy("flow_id").collect()
        assert got[-1]["verdict"] == verdict and got[0]["verdict"] == "NORMAL"


def test_partial_eviction_at_check_times(spark):
    rows = [(1000 + i / 100, "a", "b", 1) for i in range(5)] + [(1008 + i / 100, "a", "b", 1) for i in range(5)]
    got = W.ddos_windows(new_flows(spark, rows), checks(spark, [(1009, "a"), (1011, "a")])).orderBy("ts_us").collect()
    assert [r["total_flows"] for r in got] == [10, 5]


def test_small_spread_flood_reaches_attack(spark):
    rows = [(5 * (s * 25 + f) / 625, f"203.0.113.{s}", "192.168.1.10", 80) for s in range(25) for f in range(25)]
    got = W.ddos_windows(new_flows(spark, rows)).orderBy("ts_us").collect()
    assert len(got) == 625 and got[-1]["verdict"] == "ATTACK"


def test_port_scan_equals_brute_force(spark):
    rows = random_flows(2, 250)
    got = W.port_scan_windows(new_flows(spark, rows), None, PortScanParams(10.0, 5, 3)).orderBy("flow_id").collect()
    assert len(got) == len(rows)
    for (t, src, *_), r in zip(rows, got):
        seen = [x for x in in_window(rows, t, 10) if x[1] == src]
        assert r["distinct_ports"] == len({x[3] for x in seen})
        assert r["distinct_targets"] == brute_targets(seen)
        assert (r["scan_start_us"], r["scan_end_us"]) == (round(min(x[0] for x in seen) * S), round(max(x[0] for x in seen) * S))


def test_port_scan_at_check_times_equals_brute_force(spark):
    rows = random_flows(3, 200)
    rng = random.Random(9)
    asked = [(round(rng.uniform(-5, 90), 2), f"10.0.0.{rng.randint(1, 3)}") for _ in range(150)]
    got = W.port_scan_windows(new_flows(spark, rows), checks(spark, asked), PortScanParams(7.0, 5, 3)).collect()
    assert len(got) == len(asked)
    for r in got:
        t, src = asked[r["check_id"]]
        seen = [x for x in in_window(rows, t, 7) if x[1] == src]
        assert r["distinct_ports"] == len({x[3] for x in seen})
        assert r["distinct_targets"] == brute_targets(seen)
        if seen:
            assert r["scan_start_us"] == round(min(x[0] for x in seen) * S)
            assert r["scan_end_us"] == round(max(x[0] for x in seen) * S)
        else:
            assert r["scan_start_us"] is None and r["ports_per_second"] == 0.0


def test_port_scan_thresholds_and_targets(spark):
    p = PortScanParams(10.0, attack_ports=15, suspicious_ports=6)
    for ports, verdict, confidence in ((3, "NORMAL", 0.0), (6, "SUSPICIOUS", 40.0), (15, "ATTACK", 100.0)):
        rows = [(1 + i / 10, "10.0.0.9", "192.168.0.1", 1000 + i) for i in range(ports)]
        last = W.port_scan_windows(new_flows(spark, rows), None, p).orderBy("flow_id").collect()[-1]
        assert (last["distinct_ports"], last["verdict"], last["confidence_pct"]) == (ports, verdict, confidence)
        assert last["distinct_targets"] == 1
    sweep = [(1 + i / 10, "10.0.0.9", f"192.168.0.{i}", 22) for i in range(10)]
    last = W.port_scan_windows(new_flows(spark, sweep)).orderBy("flow_id").collect()[-1]
    assert (last["distinct_ports"], last["distinct_targets"]) == (1, 10)
    mixed = [(1 + i / 10, "10.0.0.9", "192.168.0.1", 1000 + i) for i in range(9)] + [(2, "10.0.0.9", "8.8.8.8", 53)]
    assert W.port_scan_windows(new_flows(spark, mixed)).orderBy("flow_id").collect()[-1]["distinct_targets"] == 1
    same = [(1 + i / 10, "10.0.0.9", "192.168.0.1", 443) for i in range(20)]
    assert W.port_scan_windows(new_flows(spark, same), detail=False).orderBy("flow_id").collect()[-1]["verdict"] == "NORMAL"


def brute_episodes(times, w, attack):
    """Attempts with peers, and episodes, at each distinct time."""
    out, episode, was = {}, 0, False
    for t in sorted(set(times)):
        n = sum(t - w <= x <= t for x in times)
        episode += n >= attack and not was
        was = n >= attack
        out[t] = (n, episode)
    return out


def test_brute_force_equals_fold(spark):
    rows = random_flows(4, 300, 120.0)
    got = W.brute_force_windows(new_flows(spark, rows), BruteForceParams(8.0, 3, 2)).collect()
    assert {r["dst_port"] for r in got} == {22, 3389}
    by_key = {}
    for i, (t, s, d, p) in enumerate(rows):
        by_key.setdefault((s, d, p), []).append(round(t * S))
    for r in got:
        want = brute_episodes(by_key[(r["src_ip"], r["dst_ip"], r["dst_port"])], 8 * S, 3)
        assert (r["attempts"], r["repeat_offender_count"]) == want[r["ts_us"]]


def test_brute_force_episodes(spark):
    steady = [(1000 + i, "a", "b", 22) for i in range(15)]
    last = W.brute_force_windows(new_flows(spark, steady)).orderBy("flow_id").collect()[-1]
    assert (last["verdict"], last["repeat_offender_count"]) == ("ATTACK", 1)
    bursts = [(b + i / 10, "a", "b", 22) for b in (0, 1000) for i in range(15)]
    got = W.brute_force_windows(new_flows(spark, bursts), BruteForceParams(10.0)).orderBy("flow_id").collect()
    assert (got[14]["repeat_offender_count"], got[29]["repeat_offender_count"]) == (1, 2)


def test_transitions_buffer_and_summary(spark):
    verdicts = ["NORMAL", "ATTACK", "ATTACK", "SUSPICIOUS", "ATTACK", "NORMAL"]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(verdicts)] + [("j", 9, "ATTACK")], "k string, n bigint, verdict string")
    assert sorted((r["k"], r["n"]) for r in W.verdict_transitions(df, ["k"], "n").collect()) == [("j", 9), ("k", 1), ("k", 4)]
    assert sorted(r["n"] for r in W.verdict_transitions(df.filter("k = 'k'"), [], "n", to=None).collect()) == [1, 3, 4, 5]
    counted = W.running_summary(df.filter("k = 'k'"), "n", every=3).orderBy("flows_seen").collect()
    assert [tuple(r) for r in counted] == [(3, 1, 0, 2, 0), (6, 2, 1, 3, 0)]
    recent = spark.createDataFrame([(i, i * 100 * S) for i in range(6)], "arrival_seq bigint, ts_us bigint")
    assert [r["arrival_seq"] for r in W.evidence_buffer(recent, EvidenceParams(300.0)).collect()] == [2, 3, 4, 5]


def test_flagged_detail_equals_full(spark):
    p = PortScanParams(10.0, 5, 4)
    rows = random_flows(5, 200, 200.0) + [(90 + i / 10, "10.0.0.9", f"192.168.0.{i % 4}", 7000 + i) for i in range(12)]
    table = new_flows(spark, rows)
    some = checks(spark, [(t, s) for t, s, *_ in rows[::3]] + [(95.0, "10.0.0.9"), (-3.0, "10.0.0.9"), (150.0, "none")])
    for check in (None, some):
        key = "flow_id" if check is None else "check_id"
        full = {r[key]: r.asDict() for r in W.port_scan_windows(table, check, p).collect()}
        got = {r[key]: r.asDict() for r in W.port_scan_windows(table, check, p, detail="flagged").collect()}
        hidden = {"distinct_targets", "scan_start_us", "scan_end_us", "duration_seconds", "ports_per_second"}
        assert got.keys() == full.keys() and {r["verdict"] for r in full.values()} > {"NORMAL"}
        for k, row in full.items():
            assert got[k] == {c: None if c in hidden and row["verdict"] == "NORMAL" else v for c, v in row.items()}


def test_targets_alone_equal_full(spark):
    table = new_flows(spark, random_flows(6, 150))
    full = W.port_scan_windows(table, None, PortScanParams(10.0, 5, 4))
    got = W.port_scan_windows(table, None, PortScanParams(10.0, 5, 4), detail="targets")
    assert "scan_start_us" not in got.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, full.select(*got.columns).collect()))


def test_window_sweeps_deal_their_rows_once(spark, tmp_path):
    """Every scan of changes reads rows and totals from one exchange, so nothing below it is worked out twice."""
    new_flows(spark, random_flows(7, 100)).write.parquet(str(tmp_path / "flows"))
    table = spark.read.parquet(str(tmp_path / "flows"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = W.ddos_counts(table, table, DdosParams(10.0))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("ReusedExchange") == 2 and plan.count("FileScan parquet") == 2

import random

from pyspark.sql import functions as F

from netspark.operators import incidents as I, reports as R, techniques as T
from netspark.schemas import ACTIONS, EVIDENCE


def evidence(spark, rows):
    """rows: (seq, detector, seconds, verdict, src, attack_type)"""
    full = [
        (f"e{seq}", seq, d, int(t * 1_000_000), v, f"{d} found", src, None, None, "{}", kind) for seq, d, t, v, src, kind in rows
    ]
    return spark.createDataFrame(full, EVIDENCE)


def actions(spark, rows):
    return spark.createDataFrame(rows, ACTIONS)


def folded(rows, acts):
    """Row-at-a-time correlation: (seq -> (incident number, status after)) of attached rows and effective actions."""
    state, out = {}, {}
    stream = [(seq, "e", v, src or "__aggregate__") for seq, _, _, v, src, _ in rows] + [(s, "a", a, k) for s, k, a in acts]
    for seq, kind, what, key in sorted(stream):
        number, status = state.get(key, (0, None))
        if kind == "a":
            if status is None:
                continue
            status = "RESOLVED" if what == "resolve" else "OPEN"
        elif what in ("NORMAL", "WARMING_UP"):
            continue
        elif status != "OPEN":
            if what == "UNAVAILABLE":
                continue
            number, status = number + 1, "OPEN"
        state[key] = (number, status)
        out[seq] = (key, number, status)
    return out


def test_random_evidence_equals_fold(spark):
    rng = random.Random(5)
    verdicts = ["NORMAL", "SUSPICIOUS", "ATTACK", "UNAVAILABLE", "WARMING_UP"]
    order = rng.sample(range(5000), 700)
    rows = [(s, "ddos", rng.random() * 99, rng.choice(verdicts), rng.choice(["a", "a", "a", "b", "c", None]), None) for s in order[:550]]
    acts = [(s, rng.choice(["a", "b", "c", "d", "__aggregate__"]), rng.choice(["resolve", "reopen"])) for s in order[550:]]
    bridge = I.correlate(evidence(spark, rows), actions(spark, acts))
    got = {r["arrival_seq"]: (r["key"], r["incident_no"], r["status_after"]) for r in bridge.collect()}
    want = folded(rows, acts)
    assert got == want
    last = {}
    for seq in sorted(want):
        key, number, status = want[seq]
        last[(key, number)] = status
    table = {(r["key"], r["incident_no"]): r["status"] for r in I.incidents(bridge).collect()}
    assert table == last


def test_detectors_of_one_source_merge(spark):
    rows = [(1, "port_scan", 100, "ATTACK", "x", None), (2, "brute_force", 150, "ATTACK", "x", None)]
    (one,) = I.incidents(I.correlate(evidence(spark, rows))).collect()
    assert (one["detectors_involved"], one["evidence_count"]) == (["brute_force", "port_scan"], 2)
    assert (one["first_seen_us"], one["last_seen_us"]) == (100_000_000, 150_000_000)
    assert one["techniques"] == ["T1046", "T1110"]


def test_unavailable_attaches_only_to_an_open_incident(spark):
    rows = [(1, "llm", 1, "UNAVAILABLE", "x", None), (2, "ddos", 2, "ATTACK", "x", None), (3, "llm", 3, "UNAVAILABLE", "x", None)]
    got = I.correlate(evidence(spark, rows), actions(spark, [(4, "x", "resolve")])).orderBy("arrival_seq").collect()
    assert [r["arrival_seq"] for r in got] == [2, 3, 4]
    later = rows + [(5, "llm", 5, "UNAVAILABLE", "x", None), (6, "ddos", 6, "SUSPICIOUS", "x", None)]
    table = I.incidents(I.correlate(evidence(spark, later), actions(spark, [(4, "x", "resolve")]))).orderBy("incident_no").collect()
    assert [(r["incident_no"], r["status"], r["highest_verdict"]) for r in table] == [(1, "RESOLVED", "ATTACK"), (2, "OPEN", "SUSPICIOUS")]


def scored(spark, *found):
    rows = [(i, d, i, v, "x", kind) for i, (d, v, kind) in enumerate(found)]
    (row,) = I.incidents(I.correlate(evidence(spark, rows))).collect()
    return row["risk_score"], row["risk_tier"]


def test_risk_scores(spark):
    assert scored(spark, ("ddos", "ATTACK", None)) == (30, "MEDIUM")
    assert scored(spark, ("anomaly", "SUSPICIOUS", None), ("port_scan", "SUSPICIOUS", None)) == (32, "MEDIUM")
    assert scored(spark, ("anomaly", "SUSPICIOUS", None), ("brute_force", "ATTACK", None), ("llm", "ATTACK", "ddos")) == (94, "CRITICAL")
    assert scored(spark, ("anomaly", "SUSPICIOUS", None)) == (8, "LOW")


def test_tier_bounds(spark):
    df = spark.createDataFrame([(s,) for s in (0, 24, 25, 49, 50, 79, 80, 100)], "s int").select(I.risk_tier(F.col("s")).alias("t"))
    assert [r["t"] for r in df.collect()] == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL"]


def test_running_risk_ends_at_the_incident_risk(spark):
    rows = [(i, d, i, v, "x", None) for i, (d, v) in enumerate([("anomaly", "SUSPICIOUS"), ("ddos", "ATTACK"), ("anomaly", "ATTACK")])]
    bridge = I.correlate(evidence(spark, rows))
    running = [r["risk_score"] for r in I.running_risk(bridge).orderBy("arrival_seq").collect()]
    assert running == [8, 48, 55] and I.incidents(bridge).collect()[0]["risk_score"] == 55


def test_techniques(spark):
    rows = [
        (1, "anomaly", 1, "ATTACK", "x", None), (2, "llm", 2, "ATTACK", "syn_flood", None), (3, "llm", 3, "ATTACK", "x", "credential_stuffing"),
        (4, "ddos", 4, "NORMAL", None, None),
    ]
    tagged = T.tag_techniques(evidence(spark, rows)).orderBy("arrival_seq").collect()
    assert [r["technique_id"] for r in tagged] == [None, None, "T1110.004", "T1498"]


def test_timeline_lines_keep_arrival_order_and_never_cut(spark):
    rows = [(1, "port_scan", 50, "ATTACK", "10.0.0.66", None), (2, "llm", 10, "UNAVAILABLE", "10.0.0.66", None)]
    bridge = I.correlate(evidence(spark, rows))
    lines = [r["line"] for r in I.timeline_text(bridge, I.incidents(bridge)).orderBy("line_order").collect()]
    assert lines[0].endswith("(10.0.0.66) — status=OPEN, highest_verdict=ATTACK")
    assert lines[1] == "  [1970-01-01 00:00:50 UTC] port_scan    ATTACK     10.0.0.66 -> ?:?  (port_scan found)"
    assert "llm          UNAVAILABLE 10.0.0.66" in lines[2]


def test_views(spark):
    rows = [(1, "ddos", 1, "ATTACK", None, None), (2, "port_scan", 2, "SUSPICIOUS", "x", None)]
    bridge = I.correlate(evidence(spark, rows), actions(spark, [(3, "x", "resolve")]))
    table = I.incidents(bridge)
    assert [r["key"] for r in R.incident_list(table).collect()] == ["__aggregate__"]
    assert {r["item"]: r["value"] for r in R.summary(table).collect()} == {
        "open_incidents": 1, "tier_LOW": 0, "tier_MEDIUM": 1, "tier_HIGH": 0, "tier_CRITICAL": 0
    }
    assert R.incident_detail(bridge, table, "nobody").count() == 0
    assert [r["source"] for r in R.incidents_csv(table).orderBy("evidence_count", "source").collect()] == ["aggregate (DDoS)", "x"]
    assert "src=" not in R.incidents_cef(table.filter("key = '__aggregate__'")).collect()[0]["line"]
    merged = I.merge_sensors({"s1": table, "s2": table})
    assert merged.select("sensor_id", "incident_id").distinct().count() == 4


def test_cef_escapes(spark):
    df = evidence(spark, [(1, "llm", 1.5, "ATTACK", "x", None)]).withColumn("reasoning", F.lit("a=b\\c|d"))
    line = R.evidence_cef(df).collect()[0]["line"]
    assert "|llm.ATTACK|" in line and " msg=a\\=b\\\\c|d " in line and "|9|rt=1500 src=x " in line and "dst=" not in line

import random

from pyspark.sql import functions as F

from netspark.functions import ip as ipf
from netspark.operators import geo, response as R
from netspark.params import AlertParams, BlockParams
from netspark.schemas import GEO_RANGES


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(build(F.col("v"))).collect()]


def test_escalating_durations(spark):
    got = column(spark, [0, 1, 2, 3, 4, 5, 1000], lambda c: R.block_minutes(c), "bigint")
    assert got == [60, 60, 180, 360, 540, 600, 600]


def test_block_skip_reasons(spark):
    p = BlockParams(own_addresses=("9.9.9.9",), whitelist=("8.8.4.4",))
    got = column(spark, ["127.0.0.5", "9.9.9.9", "8.8.4.4", "nope", "10.1.1.1", "224.0.0.1", "8.8.8.8", "::1", "2001:4860::8888", "fe80::1", "fd00:1::2", "1::2::3", "::ffff:8.8.8.8", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "12345::", "::"], lambda c: R.block_skip_reason(c, p))
    assert [g and g.split()[0] for g in got] == [
        "loopback", "one", "on", "not", "private", None, None, "loopback", None, "private", "private", "not", None, None, "not", "not", "private",
    ]


def test_address_predicates(spark):
    values = ["192.0.0.9", "192.0.0.8", "203.0.113.7", "240.0.0.1", "239.1.1.1", "255.255.255.255", "1.2.3", "01.2.3.4", None]
    assert column(spark, values, ipf.is_private) == [False, True, True, True, False, True, False, False, False]
    assert column(spark, values, ipf.is_multicast_or_broadcast) == [False, False, False, False, True, True, False, False, False]
    assert column(spark, values, ipf.ip_number)[-3:] == [None, None, None]


def events(spark, rows):
    return spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "seq bigint, ts_us bigint, src_ip string")


def greedy(rows, limit):
    last, sent = {}, []
    for i, (t, s) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[0])):
        if s not in last or t - last[s] >= limit:
            last[s] = t
            sent.append(i)
    return sorted(sent)


def test_alert_limit_equals_fold(spark):
    """Pointer doubling must agree with a sequential fold."""
    rng = random.Random(5)
    rows = [(rng.randint(0, 4000), rng.choice(["hot", "hot", "hot", "b"])) for _ in range(400)] + [(90_000 + i, "b") for i in range(3)]
    got = R.rate_limited_alerts(events(spark, rows), AlertParams(rate_limit_seconds=60e-6)).filter("sent").collect()
    assert sorted(r["seq"] for r in got) == greedy(rows, 60)


def test_alert_limit_is_closed_at_the_limit(spark):
    rows = [(t * 1_000_000, "a") for t in (0, 100, 600, 700, 1200)]
    got = R.rate_limited_alerts(events(spark, rows)).filter("sent").orderBy("seq").collect()
    assert [r["ts_us"] // 1_000_000 for r in got] == [0, 600, 1200]


def test_block_intervals_and_as_of(spark):
    schema = "seq bigint, ts_us bigint, action string, ip string, expires_us bigint"
    rows = [(1, 0, "block", "a", 100), (2, 50, "block", "a", 70), (3, 60, "unblock", "a", None), (4, 10, "block", "b", 30)]
    df = spark.createDataFrame([(s, t * 10**6, a, i, e and e * 10**6) for s, t, a, i, e in rows], schema)
    got = {r["seq"]: (r["valid_from_us"] // 10**6, r["valid_to_us"] // 10**6) for r in R.block_intervals(df).collect()}
    assert got == {1: (0, 50), 2: (50, 60), 4: (10, 30)}
    as_of = lambda t: {r["ip"]: r["seconds_remaining"] for r in R.blocked_as_of(df, t * 10**6).collect()}
    assert as_of(20) == {"a": 80.0, "b": 10.0} and as_of(55) == {"a": 15.0} and as_of(65) == {} and as_of(30) == {"a": 70.0}


def test_geo_lookup(spark):
    start = ipf.to_number("8.8.0.0")
    ranges = spark.createDataFrame(
        [(start, start + 200_000, "Land", "LA", None, 1.0, 2.0, "AS15169 Some Net", "Org"), (start + 300_000, start + 300_000, None, None, "Town", None, None, "ASx", None)],
        GEO_RANGES,
    )
    ips = ["8.8.8.8", "8.11.255.1", "8.12.147.224", "10.0.0.1", "bad", None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(ips)], "i int, ip string")
    got = {r["i"]: (r["resolved"], r["location"], r["asn"]) for r in geo.geo_enrich(rows, "ip", ranges).collect()}
    assert got[0] == (True, "Land (Org)", 15169) and got[2] == (True, "Town", None)
    assert got[1][1] == "location unknown" and got[3][1] == "local network" and got[4][1] == "location unknown"
    assert len(got) == 6


def test_geo_lookup_of_many_ranges_and_a_hot_address(spark, monkeypatch):
    rng = random.Random(6)
    edges = sorted(rng.sample(range(ipf.to_number("11.0.0.0"), ipf.to_number("12.0.0.0"), 7), 80))
    ranges = [(a, b, f"C{a}", "CC", None, 0.0, 0.0, "AS1 x", "o") for a, b in zip(edges[::2], edges[1::2])]
    numbers = [rng.randrange(edges[0] - 9, edges[-1] + 9) for _ in range(300)] + edges + [edges[0]] * 400
    text = lambda n: ".".join(str(n >> k & 255) for k in (24, 16, 8, 0))
    rows = spark.createDataFrame([(i, text(n)) for i, n in enumerate(numbers)], "i int, ip string")
    expected = [next((r[2] for r in ranges if r[0] <= n <= r[1]), None) for n in numbers]
    for most in (geo.MOST_SENT, 0):
        monkeypatch.setattr(geo, "MOST_SENT", most)
        got = geo.geo_enrich(rows, "ip", spark.createDataFrame(ranges, GEO_RANGES)).orderBy("i").collect()
        assert [r["country"] for r in got] == expected


def test_alert_text(spark):
    df = spark.createDataFrame([(1, "x", "ddos", "", "  a: 1")], "seq int, src_ip string, attack_type string, reasoning string, detail string")
    row = R.alert_messages(df, "brand").collect()[0]
    assert row["subject"] == "[brand] ATTACK: ddos from x"
    assert row["body"].splitlines()[-3:] == ["", "Additional detail:", "  a: 1"] and "Reasoning" not in row["body"]

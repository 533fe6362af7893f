"""The driver tables read as network tables (FIXTURES.md section 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _host(prefix: str, number: str) -> str:
    return f"concat('{prefix}.', {number} div 250, '.', {number} % 250 + 1)"


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a conversation; its line items are the packets."""
    orders = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey", "unix_micros(cast(o_orderdate as timestamp)) day_us"
    )
    items = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"
    )
    numbered = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "*", "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) pkt_no"
    )
    client, server = _host("10.0", "o_custkey"), "concat('192.168.1.', l_orderkey % 50 + 1)"
    service = "element_at(array(22, 443, 80, 3389, 5432), cast(l_orderkey % 5 + 1 as int))"
    port = "cast(20000 + l_orderkey % 40000 as int)"
    out = "l_linestatus = 'O'"
    return numbered.selectExpr(
        "day_us div 86400000000 * 10000000000 + l_orderkey * 100 + pkt_no arrival_seq",
        "day_us + pkt_no * (100000 + (l_partkey % 50) * 4000) ts_us",
        "case when l_orderkey % 10 < 7 then 6 when l_orderkey % 10 < 9 then 17 else 1 end protocol",
        f"if({out}, {client}, {server}) src_ip",
        f"if({out}, {server}, {client}) dst_ip",
        f"case when l_orderkey % 10 = 9 then 0 when {out} then {port} else {service} end src_port",
        f"case when l_orderkey % 10 = 9 then 0 when {out} then {service} else {port} end dst_port",
        "cast(40 + l_quantity * 20 as int) size",
        "20 header_size",
        "cast(case when l_returnflag = 'A' and l_quantity < 25 then 0 else 20 + l_quantity * 20 end as int) payload_size",
        "case when l_orderkey % 10 >= 7 then null when l_partkey % 97 = 0 then 'R' when l_linenumber = 7 then 'FA' "
        "when pkt_no = 1 then 'S' when l_returnflag = 'N' then 'PA' else 'A' end tcp_flags",
    )


def new_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a flow creation."""
    k = "cast(get_json_object(props, '$.k') as int)"
    return read(spark, sf_dir, "events").selectExpr(
        "event_id flow_id",
        "unix_micros(cast(ts as timestamp)) ts_us",
        f"{_host('10.0', 'user_id')} src_ip",
        "concat('192.168.1.', event_id % 7 + 1) dst_ip",
        f"case event_type when 'signup' then 22 when 'error' then 3389 when 'click' then 443 "
        f"when 'view' then 1000 + {k} else 8000 + {k} % 10 end dst_port",
    )


def scored_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a finished flow with a given anomaly score (three decimals) and rate.

    Rates and scores come from the event value, so busy events look unusual.
    """
    cents = "cast(round(value * 100) as bigint)"
    base = read(spark, sf_dir, "events").selectExpr("event_id", "value", f"{cents} cents")
    return new_flows(spark, sf_dir).join(base, F.col("flow_id") == F.col("event_id")).selectExpr(
        "flow_id",
        "flow_id finish_seq",
        "ts_us",
        "src_ip",
        "cast(20000 + flow_id % 40000 as int) src_port",
        "case when flow_id % 53 = 0 then '239.255.255.250' when flow_id % 59 = 0 then '255.255.255.255' else dst_ip end dst_ip",
        "dst_port",
        "case when flow_id % 10 < 7 then 6 when flow_id % 10 < 9 then 17 else 1 end protocol",
        "(3000 - cents) div 200 / 1000.0D score",
        "cast(2 + flow_id % 40 as bigint) total_packets",
        "cents / 10.0D packets_per_second",
        "flow_id % 5 / 4.0D syn_ratio",
        "flow_id % 3 / 2.0D zero_payload_ratio",
    )


RESPONSE_CASES = [
    '{"attack_type": "port_scan", "confidence": "high", "reasoning": "many ports"}',
    '```json\n{"attack_type": "ddos", "confidence": "medium", "reasoning": "high rate"}\n```',
    '{"attack_type": "benign", "confidence": "high", "reasoning": "normal transfer"}',
    '{"attack_type": "worm", "confidence": "high", "reasoning": "unlisted type"}',
    '{"attack_type": "brute_force", "confidence": "certain", "reasoning": "odd confidence"}',
    "I think this is an attack",
    '{"attack_type": "unknown", "confidence": "low", "reasoning": "not clear"}',
    '{"attack_type": "data_exfiltration", "confidence": "low"}',
    '  {"attack_type": "syn_flood", "confidence": "high", "reasoning": "no handshake = flood"}  ',
    '{"confidence": "high"}',
]


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw reviewer answer per flow, good and bad ones in turn."""
    cases = F.array(*[F.lit(c) for c in RESPONSE_CASES])
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("flow_id"),
        F.get(cases, (F.col("event_id") % len(RESPONSE_CASES)).cast("int")).alias("raw_text"),
    )


# Midpoints of the event month: half of it, and three quarters.
HALF_US = 1705363200000000  # 2024-01-16
LATE_US = 1705968000000000  # 2024-01-23


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators resolve some sources half way, and reopen some of those later."""
    hosts = new_flows(spark, sf_dir).withColumn("last_octet", F.expr("try_cast(get(split(src_ip, '[.]'), 3) as int)"))

    def last_before(limit: int, every: int, action: str) -> DataFrame:
        picked = hosts.filter((F.col("ts_us") < limit) & (F.col("last_octet") % every == 0))
        return picked.groupBy(F.col("src_ip").alias("key")).agg(
            (F.max("flow_id") * 8 + 7).alias("arrival_seq")
        ).withColumn("action", F.lit(action))

    both = last_before(HALF_US, 5, "resolve").unionByName(last_before(LATE_US, 10, "reopen"))
    return both.select("arrival_seq", "key", "action")


PREFIXES = ["8.8", "10.1", "127.0", "169.254", "172.20", "192.0", "198.51", "203.0", "224.0", "240.1", "255.255", "11.0"]


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One address per event, spread over public, private, reserved and invalid forms."""
    prefixes = F.array(*[F.lit(p) for p in PREFIXES])
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("flow_id"),
        F.expr("unix_micros(cast(ts as timestamp))").alias("ts_us"),
        F.when(F.col("event_id") % 101 == 0, F.concat(F.lit("host-"), "user_id"))
        .when(F.col("event_id") % 97 == 0, F.lit("255.255.255.255"))
        .when(F.col("event_id") % 89 == 0, F.concat(F.lit("10.0.0."), F.col("user_id") + 200))
        .otherwise(
            F.concat_ws(
                ".",
                F.get(prefixes, (F.col("event_id") % len(PREFIXES)).cast("int")),
                (F.col("user_id") % 120).cast("string"),
                (F.col("event_id") % 256).cast("string"),
            )
        )
        .alias("ip"),
    )


def geo_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint address ranges owned by suppliers, with a hole after each."""
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    owned = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return owned.selectExpr(
        "184549376 + s_suppkey * 300 start_ip",
        "184549376 + s_suppkey * 300 + 249 end_ip",
        "n_name country",
        "substring(n_name, 1, 2) country_code",
        "if(s_suppkey % 3 = 0, null, concat('City ', s_suppkey)) city",
        "s_suppkey / 4.0D latitude",
        "-s_suppkey / 4.0D longitude",
        "case when s_suppkey % 5 = 0 then null when s_suppkey % 7 = 0 then concat('ASx', s_suppkey) "
        "else concat('AS', 1000 + s_suppkey, ' Net ', s_suppkey) end as_text",
        "if(s_suppkey % 4 = 0, null, concat('Net ', s_suppkey)) org",
    )

"""The registered queries: one Spark plan per operator, with a plain-SQL check where SQL can state it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from netspark.functions import ip as ipf
from netspark.functions.text import utc_text
from netspark.operators import (
    anomaly,
    budget as bud,
    evidence as ev,
    features as fe,
    flows as fl,
    geo,
    incidents as inc,
    metrics as me,
    registry as reg,
    reports as rep,
    response as res,
    retention as ret,
    techniques as tech,
    training as tr,
    verdicts as ver,
    windows as win,
)
from netspark.params import (
    AnomalyParams,
    BlockParams,
    EvidenceParams,
    FlowParams,
    RetentionParams,
    VerdictParams,
)
from netspark.plans import adapters, oracle as o
from netspark.plans.tables import (
    ALERT,
    BLOCK,
    BRUTE_FORCE,
    DDOS,
    PACKET_DDOS,
    PACKET_GUESS,
    PACKET_SCAN,
    PORT_SCAN,
    SECONDS,
    Tables,
)
from netspark.schemas import FEATURE_COLUMNS
from netspark.session import shared_dir, stage
from netspark.sources import captures, tables as store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(build(Tables(spark, sf_dir)))
        if sql is not None:
            CHECKS[name] = o.with_parts(sql)
        return build

    return register


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits and arrays to text, so results compare as values."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, ty.DoubleType):
            out.append(F.round(F.col(f.name), 6).alias(f.name))
        elif isinstance(f.dataType, ty.ArrayType):
            out.append(F.array_join(f.name, ",").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def r6(*names: str) -> str:
    return ", ".join(f"round({n}::double, 6) {n.split('.')[-1]}" for n in names)


PACKET_COLUMNS = [
    "arrival_seq", "ts_us", "protocol", "src_ip", "dst_ip", "src_port", "dst_port", "size", "header_size", "payload_size", "tcp_flags",
]
NOW_US = 1706832000000000  # 2024-02-02
RETENTION = RetentionParams(bulk_days=14.0, finding_days=21.0, samples_per_label=700)


# ---- sources and sinks ----------------------------------------------------------
query("s1_packet_source", f"select {', '.join(PACKET_COLUMNS)} from packets")(
    lambda t: adapters.packets(t.spark, t.sf_dir)
)


@query("s2_capture_ingest", "select ts_us, protocol, src_ip, dst_ip, src_port, dst_port, size, header_size, size - header_size payload_size, tcp_flags from packets")
def s2(t: Tables) -> DataFrame:
    """Packets written as capture files and decoded again; captures say how many bytes follow the IP header."""
    folder = f"{shared_dir(t.spark)}/captures-{uuid.uuid4().hex}"
    captures.write_captures(t.packets(), folder)
    return captures.decode_captures(t.spark, folder, "part-*").drop("arrival_seq")


@query(
    "s3_evidence_append",
    "select evidence_id, detector, verdict, src_ip, strftime(make_timestamp(ts_us), '%Y-%m-%d') event_day from evidence",
)
def s3(t: Tables) -> DataFrame:
    import uuid

    path = f"{shared_dir(t.spark)}/evidence-by-day-{uuid.uuid4().hex}"
    store.append_evidence(t.evidence(), path)
    return store.read_evidence(t.spark, path).select(
        "evidence_id", "detector", "verdict", "src_ip", F.col("event_date").cast("string").alias("event_day")
    )


LABELLED = (
    "id, \"timestamp\", label, label_source, confidence, round(anomaly_score::double, 6) anomaly_score, verdict, reasoning, "
    "src_ip, dst_ip, src_port, dst_port, protocol, total_packets, round(packets_per_second::double, 6) packets_per_second, "
    "round(syn_ratio::double, 6) syn_ratio, round(zero_payload_ratio::double, 6) zero_payload_ratio, len(keys) n_keys, "
    + o.joined_pairs("pairs") + " all_values"
)


def json_values(text: Column) -> Column:
    """The sorted ``key=value`` pairs of a JSON object; numbers in millionths, from 1000 on in thousandths."""

    def pair(key: Column, value: Column) -> Column:
        number = value.try_cast("double")
        scale = F.when(F.abs(number) < 1000, F.lit(1e6)).otherwise(F.lit(1e3))
        return F.concat(key, F.lit("="), F.coalesce(F.floor(number * scale + F.lit(o.NO_TIE)).cast("string"), value, F.lit("null")))

    return F.array_join(F.array_sort(F.map_values(F.transform_values(F.from_json(text, "map<string,string>"), pair))), ",")


def labelled_view(df: DataFrame) -> DataFrame:
    stored = F.col("all_features")
    return df.withColumns({"n_keys": F.size(F.json_object_keys(stored)), "all_values": json_values(stored)}).drop("all_features")


query("s4_labelled_append", f"select {LABELLED} from labelled")(lambda t: labelled_view(t.labelled()))


@query("s5_labelled_scan", f"select {LABELLED} from labelled where confidence = 'high'")
def s5(t: Tables) -> DataFrame:
    import uuid

    path = f"{shared_dir(t.spark)}/labelled-{uuid.uuid4().hex}"
    store.append_labelled(t.build_labelled(), path)
    return labelled_view(store.read_labelled(t.spark, path, "high"))


query(
    "s6_detections_log",
    "select flow_id, verdict, round(score, 6) score, src_ip, dst_ip from scored where verdict in ('SUSPICIOUS', 'ATTACK')",
)(lambda t: rep.detections_log(t.scored()).select("flow_id", "verdict", "score", "src_ip", "dst_ip"))

query(
    "s7_event_log",
    """select 'evidence_created' event_type, arrival_seq, ts_us, evidence_id, detector, verdict, src_ip, dst_ip, dst_port, reasoning,
  null incident_id, null as key, null highest_verdict, null evidence_count from evidence
union all select case when is_new then 'incident_opened' else 'incident_updated' end, arrival_seq, ts_us, null, null, verdict, null, null, null, null,
  incident_id, key, null, null from bridge where kind = 'evidence'
union all select 'incident_resolved', b.arrival_seq, null, null, null, null, null, null, null, null, b.incident_id, b.key, i.highest_verdict, i.evidence_count
from bridge b join incidents i using (incident_id) where b.kind = 'action' and b.status_after = 'RESOLVED'""",
)(lambda t: rep.event_log(t.evidence(), t.bridge(), t.incidents()))

query(
    "s8_incident_csv",
    f"""select incident_id, case when key = '__aggregate__' then 'aggregate (DDoS)' else key end as source, status, risk_score, risk_tier,
  highest_verdict, detectors_involved, techniques mitre_techniques, evidence_count, {o.utc_text('first_seen_us')} first_seen,
  {o.utc_text('last_seen_us')} last_seen from incidents""",
)(lambda t: rep.incidents_csv(t.incidents()))

query(
    "s9_evidence_csv",
    f"""select incident_id, evidence_id, detector, verdict, {o.utc_text('ts_us')} "timestamp", src_ip, dst_ip, dst_port, reasoning
from bridge where kind = 'evidence'""",
)(lambda t: rep.evidence_csv(t.bridge()))


def _escaped(x: str) -> str:
    return f"replace(replace({x}, chr(92), chr(92) || chr(92)), '=', chr(92) || '=')"


query(
    "s10_cef_evidence",
    f"""select evidence_id, 'CEF:0|netspark|detections|1.0|' || detector || '.' || verdict || '|netspark ' || detector || ' finding: ' || verdict || '|'
  || case verdict when 'SUSPICIOUS' then 5 when 'ATTACK' then 9 else 0 end || '|rt=' || (ts_us // 1000) || coalesce(' src=' || src_ip, '')
  || coalesce(' dst=' || dst_ip, '') || coalesce(' dpt=' || dst_port, '') || coalesce(' msg=' || {_escaped('reasoning')}, '')
  || ' externalId=' || evidence_id || ' cs1Label=detector cs1=' || detector line from evidence""",
)(lambda t: rep.evidence_cef(t.evidence()))

query(
    "s11_cef_incident",
    """select incident_id, 'CEF:0|netspark|detections|1.0|incident.' || status || '|netspark incident (' || risk_tier || '): ' || key || '|'
  || case risk_tier when 'LOW' then 2 when 'MEDIUM' then 5 when 'HIGH' then 8 else 10 end || '|rt=' || (last_seen_us // 1000)
  || case when key = '__aggregate__' then '' else ' src=' || key end || ' msg=' || risk_explanation || ' externalId=' || incident_id
  || ' cn1Label=riskScore cn1=' || risk_score || ' cs1Label=detectorsInvolved cs1=' || detectors_involved
  || ' cs2Label=incidentStatus cs2=' || status || ' cs3Label=mitreTechniques' || case when techniques = '' then '' else ' cs3=' || techniques end line
from incidents""",
)(lambda t: rep.incidents_cef(t.incidents()))

query(
    "s12_block_audit",
    "select seq, ts_us, action, ip, reason, dry_run, backend, expires_us from block_actions",
)(lambda t: t.block_actions())

query(
    "s13_labelled_summary",
    """select 'all' section, 'total' as name, count(*) samples, 100.0::double share from labelled
union all select 'all', 'usable', count(*) filter (where label_source = 'llm'), round(count(*) filter (where label_source = 'llm') / count(*) * 100, 6) from labelled
union all select 'label', label, count(*), null from labelled group by label
union all select 'source', label_source, count(*), null from labelled group by label_source""",
)(lambda t: rep.labelled_summary(t.labelled()))


# ---- projections and predicates -------------------------------------------------
query("p1_flow_key", "select arrival_seq, ip_a, port_a, ip_b, port_b, protocol from keyed")(
    lambda t: fl.with_flow_key(t.packets()).select("arrival_seq", *fl.KEY)
)
query(
    "p2_direction",
    "select arrival_seq, opens, gap_us, case when fwd then 'forward' else 'backward' end direction from directed",
)(lambda t: fl.with_direction(t.sessions()).select("arrival_seq", "opens", "gap_us", "direction"))
query("p3_min_packets", "select flow_id, total_packets from features")(
    lambda t: fl.flows(t.sessions()).filter(F.col("total_packets") >= FlowParams().min_packets).select("flow_id", "total_packets")
)
query("p4_labelling_filter", "select flow_id, verdict from scored where verdict in ('SUSPICIOUS', 'ATTACK')")(
    lambda t: t.scored().filter(ver.flagged(F.col("verdict"))).select("flow_id", "verdict")
)
query("p5_multicast_gate", f"select flow_id, dst_ip, {o.multicast('dst_ip')} multicast from scored_all")(
    lambda t: adapters.scored_flows(t.spark, t.sf_dir).select(
        "flow_id", "dst_ip", ipf.is_multicast_or_broadcast(F.col("dst_ip")).alias("multicast")
    )
)
query(
    "p6_reserved_addresses",
    f"""select flow_id, ip, {o.within('n', ipf.PRIVATE_BLOCKS)} private, {o.within('n', [*ipf.PRIVATE_BLOCKS, ipf.MULTICAST_BLOCK])} reserved
from (select *, {o.ip_number('ip')} n from addresses)""",
)(
    lambda t: adapters.addresses(t.spark, t.sf_dir).select(
        "flow_id", "ip", ipf.is_private(F.col("ip")).alias("private"), ipf.is_local_or_reserved(F.col("ip")).alias("reserved")
    )
)
query("p7_watched_ports", "select flow_id, dst_port from nf where dst_port in (22, 3389, 21, 23, 3306, 5432)")(
    lambda t: t.new_flows().filter(win.watched(F.col("dst_port"), BRUTE_FORCE)).select("flow_id", "dst_port")
)
query(
    "p8_flood_guard",
    "select flow_id, total_packets >= 20 and packets_per_second > 1000 flood from scored_all",
)(lambda t: t.scored().select("flow_id", anomaly.flood_guard().alias("flood")))
query("p9_review_candidates", "select flow_id, verdict, round(score, 6) score from candidates")(
    lambda t: ver.candidates(t.scored()).select("flow_id", "verdict", "score")
)

_ELIGIBLE = BlockParams(own_addresses=("8.8.0.0", "8.8.12.12"), whitelist=("10.1.1.1", "8.8.24.24"))
query(
    "p10_block_eligibility",
    f"""select flow_id, ip, case when {o.within('n', [ipf.LOOPBACK_BLOCK])} then 'loopback is not blocked'
  when ip in ('8.8.0.0', '8.8.12.12') then 'one of our own addresses'
  when ip in ('10.1.1.1', '8.8.24.24') then 'on the list of allowed addresses'
  when n is null then 'not an address: ' || ip
  when {o.within('n', ipf.PRIVATE_BLOCKS)} then 'private addresses are left alone' end skip_reason
from (select *, {o.ip_number('ip')} n from addresses)""",
)(
    lambda t: adapters.addresses(t.spark, t.sf_dir).select(
        "flow_id", "ip", res.block_skip_reason(F.col("ip"), _ELIGIBLE).alias("skip_reason")
    )
)
query(
    "p11_current_schema",
    f"select id, schema_keys = {o.quoted(','.join(sorted(FEATURE_COLUMNS)))} is_current from reviewed",
)(
    lambda t: t.reviewed().select("id", fe.is_current_schema(F.col("all_features")).alias("is_current"))
)
query(
    "p12_stale_marker",
    "select id, not list_has_all(keys, ['ack_ratio', 'fwd_packet_share', 'iat_cv']) stale from labelled",
)(lambda t: t.labelled().select("id", fe.is_stale(F.col("all_features")).alias("stale")))
query(
    "p13_verdict_sets",
    """select verdict, verdict in ('SUSPICIOUS', 'ATTACK') opens, verdict in ('NORMAL', 'WARMING_UP') never_counts, count(*) n
from evidence group by all""",
)(
    lambda t: t.evidence()
    .groupBy("verdict", inc.opens_incident(F.col("verdict")).alias("opens"), inc.never_counts(F.col("verdict")).alias("never_counts"))
    .agg(F.count(F.lit(1)).alias("n"))
)

# ---- flows ----------------------------------------------------------------------
FLOW_SQL = """
select min(arrival_seq) flow_id, case when bool_or(closes) then max(arrival_seq) else 576460752303423488 + min(arrival_seq) end finish_seq,
  arg_min(src_ip, arrival_seq) src_ip, arg_min(dst_ip, arrival_seq) dst_ip, arg_min(src_port, arrival_seq) src_port,
  arg_min(dst_port, arrival_seq) dst_port, protocol, arg_min(ts_us, arrival_seq) start_us, arg_max(ts_us, arrival_seq) last_us,
  bool_or(closes) finished_cleanly, count(*) total_packets
from {} group by ip_a, port_a, ip_b, port_b, protocol, session_no"""
query("f1_flows", FLOW_SQL.format("sessions"))(lambda t: fl.flows(t.sessions()))
query("f2_idle_timeout", FLOW_SQL.format("idle_sessions"))(
    lambda t: fl.flows(fl.with_flow_id(t.packets(), FlowParams(idle_timeout_seconds=0.4)))
)
query(
    "f3_clean_close",
    f"select finished_cleanly, count(*) flows, sum(total_packets)::bigint packets from ({FLOW_SQL.format('sessions')}) group by 1",
)(
    lambda t: fl.flows(t.sessions()).groupBy("finished_cleanly").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("total_packets").alias("packets")
    )
)
query("f4_new_flow_events", "select arrival_seq flow_id, ts_us, src_ip, dst_ip, dst_port from sessions where opens")(
    lambda t: fl.new_flow_events(t.sessions())
)
query(
    "f5_finish_order",
    "select flow_id, row_number() over (order by not finished_cleanly, case when finished_cleanly then last_seq else flow_id end) place from features",
)(
    # The place is a running count over the finish order, in chunks.
    lambda t: win.scan(
        t.features().select("flow_id", "finish_seq", F.lit(1).alias("one")), [], "finish_seq",
        {"place": win.Running("sum", "one")}, (1 << 36,),
    ).select("flow_id", "place")
)


@query("f6_streaming_flows", FLOW_SQL.format("idle_sessions"))
def f6(t: Tables) -> DataFrame:
    from netspark.streaming.flows import stream_flows_once

    return stream_flows_once(stage(t.packets(), "packets"), FlowParams(idle_timeout_seconds=0.4)).select(
        "flow_id", "finish_seq", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "start_us", "last_us",
        "finished_cleanly", "total_packets",
    )


# ---- features -------------------------------------------------------------------
def feature_query(name: str, columns: list[str]) -> None:
    doubles = {"duration_seconds", "bytes_per_second", "packets_per_second", "bwd_fwd_packet_ratio", "fwd_packet_share",
               "syn_ratio", "ack_ratio", "avg_payload_size", "zero_payload_ratio"}
    shown = [r6(c) if c in doubles or c.startswith("iat_") or "_len_" in c else c for c in columns]
    query(name, f"select flow_id, {', '.join(shown)} from features")(lambda t: t.features().select("flow_id", *columns))


_LEN = [f"{d}_{m}_{s}" for m in ("pkt_len", "header_len") for d in ("fwd", "bwd") for s in ("mean", "max", "min", "std")]
feature_query("x1_duration", ["duration_seconds"])
feature_query("x2_counts", ["total_packets", "total_bytes", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes"])
feature_query("x3_rates", ["bytes_per_second", "packets_per_second"])
feature_query("x4_shares", ["bwd_fwd_packet_ratio", "fwd_packet_share"])
feature_query("x5_packet_lengths", [c for c in _LEN if "pkt" in c])
feature_query("x6_header_lengths", [c for c in _LEN if "header" in c])
feature_query("x7_gaps", ["iat_mean", "iat_max", "iat_min", "iat_std"])
feature_query("x8_gap_variation", ["iat_cv"])
feature_query("x9_flag_counts", ["syn_count", "ack_count", "fin_count", "rst_count", "psh_count", "urg_count"])
feature_query("x10_flag_ratios", ["syn_ratio", "ack_ratio"])
feature_query("x11_payload", ["avg_payload_size", "zero_payload_ratio"])
feature_query("x12_well_known_port", ["is_well_known_dst_port"])


@query(
    "x13_schema_version",
    "select schema_keys, substr(sha256(schema_keys), 1, 12) schema_version, count(*) samples from reviewed group by all",
)
def x13(t: Tables) -> DataFrame:
    reviewed = t.reviewed().withColumn("k", fe.feature_keys(F.col("all_features")))
    return reviewed.groupBy(F.array_join("k", ",").alias("schema_keys"), fe.schema_version(F.col("k")).alias("schema_version")).agg(
        F.count(F.lit(1)).alias("samples")
    )


@query("x0_flow_features", f"""select flow_id, finish_seq, src_ip, dst_ip, src_port, dst_port, start_us, last_us, finished_cleanly, protocol,
{', '.join(c if c.endswith(('_packets', '_count', '_bytes', 'port')) else r6(c) for c in FEATURE_COLUMNS if c != 'protocol')} from features""")
def x0(t: Tables) -> DataFrame:
    return fe.flow_features(t.sessions())


# ---- windows --------------------------------------------------------------------
query("w1_ddos_counts", "select flow_id, total_flows, distinct_sources from ddos")(
    lambda t: win.ddos_windows(t.new_flows(), None, DDOS).select("flow_id", "total_flows", "distinct_sources")
)
query("w2_ddos_verdicts", "select flow_id, ts_us, verdict from ddos")(lambda t: t.ddos().select("flow_id", "ts_us", "verdict"))
query("w3_port_scan_ports", "select flow_id, src_ip, distinct_ports from port_scan")(
    lambda t: win.port_scan_windows(t.new_flows(), None, PORT_SCAN, detail=False).select("flow_id", "src_ip", "distinct_ports")
)
query("w4_port_scan_targets", "select flow_id, src_ip, distinct_ports, distinct_targets from port_scan")(
    lambda t: win.port_scan_windows(t.new_flows(), None, PORT_SCAN).select("flow_id", "src_ip", "distinct_ports", "distinct_targets")
)
query(
    "w4_flagged",
    f"""select flow_id, distinct_ports, verdict, {r6('confidence_pct')}, case when verdict <> 'NORMAL' then distinct_targets end distinct_targets,
  case when verdict <> 'NORMAL' then scan_start_us end scan_start_us, case when verdict <> 'NORMAL' then scan_end_us end scan_end_us,
  case when verdict <> 'NORMAL' then round(ports_per_second::double, 6) end ports_per_second from port_scan""",
)(
    lambda t: win.port_scan_windows(t.new_flows(), None, PORT_SCAN, detail="flagged").select(
        "flow_id", "distinct_ports", "verdict", "confidence_pct", "distinct_targets", "scan_start_us", "scan_end_us", "ports_per_second"
    )
)
query(
    "w5_scan_span",
    f"select flow_id, scan_start_us, scan_end_us, {r6('duration_seconds', 'ports_per_second')} from port_scan",
)(lambda t: t.port_scan().select("flow_id", "scan_start_us", "scan_end_us", "duration_seconds", "ports_per_second"))
query("w6_port_scan_verdicts", f"select flow_id, verdict, {r6('confidence_pct')} from port_scan")(
    lambda t: t.port_scan().select("flow_id", "verdict", "confidence_pct")
)
query("w7_brute_force_attempts", "select flow_id, src_ip, dst_ip, dst_port, attempts from brute_force")(
    lambda t: win.brute_force_windows(t.new_flows(), BRUTE_FORCE).select("flow_id", "src_ip", "dst_ip", "dst_port", "attempts")
)
query("w8_brute_force_verdicts", "select flow_id, verdict from brute_force")(lambda t: t.brute_force().select("flow_id", "verdict"))
query("w9_repeat_offenders", "select flow_id, attempts, repeat_offender_count from brute_force")(
    lambda t: t.brute_force().select("flow_id", "attempts", "repeat_offender_count")
)


@query(
    "w10_verdict_transitions",
    """select 'ddos' detector, flow_id, verdict from ddos_changes union all select 'port_scan', flow_id, verdict from port_scan_changes
union all select 'brute_force', flow_id, verdict from brute_force_changes""",
)
def w10(t: Tables) -> DataFrame:
    return ev.evidence(
        *[df.select(F.lit(name).alias("detector"), "flow_id", "verdict") for name, df in t.transitions().items()]
    )


_BUFFER = EvidenceParams(buffer_seconds=2 * 86_400.0)
query(
    "w11_evidence_buffer",
    "select evidence_id, arrival_seq, detector, verdict from evidence where ts_us >= (select max(ts_us) from evidence) - 172800000000",
)(lambda t: win.evidence_buffer(t.evidence(), _BUFFER).select("evidence_id", "arrival_seq", "detector", "verdict"))
query(
    "w12_running_summary",
    """select * from (select count(*) over w flows_seen, count(*) filter (where verdict = 'NORMAL') over w normal,
  count(*) filter (where verdict = 'SUSPICIOUS') over w suspicious, count(*) filter (where verdict = 'ATTACK') over w attack,
  count(*) filter (where verdict = 'WARMING_UP') over w warming_up from scored window w as (order by finish_seq)) where flows_seen % 50 = 0""",
)(lambda t: win.running_summary(t.scored(), "finish_seq"))

# Check-time evaluation over packets: new flows recorded at their start, checked at each flow's last packet.
_PD, _PP = PACKET_DDOS, PACKET_SCAN
o.FRAGMENTS["started"] = "select arrival_seq flow_id, ts_us, src_ip, dst_ip, dst_port from sessions where opens"
o.FRAGMENTS["checks"] = "select flow_id, finish_seq, last_us ts_us, src_ip from features"


def packet_checks(t: Tables) -> DataFrame:
    return t.features().select("flow_id", "finish_seq", F.col("last_us").alias("ts_us"), "src_ip")


query(
    "w1_ddos_at_check",
    f"select flow_id, total_flows, distinct_sources, verdict from ({o.ddos_sql('started', 'checks', _PD)})",
)(
    lambda t: win.ddos_windows(t.started(), packet_checks(t), _PD).select(
        "flow_id", "total_flows", "distinct_sources", "verdict"
    )
)
query(
    "w4_port_scan_at_check",
    f"""select flow_id, distinct_ports, distinct_targets, scan_start_us, scan_end_us, {r6('duration_seconds')}, verdict
from ({o.port_scan_sql('started', 'checks', _PP.window_us, 4, 6)})""",
)(
    lambda t: win.port_scan_windows(t.started(), packet_checks(t), _PP).select(
        "flow_id", "distinct_ports", "distinct_targets", "scan_start_us", "scan_end_us", "duration_seconds", "verdict"
    )
)

# ---- anomaly --------------------------------------------------------------------
query(
    "n1_warmup_split",
    """select flow_id, row_number() over (order by finish_seq) <= 30 in_baseline, row_number() over (order by finish_seq) >= 30 is_scored from features""",
)(
    lambda t: t.features().select(
        "flow_id",
        (F.col("finish_seq") <= anomaly.warmup_end(t.features(), anomaly.AnomalyParams())).alias("in_baseline"),
        (F.col("finish_seq") >= anomaly.warmup_end(t.features(), anomaly.AnomalyParams())).alias("is_scored"),
    )
)
_LONG = " union all ".join(
    f"select '{c}' feature, avg({c}::double) mean, stddev_pop({c}::double) std from warm" for c in FEATURE_COLUMNS
)
o.FRAGMENTS["warm"] = "select * from features order by finish_seq limit 30"
o.FRAGMENTS["warm_statistics"] = f"select *, case when std > 1e-12 * abs(mean) then 1.0::double else 0.0::double end scaled_variance from ({_LONG})"
query("n2_standardise", f"select feature, {r6('mean', 'std', 'scaled_variance')} from warm_statistics")(
    lambda t: anomaly.baseline_statistics(anomaly.baseline_flows(t.features()))
)
query(
    "n3_column_filter",
    f"select feature, {r6('mean', 'std', 'scaled_variance')} from warm_statistics where scaled_variance > 1e-9",
)(lambda t: anomaly.kept_columns(anomaly.baseline_statistics(anomaly.baseline_flows(t.features()))))


o.FRAGMENTS |= o.forest(AnomalyParams())
_FOREST_SCORES = f"select flow_id, {r6('score')}, {o.anomaly_verdict('score')} verdict from forest_scores"


@query("n4_forest_nodes", f"select tree_id, node_id, feature, {r6('threshold', 'path')} from forest_nodes")
def n4(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(anomaly.fit_baseline(t.features()).nodes, anomaly.NODES)


@query("n5_forest_scores", _FOREST_SCORES)
def n5(t: Tables) -> DataFrame:
    model = anomaly.fit_baseline(t.features())
    return anomaly.score(t.features(), model).select("flow_id", "score", "verdict")


query("n6_anomaly_verdicts", "select flow_id, round(score, 6) score, verdict from scored")(
    lambda t: t.scored().select("flow_id", "score", "verdict")
)


@query("n7_saved_model_scores", _FOREST_SCORES)
def n7(t: Tables) -> DataFrame:
    import uuid

    path = f"{shared_dir(t.spark)}/model-{uuid.uuid4().hex}"
    anomaly.fit_baseline(t.features()).save(t.spark, path)
    return anomaly.score(t.features(), anomaly.BaselineModel.load(t.spark, path)).select("flow_id", "score", "verdict")


# ---- reviewer verdicts ----------------------------------------------------------
def _f(x: str, d: int) -> str:
    return f"printf('%.{d}f', {x}::double)"


query(
    "l1_prompts",
    f"""select flow_id, concat_ws(chr(10), 'Protocol: ' || case protocol when 6 then 'TCP' when 17 then 'UDP' else 'ICMP' end,
  'Source: ' || src_ip || ':' || src_port, 'Destination: ' || dst_ip || ':' || dst_port, 'Duration: ' || {_f('duration_seconds', 3)} || ' seconds',
  'Total packets: ' || total_packets || ' (' || fwd_packets || ' forward, ' || bwd_packets || ' backward)',
  'Packet rate: ' || {_f('packets_per_second', 1)} || ' packets/second', 'Byte rate: ' || {_f('bytes_per_second', 1)} || ' bytes/second',
  'Forward packet share: ' || {_f('fwd_packet_share', 2)} || ' (' || fwd_packets || ' forward / ' || bwd_packets || ' backward)',
  case when protocol = 6 then 'TCP flags seen: SYN=' || syn_count || ', ACK=' || ack_count || ', FIN=' || fin_count || ', RST=' || rst_count end,
  case when protocol = 6 then 'SYN ratio (SYN packets / total): ' || {_f('syn_ratio', 2)} end,
  case when protocol = 6 then 'ACK ratio (ACK packets / total): ' || {_f('ack_ratio', 2)} end,
  'Zero-payload packet ratio: ' || {_f('zero_payload_ratio', 2)},
  'Inter-arrival time: mean=' || {_f('iat_mean', 4)} || 's, std=' || {_f('iat_std', 4)} || 's, cv=' || {_f('iat_cv', 2)},
  'Statistical verdict: ' || verdict || ', raw score=' || {_f('score', 4)}, {o.quoted(ver.GUIDANCE)}) prompt
from scored_features where verdict = 'SUSPICIOUS' and score < -0.03""",
)(
    lambda t: ver.prompts(
        fe.timing_in_arrival_order(ver.candidates(t.scored_features()), t.packets(), {"iat_mean": 4, "iat_std": 4, "iat_cv": 2})
    )
)
_BUDGET = VerdictParams(calls_per_minute=2)
query(
    "l2_budget",
    """select flow_id, row_number() over (partition by last_us // 60000000 order by finish_seq) <= 2 admitted
from scored_features where verdict = 'SUSPICIOUS' and score < -0.03""",
)(lambda t: ver.admit(ver.candidates(t.scored_features()), "finish_seq", _BUDGET).select("flow_id", "admitted"))
# Events are minutes apart, so the trailing window is hours long; no queue, as SQL has the plain admission.
_TRAILING = VerdictParams(calls_per_minute=3, budget_seconds=6 * 3600.0, queue_length=0, chunk_seconds=86_400.0)
query(
    "l2_trailing_budget",
    f"""select * from (with recursive c as (
  select flow_id, last_us t, row_number() over (order by last_us, finish_seq) i from scored_features where verdict = 'SUSPICIOUS' and score < -0.03),
calls as (
  select i, flow_id, t, [t] held from c where i = 1
  union all
  select n.i, n.flow_id, n.t, list_append(if(len(held) < {_TRAILING.calls_per_minute}, held, held[2:]), n.t)
  from calls p, lateral (
    select min(c.i) i, arg_min(c.flow_id, c.i) flow_id, arg_min(c.t, c.i) t from c
    where c.i > p.i and (len(p.held) < {_TRAILING.calls_per_minute} or c.t > p.held[1] + {_TRAILING.budget_us})) n where n.i is not null)
select c.flow_id, case when a.i is null then 'dropped' else 'called' end outcome, a.t called_us from c left join calls a using (i))""",
)(
    lambda t: bud.schedule(
        ver.candidates(t.scored_features()).withColumn("ts_us", F.col("last_us")), "finish_seq", _TRAILING
    ).select("flow_id", "outcome", "called_us")
)
query("l3_parsed_responses", "select flow_id, available, attack_type, confidence, review_reasoning, error from parsed")(
    lambda t: ver.parse_verdicts(t.responses())
)
query(
    "l4_review_evidence",
    "select arrival_seq, verdict, reasoning, src_ip, dst_ip, dst_port, attack_type from evidence where detector = 'llm'",
)(
    lambda t: ev.from_reviews(t.reviews()).select(
        "arrival_seq", "verdict", "reasoning", "src_ip", "dst_ip", "dst_port", "attack_type"
    )
)
query("l5_labels", "select flow_id, label, label_source, confidence, reasoning from feature_labels")(
    lambda t: ver.label(t.scored_features(), ver.parse_verdicts(t.feature_responses())).select(
        "flow_id", "label", "label_source", "confidence", "reasoning"
    )
)
query("l6_promotion", "select flow_id, verdict, stored_verdict, label from labels")(
    lambda t: ver.label(t.scored(), ver.parse_verdicts(t.responses())).select("flow_id", "verdict", "stored_verdict", "label")
)


@query(
    "l7_tracker_labels",
    f"""select label, label_source, confidence, reasoning, src_ip, dst_ip, dst_port, len(keys) n_keys, {o.joined_pairs('pairs')} all_values
from labelled where label_source like '%_tracker'""",
)
def l7(t: Tables) -> DataFrame:
    moved = t.transitions()
    rows = ver.tracker_labels(moved["ddos"], moved["port_scan"], moved["brute_force"], SECONDS)
    return rows.select(
        "label", "label_source", "confidence", "reasoning", "src_ip", "dst_ip", "dst_port",
        F.size(F.json_object_keys("all_features")).alias("n_keys"), json_values(F.col("all_features")).alias("all_values"),
    )


# ---- evidence and incidents -----------------------------------------------------
query(
    "e1_evidence",
    "select arrival_seq, detector, ts_us, verdict, reasoning, src_ip, dst_ip, dst_port, attack_type from evidence",
)(lambda t: t.build_evidence().drop("evidence_id", "payload"))
query(
    "e2_payloads",
    """select finish_seq * 8 + 2 arrival_seq, 'ddos' detector, verdict, '21600.0' window_seconds, total_flows::varchar first_count, distinct_sources::varchar second_count from ddos
union all select finish_seq * 8 + 3, 'port_scan', verdict, '86400.0', distinct_ports::varchar, distinct_targets::varchar from port_scan
union all select finish_seq * 8 + 4, 'brute_force', verdict, '259200.0', attempts::varchar, repeat_offender_count::varchar from brute_force""",
)(
    lambda t: t.evidence().filter("detector not in ('anomaly', 'llm')").selectExpr(
        "arrival_seq", "detector", "get_json_object(payload, '$.verdict') verdict", "get_json_object(payload, '$.window_seconds') window_seconds",
        "coalesce(get_json_object(payload, '$.total_flows_in_window'), get_json_object(payload, '$.distinct_ports_in_window'), get_json_object(payload, '$.attempts_in_window')) first_count",
        "coalesce(get_json_object(payload, '$.distinct_sources_in_window'), get_json_object(payload, '$.distinct_targets_in_window'), get_json_object(payload, '$.repeat_offender_count')) second_count",
    )
)
query("e2_flow_payloads", "select arrival_seq, detector, stated, features from flow_payloads")(
    lambda t: t.flow_evidence().select(
        "arrival_seq", "detector", json_values(F.expr("to_json(map_filter(from_json(payload, 'map<string,string>'), (k, v) -> k <> 'features'))")).alias("stated"),
        json_values(F.get_json_object("payload", "$.features")).alias("features"),
    )
)
query("e3_evidence_ids", "select arrival_seq, evidence_id from evidence")(lambda t: t.evidence().select("arrival_seq", "evidence_id"))
query(
    "i1_correlation",
    "select arrival_seq, key, kind, incident_no, incident_id, is_new, status_after, evidence_id from bridge",
)(
    lambda t: inc.correlate(t.evidence(), t.actions()).select(
        "arrival_seq", "key", "kind", "incident_no", "incident_id", "is_new", "status_after", "evidence_id"
    )
)
query(
    "i2_incidents",
    """select incident_id, key, incident_no, status, first_seen_us, last_seen_us, detectors_involved, evidence_count, highest_verdict from incidents""",
)(
    lambda t: inc.incidents(t.bridge()).select(
        "incident_id", "key", "incident_no", "status", "first_seen_us", "last_seen_us", "detectors_involved", "evidence_count", "highest_verdict"
    )
)
query(
    "i3_actions",
    "select arrival_seq, key, incident_id, status_after from bridge where kind = 'action'",
)(lambda t: t.bridge().filter("kind = 'action'").select("arrival_seq", "key", "incident_id", "status_after"))
query("i4_open_incidents", "select incident_id, key, incident_no from latest where status = 'OPEN'")(
    lambda t: inc.open_incidents(inc.latest_only(t.incidents())).select("incident_id", "key", "incident_no")
)
query(
    "i5_timeline",
    "select incident_id, arrival_seq, ts_us, detector, verdict, reasoning, src_ip, dst_ip, dst_port from bridge where kind = 'evidence'",
)(lambda t: inc.timeline(t.bridge()).drop("key", "evidence_id"))
TIMELINE_LINES = f"""
select incident_id, -1::bigint line_order, 'Incident ' || incident_id || ' (' || key || ') — status=' || status || ', highest_verdict=' || highest_verdict line from incidents
union all
select incident_id, arrival_seq, '  [' || {o.utc_text('ts_us')} || '] ' || rpad(detector, 12, ' ') || ' ' || rpad(verdict, greatest(10, length(verdict))::int, ' ') || ' '
  || coalesce(src_ip, '?') || ' -> ' || coalesce(dst_ip, '?') || ':' || coalesce(dst_port::varchar, '?') || '  (' || reasoning || ')'
from bridge where kind = 'evidence'"""
query("i6_timeline_text", TIMELINE_LINES)(lambda t: inc.timeline_text(t.bridge(), t.incidents()))
query("i7_risk_scores", "select incident_id, risk_score, contributing_detectors from incidents")(
    lambda t: inc.incidents(t.bridge()).select(
        "incident_id", "risk_score", F.array_join("contributing_detectors", ", ").alias("contributing_detectors")
    )
)
query("i8_risk_tiers", "select incident_id, risk_tier, risk_explanation from incidents")(
    lambda t: t.incidents().select("incident_id", "risk_tier", "risk_explanation")
)
query(
    "i9_technique_tags",
    f"select evidence_id, {o.TECHNIQUE} technique_id from evidence",
)(lambda t: tech.tag_techniques(t.evidence()).select("evidence_id", "technique_id"))
query("i10_incident_techniques", "select incident_id, technique_id, first_seq from first_techniques")(
    lambda t: inc.incident_techniques(t.bridge()).drop("key")
)

# ---- reports --------------------------------------------------------------------
BLOCKED_AT = 1706140800000000  # 2024-01-25
BLOCKED = f"""(select ip, round((expires_us - {BLOCKED_AT}) / 1e6, 1) seconds_remaining from (
  select ip, arg_max(action, seq) last_action, arg_max(coalesce(expires_us, 0), seq) expires_us from block_actions where ts_us <= {BLOCKED_AT} group by ip)
  where last_action = 'block' and expires_us > {BLOCKED_AT})"""
query(
    "q1_summary",
    f"""select 'open_incidents' item, count(*) as value from latest where status = 'OPEN'
union all select 'tier_' || tier, (select count(*) from latest where status = 'OPEN' and risk_tier = tier) from (select unnest(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) tier)
union all select 'blocked_ips', count(*) from {BLOCKED}""",
)(lambda t: rep.summary(t.incidents(), res.blocked_as_of(t.block_actions(), BLOCKED_AT)))
INCIDENT_COLUMNS = (
    "incident_id, key, incident_no, status, first_seen_us, last_seen_us, detectors_involved, evidence_count, highest_verdict, "
    "risk_score, risk_tier, contributing_detectors, risk_explanation, techniques"
)
_INCIDENT_SQL = INCIDENT_COLUMNS.replace("contributing_detectors", "replace(contributing_detectors, ', ', ',') contributing_detectors")
query("q2_incident_list", f"select {_INCIDENT_SQL} from latest where status = 'OPEN'")(lambda t: rep.incident_list(t.incidents()))
query("q2_incident_history", f"select {_INCIDENT_SQL} from latest")(lambda t: rep.incident_list(t.incidents(), include_resolved=True))
query(
    "q3_incident_detail",
    """select b.incident_id, b.key, b.arrival_seq, b.ts_us, b.detector, b.verdict, b.reasoning, l.status, l.risk_score, l.risk_tier
from bridge b join latest l using (incident_id) where b.key = '10.0.0.10' and b.kind = 'evidence'""",
)(
    lambda t: rep.incident_detail(t.bridge(), t.incidents(), "10.0.0.10").select(
        "incident_id", "key", "arrival_seq", "ts_us", "detector", "verdict", "reasoning", "status", "risk_score", "risk_tier"
    )
)
query(
    "q4_resolve_all_open",
    """select arrival_seq, key, incident_id, status_after from bridge where kind = 'action'
union all select (select max(arrival_seq) from evidence) + 1, key, incident_id, 'RESOLVED' from latest""",
)(
    # Every key is resolved at the end of the stream, on top of the earlier actions.
    lambda t: inc.correlate(
        t.evidence(),
        t.actions().unionByName(
            t.incidents().select("key").distinct().select(
                (F.lit(1) + t.evidence().agg(F.max("arrival_seq")).scalar()).alias("arrival_seq"), "key", F.lit("resolve").alias("action")
            )
        ),
    ).filter("kind = 'action'").select("arrival_seq", "key", "incident_id", "status_after")
)
query("q5_by_risk", "select key, incident_no, risk_score, risk_tier, status from incidents order by risk_score desc, key, incident_no limit 20")(
    lambda t: rep.by_risk(t.incidents(), 20).select("key", "incident_no", "risk_score", "risk_tier", "status")
)
query(
    "q6_fleet_summary",
    f"""select 0 section, null risk_score, null as key, null incident_no, concat_ws(chr(10), '# Incident summary', '',
  '**' || count(*) || ' total incidents, ' || count(*) filter (where status = 'OPEN') || ' currently open.**', '',
  '| Source | Status | Risk | Detectors | Last seen |', '|---|---|---|---|---|') line from incidents
union all select 1, risk_score, key, incident_no, '| ' || case when key = '__aggregate__' then 'Aggregate (DDoS)' else key end || ' | ' || status || ' | '
  || risk_score || ' (' || risk_tier || ') | ' || replace(detectors_involved, ',', ', ') || ' | ' || {o.utc_text('last_seen_us')} || ' |' from incidents""",
)(lambda t: rep.fleet_summary(t.incidents()))
_FACTS = " union all ".join(f"select '{i}' technique_id, '- **{i}** — {n} ({x})' fact" for i, n, x in tech.TECHNIQUES)
query(
    "q7_case_files",
    f"""select i.incident_id, 0 section, 0::bigint line_order, concat_ws(chr(10), '# Incident report — ' || i.incident_id, '',
  '- **Source:** ' || case when i.key = '__aggregate__' then 'Aggregate (cross-source DDoS)' else i.key end, '- **Status:** ' || status,
  '- **Risk:** ' || risk_score || '/100 (' || risk_tier || ')', '- **Highest verdict recorded:** ' || highest_verdict,
  '- **Detectors involved:** ' || replace(detectors_involved, ',', ', '), '- **First seen:** ' || {o.utc_text('first_seen_us')},
  '- **Last seen:** ' || {o.utc_text('last_seen_us')}, chr(10) || '## MITRE ATT&CK techniques' || chr(10),
  coalesce(f.facts, '- No technique could be confidently attributed (see risk explanation below).'),
  chr(10) || '## Risk explanation' || chr(10), risk_explanation, chr(10) || '## Timeline' || chr(10) || chr(10) || repeat(chr(96), 3)) line
from incidents i left join (select incident_id, string_agg(fact, chr(10) order by first_seq) facts from first_techniques join ({_FACTS}) using (technique_id) group by 1) f using (incident_id)
union all select incident_id, 1, line_order, line from ({TIMELINE_LINES})
union all select incident_id, 2, 0, repeat(chr(96), 3) from incidents""",
)(lambda t: rep.case_files(t.bridge(), t.incidents()))
query(
    "q8_verdict_counts",
    "select v verdict, (select count(*) from scored where verdict = v) flows from (select unnest(['WARMING_UP', 'NORMAL', 'SUSPICIOUS', 'ATTACK']) v)",
)(lambda t: rep.verdict_counts(t.scored()))
query(
    "q8_attack_outcomes",
    """select seq, attack_type, src_ip, outcome, reasoning, '  [' || strftime(make_timestamp(ts_us), '%H:%M:%S') || '] ' || rpad(attack_type, greatest(12, length(attack_type))::int, ' ')
  || ' src=' || rpad(src_ip, 17, ' ') || ' ' || outcome line
from (select *, case when applied then 'BLOCKED' else 'NOT BLOCKED (' || skip_reason || ')' end outcome from decisions)""",
)(lambda t: rep.attack_outcomes(res.block_decisions(t.attack_events(), BLOCK)))
query("q8_still_blocked", f"select * from {BLOCKED}")(
    lambda t: rep.still_blocked(res.blocked_as_of(t.block_actions(), BLOCKED_AT))
)
o.FRAGMENTS["sensed"] = "select *, 'sensor-' || (arrival_seq // 8 % 3) sensor_id from evidence"
o.FRAGMENTS["sensed_bridge"] = o.correlate_sql("sensed", None, ", sensor_id")


def sensed(t: Tables) -> DataFrame:
    return t.evidence().withColumn("sensor_id", F.expr("concat('sensor-', arrival_seq div 8 % 3)"))


query(
    "q9_sensor_incidents",
    """select sensor_id, incident_id, key, incident_no, count(*) evidence_count from sensed_bridge group by all""",
)(
    lambda t: inc.incidents(inc.correlate(sensed(t), keys=["sensor_id"]), keys=["sensor_id"]).select(
        "sensor_id", "incident_id", "key", "incident_no", "evidence_count"
    )
)
query(
    "q9_sensor_list",
    """select sensor_id, key, max(incident_no) incident_no from sensed_bridge group by all""",
)(
    # One incident table per sensor, merged, as the tables of separate engines are.
    lambda t: rep.incident_list(
        inc.merge_sensors(
            {s: inc.incidents(inc.correlate(sensed(t).filter(F.col("sensor_id") == s).drop("sensor_id"))) for s in ("sensor-0", "sensor-1", "sensor-2")}
        ),
        include_resolved=True,
    ).select("sensor_id", "key", "incident_no")
)
query(
    "q9_central_incidents",
    "select key, incident_no, count(*) evidence_count, count(distinct sensor_id) sensors from (" + o.correlate_sql("sensed", None) + ") group by all",
)(
    lambda t: inc.correlate(sensed(t)).groupBy("key", "incident_no").agg(
        F.count(F.lit(1)).alias("evidence_count"), F.count_distinct("sensor_id").alias("sensors")
    )
)

# ---- response -------------------------------------------------------------------
query("r1_attack_events", "select seq, ts_us, src_ip, attack_type, reasoning, repeat_offender_count from attack_events")(
    lambda t: res.attack_events(flows=t.scored(), windows=SECONDS, **t.transitions())
)
query(
    "r2_block_durations",
    "select seq, src_ip, repeat_offender_count, round(duration_minutes, 6) duration_minutes, skip_reason, applied, expires_us from decisions",
)(
    lambda t: res.block_decisions(t.attack_events(), BLOCK).select(
        "seq", "src_ip", "repeat_offender_count", "duration_minutes", "skip_reason", "applied", "expires_us"
    )
)
query(
    "r3_alert_rate_limit",
    f"""select seq, src_ip, e.ts_us, c.ts is not null and seq = (select min(seq) from attack_events f where f.src_ip = e.src_ip and f.ts_us = e.ts_us) sent
from attack_events e left join (
  with recursive chain(src, ts) as (
    select src_ip, min(ts_us) from attack_events group by 1
    union all
    select c.src, min(e.ts_us) from chain c join attack_events e on e.src_ip = c.src and e.ts_us >= c.ts + {ALERT.rate_limit_us} group by c.src, c.ts)
  select distinct src, ts from chain) c on c.src = e.src_ip and c.ts = e.ts_us""",
)(lambda t: res.rate_limited_alerts(t.attack_events(), ALERT).select("seq", "src_ip", "ts_us", "sent"))
query(
    "r4_block_intervals",
    """select seq, ip, valid_from_us, valid_to_us from (select *, ts_us valid_from_us,
  least(expires_us, lead(ts_us) over (partition by ip order by seq)) valid_to_us from block_actions) where action = 'block'""",
)(lambda t: res.block_intervals(t.block_actions()))
query("r5_blocked_as_of", f"select * from {BLOCKED}")(lambda t: res.blocked_as_of(t.block_actions(), BLOCKED_AT))
query(
    "r6_alert_messages",
    """select seq, '[netspark] ATTACK: ' || attack_type || ' from ' || src_ip subject, concat_ws(chr(10), 'netspark detected a confirmed attack.', '',
  'Attack type : ' || attack_type, 'Source IP   : ' || src_ip, 'Location    : location unknown', chr(10) || 'Reasoning: ' || reasoning) body from attack_events""",
)(lambda t: res.alert_messages(t.attack_events()))
_ASN = "try_cast(regexp_extract(as_text, '^AS([0-9]+)(\\s|$)', 1) as bigint)"
query(
    "r7_geo_enrichment",
    f"""select flow_id, ip, private is_private, start_ip is not null resolved, country, country_code, city, {r6('latitude', 'longitude')}, {_ASN} asn, org,
  case when private then 'local network' when start_ip is null then 'location unknown'
    else concat_ws(', ', city, country) || case when org is null then '' else ' (' || org || ')' end end as location
from (select *, {o.within('n', [*ipf.PRIVATE_BLOCKS, ipf.MULTICAST_BLOCK])} private from (select *, {o.ip_number('ip')} n from addresses)) a
left join geo_ranges g on not private and n between start_ip and end_ip""",
)(
    lambda t: geo.geo_enrich(adapters.addresses(t.spark, t.sf_dir), "ip", adapters.geo_ranges(t.spark, t.sf_dir)).drop("ts_us")
)
query("r8_asn_parse", f"select start_ip, as_text, {_ASN} asn from geo_ranges")(
    lambda t: adapters.geo_ranges(t.spark, t.sf_dir).select("start_ip", "as_text", geo.parse_asn(F.col("as_text")).alias("asn"))
)

# ---- training, models, retention, metrics ---------------------------------------
query("a1_training_set", "select id, label from usable")(lambda t: tr.training_set(t.reviewed()).select("id", "label"))


@query(
    "a2_split_sizes",
    """select count(*) samples, count(distinct label) classes,
  least(greatest(count(distinct label), round_even(0.2 * count(*), 0)), count(*) - count(distinct label))::bigint test_rows from usable""",
)
def a2(t: Tables) -> DataFrame:
    share = F.lit(0.2) * F.col("samples")
    sizes = tr.usable_samples(t.reviewed()).agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("label").alias("classes"))
    rows = F.least(F.greatest(F.col("classes"), F.bround(share, 0)), F.col("samples") - F.col("classes"))
    return sizes.withColumn("test_rows", rows.cast("bigint"))


@query("a3_stratified_split", "select id, label, in_test from split")
def a3(t: Tables) -> DataFrame:
    return tr.stratified_split(tr.training_set(t.reviewed())).select("id", "label", "in_test")


@query("a4_best_model")
def a4(t: Tables) -> DataFrame:
    best = t.best_model()
    predicted = tr.classify(tr.sample_features(tr.training_set(t.reviewed())), best.model, best.labels)
    return tr.class_report(tr.confusion(predicted)).withColumn("model_name", F.lit(best.name))


o.FRAGMENTS["guesses"] = """select attack_type as label, case when score < -0.05 then 'port_scan' when score < -0.04 then 'ddos' when verdict = 'ATTACK' then 'syn_flood'
  else 'flood' end predicted_label from reviews where available"""


def guesses(t: Tables) -> DataFrame:
    """Reviewed types against a rule of thumb on the score."""
    return t.reviews().filter("available").selectExpr(
        "attack_type label",
        "case when score < -0.05D then 'port_scan' when score < -0.04D then 'ddos' when verdict = 'ATTACK' then 'syn_flood' else 'flood' end predicted_label",
    )


query("a5_confusion", "select label, predicted_label, count(*) n from guesses group by all")(lambda t: tr.confusion(guesses(t)))
query(
    "a5_class_report",
    """select label, case when guessed > 0 then round(hits / guessed, 6) else 0 end::double as precision, case when support > 0 then round(hits / support, 6) else 0 end::double recall,
  round(2 * hits / (support + guessed), 6)::double f1, support
from (select l as label, count(*) filter (where label = l) support, count(*) filter (where predicted_label = l) guessed,
  count(*) filter (where label = l and predicted_label = l) hits
  from guesses, (select label l from guesses union select predicted_label from guesses) group by l)""",
)(lambda t: tr.class_report(tr.confusion(guesses(t))))


@query("a6_predictions")
def a6(t: Tables) -> DataFrame:
    best = t.best_model()
    return tr.classify_flagged(t.scored_features(), best.model, best.labels).select(
        "flow_id", "predicted_label", F.round(F.element_at("probabilities", F.col("predicted_label")), 6).alias("share")
    )


query("a7_label_counts", "select label, count(*) samples from labelled group by 1")(lambda t: rep.label_counts(t.labels()))
query("a7_source_counts", "select label_source, count(*) samples from labelled group by 1")(
    lambda t: rep.label_counts(t.labels(), "label_source")
)
query(
    "a8_schema_split",
    """select schema_keys, len(string_split(schema_keys, ',')) n_keys, count(*) samples,
  case when list_has_all(string_split(schema_keys, ','), ['ack_ratio', 'fwd_packet_share', 'iat_cv']) then 'current' else 'stale' end tag from reviewed group by all""",
)(lambda t: tr.schema_split(t.reviewed()))
query(
    "a9_retrain_due",
    """select samples, coalesce(last, 0) last_samples, samples - coalesce(last, 0) new_samples, samples - coalesce(last, 0) >= 100 due
from (select count(*) samples, (select sample_count from versions where version = (select version from active)) last from reviewed)""",
)(lambda t: reg.retrain_due(t.labelled(), t.versions(), reg.auto_promotions(t.versions())))
query(
    "a10_promotions",
    """select version, promoted_seq from promotions union all
select (select min(version) from versions), (select max(promoted_seq) from promotions) + 1""",
)(lambda t: reg.promote(t.versions(), reg.auto_promotions(t.versions()), "20240101_000000"))
_ROLLED_BACK = ("20240110_000000", "20240103_000000")  # after the tenth day's model, that of the third was put back
query(
    "a10_after_rollback",
    f"""select version, n promoted_seq from (with recursive steps as (
  select row_number() over (order by place, by_hand, version) n, version, f1_macro, by_hand from (
    select version as place, 0 by_hand, version, f1_macro from versions
    union all select '{_ROLLED_BACK[0]}', 1, version, f1_macro from versions where version = '{_ROLLED_BACK[1]}')),
fold(n, version, active, promoted) as (
  select n, version, f1_macro, true from steps where n = 1
  union all
  select s.n, s.version, case when s.by_hand = 1 or s.f1_macro > f.active then s.f1_macro else f.active end, s.by_hand = 1 or s.f1_macro > f.active
  from fold f join steps s on s.n = f.n + 1)
select * from fold) where promoted""",
)(
    lambda t: reg.auto_promotions(
        t.versions(), t.versions().limit(1).select(F.lit(_ROLLED_BACK[1]).alias("version"), F.lit(_ROLLED_BACK[0]).alias("after_version"))
    )
)
query(
    "a11_versions",
    """select version, trained_at, sample_count, feature_schema_version, model_name, round(f1_macro, 6) f1_macro,
  version = (select version from active) promoted from versions""",
)(lambda t: reg.list_versions(t.versions().drop("promoted"), reg.auto_promotions(t.versions())))
query(
    "a11_pruned",
    """select version, sample_count from versions where version not in (select version from active) and model_name <> 'RandomForest'""",
)(
    lambda t: reg.prune(
        t.versions(), reg.auto_promotions(t.versions()), t.versions().filter("model_name = 'RandomForest'")
    ).select("version", "sample_count")
)
query(
    "a12_stale_report",
    """select count(*) stale, min("timestamp") earliest, max("timestamp") latest from reviewed
where not list_has_all(keys, ['ack_ratio', 'fwd_packet_share', 'iat_cv'])""",
)(lambda t: tr.stale_report(t.reviewed()))
query(
    "a12_without_stale",
    """select id, label_source from labelled where not (label_source = 'llm' and not list_has_all(keys, ['ack_ratio', 'fwd_packet_share', 'iat_cv']))""",
)(lambda t: tr.drop_stale(t.labelled()).select("id", "label_source"))
_POISON = f"label = 'ddos' and label_source = 'llm' and {o.multicast('dst_ip')}"
query("a13_multicast_labels", f"select id, dst_ip, dst_port, confidence, reasoning from labelled where {_POISON}")(
    lambda t: tr.multicast_flood_labels(t.labelled()).select("id", "dst_ip", "dst_port", "confidence", "reasoning")
)
query("a13_without_multicast", f"select id, label from labelled where not coalesce({_POISON}, false)")(
    lambda t: tr.drop_multicast_flood_labels(t.labelled()).select("id", "label")
)

_BULK_CUT = NOW_US - 14 * 86_400_000_000
_FIND_CUT = NOW_US - 21 * 86_400_000_000
o.FRAGMENTS["tiers"] = f"""select e.*, case when verdict in ('NORMAL', 'WARMING_UP') and ts_us < {_BULK_CUT} then 'bulk'
  when verdict in ('SUSPICIOUS', 'ATTACK', 'UNAVAILABLE') and ts_us < {_FIND_CUT} and k.key is null then 'finding' end removed_by
from evidence e left join (select distinct key from incidents where status = 'OPEN') k on k.key = coalesce(e.src_ip, '__aggregate__')"""
query("t1_bulk_retention", "select evidence_id, verdict from tiers where coalesce(removed_by, '') <> 'bulk'")(
    lambda t: t.evidence().filter(~ret.old_bulk(NOW_US, RETENTION)).select("evidence_id", "verdict")
)
query("t2_finding_retention", "select evidence_id, verdict, removed_by from tiers")(
    lambda t: ret.evidence_tier(t.evidence(), t.incidents(), NOW_US, RETENTION).select("evidence_id", "verdict", "removed_by")
)
query(
    "t3_sample_cap",
    """select id, label from (select id, label, row_number() over (partition by label order by "timestamp" desc, id desc) place from labelled) where place <= 700""",
)(lambda t: ret.kept_samples(t.labels(), RETENTION).select("id", "label"))
query(
    "t4_retention_stats",
    """select 'bulk_evidence' tier, count(*) filter (where removed_by = 'bulk') removed from tiers
union all select 'finding_evidence', count(*) filter (where removed_by = 'finding') from tiers
union all select 'training_samples', sum(greatest(n - 700, 0))::bigint from (select count(*) n from labelled group by label)""",
)(lambda t: ret.retain(t.evidence(), t.labelled(), t.incidents(), NOW_US, RETENTION)[2])

query("m1_evidence_counts", "select detector, verdict, count(*) evidence_total from evidence group by all")(
    lambda t: me.evidence_counts(t.evidence())
)
query(
    "m2_incident_events",
    "select count(*) filter (where is_new) incidents_opened, count(*) filter (where not is_new) incidents_updated from bridge where kind = 'evidence'",
)(lambda t: me.incident_event_counts(t.bridge()))
_BOUNDS = ", ".join(map(str, me.RISK_BUCKETS))
query(
    "m3_risk_histogram",
    f"""select b::varchar le, (select count(*) from running where risk_score <= b) observations from (select unnest([{_BOUNDS}]) b)
union all select '+Inf', count(*) from running""",
)(lambda t: me.risk_histogram(t.bridge()))
query(
    "m4_tier_counts",
    f"""select t risk_tier, (select count(*) from running where {o.tier('risk_score')} = t) assessments from (select unnest(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) t)""",
)(lambda t: me.tier_counts(t.bridge()))
query("m4_open_gauge", "select count(*) incidents_open from incidents where status = 'OPEN'")(lambda t: me.open_gauge(t.incidents()))
query(
    "m5_all_metrics",
    f"""select 'evidence_total' metric, 'detector=' || detector || ',verdict=' || verdict labels, count(*) as value from evidence group by all
union all select 'incidents_opened_total', '', count(*) from bridge where kind = 'evidence' and is_new
union all select 'incidents_updated_total', '', count(*) from bridge where kind = 'evidence' and not is_new
union all select 'incident_risk_score_bucket', 'le=' || b, (select count(*) from running where risk_score <= b) from (select unnest([{_BOUNDS}]) b)
union all select 'incident_risk_score_bucket', 'le=+Inf', count(*) from running
union all select 'risk_tier_assessments_total', 'tier=' || t, (select count(*) from running where {o.tier('risk_score')} = t) from (select unnest(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) t)
union all select 'incidents_open_current', '', count(*) from incidents where status = 'OPEN'
union all select 'block_actions_total', 'action=' || action || ',backend=' || backend, count(*) from block_actions group by all
union all select 'llm_calls_total', 'outcome=' || case when available then 'success' else 'failed' end, count(*) from reviews group by all
union all select 'cef_export_total', 'granularity=evidence,outcome=sent', count(*) from evidence
union all select 'cef_export_total', 'granularity=incident,outcome=sent', count(*) from bridge where kind = 'evidence'""",
)(lambda t: me.metrics(t.evidence(), t.bridge(), t.incidents(), t.block_actions(), t.reviews()))


# ---- the whole way --------------------------------------------------------------
o.FRAGMENTS["judged"] = """select flow_id, finish_seq, last_us ts_us, src_ip, dst_ip, dst_port,
  case when finish_seq < warm_end then 'WARMING_UP' when total_packets >= 20 and packets_per_second > 1000 then 'ATTACK'
    when (total_bytes % 97 - 60) / 1000.0::double < -0.015 then 'SUSPICIOUS' else 'NORMAL' end verdict
from features, (select max(finish_seq) warm_end from warm)"""
o.FRAGMENTS["attempted"] = "select flow_id, finish_seq, last_us ts_us, src_ip, dst_ip, dst_port from features"
o.FRAGMENTS["flow_evidence"] = f"""
select finish_seq * 8 arrival_seq, 'anomaly' detector, ts_us, verdict, src_ip, null::varchar attack_type from judged
union all select finish_seq * 8 + 2, 'ddos', ts_us, verdict, null, null from ({o.ddos_sql('started', 'checks', PACKET_DDOS)})
union all select finish_seq * 8 + 3, 'port_scan', ts_us, verdict, src_ip, null from ({o.port_scan_sql('started', 'checks', PACKET_SCAN.window_us, PACKET_SCAN.suspicious_ports, PACKET_SCAN.attack_ports)})
union all select finish_seq * 8 + 4, 'brute_force', ts_us, verdict, src_ip, null from ({o.brute_force_sql('attempted', PACKET_GUESS)})"""
o.FRAGMENTS["flow_bridge"] = o.correlate_sql("flow_evidence", None)
query(
    "packets_to_risk",
    f"""select key, evidence_count, detectors, cast(least(100, {o.half_even('raw')}) as int) risk_score from (
  select key, sum(n)::bigint evidence_count, string_agg(detector, ',' order by detector) detectors,
    sum(case when pts > 0 then pts * {o.TRUST_SQL}::double else 0 end) + greatest(count(*) filter (where pts > 0) - 1, 0) * 10 raw
  from (select key, detector, count(*) n, max({o.POINTS}) pts from flow_bridge group by 1, 2) group by 1)""",
)(
    lambda t: inc.incidents(inc.correlate(t.packet_evidence(detail=False))).select(
        "key", "evidence_count", F.col("detectors_involved").alias("detectors"), "risk_score"
    )
)

"""The same tables as ``plans.tables`` in plain SQL, as named parts a check query is put together from."""

from __future__ import annotations

import math
import re

from netspark.functions.ip import IPV4_PATTERN, MULTICAST_BLOCK, PRIVATE_BLOCKS, to_number
from netspark.operators.incidents import TRUST
from netspark.operators.techniques import BY_ATTACK_TYPE, BY_DETECTOR
from netspark.params import AnomalyParams
from netspark.plans import tables as T
from netspark.plans.adapters import HALF_US, LATE_US, PREFIXES, RESPONSE_CASES
from netspark.schemas import ATTACK_TYPES, DETECTORS, FEATURE_COLUMNS, IDENTITY_COLUMNS, STALE_MARKER_KEYS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def text_list(values) -> str:
    return ", ".join(quoted(v) for v in values)


def ip_number(ip: str) -> str:
    part = [f"cast(string_split({ip}, '.')[{i}] as bigint)" for i in (1, 2, 3, 4)]
    value = f"{part[0]} * 16777216 + {part[1]} * 65536 + {part[2]} * 256 + {part[3]}"
    return f"(case when regexp_matches({ip}, {quoted(IPV4_PATTERN)}) then {value} end)"


def within(number: str, blocks) -> str:
    tests = " or ".join(f"{number} between {to_number(a)} and {to_number(b)}" for a, b in blocks)
    return f"coalesce({tests}, false)"


def utc_text(ts_us: str) -> str:
    return f"strftime(make_timestamp({ts_us}), '%Y-%m-%d %H:%M:%S') || ' UTC'"


def iso_text(ts_us: str) -> str:
    return f"strftime(make_timestamp({ts_us}), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"


def multicast(ip: str) -> str:
    return within(ip_number(ip), [MULTICAST_BLOCK, ("255.255.255.255", "255.255.255.255")])


_CASES = "[" + text_list(RESPONSE_CASES).replace("\n", "' || chr(10) || '") + "]"
KEY = "ip_a, port_a, ip_b, port_b, protocol"
_SRC, _DST = "row(src_ip, src_port)", "row(dst_ip, dst_port)"


def _direction(end: str, size: str, name: str) -> str:
    test = "fwd" if end == "fwd" else "not fwd"
    value = f"(case when {test} then {size} end)"
    return ", ".join(
        f"coalesce({fn}({value}), 0)::double {end}_{name}_{stat}"
        for stat, fn in (("mean", "avg"), ("max", "max"), ("min", "min"), ("std", "stddev_samp"))
    )


def _parse(source: str, target_columns: str = "flow_id") -> str:
    """Parsed answers of a (flow_id, raw_text) part."""
    fence = "chr(96) || chr(96) || chr(96)"
    return f"""
select flow_id, coalesce(kind in ({text_list(ATTACK_TYPES)}), false) available,
  case when kind in ({text_list(ATTACK_TYPES)}) then kind end attack_type,
  case when kind in ({text_list(ATTACK_TYPES)}) and conf in ('high', 'medium', 'low', 'unknown') then conf else 'unknown' end confidence,
  case when kind in ({text_list(ATTACK_TYPES)}) then why end review_reasoning,
  case when not json_valid(body) then 'Could not parse LLM response as JSON'
       when kind is null or kind not in ({text_list(ATTACK_TYPES)})
       then 'LLM returned an unrecognised attack_type: ' || coalesce('''' || kind || '''', 'None') end error
from (
  select *, case when json_valid(body) then json_extract_string(body, '$.attack_type') end kind,
    case when json_valid(body) then json_extract_string(body, '$.confidence') end conf,
    case when json_valid(body) then json_extract_string(body, '$.reasoning') end why
  from (
    select flow_id, trim(array_to_string(list_filter(string_split(trim(raw_text), chr(10)),
      lambda x: not starts_with(trim(x), {fence})), chr(10))) body
    from {source}))"""


def _label(results: str, parsed: str) -> str:
    return f"""
select l.*, case when verdict = 'SUSPICIOUS' and label in ('port_scan', 'syn_flood', 'ddos', 'brute_force', 'data_exfiltration')
    and confidence in ('high', 'medium') then 'ATTACK' else verdict end stored_verdict
from (
  select r.*, case when asked and available then attack_type else 'unknown' end as label,
    case when not asked then 'auto' when available then 'llm' else 'llm_failed' end label_source,
    case when asked and available then p.confidence else 'unknown' end confidence,
    case when not asked then null when available then review_reasoning else error end reasoning
  from (select *, verdict = 'ATTACK' or coalesce(score < -0.03, false) asked from {results}
        where verdict in ('SUSPICIOUS', 'ATTACK')) r
  left join {parsed} p using (flow_id)) l"""


def _evidence_part(source: str, detector: str, verdict: str, reasoning: str, identity: tuple, kind: str = "null") -> str:
    rank = DETECTORS.index(detector)
    src, dst, port = identity
    return (
        f"select finish_seq * 8 + {rank} arrival_seq, '{detector}' detector, ts_us, {verdict} verdict, {reasoning} reasoning, "
        f"cast({src} as varchar) src_ip, cast({dst} as varchar) dst_ip, cast({port} as int) dst_port, "
        f"cast({kind} as varchar) attack_type from {source}"
    )


_ALL = ("src_ip", "dst_ip", "dst_port")
_NONE = ("null", "null", "null")


def window_words(detector: str) -> str:
    return f"{T.SECONDS[detector]}s window"


def _map(column: str, mapping: dict[str, str]) -> str:
    return f"(case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in mapping.items()) + " end)"


TECHNIQUE = f"(case when detector = 'llm' then {_map('attack_type', BY_ATTACK_TYPE)} else {_map('detector', BY_DETECTOR)} end)"
POINTS = "(case verdict when 'SUSPICIOUS' then 15 when 'ATTACK' then 30 else 0 end)"
TRUST_SQL = "(case detector " + " ".join(f"when '{d}' then {w}" for d, w in TRUST.items()) + " end)"


def half_even(x: str) -> str:
    """All scores are multiples of a half."""
    return f"(case when {x} - floor({x}) = 0.5 then 2 * floor(({x} + 0.5) / 2) else round({x}) end)"


def tier(score: str) -> str:
    return f"case when {score} <= 24 then 'LOW' when {score} <= 49 then 'MEDIUM' when {score} <= 79 then 'HIGH' else 'CRITICAL' end"


def _keys(columns) -> str:
    return "[" + text_list(columns) + "]"


_TEXT = {"src_ip", "dst_ip", "verdict", "attack_type", "confidence", "reasoning", "error", "detection_type", "available"}
NO_TIE = 0.31830988  # added before rounding down, so that values of few digits don't lie on an edge


def _pair(name: str, source: str | None = None) -> str:
    """``name=value`` as text: numbers in millionths, from 1000 on in thousandths."""
    column = source or name
    number = f"floor({column}::double * case when abs({column}::double) < 1000 then 1e6 else 1e3 end + {NO_TIE}::double)::bigint"
    return f"'{name}=' || coalesce({column if name in _TEXT else number}::varchar, 'null')"


def _pairs(columns, **sources: str) -> str:
    named = [_pair(c) for c in columns] + [_pair(name, source) for name, source in sources.items()]
    return "[" + ", ".join(named) + "]"


def joined_pairs(pairs: str) -> str:
    return f"array_to_string(list_sort({pairs}), ',')"


_STORED = IDENTITY_COLUMNS + FEATURE_COLUMNS
_OLDER = [c for c in _STORED if c not in STALE_MARKER_KEYS]


def _labelled_part(source: str, keys: str, pairs: str, rows: str, stored: str = "stored_verdict") -> str:
    return (
        f"select {rows} id, {iso_text('ts_us')} \"timestamp\", label, label_source, confidence, score anomaly_score, "
        f"{stored} verdict, reasoning, {keys} keys, {pairs} pairs, src_ip, dst_ip, cast(src_port as int) src_port, cast(dst_port as int) dst_port, "
        f"cast(protocol as int) protocol, total_packets, packets_per_second, syn_ratio, zero_payload_ratio from {source}"
    )


def _tracker(source: str, name: str, rank: int, reasoning: str, kind: str, keys: dict[str, str], identity: tuple) -> str:
    src, dst, port = identity
    described = _pairs([], detection_type=quoted(kind), window_seconds=repr(float(T.SECONDS[name])), **keys)
    return (
        f"select -1000000000 - (finish_seq * 8 + {rank}) id, {iso_text('ts_us')} \"timestamp\", '{name}' as label, "
        f"'{name}_tracker' label_source, 'high' confidence, null anomaly_score, 'ATTACK' verdict, {reasoning} reasoning, "
        f"{_keys(['detection_type', 'window_seconds', *keys])} keys, {described} pairs, {src} src_ip, {dst} dst_ip, null src_port, {port} dst_port, "
        f"null protocol, null total_packets, null packets_per_second, null syn_ratio, null zero_payload_ratio from {source}"
    )


def _transitions(source: str, keys: str) -> str:
    by = f"partition by {keys} " if keys else ""
    return (
        f"select * exclude (prev) from (select *, coalesce(lag(verdict) over ({by}order by finish_seq), 'NORMAL') prev "
        f"from {source}) where verdict <> prev and verdict = 'ATTACK'"
    )


_D, _P, _B = T.DDOS, T.PORT_SCAN, T.BRUTE_FORCE


def port_scan_sql(events: str, checks: str, window_us: int, suspicious: int, attack: int) -> str:
    """Counts per check row by comparing it with every event of its source in the window."""
    return f"""
with pairs as (
  select a.flow_id, a.ts_us t, b.dst_ip d, b.dst_port p, b.ts_us bt
  from {checks} a join {events} b on a.src_ip = b.src_ip and b.ts_us between a.ts_us - {window_us} and a.ts_us),
totals as (select flow_id, count(distinct p) distinct_ports, min(bt) scan_start_us, max(bt) scan_end_us from pairs group by 1),
contacts as (select distinct flow_id, d, p from pairs),
wide as (select flow_id, p from contacts group by 1, 2 having count(distinct d) >= 2),
per_target as (
  select c.flow_id, c.d, count(*) ports, count(w.p) shared from contacts c left join wide w on c.flow_id = w.flow_id and c.p = w.p
  group by 1, 2),
targets as (select flow_id, count(*) filter (where ports >= 2 or shared >= 1) distinct_targets from per_target group by 1)
select c.*, coalesce(t.distinct_ports, 0) distinct_ports, coalesce(g.distinct_targets, 0) distinct_targets, t.scan_start_us, t.scan_end_us,
  coalesce((t.scan_end_us - t.scan_start_us) / 1e6, 0.0) duration_seconds,
  coalesce(t.distinct_ports / greatest((t.scan_end_us - t.scan_start_us) / 1e6, 0.001), 0.0) ports_per_second,
  case when coalesce(t.distinct_ports, 0) >= {attack} then 'ATTACK' when coalesce(t.distinct_ports, 0) >= {suspicious} then 'SUSPICIOUS' else 'NORMAL' end verdict,
  case when coalesce(t.distinct_ports, 0) < {suspicious} then 0.0 else least(100.0::double, t.distinct_ports / {attack}.0::double * 100.0) end confidence_pct
from {checks} c left join totals t using (flow_id) left join targets g using (flow_id)"""


def ddos_sql(events: str, checks: str, p) -> str:
    return f"""
select c.*, count(b.src_ip) total_flows, count(distinct b.src_ip) distinct_sources,
  case when count(b.src_ip) >= {p.attack_flows} and count(distinct b.src_ip) >= {p.attack_sources} then 'ATTACK'
       when count(b.src_ip) >= {p.suspicious_flows} or count(distinct b.src_ip) >= {p.suspicious_sources} then 'SUSPICIOUS'
       else 'NORMAL' end verdict
from {checks} c left join (select src_ip, ts_us bt from {events}) b on b.bt between c.ts_us - {p.window_us} and c.ts_us
group by all"""


def brute_force_sql(attempts: str, p) -> str:
    ports = ", ".join(map(str, p.watched_ports))
    by = "partition by src_ip, dst_ip, dst_port"
    return f"""
with kept as (select * from {attempts} where dst_port in ({ports})),
counted as (
  select *, count(*) over ({by} order by ts_us range between {p.window_us} preceding and current row) attempts from kept),
times as (select distinct src_ip, dst_ip, dst_port, ts_us, attempts from counted),
rising as (
  select *, case when attempts >= {p.attack_attempts} and coalesce(lag(attempts) over ({by} order by ts_us), 0) < {p.attack_attempts}
    then 1 else 0 end rise from times),
numbered as (select *, sum(rise) over ({by} order by ts_us)::bigint repeat_offender_count from rising)
select c.*, n.repeat_offender_count,
  case when c.attempts >= {p.attack_attempts} then 'ATTACK' when c.attempts >= {p.suspicious_attempts} then 'SUSPICIOUS' else 'NORMAL' end verdict
from counted c join numbered n using (src_ip, dst_ip, dst_port, ts_us)"""


def correlate_sql(evidence: str, actions: str | None, extra: str = "") -> str:
    by = f"partition by key{extra}"
    acts = f" union all by name select arrival_seq, key, 'action' kind, action from {actions}" if actions else ""
    action = "action" if actions else "null"
    return f"""
with rows as (
  select coalesce(src_ip, '__aggregate__') as key, *, 'evidence' kind from {evidence} where verdict not in ('NORMAL', 'WARMING_UP'){acts}),
opened as (
  select *, kind = 'evidence' and verdict in ('SUSPICIOUS', 'ATTACK') opens from rows),
known as (
  select *, coalesce(max(opens::int) over ({by} order by arrival_seq rows between unbounded preceding and 1 preceding), 0) = 1 had from opened),
sets as (
  select *, case when opens then 'OPEN' when {action} = 'resolve' and had then 'RESOLVED' when {action} = 'reopen' and had then 'OPEN' end state
  from known),
states as (
  select *, last_value(state ignore nulls) over ({by} order by arrival_seq rows between unbounded preceding and 1 preceding) before from sets),
kept as (
  select *, opens and (before is null or before = 'RESOLVED') is_new from states
  where opens or (kind = 'action' and state is not null) or (kind = 'evidence' and verdict = 'UNAVAILABLE' and before = 'OPEN')),
numbered as (
  select *, sum(is_new::int) over ({by} order by arrival_seq)::bigint incident_no from kept)
select * exclude (opens, had, state, before), coalesce(state, before) status_after,
  substr(sha256(key || '#' || incident_no{extra.replace(', ', " || '#' || ")}), 1, 32) incident_id from numbered"""


FRAGMENTS: dict[str, str] = {
    "packets": """
with b as (select l.*, o.o_custkey, epoch_us(o.o_orderdate) day_us,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) pkt_no
  from lineitem l join orders o on l_orderkey = o_orderkey)
select day_us//86400000000*10000000000 + l_orderkey*100 + pkt_no arrival_seq,
  day_us + pkt_no*(100000 + (l_partkey%50)*4000) ts_us,
  case when l_orderkey%10<7 then 6 when l_orderkey%10<9 then 17 else 1 end protocol,
  case when l_linestatus='O' then '10.0.'||(o_custkey//250)||'.'||(o_custkey%250+1)
       else '192.168.1.'||(l_orderkey%50+1) end src_ip,
  case when l_linestatus='O' then '192.168.1.'||(l_orderkey%50+1)
       else '10.0.'||(o_custkey//250)||'.'||(o_custkey%250+1) end dst_ip,
  cast(case when l_orderkey%10=9 then 0 when l_linestatus='O' then 20000+l_orderkey%40000
       else [22,443,80,3389,5432][l_orderkey%5+1] end as int) src_port,
  cast(case when l_orderkey%10=9 then 0 when l_linestatus='O' then [22,443,80,3389,5432][l_orderkey%5+1]
       else 20000+l_orderkey%40000 end as int) dst_port,
  cast(40+l_quantity*20 as int) size, 20 header_size,
  cast(case when l_returnflag='A' and l_quantity<25 then 0 else 20+l_quantity*20 end as int) payload_size,
  case when l_orderkey%10>=7 then null when l_partkey%97=0 then 'R' when l_linenumber=7 then 'FA'
       when pkt_no=1 then 'S' when l_returnflag='N' then 'PA' else 'A' end tcp_flags
from b""",
    "keyed": f"""
select *, case when {_SRC} <= {_DST} then src_ip else dst_ip end ip_a, case when {_SRC} <= {_DST} then src_port else dst_port end port_a,
  case when {_SRC} <= {_DST} then dst_ip else src_ip end ip_b, case when {_SRC} <= {_DST} then dst_port else src_port end port_b,
  coalesce(tcp_flags like '%F%' or tcp_flags like '%R%', false) closes
from packets""",
    "stepped": f"""
select *, lag(closes) over (partition by {KEY} order by arrival_seq) prev_closes,
  lag(ts_us) over (partition by {KEY} order by arrival_seq) prev_ts
from keyed""",
    "sessions": f"""
select *, coalesce(prev_closes, true) opens,
  sum(coalesce(prev_closes, true)::int) over (partition by {KEY} order by arrival_seq) session_no,
  case when prev_closes = false then greatest(ts_us - prev_ts, 0) end gap_us
from stepped""",
    "idle_sessions": f"""
select *, sum(opens::int) over (partition by {KEY} order by arrival_seq) session_no from (
  select *, coalesce(prev_closes, true) or ts_us - prev_ts >= 400000 opens from stepped)""",
    "directed": f"""
select *, src_ip = first_value(src_ip) over f and src_port = first_value(src_port) over f fwd
from sessions window f as (partition by {KEY}, session_no order by arrival_seq)""",
    "features": f"""
with g as (
  select {KEY}, session_no, min(arrival_seq) flow_id, max(arrival_seq) last_seq, bool_or(closes) finished_cleanly,
    arg_min(src_ip, arrival_seq) src_ip, arg_min(dst_ip, arrival_seq) dst_ip, arg_min(src_port, arrival_seq) src_port,
    arg_min(dst_port, arrival_seq) dst_port, arg_min(ts_us, arrival_seq) start_us, arg_max(ts_us, arrival_seq) last_us,
    count(*) total_packets, sum(size)::bigint total_bytes, count(*) filter (where fwd) fwd_packets, count(*) filter (where not fwd) bwd_packets,
    coalesce(sum(size) filter (where fwd), 0)::bigint fwd_bytes, coalesce(sum(size) filter (where not fwd), 0)::bigint bwd_bytes,
    {_direction('fwd', 'size', 'pkt_len')}, {_direction('bwd', 'size', 'pkt_len')},
    {_direction('fwd', 'header_size', 'header_len')}, {_direction('bwd', 'header_size', 'header_len')},
    coalesce(avg(gap_us / 1e6), 0) iat_mean, coalesce(max(gap_us / 1e6), 0) iat_max, coalesce(min(gap_us / 1e6), 0) iat_min,
    coalesce(stddev_samp(gap_us / 1e6), 0) iat_std,
    count(*) filter (where tcp_flags like '%S%') syn_count, count(*) filter (where tcp_flags like '%A%') ack_count,
    count(*) filter (where tcp_flags like '%F%') fin_count, count(*) filter (where tcp_flags like '%R%') rst_count,
    count(*) filter (where tcp_flags like '%P%') psh_count, count(*) filter (where tcp_flags like '%U%') urg_count,
    count(tcp_flags) flagged, avg(payload_size) avg_payload_size, avg(case when payload_size = 0 then 1.0 else 0.0 end) zero_payload_ratio
  from directed group by all)
select *, case when finished_cleanly then last_seq else 576460752303423488 + flow_id end finish_seq,
  greatest((last_us - start_us) / 1e6, 1e-6::double) duration_seconds,
  total_bytes / greatest((last_us - start_us) / 1e6, 1e-6::double) bytes_per_second,
  total_packets / greatest((last_us - start_us) / 1e6, 1e-6::double) packets_per_second,
  case when fwd_packets > 0 then bwd_packets / fwd_packets else 0.0 end bwd_fwd_packet_ratio,
  fwd_packets / total_packets fwd_packet_share,
  case when iat_mean > 0 then iat_std / iat_mean else 0.0 end iat_cv,
  case when flagged > 0 then syn_count / flagged else 0.0 end syn_ratio,
  case when flagged > 0 then ack_count / flagged else 0.0 end ack_ratio,
  case when dst_port < 1024 then 1 else 0 end is_well_known_dst_port
from g where total_packets >= 2""",
    "scored_features": """
select *, last_us ts_us, (total_bytes % 97 - 60) / 1000.0::double score,
  case when total_packets >= 20 and packets_per_second > 1000 then 'ATTACK'
       when (total_bytes % 97 - 60) / 1000.0::double < -0.015 then 'SUSPICIOUS' else 'NORMAL' end verdict
from features""",
    "feature_responses": f"select flow_id, {_CASES}[flow_id // 100 % 10 + 1] raw_text from features",
    "feature_parsed": _parse("feature_responses"),
    "feature_labels": _label("scored_features", "feature_parsed"),
    "nf": """
select event_id flow_id, event_id finish_seq, epoch_us(ts) ts_us,
  '10.0.'||(user_id//250)||'.'||(user_id%250+1) src_ip,
  '192.168.1.'||(event_id%7+1) dst_ip,
  cast(case event_type when 'signup' then 22 when 'error' then 3389 when 'click' then 443
    when 'view' then 1000+cast(props->>'k' as int)
    else 8000+cast(props->>'k' as int)%10 end as int) dst_port
from events""",
    "scored_all": """
select flow_id, finish_seq, ts_us, src_ip, cast(20000 + flow_id % 40000 as int) src_port,
  case when flow_id % 53 = 0 then '239.255.255.250' when flow_id % 59 = 0 then '255.255.255.255' else dst_ip end dst_ip, dst_port,
  case when flow_id % 10 < 7 then 6 when flow_id % 10 < 9 then 17 else 1 end protocol,
  (3000 - cents) // 200 / 1000.0::double score0, 2 + flow_id % 40 total_packets, cents / 10.0::double packets_per_second,
  flow_id % 5 / 4.0::double syn_ratio, flow_id % 3 / 2.0::double zero_payload_ratio
from nf join (select event_id, cast(round(value * 100) as bigint) cents from events) on flow_id = event_id""",
    "scored": """
select * exclude (score0), case when finish_seq >= warm_end then score0 end score,
  case when coalesce(finish_seq < warm_end, true) then 'WARMING_UP' when total_packets >= 20 and packets_per_second > 1000 then 'ATTACK'
       when score0 < -0.015 then 'SUSPICIOUS' else 'NORMAL' end verdict
from scored_all, (select case when count(*) >= 30 then max(finish_seq) end warm_end from (select finish_seq from scored_all order by 1 limit 30))""",
    "responses": f"select event_id flow_id, {_CASES}[event_id % 10 + 1] raw_text from events",
    "parsed": _parse("responses"),
    "candidates": """
select * from scored where verdict = 'ATTACK' or (verdict = 'SUSPICIOUS' and score < -0.03)""",
    "reviews": f"""
select * exclude (available, confidence, error), coalesce(available, false) available, coalesce(confidence, 'unknown') confidence,
  case when available is null then 'no response' else error end error
from candidates left join parsed using (flow_id) where not {multicast('dst_ip')}""",
    "labels": _label("scored", "parsed"),
    "ddos": ddos_sql("nf", "nf", _D),
    "port_scan": port_scan_sql("nf", "nf", _P.window_us, _P.suspicious_ports, _P.attack_ports),
    "brute_force": brute_force_sql("nf", _B),
    "ddos_changes": _transitions("ddos", ""),
    "port_scan_changes": _transitions("port_scan", "src_ip"),
    "brute_force_changes": _transitions("brute_force", "src_ip, dst_ip, dst_port"),
    "evidence_rows": " union all ".join(
        [
            _evidence_part(
                "scored", "anomaly", "verdict",
                "case when verdict = 'WARMING_UP' then 'Still warming up - no baseline yet.' else 'Isolation Forest score ' || "
                "printf('%.3f', score) || ' against learned baseline.' end", _ALL),
            _evidence_part(
                "reviews", "llm",
                "case when not available then 'UNAVAILABLE' when attack_type = 'benign' then 'NORMAL' when attack_type = 'unknown' then 'SUSPICIOUS' else 'ATTACK' end",
                "case when not available then 'LLM analysis unavailable: ' || error else coalesce(nullif(review_reasoning, ''), "
                "'LLM classified this flow as ' || attack_type || '.') end", _ALL, "attack_type"),
            _evidence_part(
                "ddos", "ddos", "verdict",
                f"total_flows || ' flows from ' || distinct_sources || ' distinct sources in a {window_words('ddos')}.'", _NONE),
            _evidence_part(
                "port_scan", "port_scan", "verdict",
                f"distinct_ports || ' distinct ports touched across ' || distinct_targets || ' targets in a {window_words('port_scan')}.'",
                ("src_ip", "null", "null")),
            _evidence_part(
                "brute_force", "brute_force", "verdict",
                f"attempts || ' attempts in {window_words('brute_force')} (offence #' || repeat_offender_count || ').'", _ALL),
        ]
    ),
    "evidence": """
select sha256(detector || '/' || coalesce(src_ip, '') || '/' || coalesce(dst_ip, '') || '/' || coalesce(dst_port::varchar, '') || '/'
  || ts_us || '/' || arrival_seq) evidence_id, * from evidence_rows""",
    "actions": f"""
with h as (select *, cast(string_split(src_ip, '.')[4] as int) octet from nf)
select max(flow_id) * 8 + 7 arrival_seq, src_ip as key, 'resolve' as action from h where ts_us < {HALF_US} and octet % 5 = 0 group by src_ip
union all
select max(flow_id) * 8 + 7, src_ip, 'reopen' from h where ts_us < {LATE_US} and octet % 10 = 0 group by src_ip""",
    "bridge": correlate_sql("evidence", "actions"),
    "worst": f"""
select incident_id, detector, max({POINTS}) pts from bridge where kind = 'evidence' group by 1, 2""",
    "risk": f"""
select incident_id, risk_score, {tier('risk_score')} risk_tier,
  coalesce(contributing, '') contributing, case when n = 0 then 'No corroborating evidence contributed to this score.'
    else n || ' detector(s) corroborating (' || contributing || ').' end risk_explanation
from (
  select incident_id, cast(least(100, {half_even('raw')}) as int) risk_score, n, contributing from (
    select incident_id, sum(case when pts > 0 then pts * {TRUST_SQL}::double else 0 end) + greatest(count(*) filter (where pts > 0) - 1, 0) * 10 raw,
      count(*) filter (where pts > 0) n, string_agg(detector, ', ' order by detector) filter (where pts > 0) contributing
    from worst group by 1))""",
    "first_techniques": f"""
select incident_id, key, {TECHNIQUE} technique_id, min(arrival_seq) first_seq from bridge
where kind = 'evidence' and {TECHNIQUE} is not null group by all""",
    "incidents": """
select b.incident_id, b.key, b.incident_no, arg_max(status_after, arrival_seq) status,
  arg_min(ts_us, arrival_seq) filter (where kind = 'evidence') first_seen_us, max(ts_us) last_seen_us,
  count(*) filter (where kind = 'evidence') evidence_count,
  string_agg(distinct detector, ',' order by detector) detectors_involved,
  ['UNAVAILABLE', 'SUSPICIOUS', 'ATTACK'][max(case verdict when 'ATTACK' then 3 when 'SUSPICIOUS' then 2 else 1 end) filter (where kind = 'evidence')] highest_verdict,
  any_value(r.risk_score) risk_score, any_value(r.risk_tier) risk_tier, any_value(r.contributing) contributing_detectors,
  any_value(r.risk_explanation) risk_explanation, any_value(coalesce(t.techniques, '')) techniques
from bridge b join risk r using (incident_id)
left join (select incident_id, string_agg(technique_id, ',' order by first_seq) techniques from first_techniques group by 1) t using (incident_id)
group by b.incident_id, b.key, b.incident_no""",
    "latest": "select * from incidents i where incident_no = (select max(incident_no) from incidents j where j.key = i.key)",
    "running": f"""
select b.incident_id, b.arrival_seq, cast(least(100, {half_even('raw')}) as int) risk_score from (
  select incident_id, arrival_seq, sum(case when p > 0 then p * {TRUST_SQL}::double else 0 end)
    + greatest(count(*) filter (where p > 0) - 1, 0) * 10 raw
  from (
    select e.incident_id, e.arrival_seq, w.detector, max(w.p) p from (select * from bridge where kind = 'evidence') e
    join (select incident_id, detector, p, min(arrival_seq) since from (select incident_id, detector, arrival_seq, {POINTS} p from bridge where kind = 'evidence') group by 1, 2, 3) w
      on w.incident_id = e.incident_id and w.since <= e.arrival_seq
    group by 1, 2, 3) group by 1, 2) b""",
    "attack_events": f"""
select finish_seq * 8 seq, ts_us, src_ip, 'anomaly_flood' attack_type,
  'Per-flow ATTACK verdict (score=' || score::varchar || ').' reasoning, 0 repeat_offender_count from scored where verdict = 'ATTACK'
union all select finish_seq * 8 + 2, ts_us, 'multiple-sources', 'ddos',
  total_flows || ' flows from ' || distinct_sources || ' distinct sources in {T.SECONDS['ddos']:.0f}s.', 0 from ddos_changes
union all select finish_seq * 8 + 3, ts_us, src_ip, 'port_scan',
  'Touched ' || distinct_ports || ' distinct ports across ' || distinct_targets || ' targets in {T.SECONDS['port_scan']:.0f}s.', 0 from port_scan_changes
union all select finish_seq * 8 + 4, ts_us, src_ip, 'brute_force',
  attempts || ' connection attempts to ' || dst_ip || ':' || dst_port || ' in {T.SECONDS['brute_force']:.0f}s.', repeat_offender_count from brute_force_changes""",
    "decisions": f"""
select *, ts_us + cast(duration_minutes * 60000000 as bigint) expires_us, skip_reason is null applied, false dry_run from (
  select *, case when src_ip = 'multiple-sources' then 'a distributed flood has no one source to block' end skip_reason,
    case when src_ip = 'multiple-sources' then null when repeat_offender_count <= 1 then 2880.0::double
      else 2880.0::double * least(3.0 * (repeat_offender_count - 1), 10.0) end duration_minutes from attack_events)""",
    "block_actions": """
select seq, ts_us, 'block' as action, src_ip ip, attack_type || ': ' || reasoning reason, false dry_run, 'none' backend, expires_us
from decisions where skip_reason is null
union all
select min(seq) + 5, min(ts_us) + 86400000000, 'unblock', src_ip, 'manual', false, 'none', null from attack_events
where src_ip <> 'multiple-sources' and cast(string_split(src_ip, '.')[4] as int) % 4 = 0 group by src_ip""",
    "addresses": f"""
select event_id flow_id, epoch_us(ts) ts_us,
  case when event_id % 101 = 0 then 'host-' || user_id when event_id % 97 = 0 then '255.255.255.255'
    when event_id % 89 = 0 then '10.0.0.' || (user_id + 200)
    else [{text_list(PREFIXES)}][event_id % {len(PREFIXES)} + 1] || '.' || (user_id % 120) || '.' || (event_id % 256) end ip
from events""",
    "geo_ranges": """
select 184549376 + s_suppkey * 300 start_ip, 184549376 + s_suppkey * 300 + 249 end_ip, n_name country, substring(n_name, 1, 2) country_code,
  case when s_suppkey % 3 <> 0 then 'City ' || s_suppkey end city, s_suppkey / 4.0::double latitude, -s_suppkey / 4.0::double longitude,
  case when s_suppkey % 5 = 0 then null when s_suppkey % 7 = 0 then 'ASx' || s_suppkey else 'AS' || (1000 + s_suppkey) || ' Net ' || s_suppkey end as_text,
  case when s_suppkey % 4 <> 0 then 'Net ' || s_suppkey end org
from supplier join nation on s_nationkey = n_nationkey""",
    "labelled": " union all ".join(
        [
            _labelled_part(
                "feature_labels", f"case when flow_id // 100 % 6 = 0 then {_keys(_OLDER)} else {_keys(_STORED)} end",
                f"case when flow_id // 100 % 6 = 0 then {_pairs(_OLDER)} else {_pairs(_STORED)} end", "flow_id"),
            _labelled_part("labels", _keys(T.SCORED_FEATURES), _pairs(T.SCORED_FEATURES), "-1 - flow_id"),
            _tracker(
                "ddos_changes", "ddos", 2,
                "'Aggregate rate tracker: ' || total_flows || ' flows from ' || distinct_sources || "
                f"' distinct sources within a {T.SECONDS['ddos']:.0f}s window (both thresholds exceeded).'",
                "aggregate_ddos", {"total_flows_in_window": "total_flows", "distinct_sources_in_window": "distinct_sources"}, _NONE),
            _tracker(
                "port_scan_changes", "port_scan", 3,
                "'Port scan tracker: source ' || src_ip || ' touched ' || distinct_ports || ' distinct destination ports across ' || "
                "distinct_targets || case when distinct_targets = 1 then ' target' else ' targets' end || "
                f"' within a {T.SECONDS['port_scan']:.0f}s window (threshold exceeded).'",
                "port_scan", {"src_ip": "src_ip", "distinct_ports_in_window": "distinct_ports", "distinct_targets_in_window": "distinct_targets"}, ("src_ip", "null", "null")),
            _tracker(
                "brute_force_changes", "brute_force", 4,
                "'Brute-force tracker: source ' || src_ip || ' made ' || attempts || ' connection attempts to ' || dst_ip || ':' || dst_port || "
                f"' within a {T.SECONDS['brute_force']:.0f}s window (threshold exceeded). Note: reflects connection rate only, "
                "not a confirmed authentication failure.'",
                "brute_force", {"src_ip": "src_ip", "dst_ip": "dst_ip", "dst_port": "dst_port", "attempts_in_window": "attempts"}, _ALL),
        ]
    ),
    "reviewed": f"""
select *, array_to_string(list_sort(list_filter(keys, lambda x: x not in ({text_list(IDENTITY_COLUMNS)}))), ',') schema_keys
from labelled where label_source = 'llm'""",
    "usable": f"""
select * from (select *, count(*) over (partition by label) n from reviewed where schema_keys = {quoted(','.join(sorted(FEATURE_COLUMNS)))})
where n >= 2""",
    "versions": """
select strftime(date_trunc('day', ts), '%Y%m%d') || '_000000' as version, strftime(date_trunc('day', ts), '%Y-%m-%d') || 'T00:00:00+00:00' trained_at,
  cast(count(*) filter (where event_type = 'error') * 10 as int) sample_count, substr(sha256(count(*)::varchar), 1, 12) feature_schema_version,
  case when count(*) % 2 = 0 then 'RandomForest' else 'GradientBoosting' end model_name, count(*) % 50 / 50.0::double f1_macro
from events group by date_trunc('day', ts)""",
    "promotions": """
select version, promoted_seq from (
  select *, row_number() over (order by version) promoted_seq,
    max(f1_macro) over (order by version rows between unbounded preceding and 1 preceding) best from versions)
where best is null or f1_macro > best""",
    "active": "select arg_max(version, promoted_seq) as version from promotions",
}

_WORD = re.compile(r"\b(?:from|join)\s+([a-z_][a-z_0-9]*)")


def anomaly_verdict(score: str) -> str:
    p = AnomalyParams()
    return f"""case when {score} is null then 'WARMING_UP' when total_packets >= {p.flood_min_packets} and packets_per_second > {p.flood_packets_per_second}
  then 'ATTACK' when {score} < {p.suspicious_score} then 'SUSPICIOUS' else 'NORMAL' end"""


def forest(p: AnomalyParams) -> dict[str, str]:
    """An isolation forest unrolled level by level: its nodes, then every flow's way down every tree."""
    limit = math.ceil(math.log2(p.warmup_flows))
    stem = f"'{p.seed}:' || tree_id || ':' || node_id || ':'"
    path = (
        "case when n <= 1 then 0.0::double when n = 2 then 1.0::double "
        "else 2.0::double * (ln(n - 1) + 0.5772156649015329::double) - 2.0::double * (n - 1) / n end"
    )
    long = " union all ".join(f"select flow_id, finish_seq, '{c}' feature, {c}::double v from features" for c in FEATURE_COLUMNS)
    parts = {
        "forest_columns": f"""select feature, mean, case when std = 0 then 1.0::double else std end std, row_number() over (order by feature) - 1 j
from warm_statistics where scaled_variance > {p.min_variance}""",
        "forest_values": f"select flow_id, finish_seq, j, (v - mean) / std v from ({long}) join forest_columns using (feature)",
        "forest_points": "select finish_seq, j, v from forest_values semi join warm using (finish_seq)",
        "forest_at_0": f"select t.range::int tree_id, 1 node_id, finish_seq from warm, range({p.trees}) t",
        "forest_way_0": f"select flow_id, t.range::int tree_id, 1 node_id from features, range({p.trees}) t",
    }
    for depth in range(limit + 1):
        parts[f"forest_size_{depth}"] = f"select tree_id, node_id, count(*) n from forest_at_{depth} group by all"
        parts[f"forest_ends_{depth}"] = f"""
select tree_id, node_id, arg_min(j, draw) f, arg_min(low, draw) low, arg_min(high, draw) high
from (select *, md5({stem} || j) draw from (select tree_id, node_id, j, min(v) low, max(v) high
  from forest_at_{depth} join forest_points using (finish_seq) group by all) where high > low) group by all"""
        parts[f"forest_cut_{depth}"] = f"""
select tree_id, node_id, f, case when drawn >= high then low else drawn end threshold
from (select *, low + ('0x' || left(md5({stem} || 'threshold'), 13))::bigint::double / 4503599627370496::double * (high - low) drawn
  from forest_ends_{depth}) where {depth} < {limit}"""
        parts[f"forest_at_{depth + 1}"] = f"""
select tree_id, 2 * node_id + (v > threshold)::int node_id, finish_seq
from forest_at_{depth} join forest_cut_{depth} c using (tree_id, node_id) join forest_points using (finish_seq) where j = f"""
        parts[f"forest_way_{depth + 1}"] = f"""
select flow_id, tree_id, case when f is null then node_id else 2 * node_id + (v > threshold)::int end node_id
from forest_way_{depth} left join forest_cut_{depth} using (tree_id, node_id) left join (select flow_id, j f, v from forest_values) using (flow_id, f)"""
    parts["forest_nodes"] = " union all ".join(
        f"""select tree_id, node_id, coalesce(f, -1)::int feature, coalesce(threshold, 0.0) threshold,
  case when f is null then {depth} + {path} else 0.0::double end path from forest_size_{depth} left join forest_cut_{depth} using (tree_id, node_id)"""
        for depth in range(limit + 1)
    )
    size = p.warmup_flows
    scale = 2 * (math.log(size - 1) + 0.5772156649015329) - 2 * (size - 1) / size
    parts["forest_raw"] = f"""select flow_id, -pow(2.0::double, -avg(path) / {scale!r}::double) raw
from forest_way_{limit} join forest_nodes using (tree_id, node_id) group by flow_id"""
    parts["forest_scores"] = f"""
select f.*, case when finish_seq >= (select max(finish_seq) from warm) then raw - (
  select quantile_cont(raw, {p.contamination}) from forest_raw semi join warm using (flow_id)) end score
from features f join forest_raw using (flow_id)"""
    return parts


FRAGMENTS["flow_payloads"] = f"""
select finish_seq * 8 + {DETECTORS.index('anomaly')} arrival_seq, 'anomaly' detector, {joined_pairs(_pairs(['verdict', 'score']))} stated,
  {joined_pairs(_pairs(T.SCORED_FEATURES))} features from scored
union all select finish_seq * 8 + {DETECTORS.index('llm')}, 'llm',
  {joined_pairs(_pairs(['available', 'attack_type', 'confidence', 'error'], reasoning='review_reasoning'))}, null from reviews"""
FRAGMENTS["split"] = """
with c as (select label, count(*) k from usable group by 1),
s as (select sum(k) total, least(greatest(count(*), round_even(0.2 * sum(k), 0)), sum(k) - count(*)) size from c),
e as (select label, k, k * size / total exact, least(greatest(1, floor(k * size / total)), k - 1) base, size from c, s),
m as (select *, size - sum(base) over () short from e),
q as (select label, base + case
    when base < k - 1 and row_number() over (partition by base < k - 1 order by base - exact, label) <= short then 1
    when base > 1 and row_number() over (partition by base > 1 order by base - exact desc, label desc) <= -short then -1 else 0 end quota from m)
select id, u.label, row_number() over (partition by u.label order by md5(id || ':42'), id) <= quota in_test from usable u join q using (label)"""


def _needs(sql: str, own: str | None, done: list[str]) -> None:
    for word in dict.fromkeys(_WORD.findall(sql)):
        if word in FRAGMENTS and word != own and word not in done:
            _needs(FRAGMENTS[word], word, done)
            if word not in done:
                done.append(word)


def with_parts(sql: str) -> str:
    """Put the parts a statement names, and those they name, in front of it."""
    parts: list[str] = []
    _needs(sql, None, parts)
    if not parts:
        return sql
    return "with " + ",\n".join(f"{name} as materialized ({FRAGMENTS[name]})" for name in parts) + "\n" + sql

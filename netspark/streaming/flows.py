"""Continuous flow assembly: packets in, finished flows out.

State per flow key is one open flow as partial aggregates (35 doubles), never its packets; keys share the
state rows of their buckets, and a bucket's packets are folded together by array operations. A flow is emitted when a packet closes it, or when the watermark passes its last packet by
the idle timeout. The features follow from the aggregates as column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netspark.operators.flows import _LEFTOVER, KEY, closes, with_flow_key
from netspark.params import FlowParams
from netspark.schemas import FEATURE_COLUMNS, IDENTITY_COLUMNS
from netspark.session import shared_dir

# A measure is (count, mean, sum of squared deviations, min, max), which merges exactly.
_MEASURES = ["fwd_size", "bwd_size", "fwd_header", "bwd_header", "gap"]
_FLAGS = ["S", "A", "F", "R", "P", "U"]
_PLAIN = ["packets", "payload", "zero_payload", "flagged", *_FLAGS]

_STATE = (
    "flow_id bigint, src_ip string, dst_ip string, src_port int, dst_port int, start_us bigint, "
    "last_us bigint, last_seq bigint, sums binary"
)
_FLOW = f"protocol int, finished_cleanly boolean, total_packets bigint, {_STATE}"
_STATE_COLUMNS = [c.strip().split(" ")[0] for c in _STATE.split(", ")]
_EMPTY = [0.0, 0.0, 0.0, 0.0, 0.0]
_PACKET_COLUMNS = [
    "arrival_seq", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "size", "header_size", "payload_size", "tcp_flags", "closes",
]


def _measure(values: np.ndarray) -> list[float]:
    n = len(values)
    if n == 0:
        return list(_EMPTY)
    mean = float(values.sum()) / n
    deviation = values - mean
    return [float(n), mean, float(deviation @ deviation), float(values.min()), float(values.max())]


def _merge(a, b) -> list[float]:
    if a[0] == 0:
        return list(b)
    if b[0] == 0:
        return list(a)
    n = a[0] + b[0]
    delta = b[1] - a[1]
    return [n, a[1] + delta * b[0] / n, a[2] + b[2] + delta * delta * a[0] * b[0] / n, min(a[3], b[3]), max(a[4], b[4])]


def _summarise(p: dict[str, np.ndarray], part: slice, held: tuple | None) -> tuple:
    """Partial aggregates of consecutive packets of one flow, which ``held`` may already have begun."""
    src_ip, src_port, times = p["src_ip"][part], p["src_port"][part], p["ts_us"][part]
    opener = (src_ip[0], src_port[0]) if held is None else (held[1], held[3])
    forward = (src_ip == opener[0]) & (src_port == opener[1])
    path = times if held is None else np.concatenate(([held[6]], times))
    gaps = np.maximum(np.diff(path), 0) / 1e6
    size, header, payload = p["size"][part], p["header_size"][part], p["payload_size"][part]
    flags = [f for f in p["tcp_flags"][part] if f is not None]
    plain = [float(len(times)), float(payload.sum()), float((payload == 0).sum()), float(len(flags))]
    plain += [float(sum(letter in f for f in flags)) for letter in _FLAGS]
    parts = [size[forward], size[~forward], header[forward], header[~forward], gaps]
    seq = p["arrival_seq"][part]
    return (
        int(seq[0]), str(src_ip[0]), str(p["dst_ip"][part][0]), int(src_port[0]), int(p["dst_port"][part][0]),
        int(times[0]), int(times[-1]), int(seq[-1]), [*plain, *(x for m in parts for x in _measure(m))],
    )


def _extend(old: tuple, new: tuple) -> tuple:
    a, b, n = old[8], new[8], len(_PLAIN)
    sums = [x + y for x, y in zip(a[:n], b[:n])]
    for i in range(n, len(a), len(_EMPTY)):
        sums += _merge(a[i : i + len(_EMPTY)], b[i : i + len(_EMPTY)])
    return (*old[:6], *new[6:8], sums)


def _pack(flow: tuple) -> tuple:
    return (*flow[:8], np.array(flow[8]).tobytes())


def _unpack(flow: tuple) -> tuple:
    return (*flow[:8], np.frombuffer(flow[8]).tolist())


@F.pandas_udf(ArrayType(DoubleType()))
def _sums(packed: pd.Series) -> pd.Series:
    return packed.map(np.frombuffer)


def _arrays(rows: pd.DataFrame, order: np.ndarray) -> dict[str, np.ndarray]:
    p = {c: rows[c].to_numpy()[order] for c in _PACKET_COLUMNS}
    for c in ("size", "header_size", "payload_size"):
        p[c] = p[c].astype(float)
    return p


def _take(p: dict[str, np.ndarray], held: tuple | None, timeout_us: int, protocol: int) -> tuple[list[tuple], tuple | None]:
    """The flows that a key's next packets, in order, finish, and the one that stays open."""
    done, times, ends = [], p["ts_us"], p["closes"].astype(bool)
    if held is not None and times[0] - held[6] >= timeout_us:
        done.append((protocol, False, int(held[8][0]), *_pack(held)))
        held = None
    breaks = np.flatnonzero(ends[:-1] | (np.diff(times) >= timeout_us)) + 1
    edges = [0, *breaks.tolist(), len(times)]
    for i in range(len(edges) - 1):
        part = slice(edges[i], edges[i + 1])
        summary = _summarise(p, part, held)
        held = summary if held is None else _extend(held, summary)
        closed = bool(ends[edges[i + 1] - 1])
        if closed or i < len(edges) - 2:
            done.append((protocol, closed, int(held[8][0]), *_pack(held)))
            held = None
    return done, held


#: Flow keys share the state of their bucket, so a call of the Python worker serves many of them.
BUCKETS = 1024
ROWS_PER_BUCKET = 16_384
_HELD_COLUMNS = [*KEY, *(c for c in _STATE_COLUMNS if c != "sums")]


def _codes(*columns: pd.DataFrame) -> list[np.ndarray]:
    """The flow keys of several frames as numbers, equal where the keys are."""
    keys = pd.concat([c[KEY] for c in columns], ignore_index=True)
    code = np.zeros(len(keys), dtype=np.int64)
    for name in KEY:
        part, values = pd.factorize(keys[name], use_na_sentinel=False)
        code = pd.factorize(code * max(len(values), 1) + part)[0]
    return np.split(code, np.cumsum([len(c) for c in columns])[:-1])


def _segment_measure(values: np.ndarray, mask: np.ndarray, starts: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """``_measure`` of the masked values of each segment, a row each."""
    n = np.add.reduceat(mask.astype(float), starts)
    some = n > 0
    mean = np.add.reduceat(np.where(mask, values, 0.0), starts) / np.where(some, n, 1.0)
    deviation = np.where(mask, values - mean[segment], 0.0)
    low = np.minimum.reduceat(np.where(mask, values, np.inf), starts)
    high = np.maximum.reduceat(np.where(mask, values, -np.inf), starts)
    spread = np.add.reduceat(deviation * deviation, starts)
    return np.where(some[:, None], np.column_stack([n, mean, spread, low, high]), 0.0)


def _merge_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``_extend`` of the sums of many flows, a row each."""
    out, n = a.copy(), len(_PLAIN)
    out[:, :n] += b[:, :n]
    for i in range(n, a.shape[1], len(_EMPTY)):
        x, y = a[:, i : i + len(_EMPTY)], b[:, i : i + len(_EMPTY)]
        total = x[:, 0] + y[:, 0]
        safe, delta = np.where(total > 0, total, 1.0), y[:, 1] - x[:, 1]
        both = np.column_stack(
            [total, x[:, 1] + delta * y[:, 0] / safe, x[:, 2] + y[:, 2] + delta * delta * x[:, 0] * y[:, 0] / safe,
             np.minimum(x[:, 3], y[:, 3]), np.maximum(x[:, 4], y[:, 4])]
        )
        out[:, i : i + len(_EMPTY)] = np.where((x[:, 0] == 0)[:, None], y, np.where((y[:, 0] == 0)[:, None], x, both))
    return out


_WIDTH = len(_PLAIN) + len(_MEASURES) * len(_EMPTY)


def _nothing_held() -> tuple[pd.DataFrame, np.ndarray]:
    return pd.DataFrame(columns=_HELD_COLUMNS), np.empty((0, _WIDTH))


def _pack_held(held: pd.DataFrame, sums: np.ndarray) -> bytes:
    table = pa.Table.from_pandas(held, preserve_index=False)
    table = table.append_column("sums", pa.array(list(sums), pa.list_(pa.float64())))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack_held(packed: bytes) -> tuple[pd.DataFrame, np.ndarray]:
    table = pa.ipc.open_stream(packed).read_all()
    sums = table["sums"].combine_chunks().flatten().to_numpy().reshape(-1, _WIDTH)
    return table.drop_columns(["sums"]).to_pandas(), sums


def _finished(flows: pd.DataFrame, sums: np.ndarray, closed: np.ndarray) -> pd.DataFrame:
    done = flows[["protocol", *(c for c in _STATE_COLUMNS if c != "sums")]].copy()
    done.insert(1, "finished_cleanly", closed)
    done.insert(2, "total_packets", sums[:, 0].astype(np.int64))
    done["sums"] = [row.tobytes() for row in sums]
    return done


def _take_all(rows: pd.DataFrame, held: pd.DataFrame, held_sums: np.ndarray, timeout_us: int):
    """``_take`` for the packets of many keys at once: finished flows, then the open ones and their sums."""
    code, held_code = _codes(rows, held)
    order = np.lexsort((rows["arrival_seq"].to_numpy(), code))
    code, p = code[order], _arrays(rows, order)
    keys = {c: rows[c].to_numpy()[order] for c in KEY}
    times, ends = p["ts_us"].astype(np.int64), p["closes"].astype(bool)
    same_key, steps = code[1:] == code[:-1], np.diff(times)
    starts = np.concatenate(([0], np.flatnonzero(~same_key | ends[:-1] | (steps >= timeout_us)) + 1))
    lasts = np.concatenate((starts[1:], [len(times)])) - 1
    segment = np.repeat(np.arange(len(starts)), lasts - starts + 1)
    first_of_key = np.concatenate(([True], code[starts[1:]] != code[starts[1:] - 1]))
    last_of_key = np.concatenate((first_of_key[1:], [True]))

    # A key's first segment goes on with its held flow, unless that has been idle for too long.
    at = np.full(int(max(code.max(), held_code.max(initial=0))) + 1, -1)
    at[held_code] = np.arange(len(held_code))
    partner = np.where(first_of_key, at[code[starts]], -1)
    held_last = held["last_us"].to_numpy(dtype=np.int64)
    near = np.zeros(len(starts), dtype=bool)
    asked = partner >= 0
    near[asked] = times[starts[asked]] - held_last[partner[asked]] < timeout_us
    joined, idle = partner[near], partner[asked & ~near]

    flows = {c: keys[c][starts] for c in KEY}
    flows |= {
        "flow_id": p["arrival_seq"][starts], "src_ip": p["src_ip"][starts], "dst_ip": p["dst_ip"][starts],
        "src_port": p["src_port"][starts], "dst_port": p["dst_port"][starts], "start_us": times[starts],
    }
    for name in ("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "start_us"):
        flows[name] = flows[name].copy()
        flows[name][near] = held[name].to_numpy()[joined]
    flows |= {"last_us": times[lasts], "last_seq": p["arrival_seq"][lasts]}

    forward = (p["src_ip"] == flows["src_ip"][segment]) & (p["src_port"] == flows["src_port"][segment])
    gaps, has_gap = np.zeros(len(times)), np.ones(len(times), dtype=bool)
    gaps[1:] = np.maximum(steps, 0) / 1e6
    has_gap[starts] = near
    gaps[starts[near]] = np.maximum(times[starts[near]] - held_last[joined], 0) / 1e6

    flag, texts = pd.factorize(p["tcp_flags"], use_na_sentinel=False)
    known = np.array([[float(isinstance(t, str)), *(float(isinstance(t, str) and f in t) for f in _FLAGS)] for t in texts])
    payload, one = p["payload_size"], np.ones(len(times))
    plain = np.column_stack([one, payload, payload == 0, known[flag]])
    forward = forward.astype(bool)
    measured = [
        (p["size"], forward), (p["size"], ~forward), (p["header_size"], forward), (p["header_size"], ~forward), (gaps, has_gap),
    ]
    sums = np.column_stack([np.add.reduceat(plain, starts), *(_segment_measure(v, m, starts, segment) for v, m in measured)])
    sums[near] = _merge_rows(held_sums[joined], sums[near])

    closed = ends[lasts]
    over = closed | ~last_of_key
    flows = pd.DataFrame(flows)[_HELD_COLUMNS]
    stays = np.ones(len(held), dtype=bool)
    stays[joined] = stays[idle] = False
    done = [_finished(held.iloc[idle], held_sums[idle], np.zeros(len(idle), dtype=bool)), _finished(flows[over], sums[over], closed[over])]
    parts = [f for f in (held[stays], flows[~over]) if len(f)]
    left = pd.concat(parts, ignore_index=True) if parts else _nothing_held()[0]
    return done, left, np.concatenate([held_sums[stays], sums[~over]])


def _assemble(params: FlowParams):
    timeout_us = params.idle_timeout_us
    if timeout_us is None:
        raise ValueError("a stream needs an idle timeout: it has no end at which to flush flows")

    def assemble(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if int(key[0]) < 0:  # a heartbeat only moves the watermark
            for _ in batches:
                pass
            return
        done = []
        held, sums = _unpack_held(state.get[0]) if state.exists else _nothing_held()
        if not state.hasTimedOut:
            more, held, sums = _take_all(pd.concat(list(batches), ignore_index=True), held, sums, timeout_us)
            done += more
        # Packets of other keys do not keep a flow open: what the watermark has passed is done.
        passed = held["last_us"].to_numpy(dtype=np.int64) + timeout_us <= state.getCurrentWatermarkMs() * 1000
        done.append(_finished(held[passed], sums[passed], np.zeros(int(passed.sum()), dtype=bool)))
        held, sums = held[~passed], sums[~passed]
        if len(held):
            state.update((_pack_held(held, sums),))
            # A timer must lie ahead of the watermark.
            due_ms = (int(held["last_us"].min()) + timeout_us) // 1000
            state.setTimeoutTimestamp(max(due_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        for flows in done:
            if len(flows):
                yield flows

    return assemble


class _Reorder(StatefulProcessor):
    """One flow key: packets that wait for the watermark, the open flow, and one timer for whichever is due first."""

    def __init__(self, timeout_us: int, packets: StructType):
        self.timeout_us, self.packets = timeout_us, packets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.packets)
        self.open = handle.getValueState("open", _STATE)

    def _wake(self, due_us: int, sooner: bool = False) -> None:
        """Set the one timer; with `sooner` only if it comes before the one that is set."""
        due, set_for = -(-due_us // 1000), list(self.handle.listTimers())
        if sooner and set_for and min(set_for) <= due:
            return
        for timer in set_for:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))[self.packets.names].astype(object)
        self.waiting.appendList(list(frame.where(frame.notna(), None).itertuples(index=False, name=None)))
        self._wake(int(frame["ts_us"].min()), sooner=True)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, protocol, done = timerValues.getCurrentWatermarkInMs() * 1000, int(key[4]), []
        held = _unpack(tuple(self.open.get())) if self.open.exists() else None
        rows = pd.DataFrame(list(self.waiting.get()), columns=self.packets.names).sort_values("arrival_seq", kind="stable")
        # By arrival number, as far as the watermark has passed every packet.
        ahead = np.flatnonzero(rows["ts_us"].to_numpy() > passed)
        ready = int(ahead[0]) if len(ahead) else len(rows)
        if ready:
            more, held = _take(_arrays(rows, np.arange(ready)), held, self.timeout_us, protocol)
            done += more
            left = rows.iloc[ready:].astype(object)
            if len(left):
                self.waiting.put(list(left.where(left.notna(), None).itertuples(index=False, name=None)))
            else:
                self.waiting.clear()
        if held is not None and ready == len(rows) and held[6] + self.timeout_us <= passed:
            done.append((protocol, False, int(held[8][0]), *_pack(held)))
            held = None
        if held is None:
            self.open.clear()
        else:
            self.open.update(_pack(held))
        if ready < len(rows):
            self._wake(int(rows["ts_us"].iloc[ready]))
        elif held is not None:
            self._wake(held[6] + self.timeout_us)
        if done:
            yield pd.DataFrame(done, columns=["protocol", "finished_cleanly", "total_packets", *_STATE_COLUMNS])

    def close(self) -> None:
        pass


def stream_flows_reordered(packets: DataFrame, params: FlowParams, delay: str = "10 seconds") -> DataFrame:
    """Finished flows of a packet stream whose micro-batches come out of order, the same as those of the ordered table.

    Packets wait in the state until the watermark, ``delay`` behind the newest packet, has passed them and all of their key with a
    smaller arrival number; then they are taken by arrival number. ``delay`` covers how late packets come and how far times
    run against arrival numbers. What comes later is dropped and counted in the query's progress. The state of a key ends
    with its last flow. Start the query inside ``windows.rocksdb_state``.
    """
    if params.idle_timeout_us is None:
        raise ValueError("a stream needs an idle timeout: it has no end at which to flush flows")
    keyed = with_flow_key(packets).withColumn("closes", closes(F.col("tcp_flags")))
    timed = keyed.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", delay)
    kept = StructType([keyed.schema[c] for c in _PACKET_COLUMNS])
    finished = timed.select(*KEY, *_PACKET_COLUMNS, "ts").groupBy(*KEY).transformWithStateInPandas(_Reorder(params.idle_timeout_us, kept), _FLOW, "append", "eventTime")
    finish = F.when(F.col("finished_cleanly"), F.col("last_seq")).otherwise(F.lit(_LEFTOVER).cast("bigint") + F.col("flow_id"))
    return finished.withColumn("finish_seq", finish)


def stream_flows(packets: DataFrame, params: FlowParams, delay: str = "10 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Finished flows of a packet stream. Rows later than ``delay`` behind the newest are dropped.

    Keys are dealt over ``buckets``, each with one state row of its open flows. A bucket's packets of a micro-batch are in
    one task at a time, so more packets a micro-batch ask for more buckets; a checkpoint keeps the number it began with.
    """
    keyed = with_flow_key(packets).withColumn("closes", closes(F.col("tcp_flags")))
    timed = keyed.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", delay)
    bucket = F.when(F.col("protocol") < 0, F.lit(-1)).otherwise(F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int"))
    dealt = timed.select(bucket.alias("bucket"), *KEY, *(c for c in _PACKET_COLUMNS if c not in KEY), "ts")
    finished = dealt.groupBy("bucket").applyInPandasWithState(
        _assemble(params), _FLOW, "flows binary", "append", GroupStateTimeout.EventTimeTimeout
    )
    finish = F.when(F.col("finished_cleanly"), F.col("last_seq")).otherwise(F.lit(_LEFTOVER).cast("bigint") + F.col("flow_id"))
    return finished.withColumn("finish_seq", finish)


def streamed_features(finished: DataFrame, params: FlowParams = FlowParams()) -> DataFrame:
    """The feature columns of streamed flows, from their packed aggregates.

    For the written flow table, or each batch of a ``foreachBatch`` sink.
    """

    def plain(name: str) -> Column:
        return F.col("sums")[_PLAIN.index(name)]

    def stat(measure: str, name: str) -> Column:
        at = len(_PLAIN) + _MEASURES.index(measure) * len(_EMPTY)
        n, mean, spread, low, high = (F.col("sums")[at + i] for i in range(len(_EMPTY)))
        if name == "std":
            return F.when(n >= 2, F.sqrt(spread / (n - 1))).otherwise(F.lit(0.0))
        return {"n": n, "mean": mean, "min": low, "max": high, "sum": F.round(mean * n)}[name]

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    forward, backward = stat("fwd_size", "n"), stat("bwd_size", "n")
    duration = F.greatest((F.col("last_us") - F.col("start_us")) / F.lit(1e6), F.lit(1e-6))
    total_bytes = stat("fwd_size", "sum") + stat("bwd_size", "sum")
    names = dict(zip(_FLAGS, ["syn", "ack", "fin", "rst", "psh", "urg"]))
    counts = {
        "total_packets": plain("packets"), "total_bytes": total_bytes, "fwd_packets": forward, "bwd_packets": backward,
        "fwd_bytes": stat("fwd_size", "sum"), "bwd_bytes": stat("bwd_size", "sum"),
        **{f"{name}_count": plain(letter) for letter, name in names.items()},
    }
    columns = {
        "duration_seconds": duration,
        "bytes_per_second": total_bytes / duration,
        "packets_per_second": plain("packets") / duration,
        "bwd_fwd_packet_ratio": ratio(backward, forward),
        "fwd_packet_share": ratio(forward, plain("packets")),
        "iat_cv": ratio(stat("gap", "std"), stat("gap", "mean")),
        "syn_ratio": ratio(plain("S"), plain("flagged")),
        "ack_ratio": ratio(plain("A"), plain("flagged")),
        "avg_payload_size": plain("payload") / plain("packets"),
        "zero_payload_ratio": plain("zero_payload") / plain("packets"),
        "is_well_known_dst_port": (F.col("dst_port") < 1024).cast("int"),
        **{name: value.cast("bigint") for name, value in counts.items()},
    }
    for s in ("mean", "max", "min", "std"):
        columns[f"iat_{s}"] = stat("gap", s)
        for d in ("fwd", "bwd"):
            columns[f"{d}_pkt_len_{s}"] = stat(f"{d}_size", s)
            columns[f"{d}_header_len_{s}"] = stat(f"{d}_header", s)
    features = [columns.get(c, F.col(c)).alias(c) for c in FEATURE_COLUMNS]
    kept = finished.filter(F.col("total_packets") >= params.min_packets).withColumn("sums", _sums("sums"))
    return kept.select(
        "flow_id", "finish_seq", *IDENTITY_COLUMNS, "start_us", "last_us", "finished_cleanly", *features
    )


def heartbeat(packets: DataFrame, ahead_us: int) -> DataFrame:
    """One row after the newest packet: on arrival it moves the watermark past every open flow."""
    fields = {f.name: f.dataType for f in packets.schema.fields}
    last = packets.agg(F.max("ts_us").alias("ts_us"), F.max("arrival_seq").alias("arrival_seq"))
    values = {
        "arrival_seq": F.col("arrival_seq") + 1, "ts_us": F.col("ts_us") + ahead_us, "protocol": F.lit(-1),
        "src_ip": F.lit("0.0.0.0"), "dst_ip": F.lit("0.0.0.0"),
    }
    return last.select(*[values.get(n, F.lit(None) if n == "tcp_flags" else F.lit(0)).cast(t).alias(n) for n, t in fields.items()])


def stream_flows_once(packets: DataFrame, params: FlowParams) -> DataFrame:
    """A stored packet table through the stream, to its end: all data, then a heartbeat to flush."""
    import uuid

    spark = packets.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    span = packets.agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b"), F.count(F.lit(1)).alias("n")).first()
    delay_us = max(span["b"] - span["a"], 0) + 1_000_000
    packets.write.parquet(f"{base}/in")
    heartbeat(packets, 2 * delay_us + params.idle_timeout_us).write.mode("append").parquet(f"{base}/in")
    source = spark.readStream.schema(packets.schema).parquet(f"{base}/in")
    # The stored rows are in no particular time order, so nothing is late within their own span.
    buckets = max(BUCKETS, span["n"] // ROWS_PER_BUCKET)
    finished = stream_flows(source, params, f"{delay_us // 1_000_000 + 1} seconds", buckets)
    run = (
        finished.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start(f"{base}/out")
    )
    run.awaitTermination()
    return spark.read.schema(finished.schema).parquet(f"{base}/out")

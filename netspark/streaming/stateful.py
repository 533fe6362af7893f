"""Per-key folds over streams: password guessing, incidents, alert limits, verdict changes.

The state of a key is small and bounded: the attempt times inside one window, an open
flag with a number, one time, or one verdict. Rows of a micro-batch are taken in arrival order. Alert limits and verdict changes
forget keys by timers of event time; start them inside ``windows.rocksdb_state``, which their state needs.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from netspark.operators.incidents import incident_id, incident_key, never_counts
from netspark.operators.windows import TRIPLE, watched
from netspark.params import AlertParams, BruteForceParams
from netspark.schemas import ATTACK, NORMAL, OPEN, RESOLVED, SUSPICIOUS, UNAVAILABLE


def _rows(batches: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    frames = list(batches)
    return (frames[0] if len(frames) == 1 else pd.concat(frames)).sort_values(order, kind="stable")


def _timeout(idle_seconds: float | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.ProcessingTimeTimeout


def stream_brute_force(
    attempts: DataFrame, p: BruteForceParams = BruteForceParams(), idle_seconds: float | None = None
) -> DataFrame:
    """Attempts in the window, verdict and episode per attempt; times must not run backwards per triple.

    A triple without attempts for ``idle_seconds`` of processing time is forgotten, and its episodes start again at
    one; None keeps every triple. For triggers that go on: a processing-time timeout never lets availableNow end.
    """
    window_us, hot, warm = p.window_us, p.attack_attempts, p.suspicious_attempts

    def fold(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _rows(batches, "ts_us")
        times, episode, was_hot = state.get if state.exists else ([], 0, False)
        recent = deque(times)
        counts, episodes = [], []
        at = rows["ts_us"].to_numpy()
        for t, peers in zip(*(x.tolist() for x in np.unique(at, return_counts=True)), strict=True):
            recent.extend([t] * peers)
            while recent and recent[0] < t - window_us:
                recent.popleft()
            is_hot = len(recent) >= hot
            episode += int(is_hot and not was_hot)
            was_hot = is_hot
            counts += [len(recent)] * peers
            episodes += [episode] * peers
        state.update((list(recent), episode, was_hot))
        if idle_seconds is not None:
            state.setTimeoutDuration(int(idle_seconds * 1000))
        verdict = [ATTACK if n >= hot else SUSPICIOUS if n >= warm else NORMAL for n in counts]
        yield pd.DataFrame(
            {
                "flow_id": rows["flow_id"].to_numpy(), "ts_us": at, "src_ip": key[0], "dst_ip": key[1], "dst_port": key[2],
                "attempts": counts, "repeat_offender_count": episodes, "verdict": verdict,
            }
        )

    kept = attempts.filter(watched(F.col("dst_port"), p)).select("flow_id", "ts_us", *TRIPLE)
    return kept.groupBy(*TRIPLE).applyInPandasWithState(
        fold,
        "flow_id bigint, ts_us bigint, src_ip string, dst_ip string, dst_port int, attempts bigint, "
        "repeat_offender_count bigint, verdict string",
        "times array<bigint>, episode int, was_hot boolean",
        "append",
        _timeout(idle_seconds),
    )


def stream_correlate(rows: DataFrame) -> DataFrame:
    """Evidence and actions in one stream to attached rows with incident number and status.

    ``rows`` has the evidence columns plus ``key`` and ``action`` (null on evidence).
    """

    def fold(key, batches, state: GroupState):
        frame = _rows(batches, "arrival_seq")
        number, status = state.get if state.exists else (0, None)
        out = []
        for seq, verdict, action in zip(frame["arrival_seq"], frame["verdict"], frame["action"]):
            if isinstance(action, str):
                if status is None:
                    continue
                status = RESOLVED if action == "resolve" else OPEN
                out.append((int(seq), key[0], number, "action", False, status))
                continue
            opens = verdict in (SUSPICIOUS, ATTACK)
            is_new = opens and status != OPEN
            if is_new:
                number, status = number + 1, OPEN
            if opens or (verdict == UNAVAILABLE and status == OPEN):
                out.append((int(seq), key[0], number, "evidence", is_new, status))
        state.update((number, status))
        if out:
            yield pd.DataFrame(out, columns=["arrival_seq", "key", "incident_no", "kind", "is_new", "status_after"])

    counted = rows.filter(F.col("action").isNotNull() | ~never_counts(F.col("verdict")))
    keyed = counted.withColumn("key", F.coalesce("key", incident_key(F.col("src_ip"))))
    attached = keyed.select("key", "arrival_seq", "verdict", "action").groupBy("key").applyInPandasWithState(
        fold,
        "arrival_seq bigint, key string, incident_no bigint, kind string, is_new boolean, status_after string",
        "number bigint, status string",
        "append",
        GroupStateTimeout.NoTimeout,
    )
    return attached.withColumn("incident_id", incident_id(F.col("key"), F.col("incident_no")))


class _Keyed(StatefulProcessor):
    """One value per key, forgotten by a timer of event time."""

    schema = "value bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.schema)

    def keep(self, value: tuple, until_us: int | None) -> None:
        """The value, until the watermark has passed `until_us`."""
        self.value.update(value)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if until_us is not None:
            self.handle.registerTimer(-(-until_us // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Alerts(_Keyed):
    schema = "last bigint"

    def __init__(self, limit_us: int):
        self.limit_us = limit_us

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts_us", "seq"])
        times = frame["ts_us"].to_numpy()
        sent = np.zeros(len(times), bool)
        last = self.value.get()[0] if self.value.exists() else None
        at = 0 if last is None else int(np.searchsorted(times, last + self.limit_us))
        while at < len(times):  # from one sent alert to the next
            sent[at], last = True, int(times[at])
            at = max(at + 1, int(np.searchsorted(times, last + self.limit_us)))
        # Once the limit has run out, an event is sent whether the last one is known or not.
        self.keep((last,), last + self.limit_us)
        yield pd.DataFrame({"seq": frame["seq"].to_numpy(), "ts_us": times, "src_ip": key[0], "sent": sent})


def stream_alerts(events: DataFrame, p: AlertParams = AlertParams(), delay: str = "0 seconds") -> DataFrame:
    """Attack events with ``sent``: at most one per source and rate limit; times must not run backwards per source.

    A source is in the state while its limit runs, by event time, which changes no result and makes a replay the same as the
    live run. Events behind the watermark, which is ``delay`` behind the newest event, are dropped.
    """
    timed = events.select("src_ip", "seq", "ts_us", F.timestamp_micros("ts_us").alias("_at")).withWatermark("_at", delay)
    return timed.groupBy("src_ip").transformWithStateInPandas(
        _Alerts(p.rate_limit_us), "seq bigint, ts_us bigint, src_ip string, sent boolean", "append", "eventTime"
    )


class _Transitions(_Keyed):
    schema = "verdict string"

    def __init__(self, columns: list[str], order: str, to: str | None, idle_us: int | None):
        self.columns, self.order, self.to, self.idle_us = columns, order, to, idle_us

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.order)
        before = self.value.get()[0] if self.value.exists() else NORMAL
        previous = frame["verdict"].shift(1)
        previous.iloc[0] = before
        self.keep((frame["verdict"].iloc[-1],), None if self.idle_us is None else int(frame["ts_us"].max()) + self.idle_us)
        changed = frame["verdict"] != previous
        if self.to is not None:
            changed &= frame["verdict"] == self.to
        if changed.any():
            yield frame.assign(previous_verdict=previous)[changed][[*self.columns, "previous_verdict"]]


def stream_transitions(
    results: DataFrame, keys: list[str], order: str, to: str | None = ATTACK, idle_seconds: float | None = None, delay: str = "0 seconds"
) -> DataFrame:
    """Rows whose verdict differs from the key's previous one, like ``verdict_transitions``; ``results`` has ``ts_us``.

    The state of a key is its last verdict. Micro-batches must follow ``order``, as the window detectors' do. With
    ``idle_seconds`` a key without results for so long, by event time, counts as normal again.
    """
    timed = results.withColumn("_at", F.timestamp_micros("ts_us")).withWatermark("_at", delay)
    by = keys or ["_all"]
    if not keys:
        timed = timed.withColumn("_all", F.lit(0))
    out = StructType([*results.schema.fields, StructField("previous_verdict", StringType())])
    idle_us = None if idle_seconds is None else int(idle_seconds * 1e6)
    return timed.groupBy(*by).transformWithStateInPandas(_Transitions(results.columns, order, to, idle_us), out, "append", "eventTime")

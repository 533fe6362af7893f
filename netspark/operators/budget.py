"""The review budget over a trailing window, with its bounded queue of flows that wait for a call.

A flow is called at once if fewer than ``calls_per_minute`` calls lie in the closed window that ends at it. Otherwise it
waits, if the queue has room, and a poll at every multiple of ``poll_seconds`` calls the longest waiting flow if the
budget allows. Rows of one instant come in order, before a poll at that instant.

Each answer depends on the calls before it, so time is cut into chunks that are folded side by side: first as if
nothing had come before, then again, each with what the chunk before has handed on, for the chunks for which that has
changed, until nothing changes. What is handed on is small: the calls of one window and the queue. A chunk whose
traffic is below the budget for a window hands on the same whatever came before, so two or three rounds do; a budget that
is used up without a break takes a round per chunk at most, and the result is always that of one fold.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netspark.params import VerdictParams
from netspark.session import stage

CALLED, RETRIED, WAITING, DROPPED = "called", "retried", "waiting", "dropped"
#: What a chunk hands on: call times in the window, and the places in order of the rows that wait.
STATE = "calls array<bigint>, queue array<bigint>"
FOLDED = f"chunk bigint, {STATE}, used string, decided array<struct<place:bigint,called_us:bigint,outcome:string>>"


class Limiter:
    """The budget and the queue between two instants."""

    def __init__(self, p: VerdictParams, calls=(), queue=()):
        self.p, self.calls, self.queue = p, deque(calls), deque(queue)

    def free(self, now: int) -> bool:
        while self.calls and self.calls[0] < now - self.p.budget_us:
            self.calls.popleft()
        return len(self.calls) < self.p.calls_per_minute

    def fold(self, times: np.ndarray, places: np.ndarray, start: int, end: int) -> Iterator[tuple[int, int, str]]:
        """(place, time of the call, outcome) of each call in [start, end), for arrivals in order; steps follow the calls, not the arrivals."""
        poll, window, i, n = self.p.poll_us, self.p.budget_us, 0, len(times)
        tick = -(-start // poll) * poll
        while True:
            arrival = int(times[i]) if i < n else end
            due = tick if self.queue else end
            if arrival >= end and due >= end:
                break
            now = min(arrival, due)
            if self.free(now):
                self.calls.append(now)
                if arrival <= due:
                    yield int(places[i]), now, CALLED
                    i += 1
                else:
                    yield self.queue.popleft(), now, RETRIED
                    tick += poll
                continue
            # Up to the oldest call's end nothing can be called: arrivals wait while there is room, polls find no call.
            until = self.calls[0] + window
            j = int(np.searchsorted(times, min(until, end - 1), "right"))
            room = max(0, self.p.queue_length - len(self.queue))
            self.queue.extend(places[i : min(j, i + room)].tolist())
            i = max(i, j)
            tick = max(tick, (until // poll + 1) * poll)
        self.free(end)


def _fold(p: VerdictParams):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                limiter = Limiter(p, row.calls, row.queue)
                none = np.zeros(0, np.int64)
                times, places = (none, none) if row.times is None else (np.asarray(row.times), np.asarray(row.places))
                decided = [{"place": a, "called_us": b, "outcome": c} for a, b, c in limiter.fold(times, places, row.chunk * p.chunk_us, (row.chunk + 1) * p.chunk_us)]
                out.append((row.chunk, list(limiter.calls), list(limiter.queue), row.used, decided))
            yield pd.DataFrame(out, columns=["chunk", "calls", "queue", "used", "decided"])

    return run


def schedule(rows: DataFrame, order: str = "finish_seq", p: VerdictParams = VerdictParams()) -> DataFrame:
    """The rows with ``outcome`` (called, retried, waiting, dropped) and ``called_us``; ``order`` is unique and parts equal times.

    A chunk's rows are two arrays in one task: choose ``chunk_seconds`` by the rate of review candidates. Rows that their own
    instant is too full for are dropped before, so an instant sends what can be called or wait at most.
    """
    most = p.calls_per_minute + p.queue_length
    at = rows.select(F.col("ts_us"), F.col(order).cast("bigint").alias("place")).withColumn("_rank", F.row_number().over(Window.partitionBy("ts_us").orderBy("place")))
    kept = at.filter(F.col("_rank") <= most).withColumn("chunk", F.expr(f"(ts_us - pmod(ts_us, {p.chunk_us}L)) div {p.chunk_us}L"))
    ordered = F.sort_array(F.collect_list(F.struct("ts_us", "place")))
    packed = kept.groupBy("chunk").agg(ordered.alias("_rows"))
    packed = stage(packed.select("chunk", F.col("_rows.ts_us").alias("times"), F.col("_rows.place").alias("places")), "budget-chunks")
    # A queue that is left when arrivals end is worked off in the chunks that follow.
    windows = p.queue_length / max(p.calls_per_minute, 1) + 2
    polls = p.queue_length * p.poll_us
    later = int(max(windows * p.budget_us, polls) // p.chunk_us) + 2
    span = packed.select(F.explode(F.sequence("chunk", F.col("chunk") + F.lit(later))).alias("chunk")).distinct()
    chunks = stage(span.join(packed, "chunk", "left"), "budget-span")
    none = F.array().cast("array<bigint>")
    used = F.to_json(F.struct("calls", "queue"))
    first = chunks.withColumn("calls", none).withColumn("queue", none).withColumn("used", used)
    columns = ["chunk", "times", "places", "calls", "queue", "used"]
    folded = stage(first.select(*columns).mapInPandas(_fold(p), FOLDED), "budget-0")
    number = 0
    while True:
        handed = folded.select((F.col("chunk") + 1).alias("chunk"), "calls", "queue")
        now = folded.select("chunk", F.col("used").alias("before")).join(handed, "chunk", "left")
        now = now.select("chunk", "before", F.coalesce("calls", none).alias("calls"), F.coalesce("queue", none).alias("queue")).withColumn("used", used)
        stale = stage(now.filter("used <> before").drop("before"), "budget-stale")
        if stale.isEmpty():
            break
        number += 1
        again = chunks.join(stale, "chunk").select(*columns).mapInPandas(_fold(p), FOLDED)
        folded = stage(folded.join(stale.select("chunk"), "chunk", "left_anti").unionByName(again), f"budget-{number}")
    decided = folded.select(F.explode("decided").alias("_d")).select("_d.*")
    # Who waits at the end of all chunks: one queue.
    last = folded.agg(F.max_by("queue", "chunk").alias("queue")).select(F.explode("queue").alias("place"))
    waiting = last.select("place", F.lit(None).cast("bigint").alias("called_us"), F.lit(WAITING).alias("outcome"))
    outcomes = decided.unionByName(waiting).withColumnRenamed("place", order)
    found = rows.join(outcomes, order, "left")
    return found.withColumn("outcome", F.coalesce("outcome", F.lit(DROPPED)))

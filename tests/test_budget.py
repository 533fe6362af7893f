import random
from collections import deque

import pytest

from netspark.operators import budget as B
from netspark.params import VerdictParams


def plain(rows, p):
    """One fold over all instants: arrivals in order, then the poll, if there is one."""
    calls, queue, out = [], deque(), {}
    end = max((t for t, _ in rows), default=0) + 10_000_000
    times = sorted({t for t, _ in rows} | set(range(0, end, p.poll_us)))
    free = lambda t: sum(c >= t - p.budget_us for c in calls) < p.calls_per_minute
    for t in times:
        for _, place in sorted(r for r in rows if r[0] == t):
            if free(t):
                calls.append(t)
                out[place] = ("called", t)
            elif len(queue) < p.queue_length:
                queue.append(place)
                out[place] = ("waiting", None)
            else:
                out[place] = ("dropped", None)
        if t % p.poll_us == 0 and queue and free(t):
            calls.append(t)
            out[queue.popleft()] = ("retried", t)
    return out


CASES = {
    "sparse": (5, 60, 400_000),
    "dense": (3, 300, 100_000),
    "bursts": (4, 200, 300_000),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("queue", [0, 3])
def test_schedule_equals_one_fold(spark, case, queue):
    seed, n, span = CASES[case]
    rng = random.Random(seed)
    # Microseconds stand for seconds: a window of 9 ms, a poll every 0.7 ms, chunks of 20 ms.
    p = VerdictParams(calls_per_minute=4, budget_seconds=0.009, queue_length=queue, poll_seconds=0.0007, chunk_seconds=0.02)
    centres = [rng.randrange(span) for _ in range(6)]
    times = [min(span - 1, rng.choice(centres) + rng.randrange(4000) // 500 * 500) if case == "bursts" else rng.randrange(span) // 100 * 100 for _ in range(n)]
    rows = [(t, i * 3) for i, t in enumerate(times)]
    table = spark.createDataFrame([(t, i, "x", "c") for t, i in rows], "ts_us bigint, finish_seq bigint, chunk string, place string")
    found = {r.finish_seq: (r.outcome, r.called_us) for r in B.schedule(table, p=p).collect()}
    expected = plain(rows, p)
    assert found == {k: v for k, v in expected.items()}
    assert {"called", "dropped"} <= {v[0] for v in found.values()} or case == "sparse"


def test_a_budget_that_never_rests(spark):
    """No chunk ends with room, so what one hands on travels through all of them."""
    p = VerdictParams(calls_per_minute=3, budget_seconds=0.01, queue_length=0, poll_seconds=1.0, chunk_seconds=0.025)
    rows = [(t, t) for t in range(0, 150_000, 170)]
    table = spark.createDataFrame(rows, "ts_us bigint, finish_seq bigint")
    found = {r.finish_seq: (r.outcome, r.called_us) for r in B.schedule(table, p=p).collect()}
    assert found == plain(rows, p) and sum(v[0] == "called" for v in found.values()) == 45


def test_empty_table(spark):
    assert B.schedule(spark.createDataFrame([], "ts_us bigint, finish_seq bigint")).count() == 0

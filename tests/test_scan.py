import random

import pytest
from pyspark.sql import functions as F

from netspark.operators.scan import Running, scan


def fold(rows, kinds):
    """Sequential running values per key, current row left out or taken in."""
    out = {}
    for key in {r[0] for r in rows}:
        held = {"sum": 0, "max": None, "last": None}
        for k, t, v in sorted(r for r in rows if r[0] == key):
            before = dict(held)
            if v is not None:
                held["sum"] += v
                held["max"] = v if held["max"] is None else max(held["max"], v)
                held["last"] = v
            out[(k, t)] = tuple((held if inclusive else before)[kind] for kind, inclusive in kinds)
    return out


KINDS = [(k, i) for k in ("sum", "max", "last") for i in (True, False)]


@pytest.mark.parametrize("widths", [(), (7,), (5, 3), (2, 2, 2)])
def test_scan_equals_fold(spark, widths):
    rng = random.Random(len(widths))
    rows = [(f"k{rng.choice([0, 0, 0, 1, 2])}", t, rng.choice([None, rng.randint(-9, 9)])) for t in rng.sample(range(-40, 200), 150)]
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint")
    out = {f"{k}_{i}": Running(k, "v", i) for k, i in KINDS}
    got = {(r["k"], r["t"]): tuple(r[f"{k}_{i}"] for k, i in KINDS) for r in scan(df, ["k"], "t", out, widths).collect()}
    assert got == fold(rows, KINDS)


def test_scan_without_keys_and_reversed(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 3)
    total = scan(df, [], "id", {"s": Running("sum", "v")}, (8,)).orderBy("id").collect()
    assert [r["s"] for r in total] == [sum(x % 3 for x in range(i + 1)) for i in range(100)]
    later = scan(df, [], "id", {"n": Running("last", "id", False)}, (8,), reverse=True).orderBy("id").collect()
    assert [r["n"] for r in later] == [*range(1, 100), None]


def test_one_hot_key_is_cut_into_chunks(spark):
    """The row-level window must be partitioned by chunk as well as by key."""
    df = spark.createDataFrame([("hot", i, 1) for i in range(1000)], "k string, t bigint, v bigint")
    plan = scan(df, ["k"], "t", {"s": Running("sum", "v")}, (100,))._jdf.queryExecution().optimizedPlan().toString()
    row_level = [line for line in plan.splitlines() if "Window [sum(v" in line]
    assert row_level and all("_chunk0" in line.split("windowspecdefinition(")[1].split("ASC")[0] for line in row_level)

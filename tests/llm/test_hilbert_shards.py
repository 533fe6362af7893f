import random
import zlib

from pyspark.sql import functions as F

from netspark.llm import hilbert_shards as hs

SCHEMA = "doc_id long, text string, lang string, source string"


def test_curve_visits_every_cell_by_single_steps(spark):
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = spark.range(side**n).select(*((F.floor(F.col("id") / side**k) % side).cast("int").alias(f"c{k}") for k in range(n)))
        rows = sorted(map(tuple, cells.select(hs.curve_index([F.col(c) for c in cells.columns], bits), *cells.columns).collect()))
        assert [r[0] for r in rows] == list(range(side**n))
        assert all(sum(abs(a - b) for a, b in zip(x[1:], y[1:])) == 1 for x, y in zip(rows, rows[1:]))


def documents():
    rng = random.Random(8)
    rows = [(i, "w" * rng.choice([1, 10, 200, 3000]) + "é", rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", "a", "b", "c" * 99, None])) for i in range(700)]
    rows += [(700 + i, "the same text", "en", "hot") for i in range(400)] + [(5, "x", "en", "a")] * 60
    return rows + [(None, None, None, None), (None, "", "", ""), (2000, "z" * 500_000, "en", "hot")]


def test_rows_law(spark):
    rows = documents()
    found = hs.shards(spark.createDataFrame(rows, SCHEMA)).collect()
    expected = sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=str) == expected
    slots = [sorted(r.slot for r in found if r.shard == s) for s in range(8)]
    assert all(x == list(range(len(x))) for x in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1
    assert {r.law for r in found} == {"rows"} and {r.grown_shard for r in found} == {None}
    # The order along the shards is the curve's.
    order = sorted(found, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in found)


def test_bytes_law(spark):
    rows = documents()
    found = hs.shards(spark.createDataFrame(rows, SCHEMA), hs.HilbertParams(law="bytes", shards=5)).collect()
    total, most = sum(r.size for r in found), max(r.size for r in found)
    for s in range(5):
        own = [r for r in found if r.shard == s]
        assert abs(sum(r.size for r in own) - total / 5) <= most and sorted(r.slot for r in own) == list(range(len(own)))


def test_runs_prune_by_every_dimension(spark):
    rng = random.Random(9)
    rows = [(i, "w" * rng.randrange(1, 4000), rng.choice(["de", "en", "es", "fr"]), f"s{rng.randrange(16):02}") for i in range(4000)]
    params = hs.HilbertParams(shards=64)
    runs = hs.ranges(hs.assigned(spark.createDataFrame(rows, SCHEMA), params)).collect()
    for name, value in (("lang", "=es"), ("source", "=s05"), ("size", f"{(1 << 63) + 1000:020}")):
        read = [r for r in runs if r[f"least_key_{name}"] <= value <= r[f"most_key_{name}"]]
        assert read and len(read) <= 40, name


def test_write_keeps_rows_and_columns(spark, tmp_path):
    rows = [(*r, i, "s") for i, r in enumerate(documents())]
    docs = spark.createDataFrame(rows, SCHEMA + ", curve int, shard string")
    hs.write(docs, f"{tmp_path}/out", hs.HilbertParams(shards=3))
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.columns == [*docs.columns, "shard_"] and sorted(map(str, (tuple(r)[:-1] for r in back.collect()))) == sorted(map(str, rows))
    assert {r.shard_ for r in back.select("shard_").distinct().collect()} == {0, 1, 2}


def test_empty_table(spark):
    assert hs.shards(spark.createDataFrame([], SCHEMA)).count() == 0

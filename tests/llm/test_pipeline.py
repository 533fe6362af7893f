import random

import pytest

import corpus_pipeline
from tests.llm import test_decontaminate, test_pii_weak, test_quality_mcd, test_simhash_vp


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    items = [(i, prose(rng, 25)) for i in range(5)]
    rows = [(i, prose(rng, rng.randint(25, 120))) for i in range(150)]
    rows += [(200 + i, rows[i % 7][1]) for i in range(30)]  # copies
    rows += [(300 + i, f"{prose(rng, 30)} {items[i % 5][1]} {prose(rng, 30)}") for i in range(20)]
    rows += [(400 + i, f"{prose(rng, 30)} mail me at u{i}@mail.example.org or +1 (555) 123-45{i:02}") for i in range(20)]
    rows += [(500 + i, "same words here " * 40) for i in range(9)] + [(600 + i, prose(rng, 5)) for i in range(9)]
    rows += [(700, None), (701, ""), (None, prose(rng, 40)), (5, rows[5][1]), (5, rows[5][1])]
    docs = [(i, t, rng.choice(["en", None]), rng.choice(["s0", "s0", "s1"]), len(t or "")) for i, t in rows]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_each_stage_on_its_own_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    states = [sorted(map(tuple, docs.collect()), key=str)]
    for name, apply in corpus_pipeline.STAGES[:-1]:
        out = apply(spark, docs, folder)
        assert out.columns == docs.columns, name
        rows = sorted(map(tuple, out.collect()), key=str)
        docs = spark.createDataFrame(rows, docs.schema)
        states.append(rows)
    quality, single, clean, redacted = states[1:]
    # Quality: exactly the base rules, as all other documents are alike.
    assert quality == [r for r in states[0] if not test_quality_mcd.base(r[1])[-1]]
    values = [test_simhash_vp.plain_fingerprint(r[1]) for r in quality]
    label = test_simhash_vp.plain_components(values)
    heads = {x: min((r[0] for r, y in zip(quality, label) if x == y and r[0] is not None), default=None) for x in label}
    assert sorted(r[0] for r in single if r[0] is not None) == sorted(h for h in heads.values() if h is not None)
    assert sum(r[0] is None for r in single) == sum(h is None for h in heads.values())
    hit = {r[0]: r[5] for r in test_decontaminate.expected(single, items, 10)}
    assert clean == [r for r in single if not hit[r[0]]]
    assert len(redacted) == len(clean)
    for before, after in zip(sorted(clean, key=lambda r: str(r[0])), sorted(redacted, key=lambda r: str(r[0]))):
        assert not test_pii_weak.base(after[1]) and after[4] == len(after[1])
        assert after[1] == before[1] or test_pii_weak.base(before[1])


def test_run_gives_the_last_stage(spark, folder):
    found = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, apply in corpus_pipeline.STAGES:
        docs = apply(spark, docs, folder)
    key = lambda r: str(r[0])
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, docs.collect()), key=key)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None

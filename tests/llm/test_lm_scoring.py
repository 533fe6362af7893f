import math
import random
from collections import Counter

import numpy as np
import pytest

from netspark.llm import lm_scoring, packed
from netspark.llm.lm_scoring import LmParams


def words_of(text):
    return [w for w in (text or "").encode().lower().replace(b"\n", b" ").replace(b"\t", b" ").split(b" ") if w]


def model(texts, types, params):
    single, pair, total = Counter(), Counter(), 0
    for words in texts:
        single.update(words)
        pair.update(zip(words, words[1:]))
        total += len(words)

    def loss(words):
        out = 0.0
        for i, w in enumerate(words):
            p = (single[w] + params.smooth) / (total + params.smooth * types)
            v = words[i - 1] if i else None
            if v is not None and single[v]:
                p = params.bigram * pair[v, w] / single[v] + (1 - params.bigram) * p
            out -= math.log(p)
        return out / len(words)

    return loss


def expected(rows, good, params):
    texts = [(r[0], words_of(r[1])) for r in rows]
    types = len({w for _, words in texts for w in words})
    ours = model([w for i, w in texts if i in good], types, params)
    every = model([w for _, w in texts], types, params)
    return [(i, len(w), ours(w) if w else None, every(w) if w else None) for i, w in texts]


@pytest.mark.parametrize(("good", "sent"), [({1, 4, 9, 16, 25, 36, 999_999}, 1 << 20), ({1, 4, 9, 16, 25}, 0), (set(), 1 << 20)])
def test_scores_equal_brute_force(spark, monkeypatch, good, sent):
    monkeypatch.setattr(lm_scoring, "MOST_SENT", sent)
    rng = random.Random(1)
    rows = [(0, None), (None, "x y"), (None, "x y"), (2, ""), (3, " \n"), (4, "one"), (4, "One two")]
    rows += [(5 + i, " ".join(rng.choice(["a", "B", "c", "ñu", "the"]) + rng.choice(["", "", "x"]) for _ in range(rng.randint(1, 60)))) for i in range(80)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, is_target string").repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(i, 1, 0) for i in good] + [(5, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    params = LmParams()
    found = lm_scoring.scores(lm_scoring.with_target(docs, labels), "is_target", params, slice_bytes=900).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for got, want in zip(sorted(map(tuple, found), key=key), sorted(expected(rows, good, params), key=key), strict=True):
        assert got[:2] == want[:2]
        assert got[2:4] == (None, None) if want[2] is None else got[2:4] == pytest.approx(want[2:])
        assert got[4] is None if want[2] is None else got[4] == pytest.approx(want[2] - want[3])


def test_targets_score_lower(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("alpha beta gamma delta".split() if i % 2 else "uno dos tres beta".split()) for _ in range(40))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.score for r in lm_scoring.scores(docs.selectExpr("*", "doc_id % 2 = 1 and doc_id < 60 t"), "t").collect()}
    assert max(found[i] for i in range(61, 100, 2)) < min(found[i] for i in range(0, 100, 2))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scoring.scores(docs, "false").count() == 0


def test_keys_are_dealt_by_equal_ranges():
    rng = np.random.default_rng(2)
    for bits, partitions, n in ((64, 8, 500), (20, 64, 30), (16, 2, 1), (24, 16, 0)):
        keys = np.sort(rng.integers(0, 1 << bits, n, dtype=np.uint64, endpoint=False) if bits < 64 else rng.integers(0, 2**64 - 1, n, dtype=np.uint64))
        parts, cuts = packed.dealt(keys, partitions, bits)
        got = [(p, int(k)) for p, c in zip(parts, cuts) for k in keys[c]]
        assert got == [(int(k) * partitions >> bits, int(k)) for k in keys] and len(parts) <= min(partitions, n)

import math
import random
import zlib
from collections import Counter

import pytest

from netspark.llm import language_id
from netspark.llm.language_id import LanguageParams

SYLLABLES = {"en": "th er on an re he in ed nd ha", "de": "en er ch te ge ei sch ung ße ü", "es": "os ar ción ue ra la ñ do as ie"}
COMMON = {"en": "the of and", "de": "der die und", "es": "el los y"}


def words(rng, lang, n):
    out = []
    for _ in range(n):
        out.append(rng.choice(COMMON[lang].split()) if rng.random() < 0.3 else "".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 4))))
    return " ".join(out)


def test_held_out_documents_are_recognised(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, lang, rng.randint(3, 60)).upper() if i % 7 == 0 else words(rng, lang, rng.randint(3, 60)), lang) for i in range(600) for lang in [rng.choice(list(COMMON))]]
    truth = {r[0]: r[2] for r in rows}
    rows = [(i, t, lang if zlib.crc32(str(i).encode()) % 4 != 2 else "zz") for i, t, lang in rows]  # held-out labels must not matter
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    found = language_id.languages(docs).collect()
    assert {r.doc_id for r in found if r.held_out} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    held = [r for r in found if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found) and {r.lang_pred for r in found} <= set(COMMON)


def plain_predictions(rows, smooth):
    """(lang, score) of every text by the definition: counted words and n-grams of the taught rows, backed off word by word."""
    counts = {}
    for doc_id, text, lang in rows:
        if doc_id is not None and lang is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 4 != 2:
            for w in language_id.words_of(text):
                marked = f" {w} "
                tokens = [(0, w), *((k, marked[i : i + k]) for k in (2, 3, 4) for i in range(len(marked) - k + 1)), *((1, c) for c in w)]
                for kind, token in tokens:
                    counts.setdefault(lang, {}).setdefault(kind, Counter())[token] += 1
    langs = sorted(counts)
    known = {k: set().union(*(counts[x].get(k, ()) for x in langs)) for k in range(5)}

    def log(lang, kind, token):
        c = counts[lang].get(kind, Counter())
        return math.log((c[token] + smooth) / (c.total() + smooth * len(known[kind])))

    out = []
    for _, text, _ in rows:
        words = language_id.words_of(text or "")
        if not any(c.isalpha() for w in words for c in w):
            out.append(("und", 0.0))
            continue
        total = dict.fromkeys(langs, 0.0)
        for w in words:
            for kind in (0, 4, 3, 2, 1):
                marked = f" {w} "
                tokens = [w] if kind == 0 else list(w) if kind == 1 else [marked[i : i + kind] for i in range(len(marked) - kind + 1)]
                tokens = [t for t in tokens if t in known[kind]]
                if tokens:
                    for lang in langs:
                        total[lang] += sum(log(lang, kind, t) for t in tokens) / len(tokens)
                    break
        best = max(langs, key=lambda x: (total[x], [-ord(c) for c in x]))
        out.append((best, 1 / sum(math.exp(total[x] - total[best]) for x in langs)))
    return out


def test_predictions_equal_the_definition(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, lang, rng.randint(1, 25)), lang) for i in range(200) for lang in [rng.choice(list(COMMON))]]
    rows += [(300, "zzqq Übung", None), (301, "12 !", "en"), (302, None, "de"), (None, "the der", "en"), (303, "日本 the", "es")]
    found = language_id.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)).collect()
    assert [r.doc_id for r in found] == [r[0] for r in rows]
    for r, (lang, score) in zip(found, plain_predictions(rows, LanguageParams().smooth)):
        # Sums of 32-bit logarithms: equal up to rounding.
        assert r.score == pytest.approx(score, abs=1e-4) and (r.lang_pred == lang or score < 0.5001)


def test_words_first_then_shorter_grams(spark):
    docs = spark.createDataFrame([(0, "gift gift xylo", "de"), (1, "gift xyz", "en"), (3, "ñandu", "es")], "doc_id long, text string, lang string")
    model = language_id.fit(docs.filter("doc_id < 9"), LanguageParams(smooth=0.5))
    own = language_id.Predictor(model)
    assert own.predict("gift")[0] == "de"
    assert own.predict("ñandulos")[0] == "es"  # by four letters
    assert own.predict("ñ")[0] == "es"  # by one
    rows = model.rows
    assert not any(g in rows[1] for g in language_id.grams_of("qqxyzqq", 4)) and own.predict("qqxyzqq")[0] == "en"


def test_odd_rows(spark):
    long = "der die und " * 40_000
    rows = [(0, "the of and", "en"), (1, "der und die", "de"), (None, None, None), (5, "", "en"), (6, "12 _ -- ²", "en"), (7, long, None), (7, long, None), (8, "x" * 100_000, "en")]
    found = language_id.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and (by_id[None].lang_pred, by_id[None].score, by_id[None].held_out) == ("und", 0.0, False)
    assert by_id[5].lang_pred == by_id[6].lang_pred == "und" and by_id[7].lang_pred == "de"


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.languages(docs).collect()] == ["und"]
    assert language_id.languages(docs.limit(0)).count() == 0

import random
import re

import numpy as np
import pytest

from netspark.llm import quality_mcd
from netspark.llm.quality_mcd import McdParams

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def prose(rng, n):
    words = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n)]
    return " ".join(w.capitalize() if i % 9 == 0 else w for i, w in enumerate(words)) + "."


def test_base_rules_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "one\ntwo\none\n \n \none", "\xa0 x\xa0y é日本 #*$%&|<> <", "a b c d e f g h " * 2, "a b c d e f g a b c d e f g", "x " * 5000, "x\x1cy\x0bz\x0cw\rv"]
    for _ in range(120):
        words = [rng.choice(["a", "b", "ñu", "C#", "x%"]) for _ in range(rng.choice([7, 8, 9, 20, 60]))]
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
        texts.append(prose(rng, 30) + "\n" + rng.choice(["", "same line\nsame line\n"]) + prose(rng, 12))
    rows = [(i % 200 if i else None, t, rng.choice([None, "en", "de"]), rng.choice([None, "s0", "s1"]), "q", 1) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, q string, `group` int")
    found = quality_mcd.judged(docs, McdParams(shrink=30)).collect()
    key = lambda r: (r[0] is None, r)
    mine = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found]
    assert sorted(mine, key=key) == sorted([(r[0], *base(r[1])) for r in rows], key=key)
    assert not any(r.kept for r in found if r.base_failed)


def test_outliers_go_and_ordinary_documents_stay(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(40, 400)), "en", "hot" if i % 3 else f"s{i % 2}") for i in range(900)]
    odd = {}
    for i in range(900, 940):
        words = prose(rng, 200).split()
        odd[i] = " ".join(w + "$$$" for w in words) if i % 2 else " ".join(words).upper()
    rows += [(i, t, "en", "hot") for i, t in odd.items()]
    rows += [(2000, prose(rng, 90), "xx", "alone"), (2001, " ".join("###" for _ in range(90)) + prose(rng, 60), "xx", "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("_quality", docs_extra())
    kept = {r.doc_id for r in quality_mcd.keep(docs).select("doc_id").collect()}
    assert not kept & set(odd) and 2001 not in kept
    assert len(kept & {*range(900), 2000}) >= 898
    judged = {r.doc_id for r in quality_mcd.judged(docs).collect() if r.kept}
    assert judged == kept
    assert quality_mcd.keep(docs).columns == docs.columns


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("extra")


def test_many_groups_take_the_salted_join(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, prose(rng, 60) if i % 20 else "$" * 300 + prose(rng, 60), "en", f"s{i % 2}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    few = sorted(map(tuple, quality_mcd.judged(docs).select("doc_id", "kept").collect()))
    monkeypatch.setattr(quality_mcd, "MOST_GROUPS", 0)
    assert sorted(map(tuple, quality_mcd.judged(docs).select("doc_id", "kept").collect())) == few


@pytest.mark.parametrize("texts", [[], [None, ""]])
def test_without_an_estimate(spark, texts):
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    assert [r.kept for r in quality_mcd.judged(docs).collect()] == [False] * len(texts)
    assert quality_mcd.keep(docs).count() == 0


def test_chi_square():
    assert np.isclose(quality_mcd.chi_square(0.5, 6), 5.348, rtol=0.01)
    assert np.isclose(quality_mcd.chi_square(0.999, 6), 22.46, rtol=0.01)


def test_copied_lines_go_and_one_line_twice_stays(spark):
    rng = random.Random(7)
    lines = lambda n: [prose(rng, 12) for _ in range(n)]
    rows = [(i, "\n".join(lines(rng.randint(6, 30)))) for i in range(400)]
    twice = {}
    for i in range(400, 420):
        text = lines(rng.randint(8, 20))
        twice[i] = "\n".join([*text, text[2]])
    copied = {}
    for i in range(420, 430):  # two of three lines are copies; no eight words in a row come again
        copied[i] = "\n".join(x for _ in range(20) for x in ("see also here", "back to top", prose(rng, 30)))
    assert not any(base(t)[-1] for t in [*twice.values(), *copied.values()]) and not any(base(t)[4] for t in copied.values())
    rows += [*twice.items(), *copied.items()]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality_mcd.judged(docs).collect() if r.kept}
    assert not kept & set(copied)
    assert set(twice) <= kept


@pytest.mark.parametrize("wide, outer", [(3.0, 1.0), (3.0, 30.0), (0.2, 1.0)])
def test_scale_and_floor(spark, wide, outer):
    rng, params = np.random.default_rng(8), McdParams()
    # The last third is `outer` times as wide, so that the core holds some of it and is to be scaled down.
    values = rng.normal(size=(3000, 6)) * np.array(params.floor) * wide * np.where(np.arange(3000) < 2000, 1, outer)[:, None]
    rows = [(i, False, "g", *map(float, v)) for i, v in enumerate(values)]
    columns = ", ".join(f"{x} double" for x in quality_mcd.FEATURES)
    found, _ = quality_mcd.estimates(spark.createDataFrame(rows, f"doc_id long, base_failed boolean, `group` string, {columns}"), params)
    (row,) = found.collect()
    factor = np.zeros((6, 6))
    for i, j in quality_mcd._PAIRS:
        factor[i, j] = row[f"l_{i}_{j}"]
    solved = np.linalg.solve(factor, (values - [row[f"mean_{i}"] for i in range(6)]).T)
    median = np.median((solved**2).sum(axis=0))
    if wide > 1:
        assert np.isclose(median, quality_mcd.chi_square(0.5, 6), rtol=0.05)
    else:
        assert np.allclose(np.diag(factor), params.floor, rtol=0.05)


def plain_estimate(values, params):
    """Mean and scaled covariance by concentration steps from both starts, and the determinants on the way."""
    floor = np.array(params.floor)

    def floored(cov):
        return cov + np.diag(np.maximum(floor**2 - np.diag(cov), 0))

    def far(mean, cov):
        return np.einsum("ij,ji->i", values - mean, np.linalg.solve(floored(cov), (values - mean).T))

    at = lambda x, share: np.sort(x, axis=0)[int(np.ceil(share * len(x))) - 1]
    middle = at(values, 0.5)
    first = [(middle, np.diag((at(abs(values - middle), 0.5) * 1.4826) ** 2)), (values.mean(axis=0), np.cov(values.T, bias=True))]
    ends = []
    for mean, cov in first:
        trace = []
        while len(trace) < params.steps:
            d2 = far(mean, cov)
            core = values[d2 <= at(d2, params.core)]
            new = core.mean(axis=0), np.cov(core.T, bias=True)
            size = np.linalg.slogdet(floored(new[1]))[1]
            if trace and size >= trace[-1]:
                break
            mean, cov = new
            trace.append(size)
            if len(trace) > 1 and size >= trace[-2] - params.least_fall:
                break
        ends.append((trace[-1], len(ends), mean, cov, trace))
    _, _, mean, cov, _ = min(ends, key=lambda e: e[:2])
    part = np.minimum(np.diag(cov) / floor**2, 1).sum().clip(1)
    return mean, cov * at(far(mean, cov), 0.5) / (part * (1 - 2 / (9 * part)) ** 3), [e[4] for e in ends]


def sample(rng, n, shift):
    mixing = np.eye(6) + np.tril(rng.normal(size=(6, 6)), -1) * 0.4
    values = rng.normal(size=(n, 6)) @ mixing.T + shift
    values[: n // 6] += 9 * np.sign(rng.normal(size=6))  # a clump of outliers, which draws the second start
    return values


def as_rows(spark, groups):
    columns = ", ".join(f"{x} double" for x in quality_mcd.FEATURES)
    rows = [(i, False, name, *map(float, v)) for name, values in groups.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"doc_id long, base_failed boolean, `group` string, {columns}")


def test_estimates_equal_plain_steps_mixed_by_size(spark):
    rng, params = np.random.default_rng(9), McdParams()
    # Quantiles of up to 500 rows are exact.
    groups = {"a": sample(rng, 300, 0.0), "b": sample(rng, 120, 3.0), "c": sample(rng, 30, -2.0)}
    found, n_groups = quality_mcd.estimates(as_rows(spark, groups), params)
    assert n_groups == 3
    whole_mean, whole_cov, _ = plain_estimate(np.concatenate(list(groups.values())), params)
    floor = np.array(params.floor)
    for row in found.collect():
        mean, cov, traces = plain_estimate(groups[row["group"]], params)
        assert all(b < a for t in traces for a, b in zip(t, t[1:]))
        share = len(groups[row["group"]]) / (len(groups[row["group"]]) + params.shrink)
        apart = mean - whole_mean
        wanted = share * cov + (1 - share) * whole_cov + share * (1 - share) * np.outer(apart, apart)
        wanted += np.diag(np.maximum(floor**2 - np.diag(wanted), 0))
        factor = np.zeros((6, 6))
        for i, j in quality_mcd._PAIRS:
            factor[i, j] = row[f"l_{i}_{j}"]
        assert np.allclose([row[f"mean_{i}"] for i in range(6)], whole_mean + share * apart)
        assert np.allclose(factor @ factor.T, wanted)


def test_determinants_fall_with_every_step(spark):
    rng = np.random.default_rng(10)
    groups = {"0a": sample(rng, 300, 0.0)}
    groups["1a"] = groups["0a"]
    rows = as_rows(spark, groups).withColumnRenamed("group", "mine")
    plain = as_rows(spark, {"a": groups["0a"]}).withColumnRenamed("group", "mine")
    sizes = []
    for steps in (1, 2, 3, 20):
        params = McdParams(steps=steps)
        found = quality_mcd.concentrate(rows, quality_mcd.starts(plain, params, 1), params, 2)
        sizes.append({r["group"]: r["size"] for r in found.collect()})
    assert set(sizes[0]) == {"0a", "1a"}
    assert all(after[g] <= before[g] for before, after in zip(sizes, sizes[1:]) for g in before)
    assert any(sizes[-1][g] < sizes[0][g] for g in sizes[0])


def test_verdicts_do_not_jump_as_a_group_grows(spark):
    rng, params = np.random.default_rng(11), McdParams()
    values, other = sample(rng, 130, 1.5), sample(rng, 600, 0.0)
    before = None
    for n in (98, 99, 100, 101, 102):
        found, _ = quality_mcd.estimates(as_rows(spark, {"grows": values[:n], "other": other}), params)
        (row,) = found.filter("`group` = 'grows'").collect()
        factor = np.zeros((6, 6))
        for i, j in quality_mcd._PAIRS:
            factor[i, j] = row[f"l_{i}_{j}"]
        d2 = (np.linalg.solve(factor, (values[:98] - [row[f"mean_{i}"] for i in range(6)]).T) ** 2).sum(axis=0)
        assert before is None or np.abs(np.log(d2 / before)).max() < 0.5
        before = d2

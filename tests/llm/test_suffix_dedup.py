import hashlib
import random

import numpy as np
import pytest

from netspark.llm import packed, suffix_dedup


def expected(rows, width):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    first = {}
    for doc_id, text in texts:
        for i in range(len(text) - width + 1):
            key = packed.NO_ID if doc_id is None else doc_id
            first[text[i : i + width]] = min(key, first.get(text[i : i + width], key))
    out = []
    for doc_id, text in texts:
        gone = [False] * len(text)
        for i in range(len(text) - width + 1):
            if first[text[i : i + width]] < (packed.NO_ID if doc_id is None else doc_id):
                gone[i : i + width] = [True] * width
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r))


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "er", "ñ", "th", "on", "日"]) for _ in range(rng.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(rng.randint(8, 40)) for _ in range(6)] + ["aaaa" * 60, "ab" * 90]
    out = [None, "", "short", "x" * 50, "x" * 49, "x" * 51]
    for _ in range(n):
        text = " ".join(rng.choice([prose(rng.randint(1, 30)), rng.choice(shared)]) for _ in range(rng.randint(1, 4)))
        if rng.random() < 0.2 and len(out) > 8:
            text = rng.choice(out[6:])
            text = text[: rng.randrange(len(text))] + "!" + text[rng.randrange(len(text)) :]
        out.append(text)
    ids = list(range(3 * len(out)))
    rng.shuffle(ids)
    rows = [(i, t, "kept", 1) for i, t in zip(ids, out)]
    return rows + [(None, shared[0] + " no id", "", 0), (None, shared[0] + " no id", "", 0), (rows[9][0], rows[9][1], "", 0), (rows[9][0], shared[1] * 2, "", 0)]


def rows_of(found):
    got = []
    for r in found.collect():
        assert r.n_bytes - len(r.kept) == sum(b - a for a, b in zip(r.start, r.stop))
        got.append((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.start), hashlib.sha256(bytes(r.kept)).hexdigest()))
    return sorted(got, key=lambda r: (r[0] is None, r))


def test_rows_equal_brute_force(spark):
    rows = corpus(1, 160)
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, start int").repartition(5)
    assert rows_of(suffix_dedup.remove_repeats(docs, slice_bytes=3000)) == expected(rows, 50)


def test_hot_grams_are_dealt_by_window(spark):
    rows = corpus(2, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, start int").repartition(4)
    assert rows_of(suffix_dedup.remove_repeats(docs, width=12, q=5, hot_slices=3, slice_bytes=1500)) == expected(rows, 12)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.digests(docs).count() == 0


def test_pieces_meet_at_their_edges(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 700).astype(np.uint8)
    offsets = np.array([0, 0, 30, 330, 340, 700])
    for piece in (64, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        _, place, first, last = suffix_dedup.anchors(data, offsets, 20, 8)
        covered = sorted(w for a, b in zip(first, last) for w in range(a, b + 1))
        assert covered == [w for w in range(681) if offsets[np.searchsorted(offsets, w, "right")] - w >= 20]
        assert ((place >= last - 0) | (place >= first)).all() and (place + 8 <= first + 20).all()


@pytest.mark.parametrize("run", [1, 60, 1 << 15])
def test_buckets_equal_windows(run):
    rng = np.random.default_rng(4)
    for width in (5, 8, 13, 16, 50):
        length = rng.integers(width, width + 12, 40)
        data = rng.integers(97, 99 if width > 13 else 101, length.sum()).astype(np.uint8)
        data[: len(data) // 2] = 97
        data[-30:] = 0
        start = np.cumsum(length) - length
        bucket = suffix_dedup.buckets(data, start, length, width, run)
        raw, seen = data.tobytes(), {}
        for s, n in zip(start, length):
            for i in range(s, s + n - width + 1):
                assert seen.setdefault(raw[i : i + width], bucket[i]) == bucket[i]
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("run", [1, 40, 1 << 15])
def test_refinement_gives_the_suffix_array(run, monkeypatch):
    rng = np.random.default_rng(5)
    for letters in (1, 2, 4):
        length = rng.integers(1, 60, 25)
        data = rng.integers(0, letters, length.sum()).astype(np.uint8)
        start = np.cumsum(length) - length
        ends = np.repeat(start + length, length)
        held = {}
        refined = suffix_dedup._refined

        def watched(todo, order, pointer, depth, left, width):
            held.update(order=order, pointer=pointer)
            return refined(todo, order, pointer, depth, left, width)

        monkeypatch.setattr(suffix_dedup, "_refined", watched)
        suffix_dedup.buckets(data, start, length, 64, run)  # no suffix has as many bytes, so all are sorted to their ends
        monkeypatch.setattr(suffix_dedup, "_refined", refined)
        suffixes = [data[i : ends[i]].tobytes() for i in held["order"]]
        assert suffixes == sorted(suffixes)
        pointers = held["pointer"][held["order"]]
        assert all((a == b) == (p == q) for a, b, p, q in zip(suffixes, suffixes[1:], pointers, pointers[1:]))


def test_later_runs_use_the_new_pointers(monkeypatch):
    text = np.frombuffer(bytes(range(65, 91)) * 40, np.uint8)
    start, length = np.zeros(1, np.int64), np.array([len(text)])
    steps = []
    refined = suffix_dedup._refined
    monkeypatch.setattr(suffix_dedup, "_refined", lambda todo, *rest: (steps.append(len(todo)), refined(todo, *rest))[1])
    suffix_dedup.buckets(text, start, length, 400, 1)
    reused = sum(steps)
    steps.clear()
    suffix_dedup.buckets(text, start, length, 400, 1 << 15)
    assert reused < sum(steps)  # buckets that look at refined ones need fewer steps


def test_single_windows_are_hashed_a_run_at_a_time(monkeypatch):
    """Hashes of single windows are those of their whole rows, and no more than a run of rows is built for them."""
    data = np.frombuffer(("abc" * 400 + "".join(chr(65 + i % 26) for i in range(400))).encode(), np.uint8)
    single = np.arange(len(data) - 50 + 1)
    whole = suffix_dedup.stretches(data, single, single, single, 50, 20)
    whole[:, 0] = suffix_dedup.SINGLE
    built, build = [], suffix_dedup.stretches
    monkeypatch.setattr(suffix_dedup, "stretches", lambda *a: built.append(len(a[1])) or build(*a))
    assert (suffix_dedup._single_hashes(data, single, 50, 20, size=128) == suffix_dedup._row_hashes(whole)).all()
    assert max(built) == 128


def test_anchors_are_dealt_evenly():
    """Anchors are the smallest hashes of their windows; their keys still fill all partitions alike."""
    data = np.random.default_rng(3).integers(97, 123, 200_000).astype(np.uint8)
    hashes = suffix_dedup.anchors(data, np.array([0, len(data)]), 50, 20)[0]
    keys = np.sort(suffix_dedup.spread_keys(hashes, 40))
    parts, cuts = packed.dealt(keys, 32, 40)
    sizes = [c.stop - c.start for c in cuts]
    assert parts == list(range(32)) and max(sizes) < 1.5 * len(keys) / 32


def test_work_follows_rows_and_not_partitions(spark, monkeypatch):
    """Slices x partitions grows with the square of the input: partitions of few rows are worked on together, and answers at once."""
    assert [p for p, _ in suffix_dedup._runs(list(range(7)), [slice(i, i + 1) for i in range(7)], 3)] == [[0, 1, 2], [3, 4, 5], [6]]
    assert list(suffix_dedup._runs([], [])) == []
    rng = np.random.default_rng(4)
    for n in (50, 90, 400):
        starts = np.sort(rng.integers(0, n - 49, 12))
        gone = np.array([int(x) & ((1 << min(31, n - 49 - s)) - 1) for s, x in zip(starts, rng.integers(0, 1 << 31, 12))], np.uint64)
        want = np.zeros(n, bool)
        for s, bits in zip(starts, gone):
            for j in range(31):
                if int(bits) >> j & 1:
                    want[s + j : s + j + 50] = True
        assert (suffix_dedup.covered(starts, gone, n, 50) == want).all()
    assert not suffix_dedup.covered(np.zeros(0, np.int64), np.zeros(0, np.uint64), 5, 50).any()
    rows = corpus(6, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, start int").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert rows_of(suffix_dedup.remove_repeats(docs, slice_bytes=3000)) == expected(rows, 50)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

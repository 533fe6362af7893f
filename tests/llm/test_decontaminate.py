import hashlib
import random
import re

import duckdb

from netspark.llm import decontaminate
from netspark.llm.checks import CHECKS

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORDS.findall((text or "").encode().lower())


def matches_of(words, items, window):
    """(doc_word, item_id, item_word, n_words) of the maximal runs of equal windows, by trying every pair of places."""
    out = set()
    for item_id, text in items:
        item = words_of(text)
        size = min(window, len(item))
        spots = {}
        for i in range(len(item) - size + 1 if item else 0):
            spots.setdefault(tuple(item[i : i + size]), []).append(i)
        pairs = {(j, i) for j in range(len(words) - size + 1) for i in spots.get(tuple(words[j : j + size]), [])}
        for j, i in pairs:
            if (j - 1, i - 1) not in pairs:
                n = 0
                while (j + n, i + n) in pairs:
                    n += 1
                out.add((j, "" if item_id is None else str(item_id), i, n - 1 + size))
    return sorted(out)


def expected(rows, items, window):
    wanted = {}
    for item_id, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            wanted.setdefault(tuple(words[i : i + window]), set()).add(item_id)
    out = []
    for doc_id, text, *_ in rows:
        words, hit, found = words_of(text), set(), set()
        for size in {len(w) for w in wanted}:
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in wanted:
                    hit |= set(range(i, i + size))
                    found |= wanted[tuple(words[i : i + size])] - {None}
        names = ",".join(sorted(map(str, found)))
        long = matches_of(words, items, window)
        told = ",".join(f"{name}:{j}:{i}:{n}" for j, name, i, n in long)
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit), max((m[3] for m in long), default=0), told))
    return out


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r))


def data(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "Of", "the", "ñu", "x9", "日本"]) + rng.choice(["", "", "b", str(rng.randrange(30))])
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(word() for _ in range(n))
    items = [(i, text(rng.choice([3, 9, 10, 11, 25, 40]))) for i in range(25)]
    items += [(90, "rare1 rare2"), (91, None), (92, ""), (93, "--"), (5, items[3][1]), (94, items[3][1]), (None, text(12)), (95, "one " * 30)]
    rows = [(0, None), (1, ""), (2, "..."), (None, items[0][1]), (3, "one " * 300), (3, "one " * 300)]
    for i in range(120):
        parts = [text(rng.randrange(40))]
        if rng.random() < 0.5:
            item = words_of(rng.choice(items)[1])
            cut = rng.randrange(max(1, len(item)))
            parts += [b" ".join(item[cut : cut + rng.choice([9, 10, 40])]).decode(), text(4)]
        rows.append((10 + i, rng.choice([" ", ". "]).join(parts).upper() if i % 3 else " ".join(parts)))
    return [(*r, "extra", 1) for r in rows], items


def test_rows_equal_brute_force_for_one_block_and_for_many(spark):
    for seed, window in ((1, 10), (2, 4)):
        rows, items = data(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string, items string, n_words int").repartition(3)
        benchmark = spark.createDataFrame(items, "item_id int, text string")
        for block_words in (1 << 20, 60):
            found = decontaminate.digests(docs, benchmark, window, block_words).collect()
            assert sorted_rows(found) == sorted_rows(expected(rows, items, window))


def test_longest_matches_and_places(spark):
    item = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, "a b " + " ".join(item[5:27]) + " z " + " ".join(item[:9]))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, " ".join(item)), (8, "b W5 w6")], "item_id long, text string")
    (row,) = decontaminate.scan(docs, benchmark).collect()
    assert sorted(map(tuple, row.matches)) == [("7", 2, 5, 22), ("8", 1, 0, 3)]
    assert (row.hit_start, row.hit_end, row.n_words) == ([1], [24], 34)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontaminate.digests(docs, none).collect()] == [(1, 3, 0, 0)]
    assert decontaminate.digests(docs.limit(0), none).count() == 0


def test_an_item_above_the_bound_is_searched_in_pieces(spark):
    rng = random.Random(3)
    item = [f"w{rng.randrange(40)}" for _ in range(90)]
    texts = [" ".join(item), "x " + " ".join(item[20:60]) + " y", " ".join(item[8:13]), "é, ".join(item[:50] + ["z"] + item[9:80]), "w1 w2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([("long", " é ".join(item)), ("long2", ", ".join(item)), (None, " ".join(item[30:70]))], "item_id string, text string")
    blocks = list(decontaminate.blocks(benchmark, 4, 50))
    assert len(blocks) > 4 and all(len(b.vocabulary.numbers) <= 50 and len(b.owner_word) <= 50 for b in blocks)
    key = lambda m: (m[0] or "", *m[1:])
    whole, cut = (
        {r.doc_id: (r.hit_start, r.hit_end, sorted(r.items), sorted(map(tuple, r.matches), key=key)) for r in decontaminate.scan(docs, benchmark, 4, n).collect()} for n in (1 << 20, 50)
    )
    assert whole == cut and ("long2", 0, 0, 90) in whole[0][3]
    assert list(decontaminate.pieces("a b", 4, 1)) == [(0, "a b")] and list(decontaminate.pieces("--", 4, 1)) == []


def test_sql_equals_the_operator(spark, tmp_path):
    rows, items = data(4)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    db = duckdb.connect()
    for name, table in (("documents", docs), ("benchmark", benchmark)):
        table.write.parquet(str(tmp_path / name))
        db.execute(f"create view {name} as select * from '{tmp_path}/{name}/*.parquet'")
    found = decontaminate.digests(docs, benchmark)
    theirs = db.execute(CHECKS["op5_decontamination"])
    assert [d[0] for d in theirs.description] == found.columns
    assert sorted_rows(theirs.fetchall()) == sorted_rows(found.collect())

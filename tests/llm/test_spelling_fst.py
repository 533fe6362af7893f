import random
import re
import zlib
from collections import Counter

import pytest

from netspark.llm import spelling_fst as sf


def one_edit(word, alphabet):
    out = set()
    for i in range(len(word) + 1):
        for c in alphabet:
            out |= {word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]} if i < len(word) else {word + c}
        if i < len(word):
            out.add(word[:i] + word[i + 1 :])
    return out - {word}


def plain(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 5}
    alphabet = set("".join(n))
    near = {w: [v for v in one_edit(w, alphabet) if v in n] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("letters,count", [("ab", 300), ("abc", 400), ("abcdefgh", 200)])
def test_composition_accepts_each_pair_once(letters, count):
    rng = random.Random(count)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, 7))) for _ in range(count)})
    made = sf.Acceptor(words)
    found = sorted(tuple(sorted((words[i], words[j]))) for i, j in made.pairs())
    there = set(words)
    assert found == sorted({tuple(sorted((u, v))) for u in words for v in one_edit(u, set(letters)) if v in there})
    assert made.size[made.first] == len(words)


def test_acceptor_is_minimal():
    made = sf.Acceptor(sorted(a + b + c for a in "abc" for b in "xy" for c in ("ing", "ed", "")))
    assert len({(f, *a.items()) for f, a in zip(made.final, made.arcs)}) == len(made.arcs) == 7


def test_long_words_need_no_deep_recursion():
    word = "ab" * 50_000
    assert list(sf.Acceptor(sorted([word, word + "x", word[:7] + word[8:]])).pairs())


def documents():
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choice("abA") for _ in range(rng.randint(5, 9))) for _ in range(50))) for i in range(300)]
    rows += [(1000 + i, f"separate separate, separate receive {rng.choice(['seperate', 'separat', 'recieve', 'receve'])}") for i in range(60)]
    # A variant's variant.
    rows += [(3000, "alphabet " * 400), (3001, "alphabett " * 50), (3002, "alphabettt " * 8)]
    rows += [(None, None), (None, ""), (3, "éàçüÿ× éàçüÿ× éàçüÿx " * 9), (None, "Hellow helloww helloww! " * 4), (2000, ("q" * 3000 + " ") * 6 + ("q" * 2999 + " ") * 40)]
    return rows + rows[:5]


@pytest.mark.parametrize("largest", [20_000, 12])
def test_rows_equal_brute_force(spark, largest):
    rows = [r for r in documents() if largest > 100 or len(r[1] or "") < 10_000]
    docs = spark.createDataFrame([(t, i, 1, "k") for i, t in rows], "text string, doc_id long, n int, word string")
    found = sorted(map(tuple, sf.variants(docs, sf.SpellingParams(largest=largest)).collect()))
    expected = plain(rows)
    assert found == expected and any(r[1] for r in expected) and any(r[2] not in (r[0], r[1]) for r in expected)


def test_empty_table(spark):
    assert sf.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0

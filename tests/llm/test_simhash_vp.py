import random

import numpy as np
import xxhash

from netspark.llm import simhash_vp as vp


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(values, bits=3):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= bits:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def clouds(rng, n):
    out = []
    for _ in range(n):
        kind, centre = rng.random(), rng.getrandbits(64)
        if kind < 0.3 and out:
            centre = rng.choice(out)
        for _ in range(rng.choice([1, 1, 2, 5])):
            value = centre
            for _ in range(rng.randint(0, 5)):
                value ^= 1 << rng.randrange(64)
            out.append(value)
    fixed = rng.getrandbits(32)  # many equal halves
    return out + [(fixed << 32) | (rng.getrandbits(9) * 37) for _ in range(150)]


def test_search_equals_all_pairs():
    rng = random.Random(11)
    for _ in range(4):
        values = clouds(rng, 250)
        array = np.array(values, np.uint64)
        found = vp.Forest(len(values))
        for mask in vp.HALVES:
            vp.search(array, np.arange(len(values)), np.arange(len(values)), mask, 3, found)
        first = {}
        label = [first.setdefault(x, i) for i, x in enumerate(found.settle())]
        assert label == plain_components(values)


def test_routing_keeps_every_pair():
    rng = random.Random(12)
    values = clouds(rng, 600)
    array = np.array(values, np.uint64)
    pairs = set()
    for mask in vp.HALVES:
        root = vp.grow(array[::3], mask, 3, 16, [])
        lives = {}
        for shard, at, home in vp.route(root, array, np.arange(len(array)), np.ones(len(array), bool)):
            lives[shard] = (set(at), set(at[home]))
        assert sorted(x for _, home in lives.values() for x in home) == list(range(len(array)))
        pairs |= {(a, b) for seen, home in lives.values() for a in home for b in seen}
    for i in range(len(values)):
        for j in range(len(values)):
            if bin(values[i] ^ values[j]).count("1") <= 3:
                assert (i, j) in pairs


def test_rows_equal_brute_force(spark):
    rng = random.Random(13)
    words = ["alpha", "Beta", "gamma", "delta", "ñu", "x"]
    texts = [None, "", " \t\n", "a", "A b", "a  b\tc", "b"]
    for _ in range(150):
        base = [rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.choice([3, 12, 80]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            other = list(base)
            other[rng.randrange(len(other))] = "changed"
            texts.append("\n".join(other) if rng.random() < 0.5 else " ".join(other).upper())
    rows = [(7 * i % 1009, t, "bits", i) for i, t in enumerate(texts)] + [(4, "tie a b c", "", 1), (4, "tie a b c", "", 1), (None, "no id here", "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bits string, label int")
    found = vp.near_duplicates(docs, shard=40).collect()
    values = [plain_fingerprint(r[1]) for r in rows]
    label = plain_components(values)
    smallest = {x: min((r[0] for r, y in zip(rows, label) if x == y and r[0] is not None), default=None) for x in set(label)}
    expected = [(r[0], f"{v:016x}", smallest[x]) for r, v, x in zip(rows, values, label)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


def test_empty_table(spark):
    assert vp.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0

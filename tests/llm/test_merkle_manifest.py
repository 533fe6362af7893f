import hashlib
import random
import zlib

import numpy as np
import pytest

from netspark.llm import merkle_manifest as mm


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    return digest(*map(field, (doc_id, source, lang, n_chars if n_chars is None else n_chars + more, text)))


def levels_of(nodes, arity):
    found = [nodes]
    while len(nodes) > 1:
        nodes = [digest(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
        found.append(nodes)
    return found


def path_of(levels, i, arity):
    out = []
    for level in levels[:-1]:
        out.append((i % arity, level[i - i % arity : i - i % arity + arity]))
        i //= arity
    return out


def plain(rows, arity):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for lang in langs:
        own = sorted(trees[lang], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        built[lang] = own, levels_of([plain_leaf(r) for r in own], arity)
    top = levels_of([built[x][1][-1][0] for x in langs], arity)
    out = []
    for k, lang in enumerate(langs):
        own, levels = built[lang]
        for i, row in enumerate(own):
            steps = path_of(levels, i, arity) + path_of(top, k, arity)
            others = [x for slot, run in steps for j, x in enumerate(run) if j != slot]
            now = plain_leaf(row, int(row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0))
            for slot, run in steps:
                now = digest(*run[:slot], now, *run[slot + 1 :])
            out.append((row[0], plain_leaf(row), levels[-1][0], top[-1][0], digest(*others), now, now == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def documents(n):
    rng = random.Random(n)
    rows = [(i, f"s{i % 3}", rng.choice(["en", "en", "en", "de", None]), rng.choice([None, i]), "x" * rng.randrange(300)) for i in range(n)]
    rows += [(None, None, None, None, None), (None, "a", "zz", 3, "x"), (7, "é", "ü", None, "ß"), (7, "é", "ü", 4, "ß"), (7, "é", "ü", 4, "ß"), (-5, "", "", 0, ""), (9, "s", "en", 1, "y" * 300_000)]
    return rows


def test_sha256_over_arrays():
    rng = random.Random(1)
    parts = [[hashlib.sha256(rng.randbytes(9)).digest() for _ in range(40)] for _ in range(4)]
    for count in range(5):
        state = mm.start(40)
        for part in parts[:count]:
            state = mm.compress(state, mm.as_block(mm.unpack(b"".join(part))))
        found = mm.as_text(mm.finish(state, np.full(40, count))).to_pylist()
        assert found == [digest(*(parts[k][i].hex() for k in range(count))) for i in range(40)]


def test_states_are_those_before_each_slot():
    leaves = mm.unpack(b"".join(hashlib.sha256(bytes([i])).digest() for i in range(11)))
    levels, root = mm.grow(leaves, 3, None)
    assert mm.as_text(root).to_pylist() == levels_of(mm.as_text(leaves).to_pylist(), 3)[-1]
    # A parent can be finished from the state before its last child and that child alone.
    row = {"leaves": mm.pack(leaves), "states": b"".join(mm.pack(x.states) for x in levels), "levels": len(levels)}
    for kept, again in zip(levels, mm._levels(row, 3), strict=True):
        assert (kept.children == again.children).all() and (kept.states == again.states).all()


@pytest.mark.parametrize("params", [mm.MerkleParams(), mm.MerkleParams(2, 3), mm.MerkleParams(3, 2)])
def test_rows_equal_brute_force(spark, params):
    rows = documents(90)
    found = mm.digests(spark.createDataFrame(rows, SCHEMA), params).collect()
    assert sorted(map(tuple, found), key=str) == plain(rows, params.arity)
    assert any(r.verified for r in found) and not all(r.verified for r in found)


def test_clashing_columns_one_row_and_empty_table(spark):
    wide = spark.createDataFrame([(*documents(1)[0], "a", 1, b"z")], SCHEMA + ", tree string, place long, leaf binary")
    row = mm.digests(wide).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == digest() and row.folded_root in (row.root, plain_leaf(documents(1)[0], 1))
    assert mm.digests(spark.createDataFrame([], SCHEMA)).count() == 0

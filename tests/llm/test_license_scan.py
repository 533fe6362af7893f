import random
import re

import numpy as np
import pyarrow as pa

from netspark.llm import license_scan
from netspark.llm.license_scan import TEMPLATES


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_planted_licenses_are_found_with_their_spans(spark):
    rng = random.Random(1)
    rows, wanted = [(0, None), (1, ""), (2, "license"), (None, TEMPLATES[6][1])], {(None, "Apache-2.0")}
    for i in range(3, 200):
        before, after = prose(rng, rng.randrange(60)), prose(rng, rng.randrange(60))
        if i % 2:
            rows.append((i, f"{before} {after}"))
            continue
        name, text = rng.choice(TEMPLATES)
        words = text.split()
        if len(words) > 20:  # change a few words
            for _ in range(len(words) // 25):
                words[rng.randrange(len(words))] = rng.choice(["", "changed", "two words"])
        text = " ".join(words)
        rows.append((i, f"é{before}. {text.upper() if i % 3 else text}\n{after}"))
        wanted.add((i, name))
    rows += [rows[6], rows[6]]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    found = license_scan.scan(docs).collect()
    assert {(r.doc_id, r.license) for r in found} == wanted
    assert sum(r.doc_id == rows[6][0] for r in found) in (0, 3)
    for r in found:
        text = dict((x[0], x[1]) for x in rows)[r.doc_id].encode()[r.start : r.stop].decode().lower()
        words = set(re.findall("[a-z0-9]+", TEMPLATES[r.template][1].lower()))
        assert r.coverage >= 0.8 and r.coverage == r.matched_words / r.template_words
        assert r.stop - r.start <= 1.3 * len(TEMPLATES[r.template][1])
        assert sum(w in words for w in re.findall("[a-z0-9]+", text)) >= r.matched_words


def subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_equals_the_full_table():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randint(1, 12))]
        b = [rng.randrange(6) for _ in range(rng.randint(1, 12))]
        start, stop, matched = license_scan.aligned(np.array(a, np.uint64), np.array(b, np.uint64), 0, 30)
        assert matched == subsequence(a, b)
        if matched:
            assert subsequence(a, b[start:stop]) == matched


def test_any_long_enough_common_run_shares_a_pick():
    rng = np.random.default_rng(3)
    for _ in range(50):
        common = rng.integers(0, 1 << 60, 5).astype(np.uint64)
        texts = [np.concatenate([rng.integers(0, 1 << 60, rng.integers(0, 9)).astype(np.uint64), common, rng.integers(0, 1 << 60, rng.integers(0, 9)).astype(np.uint64)]) for _ in range(2)]
        picks = []
        for words in texts:
            hashes = license_scan.gram_hashes(words, 3)
            picks.append(set(hashes[license_scan.winnowed(hashes, 3)].tolist()))
        assert picks[0] & picks[1]


def scanned(text):
    index = license_scan.Index(license_scan.LicenseParams())
    words, _, _, first = license_scan.words_with_places(*license_scan.text_bytes(pa.array([text])))
    return [(index.names[number], a, b, matched / len(index.words[number])) for _, number, a, b, matched in index.scan(words, first)]


def test_bare_reservation_is_found_anywhere():
    rng = random.Random(5)
    for _ in range(200):
        before = rng.randrange(30)
        assert scanned(f"{prose(rng, before)} All rights reserved. {prose(rng, 20)}") == [("Proprietary", before, before + 3, 1.0)]


def test_relatives_are_told_apart():
    texts = {}
    for name, text in TEMPLATES:
        if len(text.split()) > 50:
            texts[name] = text
    assert {"BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0"} <= set(texts)
    assert "POSSIBILITY OF SUCH DAMAGE" in texts["BSD-2-Clause"] and "Neither the name" in texts["BSD-3-Clause"]
    for name, text in texts.items():
        assert [(m[0], m[3]) for m in scanned(text)] == [(name, 1.0)]


def test_every_place_of_a_repeated_notice_is_found():
    for number in (1, 6, 12, len(TEMPLATES) - 1):
        name, text = TEMPLATES[number]
        size = len(license_scan.Index(license_scan.LicenseParams()).words[number])
        for times in (2, 3, 7):
            found = sorted(scanned(f"one two. {' '.join([text] * times)} three"))
            assert found == [(name, 2 + k * size, 2 + (k + 1) * size, 1.0) for k in range(times)]


def test_empty_table(spark):
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0

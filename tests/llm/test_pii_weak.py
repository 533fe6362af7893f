import hashlib
import random
import re

import pytest

from netspark.llm import pii_weak

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 if kind == "phone" else True


def base(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in p.finditer(text or "") if valid(k, m.group())]


def card(rng, n=16):
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return digits + next(d for d in "0123456789" if luhn(digits + d))


def texts():
    rng = random.Random(8)
    out = [
        None, "", "a@b.c_d@e.f@g.h", "a@b c@d.e x@y@z.w", "é" * 7 + " ü.x+1@mail.example.com, 日本 1.2.3.4.5.6.7.8", "300.1.2.3.4 001.2.3.255 1.2.3.256",
        "a" * 3000 + "@", "x." * 1500 + "@y", "1.2.3.4" * 40, "+1 (578) 555-6437. +1234567 +12 3-4.5()6 7 8 9", "4111 1111 1111 1111-", "4111-1111-1111-1111 5",
        "41111111111111111111111", "4111  1111 1111 1111", "12 34 56 " * 50, "me (at) host [dot] org call 555-123-4567 or (555) 123-4567", "fe80::1ff:fe23:4567:890a 12:30:45",
        "@.@", "+", "++1 22 33 44 55 66", "a@b.c" * 300,
    ]
    alphabet = "0123456789" * 2 + "abé@+.-  ()%_\n日"
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(90))) for _ in range(700)]
    for _ in range(100):
        out.append(f"x {card(rng, rng.choice([15, 16, 17, 18, 19, 20]))} y +44 {rng.randrange(10**9)} z u{rng.randrange(99)}@mail.example.org {rng.randrange(300)}.{rng.randrange(300)}.1.2")
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i else None, t, 5, "s") for i, t in enumerate(texts())] + [(3, "tie a@b.cd", 1, "s")] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars int, spans string")


def test_base_spans_equal_brute_force_and_stay(docs):
    found = pii_weak.digests(docs).collect()
    expected = []
    for row in docs.collect():
        spans = base(row.text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        expected.append((row.doc_id, *(sum(s[0] == k for s in spans) for k in BASE), hashlib.sha256(joined.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r[:6]) for r in found), key=key) == sorted(expected, key=key)
    by_id = {r.doc_id: set(r.spans.split(",")) for r in found}
    for row in docs.collect():
        if row.doc_id != 3:
            assert {f"{k}:{a}:{b}" for k, a, b in base(row.text)} <= by_id[row.doc_id]


def test_redaction_takes_effect(docs):
    out = pii_weak.redact(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    for row in docs.collect():
        done = rows[row.doc_id]
        if not row.text:
            assert done.text == row.text
            continue
        assert not any(k == "email" for k, *_ in base(done.text))
        if not re.search(r"[0-9@]", row.text):
            assert done.text == row.text
        assert done.n_chars == len(done.text)
    assert rows[3].text == "tie <EMAIL>"


def test_em_finds_the_reliable_labelers():
    rng = random.Random(1)
    patterns = {}
    for _ in range(4000):
        truth = rng.random() < 0.4
        vote = tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < right) == truth else -1) for right in (0.95, 0.9, 0.85, 0.6, 0.55, 0.8))
        patterns[vote] = patterns.get(vote, 0) + 1
    post, table = pii_weak.expectation_maximisation(patterns)
    said = [t[1, 1] / (t[1, 1] + t[-1, 1]) for t in table]
    assert abs(said[0] - 0.95) < 0.03 and abs(said[3] - 0.6) < 0.06
    assert post[max(patterns, key=sum)] > 0.9 > 0.1 > post[min(patterns, key=sum)]


def test_likely_candidates_are_added(spark):
    rng = random.Random(9)
    rows = [(i, f"please call my phone 555-{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)} now, or phone +1 555 {rng.randrange(100, 999)} 1234") for i in range(200)]
    rows += [(300 + i, f"on page 12-{rng.randrange(100, 999)}-{rng.randrange(100, 999)}x of order +0 {rng.randrange(10**7, 10**8)}") for i in range(200)]
    found = {r.doc_id: r.spans.split(",") for r in pii_weak.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(len(found[i]) == 2 for i in range(200)) > 190
    assert sum("phone:11" in s or "phone:8:" in s for i in range(300, 500) for s in found[i]) < 10


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii_weak.digests(none).count() == 0 and pii_weak.redact(none).count() == 0

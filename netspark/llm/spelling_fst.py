"""Spelling variants by finite-state composition: the vocabulary's acceptor, one edit, and the acceptor again.

The minimised acceptor of a set of words, composed with the transducer of one inserted, deleted or replaced character and
with the acceptor itself, accepts exactly the pairs of words that are one edit apart. As the acceptor is deterministic, both
tapes stand in the same state until the first place where the words differ; the edit is made there, and from there on the
pair of states goes on without one. So each pair has one accepting run and is enumerated once, and words are numbered by the
counts of accepted words below each state.

The composition is enumerated per initial-state partition. Of two near words the shorter one has m characters, and they share the first
m // 2 or the last m - m // 2 ones: forwards, a partition begins in the state that is reached by a first half, and backwards, in
the acceptor of the reversed words, in that of a second half. Backwards only pairs that differ within the first half count. So a word
is in four partitions at most, and they are spread by their keys. A partition of more than `largest` words is cut at
every place after its first half instead: words that are equal but for one place meet in a partition of
their own, which has at most a word per character. Nothing is dropped.

Words are the maximal runs of letters, A-Z in lower case, that are long and frequent enough; where 199 divides the
crc32 of `<doc_id>:<run>` the run loses a character first, by the same number. A null text has no runs; a null doc_id counts as no characters
in that key. Empty texts have no runs; repeated rows count again; ties between forms go to the smallest word in code-point order. Very
long texts are read whole, one at a time; a word of any length is one row. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.llm.common import cut, slices

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Bytes of text whose runs are counted before they leave a task.
SLICE = 16 << 20


@dataclass(frozen=True)
class SpellingParams:
    least_length: int = 6
    least_count: int = 5
    #: One in so many runs of a document loses a character; 0 for none.
    damage: int = 199
    #: A form is so many times as frequent as its variant.
    ratio: int = 5
    #: Words of a partition beyond which it is cut at every place.
    largest: int = 20_000


def vocabulary(docs: DataFrame, params: SpellingParams = SpellingParams()) -> DataFrame:
    """word and n of all words that are long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE):
            counts: Counter[str] = Counter()
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                runs = Counter(RUN.findall((text or "").translate(LOWER)))
                begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in runs.items():
                    if len(word) >= params.least_length:
                        if params.damage and (h := zlib.crc32(word.encode(), begun)) % params.damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < params.least_length:
                                continue
                        counts[word] += n
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    found = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= params.least_count)


class Acceptor:
    """The minimal deterministic acceptor of sorted, distinct words. State: its arcs by character, in order, and whether it accepts."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        #: Words that are accepted from a state.
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        # The states on the last word's way that may still get arcs.
        way: list[tuple[dict[str, int], bool]] = [({}, False)]
        last = ""

        def settle(down_to: int) -> None:
            while len(way) > down_to + 1:
                arcs, final = way.pop()
                way[-1][0][last[len(way) - 1]] = self._state(arcs, final, known)

        for word in words:
            shared = 0
            while shared < len(last) and shared < len(word) and last[shared] == word[shared]:
                shared += 1
            settle(shared)
            way.extend(({}, False) for _ in range(len(word) - shared))
            way[-1] = (way[-1][0], True)
            last = word
        settle(0)
        self.first = self._state(*way[0], known)

    def _state(self, arcs: dict[str, int], final: bool, known: dict[tuple, int]) -> int:
        key = (final, *arcs.items())
        state = known.get(key)
        if state is None:
            state = known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
            self.size.append(final + sum(self.size[x] for x in arcs.values()))
        return state

    def common(self, left: int, right: int) -> list[tuple[int, int]]:
        """Numbers, in each state's own order, of the words that both states accept: the rest of the composition after the edit."""
        found, todo = [], [(left, right, 0, 0)]
        while todo:
            p, q, i, j = todo.pop()
            if p == q:
                found.extend((i + k, j + k) for k in range(self.size[p]))
                continue
            if self.final[p]:
                if self.final[q]:
                    found.append((i, j))
                i += 1
            if self.final[q]:
                j += 1
            others, offsets = self.arcs[q], None
            for c, x in self.arcs[p].items():
                if c in others:
                    if offsets is None:
                        offsets = self._offsets(others, j)
                    todo.append((x, others[c], i, offsets[c]))
                i += self.size[x]
        return found

    def _offsets(self, arcs: dict[str, int], first: int) -> dict[str, int]:
        out = {}
        for c, x in arcs.items():
            out[c] = first
            first += self.size[x]
        return out

    def edits(self, state: int) -> list[tuple[int, int]]:
        """Number pairs, counted from `state`, of the words that differ first right there, by one edit."""
        found, arcs = [], self.arcs[state]
        offsets = self._offsets(arcs, int(self.final[state]))
        entries = list(arcs.items())
        for k, (c, x) in enumerate(entries):
            # Replaced: the other tape takes another arc.
            for d, y in entries[k + 1 :]:
                found.extend((offsets[c] + i, offsets[d] + j) for i, j in self.common(x, y))
            # Inserted on this tape: the other one stays, and does not go on with the same character.
            begin = offsets[c]
            found.extend((begin + i, j) for i, j in self.common(x, state) if not begin <= j < begin + self.size[x])
        return found

    def pairs(self) -> Iterator[tuple[int, int]]:
        """Numbers of all pairs of words that are one edit apart, each once."""
        known: dict[int, list[tuple[int, int]]] = {}
        todo = [(self.first, 0)]
        while todo:
            state, number = todo.pop()
            if self.size[state] < 2:
                continue
            here = known.get(state)
            if here is None:
                here = known[state] = self.edits(state)
            for i, j in here:
                yield number + i, number + j
            number += self.final[state]
            for x in self.arcs[state].values():
                todo.append((x, number))
                number += self.size[x]


def shared(a: str, b: str) -> int:
    """Characters at the start that are the same."""
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def partition_links(key: str, rows: list[tuple[str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, greatest n among them, smallest word of that n) for the words of one partition that have any there.

    The key is f (forwards), r (backwards) or c (cut at a place), the shorter word's length, the half's or the cut's number of
    characters, and the characters.
    """
    kind, length, place = key.split(":", 3)[:3]
    shorter, half, back = int(length), int(place), kind == "r"
    ordered = sorted((word[::-1] if back else word, n) for word, n in rows)
    words = [word[::-1] if back else word for word, _ in ordered]
    best: dict[int, list] = {}
    for i, j in Acceptor([word for word, _ in ordered]).pairs():
        a, b = words[i], words[j]
        if min(len(a), len(b)) != shorter or (back and shared(a, b) >= half) or (kind == "c" and shared(a, b) != half):
            continue
        for own, other in ((i, j), (j, i)):
            count, word = ordered[other][1], words[other]
            kept = best.get(own)
            if kept is None:
                best[own] = [1, count, word]
            else:
                kept[0] += 1
                if (count, kept[2]) > (kept[1], word):
                    kept[1:] = count, word
    for own, (n, count, word) in best.items():
        yield words[own], n, count, word


def _keys(least: int) -> str:
    """SQL: the keys of a word's partitions, forwards and backwards, as the shorter and as the longer word of a pair."""
    made = []
    for m in ("length(word)", "length(word) - 1"):
        half = f"(({m}) div 2)"
        made.append(f"if({m} < {least}, null, concat('f:', {m}, ':', {half}, ':', left(word, {half})))")
        made.append(f"if({m} < {least}, null, concat('r:', {m}, ':', {half}, ':', right(word, {m} - {half})))")
    return f"explode(filter(array({', '.join(made)}), k -> k is not null))"


def _cuts() -> str:
    """SQL: the keys of a hot forward (backward) partition's word, one or two for each place after (before) the shared half.

    Words that differ first at place p are equal before and after it. The shorter one has m characters, so where one is
    inserted the last m - p are the same, and where one is replaced, in words of m both, the last m - p - 1.
    """
    places = "if(kind = 'f', sequence(half, m), if(half = 0, array(), sequence(0, half - 1)))"
    made = f"flatten(transform({places}, p -> array(named_struct('p', p, 'tail', m - p), named_struct('p', p, 'tail', m - p - 1))))"
    wanted = f"filter({made}, x -> x.tail = m - x.p or (x.tail >= 0 and length(word) = m))"
    return f"explode(transform({wanted}, x -> concat('c:', m, ':', x.p, ':', x.tail, ':', left(word, x.p), '|', right(word, x.tail))))"


def links(words: DataFrame, params: SpellingParams = SpellingParams()) -> DataFrame:
    """word, n_near, best_n and best: near words of each word that has any, and the most frequent one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int]] = []
        now, out = None, []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "near", "best_n", "best"])

        for part in batches:
            for key, word, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if key != now:
                    if len(held) > 1:
                        out.extend(partition_links(now, held))
                    now, held = key, []
                    if len(out) >= 10_000:
                        yield batch()
                held.append((word, n))
        if len(held) > 1:
            out.extend(partition_links(now, held))
        if out:
            yield batch()

    words = cut(words)
    keyed = words.selectExpr(f"{_keys(params.least_length)} as key", "word", "n")
    sizes = cut(keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
    hot = sizes.filter(F.col("size") > params.largest).select("key")
    plain = sizes.filter(F.col("size") <= params.largest).select("key")
    chosen = keyed.join(plain, "key", "left_semi")
    if not hot.isEmpty():
        # At most 4 / `largest` of the number of words.
        whole = keyed.join(hot, "key", "left_semi").selectExpr("split(key, ':')[0] as kind", "cast(split(key, ':')[1] as int) as m", "cast(split(key, ':')[2] as int) as half", "word", "n")
        chosen = chosen.unionByName(whole.selectExpr(f"{_cuts()} as key", "word", "n"))
    found = chosen.repartition("key").sortWithinPartitions("key").mapInArrow(run, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def variants(docs: DataFrame, params: SpellingParams = SpellingParams()) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary."""
    words = cut(vocabulary(docs, params))
    near = words.join(links(words, params), "word", "left")
    ok = F.col("best_n") >= params.ratio * F.col("n")
    formed = cut(near.select("word", F.when(ok, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(ok, F.col("best_n")).alias("form_n")))
    # Forms are more frequent by `ratio`, so ways are short and have no circles; each round doubles how far a form is followed.
    ways = cut(formed.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = cut(ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        ways = further.select("word", "root")
        if further.filter("moved").isEmpty():
            break
    return formed.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

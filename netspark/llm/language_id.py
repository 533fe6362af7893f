"""Language identification, word first: known words by their log frequency per language, others by character n-grams.

A word that was learned adds its log frequency in each language. Any other word backs off: its n-grams of the longest
order with a learned n-gram add their mean log frequency; if none is known, the next shorter order is tried.
The language with the largest sum wins; the score is its share under equal priors.

The model is fitted on a bounded sample: of every language about `docs_per_lang` labelled documents, whole, chosen by a
hash of their id, and keeps every word and n-gram of these. This bound is a parameter of the fit: the model that goes to
every task has the vocabulary of at most about `docs_per_lang` documents a language. Every document is predicted from its whole text.

A null text or one without letters is `und` with score 0, as is any text if nothing could be learned. A null lang
teaches nothing; a null doc_id teaches nothing and is not held out. Equal sums go to the language that sorts first.
Repeated rows each get their row; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.llm.common import slices

UNKNOWN = "und"
ORDERS = (4, 3, 2, 1)
LETTERS = re.compile(r"[^\W\d_]+")
SLICE = 4 << 20
#: Unseen words whose sums a worker keeps, and words of a document that are looked up at once.
MEMORY, BLOCK = 200_000, 50_000


@dataclass(frozen=True)
class LanguageParams:
    docs_per_lang: int = 3000
    smooth: float = 0.5


def is_held_out(key: str = "doc_id", of: int = 4, held: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % of == held, F.lit(False))


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def grams_of(word: str, order: int) -> list[str]:
    marked = f" {word} "
    return [marked[i : i + order] for i in range(len(marked) - order + 1)] if order > 1 else list(word)


@dataclass
class Model:
    """Log frequencies: a row per word or n-gram, a column per language; order 0 has the words."""

    languages: list[str]
    rows: list[dict[str, int]]
    tables: list[np.ndarray]

    def unseen(self, word: str) -> np.ndarray:
        """Backed-off sums of a word that is not known."""
        for rows, table, order in zip(self.rows[1:], self.tables[1:], ORDERS, strict=True):
            found = [rows[g] for g in grams_of(word, order) if g in rows]
            if found:
                return table[found].mean(axis=0)
        return np.zeros(len(self.languages), np.float32)


def fit(docs: DataFrame, params: LanguageParams = LanguageParams()) -> Model:
    """Learn from the documents that are not held out and have a language."""
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row per language
    languages = sorted(sizes)
    if not languages:
        return Model([], [{} for _ in range(5)], [np.zeros((0, 0), np.float32)] * 5)
    shares = F.create_map(*[F.lit(x) for lang in languages for x in (lang, params.docs_per_lang / sizes[lang])])
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / (1 << 30)
    sample = known.filter(place < F.element_at(shares, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE):
            seen: dict[str, Counter] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
            for lang, words in seen.items():
                out = [(lang, 0, w, n) for w, n in words.items()]
                for order in ORDERS:
                    grams: Counter = Counter()
                    for w, n in words.items():
                        for g in grams_of(w, order):
                            grams[g] += n
                    out += [(lang, order, g, n) for g, n in grams.items()]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["lang", "kind", "token", "n"]) if out else _nothing()

    counted = sample.mapInArrow(count, "lang string, kind bigint, token string, n bigint").groupBy("lang", "kind", "token").agg(F.sum("n").alias("n"))
    kept = counted.toArrow()
    number = {lang: i for i, lang in enumerate(languages)}
    rows, tables = [], []
    for kind in (0, *ORDERS):
        part = kept.filter(pa.compute.equal(kept.column("kind"), kind))
        names = sorted(set(part.column("token").to_pylist()))
        row = {w: i for i, w in enumerate(names)}
        counts = np.zeros((len(names), len(languages)))
        for lang, token, n in zip(part.column("lang").to_pylist(), part.column("token").to_pylist(), part.column("n").to_pylist(), strict=True):
            counts[row[token], number[lang]] = n
        rows.append(row)
        tables.append(np.log((counts + params.smooth) / (counts.sum(axis=0) + params.smooth * max(1, len(names)))).astype(np.float32))
    return Model(languages, rows, tables)


def _nothing() -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"lang": pa.array([], pa.string()), "kind": pa.array([], pa.int64()), "token": pa.array([], pa.string()), "n": pa.array([], pa.int64())})


class Predictor:
    """Sums over words; unseen words are worked out once and kept while there is room."""

    def __init__(self, model: Model):
        self.model, self.fixed = model, len(model.tables[0])
        self.table = np.concatenate([model.tables[0], np.zeros((MEMORY + BLOCK, len(model.languages)), np.float32)])
        self.row = dict(model.rows[0])
        self.used = self.fixed

    def _sum(self, words: list[str]) -> np.ndarray:
        if self.used + len(words) > len(self.table):
            self.row, self.used = dict(self.model.rows[0]), self.fixed
        row = self.row
        for word in set(words).difference(row):
            self.table[self.used] = self.model.unseen(word)
            row[word] = self.used
            self.used += 1
        return self.table[[row[w] for w in words]].sum(axis=0, dtype=np.float64)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text or "")
        if not self.model.languages or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        total = sum((self._sum(words[i : i + BLOCK]) for i in range(0, len(words), BLOCK)), np.zeros(len(self.model.languages)))
        best = int(np.argmax(total))
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row, from its text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Predictor(sent.value)
        for part in slices(batches, SLICE):
            found = [own.predict(text) for text in part.column(1).to_pylist()]
            langs, scores = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def languages(docs: DataFrame, params: LanguageParams = LanguageParams()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    return predict(docs, fit(docs, params)).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")

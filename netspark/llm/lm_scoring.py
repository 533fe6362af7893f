"""Cross-entropy difference between a target and a background bigram model.

Both models are word bigrams interpolated with unigrams, with the same words, the same weights and the same
add-`smooth` unigrams over one shared vocabulary, the word types of the whole corpus. The target model counts the target
documents, the background model every document. Each token is scored by the difference of its losses,
ln P_background - ln P_target, and a document by their mean: the lower, the more it is like the target.

Words are what white space parts, in lower case, held as hashes of at least 18 bits more than the corpus needs to
number its words. Each slice of documents sends its distinct words and bigrams with their counts to partitions of the key
space, where the counts of all slices are summed, and gets the sums back for its own keys. So no model is held in one
place, every document counts, and what is gathered grows with the corpus. A frequent word is one entry per slice.

Null and empty texts have no tokens and a null score. A document that no label speaks of is background alone. Repeated rows
count as often as they stand. Without target documents the target model is uniform. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.llm import packed
from netspark.llm.common import cut, lower_ascii, mix, word_hashes, word_spans

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


@dataclass(frozen=True)
class LmParams:
    #: Weight of the bigram against the unigram estimate.
    bigram: float = 0.6
    smooth: float = 0.1


def tokens(one: packed.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a slice and the document of each."""
    data = lower_ascii(one.data)
    starts, ends, doc = word_spans(IS_WORD[data], one.offsets)
    return word_hashes(data, starts, ends), doc


def keys_of(words: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words, and of each word with the one before it; a document's first word follows a mark."""
    first = np.append(True, doc[1:] != doc[:-1])[: len(words)]
    before = np.where(first, np.uint64(0), np.roll(words, 1))
    pairs = mix((before * np.uint64(0x9E3779B97F4A7C15)) ^ (words + np.uint64(0x632BE59BD9B4E019)))
    # The lowest bit tells a word from a pair.
    drop = np.uint64(64 - bits)
    return (words >> drop) & ~np.uint64(1), (pairs >> drop) | np.uint64(1)


def scores(docs: DataFrame, target: str, params: LmParams = LmParams(), slice_bytes: int = packed.SLICE) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss (nats a token) and their difference `score`; `target` is SQL on a row."""
    slices = packed.pack(docs, target, slice_bytes)
    partitions, size = packed.plan(slices)
    bits = min(64, max(16, size.bit_length()) + 18)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in packed.rows(batch):
                one = packed.Slice(row)
                words, doc = tokens(one)
                key, of = np.unique(np.concatenate(keys_of(words, doc, bits)), return_inverse=True)
                wanted = np.tile(one.flags[doc], 2)
                every, ours = np.bincount(of, minlength=len(key)), np.bincount(of[wanted], minlength=len(key))
                parts, cuts = packed.dealt(key, partitions, bits)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(parts, pa.int32()),
                        "slice": pa.array([one.name] * len(parts), pa.string()),
                        "keys": pa.array([packed.squeeze_sorted(key[c]) for c in cuts], pa.binary()),
                        "every": pa.array([packed.squeeze(every[c]) for c in cuts], pa.binary()),
                        "ours": pa.array([packed.squeeze(ours[c]) for c in cuts], pa.binary()),
                    }
                )

    def add(table: pa.Table) -> pa.Table:
        keys = [packed.expand_sorted(x.as_buffer()) for x in table.column("keys")]
        key, of = np.unique(np.concatenate(keys), return_inverse=True)
        sums = []
        for name in ("every", "ours"):
            counts = np.concatenate([packed.expand(x.as_buffer(), "<i8") for x in table.column(name)])
            total = np.zeros(len(key), np.int64)
            np.add.at(total, of, counts)
            sums.append(total)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        word = key & np.uint64(1) == 0
        back = [pa.array([packed.squeeze(x) for x in np.split(s[of], ends)], pa.binary()) for s in sums]
        # Totals of the partition stand in its first row.
        first = np.arange(table.num_rows) == 0
        totals = [pa.array(np.where(first, x, 0)) for x in (int(word.sum()), int(sums[0][word].sum()), int(sums[1][word].sum()))]
        return pa.table([table.column("slice"), table.column("part"), *back, *totals], names=["slice", "part", "every", "ours", "types", "n_every", "n_ours"])

    asked = slices.mapInArrow(ask, "part int, slice string, keys binary, every binary, ours binary")
    answers = "slice string, part int, every binary, ours binary, types bigint, n_every bigint, n_ours bigint"
    counted = cut(asked.repartition(partitions, "part").groupBy("part").applyInArrow(add, answers))
    types, n_every, n_ours = (int(x or 0) for x in counted.agg(F.sum("types"), F.sum("n_every"), F.sum("n_ours")).first())

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        told = sorted(packed.rows(right), key=lambda r: r["part"].as_py())
        done = []
        for row in packed.rows(left):
            one = packed.Slice(row)
            words, doc = tokens(one)
            n, loss = np.bincount(doc, minlength=len(one.ids)), []
            single, pair = keys_of(words, doc, bits)
            of = np.unique(np.concatenate([single, pair]), return_inverse=True)[1]
            first = np.append(True, doc[1:] != doc[:-1])[: len(words)]
            for name, total in (("ours", n_ours), ("every", n_every)):
                count = np.concatenate([np.zeros(0, np.int64), *(packed.expand(r[name].as_buffer(), "<i8") for r in told)])
                alone, both = count[of[: len(words)]], count[of[len(words) :]]
                unigram = (alone + params.smooth) / (total + params.smooth * max(types, 1))
                # A first word's context is the start of a document, which no word counts; there the unigram decides.
                context = np.where(first, 0, np.roll(alone, 1))
                bigram = np.where(context > 0, both / np.maximum(context, 1), unigram)
                p = np.where(context > 0, params.bigram * bigram + (1 - params.bigram) * unigram, unigram)
                total_loss = np.bincount(doc, weights=-np.log(p), minlength=len(one.ids))
                loss.append(np.where(n > 0, total_loss / np.maximum(n, 1), np.nan))
            none = n == 0
            done.append(
                pa.Table.from_arrays(
                    [pa.array(one.ids, mask=one.ids == packed.NO_ID), pa.array(n), *(pa.array(x, mask=none) for x in (*loss, loss[0] - loss[1]))],
                    names=["doc_id", "n_words", "target_loss", "background_loss", "score"],
                )
            )
        return pa.concat_tables(done)

    return slices.groupBy("slice").cogroup(counted.groupBy("slice")).applyInArrow(
        score, "doc_id bigint, n_words bigint, target_loss double, background_loss double, score double"
    )


#: Target ids that are sent to the tasks as one sorted array (32 MB); more are joined.
MOST_SENT = 4 << 20


def with_target(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with `is_target`: some label row calls them good (quality 1)."""
    good = cut(labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("labelled")).distinct())
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if good.count() <= MOST_SENT:
        ids = np.sort(good.toArrow().column("labelled").to_numpy())
        sent = docs.sparkSession.sparkContext.broadcast(ids)

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flags = pa.compute.is_in(batch.column(0), value_set=pa.array(sent.value))
                yield pa.RecordBatch.from_arrays([*batch.columns, flags], names=["doc_id", "text", "is_target"])

        return own.mapInArrow(mark, "doc_id bigint, text string, is_target boolean")
    # Rows without an id match no label; their text's hash spreads them.
    spread = own.withColumn("place", F.coalesce("doc_id", F.xxhash64("text")))
    joined = spread.join(good, spread["place"] == good["labelled"], "left")
    return joined.select("doc_id", "text", (F.col("doc_id").isNotNull() & F.col("labelled").isNotNull()).alias("is_target"))

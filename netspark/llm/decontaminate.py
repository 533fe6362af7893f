"""Benchmark decontamination with suffix arrays over the training documents.

Each shard (a slice of whole documents) gets a suffix array over its words: the word positions, ordered by the words
that follow. Every suffix of a benchmark item is binary-searched in it, which gives the places where its first `window`
words stand verbatim; places on one diagonal join to the longest matches. A suffix whose first three words (or fewer, if
an item is shorter) begin no benchmark suffix can't be found by any search, so such suffixes are left out before sorting.

Words are runs of 0-9, a-z and non-ASCII characters after A-Z is lower-cased, held as 64-bit hashes. A window is `window`
words; an item of fewer words, but not none, is one window. The benchmark is sent to the tasks in blocks of at most
`block_words` words, so no task holds more of it at once; each block is searched over all documents. A longer item is
cut to pieces that overlap by `window` - 1 words, each a block; what they find is put together again.

Null and empty texts have no words and are never hit. Items with equal ids count as one; an item without an id
marks words but is not named. Repeated documents each get their row. Very long texts are searched whole; a text that
repeats a passage which an item repeats too has a match for each pair of places. An empty benchmark hits nothing, an empty
documents table gives no rows. Further columns are not read by `scan` and kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.llm.common import cut, lower_ascii, mix, slices, text_bytes, word_hashes, word_spans

WINDOW, BLOCK_WORDS = 10, 1 << 20
SLICE = 8 << 20
#: Words per 64-bit column of a suffix, and the bits of each; word numbers are at most BLOCK_WORDS.
PACK, BITS = 3, 21
LEAD = 3

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True

STATE = "n_words bigint, hit_start array<int>, hit_end array<int>, items array<string>, matches array<struct<item_id:string,doc_word:int,item_word:int,n_words:int>>"
_MATCH = pa.struct([("item_id", pa.string()), ("doc_word", pa.int32()), ("item_word", pa.int32()), ("n_words", pa.int32())])


def words_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and where each text's words begin."""
    data, offsets = text_bytes(column)
    data = lower_ascii(data)
    starts, ends, text = word_spans(IS_WORD[data], offsets)
    return word_hashes(data, starts, ends), np.searchsorted(text, np.arange(len(offsets)))


class Membership:
    """Which sorted numbers are there, and at what place; a small bit table answers most misses."""

    def __init__(self, numbers: np.ndarray):
        self.numbers = numbers
        self.mask = np.uint64((1 << max(16, (16 * len(numbers)).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[mix(numbers) & self.mask] = True

    def places(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, or -1."""
        out = np.full(len(values), -1, np.int64)
        maybe = np.flatnonzero(self.bits[mix(values) & self.mask])
        if len(maybe):
            place = np.minimum(np.searchsorted(self.numbers, values[maybe]), len(self.numbers) - 1)
            found = self.numbers[place] == values[maybe]
            out[maybe[found]] = place[found]
        return out


def packed(words: np.ndarray, at: np.ndarray, length: np.ndarray, window: int) -> np.ndarray:
    """The `window` words from each place on, PACK to a number, 0 beyond `length`: one row per column."""
    columns = np.zeros((-(-window // PACK), len(at)), np.uint64)
    for k in range(window):
        inside = length > k
        word = np.where(inside, words[np.minimum(at + k, max(len(words) - 1, 0))], 0) if len(words) else 0
        columns[k // PACK] |= np.asarray(word, np.uint64) << np.uint64(BITS * (PACK - 1 - k % PACK))
    return columns


@dataclass
class Block:
    """Distinct benchmark suffixes of one block, ready to be searched."""

    ids: list[str | None]
    vocabulary: Membership
    suffixes: np.ndarray
    keep: np.ndarray
    length: np.ndarray
    lead: int
    leads: Membership
    owner_at: np.ndarray
    owner_item: np.ndarray
    owner_word: np.ndarray
    window: int
    #: Words of the item before this piece of it.
    base: int = 0


def block_of(items: list[tuple[str | None, str | None]], window: int) -> Block | None:
    """None if the items have no words."""
    hashes, first = words_of(pa.array([text for _, text in items], pa.string()))
    if len(hashes) == 0:
        return None
    numbers = np.unique(hashes)
    words = np.searchsorted(numbers, hashes) + 1
    size = np.diff(first)
    places = np.where(size > 0, np.maximum(size - window + 1, 1), 0)
    item = np.repeat(np.arange(len(items)), places)
    within = np.arange(len(item)) - np.repeat(np.cumsum(places) - places, places)
    length = np.minimum(size[item], window)
    columns = packed(words, first[:-1][item] + within, length, window)
    order = np.lexsort([item, *columns[::-1]])
    columns, item, within, length = columns[:, order], item[order], within[order], length[order]
    new = np.append(True, (columns[:, 1:] != columns[:, :-1]).any(axis=0))
    begin = np.flatnonzero(new)
    suffixes, length = columns[:, begin], length[begin]
    keep = np.full_like(suffixes, 0)
    for k in range(window):
        keep[k // PACK] |= np.where(length > k, np.uint64((1 << BITS) - 1), np.uint64(0)) << np.uint64(BITS * (PACK - 1 - k % PACK))
    lead = int(min(LEAD, length.min()))
    dropped = np.uint64(BITS * (PACK - lead))
    leads = Membership(np.unique(suffixes[0] >> dropped))
    return Block([i for i, _ in items], Membership(numbers), suffixes, keep, length, lead, leads, np.append(begin, len(item)), item, within, window)


def lower_bound(array: np.ndarray, block: Block, beyond: bool) -> np.ndarray:
    """Binary search of every benchmark suffix: the first suffix of the array that is not before it, or that is beyond it."""
    low, high = np.zeros(block.suffixes.shape[1], np.int64), np.full(block.suffixes.shape[1], array.shape[1], np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if len(open_) == 0:
            return low
        middle = (low[open_] + high[open_]) // 2
        before, equal = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for column, wanted, keep in zip(array, block.suffixes, block.keep, strict=True):
            have, want = column[middle] & keep[open_], wanted[open_]
            before |= equal & (have < want)
            equal &= have == want
        right = before | equal if beyond else before
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]


def occurrences(hashes: np.ndarray, first: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(place, suffix number) wherever a benchmark suffix stands whole within one document."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = block.vocabulary.places(hashes) + 1
    known = words > 0
    candidate = known.copy()
    for k in range(1, block.lead):
        candidate[:-k] &= known[k:]
        candidate[-k:] = False
    at = np.flatnonzero(candidate)
    if len(at) == 0:
        return none
    left = first[np.searchsorted(first, at, "right")] - at
    at, left = at[left >= block.lead], left[left >= block.lead]
    key = np.zeros(len(at), np.uint64)
    for k in range(block.lead):
        key = (key << np.uint64(BITS)) | words[at + k].astype(np.uint64)
    begins = block.leads.places(key) >= 0
    at, left = at[begins], left[begins]
    if len(at) == 0:
        return none
    columns = packed(words, at, left, block.window)
    order = np.lexsort(columns[::-1])  # the suffix array
    columns, at = columns[:, order], at[order]
    low, high = lower_bound(columns, block, False), lower_bound(columns, block, True)
    count = high - low
    suffix = np.repeat(np.arange(len(count)), count)
    place = at[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(suffix))]
    return place, suffix


def owners(suffix: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """For suffix numbers: (index into `suffix`, index into the block's owner columns), for all items that have them."""
    count = block.owner_at[suffix + 1] - block.owner_at[suffix]
    source = np.repeat(np.arange(len(suffix)), count)
    return source, np.arange(len(source)) + np.repeat(block.owner_at[suffix] - (np.cumsum(count) - count), count)


def longest_matches(place: np.ndarray, suffix: np.ndarray, doc: np.ndarray, block: Block) -> tuple[np.ndarray, ...]:
    """(doc, item, place, item word, words) of the maximal matches: suffixes in a row on one diagonal are one match."""
    source, owner = owners(suffix, block)
    item, word, at, doc = block.owner_item[owner], block.owner_word[owner], place[source], doc[source]
    order = np.lexsort((word, at - word, item, doc))
    item, word, at, doc, length = item[order], word[order], at[order], doc[order], block.length[suffix[source]][order]
    goes_on = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (at[1:] - at[:-1] == 1) & (word[1:] - word[:-1] == 1)
    start = np.flatnonzero(np.append(True, ~goes_on)) if len(at) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(at)) - 1 if len(at) else start
    return doc[start], item[start], at[start], word[start], at[end] - at[start] + length[end]


def _lists(doc: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """Values, sorted by document, as one list per document."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), values)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, with_matches: bool = True) -> DataFrame:
    """doc_id, n_words, hit_start, hit_end (hit runs of words), items (ids with a window in the document), matches (the longest)."""
    context = docs.sparkSession.sparkContext
    key = f"row_id {docs.schema['doc_id'].dataType.simpleString()}"
    state = docs.select(F.col("doc_id").alias("row_id"), F.col("text").cast("string").alias("text"))
    waiting, searched = None, 0
    for block in blocks(benchmark, window, block_words):
        if waiting:
            state = state.mapInArrow(_search(context.broadcast(waiting), with_matches, True), f"{key}, text string, {STATE}")
            searched += 1
            if searched % 4 == 0:
                state = cut(state)
        waiting = block
    # The last search need not hand the texts on.
    sent = context.broadcast(waiting) if waiting else None
    return state.mapInArrow(_search(sent, with_matches, False), f"{key}, {STATE}").withColumnRenamed("row_id", "doc_id")


def blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Block]:
    """The benchmark in blocks of bounded size; one is held at a time."""
    block_words = min(block_words, (1 << BITS) - 1)
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"), F.octet_length("text")).toLocalIterator():
        words = (row[2] or 0) // 2 + 1
        if held and size + words > block_words:
            if block := block_of(held, window):
                yield block
            held, size = [], 0
        if words > block_words:
            for base, text in pieces(row[1], window, block_words):
                if block := block_of([(row[0], text)], window):
                    block.base = base
                    yield block
            continue
        held.append((row[0], row[1]))
        size += words
    if block := block_of(held, window) if held else None:
        yield block


def pieces(text: str, window: int, block_words: int) -> Iterator[tuple[int, str]]:
    """(words before it, text) of pieces of at most `block_words` words, a window at least, that hold every window of the text once."""
    data, offsets = text_bytes(pa.array([text], pa.string()))
    starts, ends, _ = word_spans(IS_WORD[lower_ascii(data)], offsets)
    n, step = len(starts), max(1, block_words - window + 1)
    for base in range(0, max(n - window + 1, min(n, 1)), step):
        yield base, data[starts[base] : ends[min(n, base + step + window - 1) - 1]].tobytes().decode()


def _joined(found: list[dict], match: dict, block: Block) -> bool:
    """Whether a match that begins a piece of an item goes on from one that ends the piece before; then that one is longer now."""
    if block.base == 0 or match["item_word"] != block.base:
        return False
    for last in found:
        end = last["item_word"] + last["n_words"]
        if last["item_id"] == match["item_id"] and end == block.base + block.window - 1 and last["doc_word"] - last["item_word"] == match["doc_word"] - match["item_word"]:
            last["n_words"] += match["n_words"] - block.window + 1
            return True
    return False


def _search(sent, with_matches: bool, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE):
            done = _searched(part, sent.value if sent else None, with_matches)
            yield done if with_text else done.drop_columns(["text"])

    return run


def _searched(part: pa.RecordBatch, block: Block | None, with_matches: bool) -> pa.RecordBatch:
    n = part.num_rows
    hashes, first = words_of(part.column(1))
    before = {name: part.column(i) for i, name in enumerate(part.schema.names)}
    change = np.zeros(len(hashes) + 1, np.int32)
    if "hit_start" in before:
        lengths = pa.compute.list_value_length(before["hit_start"]).to_numpy(zero_copy_only=False)
        base = np.repeat(first[:-1], lengths)
        np.add.at(change, before["hit_start"].flatten().to_numpy() + base, 1)
        np.add.at(change, before["hit_end"].flatten().to_numpy() + base, -1)
    place, suffix = occurrences(hashes, first, block) if block and len(hashes) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    doc = np.searchsorted(first, place, "right") - 1
    if len(place):
        np.add.at(change, place, 1)
        np.add.at(change, place + block.length[suffix], -1)
    hit = np.cumsum(change[:-1]) > 0
    edge = np.zeros(len(hashes) + 1, bool)
    edge[first] = True
    starts = np.flatnonzero(hit & (edge[:-1] | ~np.append(False, hit[:-1])))
    ends = np.flatnonzero(hit & (edge[1:] | ~np.append(hit[1:], False))) + 1
    owner = np.searchsorted(first, starts, "right") - 1
    runs = [_lists(owner, n, pa.array((x - first[owner]).astype(np.int32))) for x in (starts, ends)]

    names: list[list[str]] = before["items"].to_pylist() if "items" in before else [[] for _ in range(n)]
    found: list[list[dict]] = before["matches"].to_pylist() if "matches" in before else [[] for _ in range(n)]
    if len(place):
        pair = np.unique(doc * block.suffixes.shape[1] + suffix)
        in_doc, which = np.divmod(pair, block.suffixes.shape[1])
        source, own = owners(which, block)
        for d, i in np.unique(np.stack([in_doc[source], block.owner_item[own]]), axis=1).T.tolist():
            if block.ids[i] is not None and not (block.base and block.ids[i] in names[d]):
                names[d].append(block.ids[i])
        if with_matches:
            for d, i, at, word, size in zip(*(x.tolist() for x in longest_matches(place, suffix, doc, block)), strict=True):
                match = {"item_id": block.ids[i], "doc_word": at - int(first[d]), "item_word": word + block.base, "n_words": size}
                if not _joined(found[d], match, block):
                    found[d].append(match)
    columns = [part.column(0), part.column(1), pa.array(np.diff(first).astype(np.int64)), *runs, pa.array(names, pa.list_(pa.string())), pa.array(found, pa.list_(_MATCH))]
    return pa.RecordBatch.from_arrays(columns, names=["row_id", "text", "n_words", "hit_start", "hit_end", "items", "matches"])


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without any hit, with all their columns."""
    context, column = docs.sparkSession.sparkContext, docs.columns.index("text")

    def without(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, SLICE):
                hashes, first = words_of(part.column(column))
                place, _ = occurrences(hashes, first, sent.value) if len(hashes) else (np.zeros(0, np.int64), None)
                keep = np.ones(part.num_rows, bool)
                keep[np.searchsorted(first, place, "right") - 1] = False
                yield part.filter(pa.array(keep))

        return run

    for number, block in enumerate(blocks(benchmark, window, block_words), 1):
        docs = docs.mapInArrow(without(context.broadcast(block)), docs.schema)
        if number % 4 == 0:
            docs = cut(docs)
    return docs


def n_hit():
    """Hit words of a row of `scan`."""
    total = lambda name: F.aggregate(name, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return total("hit_end") - total("hit_start")


def digests(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document, and its longest matches: the words of
    the longest one, and all of them as item_id:doc_word:item_word:n_words, by place, comma-joined."""
    items = F.array_sort(F.array_distinct("items"))
    # Equal items under one id match at the same places; an item without an id is named by nothing.
    found = "array_sort(array_distinct(transform(matches, m -> struct(m.doc_word, coalesce(m.item_id, '') as item_id, m.item_word, m.n_words))))"
    return scan(docs, benchmark, window, block_words).select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (n_hit() > 0).alias("contaminated"),
        F.expr("cast(coalesce(array_max(transform(matches, m -> m.n_words)), 0) as bigint)").alias("longest"),
        F.expr(f"array_join(transform({found}, m -> concat_ws(':', m.item_id, m.doc_word, m.item_word, m.n_words)), ',')").alias("matches"),
    )

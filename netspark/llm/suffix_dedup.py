"""Removal of repeated byte strings, with suffix arrays by bucket-pointer refinement.

A byte goes if some `width`-byte string that covers it also starts in a document with a smaller doc_id.

1. Anchors. Of every `width`-byte window one q-gram is picked by its hash (the smallest, the leftmost of equals), so equal
   windows pick equal q-grams at equal places. Slices send their anchors' hashes to hash partitions and learn which
   ones other documents have too: all other windows are unique.
2. Suffixes. Each shared anchor goes, with the bytes of the windows that picked it, to the partition of its q-gram: the
   q-gram buckets, so equal windows meet. Equal stretches are packed into one. Where a bucket holds different
   stretches, their suffixes are sorted by bucket-pointer refinement: buckets by the first 8 bytes, of which one run after
   another is refined to the end. A bucket is parted by the pointers of the suffixes that come after its common bytes; the new
   pointers are stored at once, its parts are refined by them in turn, and later runs find them, so a look at a refined
   bucket gives more than 8 bytes. Buckets of one suffix and those that agree in `width` bytes are left. Windows that agree in
   `width` bytes are neighbours then, and the smallest doc_id among them keeps its copy. A q-gram that very many slices
   share is dealt by whole windows instead, so its different neighbourhoods spread over all partitions.
3. Removal. Slices get their repeated windows back and cut them out.

Hashes only bring candidates together; what is removed has been compared byte by byte.

Documents with equal ids don't remove from each other; one without an id comes after all others. Null and empty texts
have no bytes. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.llm import packed
from netspark.llm.common import mix

WIDTH, Q = 50, 20
#: Bytes of text that are hashed at once.
PIECE = 1 << 20
#: Suffixes that are refined together; the next ones use their pointers.
RUN = 1 << 15
#: Slices that share a q-gram before its windows are dealt singly.
HOT_SLICES = 2000
_BASE = 0x9E3779B97F4A7C15


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the `size` bytes from each place on, by doubling."""
    part, length = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD), 1
    out, done, rest = None, 0, size
    while rest:
        if rest & 1:
            if out is None:
                out, done = part, length
            else:
                n = len(data) - (done + length) + 1
                out = out[:n] * np.uint64(pow(_BASE, length, 1 << 64)) + part[done : done + n]
                done += length
        rest >>= 1
        if rest:
            n = len(data) - 2 * length + 1
            part = part[:n] * np.uint64(pow(_BASE, length, 1 << 64)) + part[length : length + n]
            length *= 2
    return mix(out)


def sliding(values: np.ndarray, size: int, best=np.minimum) -> np.ndarray:
    """The smallest (or largest) of each `size` values in a row."""
    length = 1
    while length * 2 <= size:
        values = best(values[: len(values) - length], values[length:])
        length *= 2
    return best(values[: len(values) - (size - length)], values[size - length :]) if size > length else values


def anchors(data: np.ndarray, offsets: np.ndarray, width: int, q: int) -> tuple[np.ndarray, ...]:
    """(hash, place, first window, last window) of the picked q-grams; the windows that start at first..last picked it."""
    found, low = [], np.uint64((1 << (PIECE + width).bit_length()) - 1)
    # Windows that cross an end of a document: the last width - 1 places before it.
    ends = offsets[1:]
    # Pieces overlap so that every window is whole in exactly one.
    for begin in range(0, max(len(data) - width + 1, 0), PIECE):
        end = min(len(data), begin + PIECE + width - 1)
        hashes = window_hashes(data[begin:end], q)
        # High bits compare hashes, low bits tell the place, so the leftmost of equals wins.
        pick = sliding((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), width - q + 1) & low
        across = np.zeros(len(pick) + 1, np.int32)
        near = ends[np.searchsorted(ends, begin, "right") : np.searchsorted(ends, begin + len(pick) + width, "left")] - begin
        across += np.bincount(np.clip(near - width + 1, 0, len(pick)), minlength=len(pick) + 1)
        across -= np.bincount(np.minimum(near, len(pick)), minlength=len(pick) + 1)
        inside = np.flatnonzero(np.cumsum(across[:-1], dtype=np.int32) == 0)
        if len(inside):
            place = pick[inside].astype(np.int64)
            new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (np.diff(inside) != 1)))
            last = np.append(new[1:], len(inside)) - 1
            found.append((hashes[place[new]], place[new] + begin, inside[new] + begin, inside[last] + begin))
    if not found:
        return tuple(np.zeros(0, k) for k in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def stretches(data: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, width: int, q: int) -> np.ndarray:
    """A row per anchor: where the q-gram stands in its stretch, the number of windows, and the bytes, zeros after them."""
    size = width + width - q
    out = np.zeros((len(place), size + 2), np.uint8)
    out[:, 0], out[:, 1] = place - first, last - first + 1
    room = np.concatenate([data, np.zeros(size, np.uint8)])
    length = last - first + width
    for start in range(0, len(place), 1 << 13):
        some = slice(start, start + (1 << 13))
        at = np.arange(size)
        out[some, 2:] = np.where(at < length[some, None], room[first[some, None] + at], 0)
    return out


def classes(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each class of equal rows, class of each row)."""
    if len(matrix) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = np.ascontiguousarray(matrix).view(np.dtype((np.void, matrix.shape[1]))).reshape(-1)
    _, first, of = np.unique(whole, return_index=True, return_inverse=True)
    return first, of.reshape(-1)


def smallest(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, packed.NO_ID)
    np.minimum.at(out, of, values)
    return out


def buckets(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, run: int = RUN) -> np.ndarray:
    """Bucket of the suffix at each place of `data`, equal for suffixes that agree in `width` bytes.

    Only places from which `width` bytes follow within a stretch have one that means anything. The order is that of whole
    suffixes, an end before every byte. A bucket's pointer is the place of its first suffix in the sorted order, so
    parting a bucket leaves all other pointers as they are; `depth` is the number of bytes its suffixes are known to share.
    """
    n = len(data)
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    left = np.zeros(n, np.int64)
    left[np.repeat(start, length) + at] = np.repeat(length, length) - at
    word = np.lib.stride_tricks.as_strided(np.concatenate([data, np.zeros(8, np.uint8)])[:8].view(">u8"), (n + 1,), (1,))[:n].astype(np.uint64)
    inside = np.minimum(left, 8)
    gram = np.where(inside > 0, word >> (8 * (8 - np.maximum(inside, 1))).astype(np.uint64) << (8 * (8 - np.maximum(inside, 1))).astype(np.uint64), np.uint64(0))
    order = np.lexsort((inside, gram))
    begins = np.append(True, (gram[order[1:]] != gram[order[:-1]]) | (inside[order[1:]] != inside[order[:-1]]))[:n]
    first = np.flatnonzero(begins)
    pointer, depth = np.empty(n, np.int64), np.zeros(n, np.int64)
    pointer[order] = np.repeat(first, np.diff(np.append(first, n)))
    # Suffixes that end within their gram are equal to their ends, and done.
    depth[first] = np.where(inside[order[first]] < 8, width, 8)
    size = np.diff(np.append(first, n))
    open_ = (size > 1) & (depth[first] < width)
    waiting = np.flatnonzero(np.repeat(open_, size))
    begin = 0
    while begin < len(waiting):
        # Whole buckets; they are refined to the end before the next ones, which find their pointers.
        last = pointer[order[waiting[min(begin + run, len(waiting)) - 1]]]
        end = int(np.searchsorted(waiting, last + size[np.searchsorted(first, last)]))
        todo, begin = waiting[begin:end], end
        while len(todo):
            todo = _refined(todo, order, pointer, depth, left, width)
    # Buckets may be parted by what comes after `width` bytes: neighbours that agree that far are one again.
    window = order[left[order] >= width]
    same = np.ones(max(len(window) - 1, 0), bool)
    for k in [*range(0, width - 7, 8), max(width - 8, 0)]:
        seen = word[window + k] >> np.uint64(8 * max(8 - width, 0))
        same &= seen[1:] == seen[:-1]
    out = np.zeros(n, np.int64)
    out[window] = np.cumsum(np.append(True, ~same)[: len(window)])
    return out


def _refined(todo: np.ndarray, order: np.ndarray, pointer: np.ndarray, depth: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
    """Part the buckets that fill the places `todo` of the order by the pointers of what comes after their common bytes,
    store the new pointers, and return the places of the buckets that are still open."""
    suffix = order[todo]
    old = pointer[suffix]
    shared = depth[old]
    later = np.where(left[suffix] > shared, pointer[np.minimum(suffix + shared, len(order) - 1)] + 1, 0)
    place = np.argsort(old.astype(np.uint64) * np.uint64(len(order) + 1) + later.astype(np.uint64), kind="stable")
    suffix, later = suffix[place], later[place]
    head = np.flatnonzero(np.append(True, (old[1:] != old[:-1]) | (later[1:] != later[:-1])))
    size = np.diff(np.append(head, len(todo)))
    # A pointer that was refined before tells of more bytes than a gram.
    known = np.where(later[head] > 0, shared[head] + depth[later[head] - 1], width)
    order[todo] = suffix
    pointer[suffix] = np.repeat(todo[head], size)
    depth[todo[head]] = known
    return todo[np.repeat((size > 1) & (known < width), size)]


def repeated(matrix: np.ndarray, doc: np.ndarray, width: int, q: int) -> np.ndarray:
    """For each stretch, a bit per window: does it also stand in a document with a smaller id?"""
    windows = matrix[:, 1].astype(np.uint64)
    every = (np.uint64(1) << windows) - np.uint64(1)
    first, of = classes(matrix)
    owner = smallest(of, doc, len(first))
    # Equal stretches: all but those of the first document go entirely.
    out = np.where(doc > owner[of], every, np.uint64(0))
    kept = matrix[first]
    # Single windows are told by their class alone; the others are compared with what shares their q-gram.
    mixed = np.flatnonzero(kept[:, 0] != SINGLE)
    grams = kept[mixed[:, None], 2 + kept[mixed, :1].astype(np.int64) + np.arange(q)]
    _, gram = classes(grams)
    mixed = mixed[np.bincount(gram, minlength=1)[gram] > 1]
    bits = np.zeros(len(first), np.uint64)
    for some in _by_gram(mixed, gram[np.bincount(gram, minlength=1)[gram] > 1]):
        count = kept[some, 1].astype(np.int64)
        length = count + width - 1
        flat = kept[some, 2:][np.arange(matrix.shape[1] - 2) < length[:, None]]
        start = np.cumsum(length) - length
        bucket = buckets(flat, start, length, width)
        j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        row = np.repeat(np.arange(len(some)), count)
        _, number = np.unique(bucket[start[row] + j], return_inverse=True)
        least = smallest(number, owner[some][row], number.max() + 1)
        gone = owner[some][row] > least[number]
        np.bitwise_or.at(bits, some[row[gone]], np.uint64(1) << j[gone].astype(np.uint64))
    return out | np.where(doc == owner[of], bits[of], np.uint64(0))


def _by_gram(rows: np.ndarray, gram: np.ndarray, size: int = 4096) -> Iterator[np.ndarray]:
    """Rows in runs of whole q-gram buckets, of about `size` rows, so that memory follows one run."""
    order = np.argsort(gram, kind="stable")
    rows, gram = rows[order], gram[order]
    start = 0
    while start < len(rows):
        end = int(np.searchsorted(gram, gram[min(start + size, len(rows)) - 1], "right"))
        yield rows[start:end]
        start = end


def _runs(parts: list[int], cuts: list[slice], size: int = 1 << 13) -> Iterator[tuple[list[int], list[slice]]]:
    """Neighbouring partitions with about `size` rows together: many partitions of few rows are worked on at once."""
    first = 0
    for i, cut in enumerate(cuts):
        if cut.stop - cuts[first].start >= size or i == len(cuts) - 1:
            yield parts[first : i + 1], cuts[first : i + 1]
            first = i + 1


#: Mark of a stretch that is a single window of a hot q-gram.
SINGLE = 255


def _row_hashes(matrix: np.ndarray) -> np.ndarray:
    out = np.zeros(len(matrix), np.uint64)
    for k in range(matrix.shape[1]):
        out = mix((out ^ matrix[:, k].astype(np.uint64)) * np.uint64(_BASE) + np.uint64(1)) if k % 8 == 7 else (out << np.uint64(8)) ^ out ^ matrix[:, k]
    return mix(out)


def spread_keys(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Keys of anchors, even over the key range. Picked hashes are the smallest of their windows, so most are low."""
    return mix(hashes * np.uint64(_BASE)) >> np.uint64(64 - bits)


def _single_hashes(data: np.ndarray, single: np.ndarray, width: int, q: int, size: int = 1 << 13) -> np.ndarray:
    """The row hash of each single window, a run of windows at a time."""
    out = np.zeros(len(single), np.uint64)
    for begin in range(0, len(single), size):
        some = single[begin : begin + size]
        matrix = stretches(data, some, some, some, width, q)
        matrix[:, 0] = SINGLE
        out[begin : begin + size] = _row_hashes(matrix)
    return out


def remove_repeats(docs: DataFrame, width: int = WIDTH, q: int = Q, hot_slices: int = HOT_SLICES, slice_bytes: int = packed.SLICE) -> DataFrame:
    """doc_id, n_bytes, start, stop (byte runs that go) and kept (the rest, binary) of every document."""
    if not 0 < width - q + 1 <= 64 or width > SINGLE:
        raise ValueError("between 1 and 64 q-grams must fit into a window of at most 255 bytes")
    slices = packed.pack(docs, slice_bytes=slice_bytes)
    partitions, size = packed.plan(slices)
    bits = min(64, max(16, size.bit_length()) + 8)

    def cut_up(one: packed.Slice) -> tuple[np.ndarray, ...]:
        hashes, place, first, last = anchors(one.data, one.offsets, width, q)
        return spread_keys(hashes, bits), place, first, last

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in packed.rows(batch):
                one = packed.Slice(row)
                keys, place, _, _ = cut_up(one)
                doc = one.ids[np.searchsorted(one.offsets, place, "right") - 1]
                key, of = np.unique(keys, return_inverse=True)
                low, high = smallest(of, doc, len(key)), np.full(len(key), np.iinfo(np.int64).min)
                np.maximum.at(high, of, doc)
                parts, cuts = packed.dealt(key, partitions, bits)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(parts, pa.int32()),
                        "slice": pa.array([one.name] * len(parts), pa.string()),
                        "keys": pa.array([packed.squeeze_sorted(key[c]) for c in cuts], pa.binary()),
                        "several": pa.array([packed.squeeze((low < high)[c]) for c in cuts], pa.binary()),
                    }
                )

    def meet(table: pa.Table) -> pa.Table:
        keys = [packed.expand_sorted(x.as_buffer()) for x in table.column("keys")]
        several = np.concatenate([packed.expand(x.as_buffer(), "u1") for x in table.column("several")])
        every, of = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(of, minlength=len(every))
        shared = count > 1
        shared[of[several != 0]] = True
        state = (shared.astype(np.uint8) + (count >= hot_slices))[of]
        ends = np.cumsum([len(k) for k in keys])
        answers = [packed.squeeze(x) for x in np.split(state, ends[:-1])]
        return pa.table({"slice": table.column("slice"), "part": table.column("part"), "state": pa.array(answers, pa.binary())})

    asked = slices.mapInArrow(ask, "part int, slice string, keys binary, several binary")
    states = asked.repartition(partitions, "part").groupBy("part").applyInArrow(meet, "slice string, part int, state binary")

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"part": [], "slice": [], "rows": [], "docs": [], "starts": [], "bits": []}
        squeeze = zstandard.ZstdCompressor(level=3)

        def put(part: int, matrix: np.ndarray | None, doc: np.ndarray | None, start: np.ndarray, gone: np.ndarray | None) -> None:
            out["part"].append(part)
            out["slice"].append(one.name)
            out["rows"].append(squeeze.compress(np.ascontiguousarray(matrix).tobytes()) if gone is None else b"")
            out["docs"].append(packed.squeeze(doc) if gone is None else b"")
            out["starts"].append(packed.squeeze(start))
            out["bits"].append(b"" if gone is None else packed.squeeze(gone))

        for row in packed.rows(left):
            one = packed.Slice(row)
            keys, place, first, last = cut_up(one)
            told = sorted(packed.rows(right), key=lambda r: r["part"].as_py())
            state = np.concatenate([np.zeros(0, np.uint8), *(packed.expand(r["state"].as_buffer(), "u1") for r in told)])
            state = state[np.unique(keys, return_inverse=True)[1]]
            doc = one.ids[np.searchsorted(one.offsets, place, "right") - 1]
            shared = np.flatnonzero(state == 1)
            hot = np.flatnonzero(state == 2)
            span = (last - first + 1)[hot]
            single = np.repeat(first[hot], span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
            for at, chosen in ((0, shared), (1, hot)):
                if at:
                    start, owner, spread = single, np.repeat(doc[hot], span), _single_hashes(one.data, single, width, q) >> np.uint64(64 - bits)
                    gram, end = single, single
                else:
                    start, owner, spread = first[chosen], doc[chosen], keys[chosen]
                    gram, end = place[chosen], last[chosen]
                # Equal stretches go to one partition, so those of some whole partitions are all that has to be held.
                order, told_here = np.argsort(spread, kind="stable"), []
                for parts, cuts in _runs(*packed.dealt(spread[order], partitions, bits)):
                    some = order[cuts[0].start : cuts[-1].stop]
                    matrix = stretches(one.data, gram[some], start[some], end[some], width, q)
                    if at:
                        matrix[:, 0] = SINGLE
                    head, of = classes(matrix)
                    known = owner[some] > smallest(of, owner[some], len(head))[of]
                    if known.any():
                        told_here.append((start[some][known], (np.uint64(1) << matrix[known, 1].astype(np.uint64)) - np.uint64(1)))
                    for p, c in zip(parts, cuts, strict=True):
                        new = c.start - cuts[0].start + np.flatnonzero(~known[c.start - cuts[0].start : c.stop - cuts[0].start])
                        if len(new):
                            put(p, matrix[new], owner[some[new]], start[some[new]], None)
                if told_here:
                    put(-1 - zlib.crc32(one.name.encode()) % partitions, None, None, *map(np.concatenate, zip(*told_here, strict=True)))
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int32(), pa.string(), *[pa.binary()] * 4), strict=True)})

    sent = slices.groupBy("slice").cogroup(states.groupBy("slice")).applyInArrow(send, "part int, slice string, rows binary, docs binary, starts binary, bits binary")

    def judge(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() < 0:  # what the slices could tell by themselves
            return table.select(["slice", "starts", "bits"])
        parts = [np.frombuffer(packed.unsqueeze(x.as_buffer()), np.uint8) for x in table.column("rows")]
        wide = 2 * width - q + 2
        matrix = np.concatenate([x.reshape(-1, wide) for x in parts])
        doc = np.concatenate([packed.expand(x.as_buffer(), "<i8") for x in table.column("docs")])
        ends = np.cumsum([len(x) // wide for x in parts])
        del parts
        gone = repeated(matrix, doc, width, q)
        # Slices without a repeated window here get no answer.
        told, starts, bits_ = [], [], []
        for i, (begin, end) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)):
            some = gone[begin:end]
            if some.any():
                told.append(i)
                starts.append(packed.squeeze(packed.expand(table.column("starts")[i].as_buffer(), "<i8")[some != 0]))
                bits_.append(packed.squeeze(some[some != 0]))
        return pa.table({"slice": table.column("slice").take(pa.array(told, pa.int64())), "starts": pa.array(starts, pa.binary()), "bits": pa.array(bits_, pa.binary())})

    answers = sent.repartition(partitions, "part").groupBy("part").applyInArrow(judge, "slice string, starts binary, bits binary")

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        done = []
        for row in packed.rows(left):
            one = packed.Slice(row)
            removed = covered(*_answers(right), len(one.data), width)
            edge = np.zeros(len(removed) + 1, bool)
            edge[one.offsets] = True
            begin = np.flatnonzero(removed & (edge[:-1] | ~np.append(False, removed[:-1])))
            end = np.flatnonzero(removed & (edge[1:] | ~np.append(removed[1:], False))) + 1
            owner = np.searchsorted(one.offsets, begin, "right") - 1
            at = np.searchsorted(owner, np.arange(len(one.ids) + 1)).astype(np.int32)
            runs = [pa.ListArray.from_arrays(pa.array(at), pa.array(x - one.offsets[owner])) for x in (begin, end)]
            raw, whole = one.data.tobytes(), one.offsets.tolist()
            kept = []
            for d in range(len(one.ids)):
                place, pieces = whole[d], []
                for k in range(at[d], at[d + 1]):
                    pieces.append(raw[place : begin[k]])
                    place = int(end[k])
                pieces.append(raw[place : whole[d + 1]])
                kept.append(b"".join(pieces))
            ids = pa.array(one.ids, mask=one.ids == packed.NO_ID)
            done.append(pa.Table.from_arrays([ids, pa.array(np.diff(one.offsets)), *runs, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "start", "stop", "kept"]))
        empty = {"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "start": pa.array([], pa.list_(pa.int64())), "stop": pa.array([], pa.list_(pa.int64())), "kept": pa.array([], pa.binary())}
        return pa.concat_tables(done) if done else pa.table(empty)

    return slices.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(apply, "doc_id bigint, n_bytes bigint, start array<bigint>, stop array<bigint>, kept binary")


def _answers(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(start, bits of the windows that go) of all answers to a slice."""
    starts = [packed.expand(x.as_buffer(), "<i8") for x in table.column("starts")]
    gone = [packed.expand(x.as_buffer(), "<u8") for x in table.column("bits")]
    return np.concatenate([np.zeros(0, np.int64), *starts]), np.concatenate([np.zeros(0, np.uint64), *gone])


def covered(starts: np.ndarray, gone: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n bytes stand in a window that goes; the j-th bit of ``gone`` is for the window j places after a start."""
    here = np.zeros(n + width, bool)
    for j in range(int(gone.max()).bit_length() if len(gone) else 0):
        here[starts[(gone >> np.uint64(j)) & np.uint64(1) != 0] + j] = True
    # A byte is covered if one of the last `width` places starts a window.
    count = np.cumsum(here[:n], dtype=np.int32)
    count[width:] -= count[:-width].copy()
    return count > 0


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return remove_repeats(docs).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("start").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )

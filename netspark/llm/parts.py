"""Ids of texts from those of their parts, each of which is worked out once and kept.

Texts are cut before a space that a visible character follows, between a letter and a mark, and around line ends
next to visible characters; no pre-token of PATTERN goes over such a place, so the ids of a text are those of its parts.
Parts are told apart by two 64-bit hashes. Only parts that are not in the memory meet the tokenizer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from netspark.llm.common import text_bytes, word_hashes

#: The most bytes of a part that is kept.
KEPT = 64
#: Bytes that certainly begin a visible character: no ASCII control or space, and no lead byte of a wide space.
VISIBLE, LETTER, MARK, ASCII_VISIBLE = np.ones(256, bool), np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = MARK[list(b".,!?;:%$#*&|\")]")] = ASCII_VISIBLE[0x21:0x7F] = True
VISIBLE[[*range(0x21), 0x7F, *range(0x80, 0xC3), 0xE1, 0xE2, 0xE3]] = False


class Parts:
    """A memory of the ids of at most `limit` parts; all are forgotten when it is full.

    `whole` gives the ids of a text, `_learn` those of many parts and how many belong to each, and texts that hold
    one of the `special` strings are never cut.
    """

    special: list[str] = []

    def __init__(self, limit: int):
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.hash, self.other = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, "<u4")

    def whole(self, text: str) -> np.ndarray:
        raise NotImplementedError

    def _learn(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a column."""
        data, offsets = text_bytes(column)
        raw = data.tobytes()
        alone = np.zeros(len(offsets) - 1, bool)
        for token in self.special:  # these may hold spaces or stand inside a word
            at = raw.find(token.encode())
            while at >= 0:
                alone[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(token.encode(), at + 1)
        begins = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            left, right = data[:-1], data[1:]
            # Of white space before something visible, the last character is apart from those before it.
            begins[:-2] = ((left == 0x20) | (left == 0x0A)) & VISIBLE[right]
            begins[1:-1] |= (LETTER[left] & MARK[right]) | ((left == 0x0A) & VISIBLE[right]) | ((right == 0x0A) & ASCII_VISIBLE[left])
        begins[offsets] = True
        # What ends a text is followed by another text, not by a visible character of its own; no cut is always right.
        begins[(offsets[1:] - 1)[np.diff(offsets) > 1]] = False
        starts = np.flatnonzero(begins[:-1])
        ends = np.append(starts[1:], len(data))
        text = np.searchsorted(offsets, starts, "right") - 1
        one, two = word_hashes(data, starts, ends), word_hashes(data, starts, ends, 0x5851F42D4C957F2D)
        unique, first, of = np.unique(one, return_index=True, return_inverse=True)
        alone[text[two != two[first][of]]] = True  # unequal parts with one hash; next to never

        place = np.minimum(np.searchsorted(self.hash, unique), max(len(self.hash) - 1, 0))
        known = (self.hash[place] == unique) & (self.other[place] == two[first]) if len(self.hash) else np.zeros(len(unique), bool)
        begin, count = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        begin[known], count[known] = self.start[place[known]], self.count[place[known]]
        new = np.flatnonzero(~known)
        new = new[np.argsort(ends[first[new]] - starts[first[new]] > KEPT, kind="stable")]  # those that are not kept come last
        ids, count[new] = self._learn([raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        begin[new] = len(self.pool) + np.cumsum(count[new]) - count[new]
        pool = np.concatenate([self.pool, ids])

        size = count[of]
        total = np.cumsum(size)
        out = pool[np.repeat(begin[of] - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        edge = np.concatenate([[0], total])[np.searchsorted(text, np.arange(len(offsets)))]
        self._keep(unique, two[first], begin, count, new[ends[first[new]] - starts[first[new]] <= KEPT], pool)
        for k in range(len(offsets) - 1):
            yield self.whole(raw[offsets[k] : offsets[k + 1]].decode()) if alone[k] else out[edge[k] : edge[k + 1]]

    def _keep(self, unique, other, begin, count, new, pool) -> None:
        if len(self.hash) + len(new) > self.limit:
            self.forget()
            return
        new = np.sort(new)
        at = np.searchsorted(self.hash, unique[new])
        if len(self.hash):  # where the same hash is kept for another part, it stays
            fresh = self.hash[np.minimum(at, len(self.hash) - 1)] != unique[new]
            new, at = new[fresh], at[fresh]
        self.hash, self.other = np.insert(self.hash, at, unique[new]), np.insert(self.other, at, other[new])
        self.start, self.count = np.insert(self.start, at, begin[new]), np.insert(self.count, at, count[new])
        self.pool = pool[: max(len(self.pool), int((begin[new] + count[new]).max(initial=0)))]

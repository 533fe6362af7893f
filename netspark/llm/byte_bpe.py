"""Byte-level BPE by prefix dynamic programming.

For each byte prefix of a pre-token there is one token that can stand last: the
token whose left neighbour, the last token of the prefix before it, stays apart
from it under the merges. Storing that token for each prefix encodes the piece
(walk back from its end), makes appends exact (go on where the table ends) and
keeps edits local (rebuild until the stored tokens agree again).

Null texts are empty; empty texts have no ids; repeated rows each get their row;
an empty table gives an empty one; further columns of the input are not read.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.llm.common import Memory, slices
from netspark.llm.parts import KEPT, Parts

TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Pieces whose ids a worker keeps (twice that at most, and PARTS times as many parts, which take some 50 bytes each): for a
#: task, and where a worker does nothing else.
MEMORY, LASTING_MEMORY, PARTS = 50_000, 100_000, 10
#: Bytes of text that a task holds at once.
SLICE = 4 << 20
_PACK = struct.Struct("<I").pack


class Vocabulary:
    """Token ranks, which tokens the merges can make, and which neighbours stay apart."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.most_known = 5 * memory
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.known: dict[int, bool] = {}  # by left << 32 | right
        # Finds all tokens that end at each place, the longest first. Tokens that merging alone
        # never makes are left out: they stand only where they are a whole pre-token.
        self.ending = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            if self.merged(token) == [rank]:
                self.ending.add_word(token.decode("latin-1"), (rank, len(token)))
        self.ending.make_automaton()

    def merged(self, piece: bytes) -> list[int]:
        """Merge neighbours of the lowest rank, leftmost first, until none is left: the definition."""
        rank, never = self.ranks.get, 1 << 60
        parts = [piece[i : i + 1] for i in range(len(piece))]
        joined = [rank(a + b, never) for a, b in pairwise(parts)]
        while joined and (lowest := min(joined)) < never:
            at = joined.index(lowest)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = rank(parts[at - 1] + parts[at], never)
            if at < len(joined):
                joined[at] = rank(parts[at] + parts[at + 1], never)
        return [self.ranks[part] for part in parts]

    def apart(self, left: int, right: int) -> bool:
        """Do these two tokens, side by side, stay as they are?"""
        if len(self.known) >= self.most_known:
            self.known.clear()
        stays = self.known[left << 32 | right] = self.merged(self.bytes[left] + self.bytes[right]) == [left, right]
        return stays


class PrefixTable:
    """The last token of every byte prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def _go_on(self, piece: bytes, last: list[int], first: int, stop: Callable[[int], bool] | None = None) -> None:
        """Add the last token of each prefix longer than `first` to `last`, until `stop` says so."""
        known, apart, done = self.vocabulary.known, self.vocabulary.apart, first
        start = max(0, first + 1 - self.vocabulary.longest)
        text = piece[start:] if start else piece
        for end, (token, length) in self.vocabulary.ending.iter(text.decode("latin-1")):
            end += start + 1
            if end > done:
                if length < end:
                    left = last[end - length]
                    stays = known.get(left << 32 | token)
                    if not (apart(left, token) if stays is None else stays):
                        continue
                last.append(token)
                done = end
                if stop and stop(end):
                    return

    def append(self, more: bytes) -> None:
        """Go on where the table ends; nothing before changes."""
        before, self.piece = len(self.piece), self.piece + more
        self._go_on(self.piece, self.last, before)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put `new` for the bytes from start to end; gives the number of prefixes worked out again."""
        piece = self.piece[:start] + new + self.piece[end:]
        shift, last, window, agreed = len(new) - (end - start), self.last[: start + 1], self.vocabulary.longest, 0

        def agrees(at: int) -> bool:
            # Once a window of last tokens agrees, every later candidate sees the same bytes and neighbours as before.
            nonlocal agreed
            old = at - shift
            agreed = agreed + 1 if old > end and self.last[old] == last[at] else 0
            return agreed >= window

        self._go_on(piece, last, start, agrees)
        worked = len(last) - start - 1
        last.extend(self.last[len(last) - shift :])
        self.piece, self.last = piece, last
        return worked

    def ids(self) -> list[int]:
        out, at = [], len(self.piece)
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.bytes[self.last[at]])
        return out[::-1]


class Encoder(Parts):
    """Texts to ids with memories of parts and of the pieces in them."""

    def __init__(self, path: str, pattern: str, memory: int = MEMORY):
        super().__init__(PARTS * memory)
        self.vocabulary, self.pattern = Vocabulary(path, memory), regex.compile(pattern)
        self.pieces = Memory(self._piece, memory, KEPT)

    def _piece(self, text: str) -> bytes:
        raw = text.encode()
        whole = self.vocabulary.ranks.get(raw)
        return _PACK(whole) if whole is not None else np.array(PrefixTable(self.vocabulary, raw).ids(), "<u4").tobytes()

    def split(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def whole(self, text: str) -> np.ndarray:
        return np.frombuffer(self.split(text), "<u4")

    def _learn(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.split(part.decode()) for part in parts]
        return np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)

    def forget(self) -> None:
        """Empty the memories; the vocabulary stays."""
        super().forget()
        if hasattr(self, "pieces"):
            self.pieces.clear()
            self.pieces.older = {}
            self.vocabulary.known.clear()


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, memory: int = MEMORY) -> Encoder:
    """One per worker and vocabulary; a worker that dies loses only its memories."""
    return Encoder(path, pattern, memory)


def encode(docs: DataFrame, path: str = TOKENIZER, pattern: str = public_tokenizers.PATTERN, text: str = "text", key: str = "doc_id", decoded: bool = False, lasting: bool = False) -> DataFrame:
    """key and `ids` (binary, little-endian unsigned 32-bit) of every row's whole text; with `decoded` also the bytes that the ids stand for.

    Memories of pieces are emptied when a task ends, so a worker that waits for other work holds the vocabulary alone; with
    `lasting` they are larger and stay for the worker's next task, which suits an application that only encodes. Decoding
    in the same pass spares a second worker with a vocabulary of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern, LASTING_MEMORY if lasting else MEMORY)
        try:
            for part in slices(batches, SLICE):
                ids = [x.tobytes() for x in own.encode(part.column(1))]
                columns, names = [part.column(0), pa.array(ids, pa.binary())], [key, "ids"]
                if decoded:
                    columns.append(pa.array([_bytes_of(x, own.vocabulary.bytes) for x in ids], pa.binary()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            if not lasting:
                own.forget()

    chosen = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids binary" + ", decoded binary" * decoded)


def _bytes_of(ids: bytes, tokens: dict[int, bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def tokens(path: str) -> dict[int, bytes]:
    """The bytes of each id: all that decoding needs."""
    with open(path, "rb") as lines:
        return {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}


def decode(encoded: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """The rows with `decoded`, the bytes that the ids stand for."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            texts = [_bytes_of(x.as_buffer(), tokens(path)) if x.is_valid else None for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{fields}, decoded binary")


def digests(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document's round trip."""
    done = encode(docs, path, decoded=True, lasting=True)
    return done.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

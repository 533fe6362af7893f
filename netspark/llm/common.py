"""Helpers that several operators share: reading text batches, words as arrays, table access."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from netspark.session import shared_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder: later steps read it instead of doing the work again, also after losses."""
    shared_dir(df.sparkSession)  # sets a folder where the session names none
    return df.checkpoint()


class Memory(dict):
    """What `make` gave for a key, for some recent keys: when `limit` new ones are in, only the last `limit` before them stay."""

    def __init__(self, make: Callable[[str], bytes], limit: int, longest: int):
        super().__init__()
        self.make, self.limit, self.longest, self.older = make, limit, longest, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self.keep(key, value)
        return value

    def keep(self, key: str, value: bytes) -> None:
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and the offsets of each; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches to about `limit` bytes of text each, one row at least, so that a task's memory does not follow its input."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; all other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of word bytes, and the text it is in; runs end where a text ends."""
    if len(is_word) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.concatenate([[False], is_word[:-1]])
    begins = np.zeros(len(is_word), bool)
    inner = offsets[(offsets > 0) & (offsets < len(is_word))]
    begins[inner] = True
    starts = np.flatnonzero(is_word & (~before | begins))
    stops = np.append(begins[1:], True) | ~np.append(is_word[1:], False)
    ends = np.flatnonzero(is_word & stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a fixed reversible step)."""
    values = values ^ (values >> np.uint64(31))
    values = values * _MIX
    return values ^ (values >> np.uint64(29))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte run: 8 bytes at a time, over all runs at once."""
    times = np.uint64((int(_MUL) + 2 * seed) % (1 << 64))
    out = mix((ends - starts).astype(np.uint64) * times + np.uint64(seed))
    if len(out) == 0:
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    # The 8 bytes from each place on, as one little-endian number.
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,)) if len(data) else None
    todo, at = np.arange(len(starts)), starts.copy()
    while len(todo):
        left = ends[todo] - at
        word = eight[at]
        short = left < 8
        shift = ((8 - np.minimum(left, 8)) * 8).astype(np.uint64)
        word = np.where(short, (word << shift) >> shift, word)
        out[todo] = mix((out[todo] ^ word) * times + np.uint64(1))
        keep = left > 8
        todo, at = todo[keep], at[keep] + 8
    return out

"""Documents packed into slices, and a two-way exchange of sorted keys between slices and hash partitions.

A slice is some megabytes of whole documents in one row. Operators that compare a corpus with itself send each slice's
distinct keys to partitions of the key range, where all slices meet, and get answers back per slice. Keys travel sorted,
as packed differences, so a key costs a few bytes rather than a row. A slice's keys are distinct before they
leave it, so a hot key costs one entry per slice, and keys are hashes, so partitions are even.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.llm.common import cut, slices, text_bytes

SLICE = 4 << 20
#: Stands for a missing doc_id: after every other.
NO_ID = np.iinfo(np.int64).max
SCHEMA = "slice string, doc_ids binary, flags binary, sizes binary, body binary"


def pack(docs: DataFrame, flag: str = "false", slice_bytes: int = SLICE) -> DataFrame:
    """One row per slice: ids, a 0/1 flag and byte lengths of its documents, and their texts. Checkpointed, so a slice stays what it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, task, number = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0
        for part in slices(batches, slice_bytes):
            more = len(text_bytes(part.column(2))[0])
            if held and size + more > slice_bytes:
                yield _row(pa.Table.from_batches(held), f"{task}-{number}", squeeze)
                held, size, number = [], 0, number + 1
            held.append(part)
            size += more
        if held:
            yield _row(pa.Table.from_batches(held), f"{task}-{number}", squeeze)

    chosen = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.expr(flag), F.lit(False)).alias("flag"), F.col("text").cast("string").alias("text"))
    return cut(chosen.mapInArrow(run, SCHEMA))


def _row(table: pa.Table, name: str, squeeze) -> pa.RecordBatch:
    ids = table.column(0).fill_null(NO_ID).to_numpy().astype("<i8")
    flags = table.column(1).to_numpy().astype("u1")
    data, offsets = text_bytes(table.column(2))
    values = [name, ids.tobytes(), flags.tobytes(), np.diff(offsets).astype("<i8").tobytes(), squeeze.compress(data.tobytes())]
    kinds = [pa.string(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["slice", "doc_ids", "flags", "sizes", "body"])


class Slice:
    """An unpacked row of `pack`."""

    def __init__(self, row: dict[str, pa.Scalar]):
        self.name = row["slice"].as_py()
        self.ids = np.frombuffer(row["doc_ids"].as_buffer(), "<i8")
        self.flags = np.frombuffer(row["flags"].as_buffer(), "u1") != 0
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"].as_buffer(), "<i8"))])
        self.data = np.frombuffer(unsqueeze(row["body"].as_buffer()), np.uint8)


def rows(batch: pa.RecordBatch | pa.Table) -> Iterator[dict[str, pa.Scalar]]:
    for i in range(batch.num_rows):
        yield {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}


@cache
def _tools() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """Kept for the worker: making them costs more than packing a short array. A worker runs one task at a time."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(array: np.ndarray) -> bytes:
    """Packed bytes of an array, like bytes of its values next to each other."""
    parts = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), -1).T if len(array) else np.zeros(0, np.uint8)
    return _tools()[0].compress(parts.tobytes())


def unsqueeze(buffer: pa.Buffer | bytes) -> bytes:
    return _tools()[1].decompress(buffer)


def expand(buffer: pa.Buffer | bytes, kind: str) -> np.ndarray:
    """The array that `squeeze` packed."""
    raw, width = np.frombuffer(unsqueeze(buffer), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_sorted(buffer: pa.Buffer | bytes) -> np.ndarray:
    return np.cumsum(expand(buffer, "<u8"), dtype=np.uint64)


def dealt(keys: np.ndarray, partitions: int, bits: int) -> tuple[list[int], list[slice]]:
    """The equal ranges of a `bits`-bit key space that sorted keys fall into, and where: work grows with the keys, not with the ranges."""
    part, first = np.unique(keys >> np.uint64(bits + 1 - partitions.bit_length()), return_index=True)
    ends = np.append(first, len(keys))
    return part.tolist(), [slice(*pair) for pair in zip(ends[:-1], ends[1:], strict=True)]


def plan(packed: DataFrame, per_partition: int = 12 << 20) -> tuple[int, int]:
    """(partitions for the keys, a power of two of at least two; bytes of packed text)."""
    size = packed.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    least = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << (max(least, 4 * size // per_partition, 2) - 1).bit_length(), size

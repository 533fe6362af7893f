"""Token ids in seekable files: independent zstandard frames, a trailing seek table, a checksum per frame.

A file is, in this order:

    frames       zstandard frames (with content checksums); each holds the ids of whole documents,
                 little-endian unsigned 32-bit, about `frame_bytes` of them unless one document has more
    index        skippable frame: zstandard-packed columns doc_id (int64), is_null (uint8), n_tokens (uint64)
                 and frame (uint32) of every document
    seek table   skippable frame: per frame its packed size (uint32), its size (uint64) and the CRC-32 of its
                 content (uint32); then the number of frames (uint32), of documents (uint32), the size of the
                 index frame (uint32) and FOOT
    END          an empty skippable frame, the line separator of Spark's text writer

so every zstandard tool unpacks the file to its ids, and a reader that can seek reads the end, picks documents
and unpacks their frames only. Spark's own writer and reader move the files, so any store that Spark knows will do,
and a lost task is written again.

Null texts are empty and so have only the end id. Documents with equal doc_id keep a row each, next to each other;
a null doc_id comes first. An empty table has no documents in its files. Further columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netspark.llm.common import slices
from netspark.llm.parts import VISIBLE, Parts
from netspark.session import shared_dir

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
FRAME_BYTES, FILE_BYTES = 64 << 10, 16 << 20
SLICE = 3 << 20
#: Parts whose ids a worker keeps (some 50 bytes each; all are forgotten when it is full).
MEMORY = 1_000_000
SKIP, SEEK, FOOT = 0x184D2A50, 0x184D2A5E, b"NSF1"
END = "P*M\x18\x00\x00\x00\x00"
_TAIL = struct.Struct("<III4s")
_FRAME = np.dtype([("packed", "<u4"), ("size", "<u8"), ("crc", "<u4")])


class Encoder(Parts):
    """The tokenizer, with a memory of the ids of parts.

    Many parts meet the tokenizer as one text, whose ids are cut by the bytes that each token stands for.
    """

    def __init__(self, path: str):
        super().__init__(MEMORY)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        sizes = {i: len(token) for token, i in self.tokenizer.get_vocab().items()}  # a character of a token is a byte
        self.sizes = np.array([sizes.get(i, 0) for i in range(max(sizes) + 1)], np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many belong to each part). A line end in front keeps parts that begin with a visible character apart."""
        ids, counts = [], np.zeros(len(parts), np.int64)
        for begin in range(0, len(parts), 5000):
            some = parts[begin : begin + 5000]
            spaced = [len(part) > 1 and part[0] == 0x20 and VISIBLE[part[1]] for part in some]
            inner = [k for k, part in enumerate(some) if spaced[k] or VISIBLE[part[0]]]
            split: dict[int, np.ndarray] = {k: self.whole(some[k].decode()) for k in set(range(len(some))).difference(inner)}
            if inner:
                apart = [some[k] if spaced[k] else b"\n" + some[k] for k in inner]
                (found,) = self.tokenizer.encode_batch_fast([b"".join(apart).decode()], add_special_tokens=False)
                joined = np.array(found.ids, "<u4")
                ends = np.searchsorted(np.cumsum(self.sizes[joined]), np.cumsum([len(part) for part in apart])) + 1
                for k, own in zip(inner, np.split(joined, ends[:-1]), strict=True):
                    split[k] = own if spaced[k] else own[1:]
            for k in range(len(some)):
                ids.append(split[k])
                counts[begin + k] = len(split[k])
        return np.concatenate([np.zeros(0, "<u4"), *ids]), counts


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class FileWriter:
    """Collects documents and gives finished files of bounded size."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, file_bytes: int = FILE_BYTES, level: int = 3):
        self.frame_bytes, self.file_bytes = frame_bytes, file_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self._clear()

    def _clear(self) -> None:
        self.frames, self.table, self.written, self.open, self.open_bytes = [], [], 0, [], 0
        self.docs: list[tuple[int, int, int, int]] = []

    def _close_frame(self) -> None:
        if self.open:
            content = b"".join(self.open)
            packed = self.pack.compress(content)
            self.frames.append(packed)
            self.table.append((len(packed), len(content), zlib.crc32(content)))
            self.written += len(packed)
            self.open, self.open_bytes = [], 0

    def add(self, doc_id: int | None, ids: bytes) -> bytes | None:
        """Take one document; gives a file once enough is collected."""
        if self.open_bytes + len(ids) > self.frame_bytes:
            self._close_frame()
        done = self.finish() if self.written >= self.file_bytes else None
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // 4, len(self.frames)))
        self.open.append(ids)
        self.open_bytes += len(ids)
        return done

    def finish(self) -> bytes | None:
        """The file of what was collected, without END, which Spark's writer adds."""
        self._close_frame()
        if not self.docs:
            return None
        doc, null, tokens, frame = zip(*self.docs, strict=True)
        columns = np.array(doc, "<i8"), np.array(null, "u1"), np.array(tokens, "<u8"), np.array(frame, "<u4")
        index = _skippable(SKIP, self.pack.compress(b"".join(c.tobytes() for c in columns)))
        tail = _TAIL.pack(len(self.table), len(self.docs), len(index), FOOT)
        out = b"".join([*self.frames, index, _skippable(SEEK, np.array(self.table, _FRAME).tobytes() + tail)])
        self._clear()
        return out


class FileReader:
    """Reads documents of one file through seek() and read()."""

    def __init__(self, handle):
        self.handle = handle
        handle.seek(0, 2)
        size = handle.tell() - len(END)
        n_frames, n_docs, index_size, foot = _TAIL.unpack(self._at(size - _TAIL.size, _TAIL.size))
        if foot != FOOT:
            raise ValueError("not a token file")
        table_size = n_frames * _FRAME.itemsize
        table_at = size - _TAIL.size - table_size
        self.table = np.frombuffer(self._at(table_at, table_size), _FRAME)
        packed = self._at(table_at - 8 - index_size + 8, index_size - 8)
        raw = zstandard.ZstdDecompressor().decompress(packed)
        cut = np.cumsum([0, 8, 1, 8, 4]) * n_docs
        kinds = ("<i8", "u1", "<u8", "<u4")
        self.doc_id, self.is_null, self.n_tokens, self.frame = (
            np.frombuffer(raw, kind, n_docs, cut[i]) for i, kind in enumerate(kinds)
        )
        self.starts = np.concatenate([[0], np.cumsum(self.table["packed"], dtype=np.int64)])
        before = np.cumsum(self.n_tokens, dtype=np.int64) - self.n_tokens.astype(np.int64)
        first = np.searchsorted(self.frame, self.frame)  # the first document of each one's frame
        self.within = (before - before[first]) * 4 if n_docs else before
        self.unpacked = 0

    def _at(self, place: int, size: int) -> bytes:
        self.handle.seek(place)
        return self.handle.read(size)

    def content(self, frame: int) -> bytes:
        entry = self.table[frame]
        packed = self._at(int(self.starts[frame]), int(entry["packed"]))
        out = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(entry["size"]))
        self.unpacked += 1
        if len(out) != entry["size"] or zlib.crc32(out) != entry["crc"]:
            raise ValueError(f"frame {frame} does not match its checksum")
        return out

    def documents(self, places: Iterable[int]) -> Iterator[tuple[int, bytes]]:
        """(place, ids) of the documents at these places of the file; each frame is unpacked once if they ascend."""
        frame, content = -1, b""
        for place in places:
            if self.frame[place] != frame:
                frame = int(self.frame[place])
                content = self.content(frame)
            at = int(self.within[place])
            yield place, content[at : at + 4 * int(self.n_tokens[place])]

    def find(self, doc_ids: Iterable[int]) -> Iterator[tuple[int, bytes]]:
        """(doc_id, ids) of the wanted documents that the file holds."""
        wanted = np.flatnonzero(np.isin(self.doc_id, list(doc_ids)) & (self.is_null == 0))
        for place, ids in self.documents(wanted.tolist()):
            yield int(self.doc_id[place]), ids


class _Bytes:
    """A binary value as something to seek in, without a copy."""

    def __init__(self, buffer: pa.Buffer):
        self.buffer, self.place = buffer, 0

    def seek(self, place: int, whence: int = 0) -> None:
        self.place = place + (self.buffer.size if whence == 2 else 0)

    def tell(self) -> int:
        return self.place

    def read(self, size: int) -> bytes:
        return self.buffer.slice(self.place, size).to_pybytes()


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, frame_bytes: int = FRAME_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Encode every row's whole text, append END_ID, write files in ascending doc_id order under `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out, end = encoder(tokenizer), FileWriter(frame_bytes, file_bytes), struct.pack("<I", END_ID)
        for part in slices(batches, SLICE):
            for doc_id, ids in zip(part.column(0).to_pylist(), own.encode(part.column(1)), strict=True):
                if done := out.add(doc_id, ids.tobytes() + end):
                    yield pa.RecordBatch.from_arrays([pa.array([done], pa.binary())], names=["file"])
        if done := out.finish():
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.binary())], names=["file"])

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = chosen.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    files = ordered.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
    # One row is one file: the writer starts a new one after each.
    files.write.mode("errorifexists").option("lineSep", END).option("maxRecordsPerFile", 1).text(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """file, first_doc, n_tokens: one row per file, from the seek tables and indexes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            readers = [FileReader(_Bytes(x.as_buffer())) for x in batch.column(1)]
            firsts = [None if r.is_null[0] else int(r.doc_id[0]) for r in readers]
            totals = [int(r.n_tokens.sum()) for r in readers]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(firsts, pa.int64()), pa.array(totals, pa.int64())], names=["file", "first_doc", "file_tokens"])

    return _files(spark, path).mapInArrow(run, "file string, first_doc bigint, file_tokens bigint")


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """file, place, doc_id, ids (binary) of all documents, or of the wanted ones, whose frames alone are unpacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader = FileReader(_Bytes(content.as_buffer()))
                places = np.arange(len(reader.doc_id)) if doc_ids is None else np.flatnonzero(np.isin(reader.doc_id, doc_ids) & (reader.is_null == 0))
                for some in np.array_split(places, max(1, len(places) // 1000)):
                    ids = [x for _, x in reader.documents(some.tolist())]
                    docs = pa.array(reader.doc_id[some], mask=reader.is_null[some] != 0)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(some, pa.int64()), docs, pa.array(ids, pa.binary())], names=["file", "place", "doc_id", "ids"])

    return _files(spark, path).mapInArrow(run, "file string, place bigint, doc_id bigint, ids binary")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def digests(docs: DataFrame, path: str | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files written for it."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(docs, path, tokenizer)
    # One row per file of some 16 MB, so this running sum stays small.
    order = Window.orderBy(F.asc_nulls_first("first_doc"), "file").rowsBetween(Window.unboundedPreceding, -1)
    before = read_index(spark, path).select("file", F.coalesce(F.sum("file_tokens").over(order), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader = FileReader(_Bytes(content.as_buffer()))
                n = reader.n_tokens.astype(np.int64)
                crc = [zlib.crc32(ids) for _, ids in reader.documents(range(len(n)))]
                docs = pa.array(reader.doc_id, mask=reader.is_null != 0)
                columns = [pa.array([name] * len(n)), docs, pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "doc_id", "offset", "n_tokens", "ids_crc32"])

    rows = _files(spark, path).mapInArrow(run, "file string, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(before, "file").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")

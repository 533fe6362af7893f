import io
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from netspark.llm import parts, token_files

LIBRARY = Tokenizer.from_file(token_files.TOKENIZER)
TEXTS = ["", None, "one two", "a  b\n \nc ", "<|endoftext|> x<|endoftext|>", "word " * 3000, "x" * 9000, "ñ é ß", "one two", " lead", "\x1c a  b", "x ", " ", "a \x1cb \u2003c", "word, word. (word) 3,4. ab's, x² y², xª. n't!! ñ$$$ A%%% .. a' b", "end. \n\n x"]


def ids_of(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()


def test_rows_come_from_the_files_in_order(spark, tmp_path):
    rows = [(900 - 7 * i, t, "file", i) for i, t in enumerate(TEXTS)] + [(5, "tie", "", 0), (5, "tie", "", 1), (None, "no id", "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string, place int").repartition(3)
    found = token_files.digests(docs, f"{tmp_path}/a").orderBy("start").collect()
    start, expected = 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(text)
        expected.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert [tuple(r) for r in found] == expected
    wanted = {r.doc_id: r.ids for r in token_files.read(spark, f"{tmp_path}/a", [900, 5]).collect()}
    assert {k: bytes(v) for k, v in wanted.items()} == {900: ids_of(""), 5: ids_of("tie")}


def test_empty_table(spark, tmp_path):
    assert token_files.digests(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/b").count() == 0


def test_memory_holds_and_forgets(monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé.,' \n\u2003日") for _ in range(rng.randint(1, 6)))
    texts = [*TEXTS, *(" ".join(word() for _ in range(rng.randrange(40))) for _ in range(600))]
    for limit in (2_000_000, 300):
        monkeypatch.setattr(token_files, "MEMORY", limit)
        own = token_files.Encoder(token_files.TOKENIZER)
        for start in range(0, len(texts), 50):
            some = texts[start : start + 50]
            for text, ids in zip(some, own.encode(pa.array(some, pa.string())), strict=True):
                assert ids.tolist() == LIBRARY.encode(text or "", add_special_tokens=False).ids, repr(text)
        assert len(own.hash) <= limit


def test_parts_of_one_hash_are_told_apart(monkeypatch):
    told = parts.word_hashes
    monkeypatch.setattr(parts, "word_hashes", lambda data, starts, ends, seed=0: told(data, starts, ends, seed) & np.uint64(~0 % 2**64 if seed else 63))
    monkeypatch.setattr(np, "isin", None)  # the memory is searched, not hashed anew with every slice
    own = token_files.Encoder(token_files.TOKENIZER)
    texts = [f"word{i} and{i % 7}, or" for i in range(300)]
    for start in range(0, 300, 3):
        some = texts[start : start + 3]
        assert [x.tolist() for x in own.encode(pa.array(some))] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in some]
    assert 0 < len(own.hash) <= 64


def file_of(docs, **sizes):
    writer, files = token_files.FileWriter(**sizes), []
    for doc_id, ids in docs:
        if done := writer.add(doc_id, ids):
            files.append(done)
    if done := writer.finish():
        files.append(done)
    return [x + token_files.END.encode() for x in files]


def test_only_wanted_frames_are_unpacked_and_any_tool_reads_the_file():
    docs = [(i, struct.pack("<I", i) * (i % 50 + 1)) for i in range(400)]
    (content,) = file_of(docs, frame_bytes=1000)
    reader = token_files.FileReader(io.BytesIO(content))
    assert dict(reader.find([3, 4, 333])) == {i: docs[i][1] for i in (3, 4, 333)}
    assert reader.unpacked <= 2 < len(reader.table)
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True) as stream:
        assert stream.read() == b"".join(x for _, x in docs)


def test_files_are_bounded_and_checksums_hold():
    rng = np.random.default_rng(1)
    docs = [(i, rng.integers(0, 50_000, 300).astype("<u4").tobytes()) for i in range(200)]
    files = file_of(docs, frame_bytes=4000, file_bytes=20_000)
    assert len(files) > 3 and max(map(len, files)) < 40_000
    assert [x for f in files for x in token_files.FileReader(io.BytesIO(f)).documents(range(0))] == []
    broken = bytearray(files[0])
    broken[40] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.FileReader(io.BytesIO(bytes(broken))).find([0]))

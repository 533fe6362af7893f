import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from netspark.llm import byte_bpe

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.TOKENIZER, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [
    "", " ", "a", "  two  spaces ", "line\n \nline", "tab\t end ", "it's we'll 'S", "x" * 5000, "ab" * 3000, "ñandú straße " * 9,
    "\x1c a\x1c b", "日本語 テキスト", "é ½ ²", "<|endoftext|>", "\r\n\r\n x", "  x", "🙂🙂 🙂", "1234567 12,5", "\x00\x00", " 's",
]


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.encoder(byte_bpe.TOKENIZER, public_tokenizers.PATTERN).vocabulary


def test_encoding_and_decoding_agree_with_the_library(spark):
    rng = random.Random(3)
    some = ["".join(rng.choice(" \n\tabcdeéß'19.,_日") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts = [None, *ODD, *some, "tie", "tie"]
    docs = spark.createDataFrame([(i % 400 if i else None, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded int")
    rows = sorted((r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in byte_bpe.digests(docs).collect())
    expected = []
    for text in texts:
        ids = np.array(LIBRARY.encode_ordinary(text or ""), "<u4")
        expected.append((hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), len(ids)))
    assert rows == sorted(expected)


def test_empty_table(spark):
    assert byte_bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_appends_are_exact(vocabulary):
    rng = random.Random(5)
    for _ in range(60):
        piece = bytes(rng.choice(b"abcdeinorst \xc3\xa9") for _ in range(rng.randint(1, 120)))
        cut = rng.randint(0, len(piece))
        table = byte_bpe.PrefixTable(vocabulary, piece[:cut])
        table.append(piece[cut:])
        assert table.ids() == vocabulary.merged(piece)


def test_edits_work_out_only_what_is_near(vocabulary):
    rng = random.Random(7)
    for _ in range(60):
        piece = bytes(rng.choice(b"abcdeinorst") for _ in range(400))
        start = rng.randint(0, 399)
        end, new = rng.randint(start, min(400, start + 9)), bytes(rng.choice(b"xyzaeiou") for _ in range(rng.randint(0, 9)))
        table = byte_bpe.PrefixTable(vocabulary, piece)
        worked = table.replace(start, end, new)
        assert table.piece == piece[:start] + new + piece[end:]
        assert table.ids() == vocabulary.merged(table.piece)
        assert worked <= len(new) + 4 * vocabulary.longest


def test_a_memory_that_is_full_or_emptied_changes_no_ids():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeé'19.,)") for _ in range(rng.randint(1, 70))) for _ in range(300)]
    texts = [*ODD, *[rng.choice([" ", "\n", "  ", "\n\n", ". "]).join(rng.choices(words, k=30)) for _ in range(40)]]
    want = [LIBRARY.encode_ordinary(text) for text in texts]
    for limit in (1, 40, 100_000):
        own = byte_bpe.Encoder(byte_bpe.TOKENIZER, public_tokenizers.PATTERN, 20)
        own.limit = limit
        for _ in range(3):
            assert [x.tolist() for x in own.encode(pa.array(texts))] == want
            assert len(own.hash) <= limit
        own.forget()
        assert not len(own.hash) and not own.pieces and not own.vocabulary.known


def test_a_part_met_again_is_not_split_again():
    own = byte_bpe.Encoder(byte_bpe.TOKENIZER, public_tokenizers.PATTERN)
    (first,) = own.encode(pa.array(["so it goes, and so on"]))
    own.split = None
    again = [x.tolist() for x in own.encode(pa.array(["so it goes, and so on", None, ""]))]
    assert again == [first.tolist(), [], []]

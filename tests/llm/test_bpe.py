"""Byte-level BPE against the library's results, byte by byte and row by row."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from corpora import SCHEMA, messy
from hypothesis import given, settings
from hypothesis import strategies as st

from prospectry.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
VOCABULARY = bpe.Vocabulary(RANKS)


def test_perfect_hash_has_one_slot_for_each_key():
    for n in (1, 2, 3, 1000, 50_000):
        keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
        keys = np.unique(keys)
        assert sorted(bpe.PerfectHash(keys).slots(keys)) == list(range(len(keys)))
    with pytest.raises(ValueError):
        bpe.PerfectHash(np.array([7, 7], dtype=np.uint64))


def test_first_tier_finds_all_tokens_and_nothing_else():
    tokens = list(RANKS)
    assert VOCABULARY.whole(tokens) == list(RANKS.values())
    strange = [t + b"\xff\xfe\xfd" for t in tokens[:5000]] + [b""]
    assert set(VOCABULARY.whole(strange)) == {-1}


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_merges_follow_the_library(text):
    piece = text.encode()
    if piece:
        assert VOCABULARY.merged(piece) == LIBRARY._encode_single_piece(piece) or piece in RANKS


def test_long_runs_merge_as_in_the_library():
    for piece in ("x" * 5000, "ab" * 3000, "é" * 2000, "=-" * 1000 + "=", "\U0001f600" * 700):
        assert VOCABULARY.merged(piece.encode()) == LIBRARY._encode_single_piece(piece.encode())


def texts():
    rng = random.Random(5)
    odd = ["<|endoftext|> it's I'LL don't", " \n\n  a  b\t\tc \r\n", "\x1c\x85  x", "héé naïve ß ǅ 数字12３ ½", "a" * 40_000,
           " " * 3000, "�\x00\x7f", "\U0001f469‍\U0001f4bb" * 9]
    odd += ["".join(rng.choice("abcdeé'12 \n\t.,中 ") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    return odd


def test_documents_of_all_kinds(spark):
    rows = messy() + [(5000 + i, t, *[None] * 10) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, bpe.digests(docs, RANKS, PATTERN).collect()), key=str)
    wanted = []
    for r in rows:
        ids = LIBRARY.encode_ordinary(r[1] or "")
        wanted.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                       hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == sorted(wanted, key=str)
    kept = bpe.encode(docs, RANKS, PATTERN)
    assert kept.select("doc.*").columns == docs.columns
    assert bpe.digests(docs.limit(0), RANKS, PATTERN).count() == 0


def test_forgetting_and_short_stretches_change_nothing(monkeypatch):
    wanted = [LIBRARY.encode_ordinary(t) for t in texts()]
    for size in (1 << 21, 50, 3):
        monkeypatch.setattr(bpe, "SLICE", size)
        got, chunks = [], bpe._Chunks(PATTERN, VOCABULARY)
        for t in texts():
            chunks = bpe._Chunks(PATTERN, VOCABULARY) if len(chunks) > 5 else chunks
            got += bpe._encoded(pa.array([t]), chunks).to_pylist()
        assert got == wanted
    assert bpe._encoded(pa.array(texts()), bpe._Chunks(PATTERN, VOCABULARY)).to_pylist() == wanted


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab'sé \n\t\x1c\x85\u3000.1", max_size=30), max_size=4))
def test_texts_follow_the_library(rows):
    got = bpe._encoded(pa.array(rows, pa.string()), bpe._Chunks(PATTERN, VOCABULARY)).to_pylist()
    assert got == [LIBRARY.encode_ordinary(t) for t in rows]


def test_ids_that_no_token_has(spark):
    frame = spark.createDataFrame([(1, [0, 99_999_999]), (2, None)], "n int, ids array<int>")
    assert bytes(bpe.decode(frame.filter("n = 2"), RANKS).first()["bytes"]) == b""
    with pytest.raises(Exception, match="no token has"):
        bpe.decode(frame, RANKS).collect()
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0})

import hashlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from siftstone.llm import bpe

PATH, PATTERN = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def tree():
    return bpe.codec(PATH, PATTERN)


def whole(tree, text):
    """The library's own ids of the whole text."""
    return tree._leaf.encode_ordinary(text)


def test_documents_against_the_library(spark, tree):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.digests(docs).collect():
        ids = whole(tree, texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the ", "a", " ", "\n\n", "  \t", "1984", "é", "ß ", "日本", "'s", "'ll ", "!!", " ", "\x1c", "🙂", "xyzzy", "aaaa"]), max_size=60))
def test_small_leaves_against_the_library(parts):
    tree = bpe.codec(PATH, PATTERN)
    old = bpe.LEAF, bpe.LONG_WINDOW, bpe.LONG_PIECE
    bpe.LEAF, bpe.LONG_WINDOW, bpe.LONG_PIECE = 12, 24, 10
    try:
        text = "".join(parts)
        ids = tree.encode(text)
        assert ids.tolist() == whole(tree, text)
        assert tree.decode(ids) == text.encode()
    finally:
        bpe.LEAF, bpe.LONG_WINDOW, bpe.LONG_PIECE = old


@pytest.mark.parametrize("text", ["ab" * 20_000, "the" * 9_000 + " end", " " * 30_000 + "x", "é" * 12_000, "x\n" * 20_000, "<|endoftext|>"])
def test_long_runs(tree, text):
    ids = tree.encode(text)
    assert ids.tolist() == whole(tree, text)
    assert tree.decode(ids) == text.encode()


def test_null_empty_repeated_and_clashing_columns(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x y", "c"), (3, "x y", "c"), (None, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in bpe.digests(docs).collect())
    assert got == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2)]
    assert bpe.digests(docs.limit(0)).collect() == []
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(bytes(r.decoded) for r in back) == [b"", b"", b"x y", b"x y", b"z"]

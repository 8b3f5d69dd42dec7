"""Ids and decoded bytes against the tiktoken library."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from scorewell.llm import byte_pairs

RANKS = byte_pairs.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_pairs.Codec(RANKS, public_tokenizers.PATTERN)


def test_perfect_hash_is_minimal_and_exact(codec):
    table = codec.memo.whole
    assert len(table.keys) == len(RANKS) and set(table.keys) == set(RANKS)
    assert all(table.get(k) == v for k, v in RANKS.items())
    assert all(table.get(k + b"\xff\x00") is None for k in list(RANKS)[:2000])
    assert byte_pairs.PerfectHash({}).get(b"a") is None


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_as_the_library(codec, text):
    ids = codec.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert codec.decode(ids) == text.encode("utf-8", "surrogatepass")


def test_query_rows(docs):
    texts = [None, "", " ", "a", "the " * 3000, "x" * 3000, "naïve 😀  \n\n straße it's 12345", "<|endoftext|>"]
    rows = byte_pairs.round_trip(docs([*enumerate(texts), (0, None)]), RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = LIBRARY.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert byte_pairs.round_trip(docs([]), RANKS, public_tokenizers.PATTERN).collect() == []

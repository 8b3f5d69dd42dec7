"""Ids against the tokenizers library, layouts by their rules, the tree against a scan of all windows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scorewell.llm import tight_packing

DEFINITION = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
PARTS, LIBRARY = tight_packing.PartIds(DEFINITION), Tokenizer.from_str(DEFINITION)
TEXTS = [
    None, "", " \t ", "Hello world", "it's 12 o'clock!!", "naïve  STRASSE\n\n x y é İ", "the quick brown fox " * 1500, "a <|endoftext|> b<|endoftext|>", "x" * 9000, "\x1c\x85 áb",
    "名前　です。 中文", "tail  \n",
]


def want_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text("abE 01.,'stév\n\t×ÿ", max_size=60) | st.text("abE é'st.,01ÀÿÞ× \n\t\r\x1c\x1f\x85\xa0 　<|endoftext|>", max_size=60))
def test_same_ids_as_the_library(text):
    assert np.frombuffer(PARTS.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def check_layout(rows, texts, capacity):
    """Sequences without gaps or overlaps, every id of every document once; returns the padding."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    padding = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert set(pieces) == set(texts)
    for doc_id, text in texts.items():
        ids, at = want_ids(text), 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    return padding


@pytest.mark.parametrize("cell_pieces", [3, 8192])
def test_pieces_and_layout(docs, cell_pieces):
    frame = docs([*enumerate(TEXTS), (None, "Hello")])
    rows = tight_packing.pack(frame, DEFINITION, cell_pieces=cell_pieces).collect()
    assert check_layout(rows, {**dict(enumerate(TEXTS)), None: "Hello"}, 2048) == 0


def test_whole_rests_without_closing(docs):
    rows = tight_packing.pack(docs(list(enumerate(TEXTS))), DEFINITION, capacity=64, close=False).collect()
    check_layout(rows, dict(enumerate(TEXTS)), 64)
    for r in rows:
        assert r.length == 64 or r.start + r.length == r.doc_tokens


def test_repeated_rows_clashing_columns_and_empty_tables(spark, docs):
    frame = docs([(3, "Hello world")] * 5).selectExpr("*", "1 AS cell", "2 AS ids", "3 AS salt", "4 AS length", "5 AS sequence_id")
    rows = tight_packing.pack(frame, DEFINITION).collect()
    assert sum(r.length for r in rows) == 15 and {r.doc_tokens for r in rows} == {3}
    assert tight_packing.pack(docs([]), DEFINITION).collect() == []


def test_ids_of_large_vocabularies_keep_four_bytes(docs):
    rows = tight_packing.pack(docs([(1, "Hello")]), DEFINITION, end_id=70_000).collect()
    assert sorted((r.start, r.length) for r in rows) == [(0, 2)] and rows[0].ids_crc32 == zlib.crc32(np.array([15496, 70_000], dtype="<u4").tobytes())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(40, 64))
def test_tree_finds_the_tightest_window(lengths, capacity):
    lengths = sorted(lengths, reverse=True)
    rooms: list[int] = []
    for size in lengths:  # all open windows looked at, by the same rule
        fits = [k for k, room in enumerate(rooms) if room >= size]
        if not fits:
            rooms.append(capacity - size)
        else:
            rooms[min(fits, key=lambda k: rooms[k])] -= size
    got = tight_packing.best_fit_decreasing(lengths, capacity)
    assert sorted(i for w in got for i in w) == list(range(len(lengths)))
    assert sorted(capacity - sum(lengths[i] for i in w) for w in got) == sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 99), max_size=60), st.sampled_from([100, 128]))
def test_closing_leaves_no_padding_and_cuts_little(lengths, capacity):
    lengths = sorted(lengths, reverse=True)
    packed = [[(i, 0, lengths[i]) for i in w] for w in tight_packing.best_fit_decreasing(lengths, capacity)]
    closed = tight_packing.close_windows(packed, capacity)
    spans = defaultdict(list)
    for w in closed:
        n = sum(b - a for _, a, b in w)
        assert n == capacity or n & (n - 1) == 0
        for i, a, b in w:
            spans[i].append((a, b))
    for i, n in enumerate(lengths):
        at = 0
        for a, b in sorted(spans[i]):
            assert a == at
            at = b
        assert at == n
    assert sum(map(len, spans.values())) <= len(lengths) + len(closed) + 7


def test_little_is_padded_before_and_cut_by_closing():
    rng = random.Random(3)
    lengths = sorted((min(2047, int(rng.lognormvariate(6, 1)) + 1) for _ in range(6000)), reverse=True)
    packed = [[(i, 0, lengths[i]) for i in w] for w in tight_packing.best_fit_decreasing(lengths, 2048)]
    rooms = [2048 - sum(b - a for _, a, b in w) for w in packed]
    assert sum(rooms) < 0.002 * sum(lengths)
    assert sum(map(len, tight_packing.close_windows(packed, 2048))) <= 6000 + sum(r > 0 for r in rooms) + 11

"""Ids against the tokenizers library, layouts by their rules, and the search against best fit alone."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scorewell.llm import packing

DEFINITION = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
WORDS, LIBRARY = packing.WordIds(DEFINITION), Tokenizer.from_str(DEFINITION)


def want(text):
    ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
    return [(i // 2048, i, len(p), zlib.crc32(np.array(p, dtype="<u4").tobytes())) for i in range(0, len(ids), 2048) if (p := ids[i : i + 2048])]


TEXTS = [None, "", " \t ", "Hello world", "it's 12 o'clock!!", "naïve STRASSE straße ΟΔΟΣ  x y é İ", "the quick brown fox " * 1500, "<|endoftext|> a", "x" * 9000, "\x1c\x85 áb"]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "a", "It's", "É", "\n", "<|"])).map("".join) | st.text("abcDEé ß'st.,0129ÀÿÞ×÷ªµ-\n", max_size=60))
def test_same_ids_as_the_library(text):
    got = np.frombuffer(WORDS.encode(text), "<u4").tolist()
    assert got == LIBRARY.encode(text, add_special_tokens=False).ids


def layout_is_sound(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by)


def test_pieces_and_layout(docs):
    rows = packing.pack(docs([*enumerate(TEXTS), (3, "Hello world"), (None, "Hello")]), DEFINITION).collect()
    layout_is_sound(rows)
    for i, text in enumerate(TEXTS):
        got = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i})
        assert got == want(text), text
    assert sum(r.doc_id == 3 for r in rows) == 2
    assert packing.pack(docs([]), DEFINITION).collect() == []


def test_cells_lose_little(spark):
    rng = random.Random(2)
    lengths = [min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(6000)]
    frame = spark.createDataFrame([(i, 0, 0, n, 0, i) for i, n in enumerate(lengths)], packing.PIECE_DDL + ", salt bigint")
    used = layout_is_sound(packing.pack_pieces(frame, cell_pieces=2000).collect())
    assert used <= -(-sum(lengths) // 2048) + 6


@pytest.mark.parametrize("seed", range(6))
def test_search_never_loses_items_or_adds_bins(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(20, 70) for _ in range(120)]
    start = packing.best_fit(lengths, 100)
    squares = lambda bins: sum(sum(lengths[i] for i in b) ** 2 for b in bins)
    before, n = squares(start), len(start)
    found = packing.improve([list(b) for b in start], lengths, 100)
    assert sorted(i for b in found for i in b) == list(range(120))
    assert len(found) <= n and squares(found) >= before and all(sum(lengths[i] for i in b) <= 100 for b in found)


def test_search_empties_a_bin_that_best_fit_leaves():
    lengths = [6, 5, 5, 4, 4, 3, 3]  # 30 = 3 bins of 10: best fit makes 6+4, 5+5, 4+3+3
    assert len(packing.improve([[0, 5], [1, 3], [2, 4], [6]], lengths, 10)) == 3


def test_search_goes_on_until_no_step_of_any_bin_helps():
    rng = random.Random(5)
    lengths = [rng.randint(532, 819) for _ in range(1500)]
    start = packing.best_fit(lengths, 2048)
    found = packing.improve(start, lengths, 2048)
    assert sorted(i for b in found for i in b) == list(range(1500))
    least = -(-sum(lengths) // 2048)
    assert least < len(found) < len(start) - 20
    fill = [sum(lengths[i] for i in b) for b in found]
    assert max(fill) <= 2048
    under = [k for k in range(len(found)) if fill[k] < 2048]
    owner = np.array([k for k in under for _ in found[k]] + under)
    back = np.array([lengths[i] for k in under for i in found[k]] + [0] * len(under))
    level = np.array(fill)[owner]
    for k in under:
        mine = [lengths[i] for i in found[k]]
        for total in {*mine, *[mine[x] + mine[y] for x in range(len(mine)) for y in range(x)]}:
            moved = total - back
            possible = (owner != k) & (moved > 0) & (level + moved <= 2048)
            assert not (possible & (level - fill[k] + moved > 0)).any()


def test_search_leaves_less_than_400_steps_did():
    rng = random.Random(1)
    lengths = [rng.randint(532, 819) for _ in range(16_384)]
    start = packing.best_fit(lengths, 2048)
    assert len(packing.improve(start, lengths, 2048)) < len(start) - 400

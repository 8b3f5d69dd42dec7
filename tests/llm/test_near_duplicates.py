import random

import numpy as np
import pytest
from brute import components
from pyspark.sql import functions as F

from scorewell.llm import near_duplicates as nd


def family(seed, n_bases=4, copies=25, n_words=120):
    """Texts around a few bases with more and more words changed, so that many pairs lie near the threshold."""
    rng = random.Random(seed)
    rows = []
    for b in range(n_bases):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(n_words)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, 9)):
                words[rng.randrange(n_words)] = f"x{rng.randint(0, 10**6)}"
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return list(enumerate(rows))


def check(docs, rows, percent, size):
    comp, counts = components([r for r in rows if r[0] is not None], percent, size)
    got = nd.group(docs(rows), percent, size).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (counts[r.doc_id], comp[r.doc_id], comp[r.doc_id] == r.doc_id)


@pytest.mark.parametrize(("percent", "size"), [(85, 3), (80, 5)])
def test_components_equal_brute_force(docs, percent, size):
    rows = family(1) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "One"), (1005, "one two"), (1006, "one  TWO"), (1007, "a b c"), (1008, "a " * 30000)]
    rows += [(2000 + i, "same text again and again and again") for i in range(40)]
    check(docs, rows, percent, size)


def test_small_blocks_give_the_same(docs, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 4)
    monkeypatch.setattr(nd, "SET_BLOCK", 3)
    check(docs, family(2, 2, 30), 85, 3)


def test_pairs_within_the_distance_share_a_key():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (300, nd.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(nd.SYMBOLS, 2 * nd.CHUNKS - 1, replace=False)] ^= 1
    assert (nd.index_keys(a) == nd.index_keys(b)).any(axis=1).all()


def test_repeated_rows_and_missing_ids(docs):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (None, "only here without id"), (9, "x y z w")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in nd.group(docs(rows)).collect()), key=repr)
    assert got == sorted([(5, 3, False), (5, 3, False), (3, 3, True), (None, 3, False), (None, None, True), (9, 9, True)], key=repr)
    assert nd.group(docs([])).collect() == []
    df = docs([*rows, (9, "x y z w")]).withColumn("kept", F.lit(1)).withColumn("label", F.lit(2))
    out = nd.keep_first(df)
    assert out.columns == df.columns and sorted((r.doc_id for r in out.collect()), key=repr) == [3, 9, None]

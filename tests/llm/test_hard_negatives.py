"""Negatives against a scan of all pairs; the index against all scores of a block."""

import math

import numpy as np
import pytest

from scorewell.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def want(rows, every=100):
    used = []
    for vec_id, vector, label in rows:
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            used.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for i, (anchor, a, label) in enumerate(used):
        if anchor is None or anchor % every:
            continue
        scored = [(v, sum(x * y for x, y in zip(a, b, strict=False)), other == label) for j, (v, b, other) in enumerate(used) if j != i]
        for positive, p, _ in sorted((s for s in scored if s[2]), key=order)[:5]:
            inside = sorted((s for s in scored if not s[2] and 80 * p <= 100 * s[1] <= 100 * p), key=order)[:5]
            out += [(anchor, positive, rank, n, p, s) for rank, (n, s, _) in enumerate(inside, 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


def vectors(seed, n, labels, dimensions=16, groups=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 0.2, (groups, dimensions))
    return [(i, [float(np.float32(x)) for x in middle[rng.integers(groups)] + rng.normal(0, 0.1, dimensions)], int(rng.choice(labels))) for i in range(n)]


@pytest.mark.parametrize("limit", [0, hard_negatives.BROADCAST_BYTES])
def test_same_negatives_with_every_odd_row(spark, monkeypatch, limit):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 90)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 3)
    rows = vectors(1, 500, [0, 0, 0, 1, 2])  # one label holds most rows
    rows += [(600, None, 1), (700, rows[3][1], None), (800, [math.nan] * 16, 1), (801, [math.inf] * 16, 1), (802, [None] * 16, 1), (900, [], 1), (1000, [0.0] * 16, 2)]
    rows += [rows[100], rows[100], rows[7], (None, rows[9][1], 1), (None, rows[200][1], 0), (1100, rows[200][1], 2), (1200, [0.1] * 5, 0), (1300, [50.0] * 16, 77), (1400, [-0.4] * 16, 78)]
    rows += [(1500, [0.5] * 16, 90), (1501, [-0.5] * 16, 90), (1600, rows[5][1], 91), (1601, rows[5][1], 91)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("*", "1 AS `row`", "2 AS `full`", "3 AS block", "4 AS scores", "5 AS need")
    assert got(hard_negatives.mine(frame, broadcast_bytes=limit)) == want(rows)


def test_labels_without_partners_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 2), (100, [0.5, 0.5], 3)]
    assert got(hard_negatives.mine(spark.createDataFrame(rows, SCHEMA))) == want(rows) == []
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hard_negatives.mine(spark.createDataFrame([(100, None, 1)], SCHEMA)).collect() == []
    same = [(i, [1.0, 1.0], i % 2) for i in range(0, 400)]
    assert got(hard_negatives.mine(spark.createDataFrame(same, SCHEMA))) == want(same)


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**20 + i * 64), float(i * 64)], i % 3) for i in range(0, 300, 4)]
    assert got(hard_negatives.mine(spark.createDataFrame(rows, SCHEMA))) == want(rows)
    with pytest.raises(ValueError, match="too large"):
        hard_negatives.mine(spark.createDataFrame([(100, [1e9, 1.0], 1), (101, [1e9, 1.0], 1)], SCHEMA))


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_all_pairs_above_the_threshold(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.choice([1, 7, 16, 40]))
    rows, anchors = (np.floor(rng.normal(0, 30, (n, d)) * rng.choice([0, 0.2, 1, 3], (n, 1))) for n in (400, 30))
    layout = hard_negatives.Layout([1.0] * d, 1000, 100.0)
    scores = anchors @ rows.T
    for share in (-np.inf, -0.2, 0.0, 0.3, 0.6, 0.95):
        least = np.full(30, share) if share == -np.inf else share * np.abs(scores).max(axis=1) + (share == 0)
        a, x, s = hard_negatives.pairs_above(layout, anchors, rows, least)
        assert set(zip(a.tolist(), x.tolist(), s.tolist(), strict=True)) == {(int(i), int(j), int(scores[i, j])) for i, j in zip(*np.nonzero(scores >= least[:, None]), strict=True)}
        assert len(set(zip(a.tolist(), x.tolist(), strict=True))) == len(a)


def test_rows_of_little_weight_are_not_listed():
    layout = hard_negatives.Layout([1.0] * 16, 1000, 100.0)
    rows = np.r_[np.full((50, 16), 1.0), np.full((50, 16), 40.0)]
    touched = []
    norms = layout.norms(rows)
    anchors = np.full((2, 16), 40.0)
    reach = norms[:, :-1] * layout.norms(anchors)[:, :-1].max(axis=0) >= 0.9 * 16 * 1600
    touched = reach.sum(axis=1)
    assert (touched[:50] == 0).all() and (touched[50:] == 1).all()  # of two segments the second is covered by its norm

"""Clusters against plain k-means in integers; intervals against the distances they bound."""

import hashlib
import math

import numpy as np
import pytest

from scorewell.llm import cell_clusters
from scorewell.llm.queries import ORACLES

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def want(rows, dimensions=64, scale=64, k=16, rounds=3):
    used = []
    for vec_id, vector, *_ in rows:
        if vector is not None and len(vector) == dimensions and all(x is not None and math.isfinite(x) for x in vector):
            used.append((vec_id, [math.floor(scale * float(np.float32(x))) for x in vector]))
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [list(v) for _, v in sorted(used, key=key)[:k]]
    for step in range(rounds + 1):
        members, out = [[] for _ in centroids], []
        for vec_id, v in used:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            best = min(range(len(d)), key=lambda i: (d[i], i))
            members[best].append(v)
            out.append((vec_id, best, d[best]))
        if step < rounds:
            centroids = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(members, centroids, strict=True)]
    inertia = [sum(d for _, c, d in out if c == i) for i in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((v, c, d, inertia[c], sum(inertia), digest[c]) for v, c, d in out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def vectors(seed, n, dimensions=64, spread=0.15):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 0.3, (5, dimensions))
    return [(int(i), [float(np.float32(x)) for x in middle[i % 5] + rng.normal(0, spread, dimensions)], int(i % 3)) for i in range(n)]


def test_same_clusters_with_every_odd_row(spark):
    rows = vectors(1, 300)
    rows += [(900, None, 1), (901, [1.0] * 63, 1), (902, [math.nan] + [0.0] * 63, 1), (903, [math.inf] + [0.0] * 63, 1), (904, [None] + [0.0] * 63, 1), (905, [], 1)]
    rows += [rows[3], rows[3], (7, rows[8][1], None), (None, rows[9][1], 2), (None, rows[10][1], 2), (906, [0.0] * 64, 1), (907, [1e4] * 64, 1)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 AS `row`", "2 AS `full`", "3 AS cells", "4 AS cluster")
    assert got(cell_clusters.cluster(frame)) == want(rows)


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_result_does_not_depend_on_the_cells(spark, bits):
    rows = vectors(2, 200, dimensions=8)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert got(cell_clusters.cluster(frame, dimensions=8, clusters=7, rounds=4, bits=bits)) == want(rows, dimensions=8, k=7, rounds=4)


def test_equal_distances_few_vectors_and_empty_tables(spark):
    rows = [(i, [float(i % 2)] * 64, 0) for i in range(9)]
    assert got(cell_clusters.cluster(spark.createDataFrame(rows, SCHEMA))) == want(rows)
    assert cell_clusters.cluster(spark.createDataFrame([], SCHEMA)).collect() == []
    assert cell_clusters.cluster(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []


def test_components_beyond_exact_distances_raise(spark):
    with pytest.raises(ValueError, match="within"):
        cell_clusters.cluster(spark.createDataFrame([(1, [1e9] * 64, 1)], SCHEMA))


def test_intervals_hold_the_distances_and_settle_most_vectors():
    rng = np.random.default_rng(3)
    data = np.floor(rng.normal(0, 8, (2000, 64))).astype(np.int64)
    centroids = data[:16]
    cells = cell_clusters.Cells([list(range(-25, 26)) for _ in range(64)], data.min(axis=0).tolist(), data.max(axis=0).tolist(), 6)
    numbers = cells.unpack(cells.pack(data))
    low, high = (sum(t[d][numbers[d]] for d in range(64)) for t in cells.tables(centroids))
    exact = ((data[:, None] - centroids) ** 2).sum(axis=2)
    assert (low <= exact).all() and (exact <= high).all()
    allowed = cells.candidates(numbers, cells.tables(centroids))
    assert allowed[np.arange(2000), exact.argmin(axis=1)].all()
    assert (allowed.sum(axis=1) == 1).mean() > 0.8


def test_only_doubtful_rows_are_fetched():
    rng = np.random.default_rng(4)
    data = np.floor(rng.normal(0, 3, (1000, 4))).astype(np.int64) + np.repeat([[0], [200]], 500, axis=0)
    cells = cell_clusters.Cells([list(range(-10, 220, 4)) for _ in range(4)], data.min(axis=0).tolist(), data.max(axis=0).tolist(), 6)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([r.tobytes() for r in cells.pack(data)], pa.binary())], names=["row", "cells"])
    old, new = np.array([[0] * 4, [200] * 4]), np.array([[1] * 4, [201] * 4])
    assert sum(b.num_rows for b in cell_clusters._doubtful(cells, old, new)(iter([batch]))) == 0
    assert sum(b.num_rows for b in cell_clusters._doubtful(cells, old, new[::-1].copy())(iter([batch]))) == 1000


def test_same_rows_as_sql(spark):
    import duckdb
    import pandas as pd

    rows = vectors(5, 150)
    embeddings = pd.DataFrame({"vec_id": [r[0] for r in rows], "embedding": [np.array(r[1], dtype=np.float32) for r in rows]})  # noqa: F841
    sql = sorted(duckdb.sql(ORACLES["op12_cell_clusters"]).fetchall(), key=repr)
    assert got(cell_clusters.cluster(spark.createDataFrame(rows, SCHEMA))) == sql

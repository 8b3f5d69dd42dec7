"""k-means over a vector-approximation file: few-bit cells answer for most vectors, full vectors only where they cannot.

Every component is replaced by the number of its cell, ``bits`` bits wide; cells are equally wide but for one at each end, which
takes the rare values. One lookup table per dimension gives, for each cell and centroid, the least and the largest squared difference that a
value of the cell can have; summed over the dimensions they bound each distance from both sides. A vector whose best upper
bound lies below all other lower bounds is settled. Only the others are compared in full, and only with the centroids whose
intervals overlap.

Centroids are exact floors of exact integer sums. The first round adds up all vectors. A later round reads just the cells, asks
them about the old and the new centroids, and fetches the full vectors of those rows which are open under either or have moved
between settled clusters: their differences bring the sums up to date. So no assignment is stored between rounds, vectors
are never shuffled by cluster (a hot cluster is no hot task), and a task sends k x dimensions numbers. The driver holds the
centroids and the cells' bounds alone.

Defined results: a row whose vector is NULL, has another length, or holds a NULL or non-finite component is left out; repeated
rows count each; a NULL id is hashed as an empty string; equal hashes are ordered by components; equal distances go to the
smaller number; with fewer vectors than centroids there are that many centroids; an empty table gives no rows; further columns
are ignored. Components beyond 2^27 after scaling raise, since squared distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import materialize

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, BITS = 64, 64, 16, 3, 6
OUTER = [0.001, 0.999]  # cells are narrow between these percentiles
LARGEST = 1 << 27
FAR = np.iinfo(np.int64).max
_SUMS_DDL = "cluster int, place int, total bigint"


def usable(vector: Column, dimensions: int | None = None) -> Column:
    """Whether a vector has so many components, none of them NULL, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN is above infinity
    right = vector.isNotNull() if dimensions is None else F.size(vector) == dimensions
    return F.coalesce(right & finite, F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


class Cells:
    """Bounds of the cells of each dimension: ``low[d][c]`` to ``high[d][c]`` are the values of cell c."""

    def __init__(self, cuts: list[list[int]], least: list[int], largest: list[int], bits: int) -> None:
        self.bits = bits
        self.cuts = [np.unique([c for c in row if c > a]).astype(np.int64) for row, a in zip(cuts, least, strict=True)]
        width = max([len(c) for c in self.cuts], default=0) + 1
        self.low, self.high = (np.zeros((len(cuts), width), np.int64) for _ in range(2))
        for d, row in enumerate(self.cuts):
            self.low[d, : len(row) + 1] = [least[d], *row]
            self.high[d, : len(row) + 1] = [*(row - 1), largest[d]]

    def pack(self, vectors: np.ndarray) -> np.ndarray:
        """Rows of cell numbers, ``bits`` bits each."""
        cells = np.stack([np.searchsorted(c, vectors[:, d], side="right") for d, c in enumerate(self.cuts)], axis=1).astype(np.uint8)
        return np.packbits(np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - self.bits :].reshape(len(cells), -1), axis=1)

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        """Cell numbers by dimension and row."""
        d = len(self.cuts)
        planes = np.unpackbits(packed, axis=1)[:, : d * self.bits].reshape(len(packed), d, self.bits)
        return np.ascontiguousarray((planes @ (1 << np.arange(self.bits)[::-1])).T)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest squared difference by dimension, cell and centroid."""
        a, b = self.low[:, :, None] - centroids.T[:, None, :], self.high[:, :, None] - centroids.T[:, None, :]
        largest = np.maximum(a * a, b * b)
        return np.where((a <= 0) & (b >= 0), 0, np.minimum(a * a, b * b)), largest

    def candidates(self, cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Rows x centroids: whether the interval reaches down to the least upper bound."""
        low, high = (np.zeros((cells.shape[1], t.shape[2]), np.int64) for t in tables)
        for d, row in enumerate(cells):
            low += tables[0][d][row]
            high += tables[1][d][row]
        return low <= high.min(axis=1, keepdims=True)


def distances(vectors: np.ndarray, centroids: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Exact squared distances where ``allowed``; beyond all others elsewhere."""
    out = np.full(allowed.shape, FAR, np.int64)
    for k, centroid in enumerate(centroids):
        rows = np.flatnonzero(allowed[:, k])
        gap = vectors[rows] - centroid
        out[rows, k] = np.einsum("ij,ij->i", gap, gap)
    return out


def assign(cells: Cells, centroids: np.ndarray, tables, numbers: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Clusters of rows: settled by intervals, or by full vectors among the candidates."""
    allowed = cells.candidates(numbers, tables)
    found = allowed.argmax(axis=1)
    rows = np.flatnonzero(allowed.sum(axis=1) > 1)
    if len(rows):
        found[rows] = distances(vectors[rows], centroids, allowed[rows]).argmin(axis=1)
    return found


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dimensions)


def _bytes_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


class _Sums:
    """Componentwise sums and sizes of clusters, gathered over a task."""

    def __init__(self, clusters: int, dimensions: int) -> None:
        self.total = np.zeros((clusters, dimensions + 1), np.int64)

    def add(self, clusters: np.ndarray, vectors: np.ndarray, sign: int = 1) -> None:
        for k in np.unique(clusters):
            rows = clusters == k
            self.total[k, :-1] += sign * vectors[rows].sum(axis=0)
            self.total[k, -1] += sign * int(rows.sum())

    def batch(self) -> pa.RecordBatch:
        k, place = np.nonzero(self.total)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(place, pa.int32()), pa.array(self.total[k, place])], names=["cluster", "place", "total"])


def _all_members(cells: Cells, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, sums = cells.tables(centroids), _Sums(*centroids.shape)
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch["full"], centroids.shape[1])
                sums.add(assign(cells, centroids, tables, cells.unpack(_bytes_matrix(batch["cells"])), vectors), vectors)
        yield sums.batch()

    return run


def _doubtful(cells: Cells, old: np.ndarray, new: np.ndarray):
    """Numbers of the rows that the cells alone do not keep in their cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after = cells.tables(old), cells.tables(new)
        for batch in batches:
            if batch.num_rows:
                numbers = cells.unpack(_bytes_matrix(batch["cells"]))
                was, now = cells.candidates(numbers, before), cells.candidates(numbers, after)
                stays = (was.sum(axis=1) == 1) & (now.sum(axis=1) == 1) & (was.argmax(axis=1) == now.argmax(axis=1))
                yield pa.RecordBatch.from_arrays([batch["row"].filter(pa.array(~stays))], names=["row"])

    return run


def _moves(old: np.ndarray, new: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(*new.shape)
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch["full"], new.shape[1])
                every = np.ones((len(vectors), len(new)), bool)
                was, now = (distances(vectors, c, every).argmin(axis=1) for c in (old, new))
                moved = was != now
                sums.add(was[moved], vectors[moved], -1)
                sums.add(now[moved], vectors[moved])
        yield sums.batch()

    return run


def _final(cells: Cells, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = cells.tables(centroids)
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch["full"], centroids.shape[1])
                found = assign(cells, centroids, tables, cells.unpack(_bytes_matrix(batch["cells"])), vectors)
                gap = vectors - centroids[found]
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"], pa.array(found, pa.int32()), pa.array(np.einsum("ij,ij->i", gap, gap))], names=["vec_id", "cluster", "distance"]
                )

    return run


def _add(sums: dict[tuple[int, int], int], parts: DataFrame) -> None:
    """At most clusters x (dimensions + 1) numbers reach the driver."""
    for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        sums[r.cluster, r.place] = sums.get((r.cluster, r.place), 0) + int(r.total)


def _means(sums: dict[tuple[int, int], int], centroids: np.ndarray) -> np.ndarray:
    out = centroids.copy()
    for k in range(len(centroids)):
        if n := sums.get((k, centroids.shape[1]), 0):
            out[k] = [sums.get((k, d), 0) // n for d in range(centroids.shape[1])]
    return out


def fit_cells(vectors: DataFrame, dimensions: int, bits: int) -> Cells | None:
    """Cells of equal width between two outer percentiles of all rows, and one beyond each end; None without rows."""
    ask = [x for d in range(dimensions) for x in (F.percentile_approx(F.col("full")[d], OUTER, 20_000), F.min(F.col("full")[d]), F.max(F.col("full")[d]))]
    row = vectors.agg(*[a.alias(f"a{i}") for i, a in enumerate(ask)]).first()
    if row[1] is None:
        return None
    least, largest = list(row[1::3]), list(row[2::3])
    if max(map(abs, [*least, *largest])) > LARGEST:
        raise ValueError(f"scaled components must lie within {LARGEST}")
    inner = (1 << bits) - 2
    cuts = [list(range(a, b + 2, -(-(b - a + 1) // inner)))[: inner + 1] for a, b in row[0::3]]
    return Cells(cuts, least, largest, bits)


def cluster(
    rows: DataFrame, vector: str = "embedding", row_id: str = "vec_id", dimensions: int = DIMENSIONS, scale: int = SCALE, clusters: int = CLUSTERS,
    rounds: int = ROUNDS, bits: int = BITS,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector."""
    spark = rows.sparkSession
    ints = rows.where(usable(F.col(vector), dimensions)).select(F.col(row_id).cast("bigint").alias("vec_id"), scaled(F.col(vector), scale).alias("full"))
    cells = fit_cells(ints, dimensions, bits)
    if cells is None:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                packed = cells.pack(_matrix(batch["full"], dimensions))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in packed], pa.binary())], names=["row", "vec_id", "full", "cells"])

    numbered = ints.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("full").cast("array<int>").alias("full"))
    stored = materialize(numbered.mapInArrow(approximate, "row bigint, vec_id bigint, full array<int>, cells binary"), "vectors")  # row numbers stay as stored
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = stored.select(key.alias("key"), "full").orderBy("key", "full").limit(clusters).collect()
    centroids, old = np.array([r.full for r in first], dtype=np.int64), None
    sums: dict[tuple[int, int], int] = {}
    for _ in range(rounds):
        if old is None:
            parts = stored.select("full", "cells").mapInArrow(_all_members(cells, centroids), _SUMS_DDL)
        else:
            doubtful = materialize(stored.select("row", "cells").mapInArrow(_doubtful(cells, old, centroids), "row bigint"), "doubtful")
            parts = stored.select("row", "full").join(doubtful, "row", "left_semi").select("full").mapInArrow(_moves(old, centroids), _SUMS_DDL)
        _add(sums, parts)
        old, centroids = centroids, _means(sums, centroids)
    found = materialize(stored.select("vec_id", "full", "cells").mapInArrow(_final(cells, centroids), "vec_id bigint, cluster int, distance bigint"), "clusters")
    inertia = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    total = sum(inertia.values())
    facts = spark.createDataFrame([(k, inertia.get(k, 0), total, digest[k]) for k in range(len(centroids))], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

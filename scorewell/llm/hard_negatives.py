"""Hard negatives by threshold joins over a blocked inverted index.

Anchors are a stated query set; all rows are searched. Rows are stored once as blocks of bounded size, sorted by label, their
dimensions in the order of falling energy. A search asks for all pairs of at least each anchor's threshold. Within a block:

* Index: a row is listed under its leading dimensions only, up to the point from which the norm of its remaining components
  times the largest such norm of an anchor stays below the least threshold. Rows are sorted by that length, so the lists of
  a segment of dimensions are one prefix of a matrix, and a row of little weight is listed nowhere.
* Partial scores grow segment by segment. A pair is dropped once its partial score plus the product of both remaining norms
  is below the anchor's threshold, a row once it has no pair left; when few pairs are left they go on one by one, and
  so do the pairs of rows whose lists have ended.

Positives: the threshold of a round is a share of the usual norms' product; anchors whose window of positives is not full go on
to a lower one, at last to none at all. Negatives: the window of a positive with score p is filled from above, first among
scores of at least 95 percent of p, then 88, then 80. A task keeps only the best few of a window, which is exact; merged
windows are at most tasks x size rows.

Anchor blocks are broadcast while their counted size is below ``BROADCAST_BYTES``. Beyond, both sides are dealt by (anchor
block, slice of the row blocks), so neither a label, an anchor nor a block is a hot key.

Defined results: rows with a NULL label, a NULL vector, or a NULL or non-finite component take no part; missing trailing components
count as zero; a NULL id is no anchor, keeps its label and comes last among equal scores; repeated rows are rows of their own
(another copy of an anchor is one of its other rows); a label with one row gives no positive; a negative positive score
has no window, as 80 p > 100 p; an empty table gives no rows; further columns are ignored. Scores are exact; scaled components
whose scores could leave 62 bits raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import materialize
from .cell_clusters import scaled, usable

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 5
ROW_BLOCK, ANCHOR_BLOCK = 2048, 1024
SEGMENT = 8
BROADCAST_BYTES = 32 << 20
POSITIVE_SHARES = (0.5, 0.35, 0.25, 0.15, None)  # of the product of an anchor's norm and the usual norm; None: no threshold
NEGATIVE_PERCENTS = (95, 88, 80)
FEW_PAIRS = 0.08
NO_ID = np.iinfo(np.int64).max

_BLOCK_DDL = "number bigint, n int, vectors binary, vec_id binary, label binary, row binary"
_BLOCK = pa.schema([("number", pa.int64()), ("n", pa.int32()), *[(name, pa.binary()) for name in ("vectors", "vec_id", "label", "row")]])
_HIT_DDL = "anchor bigint, window int, score bigint, vec_id bigint, row bigint"
_HIT_NAMES = ["anchor", "window", "score", "vec_id", "row"]


class Layout:
    """What tasks must know of all rows: the order of dimensions, the number type, the usual norm."""

    def __init__(self, energy: list[float], largest: int, norm: float) -> None:
        self.order = sorted(range(len(energy)), key=lambda d: (-energy[d], d))
        self.dimensions, self.norm = len(energy), norm
        if largest * largest * max(1, len(energy)) >= 1 << 62:
            raise ValueError("scaled components are too large for exact scores")
        self.kind = np.float64 if largest * largest * max(1, len(energy)) < 1 << 53 else np.int64
        self.starts = list(range(0, self.dimensions, SEGMENT))

    def norms(self, vectors: np.ndarray) -> np.ndarray:
        """Norm of what is left of each row from each segment on; the last column is zero."""
        squares = np.square(vectors.astype(np.float64))
        parts = np.stack([squares[:, s : s + SEGMENT].sum(axis=1) for s in self.starts] + [np.zeros(len(vectors))], axis=1)
        return np.sqrt(parts[:, ::-1].cumsum(axis=1)[:, ::-1]) * (1 + 1e-9)


def pairs_above(layout: Layout, anchors: np.ndarray, rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, exact score) of all pairs whose score is at least the anchor's ``least``."""
    n_segments = len(layout.starts)
    if not (n_segments and len(anchors) and len(rows)):
        a, x = np.nonzero(np.broadcast_to((least <= 0)[:, None], (len(anchors), len(rows))))  # without components all scores are zero
        return a, x, np.zeros(len(a), np.int64)
    left_a, left_x = layout.norms(anchors), layout.norms(rows)
    slack = 1e-9 * left_a[:, 0].max() * left_x[:, 0].max() + 1e-6
    reach = left_x[:, :-1] * left_a[:, :-1].max(axis=0) + slack >= least.min()
    listed = reach.sum(axis=1)  # segments under which a row is listed
    live = np.argsort(-listed, kind="stable")[: int((listed > 0).sum())]
    partial = np.zeros((len(anchors), len(live)), layout.kind)
    loose: list[list] = [[] for _ in range(n_segments + 1)]  # pairs that go on by themselves, by the segment they are at

    def part(columns: np.ndarray, segment: int) -> None:
        """Pairs of these columns of ``partial`` that may still reach the threshold leave the matrix."""
        bound = partial[:, columns] + left_a[:, segment, None] * left_x[live[columns], segment] + slack
        a, x = np.nonzero(bound >= least[:, None])
        loose[segment].append((a, live[columns][x], partial[a, columns[x]]))

    for segment, start in enumerate(layout.starts):
        ended = np.flatnonzero(listed[live] == segment)
        if len(ended):
            part(ended, segment)
            live, partial = live[: len(live) - len(ended)], partial[:, : len(live) - len(ended)]
        if not len(live):
            break
        dims = slice(start, start + SEGMENT)
        partial = partial + anchors[:, dims] @ rows[live, dims].T
        possible = partial + left_a[:, segment + 1, None] * left_x[live, segment + 1] + slack >= least[:, None]
        if possible.mean() < FEW_PAIRS or segment + 1 == n_segments:
            a, x = np.nonzero(possible)
            loose[segment + 1].append((a, live[x], partial[a, x]))
            break
        useful = possible.any(axis=0)
        if useful.mean() < 0.8:
            live, partial = live[useful], partial[:, useful]
    a, x, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, layout.kind)
    for segment in range(n_segments + 1):
        a, x, score = (np.concatenate([p, *[q[i] for q in loose[segment]]]) for i, p in enumerate((a, x, score)))
        if segment < n_segments:
            dims = slice(layout.starts[segment], layout.starts[segment] + SEGMENT)
            score = score + np.einsum("ij,ij->i", anchors[a, dims], rows[x, dims])
            keep = score + left_a[a, segment + 1] * left_x[x, segment + 1] + slack >= least[a]
            a, x, score = a[keep], x[keep], score[keep]
    keep = score >= least[a]
    return a[keep], x[keep], score[keep].astype(np.int64)


def _pack(layout: Layout, batch: pa.RecordBatch, number: int) -> tuple:
    """Rows as one block: vectors in the layout's order, all columns sorted by label."""
    label = batch["label"].to_numpy(zero_copy_only=False).astype(np.int64)
    by = np.argsort(label, kind="stable")
    lists = batch["full"]
    sizes = np.asarray(lists.value_lengths())
    vectors = np.zeros((batch.num_rows, layout.dimensions), np.int64)
    vectors[np.arange(layout.dimensions) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    vectors = vectors[:, layout.order][by]
    vec_id = batch["vec_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
    kind = np.int32 if np.abs(vectors).max(initial=0) < 1 << 31 else np.int64
    blobs = [x.tobytes() for x in (vectors.astype(kind), vec_id[by], label[by], batch["row"].to_numpy(zero_copy_only=False).astype(np.int64)[by])]
    return number, batch.num_rows, *blobs


def _unpack(layout: Layout, n: int, vectors: bytes, *others: bytes) -> list[np.ndarray]:
    kind = np.int32 if n * layout.dimensions * 4 == len(vectors) else np.int64
    return [np.frombuffer(vectors, kind).reshape(n, layout.dimensions).astype(layout.kind), *[np.frombuffer(o, np.int64) for o in others]]


def _best(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray, most: int) -> np.ndarray:
    """Positions of the first ``most`` of each group: high scores first, then small ids, then small rows."""
    order = np.lexsort((row, vec_id, -score, group))
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    return order[rank < most]


def _row_blocks(layout: Layout, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                piece = batch.slice(at, size)
                packed = _pack(layout, piece, piece["row"][0].as_py())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(packed, _BLOCK.types, strict=True)], schema=_BLOCK)

    return run


def _anchor_block(layout: Layout):
    """A group of anchors as one row; ``scores`` holds the scores of an anchor's open windows, -1 for none."""

    def run(group: pa.Table) -> pa.Table:
        batch = group.combine_chunks().to_batches()[0]
        number, n, *blobs = _pack(layout, batch, 0)
        by = np.argsort(batch["label"].to_numpy(zero_copy_only=False).astype(np.int64), kind="stable")
        scores = np.asarray(batch["scores"].flatten().to_numpy(zero_copy_only=False), np.int64).reshape(n, -1)[by]
        columns = [pa.array([batch["block"][0].as_py()], pa.int64()), pa.array([n], pa.int32()), *[pa.array([b], pa.binary()) for b in (*blobs, scores.tobytes())]]
        return pa.table(columns, names=["block", "anchors", "a_vectors", "a_vec_id", "a_label", "a_row", "a_scores"])

    return run


_ANCHOR_DDL = "block bigint, anchors int, a_vectors binary, a_vec_id binary, a_label binary, a_row binary, a_scores binary"


class _Kept:
    """Best hits of a task's windows, trimmed whenever they have doubled."""

    def __init__(self, most: int) -> None:
        self.most, self.parts, self.size, self.limit = most, [], 0, 200_000

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(np.stack([c.astype(np.int64) for c in columns]))
        self.size += self.parts[-1].shape[1]
        if self.size > self.limit:
            self.limit = max(200_000, 2 * self.trim().shape[1])

    def trim(self) -> np.ndarray:
        if not self.parts:
            return np.zeros((5, 0), np.int64)
        merged = np.concatenate(self.parts, axis=1)
        anchor, window, score, vec_id, row = merged
        group = np.unique(np.stack([anchor, window]), axis=1, return_inverse=True)[1].reshape(-1)
        self.parts = [merged[:, _best(group, score, vec_id, row, self.most)]]
        self.size = self.parts[0].shape[1]
        return self.parts[0]

    def batch(self) -> pa.RecordBatch:
        anchor, window, score, vec_id, row = self.trim()
        ids = pa.array(vec_id, mask=vec_id == NO_ID)
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(window, pa.int32()), pa.array(score), ids, pa.array(row)], names=_HIT_NAMES)


def _columns(batch: pa.RecordBatch, i: int, names: list[str]) -> list:
    return [batch[c][i].as_py() for c in names]


def _find_positives(layout: Layout, share: float | None, most: int):
    """Other rows of an anchor's label, label by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept(most)
        for batch in batches:
            for i in range(batch.num_rows):
                x, x_id, x_label, x_row = _unpack(layout, *_columns(batch, i, ["n", "vectors", "vec_id", "label", "row"]))
                a, _, a_label, a_row = _unpack(layout, *_columns(batch, i, ["anchors", "a_vectors", "a_vec_id", "a_label", "a_row"]))
                floor = np.full(len(a), -np.inf) if share is None else share * layout.norm * layout.norms(a)[:, 0]
                for label in np.intersect1d(a_label, x_label):
                    mine, theirs = (slice(*np.searchsorted(c, [label, label + 1])) for c in (a_label, x_label))
                    p, q, score = pairs_above(layout, a[mine], x[theirs], floor[mine])
                    others = a_row[mine][p] != x_row[theirs][q]
                    p, q, score = p[others], q[others], score[others]
                    best = _best(p, score, x_id[theirs][q], x_row[theirs][q], most)
                    p, q, score = p[best], q[best], score[best]
                    kept.add(a_row[mine][p], np.zeros(len(p)), score, x_id[theirs][q], x_row[theirs][q])
        yield kept.batch()

    return run


def _find_negatives(layout: Layout, percent: int, most: int):
    """Rows of other labels in the windows below an anchor's open positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept(most)
        for batch in batches:
            for i in range(batch.num_rows):
                x, x_id, x_label, x_row = _unpack(layout, *_columns(batch, i, ["n", "vectors", "vec_id", "label", "row"]))
                a, _, a_label, a_row, top = _unpack(layout, *_columns(batch, i, ["anchors", "a_vectors", "a_vec_id", "a_label", "a_row", "a_scores"]))
                top = top.reshape(len(a), -1)
                low = -(-top * percent // 100)  # 100 * score >= percent * positive score
                floor = np.where(top < 0, np.iinfo(np.int64).max, low).min(axis=1) * (1 - 1e-12)  # the exact rule follows
                p, q, score = pairs_above(layout, a, x, floor)
                others = a_label[p] != x_label[q]
                p, q, score = p[others], q[others], score[others]
                for window in range(top.shape[1]):
                    inside = np.flatnonzero((top[p, window] >= 0) & (score <= top[p, window]) & (score >= low[p, window]))
                    inside = inside[_best(p[inside], score[inside], x_id[q[inside]], x_row[q[inside]], most)]
                    kept.add(a_row[p[inside]], np.full(len(inside), window), score[inside], x_id[q[inside]], x_row[q[inside]])
        yield kept.batch()

    return run


def search(blocks: DataFrame, n_blocks: int, anchors: DataFrame, n_anchors: int, layout: Layout, find, most: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Best ``most`` hits of each window: every anchor block meets every row block once."""
    groups = max(1, -(-n_anchors // ANCHOR_BLOCK))
    packed = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("block").applyInArrow(_anchor_block(layout), _ANCHOR_DDL)
    spread = blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    if n_anchors * (layout.dimensions + 8) * 8 <= broadcast_bytes:
        met = spread.join(F.broadcast(packed), "block")
    else:
        slices = max(1, min(n_blocks, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        cells = F.col("block"), F.col("slice")
        left = spread.withColumn("slice", F.pmod(F.xxhash64("number"), F.lit(slices))).repartition(groups * slices, *cells)
        right = packed.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint")))).repartition(groups * slices, *cells)
        met = left.join(right, ["block", "slice"])
    wide = ["n", "vectors", "vec_id", "label", "row", *[c.split()[0] for c in _ANCHOR_DDL.split(", ")[1:]]]
    hits = met.select(*wide).mapInArrow(find, _HIT_DDL)
    best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def _layout(rows: DataFrame) -> Layout | None:
    """Energy of each dimension (as many numbers as a vector has), the largest component, the 99th percentile of the norms."""
    square = F.col("full").cast("array<double>")
    norm = F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x * x))
    facts = rows.agg(F.max(F.size("full")).alias("d"), F.max(F.array_max(F.transform("full", F.abs))).alias("m"), F.percentile_approx(norm, 0.99, 1000).alias("n")).first()
    if facts.d is None:
        return None
    energy = rows.agg(*[F.sum(F.coalesce(F.get(square, F.lit(i)), F.lit(0.0)) ** 2).alias(f"e{i}") for i in range(facts.d)]).first() if facts.d else []
    return Layout(list(energy), facts.m or 0, facts.n)


def mine(
    rows: DataFrame, vector: str = "embedding", row_id: str = "vec_id", label: str = "label", scale: int = SCALE, every: int = EVERY,
    positives: int = POSITIVES, negatives: int = NEGATIVES, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors and their positives."""
    spark = rows.sparkSession
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    used = rows.where(F.col(label).isNotNull() & usable(F.col(vector))).select(
        F.col(row_id).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), scaled(F.col(vector), scale).alias("full"),
    )
    layout = _layout(used)
    if layout is None:
        return spark.createDataFrame([], out)
    stored = materialize(used.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "full"), "vectors")  # row numbers stay as stored
    blocks = materialize(stored.mapInArrow(_row_blocks(layout, ROW_BLOCK), _BLOCK_DDL), "blocks")
    n_blocks = blocks.count()
    sizes = stored.groupBy("label").agg(F.count("*").alias("rows_of_label"))
    chosen = stored.where(F.col("vec_id") % every == 0).join(sizes, "label").withColumn("need", F.least(F.col("rows_of_label") - 1, F.lit(positives)))
    left = materialize(chosen.where("need > 0").select("row", "vec_id", "label", "full", "need").withColumn("scores", F.array(F.lit(-1).cast("bigint"))), "anchors")
    anchors, found = left, []
    for share in POSITIVE_SHARES:
        if not (n := left.count()):
            break
        hits = materialize(search(blocks, n_blocks, left, n, layout, _find_positives(layout, share, positives), positives, broadcast_bytes), "positives")
        counts = hits.groupBy("anchor").agg(F.count("*").alias("hits")).withColumnRenamed("anchor", "row")
        full = left.join(counts, "row").where(F.col("hits") >= F.col("need")).select("row")
        found.append(hits.join(full.withColumnRenamed("row", "anchor"), "anchor", "left_semi"))
        left = materialize(left.join(full, "row", "left_anti"), "anchors")
    if not found:
        return spark.createDataFrame([], out)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    slot = (F.col("rank") - 1).cast("int")
    windows = materialize(pairs.where(F.col("score") >= 0).select("anchor", slot.alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "windows")
    opened, done = windows, []
    for percent in NEGATIVE_PERCENTS:
        by_anchor = opened.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "positive_score"))).alias("of"))
        scores = F.array(*[F.coalesce(F.col("of")[F.lit(i)], F.lit(-1).cast("bigint")) for i in range(positives)])
        left = materialize(by_anchor.select(F.col("anchor").alias("row"), scores.alias("scores")).join(anchors.drop("scores"), "row"), "anchors")
        if not (n := left.count()):
            break
        hits = search(blocks, n_blocks, left, n, layout, _find_negatives(layout, percent, negatives), negatives, broadcast_bytes)
        hits = materialize(hits.select("anchor", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), "negatives")
        if percent == NEGATIVE_PERCENTS[-1]:
            done.append(hits.join(opened, ["anchor", "window"]))
            break
        full = hits.groupBy("anchor", "window").agg(F.count("*").alias("hits")).where(F.col("hits") >= negatives).select("anchor", "window")
        closed = opened.join(full, ["anchor", "window"], "left_semi")
        done.append(hits.join(closed, ["anchor", "window"]))
        opened = materialize(opened.join(full, ["anchor", "window"], "left_anti"), "open")
    if not done:
        return spark.createDataFrame([], out)
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return result.join(names, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

"""A candidate index for dense vectors, and the ordered leaders of a similarity graph.

Signs of a vector's products with fixed random directions agree for two vectors with probability 1 - angle / pi each. The first
512 signs are a sketch; further ones are cut into bands, and two vectors are candidates if a whole band agrees. How many
bands there are follows from the threshold and the wanted recall, how wide they are from the number of vectors up to a limit,
so that a vector is shuffled a bounded number of times at every size. Only numbers and sketches meet in the buckets; a pair goes
on if its sketches differ little enough for the threshold, and is then verified on the vectors. Vectors that are hardly longer
than a sketch meet themselves: pairs are verified where they meet, and only true ones leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import materialize
from ..functions.vectors import dot

SKETCH_BITS = 512
FIRST_WORDS = 2  # 64-bit words of two sketches that are compared first
RECALL = 0.999  # wanted for pairs exactly at the threshold; pairs above it are safer
BUCKET = 32  # vectors of other directions that may share a bucket by chance
PLAN_VECTORS = 1 << 16  # the index of a larger table has the bands of this many vectors
GROUP = 1 << 16  # rows of buckets that are compared in one group
HOT_BUCKET = 8192  # larger buckets are met slice by slice
SHORT = 32  # components up to which vectors meet instead of their sketches
TAGGED_BANDS = 64  # up to so many bands a short vector brings all its bucket numbers
PRODUCTS = 1 << 22  # similarities that a task holds at a time
SKETCH_SIGMAS = 5.0
MIN_ANGLE = 0.05  # thresholds next to 1 are indexed as if a little lower
SEED = 20_260


def band_plan(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(bands, bits per band) for ``n`` vectors."""
    agree = 1 - max(MIN_ANGLE, math.acos(max(-1.0, min(1.0, threshold)))) / math.pi
    bits = max(4, min(48, math.ceil(math.log2(max(2, n) / BUCKET))))
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-(agree**bits)))), bits


def sketch_limit(threshold: float, signs: int = SKETCH_BITS) -> int:
    """Signs of two sketches that may differ at the threshold, five standard deviations up."""
    p = max(MIN_ANGLE, math.acos(max(-1.0, min(1.0, threshold)))) / math.pi
    return math.ceil(signs * p + SKETCH_SIGMAS * math.sqrt(signs * p * (1 - p)))


def _directions(count: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((count, dimensions), dtype=np.float32)


def index_plan(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(bands, bits per band) of the index: those of at most ``PLAN_VECTORS`` vectors, so a vector has no more buckets in a
    larger table; its buckets are fuller then, which costs comparisons inside a task but no shuffled bytes."""
    return band_plan(min(n, PLAN_VECTORS), threshold, recall)


def sign_keys(vectors: DataFrame, threshold: float, n: int, recall: float = RECALL, whole: bool = False) -> DataFrame:
    """(rep, sketch, keys): a sketch of ``SKETCH_BITS`` signs and a bucket number per band; zero vectors have none.

    ``whole``: (rep, n_copies, u, tags, keys), the vector in place of its sketch, and its numbers within the bands as ``tags``
    unless there are too many bands for that.
    """
    bands, bits = index_plan(n, threshold, recall)
    step = max(1, (1 << 20) // bits)  # directions are applied in parts of about a million numbers per vector block

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch["u"]
            sizes = np.asarray(lists.value_lengths())
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            for d in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == d)
                x = flat[(ends[rows, None] - d) + np.arange(d)].astype(np.float32)
                rows, x = rows[np.abs(x).max(axis=1) > 0], x[np.abs(x).max(axis=1) > 0]
                if not len(rows):
                    continue
                if d not in grid:
                    grid[d] = _directions(SKETCH_BITS + bands * bits, d).T
                per = max(1, step // max(1, len(rows)))
                keys = np.empty((len(rows), bands), np.int64)
                for first in range(0, bands, per):
                    last = min(bands, first + per)
                    signs = x @ grid[d][:, SKETCH_BITS + first * bits : SKETCH_BITS + last * bits] > 0
                    numbers = signs.reshape(len(rows), last - first, bits) @ (1 << np.arange(bits, dtype=np.int64))
                    keys[:, first:last] = numbers + (np.arange(first, last, dtype=np.int64) << bits)
                offsets = pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32))
                cells = {c: batch[c].take(pa.array(rows)) for c in carried}
                if whole:
                    tags = (keys & ((1 << bits) - 1)).astype(np.uint16) if bands <= TAGGED_BANDS else keys[:, :0].astype(np.uint16)
                    cells["tags"] = pa.array([x.tobytes() for x in tags], pa.binary())
                else:
                    cells["sketch"] = pa.array([x.tobytes() for x in np.packbits(x @ grid[d][:, :SKETCH_BITS] > 0, axis=1)], pa.binary())
                cells["keys"] = pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_pydict(cells)

    carried = ["rep", "n_copies", "u"] if whole else ["rep"]
    schema = "rep bigint, n_copies bigint, u array<double>, tags binary, keys array<bigint>" if whole else "rep bigint, sketch binary, keys array<bigint>"
    return vectors.select(*dict.fromkeys([*carried, "u"])).mapInArrow(sign, schema)


def _close(x: np.ndarray, y: np.ndarray, threshold: float, once: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Positions of sketches (columns of 64-bit words) of both sides that differ little enough; few words drop most pairs first.

    ``once``: both sides are the same, and a pair is met in one order only (or twice).
    """
    first, whole = sketch_limit(threshold, 64 * FIRST_WORDS), sketch_limit(threshold)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    per = max(1, min(64, (1 << 20) // max(1, y.shape[1])))
    for at in range(0, x.shape[1], per):
        part, base = x[:, at : at + per], at if once else 0
        rest = y[:, base:]
        differing = np.bitwise_count(part[0][:, None] ^ rest[0])
        for w in range(1, FIRST_WORDS):
            differing += np.bitwise_count(part[w][:, None] ^ rest[w])
        i, j = np.divmod(np.flatnonzero(differing <= first), rest.shape[1])
        near = np.bitwise_count(part[:, i] ^ rest[:, j]).sum(axis=0, dtype=np.int64) <= whole
        found.append((i[near] + at, j[near] + base))
    return tuple(np.concatenate(side) for side in zip(*found, strict=True))


def _dealt(signed: DataFrame, n: int, bits: int, *columns: str) -> DataFrame:
    """``key, slice`` and ``columns`` of signed vectors, a row per band, with the group (``box, low, high``) they meet in.

    A vector enters the shuffle once per band. Neighbouring buckets share a group, in which vectors are compared bucket by
    bucket; a bucket above ``HOT_BUCKET`` is cut into slices, and each two slices meet in a group of their own. There are at
    most bands * 2^bits buckets, bounded by the plan, so the list of large ones is broadcast.
    """
    shift = max(0, min(bits, bits - math.ceil(math.log2(max(1, n) / GROUP))))  # buckets of a group, as a power of two
    keyed = signed.select(*columns, F.explode("keys").alias("key"))
    hot = signed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > HOT_BUCKET)
    hot = materialize(hot.select("key", F.ceil(F.col("m") / HOT_BUCKET).cast("int").alias("n_slices")), "hot")
    dealt = keyed.join(F.broadcast(hot), "key", "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64("rep"), F.col("n_slices")).cast("int"), F.lit(0)))
    others = F.when(F.col("n_slices").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("n_slices") - 1))
    return dealt.withColumn("other", F.explode(others)).select(
        F.when(F.col("other") < 0, F.shiftright("key", shift)).otherwise(F.col("key")).alias("box"),
        F.when(F.col("other") < 0, -1).otherwise(F.least("slice", "other")).alias("low"),
        F.when(F.col("other") < 0, -1).otherwise(F.greatest("slice", "other")).alias("high"),
        "key", "slice", *columns,
    )


def _meetings(key: np.ndarray, part: np.ndarray, sliced: bool) -> Iterator[tuple[slice, slice]]:
    """Both sides of every comparison of a group whose rows are in order of key and slice."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
        if e - s < 2:
            continue
        cut = s + int(np.searchsorted(part[s:e], part[s], side="right"))  # two slices meet each other, one meets itself
        yield (slice(s, cut), slice(cut, e)) if sliced and cut < e else (slice(s, e), slice(s, e))


def candidates(vectors: DataFrame, threshold: float, n: int, recall: float = RECALL) -> DataFrame:
    """Distinct ``a < b`` that share a band and whose sketches are close enough."""
    _, bits = index_plan(n, threshold, recall)
    dealt = _dealt(materialize(sign_keys(vectors, threshold, n, recall), "bands"), n, bits, "rep", "sketch")

    def meet(table: pa.Table) -> pa.Table:
        key, part, rep = (table[c].to_numpy() for c in ("key", "slice", "rep"))
        words = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(key), -1)
        order = np.lexsort((part, key))
        key, part, rep, words, sliced = key[order], part[order], rep[order], np.ascontiguousarray(words[order].T), table["low"][0].as_py() >= 0
        found = [np.empty((0, 2), np.int64)]
        for left, right in _meetings(key, part, sliced):
            i, j = _close(words[:, left], words[:, right], threshold, left == right)
            a, b = rep[left][i], rep[right][j]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b])
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.groupBy("box", "low", "high").applyInArrow(meet, "a bigint, b bigint").distinct()


def short_pairs(vectors: DataFrame, threshold: float, n: int, recall: float = RECALL) -> DataFrame:
    """(a, b, similarity, n_a, n_b) of short vectors that share a band and are similar enough, verified where they meet.

    A pair that shares several bands is told by the first of them; with too many bands for that, pairs are made distinct.
    """
    bands, bits = index_plan(n, threshold, recall)
    signed = materialize(sign_keys(vectors, threshold, n, recall, whole=True), "bands")
    dealt = _dealt(signed, n, bits, "rep", "n_copies", "u", "tags").withColumn("d", F.size("u"))
    tagged = bands <= TAGGED_BANDS

    def meet(table: pa.Table) -> pa.Table:
        size, d, sliced = table.num_rows, table["d"][0].as_py(), table["low"][0].as_py() >= 0
        order = np.lexsort((table["slice"].to_numpy(), table["key"].to_numpy()))
        key, part, rep, copies = (table[c].to_numpy()[order] for c in ("key", "slice", "rep", "n_copies"))
        u = table["u"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(size, d)[order]
        tags = np.frombuffer(b"".join(table["tags"].to_pylist()), np.uint16).reshape(size, -1)[order]
        found = [(np.empty(0, np.int64),) * 2 + (np.empty(0),)]
        for left, right in _meetings(key, part, sliced):
            band = int(key[left.start] >> bits) if tagged else 0
            per = max(1, PRODUCTS // (right.stop - right.start))
            for at in range(left.start, left.stop, per):
                rest = max(right.start, at + 1) if left == right else right.start
                i, j = np.nonzero(u[at : min(at + per, left.stop)] @ u[rest : right.stop].T >= threshold - 1e-9)
                i, j = i + at, j + rest
                if left == right:
                    i, j = i[i < j], j[i < j]
                first = ~(tags[i, :band] == tags[j, :band]).any(axis=1)
                i, j = i[first], j[first]
                near = np.zeros(len(i))
                for x in range(d):  # added up in the order of ``dot``
                    near += u[i, x] * u[j, x]
                found.append((i[near >= threshold], j[near >= threshold], near[near >= threshold]))
        i, j, near = (np.concatenate(side) for side in zip(*found, strict=True))
        turned = rep[i] > rep[j]
        a, b = np.where(turned, j, i), np.where(turned, i, j)
        return pa.table({"a": rep[a], "b": rep[b], "similarity": near, "n_a": copies[a], "n_b": copies[b]})

    pairs = dealt.groupBy("d", "box", "low", "high").applyInArrow(meet, "a bigint, b bigint, similarity double, n_a bigint, n_b bigint")
    return pairs if tagged else pairs.dropDuplicates(["a", "b"])


def indexed_pairs(vectors: DataFrame, threshold: float, recall: float = RECALL) -> DataFrame:
    """(a, b, similarity, n_a, n_b) of unit vectors ``rep, n_copies, u`` at or above ``threshold``, found by the index."""
    short = F.size("u") <= SHORT
    sizes = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(short).alias("short")).first()
    near = short_pairs(vectors.filter(short), threshold, sizes["n"], recall) if sizes["short"] else None
    if sizes["short"] == sizes["n"] > 0:
        return near
    longer = vectors.filter(~short)  # vectors of different lengths are not similar
    found = candidates(longer, threshold, sizes["n"], recall)
    side = lambda s: longer.select(F.col("rep").alias(s), F.col("u").alias(f"u_{s}"), F.col("n_copies").alias(f"n_{s}"))
    both = found.join(side("a"), "a").join(side("b"), "b").withColumn("similarity", dot(F.col("u_a"), F.col("u_b")))
    far = both.filter(F.col("similarity") >= threshold).select("a", "b", "similarity", "n_a", "n_b")
    return far if near is None else far.unionByName(near)


def ordered_leaders(edges: DataFrame) -> DataFrame:
    """(code, leader) of every node that an earlier leader stands for; ``edges`` are ``a < b``.

    The leaders are those of a scan in order: a node leads unless an earlier leader is its neighbour. In a round all nodes
    lead that have no earlier undecided neighbour; their neighbours follow, and the edges of decided nodes go. When no edge
    is left, every node without a leader before it leads, and a follower belongs to its earliest leading neighbour. Rounds
    are joins on the edge list; their number is that of the longest chain of decisions, about log n for unordered data.
    """
    edges = materialize(edges.select("a", "b").distinct(), "edges")
    open_edges, followers = edges, None
    while open_edges.limit(1).count():
        heads = open_edges.select("a").distinct().join(open_edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = materialize(open_edges.join(heads, "a").select(F.col("b").alias("code")).distinct(), "followers")
        followers = gone if followers is None else followers.unionByName(gone)
        left = open_edges.join(heads, "a", "left_anti").join(gone.withColumnRenamed("code", "a"), "a", "left_anti")
        open_edges = materialize(left.join(gone.withColumnRenamed("code", "b"), "b", "left_anti").select("a", "b"), "edges")
    if followers is None:
        return edges.select(F.col("b").alias("code"), F.col("a").alias("leader"))
    led = edges.join(followers.withColumnRenamed("code", "a"), "a", "left_anti")  # edges whose earlier end leads
    return led.groupBy(F.col("b").alias("code")).agg(F.min("a").alias("leader"))

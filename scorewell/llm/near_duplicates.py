"""Near duplicates by MinHash signatures and a multi-index Hamming join, confirmed on the full shingle sets.

Signatures of ``SYMBOLS`` symbols of 16 bits are cut into ``CHUNKS`` chunks. Two signatures that differ in at most
``2 * CHUNKS - 1`` symbols have a chunk with at most one error, and every chunk is indexed once per place of that error, so
such a pair always shares a key (pigeonhole). A pair at 85 (80) percent fails all chunks with a chance of 5e-7 (2e-5).
A second signature of ``SKETCH`` bytes drops pairs that differ by five standard deviations more than pairs at the threshold
do on average (chance for a true pair: some 3e-6); what remains is decided on the exact sets of 64-bit shingle hashes.

Equal sets are one class from the start. Pairs within a key's bucket are never listed whole: first every member meets the
bucket's smallest member (its leader) only; then the members of all buckets of one leader that still hold several components
are compared in pairs of blocks, where pairs across components that pass the sketch are decided on the spot and only links
between components leave the task. A block is bounded; sets travel once per pair of blocks, not once per pair of texts.

Defined results: NULL, empty and blank texts have no shingles, are linked with nothing and are their own component; texts
of one or two words are one shingle; repeated rows share a component; a NULL id never names a component unless no other id
is there; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize

SYMBOLS, CHUNKS = 40, 8
CHUNK = SYMBOLS // CHUNKS
SKETCH = 256
BLOCK = 512
SET_BLOCK = 256
MEMO_ENTRIES = 400_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_MULTIPLIERS = np.random.default_rng(20240607).integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[word] = value
        return value


_HASH = _WordHash()


def shingles(text: str | None, size: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; the whole text is one shingle if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([_HASH[w] for w in words], dtype=np.uint64)
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = (out ^ h[i : len(h) - size + 1 + i]) * _A
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Smallest value of ``SKETCH`` multiplicative permutations, mixed so that any bits of it can serve as a symbol."""
    low = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    step = max(1, (1 << 17) // SKETCH)
    for i in range(0, len(hashes), step):
        np.minimum(low, (_MULTIPLIERS[:, None] * hashes[None, i : i + step]).min(axis=1), out=low)
    low = (low ^ (low >> np.uint64(32))) * _B
    return low ^ (low >> np.uint64(29))


def index_keys(symbols: np.ndarray) -> np.ndarray:
    """Per row of symbols the keys of all (chunk, place of the error) combinations."""
    n = len(symbols)
    out = np.empty((n, SYMBOLS), dtype=np.uint64)
    for chunk in range(CHUNKS):
        places = range(chunk * CHUNK, (chunk + 1) * CHUNK)
        for error in places:
            key = np.full(n, error + 1, dtype=np.uint64)
            for place in places:
                if place != error:
                    key = (key ^ symbols[:, place].astype(np.uint64)) * _C
                    key ^= key >> np.uint64(32)
            out[:, error] = key
    return out.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, symbols, sketches = [], [], [], []
        for text in batch["text"].to_pylist():
            s = shingles(text, size)
            sig = signature(s) if len(s) else None
            counts.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            symbols.append(None if sig is None else (sig[:SYMBOLS] >> np.uint64(8)).astype(np.uint16).tobytes())
            sketches.append(None if sig is None else sig.astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["text_hash"], pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(symbols, pa.binary()), pa.array(sketches, pa.binary())],
            names=["doc_id", "text_hash", "n_shingles", "digest", "symbols", "sketch"],
        )


def _explode_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            table = np.frombuffer(b"".join(part["symbols"].to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            keys = index_keys(table)
            node = np.repeat(np.asarray(part["node"]), SYMBOLS)
            place = np.tile(np.arange(SYMBOLS, dtype=np.int32), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(place), pa.array(node)], names=["key", "place", "node"])


def sketch_errors(percent: int) -> int:
    """Differing sketch bytes that a pair at the threshold exceeds with a chance of some 3e-6."""
    p = (1 - percent / 100) * 255 / 256
    return math.ceil(SKETCH * p + 5 * math.sqrt(SKETCH * p * (1 - p)))


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share ``percent`` of 100 of their union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(long, short)
    shared = int((long[np.minimum(at, len(long) - 1)] == short).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _link_blocks(batches: Iterator[pa.RecordBatch], errors: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (leader, i, j): links between components of a pair of blocks, confirmed on the sets at once.

    Once two components are linked, no further pair between them is looked at, so a block yields fewer links than it has
    components, however many similar pairs it holds.
    """

    def links(rows: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        t = pa.Table.from_batches(rows)
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        node, block = t["node"].to_pylist(), t["block"].to_numpy()
        names = t["comp"].to_pylist()
        number: dict[int, int] = {}
        comp = np.array([number.setdefault(c, len(number)) for c in names], dtype=np.int64)
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
        cells = [np.frombuffer(c, np.uint64) for c in t["cells"].to_pylist()]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = []
        for k, x in enumerate(left.tolist()):
            other = right[k + 1 :] if i == j else right
            other = other[comp[other] != comp[x]]
            if not len(other):
                continue
            far = (sketch[other] != sketch[x][None, :]).sum(axis=1)
            order = np.argsort(far, kind="stable")
            for y in other[order[far[order] <= errors]].tolist():
                if comp[y] != comp[x] and _similar(cells[x], cells[y], percent):
                    found.append((min(node[x], node[y]), max(node[x], node[y])))
                    comp[comp == comp[y]] = comp[x]
        return found

    held: list[pa.RecordBatch] = []
    now = None
    for batch in _with_end(batches):
        marks = [] if batch is None else list(zip(batch["leader"].to_pylist(), batch["i"].to_pylist(), batch["j"].to_pylist(), strict=True))
        changes = [at for at in range(len(marks)) if marks[at] != (marks[at - 1] if at else now)]
        for start, end in zip([0, *changes], [*changes, len(marks)], strict=True):
            if end > start:
                held.append(batch.slice(start, end - start))
            if held and (batch is None or end < len(marks)):
                out = links(held)
                held = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
        if marks:
            now = marks[-1]


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _sets_of(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, cells = [], []
            for node, digest, text in zip(batch["node"].to_pylist(), batch["digest"].to_pylist(), batch["text"].to_pylist(), strict=True):
                s = shingles(text, size).tobytes()
                if hashlib.blake2b(s, digest_size=16).digest() == digest:
                    nodes.append(node)
                    cells.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(cells, pa.binary())], names=["node", "cells"])

    return sets


def _confirm(percent: int):
    def confirm(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        cells = {n: np.frombuffer(c, np.uint64) for n, c in zip(sets["node"].to_pylist(), sets["cells"].to_pylist(), strict=True)}
        good = [(x, y) for x, y in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True) if _similar(cells[x], cells[y], percent)]
        return pa.table({"a": pa.array([x for x, _ in good], pa.int64()), "b": pa.array([y for _, y in good], pa.int64())})

    return confirm


def sets_of(nodes: DataFrame, classes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(node, cells): the full shingle sets of some classes, from the texts that named them."""
    wanted = nodes.join(classes.select("node", F.col("doc_id").alias("first_id"), "digest"), "node")
    met = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["first_id"])).select("node", "digest", "text")
    return materialize(met.mapInArrow(_sets_of(size), "node bigint, cells binary").dropDuplicates(["node"]), "near-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; pairs with the same ``a`` meet in blocks of some ``SET_BLOCK``."""
    sizes = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / SET_BLOCK).alias("blocks")), "near-sizes")
    n_small = max(1, sizes.count() // 64)
    small = F.concat(F.lit("s"), F.pmod(F.xxhash64("a"), F.lit(n_small)).cast("string"))
    group = F.when(F.col("blocks") == 1, small).otherwise(F.concat_ws("-", "a", F.pmod(F.xxhash64("b"), F.col("blocks"))))
    dealt = materialize(pairs.join(sizes, "a").select("a", "b", group.alias("group")), "near-pairs")
    cell = F.col("group").alias("cell")
    needs = dealt.select(F.col("a").alias("node"), cell).unionAll(dealt.select(F.col("b").alias("node"), cell)).distinct()
    return dealt.groupBy("group").cogroup(needs.join(sets, "node").groupBy("cell")).applyInArrow(_confirm(percent), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node, the label being the smallest node it reaches: smallest labels and pointer jumps."""
    edges = materialize(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "near-labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = materialize(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "near-labels")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = materialize(lower.join(jump, "label").select("node", "old", F.least("label", "far").alias("label")), "near-labels")
        changed = new.filter(F.col("old") != F.col("label")).limit(1).count()
        labels = new.drop("old")
        if not changed:
            return labels


def link_classes(classes: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """(node, label) of classes that are linked with another class."""
    keys = classes.select("node", "symbols").mapInArrow(_explode_keys, "key bigint, place int, node bigint")
    leaders = materialize(keys.groupBy("key", "place").agg(F.count("*").alias("n"), F.min("node").alias("leader")).filter("n > 1"), "near-leaders")
    buckets = materialize(keys.join(leaders, ["key", "place"]), "near-buckets")
    sketches, errors = classes.select("node", "sketch"), sketch_errors(percent)
    star = buckets.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    star = star.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b")), "b")

    @F.arrow_udf("boolean")
    def close(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, SKETCH) for c in (a, b))
        return pa.array((x != y).sum(axis=1) <= errors)

    star = materialize(star.filter(close("sketch_a", "sketch_b")).select("a", "b"), "near-star")
    ends = star.select(F.col("a").alias("node")).unionAll(star.select(F.col("b").alias("node"))).distinct()
    links = materialize(confirmed(star, sets_of(ends, classes, texts, size), percent), "near-links")
    labels = components(links)
    # what the first members have left open: pairs of other members, across components, of the buckets with one leader
    members = buckets.filter("n > 2 AND node != leader").select("leader", "node").distinct()
    mixed = materialize(members.join(labels, "node", "left").select("leader", "node", F.coalesce("label", "node").alias("comp")), "near-mixed")
    several = mixed.groupBy("leader").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    several = materialize(several.select("leader", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "near-several")
    rows = mixed.join(several, "leader").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = materialize(rows, "near-open")
    sets = sets_of(rows.select("node").distinct(), classes, texts, size)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("leader", "node", "comp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = rows.join(sketches, "node").join(sets, "node").repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j", "node")
    late = materialize(rows.mapInArrow(lambda batches: _link_blocks(batches, errors, percent), "a bigint, b bigint"), "near-links")
    return components(links.unionAll(late)) if late.limit(1).count() else labels


def _grouped(docs: DataFrame, percent: int, size: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        lambda batches: _sign(batches, size), "doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, symbols binary, sketch binary"
    )
    signed = materialize(signed, "near-signed")
    classes = signed.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("symbols").alias("symbols"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    labels = link_classes(classes, texts, percent, size)
    named = classes.select("digest", "doc_id", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_class = materialize(named.join(smallest, "label").select("digest", "component_id"), "near-components")
    linked = signed.filter("n_shingles > 0").select("doc_id", "text_hash", "n_shingles", "digest").join(by_class, "digest").drop("digest")
    alone = signed.filter("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def group(docs: DataFrame, percent: int = 85, size: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``: links at ``percent`` of 100 of the union of sets."""
    return _grouped(docs, percent, size).drop("text_hash")


def keep_first(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """One document per component, the one that names it, with all columns of ``docs``; of repeated rows one stays."""
    chosen = _grouped(docs, percent, size).filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_hash").alias("_kept_text")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    packed = docs.select(row, F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("text").alias("_text"))
    met = packed["_id"].eqNullSafe(chosen["_kept_id"]) & (packed["_text"] == chosen["_kept_text"])
    return packed.join(chosen, met, "left_semi").dropDuplicates(["_id", "_text"]).select("row.*")

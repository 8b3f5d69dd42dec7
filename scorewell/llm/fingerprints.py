"""Document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes marks candidate cuts; normalised chunking uses a strict mask before the expected size
and a loose one after it. A fingerprint is the set of chunk digests weighted by chunk length, so inserting or removing
text moves only the chunks it touches. Containment of A in B is the weight of A's chunks that B has, over A's weight.

The edited text of a document needs its successor in descending doc_id: rows are dealt into id ranges, sorted there, and
each range also receives the first row of the next range, so one shuffle of the texts is enough.

Defined results: NULL text is empty and has the empty fingerprint; two empty texts are alike (1.0), an empty and a
non-empty one are not (0.0); NULL ids come last, rows with one id are ordered by text; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import whole_text

# Chunk sizes in bytes: no cut before MIN_SIZE, strict mask up to NORMAL_SIZE, loose mask up to MAX_SIZE, then a forced cut.
MIN_SIZE, NORMAL_SIZE, MAX_SIZE = 16, 48, 192
STRICT_MASK, LOOSE_MASK = np.uint32(0x7F << 20), np.uint32(0x0F << 20)
SEED = 20250101

SCHEMA_DDL = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def gear_table() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """Rolling gear hash of the last 16 bytes at every position, by doubling the window four times."""
    h = gear[data]
    for width in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint32(width)
        h = h + shifted
    return h


def chunk_ends(data: bytes, gear: np.ndarray) -> list[int]:
    """End offsets of the chunks; the last one is the length of the data."""
    n = len(data)
    if n <= MIN_SIZE:
        return [n] if n else []
    h = gear_hashes(np.frombuffer(data, np.uint8), gear)
    loose = np.flatnonzero((h & LOOSE_MASK) == 0) + 1
    strict = ((h[loose - 1] & STRICT_MASK) == 0).tolist()
    loose = loose.tolist()
    ends, start = [], 0
    for i, cut in enumerate(loose):
        while cut - start > MAX_SIZE:
            start += MAX_SIZE
            ends.append(start)
        size = cut - start
        if size >= MIN_SIZE and (strict[i] or size >= NORMAL_SIZE):
            ends.append(cut)
            start = cut
    while n - start > MAX_SIZE:
        start += MAX_SIZE
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def fingerprint(text: str, gear: np.ndarray) -> dict[str, int]:
    """Chunk digest -> chunk length."""
    data = text.encode("utf-8", "surrogatepass")
    out, start, digest = {}, 0, hashlib.blake2b
    for end in chunk_ends(data, gear):
        out[digest(data[start:end], digest_size=6).hexdigest()] = end - start
        start = end
    return out


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    if not a or not b:
        return float(not a and not b)
    return sum(w for k, w in a.items() if k in b) / sum(a.values())


def encoded(f: dict[str, int]) -> str:
    return ",".join([f"{k}:{w:x}" for k, w in sorted(f.items())])


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by range and place; each is finished once the next of its range is known."""
    gear = gear_table()
    held = None  # (bucket, guard, doc_id, text, fingerprint)
    for batch in batches:
        out = []
        for bucket, guard, doc_id, text in zip(*[batch[c].to_pylist() for c in ("bucket", "guard", "doc_id", "text")], strict=True):
            if held is not None and held[1] and guard and held[0] == bucket:
                continue  # only the first guard row of a range counts
            mine = fingerprint(text, gear)
            if held is not None and not held[1] and held[0] == bucket:
                changed = edited_text(held[3], text)
                prints = fingerprint(changed, gear)
                out.append((
                    held[2], len(held[3]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), encoded(held[4]), encoded(prints),
                    containment(held[4], prints), containment(held[4], mine),
                ))
            held = (bucket, guard, doc_id, text, mine)
        columns = zip(*out, strict=True) if out else [[] for _ in SCHEMA]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, SCHEMA.types, strict=True)], schema=SCHEMA)


def fingerprints(docs: DataFrame, ranges_per_partition: int = 8) -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and their containments (see the module's rules)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = parts * ranges_per_partition
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text("text").alias("text"))
    ids = base.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    rank = _bucket(cuts)("doc_id")
    heads = {r["bucket"]: r["top"] for r in ids.select(rank.alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(heads)
    guards = [(order[i - 1], heads[b]) for i, b in enumerate(order)]  # the last range is followed by the first
    table = spark.createDataFrame([(b, h) for b, h in guards] or [(0, 0)], "bucket int, head bigint")
    dealt = base.select(rank.alias("bucket"), F.lit(False).alias("guard"), "doc_id", "text")
    extra = base.join(F.broadcast(table), base["doc_id"].eqNullSafe(table["head"])).select("bucket", F.lit(True).alias("guard"), "doc_id", "text")
    dealt = dealt.unionAll(extra).repartition(parts, "bucket")
    dealt = dealt.sortWithinPartitions("bucket", "guard", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.mapInArrow(_rows, SCHEMA_DDL)


def _bucket(cuts: list[int]):
    """Range number of an id, counted from the largest ids down; NULL ids are in the last range."""
    edges = np.array(cuts, dtype=np.int64)

    @F.arrow_udf("int")
    def place(ids: pa.Array) -> pa.Array:
        known = np.asarray(ids.is_valid())
        numbers = len(edges) - np.searchsorted(edges, np.asarray(ids.fill_null(0)), side="left")
        return pa.array(np.where(known, numbers, len(edges) + 1).astype(np.int32))

    return place

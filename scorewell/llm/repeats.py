"""Removal of byte strings of ``WINDOW`` bytes that also start in a document with a smaller id.

Equal texts are one text first. Every window of a text picks a minimizer (the q-gram in it with the smallest hash, leftmost
on ties), so equal windows pick equal q-grams. Only q-grams that occur in two different texts matter: hashes travel as packed
sorted arrays, one per unit of texts and hash range, and come back as the shared ones. For each shared minimizer the bytes
of its windows go, by that q-gram, to a task that sorts them as suffixes with bucket-pointer refinement: initial buckets by
eight bytes, refined by sorting on the bucket pointers of later offsets, where every refinement reuses the pointers the one
before has written (depths 8, 16, 32, 50). Windows that end in one bucket are equal; the smallest id in a bucket decides.

Scale: the texts are shuffled once, into a table bucketed by unit (a bounded number of buckets, each with as many units as it
takes) that later passes read in place; a unit, a hash range and a suffix chunk are bounded, and hashes go from units to
ranges and back in passes with a bounded fan-out. A shared q-gram with more than ``HOT_ROWS`` places, in one text or in many, leaves the suffix
path: the distinct windows of each text become rows with 128-bit digests, whose smallest ids are a map-side combined
aggregation joined back, so neither a line that a third of all documents hold nor a long text of short period is a group.

Defined results: NULL text is empty; texts under ``WINDOW`` bytes lose nothing; repeated rows with one id keep their text
(no id is smaller); a NULL id comes after all others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import arrow_rows, give_back, materialize, partitions_for, text_bytes, whole_text

WINDOW = 50
GRAM = 16
SPAN = WINDOW - GRAM + 1  # q-grams per window
HOT_ROWS = 50_000  # places; under LAST_COUNT, which a unit's count stops at
LAST_COUNT = (1 << 16) - 1
CHUNK_ROWS = 20_000
BATCH_ROWS = 1_000
UNIT_BYTES = 8 << 20
RANGE_BYTES = 8 << 20  # of text: the hashes of so much text, spread over all units, are one range
FAN = 512  # pieces that a row of hashes is cut into at once, at most
MAX_BUCKETS = 20_000  # of the table of texts; Spark allows 100,000
LAST_ID = (1 << 63) - 1
_POSITION_BITS = 26
_POSITION_MASK = np.uint64((1 << _POSITION_BITS) - 1)
_M = np.uint64(0x9E3779B97F4A7C15)
_SHORT = np.uint64((1 << 48) - 1)
_P = [np.uint64(pow(0xD6E8FEB86659FD93, 1 << i, 1 << 64)) for i in range(4)]
SEGMENT_DDL = "h bigint, unit int, ord int, doc_id bigint, start int, bytes binary"
FLAG_DDL = "unit int, ord int, start int, length int"


def _lean_pair(fn):
    """A function of two groups after which the worker gives its freed memory back."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = fn(left, right)
        give_back()
        return out

    return run


# ---------------------------------------------------------------- minimizers


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of every 16-byte gram."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _M
    h ^= h >> np.uint64(29)
    for i, width in enumerate((1, 2, 4, 8)):
        h = h[:-width] * _P[i] + h[width:]
    h = (h ^ (h >> np.uint64(32))) * _M
    return h ^ (h >> np.uint64(29))


def minimizers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of each run of windows that share a minimizer."""
    none = np.empty(0, np.int64)
    if len(data) < WINDOW:
        return np.empty(0, np.uint64), none, none
    limit = 1 << (_POSITION_BITS - 1)
    if len(data) - WINDOW + 1 > limit:  # longer texts in slices that share WINDOW - 1 bytes
        parts = [(a, *minimizers(data[a : a + limit + WINDOW - 1])) for a in range(0, len(data) - WINDOW + 1, limit)]
        return np.concatenate([p[1] for p in parts]), np.concatenate([p[2] + p[0] for p in parts]), np.concatenate([p[3] + p[0] for p in parts])
    h = gram_hashes(data)
    low = (h & ~_POSITION_MASK) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if rest := SPAN - width:
        low = np.minimum(low[:-rest], low[rest:])
    place = (low & _POSITION_MASK).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return h[place[first]], first, np.r_[first[1:], len(place)] - 1


# ---------------------------------------------------------------- shared q-grams


def _short(h: np.ndarray) -> np.ndarray:
    """48 bits of a hash, mixed again one to one: minimizers are small hashes, but ranges of these hold equally many."""
    x = h >> np.uint64(16)
    for _ in range(2):
        x = (x * _M) & _SHORT
        x ^= x >> np.uint64(23)
    return x


def _packed(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(cell: bytes) -> np.ndarray:
    raw = np.frombuffer(cell, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").reshape(-1)


def range_of(h: np.ndarray, n_ranges: int) -> np.ndarray:
    return (((h >> np.uint64(16)) * np.uint64(n_ranges)) >> np.uint64(32)).astype(np.int64)


def fan_levels(n: int) -> int:
    """Passes over packed hashes in which no row falls into more than ``FAN`` pieces."""
    return max(1, math.ceil(math.log(max(n, 2)) / math.log(FAN) - 1e-9))


def fan_out(n: int) -> int:
    """Pieces of a row in each of these passes: as even as they go, so that between two passes there are some ``n`` groups, too."""
    levels = fan_levels(n)
    fan = max(2, round(n ** (1 / levels)) - 1)
    while fan**levels < n:
        fan += 1
    return fan


class _Grams:
    """Packed q-grams: unit, hash, and two small numbers each (before the merge texts and places, after it a flag)."""

    NAMES = ("range", "family", "units", "sizes", "grams", "texts", "places")
    DDL = "range bigint, family bigint, units binary, sizes binary, grams binary, texts binary, places binary"
    TYPES = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())

    @staticmethod
    def read(group) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        flat = lambda name, kind: np.frombuffer(b"".join(group[name].to_pylist()), kind)
        return np.repeat(flat("units", "<i4"), flat("sizes", "<i4")), _unpacked(b"".join(group["grams"].to_pylist())), flat("texts", np.uint8), flat("places", "<u2")

    @classmethod
    def rows(cls, range_: np.ndarray, family: np.ndarray, unit: np.ndarray, h: np.ndarray, texts: np.ndarray, places: np.ndarray) -> pa.Table:
        """A row per (range, family), its entries by unit."""
        order = np.lexsort((unit, family, range_))
        range_, family, unit, h, texts, places = (x[order] for x in (range_, family, unit, h, texts, places))
        out = []
        ends = np.flatnonzero(np.r_[(range_[1:] != range_[:-1]) | (family[1:] != family[:-1]), True]) + 1 if len(h) else []
        at = 0
        for end in ends:
            mine = unit[at:end]
            first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
            sizes = np.diff(np.r_[first, len(mine)])
            out.append((
                int(range_[at]), int(family[at]), mine[first].astype("<i4").tobytes(), sizes.astype("<i4").tobytes(), _packed(h[at:end]),
                texts[at:end].astype(np.uint8).tobytes(), places[at:end].astype("<u2").tobytes(),
            ))
            at = end
        columns = zip(*out, strict=True) if out else ([] for _ in cls.NAMES)
        return pa.table({k: pa.array(list(c), t) for k, c, t in zip(cls.NAMES, columns, cls.TYPES, strict=True)})


def _gram_blobs(n_ranges: int, stride: int):
    def rows(unit: int, found: list[np.ndarray]) -> pa.RecordBatch:
        h, at, texts = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True, return_counts=True)
        places = np.bincount(at, weights=np.concatenate([n for _, n in found]), minlength=len(h))
        same = np.full(len(h), unit)
        table = _Grams.rows(range_of(h, n_ranges) // stride, same, same, h, np.minimum(texts, 2), np.minimum(places, LAST_COUNT))
        return table.combine_chunks().to_batches()[0]

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, []
        for batch in batches:
            for unit, text in zip(batch["unit"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if unit != now and found:
                    yield rows(now, found)
                    found = []
                now = unit
                h = minimizers(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))[0]
                if len(h):
                    found.append(np.unique(_short(h), return_counts=True))
        if found:
            yield rows(now, found)

    return blobs


def _to_ranges(n_ranges: int, stride: int):
    """A family's part of a wide range, cut into its narrower ranges."""

    def cut(group: pa.Table) -> pa.Table:
        unit, h, texts, places = _Grams.read(group)
        return _Grams.rows(range_of(h, n_ranges) // stride, np.full(len(h), group["family"][0].as_py()), unit, h, texts, places)

    return cut


def _to_families(stride: int):
    """A wide family's part of several ranges, cut into its narrower families."""

    def cut(group: pa.Table) -> pa.Table:
        unit, h, texts, places = _Grams.read(group)
        return _Grams.rows(np.full(len(h), group["range"][0].as_py()), unit.astype(np.int64) // stride, unit, h, texts, places)

    return cut


def _shared_grams(hot_rows: int, stride: int):
    """Of a range's q-grams those of two texts or more, by family of units; ``texts`` is now 1 for hot ones, ``places`` 0."""

    def shared(group: pa.Table) -> pa.Table:
        unit, h, texts, places = _Grams.read(group)
        _, at = np.unique(h, return_inverse=True)
        n_texts, n_places = np.bincount(at, weights=texts)[at], np.bincount(at, weights=places)[at]
        keep = n_texts > 1
        unit, h, hot = unit[keep], h[keep], (n_places > hot_rows)[keep]
        return _Grams.rows(np.full(len(h), group["range"][0].as_py()), unit.astype(np.int64) // stride, unit, h, hot, np.zeros(len(h)))

    return shared


def shared_grams(texts: DataFrame, n_units: int, hot_rows: int) -> DataFrame:
    """Rows of ``_Grams`` whose family is one unit: its q-grams that occur in two texts, hot ones marked.

    Units and ranges are met in passes: a row is cut into ``fan`` pieces (``fan_out``), and pieces of ``fan`` units (on the way
    back: ranges) are one group again, so rows stay large and few at every size, and a group holds the hashes of some
    ``RANGE_BYTES`` of text in every pass. Up to ``FAN`` ranges one pass each way does.
    """
    n_ranges = max(1, n_units * UNIT_BYTES // RANGE_BYTES)
    levels, fan = fan_levels(max(n_ranges, n_units)), fan_out(max(n_ranges, n_units))
    blobs = texts.select("unit", "text").mapInArrow(_gram_blobs(n_ranges, fan ** (levels - 1)), _Grams.DDL)
    for level in range(1, levels):
        families = blobs.withColumn("family", F.floor(F.col("family") / fan))
        blobs = families.groupBy("range", "family").applyInArrow(_to_ranges(n_ranges, fan ** (levels - 1 - level)), _Grams.DDL)
    found = blobs.groupBy("range").applyInArrow(_shared_grams(hot_rows, fan ** (levels - 1)), _Grams.DDL)
    for level in range(1, levels):
        ranges = found.withColumn("range", F.floor(F.col("range") / fan))
        found = ranges.groupBy("range", "family").applyInArrow(_to_families(fan ** (levels - 1 - level)), _Grams.DDL)
    return found


# ---------------------------------------------------------------- windows of shared q-grams


def _ordered(texts: pa.Table) -> list[tuple[int, int, bytes, bytes]]:
    """(ord, doc_id, digest, bytes) of a unit's texts; the order by digest and id is the same in every pass."""
    rows = sorted(zip(texts["digest"].to_pylist(), texts["doc_id"].to_pylist(), texts["text"].to_pylist(), strict=True), key=lambda r: (r[0], r[1]))
    return [(i, doc_id, digest, text.encode("utf-8", "surrogatepass")) for i, (digest, doc_id, text) in enumerate(rows)]


def _known(grams: pa.Table, hot: bool) -> np.ndarray:
    if not grams.num_rows:
        return np.empty(0, np.uint64)
    _, h, marked, _ = _Grams.read(grams)
    return np.unique(h[marked.astype(bool) == hot])


def _inside(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _segments(texts: pa.Table, grams: pa.Table) -> pa.Table:
    known, unit = _known(grams, False), texts["unit"][0].as_py() if texts.num_rows else 0
    out_h, out_ord, out_id, out_start, out_bytes = [], [], [], [], []
    for place, doc_id, _, data in _ordered(texts) if len(known) else ():
        h, first, last = minimizers(np.frombuffer(data, np.uint8))
        keep = _inside(_short(h), known)
        n = int(keep.sum())
        if n:
            a, b = first[keep].tolist(), (last[keep] + WINDOW).tolist()
            out_h.append(h[keep].view(np.int64))
            out_ord.append(np.full(n, place, np.int32))
            out_id.append(np.full(n, doc_id, np.int64))
            out_start.append(first[keep].astype(np.int32))
            out_bytes += [data[x:y] for x, y in zip(a, b, strict=True)]
    join = lambda parts, t: pa.array(np.concatenate(parts)) if parts else pa.array([], t)
    h = join(out_h, pa.int64())
    return pa.table({
        "h": h, "unit": pa.array(np.full(len(h), unit, np.int32)), "ord": join(out_ord, pa.int32()), "doc_id": join(out_id, pa.int64()),
        "start": join(out_start, pa.int32()), "bytes": pa.array(out_bytes, pa.binary()),
    })


def _hot_windows(texts: pa.Table, grams: pa.Table) -> pa.Table:
    known, unit = _known(grams, True), texts["unit"][0].as_py() if texts.num_rows else 0
    ords, ids, starts, digests = [], [], [], []
    for place, doc_id, _, data in _ordered(texts) if len(known) else ():
        h, first, last = minimizers(np.frombuffer(data, np.uint8))
        found: dict[bytes, list[int]] = {}
        for k in np.flatnonzero(_inside(_short(h), known)).tolist():
            for at in range(int(first[k]), int(last[k]) + 1):
                found.setdefault(data[at : at + WINDOW], []).append(at)
        ords += [place] * len(found)
        ids += [doc_id] * len(found)
        starts += found.values()
        digests += [hashlib.blake2b(window, digest_size=16).digest() for window in found]
    return pa.table({
        "unit": pa.array([unit] * len(ords), pa.int32()), "ord": pa.array(ords, pa.int32()), "doc_id": pa.array(ids, pa.int64()),
        "starts": pa.array(starts, pa.list_(pa.int32())), "digest": pa.array(digests, pa.binary()),
    })


def _window_runs(late: pa.Table) -> pa.Table:
    """A unit's windows as runs of windows that begin one byte after another."""
    starts = late["starts"].combine_chunks()
    ord_, start = np.repeat(late["ord"].to_numpy(), starts.value_lengths().to_numpy()), starts.flatten().to_numpy()
    order = np.lexsort((start, ord_))
    ord_, start = ord_[order], start[order]
    new = np.flatnonzero(np.r_[True, (ord_[1:] != ord_[:-1]) | (start[1:] != start[:-1] + 1)])
    ends = np.r_[new[1:], len(start)] - 1
    unit = np.full(len(new), late["unit"][0].as_py(), np.int32)
    return pa.table({"unit": unit, "ord": ord_[new], "start": start[new], "length": (start[ends] - start[new] + WINDOW).astype(np.int32)})


# ---------------------------------------------------------------- suffixes


def refine_buckets(data: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Bucket pointer of every suffix, sorted to ``depth`` bytes: suffixes share one if their first bytes are equal.

    A pointer is the place of its bucket's last suffix in the suffix array, so a refined bucket keeps to the range of the old
    one. Suffixes alone in their bucket are final and are not touched again. The data are padded by the caller.
    """
    n = len(data) - 7
    words = np.zeros(n, np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | data[i : i + n]
    order = np.argsort(words, kind="stable")
    pointer = _pointers(order, words[order], np.empty(n, np.int64), np.arange(n))
    active, reached = order, 8
    while reached < depth:
        step = min(reached, depth - reached)
        size = np.bincount(pointer[active], minlength=n)
        active = active[size[pointer[active]] > 1]
        if not len(active):
            break
        later = pointer[np.minimum(active + step, n - 1)]
        by = np.lexsort((later, pointer[active]))
        active, later = active[by], later[by]
        ends = pointer[active]
        starts = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
        sizes = np.diff(np.r_[starts, len(active)])
        places = np.arange(len(active)) - np.repeat(starts, sizes) + np.repeat(ends[starts] - sizes + 1, sizes)
        old = ends.copy()
        new_end = np.r_[(old[1:] != old[:-1]) | (later[1:] != later[:-1]), True]
        last = np.flatnonzero(new_end)
        pointer[active] = np.repeat(places[last], np.diff(np.r_[-1, last]))
        reached += step
    return pointer


def _pointers(order: np.ndarray, keys: np.ndarray, out: np.ndarray, places: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(np.r_[keys[1:] != keys[:-1], True])
    out[order] = np.repeat(places[last], np.diff(np.r_[-1, last]))
    return out


def repeated_runs(doc_ids: np.ndarray, cells: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte in the row's cell, length) of maximal runs of windows that an earlier document also has."""
    number: dict[bytes, int] = {}
    cell_of = np.array([number.setdefault(c, len(number)) for c in cells], dtype=np.int64)
    distinct = list(number)
    smallest = np.full(len(distinct), LAST_ID, np.int64)
    np.minimum.at(smallest, cell_of, doc_ids)
    sizes = np.array([len(c) for c in distinct])
    data = np.frombuffer(b"".join(distinct) + bytes(WINDOW + 8), np.uint8)
    pointer = refine_buckets(data)
    begins = np.cumsum(sizes) - sizes
    windows = sizes - WINDOW + 1
    heads = np.cumsum(windows) - windows
    starts = np.repeat(begins - heads, windows) + np.arange(windows.sum())
    bucket = pointer[starts]
    first_id = np.full(len(pointer), LAST_ID, np.int64)
    np.minimum.at(first_id, bucket, np.repeat(smallest, windows))
    by_window = first_id[bucket]
    per_row = windows[cell_of]
    row = np.repeat(np.arange(len(cells)), per_row)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    hit = by_window[heads[cell_of][row] + offset] < doc_ids[row]
    row, offset = row[hit], offset[hit]
    if not len(row):
        return row, offset, offset
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)])
    ends = np.r_[new[1:], len(row)] - 1
    return row[new], offset[new], offset[ends] - offset[new] + WINDOW


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by q-gram hash, taken in chunks that end where the hash changes."""

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        row, first, length = repeated_runs(t["doc_id"].to_numpy(), t["bytes"].to_pylist())
        return pa.RecordBatch.from_arrays(
            [pa.array(t["unit"].to_numpy()[row]), pa.array(t["ord"].to_numpy()[row]), pa.array((t["start"].to_numpy()[row] + first).astype(np.int32)), pa.array(length.astype(np.int32))],
            names=["unit", "ord", "start", "length"],
        )

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        h = np.asarray(batch["h"])
        if not len(h):
            continue
        start = 0
        for change in np.flatnonzero(h[1:] != h[:-1]).tolist() + [len(h) - 1]:
            if held and start == 0 and held[-1]["h"][-1].as_py() != h[0] and rows >= CHUNK_ROWS:
                yield solve(held)
                held, rows = [], 0
            if rows + change + 1 - start >= CHUNK_ROWS and change < len(h) - 1:
                yield solve([*held, batch.slice(start, change + 1 - start)])
                held, rows, start = [], 0, change + 1
        if start < len(h):
            held.append(batch.slice(start))
            rows += len(h) - start
    if held:
        yield solve(held)
    give_back()


# ---------------------------------------------------------------- the operator


def _merged(flags: pa.Table, n_texts: int) -> list[list[tuple[int, int]]]:
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n_texts)]
    for place, start, length in sorted(zip(flags["ord"].to_pylist(), flags["start"].to_pylist(), flags["length"].to_pylist(), strict=True)):
        mine = spans[place]
        if mine and start <= mine[-1][1]:
            mine[-1] = (mine[-1][0], max(mine[-1][1], start + length))
        else:
            mine.append((start, start + length))
    return spans


def _rest(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def _whole_characters(data: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, where a character goes only if all its bytes do."""
    inside = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            inside.append((a, b))
    return _rest(data, inside).decode("utf-8", "surrogatepass")


def _summary(texts: pa.Table, flags: pa.Table) -> pa.Table:
    rows = _ordered(texts)
    out = []
    for (_, doc_id, digest, data), spans in zip(rows, _merged(flags, len(rows)), strict=True):
        out.append((doc_id, digest, sum(b - a for a, b in spans), len(spans), hashlib.sha256(_rest(data, spans)).hexdigest()))
    columns = zip(*out, strict=True) if out else [[] for _ in range(5)]
    types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string())
    return pa.table({k: pa.array(list(c), t) for k, c, t in zip(("doc_id", "digest", "n_removed", "n_spans", "kept_sha256"), columns, types, strict=True)})


def _shortened(texts: pa.Table, flags: pa.Table) -> pa.Table:
    rows = _ordered(texts)
    out = [(doc_id, digest, _whole_characters(data, spans)) for (_, doc_id, digest, data), spans in zip(rows, _merged(flags, len(rows)), strict=True)]
    columns = zip(*out, strict=True) if out else [[] for _ in range(3)]
    return pa.table({k: pa.array(list(c), t) for k, c, t in zip(("doc_id", "digest", "rest"), columns, (pa.int64(), pa.binary(), pa.string()), strict=True)})


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a batch, one row per text, the one with the smallest id: copies are combined before the shuffle."""
    for batch in batches:
        best: dict[bytes, int] = {}
        ids = batch["doc_id"].to_pylist()
        for i, digest in enumerate(batch["digest"].to_pylist()):
            if digest not in best or ids[i] < ids[best[digest]]:
                best[digest] = i
        yield batch.take(pa.array(sorted(best.values()), pa.int64()))


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("doc_id"), whole_text("text").alias("text")).withColumn(
        "digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    )


@contextmanager
def text_table(docs: DataFrame, unit_bytes: int = UNIT_BYTES) -> Iterator[tuple[DataFrame, int, int]]:
    """Distinct texts with their smallest id, in a table bucketed by ``bucket``, dropped in the end; its units and buckets.

    A bucket holds the units with one remainder, so the number of buckets is bounded while units keep their size.
    """
    spark = docs.sparkSession
    rows = _identified(docs)
    n_units = partitions_for(docs, text_bytes(docs), unit_bytes)
    n_buckets = min(n_units, MAX_BUCKETS)
    unit = F.pmod(F.xxhash64("digest"), F.lit(n_units)).cast("int")
    once = rows.select(unit.alias("unit"), "doc_id", "digest", "text").mapInArrow(_first_copies, "unit int, doc_id bigint, digest binary, text string")
    first = F.row_number().over(Window.partitionBy("bucket", "unit", "digest").orderBy("doc_id"))
    kept = once.withColumn("bucket", _bucket(n_buckets)).repartition(n_buckets, "bucket").withColumn("_place", first).filter("_place = 1").drop("_place")
    name = f"scorewell_texts_{uuid.uuid4().hex}"
    try:
        kept.write.bucketBy(n_buckets, "bucket").sortBy("bucket", "unit").format("parquet").saveAsTable(name)
        yield spark.table(name), n_units, n_buckets
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _bucket(n_buckets: int) -> Column:
    return F.pmod(F.col("unit"), F.lit(n_buckets)).cast("int")


@contextmanager
def _met_by_bucket(spark: SparkSession) -> Iterator[None]:
    """Within this block a cogroup by (bucket, unit) takes the table of texts as it lies, by bucket."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def flagged(texts: DataFrame, n_units: int, n_buckets: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(unit, ord, start, length): byte runs of the distinct texts that start in a document with a smaller id."""
    marked = F.instr(F.hex("texts"), "01")  # a flag is one byte, 00 or 01
    grams = shared_grams(texts, n_units, hot_rows).select(F.col("family").cast("int").alias("unit"), "units", "sizes", "grams", "texts", "places", (marked > 0).alias("some_hot"))
    grams = materialize(grams.withColumn("bucket", _bucket(n_buckets)), "repeat-grams")
    by_unit = texts.groupBy("bucket", "unit")
    segments = by_unit.cogroup(grams.groupBy("bucket", "unit")).applyInArrow(_lean_pair(_segments), SEGMENT_DDL)
    dealt = segments.repartition(max(n_units, partitions_for(texts, 0)), "h").sortWithinPartitions("h")
    flags = dealt.mapInArrow(_flag, FLAG_DDL)
    hot = grams.filter("some_hot")
    if hot.limit(1).count():
        windows = by_unit.cogroup(hot.groupBy("bucket", "unit")).applyInArrow(_lean_pair(_hot_windows), "unit int, ord int, doc_id bigint, starts array<int>, digest binary")
        windows = materialize(windows, "repeat-windows")
        smallest = materialize(windows.groupBy("digest").agg(F.min("doc_id").alias("smallest"), F.max("doc_id").alias("largest")).filter("smallest < largest"), "repeat-smallest")
        late = windows.join(smallest, "digest").filter("smallest < doc_id").select("unit", "ord", "starts")
        flags = flags.unionByName(late.groupBy("unit").applyInArrow(_window_runs, FLAG_DDL))
    return flags


def _per_text(docs: DataFrame, fn, ddl: str, hot_rows: int) -> DataFrame:
    """``fn`` over every unit's texts and flagged runs, stored."""
    spark = docs.sparkSession
    with arrow_rows(spark, BATCH_ROWS), _met_by_bucket(spark), text_table(docs) as (texts, n_units, n_buckets):
        flags = flagged(texts, n_units, n_buckets, hot_rows).withColumn("bucket", _bucket(n_buckets))
        return materialize(texts.groupBy("bucket", "unit").cogroup(flags.groupBy("bucket", "unit")).applyInArrow(_lean_pair(fn), ddl), "repeat-texts")


def report(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``."""
    found = _per_text(docs, _summary, "doc_id bigint, digest binary, n_removed bigint, n_spans bigint, kept_sha256 string", hot_rows)
    rows = _identified(docs).select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes"))
    out = rows.join(found, ["doc_id", "digest"], "left")
    copy, gone = F.col("n_removed").isNull(), F.col("n_bytes") >= WINDOW
    return out.select(
        F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")).alias("doc_id"), "n_bytes",
        F.when(~copy, F.col("n_removed")).when(gone, F.col("n_bytes")).otherwise(F.lit(0)).cast("bigint").alias("n_removed"),
        F.when(~copy, F.col("n_spans")).when(gone, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("n_spans"),
        F.when(~copy, F.col("kept_sha256")).when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.lower(F.hex("digest"))).alias("kept_sha256"),
    )


def cut(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``docs`` with the repeated strings taken out of ``text`` (whole characters) and ``n_chars`` kept true if there."""
    found = _per_text(docs, _shortened, "doc_id bigint, digest binary, rest string", hot_rows)
    digest = F.unhex(F.sha2(whole_text("text").cast("binary"), 256))
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    size = F.octet_length(whole_text("text"))
    short = F.when(size < WINDOW, F.col("text"))
    rows = docs.select(others, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("doc_id"), digest.alias("digest"), short.alias("short"), (size < WINDOW).alias("is_short"))
    out = rows.join(found, ["doc_id", "digest"], "left")
    text = F.when(F.col("is_short"), F.col("short")).otherwise(F.coalesce(F.col("rest"), F.lit("")))
    columns = []
    for field in docs.schema.fields:
        if field.name == "text":
            columns.append(F.col("new").alias("text"))
        elif field.name == "n_chars":
            columns.append(F.when(F.col("new").isNotNull(), F.length("new").cast(field.dataType)).alias("n_chars"))
        else:
            columns.append(F.col(f"row.`{field.name}`").alias(field.name))
    return out.select("row", text.alias("new")).select(*columns)

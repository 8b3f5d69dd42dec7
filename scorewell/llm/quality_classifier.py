"""Quality classifier: naive Bayes support vectors.

A text is the set of its hashed n-grams: words, word pairs, and runs of one to four word shapes (case, trailing marks,
repetition). Each indicator is scaled by its class log-count ratio, counted over all labelled rows of the learning folds;
a linear hinge-loss model on the scaled, length-normalised rows is fitted by dual coordinate descent, and a logistic curve
on rows kept apart turns margins into scores.

The fit runs on the driver over at most ``MAX_FIT_ROWS`` labelled rows, the ones with the smallest id hashes (a documented
bound: a row is some thousand small integers). Counts cover every labelled row; they and the weights have ``BUCKETS``
entries whatever the data. Labels meet their texts without a shuffle of the texts while they are few (counted). Scoring is one
pass without a shuffle.

Defined results: NULL text is empty and scores by the bias alone; without both classes the score is the smoothed share of
label 1; labels that are NULL are left out; repeated label rows count as often as they join; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import fold, materialize

BUCKETS = 1 << 18
MAX_FIT_ROWS = 12_000
BROADCAST_LABELS = 1_000_000  # counted: 12 bytes each; with more labels the join is shuffled
EPOCHS = 12
COST = 1.0
SMOOTHING = 1.0
MEMO_ENTRIES = 400_000
_MASK = (1 << 32) - 1
_MARKS = b"#*$%&|<>!?.,;:"


class Words(dict):
    """Token bytes -> word hash (32 bits) << 16 | shape."""

    def __missing__(self, token: bytes) -> int:
        import zlib

        core = token.rstrip(_MARKS)
        marks = token[len(core) :]
        if not core:
            kind = 0
        elif core.isalpha() or core[0] > 127:
            text = core.decode("utf-8", "replace")
            kind = 1 if text.islower() else 2 if text.isupper() and len(text) > 1 else 3 if text.istitle() else 4
        else:
            kind = 5 if core.isdigit() else 6
        mark = 0 if not marks else 1 + min(2, len(marks) - 1) * 15 + _MARKS.index(marks[-1:])
        size = 0 if len(core) <= 14 else 1
        value = (zlib.crc32(token.lower()) << 16) | (kind * 100 + mark) * 2 + size
        if len(token) <= 48:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[token] = value
        return value


_WORDS = Words()


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)


def features(text: str | None) -> np.ndarray:
    """Distinct buckets of the text's n-grams, sorted."""
    tokens = (text or "").encode("utf-8", "surrogatepass").split()
    if not tokens:
        return np.empty(0, dtype=np.uint32)
    packed = np.array([_WORDS[t] for t in tokens], dtype=np.uint64)
    word, shape = packed >> np.uint64(16), packed & np.uint64(0xFFFF)
    shape = shape.copy()
    shape[1:] |= (word[1:] == word[:-1]).astype(np.uint64) << np.uint64(15)  # repeats its predecessor
    parts = [_mix(word, 1)]
    if len(word) > 1:
        parts.append(_mix(word[:-1] * np.uint64(0x100000001B3) + word[1:], 2))
    run = shape
    for n in range(1, 5):
        parts.append(np.unique(_mix(run, 10 + n)))
        if len(shape) <= n:
            break
        run = (run[:-1] * np.uint64(0x100000001B3)) + shape[n:]
    return np.unique(np.concatenate(parts) % np.uint64(BUCKETS)).astype(np.uint32)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = [features(t).tobytes() for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["place"], batch["label"], pa.array(cells, pa.binary())], names=["place", "label", "cells"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        for label, cells in zip(batch["label"].to_pylist(), batch["cells"].to_pylist(), strict=True):
            totals[label][np.frombuffer(cells, np.uint32)] += 1
    seen = np.flatnonzero(totals.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(totals[0][seen]), pa.array(totals[1][seen])], names=["bucket", "neg", "pos"])


def log_count_ratio(neg: np.ndarray, pos: np.ndarray) -> np.ndarray:
    p, q = pos + SMOOTHING, neg + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of min 1/2 |w|^2 + sum cost * hinge, one dual variable at a time; the last weight is the bias."""
    w = np.zeros(BUCKETS + 1)
    alpha = np.zeros(len(rows))
    diagonal = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(3)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            cells, v = rows[i], values[i]
            gradient = y[i] * (w[cells] @ v + w[BUCKETS]) - 1
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[cells] += step * v
                w[BUCKETS] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def _scaled(cells: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    v = ratio[cells]
    norm = np.sqrt(v @ v)
    return (v / norm if norm else v).astype(np.float32)


def calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve through margins (Newton steps, targets pulled in from 0 and 1, slope kept positive)."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        z = np.clip(a * margins + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        s = p * (1 - p)
        g = np.array([((p - target) * margins).sum() + 1e-3 * (a - 1), (p - target).sum()])
        h = np.array([[(s * margins * margins).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def learn(labelled: DataFrame, max_rows: int = MAX_FIT_ROWS) -> tuple[np.ndarray, float, float]:
    """(weights by bucket with the ratio folded in, slope, offset) from (doc_id, text, label) rows."""
    place = F.xxhash64(F.col("doc_id"))
    rows = labelled.select(place.alias("place"), F.col("label").cast("int").alias("label"), "text")
    made = materialize(rows.mapInArrow(_featurise, "place bigint, label int, cells binary"), "quality-cells")
    counted = made.select("label", "cells").mapInArrow(_count, "bucket bigint, neg bigint, pos bigint").groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    neg, pos = np.zeros(BUCKETS), np.zeros(BUCKETS)
    table = counted.toArrow()  # at most BUCKETS rows
    at = table["bucket"].to_numpy()
    neg[at], pos[at] = table["neg"].to_numpy(), table["pos"].to_numpy()
    ratio = log_count_ratio(neg, pos)
    n = made.count()
    near = made if n <= max_rows else made.filter(F.col("place") < int(-(2**63) + 2**64 * min(1.0, 1.1 * max_rows / n)) - 1)
    sample = near.orderBy("place", "label", "cells").limit(max_rows).toArrow()
    y = np.where(sample["label"].to_numpy() == 1, 1.0, -1.0) if sample.num_rows else np.empty(0)
    if len(set(y.tolist())) < 2:
        ones = int((y > 0).sum())
        share = (ones + 1) / (len(y) + 2)
        return np.zeros(BUCKETS + 1), 1.0, float(np.log(share / (1 - share)))
    cells = [np.frombuffer(c, np.uint32) for c in sample["cells"].to_pylist()]
    values = [_scaled(c, ratio) for c in cells]
    apart = np.arange(len(y)) % 5 == 4
    fit = np.flatnonzero(~apart) if len(set(y[~apart].tolist())) == 2 and len(set(y[apart].tolist())) == 2 else np.arange(len(y))
    check = np.flatnonzero(apart) if len(fit) < len(y) else fit
    w = dual_coordinate_descent([cells[i] for i in fit], [values[i] for i in fit], y[fit], np.full(len(fit), COST))
    margins = np.array([w[cells[i]] @ values[i] + w[BUCKETS] for i in check])
    slope, offset = calibrate(margins, y[check])
    weights = w.copy()
    weights[:BUCKETS] *= ratio
    return np.vstack([weights, np.append(ratio * ratio, 0.0)]), slope, offset


def score(docs: DataFrame, model: tuple[np.ndarray, float, float]) -> DataFrame:
    """(doc_id, held_out, score, predicted) for all rows of (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, slope, offset = shared.value
        weights, squares = table if table.ndim == 2 else (table, np.zeros(len(table)))
        for batch in batches:
            margins = np.empty(batch.num_rows)
            for i, text in enumerate(batch["text"].to_pylist()):
                cells = features(text)
                norm = np.sqrt(squares[cells].sum())
                margins[i] = (weights[cells].sum() / norm if norm else 0.0) + weights[BUCKETS]
            scores = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], schema=schema
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(place, "doc_id bigint, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, left_out: int = 1) -> DataFrame:
    """Learn from labelled rows outside the left-out fold, score all rows."""
    df = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("held_out", fold("doc_id", modulus) == left_out)
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    marks = marks.filter(F.col("label").isin(0, 1) & (fold("doc_id", modulus) != left_out))
    if marks.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    return score(df, learn(df.filter(~F.col("held_out")).join(marks, "doc_id").select("doc_id", "text", "label")))

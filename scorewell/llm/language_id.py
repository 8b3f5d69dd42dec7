"""Language identification with hyperdimensional profiles.

Every letter owns a random vector of +1 and -1, drawn from its code point. An n-gram binds its letters' vectors, each
rotated by its place, with an element-wise product; a text bundles (adds) the vectors of its n-grams; a language's
prototype bundles all texts learned for it. A text gets the language whose prototype has the largest cosine with it.
All sums are integers, so results do not depend on how the data are partitioned.

Learning is one pass: a task adds up its texts per language and sends one vector of ``DIMENSIONS`` integers per language.
Only the prototypes (languages x dimensions) reach the driver and the workers; more than ``MAX_LANGUAGES`` labels are
refused, as a label column of that size does not hold languages.

Defined results: texts that are NULL or have no letter are ``und`` with score 0; ties go to the first label in order;
without any learned label everything is ``und``; a NULL id belongs to the fold of the empty string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import fold

DIMENSIONS = 512
SEED = 77
MAX_LANGUAGES = 10_000
CHUNK_CHARS = 1 << 19  # texts are vectorised together up to this many characters
CHUNK_TEXTS = 1 << 9
UNKNOWN = "und"

_LETTERS = None


class Letters:
    """Code point -> small id (0: not a letter), and the vectors of the ids seen so far."""

    def __init__(self) -> None:
        self.ids = np.full(0x110000, -1, dtype=np.int32)
        self.vectors = [self._draw(0)]
        self.matrix = np.array(self.vectors)

    @staticmethod
    def _draw(code_point: int) -> np.ndarray:
        return np.random.default_rng([SEED, code_point]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        found = self.ids[points]
        if (found < 0).any():
            for point in np.unique(points[found < 0]).tolist():
                if chr(point).isalpha():
                    self.ids[point] = len(self.vectors)
                    self.vectors.append(self._draw(point))
                else:
                    self.ids[point] = 0
            self.matrix = np.array(self.vectors)
            found = self.ids[points]
        return found

    def trigram_vectors(self, codes: np.ndarray) -> np.ndarray:
        a, b, c = codes >> 34, (codes >> 17) & 0x1FFFF, codes & 0x1FFFF
        m = self.matrix
        return np.roll(m, 2, axis=1)[a] * np.roll(m, 1, axis=1)[b] * m[c]


def letters() -> Letters:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = Letters()
    return _LETTERS


def trigram_counts(texts: list[str], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, trigram, count) of texts taken together; runs of other characters count as one space, also at both ends."""
    joined = [f" {t.lower()} " for t in texts]
    sym = letters().symbols("".join(joined)).astype(np.int64)
    owner = np.repeat(owners, [len(t) for t in joined])
    text_no = np.repeat(np.arange(len(joined)), [len(t) for t in joined])
    keep = np.ones(len(sym), dtype=bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0) | (text_no[1:] != text_no[:-1])
    sym, owner, text_no = sym[keep], owner[keep], text_no[keep]
    same = text_no[2:] == text_no[:-2]
    codes = ((sym[:-2] << 34) | (sym[1:-1] << 17) | sym[2:])[same]
    owner = owner[2:][same]
    words, word_no = np.unique(codes, return_inverse=True)
    keys, counts = np.unique(owner * len(words) + word_no, return_counts=True)
    return (keys // len(words), words[keys % len(words)], counts) if len(words) else (keys, codes, counts)


def bundles(texts: list[str], owners: np.ndarray, n_owners: int) -> np.ndarray:
    """Sum of n-gram vectors per owner, exact integers held in float64."""
    owner, codes, counts = trigram_counts(texts, owners)
    out = np.zeros((n_owners, DIMENSIONS))
    if not len(owner):
        return out
    words, word_no = np.unique(codes, return_inverse=True)
    order = np.argsort(word_no, kind="stable")
    owner, word_no, counts = owner[order], word_no[order], counts[order]
    step = 1 << 13
    for i in range(0, len(words), step):  # a block of trigrams at a time: texts x step counts, however many trigrams there are
        a, b = np.searchsorted(word_no, [i, i + step])
        block = np.zeros((n_owners, min(step, len(words) - i)), dtype=np.float32)
        block[owner[a:b], word_no[a:b] - i] = counts[a:b]  # pairs are distinct
        out += block @ letters().trigram_vectors(words[i : i + step]).astype(np.float32)
    return out


def _pieces(texts: list[str | None]) -> Iterator[slice]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 2
        if size > CHUNK_CHARS or i - start >= CHUNK_TEXTS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch["text"].to_pylist(), batch["lang"].to_pylist()
        for s in _pieces(texts):
            names = sorted(set(langs[s]))
            index = {x: i for i, x in enumerate(names)}
            sums = bundles(texts[s], np.array([index[x] for x in langs[s]]), len(names))
            for name, row in zip(names, sums, strict=True):
                totals[name] = totals.get(name, 0) + row.astype(np.int64)
    schema = pa.schema([("lang", pa.string()), ("bundle", pa.list_(pa.int64()))])
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([v.tolist() for v in totals.values()], pa.list_(pa.int64()))], schema=schema)


def learn_profiles(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Language labels and their prototypes from (text, lang) rows without NULLs."""
    sums = (
        labelled.select("text", "lang").mapInArrow(_learn, "lang string, bundle array<bigint>")
        .select("lang", F.posexplode("bundle").alias("place", "part")).groupBy("lang", "place").agg(F.sum("part").alias("part"))
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "part"))).alias("bundle"))
    )
    rows = sums.limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} distinct labels: not a language column")
    rows.sort(key=lambda r: r["lang"])
    table = np.array([[x["part"] for x in r["bundle"]] for r in rows], dtype=np.float64).reshape(-1, DIMENSIONS)
    known = np.abs(table).sum(axis=1) > 0
    return [r["lang"] for r, k in zip(rows, known, strict=True) if k], table[known]


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the score is the cosine, cut at 0."""
    unit = prototypes / np.linalg.norm(prototypes, axis=1, keepdims=True) if len(names) else prototypes
    model = docs.sparkSession.sparkContext.broadcast((names, unit))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, table = model.value
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for s in _pieces(texts) if labels else ():
                sums = bundles(texts[s], np.arange(s.stop - s.start), s.stop - s.start)
                norms = np.linalg.norm(sums, axis=1)
                cosines = np.round((sums @ table.T) / np.maximum(norms, 1e-12)[:, None], 12)
                best = cosines.argmax(axis=1)
                for i in np.flatnonzero(norms > 0):
                    pred[s.start + i] = labels[best[i]]
                    score[s.start + i] = min(1.0, max(0.0, cosines[i, best[i]]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(pred, pa.string()), pa.array(score)], schema=schema)

    return docs.select("doc_id", "held_out", "text").mapInArrow(place, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, modulus: int = 5, left_out: int = 0) -> DataFrame:
    """Learn from the rows outside the left-out fold, predict all rows."""
    df = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    df = df.withColumn("held_out", fold("doc_id", modulus) == left_out)
    names, prototypes = learn_profiles(df.filter(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    return predict(df, names, prototypes)

"""Likelihood of whole texts under a gated recurrent language model with class-factored output.

A token's probability is P(class | state) * P(slot | class, state) and, for the rare slot, * P(word | rare words of that
class). A class is fixed by a word's spelling, its ``SLOTS`` most frequent words have slots of their own, all others share
the rare slot and are told apart by their counts, so the network knows at most ``CLASSES * SLOTS`` = 1,024 words whatever
the corpus. Word counts come from every training row; every training row also trains
the network. The state runs through a whole document, window after window; every window has a loss and a gradient, which is
truncated to the window.

Training is data-parallel: tasks start from one set of weights (biases at the log frequencies), each trains on its rows, and
their weights are averaged by token counts over a tree of bounded groups. A first round over a sixteenth of the rows gives
the second round, over the rest, a common start.

Counts of the ``HEAD_WORDS`` most frequent words (a fixed bound, words of at most ``HEAD_BYTES`` bytes) are broadcast; all
others are joined by a shuffle, one row per document and word.

Defined results: NULL text is empty, its only token is the end; repeated rows are scored one by one; without training rows
all counts are 0 and every token has the add-one probability; an empty table gives no rows.
"""

from __future__ import annotations

import ctypes
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import fold, materialize

CLASSES, SLOTS, HIDDEN = 32, 32, 16
WIDTH = SLOTS + 1  # slot 0 is the rare slot
HEAD_WORDS, HEAD_BYTES = 1 << 18, 64
TRAIN_LANES, TRAIN_WINDOW, SCORE_WINDOW = 512, 16, 64
LEAST_WINDOWS = 64  # a stream too short for all lanes gets fewer, so that it still makes this many windows
LEARNING_RATE = 0.01
FAN_IN = 64
BATCH_TOKENS = 1 << 21
SLICE_BYTES = 8 << 20  # text that is cut into words at a time
COUNT_BYTES = 16 << 20  # words that are counted at a time
BLOCK = 2048  # columns of a softmax that fit a core's cache
TRAILING = ".,;:!?#*$%&|<>\"')"
END = b""


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def class_of(word: bytes) -> int:
    """Class by the last three bytes of a word's letters; punctuation at the end does not matter."""
    core = word.rstrip(TRAILING.encode()) or word
    return zlib.crc32(core[-3:]) % CLASSES


def classes_of(words: pa.Array) -> np.ndarray:
    """``class_of`` of each word; every ending is hashed once."""
    core = pc.ascii_rtrim(words, characters=TRAILING)
    core = pc.if_else(pc.equal(pc.binary_length(core), 0), words, core)
    endings = pc.binary_slice(core.cast(pa.binary()), -3).dictionary_encode()
    found = np.array([zlib.crc32(x) % CLASSES for x in endings.dictionary.to_pylist()], np.int32)
    return found[endings.indices.to_numpy()] if len(words) else np.empty(0, np.int32)


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts with the end (an empty word) after each text's, and where each text begins and the last one stops."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    closed = pc.if_else(pc.equal(pc.binary_length(trimmed), 0), trimmed, pc.binary_join_element_wise(trimmed, " ", ""))
    lists = pc.ascii_split_whitespace(closed)
    return lists.flatten(), lists.offsets.to_numpy().astype(np.int64)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of some ``SLICE_BYTES`` of text, of whole rows."""
    part = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            yield batch.slice(a, b - a)


# ---------------------------------------------------------------- counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> pa.RecordBatch:
        counts = pc.value_counts(pa.chunked_array(held))
        words = counts.field("values")
        return pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(classes_of(words), pa.int32()), counts.field("counts")], names=["word", "cls", "c"])

    held, size = [], 0
    for part in (p for batch in batches for p in slices(batch)):
        held.append(tokens_of(part["text"])[0])
        size += held[-1].nbytes
        if size >= COUNT_BYTES:
            yield rows()
            held, size = [], 0
    if held:
        yield rows()


def count_words(training: DataFrame) -> DataFrame:
    """(word, cls, c) over all training rows, combined within a task before the shuffle."""
    partial = training.select("text").mapInArrow(_count, "word binary, cls int, c bigint")
    return materialize(partial.groupBy("word").agg(F.first("cls").alias("cls"), F.sum("c").alias("c")), "word-counts")


class Vocabulary:
    """Bounded head of the counts, slots of the model, and totals per class."""

    def __init__(self, vocab: DataFrame) -> None:
        short = vocab.filter(F.octet_length("word") <= HEAD_BYTES)
        step = F.floor(F.log2("c") * 8)
        kept, least = 0, None
        for r in short.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most some 500 steps
            if kept + r["count"] > HEAD_WORDS:
                break
            kept, least = kept + r["count"], r["step"]
        head = short.filter(step >= least).toArrow() if least is not None else None
        words = head["word"].to_pylist() if head is not None else []
        cls = head["cls"].to_numpy() if head is not None else np.empty(0, np.int32)
        c = head["c"].to_numpy() if head is not None else np.empty(0, np.int64)
        order = sorted(range(len(words)), key=lambda i: (-c[i], words[i]))
        self.words = [words[i] for i in order]
        self.cls, self.c = cls[order].astype(np.int32), c[order].astype(np.int64)
        self.slot = np.zeros(len(order), np.int32)
        used = np.zeros(CLASSES, np.int64)
        for i, k in enumerate(self.cls.tolist()):
            if used[k] < SLOTS:
                used[k] += 1
                self.slot[i] = used[k]
        self.slot_counts = np.zeros((CLASSES, WIDTH), np.int64)
        self.slot_counts[self.cls, self.slot] = np.where(self.slot > 0, self.c, 0)
        totals = {r["cls"]: (r["n"], r["v"]) for r in vocab.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
        self.n = sum(n for n, _ in totals.values())
        self.v = sum(v for _, v in totals.values())
        rare = [totals.get(k, (0, 0)) for k in range(CLASSES)]
        self.rare_n = np.array([n for n, _ in rare], np.int64) - self.slot_counts[:, 1:].sum(axis=1)
        self.rare_v = np.array([v for _, v in rare], np.int64) - used
        self.slot_counts[:, 0] = self.rare_n

    def first_weights(self) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(11)
        by_class = self.slot_counts.sum(axis=1) + 1.0
        slots = self.slot_counts + np.where(np.arange(WIDTH) == 0, 1.0, 0.1)
        f = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return {
            "x": f(CLASSES * WIDTH, 3 * HIDDEN), "u": f(HIDDEN, 3 * HIDDEN), "bu": np.zeros(3 * HIDDEN, np.float32),
            "wc": np.zeros((HIDDEN, CLASSES), np.float32), "bc": np.log(by_class / by_class.sum()).astype(np.float32),
            "ws": np.zeros((CLASSES, HIDDEN, WIDTH), np.float32), "bs": np.log(slots / slots.sum(axis=1, keepdims=True)).astype(np.float32),
        }


class Lookup:
    """Word -> place in the head, and the model's input and output number of any word."""

    def __init__(self, words: pa.Array, cls: np.ndarray, slot: np.ndarray) -> None:
        self.words = words
        self.number = np.append(cls.astype(np.int64) * WIDTH + slot, 0).astype(np.int32)
        end = pc.index(words, END).as_py()
        self.end = int(self.number[end]) if end >= 0 else class_of(END) * WIDTH

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place or -1, number) of each word."""
        places = pc.fill_null(pc.index_in(words.cast(pa.binary()), value_set=self.words), -1).to_numpy()
        numbers = self.number[places]
        rare = places < 0
        numbers[rare] = classes_of(words.filter(pa.array(rare))) * WIDTH
        return places, numbers


# ---------------------------------------------------------------- network


def keep_memory() -> None:
    """Let the C library reuse the memory of a window's arrays instead of mapping fresh pages for each of them."""
    if set_option := getattr(ctypes.CDLL(None), "mallopt", None):
        set_option(-3, 16 << 20)  # M_MMAP_THRESHOLD
        set_option(-1, 64 << 20)  # M_TRIM_THRESHOLD


def _columns(x: np.ndarray, h: np.ndarray, u: np.ndarray, bu: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step with a column per lane, so that every gate is one block of memory."""
    m = HIDDEN
    hw = u.T @ h
    hw += bu[:, None]
    with np.errstate(over="ignore"):
        gates = x[: 2 * m] + hw[: 2 * m]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.divide(1, gates, out=gates)
        z, r = gates[:m], gates[m:]
        n = r * hw[2 * m :]
        n += x[2 * m :]
        n *= -2
        np.exp(n, out=n)
        n += 1
        np.divide(2, n, out=n)
        n -= 1
    new = h - n
    new *= z
    new += n
    return new, z, r, n, hw[2 * m :]


def _step(x: np.ndarray, h: np.ndarray, u: np.ndarray, bu: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same step with a row per lane."""
    return tuple(a.T for a in _columns(x.T, h.T, u, bu))


def _inputs(w: dict[str, np.ndarray], inputs: np.ndarray) -> np.ndarray:
    """Input terms of a window (steps x lanes), columns by step."""
    return np.ascontiguousarray(np.take(w["x"], inputs, axis=0).transpose(0, 2, 1))


def _softmax(a: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each column and the log of its entry ``at``; works in ``a``."""
    logs, total = _own_logs(a, at)
    a /= total
    return a, logs


def _own_logs(a: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the probability of each column's entry ``at``, and the sums by which ``a`` then is to be divided."""
    a -= a.max(axis=0)
    own = a[at, np.arange(a.shape[1])]
    np.exp(a, out=a)
    total = a.sum(axis=0)
    return own - np.log(total), total


def _block_logs(w: np.ndarray, b: np.ndarray, states: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """``_own_logs`` of an affine layer over the columns of ``states``, a block at a time, into ``out``."""
    for k in range(0, len(at), BLOCK):
        a = w.T @ states[:, k : k + BLOCK]
        a += b[:, None]
        out[k : k + BLOCK] = _own_logs(a, at[k : k + BLOCK])[0]


def _by_class(cls: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Order of the tokens by class, and where each class begins in it."""
    order = np.argsort(cls.astype(np.int16), kind="stable")
    return order, [0, *np.cumsum(np.bincount(cls, minlength=CLASSES)).tolist()]


def token_logs(w: dict[str, np.ndarray], states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log of P(class) * P(slot | class) per row of ``states``."""
    return _column_logs(w, states.T, targets)


def _column_logs(w: dict[str, np.ndarray], states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """The same with a column per token."""
    cls, slot = targets // WIDTH, targets % WIDTH
    out, inside = np.empty(len(cls)), np.empty(len(cls))
    _block_logs(w["wc"], w["bc"], states, cls, out)
    order, ends = _by_class(cls)
    columns, slot = np.take(states, order, axis=1), slot[order]
    for k in range(CLASSES):
        at = slice(ends[k], ends[k + 1])
        _block_logs(w["ws"][k], w["bs"][k], columns[:, at], slot[at], inside[at])
    out[order] += inside
    return out


def gradients(w: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Mean loss gradients of one window (steps x lanes) from state ``h``; returns (gradients, last state, loss)."""
    steps, lanes = inputs.shape
    kept, m, h = [], HIDDEN, h.T
    x, begins = _inputs(w, inputs), fresh.any(axis=1)
    states, before = np.empty((steps, m, lanes), np.float32), np.empty((steps, m, lanes), np.float32)
    for t in range(steps):
        if begins[t]:
            h = np.where(fresh[t], np.float32(0), h)
        new, z, r, n, c = _columns(x[t], h, w["u"], w["bu"])
        kept.append((h, z, r, n, c))
        before[t], states[t] = h, new
        h = new
    flat, y = states.transpose(0, 2, 1).reshape(-1, m), targets.reshape(-1)
    cls, slot = y // WIDTH, y % WIDTH
    count = np.float32(len(y))
    at = np.arange(len(y))
    d = w["wc"].T @ flat.T
    d += w["bc"][:, None]
    d, own = _softmax(d, cls)
    loss = -own.sum()
    d.reshape(-1)[cls * len(y) + at] -= 1
    d /= count
    g = {"wc": flat.T @ d.T, "bc": d.sum(axis=1), "ws": np.zeros_like(w["ws"]), "bs": np.zeros_like(w["bs"])}
    dflat = d.T @ w["wc"].T
    order, ends = _by_class(cls)
    rows, slot, drows = flat[order], slot[order], np.empty_like(dflat)
    for k in range(CLASSES):
        a, b = ends[k], ends[k + 1]
        if a == b:
            continue
        d = w["ws"][k].T @ rows[a:b].T
        d += w["bs"][k][:, None]
        d, own = _softmax(d, slot[a:b])
        loss -= own.sum()
        d[slot[a:b], at[: b - a]] -= 1
        d /= count
        g["ws"][k], g["bs"][k] = rows[a:b].T @ d.T, d.sum(axis=1)
        drows[a:b] = d.T @ w["ws"][k].T
    dflat[order] += drows
    dstates = np.ascontiguousarray(dflat.reshape(steps, lanes, m).transpose(0, 2, 1))
    dx, dhw = np.empty((3 * m, steps, lanes), np.float64), np.empty((steps, 3 * m, lanes), dflat.dtype)
    back = np.zeros((m, lanes), dflat.dtype)
    for t in range(steps - 1, -1, -1):
        h, z, r, n, c = kept[t]
        dh, rest, dgates = dstates[t], 1 - z, dhw[t]
        dh += back
        dn = n * n
        np.subtract(1, dn, out=dn)
        dn *= dh * rest
        dz = np.subtract(h, n, out=dgates[:m])
        dz *= dh
        dz *= z
        dz *= rest
        dr = np.multiply(dn, c, out=dgates[m : 2 * m])
        dr *= r
        dr *= np.subtract(1, r, out=rest)
        dx[: 2 * m, t], dx[2 * m :, t] = dgates[: 2 * m], dn
        np.multiply(dn, r, out=dgates[2 * m :])
        back = w["u"] @ dgates
        dh *= z
        back += dh
        if begins[t]:
            back = np.where(fresh[t], np.float32(0), back)
    g["u"] = np.matmul(before, dhw.transpose(0, 2, 1)).sum(axis=0)
    g["bu"] = dhw.sum(axis=(0, 2))
    ids = inputs.reshape(-1).astype(np.intp)
    g["x"] = np.empty_like(w["x"])
    for j, column in enumerate(dx.reshape(3 * m, -1)):
        g["x"][:, j] = np.bincount(ids, weights=column, minlength=len(w["x"]))
    return g, states[-1].T, float(loss) / len(y)


class Trainer:
    """Adam over windows of lanes; a lane is a stream of documents, its state is emptied where one begins."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = {k: v.copy() for k, v in weights.items()}
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}
        self.steps = self.tokens = 0

    def stream(self, numbers: list[np.ndarray], end: int) -> None:
        targets = np.concatenate(numbers)
        starts = np.zeros(len(targets), bool)
        starts[np.cumsum([0] + [len(x) for x in numbers[:-1]])] = True
        inputs = np.empty_like(targets)
        inputs[1:] = targets[:-1]
        inputs[starts] = end
        self.tokens += len(targets)
        lanes = max(1, min(TRAIN_LANES, len(targets) // (TRAIN_WINDOW * LEAST_WINDOWS)))
        length = -(-len(targets) // lanes)
        spare = lanes * length - len(targets)

        def cut(a: np.ndarray, fill: int) -> np.ndarray:
            return np.concatenate([a, np.full(spare, fill, a.dtype)]).reshape(lanes, length).T

        x, y, fresh = cut(inputs, end), cut(targets, end), cut(starts, True)
        h = np.zeros((lanes, HIDDEN), np.float32)
        for a in range(0, length, TRAIN_WINDOW):
            b = a + TRAIN_WINDOW
            g, h, _ = gradients(self.w, x[a:b], y[a:b], fresh[a:b], h)
            self._update(g)

    def _update(self, g: dict[str, np.ndarray]) -> None:
        self.steps += 1
        rate = LEARNING_RATE * math.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        for k, d in g.items():
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.01 * (d * d - self.v[k])
            self.w[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


def _pack(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].reshape(-1) for k in sorted(w)]).astype(np.float64)


def _unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _add_up(rows: pa.Table) -> pa.Table:
    total = np.zeros(0)
    for cell in rows["weights"]:
        part = np.frombuffer(cell.as_py(), np.float64)
        total = part.copy() if not len(total) else total + part
    return pa.table({"place": pa.array([rows["place"][0].as_py() // FAN_IN]), "tokens": pa.array([sum(rows["tokens"].to_pylist())]), "weights": pa.array([total.tobytes()], pa.binary())})


def train_round(rows: DataFrame, weights: dict[str, np.ndarray], vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Every task trains from ``weights`` on its rows; the average by tokens comes back."""
    context = rows.sparkSession.sparkContext
    slotted = np.flatnonzero(vocabulary.slot > 0)
    shared = context.broadcast((weights, pa.array([vocabulary.words[i] for i in slotted], pa.binary()), vocabulary.cls[slotted], vocabulary.slot[slotted]))
    schema = "place bigint, tokens bigint, weights binary"

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keep_memory()
        start, words, cls, slot = shared.value
        lookup, trainer = Lookup(words, cls, slot), Trainer(start)
        held, size = [], 0
        for part in (p for batch in batches for p in slices(batch)):
            words_in, begins = tokens_of(part["text"])
            for numbers in np.split(lookup(words_in)[1], begins[1:-1]):
                held.append(numbers)
                size += len(numbers)
                if size >= BATCH_TOKENS:
                    trainer.stream(held, lookup.end)
                    held, size = [], 0
        if held:
            trainer.stream(held, lookup.end)
        if trainer.tokens:
            place = TaskContext.get().partitionId()
            blob = (_pack(trainer.w) * trainer.tokens).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([trainer.tokens]), pa.array([blob], pa.binary())], names=["place", "tokens", "weights"])

    sums = materialize(rows.select("text").mapInArrow(train, schema), "lm-weights")
    while sums.count() > FAN_IN:
        sums = materialize(sums.groupBy(F.floor(F.col("place") / FAN_IN)).applyInArrow(_add_up, schema), "lm-weights")
    parts = sums.orderBy("place").toArrow()
    if not parts.num_rows:
        return weights
    total = sum(np.frombuffer(c, np.float64) for c in parts["weights"].to_pylist()) / sum(parts["tokens"].to_pylist())
    return _unpack(total, weights)


# ---------------------------------------------------------------- scores


def text_logs(w: dict[str, np.ndarray], numbers: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log of the class and slot probabilities of whole documents; a lane holds whole documents one after another."""
    sizes = np.array([len(x) for x in numbers])
    lanes = int(max(1, min(1024, sizes.sum() // max(sizes.max(), 1024), len(numbers))))
    load, plan = [0] * lanes, [[] for _ in range(lanes)]
    import heapq

    heap = [(0, k) for k in range(lanes)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        at, k = heapq.heappop(heap)
        plan[k].append(i)
        load[k] = at + int(sizes[i])
        heapq.heappush(heap, (load[k], k))
    lane_order = sorted(range(lanes), key=lambda k: -load[k])
    length = load[lane_order[0]]
    y = np.full((lanes, length), end, np.int32)
    x = np.full((lanes, length), end, np.int32)
    owner = np.full((lanes, length), -1, np.int32)
    fresh = np.zeros((lanes, length), bool)
    for row, k in enumerate(lane_order):
        at = 0
        for i in plan[k]:
            n = int(sizes[i])
            y[row, at : at + n], owner[row, at : at + n] = numbers[i], i
            x[row, at + 1 : at + n] = numbers[i][:-1]
            fresh[row, at] = True
            at += n
    alive = np.array([load[k] for k in lane_order])
    y, x, owner, fresh = (np.ascontiguousarray(a.T) for a in (y, x, owner, fresh))
    out = np.zeros(len(numbers))
    h = np.zeros((HIDDEN, lanes), np.float32)
    for a in range(0, length, SCORE_WINDOW):
        b = min(a + SCORE_WINDOW, length)
        m = int((alive > a).sum())
        h = h[:, :m]
        states = np.empty((HIDDEN, b - a, m), np.float32)
        terms, begins = _inputs(w, x[a:b, :m]), fresh[a:b, :m].any(axis=1)
        for t in range(b - a):
            if begins[t]:
                h = np.where(fresh[a + t, :m], np.float32(0), h)
            h = _columns(terms[t], h, w["u"], w["bu"])[0]
            states[:, t] = h
        who, states, targets = owner[a:b, :m].reshape(-1), states.reshape(HIDDEN, -1), y[a:b, :m].reshape(-1)
        real = who >= 0
        if not real.all():
            who, states, targets = who[real], states[:, real], targets[real]
        out += np.bincount(who, weights=_column_logs(w, states, targets), minlength=len(out))
    return out


SCORE_DDL = (
    "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_log double, model_log double, "
    "rare array<struct<word:binary,cls:int,n:int>>"
)


def _rare_words(tokens: pa.Array, rare: np.ndarray, begins: np.ndarray) -> pa.Array:
    """Per text the words that are ``rare``, each once with its class and how often the text has it."""
    coded = tokens.filter(pa.array(rare)).dictionary_encode()
    many = max(1, len(coded.dictionary))
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))[rare]
    keys, n = np.unique(text * many + coded.indices.to_numpy(), return_counts=True)
    codes = keys % many
    cells = pa.StructArray.from_arrays(
        [coded.dictionary.take(pa.array(codes)).cast(pa.binary()), pa.array(classes_of(coded.dictionary)[codes], pa.int32()), pa.array(n, pa.int32())], names=["word", "cls", "n"]
    )
    ends = np.concatenate([[0], np.cumsum(np.bincount(keys // many, minlength=len(begins) - 1))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)


def _score_rows(rows: DataFrame, weights: dict[str, np.ndarray], vocabulary: Vocabulary) -> DataFrame:
    v = vocabulary
    base = np.append(np.log10((v.c + 1) / (v.n + v.v + 1)), 0.0)  # the last entry is that of words outside the head
    inside = np.append(np.where(v.slot > 0, 0.0, np.log10((v.c + 1) / (v.rare_n[v.cls] + v.rare_v[v.cls] + 1))), 0.0)
    shared = rows.sparkSession.sparkContext.broadcast((weights, pa.array(v.words, pa.binary()), v.cls, v.slot, base, inside))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keep_memory()
        w, words, cls, slot, base_logs, inside_logs = shared.value
        lookup = Lookup(words, cls, slot)
        row = TaskContext.get().partitionId() << 40

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal row
            model = text_logs(w, [x for _, numbers in held for x in numbers], lookup.end) / math.log(10)
            at = 0
            for columns, numbers in held:
                n = len(numbers)
                made = {"row": np.arange(row, row + n), **columns, "model_log": columns["inside_log"] + model[at : at + n]}
                names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_log", "model_log", "rare"]
                yield pa.RecordBatch.from_arrays([made[k] if isinstance(made[k], pa.Array) else pa.array(made[k]) for k in names], names=names)
                row, at = row + n, at + n

        held, size = [], 0
        for part in (p for batch in batches for p in slices(batch)):
            tokens, begins = tokens_of(part["text"])
            places, numbers = lookup(tokens)
            n_known, base_log, inside_log = (np.add.reduceat(x, begins[:-1]) for x in ((places >= 0).astype(np.int64), base_logs[places], inside_logs[places]))
            columns = {
                "doc_id": part["doc_id"], "held_out": part["held_out"], "n_tokens": np.diff(begins), "n_known": n_known,
                "base_log": base_log, "inside_log": inside_log, "rare": _rare_words(tokens, places < 0, begins),
            }
            numbers = np.split(numbers, begins[1:-1])
            del tokens, places
            a = 0
            for b, x in enumerate(numbers, 1):
                size += len(x)
                if size >= BATCH_TOKENS or b == len(numbers):
                    held.append(({k: c[a:b] for k, c in columns.items()}, numbers[a:b]))
                    a = b
                if size >= BATCH_TOKENS:
                    yield from finish()
                    held, size = [], 0
        if held:
            yield from finish()

    return rows.select("doc_id", "held_out", "text").mapInArrow(score, SCORE_DDL)


def score(docs: DataFrame, modulus: int = 7, left_out: int = 2) -> DataFrame:
    """Train outside the left-out fold, score every row (log10)."""
    df = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("held_out", fold("doc_id", modulus) == left_out)
    training = df.filter(~F.col("held_out"))
    counts = count_words(training)
    vocabulary = Vocabulary(counts)
    weights = vocabulary.first_weights()
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(16))
    for share in (part == 0, part != 0):
        weights = train_round(training.filter(share), weights, vocabulary)
    made = materialize(_score_rows(df, weights, vocabulary), "lm-rows")
    v = vocabulary
    inside = F.get(F.array(*[F.lit(float(x)) for x in (v.rare_n + v.rare_v + 1).tolist()]), F.col("cls"))
    rare = made.select("row", F.explode("rare").alias("x")).select("row", F.col("x.word").alias("word"), F.col("x.cls").alias("cls"), F.col("x.n").alias("n"))
    c = F.coalesce(F.col("c"), F.lit(0))
    joined = rare.join(counts.select("word", "c"), "word", "left").select(
        "row", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("bigint").alias("n_tokens"),
        F.when(c > 0, F.col("n")).otherwise(0).cast("bigint").alias("n_known"),
        (F.col("n") * F.log10((c + 1) / F.lit(float(v.n + v.v + 1)))).alias("base_log"), (F.col("n") * F.log10((c + 1) / inside)).alias("model_log"),
    )
    both = made.drop("rare").unionByName(joined)
    return both.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(int(v.n)).cast("bigint").alias("train_tokens"), F.sum("base_log").alias("base_score"), F.sum("model_log").alias("score"),
    ).drop("row")

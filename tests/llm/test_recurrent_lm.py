import math
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from scorewell.llm import recurrent_lm as lm


def corpus(n=240, seed=3):
    rng = random.Random(seed)
    words = {"x": ["alpha", "beta", "gamma", "delta"], "y": ["uno", "dos", "tres", "cuatro"]}
    rows = []
    for i in range(n):
        kind = rng.choice("xy")
        rows.append((i, " ".join(rng.choice(words[kind]) if rng.random() < 0.95 else f"rare{rng.randint(0, 400)}" for _ in range(rng.randint(0, 90)))))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \t"), (3, rows[3][1]), (None, "alpha UNO Ü"), (n + 3, "alpha " * 9000)]


def test_counts_and_base_scores(docs):
    rows = corpus(900)
    out = lm.score(docs(rows)).collect()
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    c = Counter()
    for d, t in rows:
        if not held(d):
            c.update(lm.words_of(t))
            c[lm.END] += 1
    n, v = sum(c.values()), len(c)
    want = []
    for d, t in rows:
        tokens = [*lm.words_of(t), lm.END]
        want.append((d, held(d), len(tokens), sum(c[w] > 0 for w in tokens), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens), 6)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    out_fold = [r for r in out if r.held_out]
    assert sum(r.score for r in out_fold) > sum(r.base_score for r in out_fold)
    assert all(r.score < 0 for r in out)


def test_rare_words_joined_equal_rare_words_in_the_head(docs, monkeypatch):
    rows = corpus(60)
    full = {(r.doc_id, r.n_tokens): r for r in lm.score(docs(rows)).collect()}
    monkeypatch.setattr(lm, "HEAD_WORDS", 12)
    for r in lm.score(docs(rows)).collect():
        want = full[(r.doc_id, r.n_tokens)]
        assert r.n_known == want.n_known and r.base_score == pytest.approx(want.base_score)


def test_no_rows(docs):
    assert lm.score(docs([])).collect() == []


def small_weights(seed=0):
    rng = np.random.default_rng(seed)
    f = lambda *s: rng.normal(0, 0.4, s)
    return {
        "x": f(lm.CLASSES * lm.WIDTH, 3 * lm.HIDDEN), "u": f(lm.HIDDEN, 3 * lm.HIDDEN), "bu": f(3 * lm.HIDDEN), "wc": f(lm.HIDDEN, lm.CLASSES), "bc": f(lm.CLASSES),
        "ws": f(lm.CLASSES, lm.HIDDEN, lm.WIDTH), "bs": f(lm.CLASSES, lm.WIDTH),
    }


def test_gradients_equal_finite_differences(monkeypatch):
    rng = np.random.default_rng(1)
    w = small_weights()
    x, y = rng.integers(0, 40, (5, 3)), rng.integers(0, 90, (5, 3))
    fresh = np.zeros((5, 3), bool)
    fresh[2, 1] = True
    h = rng.normal(0, 0.3, (3, lm.HIDDEN))
    g, _, _ = lm.gradients(w, x, y, fresh, h)

    def loss():
        state, total = h, 0.0
        for t in range(5):
            state = np.where(fresh[t][:, None], 0, state)
            state = lm._step(w["x"][x[t]], state, w["u"], w["bu"])[0]
            total -= lm.token_logs(w, state, y[t]).sum()
        return total / 15

    for name in w:
        flat, grad = w[name].reshape(-1), g[name].reshape(-1)
        for i in np.argsort(-np.abs(grad))[:4]:
            keep = flat[i]
            flat[i] = keep + 1e-4
            up = loss()
            flat[i] = keep - 1e-4
            down = loss()
            flat[i] = keep
            assert grad[i] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=2e-5), name


def test_probabilities_sum_to_one_and_state_spans_windows(monkeypatch):
    w = small_weights(2)
    state = np.random.default_rng(3).normal(0, 1, (1, lm.HIDDEN))
    every = np.arange(lm.CLASSES * lm.WIDTH)
    assert np.exp(lm.token_logs(w, np.repeat(state, len(every), axis=0), every)).sum() == pytest.approx(1)
    texts = [np.random.default_rng(i).integers(0, 200, n).astype(np.int32) for i, n in enumerate([1, 700, 3, 64, 65, 250])]
    whole = lm.text_logs(w, texts, 7)
    monkeypatch.setattr(lm, "SCORE_WINDOW", 5)
    assert lm.text_logs(w, texts, 7) == pytest.approx(whole, rel=1e-4)
    for text, value in zip(texts, whole, strict=True):
        assert lm.text_logs(w, [text], 7)[0] == pytest.approx(value, rel=1e-4)


def test_every_token_has_a_gradient(monkeypatch):
    numbers = [np.random.default_rng(i).integers(0, 200, n).astype(np.int32) for i, n in enumerate([40, 3000, 7, 900])]
    whole, seen, plain = np.concatenate(numbers), [], lm.gradients

    def watched(w, x, y, fresh, h):
        seen.append(y.reshape(-1).copy())
        return plain(w, x, y, fresh, h)

    monkeypatch.setattr(lm, "gradients", watched)
    trainer = lm.Trainer(small_weights())
    trainer.stream(numbers, 7)
    got, want = np.bincount(np.concatenate(seen), minlength=200), np.bincount(whole, minlength=200)
    assert (got >= want).all() and trainer.steps == len(seen)


def test_a_lone_window_trains():
    start = small_weights()
    trainer = lm.Trainer(start)
    trainer.stream([np.arange(lm.TRAIN_WINDOW, dtype=np.int32)], 7)
    assert trainer.steps == 1 and not np.array_equal(trainer.w["bs"], start["bs"])


ODD_TEXTS = ["a  b. c,\t", None, "", " \n", "ÄB cd\x85 e\x1cf Été!?", "...", "x", "\x0b\x0c y ...'", "AbC abc. ABC!", "12345 45) 345\x00", "　 🙂🙂 🙂."]


def test_words_of_whole_batches_equal_words_of_single_texts():
    flat, begins = lm.tokens_of(pa.array(ODD_TEXTS, pa.string()))
    words = flat.cast(pa.binary()).to_pylist()
    assert [words[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)] == [[*lm.words_of(t), lm.END] for t in ODD_TEXTS]
    assert lm.classes_of(flat).tolist() == [lm.class_of(w) for w in words]
    assert lm.classes_of(flat.slice(0, 0)).tolist() == []


def test_lookup_numbers_known_rare_and_no_words():
    flat, _ = lm.tokens_of(pa.array(ODD_TEXTS, pa.string()))
    words = flat.cast(pa.binary()).to_pylist()
    for head in ([b"abc", lm.END, b"x"], [b"x"], []):
        cls, slot = np.array([lm.class_of(w) for w in head], np.int32), np.array([2, 1, 0][: len(head)], np.int32)
        lookup = lm.Lookup(pa.array(head, pa.binary()), cls, slot)
        places, numbers = lookup(flat)
        assert places.tolist() == [head.index(w) if w in head else -1 for w in words]
        assert numbers.tolist() == [lm.class_of(w) * lm.WIDTH + (int(slot[head.index(w)]) if w in head else 0) for w in words]
        assert lookup.end == numbers[words.index(lm.END)]


def test_slices_change_no_counts(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"text": pa.array([*ODD_TEXTS, "alpha " * 500, *ODD_TEXTS], pa.string())})

    def counted():
        found = Counter()
        for part in lm._count(iter([batch, batch.slice(0, 0), batch])):
            for r in part.to_pylist():
                found[r["word"], r["cls"]] += r["c"]
        return found

    whole = counted()
    assert whole == Counter((w, lm.class_of(w)) for t in batch["text"].to_pylist() * 2 for w in [*lm.words_of(t), lm.END])
    monkeypatch.setattr(lm, "SLICE_BYTES", 10)
    monkeypatch.setattr(lm, "COUNT_BYTES", 100)
    assert counted() == whole
    parts = list(lm.slices(batch))
    assert len(parts) > 3 and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()


def test_words_are_counted_without_a_call_for_each():
    batch = pa.RecordBatch.from_pydict({"text": pa.array([" ".join(f"w{i}_{j}ing" for j in range(100)) for i in range(200)], pa.string())})
    calls = 0

    def watch(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(watch)
    try:
        rows = sum(len(b) for b in lm._count(iter([batch])))
    finally:
        sys.setprofile(None)
    assert rows == 20_001 and calls < 2_000

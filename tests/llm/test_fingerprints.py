"""Every row against a plain Python version over the sorted documents."""

import hashlib
import random

import pytest

from scorewell.llm import fingerprints as fp


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghéß", k=rng.randint(1, 9))) for _ in range(n))


def check(docs, rows):
    got = {}
    for r in fp.fingerprints(docs(rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    gear = fp.gear_table()
    want = {}
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = (fp.fingerprint(x, gear) for x in (text, edited, following))
        want.setdefault(doc_id, []).append(
            (len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.encoded(a), fp.encoded(b), fp.containment(a, b), fp.containment(a, c))
        )
    assert {k: sorted(tuple(r)[1:] for r in v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_rows_equal_the_plain_version(docs):
    rng = random.Random(5)
    rows = [(i * 7 - 300, words(rng, rng.choice([0, 1, 5, 80, 400]))) for i in range(300)]
    rows += [(rows[0][0], "repeated id"), (None, "no id"), (None, None), (10**17 + 1, None), (10**17, "x" * 5000), (10**17 + 2, words(rng, 20000))]
    check(docs, rows)


@pytest.mark.parametrize("rows", [[], [(1, "alone")], [(1, None)], [(1, "a"), (1, "a")]])
def test_few_rows(docs, rows):
    check(docs, rows)


def test_likeness_follows_the_shared_text():
    rng = random.Random(6)
    gear = fp.gear_table()
    a, b = words(rng, 2000), words(rng, 2000)
    pa, pb = fp.fingerprint(a, gear), fp.fingerprint(b, gear)
    assert fp.containment(pa, fp.fingerprint("shift " + a, gear)) > 0.97
    assert 0.45 < fp.containment(pa, fp.fingerprint(fp.edited_text(a, b), gear)) < 0.55
    assert fp.containment(pa, pb) == 0 and fp.containment(pa, pa) == 1
    assert sum(pa.values()) == len(a.encode())


def test_hash_depends_on_sixteen_bytes_only():
    import numpy as np

    gear = fp.gear_table()
    x = np.random.default_rng(0).integers(0, 256, 400, dtype=np.uint8)
    assert (fp.gear_hashes(x, gear)[115:] == fp.gear_hashes(x[100:], gear)[15:]).all()

"""Spans against a plain Python scan, and the linking rule by hand."""

import hashlib
import re

import pytest

from scorewell.llm import secret_scan

KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def base(text):
    out = []
    for i, (kind, pattern, group, least) in enumerate(KINDS):
        out += [(m.start(), i, m.end(), kind) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


TEXTS = [
    None, "", "nothing here", "secret: token = abcdef", "password=token=abcdefgh", "PassWD: 'hunter22' über AKIA" + "Q" * 16, "AKIAAKIA1 AKIA" + "B" * 20,
    "é😀 token=abc api_key := x apikey = \"zzzzzz\" " + "ab12" * 8, "paſſword=abcdefgh", "0" * 24 + "g" + "f" * 23, "token=" + "a" * 5000,
    "password=" * 50 + "abcdef", "x\npassword =  qwerty\n" * 40,
]


def test_base_spans_equal_a_plain_scan(docs):
    rows = {r.doc_id: r for r in secret_scan.report(docs(list(enumerate(TEXTS)))).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        want = base(text)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert rows[i].n_assign == sum(x.startswith("assign") for x in want)
        assert set(want) <= set(rows[i].spans.split(",")) | {""}


OPAQUE = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        (f"id AKIA{'X' * 16} key {OPAQUE} at https://host.example/x", {"access", "opaque", "endpoint"}),
        (f"key {OPAQUE} alone", set()),
        ("see https://host.example/x only", set()),
        (f"id AKIA{'X' * 16}" + " word" * 300 + f" key {OPAQUE}", {"access"}),
        ("user=alice password=abcdef99 at ftp://host/x", {"login", "assign", "endpoint"}),
        ("user=alice at ftp://host/x", set()),
    ],
)
def test_weak_parts_need_their_complement(docs, text, kinds):
    row = secret_scan.report(docs([(1, text), (1, text)])).collect()
    assert len(row) == 2 and row[0] == row[1]
    assert {s.split(":")[0] for s in row[0].spans.split(",") if s} == kinds


def test_redaction_keeps_other_columns_and_clean_rows(docs, spark):
    from pyspark.sql import functions as F

    df = docs([(1, "a password=abcdef99 b"), (2, "clean"), (3, None), (3, None)]).withColumn("spans", F.lit(7)).withColumn("base", F.lit("x"))
    rows = sorted(secret_scan.redact(df).collect(), key=lambda r: r.doc_id)
    assert [r.text for r in rows] == ["a [secret] b", "clean", None, None]
    assert rows[0].n_chars == len("a [secret] b") and rows[0].spans == 7 and rows[0].base == "x"


def test_empty_table(docs):
    assert secret_scan.report(docs([])).collect() == []

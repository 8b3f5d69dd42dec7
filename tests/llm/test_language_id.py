"""Held-out accuracy, the bundle against a plain sum, and the edge cases."""

import numpy as np
from pyspark.sql import functions as F

from scorewell.llm import language_id as li

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = li.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    right, n = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 20 and right > 0.9
    assert out.filter("score < 0 or score > 1").count() == 0


def test_bundle_is_the_sum_of_bound_trigrams():
    text = "Ab  c!"
    padded = [0, ord("a"), ord("b"), 0, ord("c"), 0]
    table = li.letters()
    vec = lambda p: table._draw(p).astype(int)
    want = sum(np.roll(vec(a), 2) * np.roll(vec(b), 1) * vec(c) for a, b, c in zip(padded, padded[1:], padded[2:], strict=False))
    assert (li.bundles([text, "", "xyz"], np.array([0, 1, 2]), 3)[0] == want).all()


def test_many_trigrams_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 1000))) for _ in range(64)]
    one = li.bundles(texts[:1], np.array([0]), 1)
    tracemalloc.start()
    out = li.bundles(texts, np.arange(64), 64)
    assert tracemalloc.get_traced_memory()[1] < 150 << 20  # 64 texts x 64,000 trigrams x 4 bytes alone were 16 MB, growing with the square
    tracemalloc.stop()
    assert (out[0] == one[0]).all()


def test_edges(docs, spark):
    rows = [(i, "the cat sat on the mat and the dog", "en", "s") for i in range(8)] + [(i, "der hund und die katze auf dem tisch", "de", "s") for i in range(8, 16)]
    rows += [(20, None, "en", "s"), (21, "123 !!", "en", "s"), (22, "und die katze", None, None), (22, "und die katze", None, None), (None, "the dog", "en", None), (23, "日本", None, None)]
    df = docs(rows).withColumn("held_out", F.lit(1)).withColumn("score", F.lit("x"))
    out = {(r.doc_id, r.lang_pred) for r in li.identify(df).collect()}
    assert {(20, "und"), (21, "und"), (22, "de"), (None, "en"), (0, "en"), (9, "de")} <= out
    assert li.identify(df).count() == len(rows)
    unlabelled = docs([(1, "abc", None, None)])
    assert [tuple(r) for r in li.identify(unlabelled).select("lang_pred", "score").collect()] == [("und", 0.0)]
    assert li.identify(docs([])).collect() == []
    same = {tuple(r) for r in li.identify(df.repartition(7)).collect()}
    assert same == {tuple(r) for r in li.identify(df.coalesce(1)).collect()}

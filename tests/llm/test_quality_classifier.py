import random

import numpy as np
from pyspark.sql import functions as F

from scorewell.llm import quality_classifier as qc


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = qc.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r.score for r in out if r.quality == q] for q in (1, 0))
    assert len(bad) > 5 and np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)


def test_edges(docs, spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["good", "fine", "nice"] if i % 2 else ["spam!!", "$$$", "SPAM"], k=30))) for i in range(200)]
    df = docs([*rows, (900, None), (901, ""), (900, None), (None, "good fine")]).withColumn("score", F.lit(3)).withColumn("label", F.lit(4))
    marks = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (900, None), (901, 7), (5000, 1)], "doc_id bigint, quality int")
    out = qc.classify(df, marks).collect()
    assert len(out) == 204 and all(0 <= r.score <= 1 for r in out)
    known = [r for r in out if r.doc_id is not None and r.doc_id < 200]
    assert np.mean([r.predicted == r.doc_id % 2 for r in known if r.held_out]) > 0.95
    one_class = qc.classify(df, marks.filter("quality = 1")).collect()
    assert len({r.score for r in one_class}) == 1 and one_class[0].predicted == 1
    assert {r.score for r in qc.classify(df, marks.limit(0)).collect()} == {0.5}
    assert qc.classify(docs([]), marks).collect() == []


def test_dual_descent_separates_and_keeps_the_box():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(50, 8, replace=False)) + (0 if i % 2 else 60) for i in range(60)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(60)])
    values = [np.full(8, 0.35) for _ in rows]
    w = qc.dual_coordinate_descent(rows, values, y, np.full(60, 1.0), 50)
    assert all(y[i] * (w[rows[i]] @ values[i] + w[qc.BUCKETS]) > 0 for i in range(60))


def test_features_are_a_set():
    assert qc.features(None).tolist() == qc.features(" \n").tolist() == []
    f = qc.features("a b a b a b")
    assert len(f) == len(set(f.tolist())) and (f == qc.features("a b a b a b")).all() and f.max() < qc.BUCKETS

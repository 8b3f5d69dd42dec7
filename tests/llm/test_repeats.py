import random
import uuid

import numpy as np
import pyarrow as pa
import pytest
from brute import covered_bytes, removal, text_without
from pyspark.sql import functions as F

from scorewell.llm import repeats


def make(seed, n=60):
    rng = random.Random(seed)
    noise = lambda k: "".join(rng.choices("abcdefgh éß\n", k=k))
    passages = [noise(rng.randint(49, 140)) for _ in range(5)] + ["-" * 120, "ab" * 90]
    rows = []
    for i in range(n):
        text = noise(rng.randint(0, 200))
        for _ in range(rng.randint(0, 3)):
            text += rng.choice(passages) + noise(rng.randint(0, 60))
        rows.append((rng.randint(-5, 10**6) * 2 + i % 2, text))
    rows += [(10**7 + i, rows[3][1]) for i in range(3)] + [(10**7 + 9, None), (10**7 + 10, ""), (10**7 + 11, "x" * 49), (10**7 + 12, "x" * 50), (10**7 + 13, "x" * 4000)]
    return rows


@pytest.mark.parametrize("hot_rows", [repeats.HOT_ROWS, 3])
def test_rows_equal_brute_force(docs, hot_rows):
    rows = make(4) + [(None, make(4)[0][1]), (make(4)[1][0], make(4)[1][1])]
    df = docs(rows).withColumn("unit", F.lit(1)).withColumn("digest", F.lit("x"))
    got = sorted((tuple(r) for r in repeats.report(df, hot_rows).collect()), key=repr)
    assert got == sorted(removal(rows), key=repr)


def test_cut_texts(docs):
    rows = make(6, 40)
    df = docs(rows).withColumn("row", F.lit(1)).withColumn("rest", F.col("doc_id"))
    out = repeats.cut(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id, r.text, r.n_chars, r.rest) for r in out.collect() if r.text is not None)
    want = [(d, text_without(data, c)) for (d, data, c), (_, t) in zip(covered_bytes(rows), rows, strict=True) if t is not None]
    assert got == sorted((d, t, len(t), d) for d, t in want)


def test_empty_table_and_lone_text(docs, spark):
    before = len(spark.catalog.listTables())
    assert repeats.report(docs([])).collect() == []
    assert [(r.n_bytes, r.n_removed) for r in repeats.report(docs([(1, "ab" * 200)])).collect()] == [(400, 0)]
    assert len(spark.catalog.listTables()) == before


def test_refined_buckets_are_equal_prefixes():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 99, 3000, dtype=np.uint8)
    body[1000:1300] = body[:300]
    data = np.concatenate([body, np.zeros(60, np.uint8)])
    pointer = repeats.refine_buckets(data)
    seen = {}
    for i in range(len(body) - 50):
        assert seen.setdefault(bytes(data[i : i + 50]), pointer[i]) == pointer[i]
    assert len(set(seen.values())) == len(seen)
    order = sorted(seen, key=seen.get)
    assert order == sorted(seen)


def test_equal_windows_pick_equal_grams():
    rng = np.random.default_rng(2)
    shared = rng.integers(97, 123, 400, dtype=np.uint8)
    h1, a1, b1 = repeats.minimizers(np.concatenate([rng.integers(97, 123, 333, dtype=np.uint8), shared]))
    h2, a2, b2 = repeats.minimizers(np.concatenate([rng.integers(97, 123, 70, dtype=np.uint8), shared, shared]))
    at = lambda h, a, b, w: h[np.flatnonzero((a <= w) & (w <= b))[0]]
    for w in range(351):
        assert at(h1, a1, b1, 333 + w) == at(h2, a2, b2, 70 + w) == at(h2, a2, b2, 470 + w)
    assert a1[0] == 0 and (a1[1:] == b1[:-1] + 1).all() and b1[-1] == 733 - 50


PERIODIC = [(1, "abcdefghij klmno " * 400), (2, "xyz " + "abcdefghij klmno " * 300), (3, "0123456789 pqrst " * 500), (4, "plain words that only one text has, and that are not repeated")]


def test_a_gram_is_hot_by_its_places():
    batch = pa.RecordBatch.from_pydict({"unit": pa.array([0, 0, 1, 1], pa.int32()), "text": [text for _, text in PERIODIC]})
    made = pa.Table.from_batches(repeats._gram_blobs(1, 1)(iter([batch])))
    out = repeats._shared_grams(100, 1)(made)
    texts = pa.table({"unit": pa.array([0, 0], pa.int32()), "doc_id": [1, 2], "digest": [b"a", b"b"], "text": [text for _, text in PERIODIC[:2]]})
    rows = repeats._segments(texts, out)["h"].to_numpy()
    assert len(rows) == 0 or np.unique(rows, return_counts=True)[1].max() <= 100
    assert repeats._Grams.read(out)[2].any()
    windows = repeats._hot_windows(texts, out)
    assert 0 < windows.num_rows < 200


@pytest.mark.parametrize("hot_rows", [repeats.HOT_ROWS, 100])
def test_short_periods_equal_brute_force(docs, hot_rows):
    got = sorted(tuple(r) for r in repeats.report(docs(PERIODIC), hot_rows).collect())
    assert got == sorted(removal(PERIODIC))


@pytest.mark.parametrize("fan", [2, 5, 512])
def test_many_units_few_buckets_and_several_passes(docs, spark, monkeypatch, fan):
    monkeypatch.setattr(repeats, "UNIT_BYTES", 200)
    monkeypatch.setattr(repeats, "RANGE_BYTES", 300)
    monkeypatch.setattr(repeats, "MAX_BUCKETS", 7)
    monkeypatch.setattr(repeats, "FAN", fan)
    rows = make(8, 50)
    with repeats.text_table(docs(rows), 200) as (texts, n_units, n_buckets):
        assert n_units > 40 and n_buckets == 7 and texts.select("unit").distinct().count() > 20
        assert repeats.fan_levels(n_units) >= (2 if fan < 512 else 1)
    real = repeats.text_table
    monkeypatch.setattr(repeats, "text_table", lambda d: real(d, 200))
    got = sorted((tuple(r) for r in repeats.report(docs(rows), 3).collect()), key=repr)
    assert got == sorted(removal(rows), key=repr)


def test_texts_stay_where_they_lie(docs, spark):
    with repeats.arrow_rows(spark, 100), repeats._met_by_bucket(spark), repeats.text_table(docs(make(8, 50)), 200) as (texts, n_units, n_buckets):
        flags = spark.createDataFrame([], repeats.FLAG_DDL).withColumn("bucket", repeats._bucket(n_buckets))
        met = texts.groupBy("bucket", "unit").cogroup(flags.groupBy("bucket", "unit")).applyInArrow(repeats._summary, "doc_id bigint, digest binary, n_removed bigint, n_spans bigint, kept_sha256 string")
        plan = met._jdf.queryExecution().executedPlan().toString()
    left = plan[: plan.index("Scan parquet")]
    assert "Exchange" not in left.split("FlatMapCoGroups")[1]


def test_a_failed_run_leaves_no_table(docs, spark):
    before = len(spark.catalog.listTables())
    with pytest.raises(RuntimeError), repeats.text_table(docs(make(8, 5))):
        raise RuntimeError
    assert len(spark.catalog.listTables()) == before


def test_ranges_hold_equally_many_grams():
    data = np.random.default_rng(3).integers(97, 123, 2_000_000, dtype=np.uint8)
    h = np.unique(repeats._short(repeats.minimizers(data)[0]))
    assert len(h) > 100_000 and len(h) == len(np.unique(repeats.minimizers(data)[0] >> np.uint64(16)))
    for n in (8, 64, 256):
        counts = np.bincount(repeats.range_of(h, n), minlength=n)
        assert counts.max() < 1.3 * counts.mean()


@pytest.mark.parametrize("fan", [4, 39, 512])
def test_no_group_between_passes_holds_many_hashes(docs, spark, monkeypatch, tmp_path, fan):
    """Just above ``FAN`` units a row of ``FAN`` pieces had nearly all hashes of the table meet in a few groups."""

    def counted(fn, name):
        def run(group):
            (tmp_path / f"{name}-{uuid.uuid4().hex}").write_text(str(len(repeats._Grams.read(group)[1])))
            return fn(group)

        return run

    for name in ("_to_ranges", "_shared_grams", "_to_families"):
        make_fn = getattr(repeats, name)
        monkeypatch.setattr(repeats, name, lambda *a, f=make_fn, n=name: counted(f(*a), n))
    monkeypatch.setattr(repeats, "UNIT_BYTES", 2_000)
    monkeypatch.setattr(repeats, "RANGE_BYTES", 2_000)
    monkeypatch.setattr(repeats, "FAN", fan)
    rng = random.Random(9)
    rows = [(i, "".join(rng.choices("abcdefgh ", k=500))) for i in range(160)]
    with repeats.text_table(docs(rows + [(i + 1_000, text + "z") for i, text in rows]), 2_000) as (texts, n_units, _):
        assert n_units > 39 * 2 and repeats.fan_levels(n_units) == {4: 4, 39: 2, 512: 1}[fan]
        assert repeats.shared_grams(texts, n_units, 10**6).count() > 0
    for name in {"_shared_grams"} | ({"_to_ranges", "_to_families"} if fan < 512 else set()):
        sizes = [int(p.read_text()) for p in tmp_path.glob(f"{name}-*")]
        levels = 1 if name == "_shared_grams" else repeats.fan_levels(n_units) - 1
        assert max(sizes) < 8 * sum(sizes) / levels / n_units, name


@pytest.mark.parametrize("n", [1, 2, 511, 512, 513, 770, 1_290, 40_000, 512**2, 512**2 + 1, 10**7])
def test_passes_are_as_even_as_they_go(n):
    levels, fan = repeats.fan_levels(n), repeats.fan_out(n)
    assert fan <= repeats.FAN and n <= fan**levels and (fan - 1) ** levels < max(n, 2)


def test_cut_texts_in_several_passes(docs, monkeypatch):
    """The stage of the pipeline, above ``FAN`` units."""
    monkeypatch.setattr(repeats, "UNIT_BYTES", 300)
    monkeypatch.setattr(repeats, "RANGE_BYTES", 300)
    monkeypatch.setattr(repeats, "FAN", 20)
    real, seen = repeats.text_table, []

    def small(df):
        seen.append(repeats.partitions_for(df, repeats.text_bytes(df), 300))
        return real(df, 300)

    monkeypatch.setattr(repeats, "text_table", small)
    rows = make(6, 40)
    got = sorted((r.doc_id, r.text) for r in repeats.cut(docs(rows)).collect() if r.text is not None)
    assert repeats.fan_levels(seen[0]) == 2 and repeats.fan_out(seen[0]) < 10
    assert got == sorted((d, text_without(data, c)) for (d, data, c), (_, t) in zip(covered_bytes(rows), rows, strict=True) if t is not None)

"""Steps that must spread or stay small as tables grow."""

from __future__ import annotations

import datetime as dt
import json
import math
import random

import numpy as np
import pyarrow
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from scorewell import core
from scorewell.operators import analysis as an
from scorewell.operators import codes as cd
from scorewell.operators import coding as co
from scorewell.operators import irt
from scorewell.operators import pairs as pa
from scorewell.operators import scores as sc
from scorewell.operators import validation as va
from scorewell.plans import tables as t
from scorewell.plans.registry import QUERIES, load_all
from scorewell.sources import sinks as sk
from scorewell.plans.queries_streams import as_stream
from scorewell.streaming import jobs, packed


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ratings_of_one_small_file_are_asked_on_all_cores(spark, tmp_path):
    """A bank is a small file, so its items arrive in one partition; every reply is judged once, not per use."""
    spark.range(400).coalesce(1).select(F.lit("bank").alias("instrument_key"), F.col("id").cast("string").alias("question_id"), F.lit("h").alias("item_hash"), F.lit("t").alias("text"), F.lit("A").alias("key")).write.parquet(f"{tmp_path}/items")

    def where(prompt: str) -> dict:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        return {"text": json.dumps({"bloom_level": 3, "solved_answer": str(part), "key_defensible": str(part)}), "error": None, "tokens_used": 1}

    rated = co.rate_items(spark.read.parquet(f"{tmp_path}/items"), where, "Rate it.", ["m"])
    assert rated.filter("ok").count() == 800
    assert rated.filter("step = 'key'").select("key_defensible").distinct().count() >= spark.sparkContext.defaultParallelism
    judged = co.call_checked(spark.range(3), F.col("id").cast("string"), where, lambda reply: F.array_compact(F.array(F.when(F.length(F.sha1(reply)) < 40, "short"))))
    assert plan(judged).count("sha1") == 1  # of the second call alone; the first is stored


class Value:
    def __init__(self):
        self.now, self.reads, self.writes = None, 0, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.reads += 1
        return self.now

    def update(self, value):
        self.now, self.writes = value, self.writes + 1


def test_a_batch_reads_and_writes_a_users_state_once():
    """However many instruments: each access to the state is a round trip between Python and the JVM."""
    value = Value()
    user = jobs._progress_processor([("m1", ["a", "b"]), ("m2", ["c"])])
    user.init(value)
    came = lambda *rows: [tuple(r) for r in user.handleInputRows(("u",), iter([Row(module_id=m, instrument_key=i, completed_us=us) for m, i, us in rows]), None)]
    first = came(("m1", "a", 5), ("m1", "a", 3), ("m1", None, 1), ("m2", "c", None), ("m2", "c", 0))
    assert first == [
        ("completion", "u", "m1", "a", 3, None, None, None, 1), ("completion", "u", "m2", "c", 0, None, None, None, 1),
        ("module", "u", "m1", None, None, 1, False, True, 1), ("module", "u", "m2", None, None, 2, True, False, 1),
    ]
    assert (value.reads, value.writes) == (1, 1)
    assert came(("m1", "a", 3), ("m2", "c", 9)) == [] and (value.reads, value.writes) == (2, 1)
    late = Value()
    user.init(late)
    user.handleInitialState(("u",), Row(user_id="u", done=[{"module_id": "m1", "instrument_key": "a", "us": 3}]), None)  # a struct comes as a dict
    assert [tuple(r)[:5] for r in user.handleInputRows(("u",), iter([Row(module_id="m1", instrument_key="a", completed_us=4)]), None)] == [("module", "u", "m1", None, None), ("module", "u", "m2", None, None)]
    user.init(value)
    assert came(("m1", "b", 7), ("m1", "a", 2))[2:] == [("module", "u", "m1", None, None, 1, True, True, 2), ("module", "u", "m2", None, None, 2, True, True, 2)]


def test_answers_of_a_stream_are_derived_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def seen(x):
        calls.add(1)
        return x

    as_stream(spark, spark.range(50).withColumn("y", seen("id")), [F.col("id") < 20, F.col("id") >= 20, F.col("id") >= 0])
    assert calls.value == 50


def unit_vectors(spark, n=300):
    u = F.array(F.cos(F.col("id").cast("double")), F.sin(F.col("id").cast("double")))
    return spark.range(n).select(F.col("id").alias("rep"), F.lit(1).cast("bigint").alias("n_copies"), u.alias("u"))


def test_a_vector_of_a_large_table_enters_no_more_buckets(spark):
    """Rows of the index grow with the vectors, not faster."""
    buckets = lambda n: pa.sign_keys(unit_vectors(spark, 3), 0.75, n).agg(F.max(F.size("keys"))).first()[0]
    assert buckets(1 << 10) < buckets(1 << 17) == buckets(10**8)


def test_blocks_of_all_pairs_are_not_shuffled_to_each_other(spark, monkeypatch):
    monkeypatch.setattr(cd, "BLOCK", 16)
    found = cd.pivot_pairs(unit_vectors(spark), 0.3)
    executed = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in executed and "collect_list" not in executed
    want = sum(math.cos(b - a) >= 0.3 for a in range(300) for b in range(a + 1, 300))
    assert found.select("a", "b").distinct().count() == found.count() == want


def test_texts_become_python_objects_a_few_at_a_time(spark):
    """Whatever the size of a batch."""
    import pyarrow

    batch = pyarrow.RecordBatch.from_pydict({"prompt": ["x" * 10] * 1000})
    handed = [p.num_rows for p in co._parts(iter([batch, batch]))]
    assert max(handed) <= 64 and sum(handed) == 2000
    docs = spark.range(500).select(F.col("id").alias("doc_order"), F.concat(F.lit("p"), "id").alias("participant_id"), F.lit("One two. Three four.").alias("content"))
    chunks = co.chunk_transcripts(docs, 2)
    asked = co.call_model(chunks, F.col("content"), lambda p: {"text": p.upper(), "error": None, "tokens_used": len(p)})
    assert asked.filter("reply = upper(content) AND tokens_used = char_count AND error IS NULL").count() == chunks.count() == 1000


def counted(spark, kind):
    """A column function that hands its values on, and how many it was given."""
    seen = spark.sparkContext.accumulator(0)

    def give(value):
        seen.add(1)
        return value

    return F.udf(give, kind).asNondeterministic(), seen


def test_a_text_is_encoded_once_and_linked_for_all_its_codes(spark):
    give, seen = counted(spark, "string")
    names = ["apple", "pear", "apple", "zero", "apples", "zero", "pear", "apple"]
    codes = spark.createDataFrame([(i + 1, n, "") for i, n in enumerate(names)], "code_id bigint, name string, description string")

    def encode(text):
        text = give(text)
        return F.array(*[(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in "apl"])

    links = an._code_links(codes, encode, 0.9).collect()
    assert {r["code_id"]: r["leader_id"] for r in links} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 1, 6: 6, 7: 2, 8: 1}
    assert seen.value == 4 * 6  # four texts; the function occurs twice per letter


def test_short_vectors_are_verified_where_they_meet(spark):
    rows = np.random.default_rng(3).normal(size=(400, 6)) + 1.2
    rows[200:] = rows[:200] + np.random.default_rng(4).normal(size=(200, 6)) * 0.1
    units = rows / np.linalg.norm(rows, axis=1)[:, None]
    df = spark.createDataFrame([(i, 1 + i % 3, u.tolist()) for i, u in enumerate(units)] + [(900, 1, [0.6, 0.8]), (901, 1, [0.6, 0.8])], "rep bigint, n_copies bigint, u array<double>")
    found = pa.indexed_pairs(df, 0.95)
    assert "Join" not in plan(found.select("a", "b", "similarity")).replace("LeftOuter", "").split("FlatMapGroupsInArrow")[0]  # no vector is fetched for a pair
    got = {(r["a"], r["b"]): r for r in found.collect()}
    sims = units @ units.T
    true = {(i, j) for i in range(400) for j in range(i + 1, 400) if sims[i, j] >= 0.95}
    assert len(got) == found.count() and set(got) <= true | {(900, 901)} and (900, 901) in got
    assert len(got) >= 0.99 * len(true) and len(true) > 200
    assert all(abs(r["similarity"] - sims[a, b]) < 1e-12 and (r["n_a"], r["n_b"]) == (1 + a % 3, 1 + b % 3) for (a, b), r in got.items() if a < 900)


def tables(spark, path) -> str:
    """A study of 40 users with 30 orders each."""
    n = 1200
    line = spark.range(n * 2).select(
        (F.col("id") % n).alias("l_orderkey"), (F.col("id") % 11).alias("l_partkey"), F.lit(1).cast("bigint").alias("l_suppkey"), (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"),
        (F.col("id") % 5).cast("double").alias("l_quantity"), F.col("id").cast("double").alias("l_extendedprice"), F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("id") % 3 + 1).cast("int")).alias("l_returnflag"),
        F.lit("1997-03-01").cast("timestamp_ntz").alias("l_shipdate"))
    line.write.parquet(f"{path}/lineitem.parquet")
    spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") % 40).alias("o_custkey")).write.parquet(f"{path}/orders.parquet")
    spark.range(40).select(F.col("id").alias("c_custkey"), (F.col("id") % 4).cast("int").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment")).write.parquet(f"{path}/customer.parquet")
    spark.range(4).select(F.col("id").cast("int").alias("n_nationkey"), F.concat(F.lit("NATION_"), F.col("id")).alias("n_name")).write.parquet(f"{path}/nation.parquet")
    return str(path)


def test_parts_of_answers_hold_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    """Merged by bytes, a part held ever more of the rows, which compress well."""
    sf = tables(spark, tmp_path)
    monkeypatch.setattr(core, "ROWS_PER_TASK", 100)
    means = sc.aggregate_construct_means(sc.construct_means(t.canonical(spark, sf), t.SURVEYS))
    assert means.rdd.getNumPartitions() == 24  # 2400 rows of the log
    assert means.count() > 0


def test_a_second_import_is_not_derived_again(spark, tmp_path, monkeypatch):
    sf, written = tables(spark, tmp_path), []
    real = sk.replace_partitions
    monkeypatch.setattr(sk, "replace_partitions", lambda df, path, *columns: (written.append(plan(df).count("Join")), real(df, path, *columns)))
    load_all()
    rows = {r["cohort_id"]: (r["n"], r["users"]) for r in QUERIES["replace_partitions"](spark, sf).collect()}
    assert written[0] > 0 and written[1:] == [0]
    canon = t.canonical(spark, sf).filter("cohort_id IS NOT NULL AND (cohort_id NOT IN ('NATION_1', 'NATION_2') OR module_id = 'module_1')")
    assert rows == {r["cohort_id"]: (r["n"], r["users"]) for r in canon.groupBy("cohort_id").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).collect()}


def test_indices_derive_the_answers_once(spark, tmp_path, monkeypatch):
    sf, made = tables(spark, tmp_path), []
    real = t.canonical
    monkeypatch.setattr(t, "canonical", lambda *a: (made.append(1), real(*a))[1])
    spark.range(40).select(F.col("id").alias("event_id"), F.col("id").alias("user_id"), F.lit("click").alias("event_type"), F.lit(2.0).alias("value"), F.lit('{"k": 3}').alias("props")).write.parquet(f"{sf}/events.parquet")
    load_all()
    assert QUERIES["cpi_plus"](spark, sf).count() == 40 and len(made) == 1


def test_an_import_is_cleaned_once_and_its_groups_are_not_joined(spark):
    give, seen = counted(spark, "string")
    rows = [(f"user{i % 7}", "module_1", "module1_x", f"Q{i % 3}", "a", "1", "k", f"C{i % 2}") for i in range(42)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in va.REQUIRED_IMPORT)).withColumn("question_id", give("question_id"))
    demographics = spark.createDataFrame([], "user_id string, grade string, gender string, first_language_english string")
    known = spark.createDataFrame([("user3 ",), ("user3",), ("other",), (None,)], "user_id string")
    found = {r["check"]: (r["n"], r["sample"]) for r in va.validate_import(df, demographics, known, ["C1"]).collect()}
    assert seen.value == 42
    assert found == {
        "id_of_platform_user": (1, ["user3"]), "user_in_several_cohorts": (7, [f"user{i}" for i in range(7)]), "cohort_already_registered": (1, ["C1"]),
        "duplicate_rows": (21, None), "no_demographics": (7, None),
    }


def test_a_model_reads_its_matrix_once(spark):
    give, seen = counted(spark, "double")
    rng = np.random.default_rng(5)
    rows = [(f"u{p}", f"Q{i}", float(rng.random() < 0.3 + 0.1 * i)) for p in range(60) for i in range(4)]
    matrix = spark.createDataFrame(rows, "user_id string, question_id string, item_score double").withColumn("item_score", give("item_score"))
    assert irt.fit_binary(matrix, "rasch", max_iter=3).n_persons == 60 and seen.value == 240
    items, _ = irt.item_difficulty_glmm(matrix, max_iter=3)
    assert items.count() == 4 and seen.value == 480


REQUIRED = [("m1", ["a", "b"]), ("m2", ["c"]), ("m4", []), ("m3", ["a"])]
ROWS_DDL = "user_id string, module_id string, instrument_key string, completed_us bigint"


def submitted(rng, n):
    pick = rng.choice
    return [(pick([None, "", "u", "v", "w"]), pick(["m1", "m2", "m3", "x", None, ""]), pick(["a", "b", "c", None]), pick([None, *range(-3, 9)])) for _ in range(n)]


def cells_of(rows):
    columns = dict(zip(["user_id", "module_id", "instrument_key"], zip(*[r[:3] for r in rows], strict=True), strict=True))
    batch = pyarrow.RecordBatch.from_pydict({
        "bucket": pyarrow.array([0] * len(rows), pyarrow.int32()), **{k: pyarrow.array(v, pyarrow.string()) for k, v in columns.items()},
        "completed_us": pyarrow.array([r[3] for r in rows], pyarrow.int64()),
    })
    return [cell for out in packed.pack(iter([batch])) for cell in out["cell"].to_pylist()]


def log_of(told):
    batch = pyarrow.RecordBatch.from_pylist([t.asDict() for t in told], pyarrow.schema([("completions", pyarrow.binary()), ("modules", pyarrow.binary())]))
    return [tuple(r.values()) for out in packed.unpack([m for m, _ in REQUIRED])(iter([batch])) for r in out.to_pylist()]


@pytest.mark.parametrize("seed", range(40))
def test_a_bucket_of_users_tells_what_its_users_told(seed):
    """NULL users, names and times, repeats, late answers, earlier completions; the state of all users is read and written once a batch."""
    rng = random.Random(seed)
    users, bucket = {u: Value() for u in (None, "", "u", "v", "w")}, Value()
    one, many = jobs._progress_processor(REQUIRED), jobs._unlock_processor(REQUIRED)
    many.init(bucket)
    first = {}
    for user, *name, us in submitted(rng, 12) if seed % 2 else ():
        if None not in name and us is not None:
            first.setdefault(user, {}).setdefault(tuple(name), []).append(us)
    for user, done in first.items():
        one.init(users[user])
        one.handleInitialState((user,), Row(user_id=user, done=[{"module_id": m, "instrument_key": i, "us": min(us)} for (m, i), us in done.items()]), None)
        for cell in cells_of([(user, *name, us) for name, times in done.items() for us in times]):
            many.handleInitialState((0,), Row(bucket=0, cell=cell), None)
    for _ in range(5):
        rows = submitted(rng, rng.choice([1, 3, 10]))
        want = []
        for user in {r[0] for r in rows}:
            one.init(users[user])
            came = [Row(module_id=m, instrument_key=i, completed_us=us) for u, m, i, us in rows if u == user]
            want += [tuple(r) for r in one.handleInputRows((user,), iter(came), None)]
        reads, writes = bucket.reads, bucket.writes
        cells = [cell for part in (rows[::2], rows[1::2]) if part for cell in cells_of(part)]
        told = list(many.handleInputRows((0,), iter([Row(bucket=0, cell=cell) for cell in cells]), None))
        assert sorted(log_of(told), key=repr) == sorted(want, key=repr)
        assert (bucket.reads - reads, bucket.writes - writes) == (1, int(bool(want)))


def test_unlocks_of_buckets_and_of_users(spark, tmp_path):
    """The same tables and the same log, with earlier completions, over two batches; state keys are buckets, however many users."""
    jobs.use_rocksdb(spark)
    raw = lambda rows: spark.createDataFrame(rows, "user_id string, instrument_name string, question_id string, response_value string, submitted_at timestamp")
    at = lambda day: dt.datetime(2024, 1, day)
    rows = [(f"u{i % 40}" if i % 41 else None, f"module{1 + i % 2}_t{i % 3}", "Q1", "A", at(2 + i * 7 % 20) if i % 13 else None) for i in range(300)]
    for k, part in enumerate((rows[:200], rows[150:])):
        raw(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    earlier = jobs.submissions(raw([("u1", "module1_t0", "Q1", "A", at(1)), ("new", "module2_t1", "Q1", "A", at(1))]))
    required = [("module_1", ["module1_t0", "module1_t2"]), ("module_2", ["module2_t1"])]
    logs = {}
    for buckets in (None, 3):
        stream = spark.readStream.schema(raw([]).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        path = f"{tmp_path}/out{buckets}"
        jobs.run_to_table(jobs.stream_unlocks(stream, required, earlier, buckets), path, f"{path}-ckpt", "update")
        logs[buckets] = spark.read.schema(jobs.PROGRESS_DDL).parquet(path)
        if buckets:
            assert spark.read.format("statestore").option("stateVarName", "state").load(f"{path}-ckpt").count() <= 3
    same = lambda of: sorted(map(tuple, of(logs[None]).collect()), key=repr) == sorted(map(tuple, of(logs[3]).collect()), key=repr)
    assert same(lambda log: log) and same(jobs.progress_of) and same(jobs.completions_of)
    assert logs[3].filter("user_id = 'u1' and instrument_key = 'module1_t0'").count() == 0  # known from the start
    assert logs[3].filter("user_id is null").count() and not logs[3].filter("user_id = 'new'").count()

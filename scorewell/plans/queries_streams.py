"""Streaming jobs drained over the given tables; their final tables equal the batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import materialize, shared_dir
from ..streaming import jobs
from ..streaming.tables import KeyedTable
from . import tables as t
from .queries_admin import PROGRESS, REQUIRED, ROLL
from .registry import ORACLES, query
from .sqltext import sql


ROWS_PER_FILE = 500_000


def as_stream(spark: SparkSession, df: DataFrame, slices: list, tail: DataFrame | None = None) -> DataFrame:
    """``df`` as a file stream of several micro-batches, one per slice condition.

    ``df`` is derived once and stored; a slice has as many files as the whole needs, two at least.
    """
    return _sliced(spark, materialize(df, "derived"), slices, tail)


def _sliced(spark: SparkSession, df: DataFrame, slices: list, tail: DataFrame | None = None) -> DataFrame:
    """``as_stream`` of a frame that is stored already."""
    folder = shared_dir(spark, "incoming")
    files = max(2, -(-df.count() // ROWS_PER_FILE))
    for condition in slices:
        df.filter(condition).repartition(files).write.mode("append").parquet(folder)
    if tail is not None:
        tail.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _incoming(spark, sf) -> DataFrame:
    when = F.col("submitted_at")
    cut = lambda d: F.lit(d).cast("timestamp_ntz")
    return as_stream(spark, t.responses(spark, sf), [when < cut("1997-01-01"), (when >= cut("1997-01-01")) & (when < cut("1999-01-01")), when >= cut("1999-01-01")])


@query(
    "stream_scores",
    sql("""WITH s AS (SELECT user_id, instrument_key, submitted_at, sum(item_score) AS score, count(*) AS n_answers FROM scored GROUP BY 1, 2, 3)
        SELECT user_id, instrument_key, max(submitted_at) AS submitted_at, arg_max(coalesce(score, -1), submitted_at) AS score, arg_max(n_answers, submitted_at) AS n_answers FROM s GROUP BY 1, 2""", "scored"),
)
def _(spark, sf):
    table = KeyedTable(spark, shared_dir(spark, "scores"), ["user_id", "instrument_key", "question_id"], "submitted_at")
    # every submission is split: odd and even questions arrive in different batches, one part of them twice
    odd = F.length("user_id") % 2 == F.substring("question_id", 2, 9).cast("int") % 2
    stream = as_stream(spark, t.responses(spark, sf), [odd, ~odd, odd & (F.col("question_id") < "Q4")])
    jobs.stream_scores(stream, t.rulebook(spark).rules, table, shared_dir(spark, "ckpt")).awaitTermination()
    return jobs.latest_totals(table.read()).withColumn("score", F.coalesce("score", F.lit(-1.0)))


COMPLETIONS = "SELECT user_id, concat('module_', CAST(module_num AS VARCHAR)) AS module_id, instrument_name AS instrument_key, min(submitted_at) AS completed_at FROM parsed GROUP BY 1, 2, 3"


@query("stream_completions", sql(COMPLETIONS, "parsed"))
def _(spark, sf):
    table = KeyedTable(spark, shared_dir(spark, "completions"), ["user_id", "module_id", "instrument_key"], "completed_at")
    jobs.stream_completions(_incoming(spark, sf), table, shared_dir(spark, "ckpt")).awaitTermination()
    return table.read().withColumn("completed_at", F.col("completed_at").cast("timestamp_ntz"))


@query("stream_completions_bounded", sql("SELECT DISTINCT user_id, concat('module_', CAST(module_num AS VARCHAR)) AS module_id, instrument_name AS instrument_key FROM parsed", "parsed"))
def _(spark, sf):
    table = KeyedTable(spark, shared_dir(spark, "completions"), ["user_id", "module_id", "instrument_key"], "completed_at")
    jobs.stream_completions(_incoming(spark, sf), table, shared_dir(spark, "ckpt"), "30 days").awaitTermination()
    return table.read().select("user_id", "module_id", "instrument_key")


@query(
    "stream_progress",
    sql(f"""WITH {PROGRESS} SELECT user_id, concat('module_', CAST(m AS VARCHAR)) AS module_id, CAST(m AS INT) AS position, complete,
        CASE WHEN m = 1 THEN true ELSE lag(complete) OVER (PARTITION BY user_id ORDER BY m) END AS unlocked FROM st""", "parsed"),
)
def _(spark, sf):
    done = KeyedTable(spark, shared_dir(spark, "completions"), ["user_id", "module_id", "instrument_key"], "completed_at")
    state = KeyedTable(spark, shared_dir(spark, "progress"), ["user_id", "module_id"], "as_of")
    jobs.stream_progress(_incoming(spark, sf), done, state, REQUIRED, shared_dir(spark, "ckpt")).awaitTermination()
    return state.read().drop("as_of")


def _unlocks(spark, r: DataFrame, earlier: bool = False) -> DataFrame:
    """The log of ``stream_unlocks`` over stored answers that come out of order, and some of them twice."""
    jobs.use_rocksdb(spark)
    when, cut = F.col("submitted_at"), lambda d: F.lit(d).cast("timestamp_ntz")
    odd = F.substring("question_id", 2, 9).cast("int") % 2 == 1
    slices = [(when >= cut("1997-01-01")) & odd, when < cut("1998-01-01"), (when >= cut("1997-01-01"))]
    stream = _sliced(spark, r, slices[1:] if earlier else slices)
    start = jobs.submissions(r.filter(slices[0])) if earlier else None
    path = shared_dir(spark, "unlocks")
    jobs.run_to_table(jobs.stream_unlocks(stream, REQUIRED, start), path, shared_dir(spark, "ckpt"), "update")
    return spark.read.schema(jobs.PROGRESS_DDL).parquet(path)


@query("stream_unlocks", ORACLES["stream_progress"])
def _(spark, sf):
    return jobs.progress_of(_unlocks(spark, materialize(t.responses(spark, sf), "derived")))


@query("stream_unlocks_resumed", sql(COMPLETIONS, "parsed"))
def _(spark, sf):
    """State that starts with earlier completions; with those, the log has every first submission."""
    r = materialize(t.responses(spark, sf), "derived")
    odd = F.substring("question_id", 2, 9).cast("int") % 2 == 1
    known = jobs.submissions(r.filter((F.col("submitted_at") >= F.lit("1997-01-01").cast("timestamp_ntz")) & odd))
    both = known.unionByName(jobs.completions_of(_unlocks(spark, r, earlier=True)))
    first = both.groupBy("user_id", "module_id", "instrument_key").agg(F.min("completed_at").alias("completed_at"))
    return first.withColumn("completed_at", F.col("completed_at").cast("timestamp_ntz"))


@query("stream_lockouts", "WITH " + ROLL.format(us=172_800_000_000).replace("SELECT user_id, event_id, ts, failed, n_failures, n_failures >= 3", "SELECT user_id, event_id, ts, n_failures, n_failures >= 3"))
def _(spark, sf):
    jobs.use_rocksdb(spark)
    e = t.table(spark, sf, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("failed"))
    # a heartbeat of no user moves the watermark past the last attempts
    beat = e.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("bigint").alias("user_id"), F.lit(-1).cast("bigint").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 60 DAYS")).alias("ts"), F.lit(False).alias("failed"))
    half = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    stream = as_stream(spark, e, [half, ~half], beat)
    path = shared_dir(spark, "lockouts")
    jobs.run_to_table(jobs.stream_lockouts(stream, 172_800, 3, 172_800), path, shared_dir(spark, "ckpt"))
    out = spark.read.parquet(path).filter("user_id >= 0")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("first_failure", F.col("first_failure").cast("timestamp_ntz"))

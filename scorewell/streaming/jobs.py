"""Structured Streaming jobs: scores, completions, progress and lockouts as data arrive."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..core import last_row, ship_package
from ..functions.text import infer_module
from ..operators.canonical import normalize_schema
from ..operators.progress import module_progress
from ..operators.scoring import score_items
from . import packed
from .tables import KeyedTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest_totals(answers: DataFrame) -> DataFrame:
    """Score of the latest submission per (user, instrument) from scored answers."""
    last = answers.groupBy("user_id", "instrument_key").agg(F.max("submitted_at").alias("submitted_at"))
    return answers.join(last, ["user_id", "instrument_key", "submitted_at"]).groupBy("user_id", "instrument_key", "submitted_at").agg(
        F.sum("item_score").alias("score"), F.count(F.lit(1)).alias("n_answers")
    )


def stream_scores(responses: DataFrame, rules: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Score answers on arrival; ``latest_totals`` of the table is the latest score per (user, instrument).

    The table is keyed by (user, instrument, question) and keeps the latest answer, so a submission whose answers arrive in
    several batches, late or twice adds up to the same score as in one batch.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        scored = score_items(normalize_schema(batch), rules)
        table.upsert(scored.select("user_id", "instrument_key", "question_id", "submitted_at", "item_score"), batch_id)

    return responses.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def submissions(responses: DataFrame) -> DataFrame:
    """(user_id, module_id, instrument_key, completed_at) of raw answers; a ``moduleN`` prefix names the module, else it is inferred."""
    module = F.concat(F.lit("module_"), F.regexp_extract("instrument_key", r"^module(\d+)", 1))
    named = F.when(F.col("instrument_key").rlike(r"^module\d+"), module).otherwise(infer_module(F.col("instrument_key")))
    return normalize_schema(responses).select("user_id", named.alias("module_id"), "instrument_key", F.col("submitted_at").cast("timestamp").alias("completed_at"))


def stream_completions(responses: DataFrame, table: KeyedTable, checkpoint: str, watermark: str | None = None) -> StreamingQuery:
    """Record each (user, module, instrument) once, at its first submission.

    With a watermark, repeats inside it are dropped in bounded state before they reach the table; the
    table itself ignores keys it already has.
    """
    df = submissions(responses)
    keys = ["user_id", "module_id", "instrument_key"]
    if watermark:
        df = df.withWatermark("completed_at", watermark).dropDuplicatesWithinWatermark(keys)
    return df.writeStream.foreachBatch(table.insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_progress(responses: DataFrame, completions: KeyedTable, progress: KeyedTable, required: Sequence[tuple[str, Sequence[str]]], checkpoint: str) -> StreamingQuery:
    """Completions plus the unlock state of the users a batch touches."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = submissions(batch)
        completions.insert(rows, batch_id)
        done = completions.read()
        if done is None:
            return
        touched = done.join(rows.select("user_id").distinct(), "user_id", "left_semi")
        state = module_progress(touched, required).withColumn("as_of", F.lit(batch_id).cast("bigint"))
        progress.upsert(state, batch_id)

    return responses.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PROGRESS_DDL = "kind string, user_id string, module_id string, instrument_key string, completed_us bigint, position int, complete boolean, unlocked boolean, version bigint"


def _progress_processor(required: Sequence[tuple[str, Sequence[str]]]) -> StatefulProcessor:
    """In this function for the same reason as ``_bucket_processor``."""
    told = Row(*[column.split()[0] for column in PROGRESS_DDL.split(", ")])

    class ProgressProcessor(StatefulProcessor):
        """One user's first submission per (module, instrument), and what follows for the modules."""

        def __init__(self, required):
            self.required = [(module, sorted(set(instruments))) for module, instruments in required]

        def init(self, handle: StatefulProcessorHandle) -> None:
            # one value, read and written once a batch: every access is a round trip to the JVM
            self.state = handle.getValueState("state", "modules array<string>, instruments array<string>, us array<bigint>, version bigint")

        def handleInitialState(self, key, initialState: Row, timerValues) -> None:
            found = initialState.done
            self.state.update(([d["module_id"] for d in found], [d["instrument_key"] for d in found], [d["us"] for d in found], 0))

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            least: dict[tuple, int] = {}
            for row in rows:
                name, us = (row.module_id, row.instrument_key), row.completed_us
                if None not in name and us is not None and us < least.get(name, us + 1):
                    least[name] = us
            modules, instruments, times, n = self.state.get() or ([], [], [], 0)
            done = dict(zip(zip(modules, instruments), times))
            new = {name: us for name, us in least.items() if us < done.get(name, us + 1)}
            if not new and n:
                return
            done.update(new)
            n += 1
            self.state.update(([m for m, _ in done], [i for _, i in done], list(done.values()), n))
            for (module, instrument), us in new.items():
                yield told("completion", key[0], module, instrument, us, None, None, None, n)
            open_ = True
            for position, (module, wanted) in enumerate(self.required, 1):
                complete = bool(wanted) and all((module, w) in done for w in wanted)
                yield told("module", key[0], module, None, None, position, complete, open_, n)
                open_ = complete

        def close(self) -> None:
            pass

    return ProgressProcessor(required)


UNLOCK_BUCKETS = 1024


def _unlock_processor(required: Sequence[tuple[str, Sequence[str]]]) -> StatefulProcessor:
    """What ``_progress_processor`` does, for all users of a bucket at a time; in this function for the same reason."""
    told = Row(*[column.split()[0] for column in packed.TOLD_DDL.split(", ")])
    state_ddl = packed.STATE_DDL

    class UnlockProcessor(StatefulProcessor):
        """The first submissions of a bucket's users as one value, and what a batch changes as one row of cells."""

        def __init__(self, required):
            self.required = [(module, sorted(set(instruments))) for module, instruments in required]

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("state", state_ddl)

        def handleInitialState(self, key, initialState: Row, timerValues) -> None:
            from scorewell.streaming.packed import start

            self.state.update(start(self.state.get(), initialState.cell))

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            from scorewell.streaming.packed import merge

            found = merge(self.state.get(), [row.cell for row in rows], self.required)
            if found:
                self.state.update(found[0])
                yield told(*found[1:])

        def close(self) -> None:
            pass

    return UnlockProcessor(required)


def stream_unlocks(
    responses: DataFrame, required: Sequence[tuple[str, Sequence[str]]], earlier: DataFrame | None = None, buckets: int | None = UNLOCK_BUCKETS
) -> DataFrame:
    """Completions and module states as a stream, from state kept of every user; no table is read.

    Each batch brings, for the users it changes, ``completion`` rows (new, or earlier than known) and a ``module`` row per module
    under a higher version, so repeated answers bring nothing and late ones correct what was said. ``completions_of`` and
    ``progress_of`` read the rows as tables. A user's state is as large as the instruments. ``earlier`` are completions
    (user_id, module_id, instrument_key, completed_at) that the state starts with. Needs the RocksDB state store.

    Users are dealt into ``buckets``, a number that stays for the life of a checkpoint: a batch reads and writes the state of a
    bucket it touches once, as a whole. With None each user has a state of its own, read and written apart, in rows: that is
    less to write if a batch touches few of very many users, and much slower if it touches most.
    """
    timed = lambda df: df.select(F.col("user_id").cast("string").alias("user_id"), "module_id", "instrument_key", F.unix_micros(F.col("completed_at").cast("timestamp")).alias("completed_us"))
    came, start, first = timed(submissions(responses)), None, None
    names = ["user_id", "module_id", "instrument_key"]
    if earlier is not None:
        first = timed(earlier).dropna(subset=[*names[1:], "completed_us"]).groupBy(*names).agg(F.min("completed_us").alias("us"))
    if buckets is None:
        if first is not None:  # a row per user
            start = first.groupBy("user_id").agg(F.collect_list(F.struct("module_id", "instrument_key", "us")).alias("done")).groupBy("user_id")
        return came.groupBy("user_id").transformWithState(_progress_processor(required), PROGRESS_DDL, "Update", "None", start)
    ship_package(responses.sparkSession)
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int").alias("bucket")
    if first is not None:  # few cells per bucket
        dealt = first.select(bucket, *names, F.col("us").alias("completed_us")).repartition("bucket").sortWithinPartitions("bucket")
        start = dealt.mapInArrow(packed.pack, packed.PACKED_DDL).groupBy("bucket")
    cells = came.select(bucket, *names, "completed_us").mapInArrow(packed.pack, packed.PACKED_DDL)
    told = cells.groupBy("bucket").transformWithState(_unlock_processor(required), packed.TOLD_DDL, "Update", "None", start)
    return told.mapInArrow(packed.unpack([module for module, _ in required]), PROGRESS_DDL)


def completions_of(log: DataFrame) -> DataFrame:
    first = log.filter("kind = 'completion'").groupBy("user_id", "module_id", "instrument_key").agg(F.min("completed_us").alias("us"))
    return first.select("user_id", "module_id", "instrument_key", F.timestamp_micros("us").alias("completed_at"))


def progress_of(log: DataFrame) -> DataFrame:
    return last_row(log.filter("kind = 'module'"), ["user_id", "module_id"], [F.col("version")], ["position", "complete", "unlocked"])


def _bucket_processor(window_us: int, bucket_us: int) -> StatefulProcessor:
    """The processor class lives in this function so that it travels by value: the streaming runner of
    the driver does not see files added for executors."""

    class BucketProcessor(StatefulProcessor):
        """Answers the attempts of one (user, time bucket) as they come, from the failures seen so far."""

        def __init__(self, window_us: int, bucket_us: int):
            self.window_us, self.bucket_us = window_us, bucket_us

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.fails = handle.getListState("fails", "us bigint")
            self.timer = handle.getValueState("timer", "at bigint")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            came = pd.concat(list(rows))
            new = came.loc[came["failed"], "us"]
            if len(new):
                self.fails.appendList([(int(u),) for u in new])
            if not self.timer.exists():
                at = (int(key[1]) + 1) * self.bucket_us // 1000
                self.timer.update((at,))
                self.handle.registerTimer(at)
            fails = pd.Series([r[0] for r in self.fails.get()], dtype="int64").sort_values().to_numpy()
            mine = came[came["home"]].sort_values("us")
            times = mine["us"].to_numpy(dtype="int64")
            low = fails.searchsorted(times - self.window_us, side="left")
            high = fails.searchsorted(times, side="right")
            first = [int(fails[l]) if h > l else -1 for l, h in zip(low, high)]
            yield pd.DataFrame({"user_id": int(key[0]), "event_id": mine["event_id"].to_numpy(), "us": times, "n_failures": high - low, "first_us": first}).astype("int64")

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.fails.clear()
            self.timer.clear()
            yield pd.DataFrame({"user_id": [], "event_id": [], "us": [], "n_failures": [], "first_us": []}).astype("int64")

        def close(self) -> None:
            pass

    return BucketProcessor(window_us, bucket_us)


def stream_lockouts(attempts: DataFrame, window_s: int = 300, threshold: int = 3, lock_s: int = 300, watermark: str = "10 minutes") -> DataFrame:
    """Rolling failures per attempt as a stream: ``user_id bigint, event_id, ts, failed`` in.

    An attempt is answered in the micro-batch that brings it, so a lock is known at the failure that causes it; an attempt
    that comes late is counted from then on, but answers already given stay. State is keyed by (user, time bucket) with
    look-back copies, so a hot user spreads over tasks, and is dropped when the watermark has passed the bucket. Needs the
    RocksDB state store.
    """
    bucket_us = max(4 * window_s, 3600) * 1_000_000
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    df = attempts.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "failed").withWatermark("ts", watermark)
    df = df.withColumn("us", us).withColumn("bucket", F.floor(F.col("us") / bucket_us))
    tail = F.col("failed") & (F.col("us") >= (F.col("bucket") + 1) * bucket_us - window_s * 1_000_000)
    df = df.withColumn("home", F.explode(F.when(tail, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    df = df.withColumn("bucket", F.when(F.col("home"), F.col("bucket")).otherwise(F.col("bucket") + 1))
    out = df.groupBy("user_id", "bucket").transformWithStateInPandas(
        _bucket_processor(window_s * 1_000_000, bucket_us),
        "user_id bigint, event_id bigint, us bigint, n_failures bigint, first_us bigint", "Append", "eventTime",
    )
    left = F.floor((F.col("first_us") + lock_s * 1_000_000 - F.col("us")) / 1_000_000)
    some = F.col("n_failures") > 0
    return out.select(
        "user_id", "event_id", F.timestamp_micros("us").alias("ts"), "n_failures", (F.col("n_failures") >= threshold).alias("locked"),
        F.when(some, F.timestamp_micros("first_us")).alias("first_failure"), F.when(some, F.greatest(F.lit(0), left)).otherwise(0).cast("bigint").alias("remaining_seconds"),
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain a stream into a Parquet table that only grows; rows of an update stream go into a folder per batch, so a batch
    that runs twice writes the same folder."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}"))
    query = writer.start()
    query.awaitTermination()


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

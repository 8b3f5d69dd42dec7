"""Keyed writes over Parquet tables: upsert, insert-if-absent, partition replacement, deletion, results.

Each function returns the new content (or writes a partition); a caller that keeps a table current
writes it to a new folder and repoints, since Parquet files are never changed in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import first_row, last_row


def upsert_latest(existing: DataFrame | None, incoming: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Latest row per key over old and new rows; on equal times the incoming row wins."""
    columns = [c for c in incoming.columns if c not in keys]
    fresh = incoming.withColumn("_new", F.lit(1))
    both = fresh if existing is None else existing.select(*incoming.columns).withColumn("_new", F.lit(0)).unionByName(fresh)
    return last_row(both, keys, [F.col(ts), F.col("_new")], columns).select(*incoming.columns)


def insert_if_absent(existing: DataFrame | None, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Existing rows plus the first new row of every key they lack."""
    columns = [c for c in incoming.columns if c not in keys]
    first = first_row(incoming, keys, [F.col(order)], columns).select(*incoming.columns)
    if existing is None:
        return first
    return existing.unionByName(first.join(existing.select(*keys), list(keys), "left_anti"))


def replace_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Overwrite exactly the partitions that occur in ``df``; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def delete_where(df: DataFrame, user: str | None = None, instrument: str | None = None, instrument_column: str = "instrument_key") -> DataFrame:
    """Rows that survive deleting a user, an instrument, one user's instrument, or (neither given) all."""
    hit: Column = F.lit(True)
    if user is not None:
        hit = hit & (F.col("user_id") == user)
    if instrument is not None:
        hit = hit & (F.col(instrument_column) == instrument)
    return df.filter(~F.coalesce(hit, F.lit(False)))


def delete_users(df: DataFrame, users: DataFrame) -> DataFrame:
    return df.join(users.select("user_id").distinct(), "user_id", "left_anti")


def delete_cohort_rows(df: DataFrame, cohort: str) -> tuple[DataFrame, DataFrame]:
    """(surviving rows, one-row count of the deleted ones)."""
    hit = F.coalesce(F.col("cohort_id") == cohort, F.lit(False))
    return df.filter(~hit), df.agg(F.count_if(hit).alias("n_deleted"))


def rename_cohort(users: DataFrame, transcripts: DataFrame, registry: DataFrame, old: str, new: str) -> dict[str, DataFrame]:
    """New content of the three tables and a one-row report; refuses to merge into an existing cohort."""
    old, new = old.strip(), new.strip()
    taken = registry.agg(F.coalesce(F.bool_or(F.col("cohort_id") == new), F.lit(False)).alias("_taken"))
    reason = F.when(F.lit(not old or not new), "both ids are required").when(F.lit(old == new), "same id").when(
        F.col("_taken"), "target cohort already exists"
    )
    # one aggregated row decides for all tables
    ok = F.broadcast(taken.select(reason.isNull().alias("_ok"), reason.alias("reason")))

    def renamed(df: DataFrame) -> DataFrame:
        moved = F.when(F.col("_ok") & (F.col("cohort_id") == old), F.lit(new)).otherwise(F.col("cohort_id"))
        return df.join(ok).withColumn("cohort_id", moved).select(*df.columns)

    def hits(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count_if(F.col("cohort_id") == old).alias(name))

    report = ok.join(hits(users, "users")).join(hits(transcripts, "transcripts")).select(
        F.col("_ok").alias("renamed"), "reason", F.when(F.col("_ok"), F.col("users")).otherwise(0).alias("users"),
        F.when(F.col("_ok"), F.col("transcripts")).otherwise(0).alias("transcripts"),
    )
    return {"users": renamed(users), "transcripts": renamed(transcripts), "registry": renamed(registry), "report": report}


def export_canonical_csv(canonical: DataFrame, path: str) -> None:
    """All rows ordered by user, instrument, question: a range-partitioned sort, one file per range."""
    canonical.orderBy("user_id", "instrument_key", "question_id").write.mode("overwrite").option("header", True).csv(path)


def save_results(df: DataFrame, path: str, run_id: Column, phase: Column) -> None:
    """Results as JSON payloads, partitioned by run and phase; saving a phase again replaces that phase of that run only."""
    payload = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    replace_partitions(df.select(run_id.alias("run_id"), phase.alias("phase"), payload.alias("payload")), path, "run_id", "phase")


def load_results(spark: SparkSession, path: str, schema: str, run_id: str | None = None, phase: int | None = None) -> DataFrame:
    df = spark.read.schema("payload string, run_id string, phase int").parquet(path)
    if run_id is not None:
        df = df.filter(F.col("run_id") == run_id)
    if phase is not None:
        df = df.filter(F.col("phase") == phase)
    return df.select("run_id", "phase", F.from_json("payload", schema).alias("r")).select("run_id", "phase", "r.*")


def run_registry(results: DataFrame) -> DataFrame:
    """One row per run: phases saved, last phase, rows."""
    return results.groupBy("run_id").agg(
        F.count_distinct("phase").alias("n_phases"), F.max("phase").alias("last_phase"), F.count(F.lit(1)).alias("n_rows")
    )

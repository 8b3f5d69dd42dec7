"""User, cohort and log administration as queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import last_row
from .ordered import ordinal_rank


def users_by(users: DataFrame, cohort: str | None = None, status: str | None = None) -> DataFrame:
    df = users
    if cohort is not None:
        df = df.filter(F.col("cohort_id") == cohort)
    if status is not None:
        df = df.filter(F.col("status") == status)
    return df.orderBy("user_id")


def cohort_list(users: DataFrame) -> DataFrame:
    return users.select("cohort_id").filter(F.col("cohort_id").isNotNull()).distinct().orderBy("cohort_id")


def zero_data_users(users: DataFrame, *facts: DataFrame) -> DataFrame:
    """Users without a row in any fact table."""
    seen = facts[0].select("user_id")
    for f in facts[1:]:
        seen = seen.unionByName(f.select("user_id"))
    return users.join(seen.distinct(), "user_id", "left_anti")


def footprint(facts: dict[str, DataFrame], by_instrument: bool = True) -> DataFrame:
    """Rows per fact table for every user [and instrument], one column per table."""
    keys = ["user_id", "instrument_key"] if by_instrument else ["user_id"]
    parts = None
    for name, df in facts.items():
        counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.lit(name))
        parts = counted if parts is None else parts.unionByName(counted)
    return parts.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("t") == name, F.col("n"))), F.lit(0)).alias(name) for name in facts])


def cohort_usage(cohorts: DataFrame, users: DataFrame, transcripts: DataFrame) -> DataFrame:
    """References to each cohort and whether it may be deleted (none left)."""
    u = users.groupBy("cohort_id").agg(F.count(F.lit(1)).alias("users"))
    tr = transcripts.groupBy("cohort_id").agg(F.count(F.lit(1)).alias("transcripts"))
    df = cohorts.select("cohort_id").distinct().join(u, "cohort_id", "left").join(tr, "cohort_id", "left").na.fill(0)
    return df.withColumn("deletable", (F.col("users") == 0) & (F.col("transcripts") == 0))


def delete_cohorts(registry: DataFrame, users: DataFrame, transcripts: DataFrame, wanted: list[str]) -> DataFrame:
    """The registry with ``deleted`` and ``reason`` per cohort: a wanted cohort goes only if nothing refers to it."""
    usage = cohort_usage(registry, users, transcripts).select("cohort_id", "deletable")
    asked = F.col("cohort_id").isin([w.strip() for w in wanted])
    return usage.select("cohort_id", (asked & F.col("deletable")).alias("deleted"), F.when(asked & ~F.col("deletable"), "in use").alias("reason"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def role_counts(users: DataFrame, roles: Sequence[str]) -> DataFrame:
    return users.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("role") == r).alias(r) for r in roles])


def import_summary(canonical: DataFrame) -> DataFrame:
    """Per cohort: students, rows, modules."""
    return canonical.groupBy("cohort_id").agg(
        F.count_distinct("user_id").alias("students"), F.count(F.lit(1)).alias("rows"), F.count_distinct("module_id").alias("modules")
    )


def list_imports(imported: DataFrame) -> DataFrame:
    return imported.groupBy("cohort_id").agg(
        F.count_distinct("user_id").alias("students"), F.count(F.lit(1)).alias("rows"),
        F.max("import_batch").alias("import_batch"), F.max("imported_at").alias("imported_at"),
    )


def recent_log(log: DataFrame, ts: str, n: int, tie: str) -> DataFrame:
    """The n newest entries (a top-k, not a sort of the log)."""
    return log.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def recent_attempts(log: DataFrame, user: str, ts: str, tie: str, n: int = 10, slices: int = 64) -> DataFrame:
    """Per user the n newest entries.

    First the n newest per (user, slice), then per user among those: a hot user's history is ranked
    in ``slices`` tasks and the final window sees at most n x slices rows.
    """
    from pyspark.sql import Window as W

    newest = [F.desc(ts), F.desc(tie)]
    sliced = log.withColumn("_slice", F.pmod(F.xxhash64(F.col(ts), F.col(tie)), F.lit(slices)))
    first = sliced.withColumn("_r", F.row_number().over(W.partitionBy(user, "_slice").orderBy(*newest))).filter(F.col("_r") <= n)
    ranked = first.withColumn("position", F.row_number().over(W.partitionBy(user).orderBy(*newest)))
    return ranked.filter(F.col("position") <= n).drop("_slice", "_r")


def retain_newest(snapshots: DataFrame, keep: int, protected: Sequence[str]) -> DataFrame:
    """Flag snapshots to keep: the newest ``keep`` unprotected ones and every protected one."""
    safe = F.lit(False)
    for prefix in protected:
        safe = safe | F.col("timestamp").startswith(prefix)
    marked = snapshots.withColumn("protected", safe)
    newest = marked.filter(~F.col("protected")).select("timestamp").orderBy(F.desc("timestamp")).limit(keep)
    # at most ``keep`` rows
    return marked.join(F.broadcast(newest.withColumn("_top", F.lit(True))), "timestamp", "left").select(
        *snapshots.columns, "protected", (F.col("protected") | F.coalesce("_top", F.lit(False))).alias("kept")
    )


def snapshot_reconcile(before: dict[str, DataFrame], after: dict[str, DataFrame], backup: dict[str, DataFrame]) -> DataFrame:
    """Row counts per table before, after and in the backup; verified when after equals backup."""
    a = table_counts(before).withColumnRenamed("n", "n_before")
    b = table_counts(after).withColumnRenamed("n", "n_after")
    c = table_counts(backup).withColumnRenamed("n", "n_backup")
    df = a.join(b, "table_name", "full").join(c, "table_name", "full")
    return df.withColumn("verified", F.coalesce(F.col("n_after") == F.col("n_backup"), F.lit(False)))


def rolling_failures(attempts: DataFrame, user: str, ts: str, failed: str, window_s: int = 300, threshold: int = 3, lock_s: int = 300) -> DataFrame:
    """Per attempt: failures in the trailing window, locked flag, first failure, seconds left.

    A user's history is cut into time buckets of a few windows; each attempt is also copied into the
    next bucket as look-back, so a hot user's rows spread over many tasks and no window spans more
    than two buckets.
    """
    from pyspark.sql import Window as W

    bucket_us = max(4 * window_s, 3600) * 1_000_000
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    df = attempts.withColumn("_us", us).withColumn("_b", F.floor(F.col("_us") / bucket_us))
    # only failures late enough to be seen from the next bucket travel there
    tail = F.col(failed) & (F.col("_us") >= (F.col("_b") + 1) * bucket_us - window_s * 1_000_000)
    spread = df.withColumn("_home", F.explode(F.when(tail, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    spread = spread.withColumn("_b", F.when(F.col("_home"), F.col("_b")).otherwise(F.col("_b") + 1))
    w = W.partitionBy(user, "_b").orderBy("_us").rangeBetween(-window_s * 1_000_000, 0)
    fails = F.count(F.when(F.col(failed), 1)).over(w)
    first = F.min(F.when(F.col(failed), F.col("_us"))).over(w)
    out = spread.withColumn("n_failures", fails).withColumn("_first", first).filter("_home")
    locked = F.col("n_failures") >= threshold
    left = F.floor((F.col("_first") + lock_s * 1_000_000 - F.col("_us")) / 1_000_000)
    return out.select(
        *attempts.columns, "n_failures", locked.alias("locked"),
        F.timestamp_micros("_first").cast(dict(attempts.dtypes)[ts]).alias("first_failure"),
        F.when(F.col("n_failures") > 0, F.greatest(F.lit(0), left)).otherwise(F.lit(0)).cast("bigint").alias("remaining_seconds"),
    )


def draw_positions(user: Column, n: int, size: int, seed: int) -> Column:
    """``n`` different numbers below ``size`` in random order, the same for the same (seed, user), any set equally likely.

    The k-th draw is a hash modulo the numbers that are left; it becomes a number by skipping the drawn ones in order.
    """

    def draw(drawn: Column, k: Column) -> Column:
        digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), user, k.cast("string"))), 1, 12)
        start = F.conv(digits, 16, 10).cast("bigint") % (F.lit(size).cast("bigint") - k)
        return F.concat(drawn, F.array(F.aggregate(F.array_sort(drawn), start, lambda x, taken: x + F.when(taken <= x, 1).otherwise(0))))

    steps = F.sequence(F.lit(0), F.lit(min(n, size) - 1)) if min(n, size) > 0 else F.array().cast("array<int>")
    return F.aggregate(steps, F.array().cast("array<bigint>"), draw)


def question_draw(users: DataFrame, bank: DataFrame, n: int, mode: str = "random", ids: Sequence[str] | None = None, seed: int = 7) -> DataFrame:
    """Questions per user: ``random`` n of the bank, a ``fixed`` id list (those the bank has), or the ``first`` n.

    A random draw is n positions per user, made without the bank, and a join that looks them up, so work grows with the
    questions drawn and a bank may have any size.
    """
    listed = None
    if mode == "fixed" and ids:
        known = {r[0] for r in bank.filter(F.col("question_id").isin(list(ids))).select("question_id").distinct().collect()}  # at most ids
        listed = [q for q in ids if q in known]
    if mode != "random" and not listed:
        listed = [r["question_id"] for r in bank.orderBy("position").limit(n).select("question_id").collect()]  # n ids
    if listed is not None:
        drawn = users.select("user_id", F.posexplode(F.array(*[F.lit(q) for q in listed]).cast("array<string>")).alias("_p", "question_id"))
        return drawn.select("user_id", (F.col("_p") + 1).alias("position"), "question_id")
    places = ordinal_rank(bank.select("question_id", "position"), [], "position", "question_id", "_at").select((F.col("_at") - 1).cast("bigint").alias("_q"), "question_id")
    drawn = users.select("user_id", F.posexplode(draw_positions(F.col("user_id"), n, bank.count(), seed)).alias("_p", "_q"))
    return drawn.join(places, "_q").select("user_id", (F.col("_p") + 1).alias("position"), "question_id")


def latest_rows(df: DataFrame, keys: Sequence[str], run: str, order: Sequence[str]) -> DataFrame:
    """All rows that belong to the newest run of their key."""
    newest = last_row(df, keys, [F.col(o) for o in order], [run]).withColumnRenamed(run, "_run")
    return df.join(newest, list(keys)).filter(F.col(run) == F.col("_run")).drop("_run")

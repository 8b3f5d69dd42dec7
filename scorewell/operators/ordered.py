"""Ranks, running totals and exact quantiles without a single-task window.

``Window.orderBy`` with no (or a hot) partition key sorts everything in one task. Here rows are first
collapsed to one row per (group, value), dealt into value ranges (stored, so every later read sees the
same ones), totalled per range, and only then numbered inside each range with the total of the earlier
ranges as offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import materialize



def ranged(df: DataFrame, value: str, name: str = "ranged") -> DataFrame:
    """``df`` stored with ``_range``, the number of its value's range: ranges follow the order of any sortable type and hold
    about equally many rows. Their number is the session's shuffle partitions; storing pins which row is in which."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, value).withColumn("_range", F.spark_partition_id()), name)


def cumulative_histogram(df: DataFrame, by: Sequence[str], value: str, weight: Column | None = None, also: Column | None = None) -> DataFrame:
    """One row per (by, value): ``n`` rows there, ``n_before`` rows with a smaller value, ``n_total``.

    ``also`` is a second weight, summed in the same pass into ``m``, ``m_before`` and ``m_total``. The histogram is stored once: it is read several times below, and the input plan behind it must not run again.
    """
    by = list(by)
    sums = {"n": F.count(F.lit(1)) if weight is None else F.sum(weight)} | ({} if also is None else {"m": F.sum(also)})
    hist = ranged(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(*[x.alias(c) for c, x in sums.items()]), value, "histogram")
    per_range = hist.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_in_{c}") for c in sums])
    ordered, inside = W.partitionBy(*by).orderBy("_range"), W.partitionBy(*by, "_range").orderBy(value)
    offsets = per_range.select(
        *by, "_range", *[(F.sum(f"_in_{c}").over(ordered) - F.col(f"_in_{c}")).alias(f"_offset_{c}") for c in sums],
        *[F.sum(f"_in_{c}").over(W.partitionBy(*by)).alias(f"{c}_total") for c in sums],
    )
    local = hist.withColumns({f"_local_{c}": F.sum(c).over(inside) - F.col(c) for c in sums})
    joined = _join_null_safe(local, offsets, [*by, "_range"])
    return joined.select(*by, value, *[x for c in sums for x in (c, (F.col(f"_offset_{c}") + F.col(f"_local_{c}")).alias(f"{c}_before"), f"{c}_total")])


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] or [F.lit(True)]
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def average_rank(df: DataFrame, by: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Mid-rank of ``value`` within ``by`` (ties share their mean rank)."""
    hist = cumulative_histogram(df, by, value)
    ranks = hist.select(*by, value, "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias(out))
    return carry_back(df.filter(F.col(value).isNotNull()), ranks, [*by, value], out)


HOT_SHARE = 1000  # a value with more than one in so many rows is hot; there are at most so many hot values


def carry_back(df: DataFrame, facts: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """``df`` with the column ``out`` of ``facts``, which has one row per ``keys`` and the number ``n`` of its rows in ``df``.

    Hot keys, at most ``HOT_SHARE`` whatever the data, are looked up in a broadcast table; their rows then go through the join
    of the others scattered by a salt, so a key that holds a third of the rows is no single task.
    """
    total = facts.agg(F.sum("n")).first()[0] or 0
    hot = facts.filter(F.col("n") * HOT_SHARE > total).select(*keys, F.col(out).alias("_hot"))
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) + 1).otherwise(F.lit(0))
    told = _join_null_safe(df, F.broadcast(hot), keys, "left").withColumn("_salt", salt.cast("bigint"))
    others = facts.filter(F.col("n") * HOT_SHARE <= total).select(*keys, F.col(out).alias("_cold"), F.lit(0).cast("bigint").alias("_salt"))
    joined = _join_null_safe(told, others, [*keys, "_salt"], "left")
    return joined.withColumn(out, F.coalesce("_hot", "_cold")).drop("_hot", "_cold", "_salt")


def ordinal_rank(df: DataFrame, by: Sequence[str], value: str, tie: str, out: str = "position") -> DataFrame:
    """Distinct positions 1..n within ``by``, ordered by value, ties broken by md5(tie), tie.

    A tied value is numbered in 256 slices by the first md5 byte, so one hot value is not one task.
    """
    keyed = df.filter(F.col(value).isNotNull()).withColumn("_md5", F.md5(F.col(tie).cast("string")))
    keyed = materialize(keyed.withColumn("_slice", F.substring("_md5", 1, 2)), "keyed")
    cells = keyed.groupBy(*by, value, "_slice").agg(F.count(F.lit(1)).alias("_cell"))
    within = W.partitionBy(*by, value).orderBy("_slice")
    cells = cells.withColumn("_slice_before", F.sum("_cell").over(within) - F.col("_cell"))
    hist = cumulative_histogram(keyed, by, value).select(*by, value, "n_before", "n_total")
    offsets = _join_null_safe(cells, hist, [*by, value]).select(
        *by, value, "_slice", (F.col("n_before") + F.col("_slice_before")).alias("_before"), "n_total"
    )
    row = F.row_number().over(W.partitionBy(*by, value, "_slice").orderBy("_md5", tie))
    numbered = keyed.withColumn("_row", row)
    return (
        _join_null_safe(numbered, offsets, [*by, value, "_slice"])
        .withColumn(out, F.col("_before") + F.col("_row"))
        .drop("_md5", "_slice", "_row", "_before")
    )


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group: one row per group, one column per entry."""
    return quantiles_of(cumulative_histogram(df, by, value), by, value, probs)


def quantiles_of(hist: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """``quantiles`` of an existing cumulative histogram."""
    aggs = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col("n_total") - 1)
        for tag, index in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            holds = (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n"))
            aggs.append(F.max(F.when(holds, F.col(value))).alias(f"_{tag}_{name}"))
    picked = hist.groupBy(*by).agg(F.max("n_total").alias("_n"), *aggs)
    out = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    return picked.select(*by, *out)


def modes(df: DataFrame, by: Sequence[str], value: str, out: str = "mode") -> DataFrame:
    """Most frequent value per group; the smallest one on a tie."""
    return modes_of(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")), by, value, out)


def modes_of(hist: DataFrame, by: Sequence[str], value: str, out: str = "mode") -> DataFrame:
    """``modes`` of an existing histogram."""
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col(value).alias("v")))
    return hist.groupBy(*by).agg(best.alias("_b")).select(*by, F.col("_b.v").alias(out))


def running_total(df: DataFrame, order: str, weight: str, out: str) -> DataFrame:
    """Sum of ``weight`` over the rows with a smaller ``order`` (unique per row)."""
    rows = ranged(df, order)
    sums = rows.groupBy("_range").agg(F.sum(weight).alias("_sum"))
    # one row per range: the window over all of them is as long as the number of shuffle partitions
    offsets = sums.select("_range", (F.sum("_sum").over(W.orderBy("_range")) - F.col("_sum")).alias("_offset"))
    local = F.sum(weight).over(W.partitionBy("_range").orderBy(order)) - F.col(weight)
    return (
        rows.withColumn("_local", local)
        .join(F.broadcast(offsets), "_range")
        .withColumn(out, F.col("_offset") + F.col("_local"))
        .drop("_range", "_local", "_offset")
    )

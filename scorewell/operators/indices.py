"""Competency indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import round_clean, weighted_available
from ..functions.numbers import index_band, normalized_gain, sigmoid
from ..functions.text import matches_base
from .ordered import quantiles
from .scores import binary_items

EVIDENCE_SATURATION = 5.0  # fixed value: mean evidence count that counts as full


def quant_ctt(canonical: DataFrame, base: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Mean 0/1 score per user, or the level-weighted mean (an item without a weight counts 1)."""
    df = binary_items(canonical.filter(matches_base(F.col("instrument_key"), base)))
    if weights:
        table = F.create_map(*[x for q, w in weights.items() for x in (F.lit(q), F.lit(float(w)))])
        w = F.coalesce(F.try_element_at(table, F.col("question_id")), F.lit(1.0))
        value = F.try_divide(F.sum(F.col("item_score") * w), F.sum(w))
    else:
        value = F.avg("item_score")
    return df.groupBy("user_id").agg(round_clean(value, 4).alias("cpi_quant_ctt"), F.count(F.lit(1)).alias("n_items")).withColumn(
        "method", F.lit("CTT (weighted)" if weights else "CTT")
    )


def quant_irt(abilities: DataFrame) -> DataFrame:
    """Ability mapped to 0..1."""
    return abilities.select("user_id", "theta", "theta_se", round_clean(sigmoid(F.col("theta")), 4).alias("cpi_quant_irt"))


def outcome_index(
    scores: DataFrame,
    mcq_part: str,
    gains: Sequence[tuple[str, str, str]],
    weights: dict[str, float] | None = None,
    mcq_keys: Sequence[str] | None = None,
) -> DataFrame:
    """Mean test percentage and normalised pre-to-post gains, weights renormalised over what exists.

    ``scores`` are assessment scores; ``gains`` lists (name, pre part, post part).
    """
    key, pct = F.col("instrument_key"), F.col("pct_correct")
    is_mcq = key.contains(mcq_part)
    if mcq_keys is not None:
        is_mcq = is_mcq & key.isin(list(mcq_keys))
    aggs: list[Column] = [(F.avg(F.when(is_mcq, pct)) / 100).alias("cpi_mcq"), F.count_if(is_mcq).alias("n_modules_mcq")]
    for name, pre, post in gains:
        aggs += [F.avg(F.when(key.contains(pre), pct)).alias(f"_pre_{name}"), F.avg(F.when(key.contains(post), pct)).alias(f"_post_{name}")]
    df = scores.groupBy("user_id").agg(*aggs)
    parts = [(F.col("cpi_mcq"), (weights or {}).get("cpi_mcq", 1 / 3))]
    for name, _, _ in gains:
        df = df.withColumn(name, normalized_gain(F.col(f"_pre_{name}"), F.col(f"_post_{name}"), 100.0))
        parts.append((F.col(name), (weights or {}).get(name, 1 / 3)))
    df = df.withColumn("cpi_outcome", weighted_available(parts))
    rounded = [round_clean(c, 4).alias(c) for c in ("cpi_mcq", *[g[0] for g in gains], "cpi_outcome")]
    return df.select("user_id", *rounded, "n_modules_mcq")


def process_index(means: DataFrame, engagement_part: str, motivation_part: str, flipped: Sequence[str], w: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Survey means scaled from 1..4 to 0..1, negative constructs flipped once, weights renormalised."""
    key, m = F.lower("instrument_key"), F.col("mean_score")
    engaged = (F.avg(F.when(key.contains(engagement_part), m)) - 1) / 3
    turned = F.when(F.col("construct").isin(list(flipped)), 5 - m).otherwise(m)
    motivated = F.avg(F.when(key.contains(motivation_part), (turned - 1) / 3))
    df = means.groupBy("user_id").agg(engaged.alias("engagement_mean"), motivated.alias("motivation_mean"))
    index = weighted_available([(F.col("engagement_mean"), w[0]), (F.col("motivation_mean"), w[1])])
    return df.withColumn("cpi_process", index).select(
        "user_id", *[round_clean(c, 4).alias(c) for c in ("engagement_mean", "motivation_mean", "cpi_process")]
    )


def qual_rubric(rubric: DataFrame, max_per_question: float) -> DataFrame:
    """Sum of dimension scores over the maximum, per participant; rows with an error are left out.

    ``rubric`` is long: participant_id, question_id, dimension, score, error.
    """
    ok = rubric.filter(F.col("error").isNull())
    per_q = ok.groupBy("participant_id", "question_id").agg(F.sum("score").alias("s"))
    return per_q.groupBy(F.col("participant_id").alias("user_id")).agg(
        round_clean(F.sum("s") / (F.count(F.lit(1)) * max_per_question), 4).alias("cpi_qual"), F.count(F.lit(1)).alias("n_questions_scored")
    )


def qual_density(evidence: DataFrame) -> DataFrame:
    """Share of constructs with evidence times min(mean evidence / 5, 1), per participant."""
    n = evidence.agg(F.count_distinct("construct_name").alias("_k"))
    found = F.col("evidence_count") > 0
    df = evidence.groupBy("participant_id").agg(
        F.sum("evidence_count").alias("evidence_total"), F.count_if(found).alias("constructs_found"),
        F.avg(F.when(found, F.col("evidence_count"))).alias("_mean"),
    )
    density = F.col("constructs_found") / F.col("_k") * F.least(F.col("_mean") / EVIDENCE_SATURATION, F.lit(1.0))
    return df.join(F.broadcast(n)).select(
        F.col("participant_id").alias("user_id"), "evidence_total", "constructs_found",
        round_clean(F.coalesce(density, F.lit(0.0)), 4).alias("cpi_qual"),
    )


def combined_index(quant: DataFrame, qual: DataFrame, column: str = "cpi_quant_ctt", w1: float = 0.5, w2: float = 0.5) -> DataFrame:
    """Fixed-weight sum of both parts per user (full outer); NULL when a part is missing."""
    if abs(w1 + w2 - 1) > 1e-6:
        raise ValueError("the two weights must sum to 1")
    df = quant.select("user_id", F.col(column).alias("cpi_quant")).join(qual.select("user_id", "cpi_qual"), "user_id", "full")
    return df.withColumn("cpi_plus", round_clean(w1 * F.col("cpi_quant") + w2 * F.col("cpi_qual"), 4)).withColumn("w1", F.lit(w1)).withColumn("w2", F.lit(w2))


def plus_index(outcome: DataFrame, process: DataFrame, qual: DataFrame, w: tuple[float, float, float] = (1 / 3, 1 / 3, 1 / 3)) -> DataFrame:
    """Three-part index over a full outer join, weights renormalised over the parts present, with band."""
    df = outcome.join(process, "user_id", "full").join(qual, "user_id", "full")
    parts = [(F.col(c), x) for c, x in zip(("cpi_outcome", "cpi_process", "cpi_qual"), w)]
    return df.withColumn("cpi_plus", round_clean(weighted_available(parts), 4)).withColumn("band", index_band(F.col("cpi_plus")))


def index_summary(df: DataFrame, columns: Sequence[str] = ("cpi_quant", "cpi_qual", "cpi_plus")) -> DataFrame:
    """Mean, median, sd (0 for one value), min, max, n per index column."""
    columns = [c for c in columns if c in df.columns]
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "index_name", "v").filter(F.col("v").isNotNull())
    base = long.groupBy("index_name").agg(
        F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("n")
    )
    out = base.join(quantiles(long, ["index_name"], "v", {"median": 0.5}), "index_name")
    return out.select("index_name", *[round_clean(c, 3).alias(c) for c in ("mean", "median", "sd", "min", "max")], "n")

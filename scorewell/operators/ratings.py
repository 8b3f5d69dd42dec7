"""Model and human ratings of items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import strip
from .registry import latest_rows

ITEM = ("instrument_key", "question_id", "item_hash")


def latest_suggestion(results: DataFrame, by_model: bool = True) -> DataFrame:
    """Per item [and model], the blind ratings of its newest successful run: levels and their spread.

    A run rates an item a handful of times (repeats are capped by the caller), so the level list is
    short by construction.
    """
    keys = [*ITEM, *(["model"] if by_model else [])]
    ok = results.filter(F.col("ok") & (F.col("step") == "blind"))
    rows = latest_rows(ok, keys, "run_id", ["created_at", "id"])
    level = F.col("bloom_level")
    return rows.groupBy(*keys).agg(
        F.max("run_id").alias("run_id"), F.count(F.lit(1)).alias("n_runs"), F.sort_array(F.collect_list(level)).alias("levels"),
        F.median(level).alias("level_median"), F.min(level).alias("level_min"), F.max(level).alias("level_max"),
        F.bool_or("needs_figure").alias("needs_figure"), F.bool_and("blind_matches_key").alias("blind_matches_key"),
    )


def latest_key_review(results: DataFrame) -> DataFrame:
    """Newest successful key review per item."""
    from ..core import last_row, strip

    ok = results.filter(F.col("ok") & (F.col("step") == "key"))
    return last_row(ok, ITEM, [F.col("created_at"), F.col("id")], ["key_defensible", "model", "run_id"])


def consensus_level(suggestions: DataFrame) -> DataFrame:
    """Median and spread of the per-model medians."""
    m = F.col("level_median")
    return suggestions.groupBy(*ITEM).agg(
        F.median(m).alias("median"), F.min(m).alias("min"), F.max(m).alias("max"), F.count(F.lit(1)).alias("n_models")
    )


def decision(final: Column, blind: Column, model_levels: Column, rationale: Column) -> Column:
    """kept / adopted_llm / changed; a change without a written reason is not a decision."""
    return (
        F.when(final.isNull(), F.lit(None).cast("string"))
        .when(final == blind, "kept")
        .when(F.coalesce(strip(rationale), F.lit("")) == "", F.lit(None).cast("string"))
        .when(F.array_contains(model_levels, final), "adopted_llm")
        .otherwise("changed")
    )


def review_table(items: DataFrame, human: DataFrame, results: DataFrame, models: Sequence[str]) -> DataFrame:
    """Items with human and model levels; model columns stay NULL until the human rating is locked."""
    sug = latest_suggestion(results)
    cons = consensus_level(sug)
    per_model = sug.groupBy(*ITEM).agg(
        *[F.round(F.max(F.when(F.col("model") == m, F.col("level_median"))), 1).alias(f"llm[{m}]") for m in models],
        F.collect_set(F.bround("level_median").cast("int")).alias("_levels"), F.bool_and("blind_matches_key").alias("_match"),
    )
    review = latest_key_review(results).select(*ITEM, "key_defensible")
    df = items.join(human, list(ITEM), "left").join(cons, list(ITEM), "left").join(per_model, list(ITEM), "left").join(review, list(ITEM), "left")
    locked = F.col("blind_level").isNotNull()
    gate = lambda c: F.when(locked, c)
    fmt = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    return df.select(
        *ITEM, "depends_on_figure", F.col("blind_level").alias("my_first_rating"), F.col("final_level").alias("my_final_rating"),
        decision(F.col("final_level"), F.col("blind_level"), F.col("_levels"), F.col("final_rationale")).alias("decision"),
        gate(F.col("median")).alias("llm_level_median"), F.coalesce(gate(F.col("n_models")), F.lit(0)).alias("llm_models"),
        gate(F.concat(fmt(F.col("min")), F.lit("–"), fmt(F.col("max")))).alias("llm_level_spread"),
        gate(F.col("_match")).alias("llm_blind_matches_key"), gate(F.col("key_defensible")).alias("llm_key_defensible"),
        *[gate(F.col(f"`llm[{m}]`")).alias(f"llm[{m}]") for m in models],
    )


def rating_run_rollup(results: DataFrame, price_in: float, price_out: float, priced_provider: str) -> DataFrame:
    """Per run and provider: successes, errors, tokens, cost (only the priced provider costs), status."""
    cost = (F.sum("tokens_in") * price_in + F.sum("tokens_out") * price_out) / 1e6
    df = results.groupBy("run_id", "provider").agg(
        F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_err"),
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), cost.alias("_cost"),
    )
    return df.select(
        "run_id", "provider", "n_ok", "n_err", "tokens_in", "tokens_out",
        F.when(F.col("provider") == priced_provider, F.col("_cost")).otherwise(F.lit(0.0)).alias("cost_usd"),
        F.when(F.col("n_err") == 0, "done").otherwise("done_with_errors").alias("status"),
    )


def corpus_cost_estimate(texts: DataFrame, by: Sequence[str], input_per_call: int, output_per_call: int, in_per_1k: float, out_per_1k: float) -> DataFrame:
    """Texts, estimated tokens and cost per group."""
    n = F.count(F.lit(1))
    return texts.groupBy(*by).agg(n.alias("n_texts")).withColumn("total_input", F.col("n_texts") * input_per_call).withColumn(
        "total_output", F.col("n_texts") * output_per_call
    ).withColumn("est_cost_usd", F.round(F.col("total_input") / 1000 * in_per_1k + F.col("total_output") / 1000 * out_per_1k, 5))


def content_hash(texts: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    """Order-free hash of a text multiset: lanes of the per-text SHA-256 summed, then hashed.

    Sorting and concatenating a corpus would put it whole into one task; sums combine map-side and
    do not depend on the order either.
    """
    digest = F.sha2(F.col(text), 256)
    lanes = [F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(5)]
    sums = texts.groupBy(*by).agg(F.count(text).alias("n_texts"), *[F.sum(l).alias(f"s{i}") for i, l in enumerate(lanes)])
    joined = F.concat_ws("|", F.col("n_texts").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(5)])
    return sums.select(*by, "n_texts", F.sha2(joined, 256).alias("content_hash"))

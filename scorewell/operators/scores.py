"""Score aggregates per user, construct, module and group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import ContractError, config_frame, require_columns, round_clean
from ..functions.text import is_survey, matches_base
from .ordered import cumulative_histogram, modes_of, quantiles_of

CANONICAL_CONTRACT = ("user_id", "instrument_key", "question_id", "item_score", "construct")


def validate_canonical(df: DataFrame) -> DataFrame:
    return require_columns(df, CANONICAL_CONTRACT, "canonical dataset")


def _carried(df: DataFrame) -> list[Column]:
    """Grade and cohort do not vary within a user; any non-NULL value stands for the user."""
    return [F.max(c).alias(c) for c in ("grade", "cohort_id") if c in df.columns]


def _construct_items(df: DataFrame) -> DataFrame:
    return df.filter(F.col("construct").isNotNull() & (F.col("construct") != "") & F.col("item_score").isNotNull())


def assessment_scores(canonical: DataFrame, surveys: Sequence[str], instruments: Sequence[str] | None = None) -> DataFrame:
    """Per (user, test): items answered, points, percent correct of the answered items."""
    df = validate_canonical(canonical).filter(~is_survey(F.col("instrument_key"), surveys) & F.col("item_score").isNotNull())
    if instruments is not None:
        df = df.filter(F.col("instrument_key").isin(list(instruments)))
    return (
        df.groupBy("user_id", "instrument_key")
        .agg(F.count("item_score").alias("n_items_answered"), F.sum("item_score").alias("raw_score"), *_carried(df))
        .withColumn("pct_correct", F.round(F.col("raw_score") / F.col("n_items_answered") * 100, 4))
    )


def construct_means(canonical: DataFrame, surveys: Sequence[str], instruments: Sequence[str] | None = None) -> DataFrame:
    """Per (user, survey, module, construct): items, total and mean item score."""
    df = _construct_items(validate_canonical(canonical).filter(is_survey(F.col("instrument_key"), surveys)))
    if instruments is not None:
        df = df.filter(F.col("instrument_key").isin(list(instruments)))
    keys = ["user_id", "instrument_key", *(["module_id"] if "module_id" in df.columns else []), "construct"]
    return (
        df.groupBy(*keys)
        .agg(F.count("item_score").alias("n_items"), F.sum("item_score").alias("total_score"), *_carried(df))
        .withColumn("mean_score", F.round(F.col("total_score") / F.col("n_items"), 4))
    )


def aggregate_construct_means(means: DataFrame) -> DataFrame:
    """Across modules: total over items, not the mean of module means."""
    require_columns(means, ["user_id", "instrument_key", "construct", "n_items", "total_score"], "construct means")
    return (
        means.groupBy("user_id", "instrument_key", "construct")
        .agg(
            F.count("n_items").alias("n_modules"),
            F.sum("n_items").alias("n_items_total"),
            F.sum("total_score").alias("total_score"),
        )
        .withColumn("mean_score", F.round(F.col("total_score") / F.col("n_items_total"), 4))
    )


DEMOGRAPHIC_COLUMNS = ("gender", "first_language_english")


def summarize_scores(scores: DataFrame, group_by: str | None = None, demographics: DataFrame | None = None) -> DataFrame:
    """Mean, exact median and smallest mode per instrument [, construct] [, group]; a NULL group stays.

    Median and mode come from the value histogram, so no group is ever gathered in one task.
    """
    constructs = "construct" in scores.columns
    value = "mean_score" if constructs else "pct_correct"
    tag = "score" if constructs else "pct"
    df = require_columns(scores, ["instrument_key", value], "scores")
    if group_by in DEMOGRAPHIC_COLUMNS:
        if demographics is None:
            raise ContractError(f"grouping by {group_by} needs the demographics")
        df = df.join(demographics.select("user_id", group_by), "user_id", "left")
    elif group_by is not None:
        require_columns(df, [group_by], "scores")
    keys = ["instrument_key", *(["construct"] if constructs else []), *([group_by] if group_by else [])]
    narrow = df.select(*keys, value)
    hist = cumulative_histogram(narrow, keys, value)  # the scores behind it are computed once
    mean = F.sum(F.col(value) * F.col("n")) / F.sum("n")
    base = hist.groupBy(*keys).agg(F.sum("n").alias("n_users"), round_clean(mean, 4).alias(f"mean_{tag}"))
    middle = quantiles_of(hist, keys, value, {"_median": 0.5})
    common = modes_of(hist, keys, value, "_mode")
    out = base
    for side in (middle, common):
        side = side.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], side.columns[-1])
        out = out.join(side, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left").drop(
            *[f"_k{i}" for i in range(len(keys))]
        )
    return out.select(
        *keys, "n_users", f"mean_{tag}", F.round("_median", 4).alias(f"median_{tag}"), F.round("_mode", 4).alias(f"mode_{tag}")
    )


def user_scores(canonical: DataFrame, base: str, as_percent: bool = False) -> DataFrame:
    """Per user: score sum, or percent correct, over the instruments that match ``base``."""
    df = canonical.filter(matches_base(F.col("instrument_key"), base) & F.col("item_score").isNotNull())
    value = F.sum("item_score") / F.count("item_score") * 100 if as_percent else F.sum("item_score")
    return df.groupBy("user_id").agg(value.alias("score"))


def construct_means_by_module(canonical: DataFrame, base: str, constructs: Sequence[str] | None = None) -> DataFrame:
    """Per (user, module) mean item score over one or more constructs, in long form."""
    df = canonical.filter(matches_base(F.col("instrument_key"), base) & F.col("item_score").isNotNull())
    if constructs:
        df = df.filter(F.col("construct").isin(list(constructs)))
    return df.groupBy("user_id", "module_id").agg(F.avg("item_score").alias("score"))


def percent_by_module(canonical: DataFrame, part: str) -> DataFrame:
    """Per (user, module) percent correct over instruments whose key contains ``part``."""
    df = canonical.filter(F.col("instrument_key").contains(part) & F.col("item_score").isNotNull())
    return df.groupBy("user_id", "module_id").agg((F.sum("item_score") / F.count("item_score") * 100).alias("score"))


def _composite_frame(df: DataFrame, composites: dict[str, Sequence[str]]) -> DataFrame:
    rows = [(c, name) for name, parts in composites.items() for c in parts]
    return df.join(config_frame(df.sparkSession, rows, "construct string, composite string"), "construct")


def composite_scores(canonical: DataFrame, base: str, composites: dict[str, Sequence[str]]) -> DataFrame:
    """Item-weighted composites per (user, module); a construct may feed several composites."""
    df = _construct_items(canonical.filter(matches_base(F.col("instrument_key"), base)))
    per_construct = (
        _composite_frame(df, composites)
        .groupBy("user_id", "module_id", "composite", "construct")
        .agg(F.sum("item_score").alias("s"), F.count("item_score").alias("k"))
    )
    return (
        per_construct.groupBy("user_id", "module_id", "composite")
        .agg(
            F.count(F.lit(1)).alias("n_subconstructs"),
            F.sum("k").alias("n_items_total"),
            F.sum("s").alias("total_score"),
        )
        .withColumn("mean_score", F.col("total_score") / F.col("n_items_total"))
    )


# The four subscales and their weights in the autonomy index.
AUTONOMY_WEIGHTS = {
    "intrinsic_motivation": 2.0,
    "identified_regulation": 1.0,
    "external_regulation": -1.0,
    "amotivation": -2.0,
}


def relative_autonomy_index(canonical: DataFrame, base: str, surveys: Sequence[str]) -> DataFrame:
    """Weighted sum of the four motivation subscales per (user, module), NULL unless all are present."""
    means = construct_means(canonical.filter(matches_base(F.col("instrument_key"), base)), surveys)
    per = [
        F.avg(F.when(F.col("construct") == name, F.col("mean_score"))).alias(name) for name in AUTONOMY_WEIGHTS
    ]
    wide = means.groupBy("user_id", "module_id").agg(*per)
    total = sum((F.col(name) * w for name, w in AUTONOMY_WEIGHTS.items()), F.lit(0.0))
    present = sum((F.col(name).isNotNull().cast("int") for name in AUTONOMY_WEIGHTS), F.lit(0))
    return wide.select("user_id", "module_id", total.alias("rai"), present.alias("n_subscales_present"))


def person_module_dataset(canonical: DataFrame, predictors: dict[str, DataFrame], part: str) -> DataFrame:
    """Percent correct per (user, module) with predictor columns joined on the same key."""
    from ..functions.text import module_number

    out = percent_by_module(canonical, part).withColumnRenamed("score", "pct_correct")
    for name, frame in predictors.items():
        value = "mean_score" if "mean_score" in frame.columns else "rai"
        out = out.join(frame.select("user_id", "module_id", F.col(value).alias(name)), ["user_id", "module_id"], "left")
    return out.withColumn("module_num", module_number(F.col("module_id")))


def person_mean_center(df: DataFrame, columns: Sequence[str], key: str = "user_id") -> DataFrame:
    """``c_between`` is the person's mean of ``c``, ``c_within`` the deviation from it."""
    means = df.groupBy(key).agg(*[F.avg(c).alias(f"{c}_between") for c in columns])
    out = df.join(means, key, "left")
    return out.select(*out.columns, *[(F.col(c) - F.col(f"{c}_between")).alias(f"{c}_within") for c in columns])


def eligible_subjects(df: DataFrame, min_modules: int = 2) -> DataFrame:
    """Rows of subjects seen in at least ``min_modules`` distinct modules."""
    seen = df.groupBy("user_id").agg(F.count_distinct("module_id").alias("k")).filter(F.col("k") >= min_modules)
    return df.join(seen.select("user_id"), "user_id", "left_semi")


def complete_cases(long: DataFrame, unit: str, slot: str, value: str, n_slots: int | None = None) -> DataFrame:
    """Rows of units that have a value in every slot (listwise deletion without a pivot)."""
    present = long.filter(F.col(value).isNotNull())
    if n_slots is None:
        n_slots = present.select(slot).distinct().count()
    full = present.groupBy(unit).agg(F.count_distinct(slot).alias("k")).filter(F.col("k") == n_slots)
    return present.join(full.select(unit), unit, "left_semi")


def drop_constant_items(long: DataFrame, item: str = "question_id", value: str = "item_score") -> DataFrame:
    """Rows of items whose scores vary."""
    varying = long.groupBy(item).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).filter(F.col("lo") < F.col("hi"))
    return long.join(varying.select(item), item, "left_semi")


def constant_items(long: DataFrame, item: str = "question_id", value: str = "item_score") -> DataFrame:
    stats = long.groupBy(item).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))
    return stats.filter(F.col("lo") == F.col("hi")).select(item, F.col("lo").alias("value"), "n")


def binary_items(canonical: DataFrame) -> DataFrame:
    return canonical.filter(F.col("item_score").isin(0.0, 1.0))


def binary_matrix(canonical: DataFrame, base: str) -> DataFrame:
    """Long person x item matrix: the first 0/1 score per (user, question), earliest submission first."""
    from ..core import first_row

    df = binary_items(canonical.filter(matches_base(F.col("instrument_key"), base)))
    order = [F.col("submitted_at"), F.col("instrument_key"), F.col("item_score")]
    return first_row(df, ["user_id", "question_id"], order, ["item_score"])


def likert_matrix(canonical: DataFrame, base: str, construct: str) -> DataFrame:
    """Long person x item matrix of the rounded mean Likert score (half to even)."""
    df = canonical.filter(
        matches_base(F.col("instrument_key"), base) & (F.col("construct") == construct) & F.col("item_score").isNotNull()
    )
    return df.groupBy("user_id", "question_id").agg(F.bround(F.avg(F.bround("item_score"))).alias("item_score"))


def likert_matrices(canonical: DataFrame, bases: Sequence[str]) -> DataFrame:
    """``likert_matrix`` of every construct of several surveys at once; ``g`` names survey and construct."""
    hits = [F.when(matches_base(F.col("instrument_key"), b), F.lit(b)) for b in bases]
    df = canonical.withColumn("_b", F.coalesce(*hits)).filter("_b IS NOT NULL AND construct IS NOT NULL AND item_score IS NOT NULL")
    named = df.groupBy(F.concat_ws(":", "_b", "construct").alias("g"), "user_id", "question_id")
    return named.agg(F.bround(F.avg(F.bround("item_score"))).alias("item_score"))


def response_forms(matrix: DataFrame) -> DataFrame:
    """Groups of users who answered the same set of items, largest first, labelled ``Form 1..``.

    ``matrix`` is long with one row per (user, item), so a user's list is bounded by the item bank.
    """
    from ..functions.text import natural_key
    from .ordered import ordinal_rank

    answered = matrix.filter(F.col("item_score").isNotNull()).groupBy("user_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(natural_key(F.col("question_id")).alias("k"), F.col("question_id").alias("q")))), lambda s: s["q"]), ", ").alias("items"),
        F.count_distinct("question_id").alias("n_items"),
    )
    forms = answered.groupBy("items").agg(F.count(F.lit(1)).alias("n_students"), F.max("n_items").alias("n_items"))
    ranked = ordinal_rank(forms.withColumn("_size", -F.col("n_students")), [], "_size", "items")
    return ranked.select(
        F.concat(F.lit("Form "), F.col("position").cast("string")).alias("form"), "n_students", "n_items", "items"
    )


def subset_form(matrix: DataFrame, items: Sequence[str]) -> DataFrame:
    """Rows of the users who answered exactly ``items``."""
    items = sorted(set(items))
    answered = matrix.filter(F.col("item_score").isNotNull())
    exact = answered.groupBy("user_id").agg(
        F.count_distinct("question_id").alias("k"),
        F.count_distinct(F.when(F.col("question_id").isin(items), F.col("question_id"))).alias("hit"),
    ).filter((F.col("k") == len(items)) & (F.col("hit") == len(items)))
    return answered.join(exact.select("user_id"), "user_id", "left_semi")

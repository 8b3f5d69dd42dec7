"""Participant counts, missingness, straight-lining, outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import materialize, require_columns, strip
from ..functions.numbers import percent
from ..functions.text import is_survey, module_number
from .ordered import quantiles

GENDER_ORDER = ("Male", "Female", "Unknown")
LANGUAGE_ORDER = ("English", "Non-English", "Unknown")
# Grade labels and their levels.
GRADE_LEVELS = {
    "Fourth (4th) grade": "4",
    "Fifth (5th) grade": "5",
    "Sixth (6th) grade": "6",
    "Seventh (7th) grade": "7",
    "Eighth (8th) grade": "8",
    "Adult": "Adult",
}


def domain_order(c: Column, order: Sequence[str]) -> Column:
    """Position of a label in its domain; unlisted labels come last."""
    out = F.lit(len(order))
    for i, label in enumerate(order):
        out = F.when(c == label, i).otherwise(out)
    return out


def grade_order(level: Column) -> Column:
    """4..8, then Adult, then Unknown."""
    return F.when(level.rlike(r"^\d+$"), level.try_cast("int")).when(level == "Adult", 100).otherwise(101)


def language_label(c: Column) -> Column:
    return F.when(c, "English").when(~c, "Non-English").otherwise("Unknown")


def normalize_demographics(answers: DataFrame, grade_q: str, language_q: str, gender_q: str) -> DataFrame:
    """Long demographic answers (``user_id, question_id, response_value, submitted_at``), first answer
    per question, as one cleaned row per user."""
    from ..core import first_row

    kept = answers.filter(F.col("question_id").isin(grade_q, language_q, gender_q))
    first = first_row(kept, ["user_id", "question_id"], [F.col("submitted_at"), F.col("response_value")], ["response_value"])
    wide = first.groupBy("user_id").agg(
        *[F.max(F.when(F.col("question_id") == q, F.col("response_value"))).alias(n)
          for n, q in (("grade", grade_q), ("lang", language_q), ("sex", gender_q))]
    )
    return wide.select(
        "user_id",
        "grade",
        grade_level(F.col("grade")).alias("grade_level"),
        gender_or_null(strip("sex")).alias("gender"),
        strict_bool(F.col("lang")).alias("first_language_english"),
    )


def grade_level(grade: Column) -> Column:
    pairs = [F.lit(x) for pair in GRADE_LEVELS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), strip(grade))


def gender_or_null(c: Column) -> Column:
    return F.when(c.isin("Male", "Female"), c)


def strict_bool(c: Column) -> Column:
    text = F.lower(strip(c))
    return F.when(text == "true", True).when(text == "false", False)


def lenient_bool(c: Column) -> Column:
    """Import vocabulary."""
    text = F.lower(strip(c.cast("string")))
    return F.when(text.isin("true", "1", "yes", "y"), True).when(text.isin("false", "0", "no", "n"), False)


def normalize_import_demographics(demographics: DataFrame, canonical: DataFrame) -> DataFrame:
    """One cleaned row per imported student; students without a demographics row get NULLs."""
    users = canonical.groupBy("user_id").agg(F.min("cohort_id").alias("cohort_id"))
    demo = demographics.groupBy(strip("user_id").alias("user_id")).agg(
        F.min_by(F.struct("grade", "gender", "first_language_english"), F.struct("grade", "gender", F.col("first_language_english").cast("string"))).alias("d")
    )
    known = F.col("d.grade").isin(list(GRADE_LEVELS))
    return users.join(demo, "user_id", "left").select(
        "user_id",
        F.when(known, F.col("d.grade")).alias("grade"),
        F.when(known, grade_level(F.col("d.grade"))).alias("grade_level"),
        gender_or_null(F.col("d.gender")).alias("gender"),
        lenient_bool(F.col("d.first_language_english")).alias("first_language_english"),
        "cohort_id",
    )


def _share(counts: DataFrame, total: DataFrame) -> DataFrame:
    # total is a single aggregated row
    return counts.join(F.broadcast(total)).withColumn("pct", percent(F.col("n"), F.col("_total"))).drop("_total")


def _total(demographics: DataFrame) -> DataFrame:
    return demographics.agg(F.count_distinct("user_id").alias("_total"))


def count_participants(demographics: DataFrame) -> DataFrame:
    return demographics.agg(F.count_distinct("user_id").alias("n"))


def count_by_gender(demographics: DataFrame) -> DataFrame:
    g = F.coalesce("gender", F.lit("Unknown")).alias("gender")
    counts = demographics.groupBy(g).agg(F.count_distinct("user_id").alias("n"))
    return _share(counts, _total(demographics)).orderBy(domain_order(F.col("gender"), GENDER_ORDER))


def count_by_grade(demographics: DataFrame) -> DataFrame:
    keys = [F.coalesce("grade_level", F.lit("Unknown")).alias("grade_level"), F.coalesce("grade", F.lit("Unknown")).alias("grade")]
    counts = demographics.groupBy(*keys).agg(F.count_distinct("user_id").alias("n"))
    return _share(counts, _total(demographics)).orderBy(grade_order(F.col("grade_level")), "grade")


def count_by_language(demographics: DataFrame) -> DataFrame:
    label = language_label(F.col("first_language_english")).alias("label")
    counts = demographics.groupBy("first_language_english", label).agg(F.count_distinct("user_id").alias("n"))
    return _share(counts, _total(demographics)).orderBy(domain_order(F.col("label"), LANGUAGE_ORDER))


def count_by_cohort(demographics: DataFrame, cohort_map: DataFrame) -> DataFrame:
    joined = demographics.join(cohort_map.select("user_id", "cohort_id"), "user_id", "left")
    cohort = F.coalesce("cohort_id", F.lit("Unassigned")).alias("cohort_id")
    counts = joined.groupBy(cohort).agg(F.count_distinct("user_id").alias("n"))
    return _share(counts, _total(demographics)).orderBy((F.col("cohort_id") == "Unassigned"), "cohort_id")


def participant_summary(demographics: DataFrame, cohort_map: DataFrame | None = None) -> DataFrame:
    """Total and every breakdown in one pass with grouping sets: ``breakdown, label, grade, n, pct``.

    Grade levels are broken down by the grade as it was answered, too (``grade``; NULL in other breakdowns).
    """
    df = demographics.select(
        "user_id",
        F.coalesce("gender", F.lit("Unknown")).alias("gender"),
        F.coalesce("grade_level", F.lit("Unknown")).alias("grade_level"), F.coalesce("grade", F.lit("Unknown")).alias("grade"),
        language_label(F.col("first_language_english")).alias("language"),
    )
    dims = ["gender", "grade_level", "language"]
    if cohort_map is not None:
        df = df.join(cohort_map.select("user_id", "cohort_id"), "user_id", "left").withColumn(
            "cohort_id", F.coalesce("cohort_id", F.lit("Unassigned"))
        )
        dims.append("cohort_id")
    # one row per user first: the distinct count becomes a plain count inside the grouping sets
    users = df.groupBy("user_id").agg(F.max(F.struct("grade_level", "grade")).alias("_l"), *[F.max(d).alias(d) for d in dims if d != "grade_level"]).select("*", "_l.*")
    sets = [[F.col("grade_level"), F.col("grade")] if d == "grade_level" else [F.col(d)] for d in dims] + [[]]
    cube = users.groupingSets(sets, *dims, "grade").agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(d).alias(f"_g_{d}") for d in dims]
    )
    breakdown, label = F.lit("total"), F.lit("all")
    for d in dims:
        breakdown = F.when(F.col(f"_g_{d}") == 0, d).otherwise(breakdown)
        label = F.when(F.col(f"_g_{d}") == 0, F.col(d)).otherwise(label)
    flat = cube.select(breakdown.alias("breakdown"), label.alias("label"), "grade", "n")
    total = users.agg(F.count(F.lit(1)).alias("_total"))
    return _share(flat, total)


def missingness_by_module(canonical: DataFrame, part: str) -> DataFrame:
    """Participants per test module and their share of the whole cohort (one decimal)."""
    total = canonical.agg(F.count_distinct("user_id").alias("_total"))
    prefix = F.element_at(F.split("instrument_key", "_"), 1)
    num = F.coalesce(F.regexp_replace(prefix, r"\D", "").try_cast("int"), F.lit(0))
    per = canonical.filter(F.col("instrument_key").contains(part)).groupBy("instrument_key").agg(
        F.count_distinct("user_id").alias("n_participants")
    )
    module = F.when(num > 0, F.concat(F.lit("module_"), num.cast("string"))).otherwise(F.col("instrument_key"))
    return per.join(F.broadcast(total)).select(
        module.alias("module_id"),
        num.alias("module_num"),
        "n_participants",
        F.round(F.lit(100.0) * F.col("n_participants") / F.col("_total"), 1).alias("pct_of_cohort"),
    )


def excessive_missingness(canonical: DataFrame, instruments: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Answered rows per user against the largest count of any user, flagged below the threshold."""
    df = canonical.filter(F.col("instrument_key").isin(list(instruments))).filter(
        F.col("item_score").isNotNull() | F.col("response_value").isNotNull()
    )
    counts = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_answered"))
    top = counts.agg(F.max("n_answered").alias("n_expected"))
    share = F.col("n_answered") / F.col("n_expected")
    return counts.join(F.broadcast(top)).select(
        "user_id", "n_answered", "n_expected", F.round(share, 3).alias("pct_answered"), (share < threshold).alias("flagged")
    )


def straight_lining(canonical: DataFrame, surveys: Sequence[str], min_items: int = 3) -> DataFrame:
    """Users who gave one and the same answer to all (>= min_items) items of a survey."""
    df = canonical.filter(is_survey(F.col("instrument_key"), surveys) & (strip("response_value") != ""))
    counts = df.groupBy("user_id", "instrument_key").agg(
        F.count(F.lit(1)).alias("n_items"), F.count_distinct("response_value").alias("n_distinct_responses")
    )
    flag = (F.col("n_items") >= min_items) & (F.col("n_distinct_responses") == 1)
    return counts.withColumn("flagged", flag)


def outliers(df: DataFrame, value: str, by: Sequence[str], method: str = "iqr") -> DataFrame:
    """Flag each row against its group's Tukey fences or |z| > 3; groups under three rows never flag."""
    require_columns(df, [*by, "user_id", value], "scores")
    df = materialize(df.select(*by, "user_id", value), "scores")  # read three times below, computed once
    stats = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd")
    )
    if method == "zscore":
        joined = df.join(stats, list(by))
        hit = (F.col("_sd") > 0) & (F.abs((F.col(value) - F.col("_mean")) / F.col("_sd")) > 3)
    else:
        joined = df.join(stats, list(by)).join(quantiles(df, by, value, {"_q1": 0.25, "_q3": 0.75}), list(by))
        spread = 1.5 * (F.col("_q3") - F.col("_q1"))
        hit = (F.col(value) < F.col("_q1") - spread) | (F.col(value) > F.col("_q3") + spread)
    flag = F.coalesce((F.col("_n") >= 3) & hit, F.lit(False))
    return joined.select(*by, "user_id", value, flag.alias("flagged"))

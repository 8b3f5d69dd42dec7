"""Scoring of raw answers: versioned answer keys, Likert scales, points, and instrument totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import require_columns, strip
from ..functions.text import normalize_choice


def rule_table(scoring: DataFrame) -> DataFrame:
    """One row per instrument with its rules packed in maps, ready for a single (broadcast) join.

    ``versions`` holds the superseded keys ordered by the moment they stopped to apply.
    """
    versions = F.array_sort(
        F.transform("legacy_versions", lambda v: F.struct(v["until"].alias("until"), _clean(v["correct_answers"]).alias("answers"))),
        lambda a, b: F.when(a["until"] < b["until"], -1).when(a["until"] > b["until"], 1).otherwise(0),
    )
    return scoring.select(
        strip("instrument_key").alias("instrument_key"),
        "scoring_type",
        _clean(F.col("correct_answers")).alias("current_key"),
        versions.alias("versions"),
        "default_scale",
        "reverse_scale",
        "reverse_questions",
        "points",
    )


def _clean(answers: Column) -> Column:
    return F.transform_values(answers, lambda _, v: normalize_choice(v))


def binary_score(response: Column, question: Column, submitted: Column) -> Column:
    """1/0 against the key in force at submission: of the superseded keys still valid then, the one
    that ended first; otherwise the current key. A question that key does not list stays NULL."""
    in_force = F.filter(F.col("versions"), lambda v: submitted < v["until"])
    key = F.when(F.size(in_force) > 0, F.try_element_at(F.try_element_at(in_force, F.lit(1))["answers"], question)).otherwise(
        F.try_element_at(F.col("current_key"), question)
    )
    hit = F.coalesce(normalize_choice(response) == key, F.lit(False))
    return F.when(key.isNotNull(), hit.cast("double"))


def likert_score(response: Column, question: Column) -> Column:
    """Scale value of the exact label, from the reverse scale for listed questions."""
    listed = F.coalesce(F.array_contains("reverse_questions", question), F.lit(False)) & (
        F.coalesce(F.size("reverse_scale"), F.lit(0)) > 0
    )
    return F.when(listed, F.try_element_at(F.col("reverse_scale"), response)).otherwise(
        F.try_element_at(F.col("default_scale"), response)
    )


def points_score(response: Column, question: Column) -> Column:
    return F.try_element_at(F.try_element_at(F.col("points"), question), response)


def score_items(responses: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``item_score`` to responses (``instrument_key, question_id, response_value, submitted_at``)."""
    require_columns(responses, ["instrument_key", "question_id", "response_value", "submitted_at"], "responses")
    joined = responses.join(rules, "instrument_key", "left")
    r, q, t = F.col("response_value"), F.col("question_id"), F.col("submitted_at")
    score = (
        F.when(F.col("scoring_type") == "binary", binary_score(r, q, t))
        .when(F.col("scoring_type") == "likert", likert_score(r, q))
        .when(F.col("scoring_type") == "points", points_score(r, q))
    )
    return joined.withColumn("item_score", score).drop(*[c for c in rules.columns if c != "instrument_key"])


def instrument_totals(answers: DataFrame, rules: DataFrame) -> DataFrame:
    """Total per (user, instrument) as a submission is scored; violations become an error text.

    Binary: answered bank items only, an id outside the key is an error. Points: an id outside the
    map or an answer without points is an error. Likert: answers off the scale are skipped.
    """
    require_columns(answers, ["user_id", "instrument_key", "question_id", "response_value", "submitted_at"])
    joined = answers.join(rules, "instrument_key", "left")
    r, q, t = F.col("response_value"), F.col("question_id"), F.col("submitted_at")
    kind = F.col("scoring_type")
    binary, points = binary_score(r, q, t), points_score(r, q)
    scored = joined.select(
        "user_id",
        "instrument_key",
        "question_id",
        F.when(kind == "binary", binary).when(kind == "points", points).when(kind == "likert", likert_score(r, q)).alias("s"),
        F.when(kind == "binary", binary.isNull())
        .when(kind == "points", ~F.coalesce(F.map_contains_key("points", q), F.lit(False)))
        .otherwise(F.lit(False))
        .alias("unknown_id"),
        F.when(kind == "points", points.isNull()).otherwise(F.lit(False)).alias("no_points"),
        kind.isNull().alias("no_rule"),
    )
    totals = scored.groupBy("user_id", "instrument_key").agg(
        F.coalesce(F.sum("s"), F.lit(0.0)).alias("total_score"),
        F.count(F.lit(1)).alias("n_answers"),
        F.count_if("unknown_id").alias("n_unknown"),
        F.count_if("no_points").alias("n_unscored"),
        F.max("no_rule").alias("no_rule"),
    )
    error = (
        F.when(F.col("no_rule"), F.lit("no scoring rule"))
        .when(F.col("n_unknown") > 0, F.lit("unknown question ids"))
        .when(F.col("n_unscored") > 0, F.lit("answer without points"))
    )
    return totals.withColumn("error", error).select(
        "user_id",
        "instrument_key",
        F.when(F.col("error").isNull(), F.col("total_score")).alias("total_score"),
        "n_answers",
        "n_unknown",
        "error",
    )


def unknown_question_ids(answers: DataFrame, rules: DataFrame) -> DataFrame:
    """Answered ids that the instrument's current key does not list, once each."""
    joined = answers.select("instrument_key", "question_id").distinct().join(
        rules.select("instrument_key", "current_key"), "instrument_key"
    )
    listed = F.coalesce(F.map_contains_key("current_key", F.col("question_id")), F.lit(False))
    return joined.filter(F.col("current_key").isNotNull() & ~listed).select("instrument_key", "question_id")

"""Study tables derived from the given benchmark tables (see FIXTURES.md) as lazy plans."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import first_row, place
from ..operators.canonical import FilterSpec, Rulebook, canonical_dataset
from ..sources.responses import DEFINITION_SCHEMA, SCORING_SCHEMA, flatten_definitions

SURVEYS = ("engagement_survey", "motivation_survey")
MCQ = "content_mcq_assessment"
MODULES = range(1, 8)
QUESTIONS = range(1, 8)
KEY_CHANGE = "1998-01-01 00:00:00"
GRADES = {
    "AUTOMOBILE": "Fourth (4th) grade",
    "BUILDING": "Fifth (5th) grade",
    "FURNITURE": "Sixth (6th) grade",
    "HOUSEHOLD": "Adult",
}
LABELS = ("Strongly disagree", "Disagree", "Agree", "Strongly agree")
CONSTRUCTS = {
    "engagement_survey": {"task": (1, 2, 3), "effort": (4, 5), "attention": (6, 7)},
    "motivation_survey": {
        "intrinsic_motivation": (1, 2), "identified_regulation": (3, 4),
        "external_regulation": (5, 6), "amotivation": (7,),
    },
}
REVERSED = {"engagement_survey": ("Q6", "Q7"), "motivation_survey": ()}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def key_letter(module: int, question: int, version: int) -> str:
    return "ABCD"[(module + question + version) % 4]


def definition_rows() -> list:
    """Nested definitions in the three layouts: sections (engagement), blocks (motivation), bank (tests)."""
    rows = []
    for m in MODULES:
        for base, constructs in CONSTRUCTS.items():
            parts = [
                {"name": name.upper(), "questions": [{"id": f"Q{q}", "text": None} for q in qs]}
                for name, qs in constructs.items()
            ]
            sections, blocks = (parts, None) if base == "engagement_survey" else (None, parts)
            rows.append((f"module{m}_{base}", f"module{m}", None, sections, blocks, None))
        rows.append((f"module{m}_{MCQ}", None, f"module{m}", None, None, [{"id": f"Q{q}", "text": None} for q in QUESTIONS]))
    return rows


def scoring_rows() -> list:
    import datetime as dt

    until = dt.datetime.fromisoformat(KEY_CHANGE)
    forward = {label: float(i + 1) for i, label in enumerate(LABELS)}
    backward = {label: float(4 - i) for i, label in enumerate(LABELS)}
    rows = []
    for m in MODULES:
        current = {f"Q{q}": key_letter(m, q, 1) for q in QUESTIONS}
        old = {f"Q{q}": key_letter(m, q, 0) for q in QUESTIONS if q != 7}
        rows.append((f"module{m}_{MCQ}", "binary", current, [(until, old)], None, None, None, None))
        for base in SURVEYS:
            rows.append((f"module{m}_{base}", "likert", None, None, forward, backward, list(REVERSED[base]), None))
    return rows


def definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(definition_rows(), DEFINITION_SCHEMA)


def scoring(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(scoring_rows(), SCORING_SCHEMA)


@lru_cache(maxsize=4)
def _rulebook(spark: SparkSession, app_id: str) -> Rulebook:
    return Rulebook(flatten_definitions(definitions(spark)), scoring(spark))


def rulebook(spark: SparkSession) -> Rulebook:
    return _rulebook(spark, spark.sparkContext.applicationId)


def _user(c: str) -> Column:
    return F.concat(F.lit("u"), F.col(c).cast("string"))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """First attempt per (user, instrument, question) of the answers behind lineitem and orders."""
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey)
    flag = F.col("l_returnflag")
    kind = F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2)
    # first attempts are found on narrow numeric keys; the text columns are made from the survivors
    keyed = joined.select(
        "o_custkey", (F.col("l_partkey") % 7 + 1).alias("_module"), kind.alias("_kind"), "l_linenumber",
        F.col("l_shipdate").alias("submitted_at"), "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    )
    order = [F.col(c) for c in ("submitted_at", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    first = first_row(keyed, ["o_custkey", "_module", "_kind", "l_linenumber"], order, ["submitted_at", "l_quantity"])
    level = F.col("l_quantity").cast("int") % 4
    letter = F.concat(F.substring(F.lit("ABCD"), level + 1, F.lit(1)), F.lit(": option"))
    bases = F.array(F.lit(MCQ), *[F.lit(x) for x in SURVEYS])
    return first.select(
        _user("o_custkey").alias("user_id"),
        F.concat(F.lit("module"), F.col("_module").cast("string"), F.lit("_"), F.element_at(bases, F.col("_kind") + 1)).alias("instrument_name"),
        F.concat(F.lit("Q"), F.col("l_linenumber").cast("string")).alias("question_id"),
        F.when(F.col("_kind") == 0, letter).otherwise(F.element_at(F.array(*[F.lit(x) for x in LABELS]), level + 1)).alias("response_value"),
        "submitted_at",
    )


def demographics(spark: SparkSession, sf: str) -> DataFrame:
    """One row per user, cleaned: grade, grade_level, gender, first_language_english."""
    grade = F.lit(None).cast("string")
    for segment, label in GRADES.items():
        grade = F.when(F.col("c_mktsegment") == segment, label).otherwise(grade)
    level = F.regexp_extract("grade", r"\((\d)th\)", 1)
    key = F.col("c_custkey")
    return (
        table(spark, sf, "customer")
        .select(
            _user("c_custkey").alias("user_id"),
            grade.alias("grade"),
            F.when(key % 3 == 0, "Male").when(key % 3 == 1, "Female").alias("gender"),
            F.when(key % 4 == 0, F.lit(None)).otherwise(key % 4 == 1).alias("first_language_english"),
        )
        .select(
            "user_id",
            "grade",
            F.when(F.col("grade") == "Adult", "Adult").when(level != "", level).alias("grade_level"),
            "gender",
            "first_language_english",
        )
    )


def cohort_map(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    joined = customers.join(nations, customers.c_nationkey == nations.n_nationkey)
    return joined.select(
        _user("c_custkey").alias("user_id"),
        F.when(F.col("c_nationkey") % 5 != 0, F.col("n_name")).alias("cohort_id"),
    )


def by_user(spark: SparkSession, sf: str, df: DataFrame, times: int = 1) -> DataFrame:
    """Answers (``times`` per row of the log at most) dealt out by user, for joins and aggregations per user."""
    return place(df, times * table(spark, sf, "lineitem").count(), "user_id")


def canonical(spark: SparkSession, sf: str, spec: FilterSpec | None = None) -> DataFrame:
    return canonical_dataset(
        by_user(spark, sf, responses(spark, sf)), rulebook(spark), demographics(spark, sf), cohort_map(spark, sf), spec
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical rows without the demographic joins, for operators that do not read them."""
    return canonical_dataset(responses(spark, sf), rulebook(spark))


PRE, POST = "pre_knowledge_assessment", "post_knowledge_assessment"


def pre_post(df: DataFrame) -> DataFrame:
    """Test rows renamed to a pre and a post instrument, split at 1998-07-01."""
    early = F.col("submitted_at") < F.lit("1998-07-01").cast("timestamp_ntz")
    return df.filter(F.col("instrument_key").endswith(MCQ)).withColumn(
        "instrument_key", F.when(early, "precourse_" + PRE).otherwise("postcourse_" + POST)
    )

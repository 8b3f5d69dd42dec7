"""Readers for response logs, definitions, scoring rules, item banks and import files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import require_columns, strip
from ..functions.text import depends_on_figure, item_hash, parse_option

RESPONSE_COLUMNS = ("user_id", "instrument_name", "question_id", "response_value", "submitted_at")

# Nested layouts of an instrument definition.
DEFINITION_SCHEMA = """
    instrument_key string, module_id string, scope string,
    sections array<struct<name:string, questions:array<struct<id:string, text:string>>>>,
    blocks array<struct<name:string, questions:array<struct<id:string, text:string>>>>,
    question_bank array<struct<id:string, text:string>>
"""
SCORING_SCHEMA = """
    instrument_key string, scoring_type string, correct_answers map<string,string>,
    legacy_versions array<struct<until:timestamp, correct_answers:map<string,string>>>,
    default_scale map<string,double>, reverse_scale map<string,double>, reverse_questions array<string>,
    points map<string,map<string,double>>
"""


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response log, five columns only (the scan prunes the rest)."""
    return require_columns(spark.read.parquet(path), RESPONSE_COLUMNS, "response log").select(*RESPONSE_COLUMNS)


def read_responses_jdbc(spark: SparkSession, url: str, table: str, bounds: dict | None = None) -> DataFrame:
    """The response log from a database table; ``bounds`` carries Spark's partitioning options."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for key, value in (bounds or {}).items():
        reader = reader.option(key, value)
    return reader.load().select(*RESPONSE_COLUMNS)


def flatten_definitions(definitions: DataFrame) -> DataFrame:
    """Nested definitions -> ``item_dim(instrument_key, question_id, construct, module_id)``.

    Sections and blocks name a construct for their questions, a bank does not. A question listed
    twice keeps its last layout (bank over block over section), as a later assignment would.
    """
    require_columns(definitions, ["instrument_key", "module_id"], "definitions")
    have = set(definitions.columns)
    base = [strip("instrument_key").alias("instrument_key"), _module(definitions).alias("module_id")]
    parts = []
    for rank, column in enumerate(("sections", "blocks")):
        if column in have:
            inner = definitions.select(*base, F.explode(column).alias("part"))
            parts.append(
                inner.select(
                    "instrument_key",
                    "module_id",
                    F.lower("part.name").alias("construct"),
                    F.explode("part.questions").alias("q"),
                    F.lit(rank).alias("_layout"),
                )
            )
    if "question_bank" in have:
        parts.append(
            definitions.select(
                *base,
                F.lit(None).cast("string").alias("construct"),
                F.explode("question_bank").alias("q"),
                F.lit(2).alias("_layout"),
            )
        )
    flat = parts[0]
    for p in parts[1:]:
        flat = flat.unionByName(p)
    flat = flat.withColumn("question_id", strip("q.id"))
    best = F.max(F.struct("_layout", "construct", "module_id")).alias("b")
    return (
        flat.groupBy("instrument_key", "question_id")
        .agg(best)
        .select("instrument_key", "question_id", "b.construct", "b.module_id")
    )


def _module(definitions: DataFrame):
    from ..functions.text import normalize_module_id

    raw = F.col("module_id")
    if "scope" in definitions.columns:
        raw = F.coalesce(raw, F.col("scope"))
    return normalize_module_id(raw)


def share_across_modules(definitions: DataFrame, modules: list[int]) -> DataFrame:
    """A definition used by every module, once per module: key ``moduleN_<key>``, module ``moduleN``."""
    numbered = definitions.withColumn("_n", F.explode(F.array(*[F.lit(m) for m in modules])))
    prefix = F.concat(F.lit("module"), F.col("_n").cast("string"))
    return (
        numbered.withColumn("instrument_key", F.concat(prefix, F.lit("_"), F.col("instrument_key")))
        .withColumn("module_id", prefix)
        .drop("_n")
    )


def flatten_answer_keys(scoring: DataFrame) -> DataFrame:
    """Current and legacy answer keys -> ``key_dim(instrument_key, question_id, answer, valid_until)``."""
    current = scoring.select(
        "instrument_key", F.explode("correct_answers").alias("question_id", "answer"),
        F.lit(None).cast("timestamp").alias("valid_until"),
    )
    legacy = scoring.select("instrument_key", F.explode("legacy_versions").alias("v")).select(
        "instrument_key", F.explode("v.correct_answers").alias("question_id", "answer"),
        F.col("v.until").alias("valid_until"),
    )
    return current.unionByName(legacy)


def flatten_scales(scoring: DataFrame) -> DataFrame:
    """Likert scales -> ``scale_dim(instrument_key, label, score, is_reverse)``."""
    forward = scoring.select("instrument_key", F.explode("default_scale").alias("label", "score"), F.lit(False).alias("is_reverse"))
    reverse = scoring.select("instrument_key", F.explode("reverse_scale").alias("label", "score"), F.lit(True).alias("is_reverse"))
    return forward.unionByName(reverse)


def flatten_reverse_items(scoring: DataFrame) -> DataFrame:
    return scoring.select("instrument_key", F.explode("reverse_questions").alias("question_id"))


def item_records(bank: DataFrame, keys: DataFrame | None = None, selection: list[str] | None = None) -> DataFrame:
    """Item bank records: options parsed to label and text, key attached, content hash, flags.

    ``bank`` has ``instrument_key, question_id, question, options array<string>``; ``keys`` has
    ``instrument_key, question_id, answer``.
    """
    require_columns(bank, ["instrument_key", "question_id", "question", "options"], "item bank")
    text = strip("question")
    options = F.transform("options", lambda raw, i: parse_option(raw, i))
    items = bank.select("instrument_key", "question_id", text.alias("text"), options.alias("options"))
    items = items.withColumn("item_hash", item_hash(F.col("text"), F.col("options"))).withColumn(
        "depends_on_figure",
        depends_on_figure(F.concat_ws(" ", "text", F.array_join(F.col("options.text"), " "))),
    )
    if keys is not None:
        answer = keys.select("instrument_key", "question_id", strip("answer").alias("key"))
        items = items.join(answer, ["instrument_key", "question_id"], "left")
    else:
        items = items.withColumn("key", F.lit(None).cast("string"))
    chosen = F.col("question_id").isin(selection) if selection else F.lit(None).cast("boolean")
    return items.withColumn("in_selection", chosen)


def read_item_bank(spark: SparkSession, path: str, instrument_key: str) -> DataFrame:
    """A JSON array of ``{id, question, options[]}`` records."""
    raw = spark.read.schema("id string, question string, options array<string>").json(path, multiLine=True)
    return raw.select(F.lit(instrument_key).alias("instrument_key"), F.col("id").alias("question_id"), "question", "options")


def read_import_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Import file: every column a string, empty stays empty, nothing becomes NULL by inference.

    Quoted fields may hold line breaks, so a file is read in one task; many files are read side by side. Pass
    ``multi_line=False`` for large files known to have no such breaks: Spark then splits each over tasks.
    """
    return spark.read.csv(
        path, header=True, inferSchema=False, multiLine=multi_line, escape='"', nullValue="\u0000", emptyValue=""
    ).na.fill("")

"""Data checks that return their findings as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import materialize, require_columns, strip
from ..functions.text import STUDENT_ID_PATTERN
from .descriptive import normalize_import_demographics

REQUIRED_IMPORT = ("user_id", "module_id", "instrument_key", "question_id", "response_value", "item_score", "construct", "cohort_id")
GROUND_TRUTH_REQUIRED = ("category", "code_name", "quote")
GROUND_TRUTH_OPTIONAL = ("participant_id", "page_ref", "researcher_initials", "notes")


SAMPLE = 8  # values shown per check
_ISSUE = "struct<check:string, severity:string, n:bigint, sample:array<string>>"


def _counted(row: DataFrame, severity: dict[str, str]) -> DataFrame:
    """A one-row frame of counts as findings."""
    none = F.lit(None).cast("array<string>")
    cells = [F.struct(F.lit(c).alias("check"), F.lit(severity[c]).alias("severity"), F.col(c).cast("bigint").alias("n"), none.alias("sample")).cast(_ISSUE) for c in row.columns]
    return row.select(F.inline(F.array(*cells)))


def validate_import(
    canonical: DataFrame, demographics: DataFrame, known_users: DataFrame, registered_cohorts: Sequence[str], known_instruments: Sequence[str] | None = None
) -> DataFrame:
    """The import checks as ``check, severity, n, sample``; only findings (n > 0) are returned.

    The file is cleaned and stored once, and read three times, whatever the number of checks: for counts over its rows, for the
    demographics of its users, and for checks on groups. For these each row enters one aggregation under a key per kind of group
    (user, cohort, instrument, answer slot, answer), combined before the shuffle. The known users enter it, too, as rows without
    weight, so no group is shuffled again to be looked up; a user's cohorts are told apart by their hashes, whose minimum needs
    no sort. What is wrong with a group are rows, of which a check shows the first ``SAMPLE`` values.
    """
    require_columns(canonical, REQUIRED_IMPORT, "import file")
    text = ("user_id", "module_id", "instrument_key", "question_id", "construct", "cohort_id")
    cleaned = canonical.select(
        *[F.coalesce(strip(F.col(x).cast("string")), F.lit("")).alias(x) for x in text], "response_value",
        F.col("item_score").try_cast("double").alias("score"),
    )
    c = materialize(cleaned, "import")
    blank = {f"empty_{x}": F.count_if(F.col(x).isin("", "nan", "None")) for x in text}
    rows = c.agg(*[n.alias(check) for check, n in {**blank, "score_not_numeric": F.count_if(F.col("score").isNull())}.items()])

    key = lambda kind, *columns: F.struct(
        F.lit(kind).alias("kind"), *[(F.col(columns[i]) if i < len(columns) else F.lit("")).cast("string").alias(f"k{i}") for i in range(3)]
    )
    kinds = [key("user", "user_id"), key("cohort", "cohort_id"), key("slot", "user_id", "instrument_key", "question_id"), key("answer", "instrument_key", "question_id", "response_value")]
    if known_instruments is not None:
        kinds.append(key("instrument", "instrument_key"))
    by = ["kind", "k0", "k1", "k2"]
    one = F.lit(1).cast("bigint")
    rated = c.select(F.explode(F.array(*kinds)).alias("g"), F.xxhash64("cohort_id").alias("cohort"), "score").select("g.*", "cohort", "score", one.alias("weight"))
    known = known_users.select(
        F.lit("user").alias("kind"), strip("user_id").cast("string").alias("k0"), F.lit("").alias("k1"), F.lit("").alias("k2"),
        F.lit(None).cast("bigint").alias("cohort"), F.lit(None).cast("double").alias("score"), F.lit(0).cast("bigint").alias("weight"),
    )
    groups = rated.unionByName(known).groupBy(*by).agg(
        F.sum("weight").alias("m"), F.min("weight").alias("least"), F.min("cohort").alias("c0"), F.max("cohort").alias("c1"), F.min("score").alias("s0"), F.max("score").alias("s1")
    ).filter(F.col("m") > 0)
    user = F.col("kind") == "user"
    faults = [
        ("bad_user_id", user & ~F.col("k0").rlike(STUDENT_ID_PATTERN), one, True),
        ("id_of_platform_user", user & (F.col("least") == 0), one, True),
        ("user_in_several_cohorts", user & (F.col("c0") < F.col("c1")), one, True),
        ("cohort_already_registered", (F.col("kind") == "cohort") & F.col("k0").isin(list(registered_cohorts)), one, True),
        ("unknown_instrument", (F.col("kind") == "instrument") & ~F.col("k0").isin(list(known_instruments or [])), one, True),
        ("duplicate_rows", (F.col("kind") == "slot") & (F.col("m") > 1), F.col("m") - 1, False),
        ("several_scores_for_one_answer", (F.col("kind") == "answer") & (F.col("s0") < F.col("s1")), one, False),
    ]
    told = [F.when(bad, F.struct(F.lit(check).alias("check"), n.alias("n"), (F.col("k0") if shown else F.lit(None).cast("string")).alias("value"))) for check, bad, n, shown in faults]
    wrong = materialize(groups.select(F.inline(F.filter(F.array(*told), lambda x: x.isNotNull()))), "findings")
    place = F.row_number().over(Window.partitionBy("check").orderBy("value"))
    few = wrong.filter("value IS NOT NULL").withColumn("_p", place).filter(F.col("_p") <= SAMPLE).groupBy("check").agg(F.sort_array(F.collect_list("value")).alias("sample"))
    found = wrong.groupBy("check").agg(F.sum("n").alias("n")).join(few, "check", "left").select("check", F.lit("error").alias("severity"), "n", "sample")

    d = normalize_import_demographics(demographics, c)
    gaps = sum((F.col(x).isNull().cast("int") for x in ("grade", "gender", "first_language_english")), F.lit(0))
    people = d.agg(F.count_if(gaps == 3).alias("no_demographics"), F.count_if((gaps > 0) & (gaps < 3)).alias("partial_demographics"))
    counted = _counted(rows, {**dict.fromkeys(blank, "error"), "score_not_numeric": "warning"}).unionByName(_counted(people, dict.fromkeys(people.columns, "warning")))
    return counted.unionByName(found).filter(F.col("n") > 0)


def normalize_ground_truth(df: DataFrame) -> DataFrame:
    """Template columns whatever their case or spacing, trimmed, blank rows dropped."""
    found = {c.strip().lower(): c for c in df.columns}
    require = [c for c in GROUND_TRUTH_REQUIRED if c not in found]
    if require:
        raise ValueError(f"missing required column(s): {', '.join(require)}")
    cols = [
        (strip(F.col(f"`{found[c]}`").cast("string")) if c in found else F.lit("")).alias(c)
        for c in (*GROUND_TRUTH_REQUIRED, *GROUND_TRUTH_OPTIONAL)
    ]
    out = df.select(*cols).na.fill("")
    return out.filter(F.concat(*[F.col(c) for c in GROUND_TRUTH_REQUIRED]) != "")


def validate_ground_truth(df: DataFrame) -> DataFrame:
    """One row: rows kept, empty quotes, whether any participant id is present, validity."""
    n = normalize_ground_truth(df).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("quote") == "").alias("n_empty_quotes"),
        F.coalesce(F.bool_or(F.col("participant_id") != ""), F.lit(False)).alias("has_participants"),
    )
    return n.withColumn("valid", F.col("n_rows") > 0)


def missing_fields(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Records with a NULL in a required field: ``field, n``."""
    require_columns(df, required)
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return row.unpivot([], list(required), "field", "n")

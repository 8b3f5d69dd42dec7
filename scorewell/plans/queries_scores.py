"""Canonical dataset, score aggregates and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import first_row, shared_dir
from ..functions import text as tx
from ..operators import canonical as cn
from ..operators import descriptive as de
from ..operators import scores as sc
from ..operators import scoring as sg
from ..sources import responses as src
from . import tables as t
from .registry import query
from .sqltext import sql

S = t.SURVEYS
COLS = "user_id, module_id, instrument_key, question_id, response_value, item_score, construct, grade, submitted_at, completed_at, cohort_id"


@query("read_responses", sql("SELECT * FROM responses", "responses"))
def _(spark, sf):
    path = shared_dir(spark, "response-log")
    t.responses(spark, sf).withColumn("device", F.lit("web")).write.parquet(path)
    return src.read_responses(spark, path)


@query("canonical_dataset", sql(f"SELECT {COLS} FROM canon", "canon"))
def _(spark, sf):
    return t.canonical(spark, sf)


SPEC = cn.FilterSpec(
    module_ids=["module_1", "module_2", "module_5"], grades=["Adult", "Fifth (5th) grade"], constructs=[],
    submitted_after="1996-01-01", submitted_before="2000-06-30", min_score=1.0, max_score=3.0, completed_after=None,
)


@query(
    "filter_spec",
    sql(
        f"""SELECT {COLS} FROM canon WHERE module_id IN ('module_1','module_2','module_5')
        AND grade IN ('Adult','Fifth (5th) grade') AND submitted_at > TIMESTAMP '1996-01-01'
        AND submitted_at < TIMESTAMP '2000-06-30' AND item_score >= 1 AND item_score <= 3""",
        "canon",
    ),
)
def _(spark, sf):
    return t.canonical(spark, sf, SPEC)


@query(
    "filter_hash",
    sql(
        """SELECT module_id, sha256('{"cohort_ids": null, "completed_after": null, "completed_before": null, "constructs": null, "grades": null, "instrument_keys": null, "max_score": null, "min_score": 1.0, "module_ids": ["module_1", "module_5"], "question_ids": null, "submitted_after": null, "submitted_before": null, "user_ids": null}') AS filter_hash,
        count(*) AS n FROM canon WHERE module_id IN ('module_1','module_5') AND item_score >= 1 GROUP BY module_id""",
        "canon",
    ),
)
def _(spark, sf):
    spec = cn.FilterSpec(module_ids=["module_5", "module_1"], min_score=1.0)
    df = spec.apply(t.canonical(spark, sf))
    return df.groupBy("module_id").agg(F.count(F.lit(1)).alias("n")).withColumn("filter_hash", spec.hash_column())


@query(
    "drop_excluded",
    sql("SELECT instrument_key, count(*) AS n, count(DISTINCT user_id) AS users FROM scored WHERE lower(trim(user_id)) NOT IN ('u7','u11','u100') GROUP BY 1", "scored"),
)
def _(spark, sf):
    df = cn.drop_excluded(t.scored(spark, sf), [" U7 ", "u11", "U100", ""])
    return df.groupBy("instrument_key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


ROW_TEXT = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '\\N')" for c in cn.CANONICAL_COLUMNS)
LANE_SUMS = ", ".join(f"sum(CAST(concat('0x', substr(h, {1 + 12 * i}, 12)) AS BIGINT)::HUGEINT) AS s{i}" for i in range(5))


@query("dataset_fingerprint", sql(f"""WITH hs AS (SELECT sha256(concat_ws(chr(1), {ROW_TEXT})) AS h FROM canon), sm AS (SELECT count(*) AS n_rows, {LANE_SUMS} FROM hs)
   SELECT n_rows, sha256(concat_ws('|', CAST(n_rows AS VARCHAR), {", ".join(f"CAST(s{i} AS VARCHAR)" for i in range(5))}, '')) AS dataset_hash FROM sm""", "canon"))
def _(spark, sf):
    return cn.dataset_fingerprint(t.canonical(spark, sf))


@query(
    "item_dim",
    sql(
        """SELECT DISTINCT instrument_name AS instrument_key, question_id,
        CASE WHEN q <= 3 THEN 'low' ELSE 'high' END AS construct, concat('module_', CAST(module_num AS VARCHAR)) AS module_id FROM parsed""",
        "parsed",
    ),
)
def _(spark, sf):
    """Definitions nested from the log itself (one section per half of the questions), flattened again."""
    seen = t.responses(spark, sf).select("instrument_name", "question_id").distinct()
    half = F.when(F.substring("question_id", 2, 9).cast("int") <= 3, "LOW").otherwise("HIGH")
    sections = (
        seen.groupBy("instrument_name", half.alias("name"))
        .agg(F.collect_set(F.struct(F.col("question_id").alias("id"), F.lit("").alias("text"))).alias("questions"))
        .groupBy(F.col("instrument_name").alias("instrument_key"))
        .agg(F.collect_list(F.struct("name", "questions")).alias("sections"))
        .withColumn("module_id", F.element_at(F.split("instrument_key", "_"), 1))
    )
    return src.flatten_definitions(sections)


@query(
    "shared_definitions",
    sql(
        """SELECT DISTINCT concat('module', CAST(m.m AS VARCHAR), '_', base) AS instrument_key, question_id,
        CAST(NULL AS VARCHAR) AS construct, concat('module_', CAST(m.m AS VARCHAR)) AS module_id
        FROM parsed, (SELECT unnest([1,2,3]) AS m) m WHERE base <> 'content_mcq_assessment'""",
        "parsed",
    ),
)
def _(spark, sf):
    """A survey shared by several modules, replicated per module number."""
    seen = t.responses(spark, sf).filter(tx.is_survey(F.col("instrument_name"), S))
    base = F.regexp_replace("instrument_name", r"^module\d+_", "")
    bank = seen.groupBy(base.alias("instrument_key")).agg(
        F.collect_set(F.struct(F.col("question_id").alias("id"), F.lit("").alias("text"))).alias("question_bank")
    ).withColumn("module_id", F.lit("global"))
    return src.flatten_definitions(src.share_across_modules(bank, [1, 2, 3]))


@query(
    "answer_key_dim",
    sql(
        """WITH keyed AS (SELECT DISTINCT instrument_name AS instrument_key, question_id, module_num, q, version FROM parsed
            WHERE base = 'content_mcq_assessment' AND NOT (q = 7 AND version = 0))
        SELECT instrument_key, question_id, substr('ABCD', 1 + (module_num + q + version) % 4, 1) AS answer,
        CASE WHEN version = 0 THEN TIMESTAMP '1998-01-01' END AS valid_until FROM keyed""",
        "parsed",
    ),
)
def _(spark, sf):
    """Answer keys of the versions in use in the log."""
    used = t.responses(spark, sf).select(
        F.col("instrument_name").alias("instrument_key"),
        "question_id",
        (F.col("submitted_at") < F.lit(t.KEY_CHANGE).cast("timestamp_ntz")).alias("old"),
    ).distinct()
    keys = src.flatten_answer_keys(t.scoring(spark)).withColumn("old", F.col("valid_until").isNotNull())
    return keys.join(used, ["instrument_key", "question_id", "old"]).select(
        "instrument_key", "question_id", "answer", F.col("valid_until").cast("timestamp_ntz").alias("valid_until")
    )


@query(
    "scale_dim",
    sql(
        """SELECT DISTINCT instrument_key, response_value AS label, item_score AS score,
        (base = 'engagement_survey' AND q IN (6,7)) AS is_reverse FROM scored WHERE base <> 'content_mcq_assessment'""",
        "scored",
    ),
)
def _(spark, sf):
    """Scale entries met in the log, forward or reverse by the item's list."""
    scoring = t.scoring(spark)
    reverse = src.flatten_reverse_items(scoring).withColumn("is_reverse", F.lit(True))
    used = t.responses(spark, sf).select(
        F.col("instrument_name").alias("instrument_key"), "question_id", F.col("response_value").alias("label")
    ).distinct()
    used = used.join(F.broadcast(reverse), ["instrument_key", "question_id"], "left").na.fill(False, ["is_reverse"])
    return used.join(src.flatten_scales(scoring), ["instrument_key", "label", "is_reverse"]).select(
        "instrument_key", "label", "score", "is_reverse"
    ).distinct()


@query(
    "normalize_schema",
    sql("SELECT user_id, instrument_name AS instrument_key, question_id, response_value, submitted_at FROM responses", "responses"),
)
def _(spark, sf):
    old = t.responses(spark, sf).withColumnRenamed("response_value", "response_raw").withColumnRenamed("submitted_at", "timestamp")
    return cn.normalize_schema(old)


@query(
    "normalize_choice",
    sql("SELECT instrument_name, trim(split_part(trim(concat('  ', response_value, ' ')), ':', 1)) AS choice, count(*) AS n FROM responses GROUP BY 1, 2", "responses"),
)
def _(spark, sf):
    padded = F.concat(F.lit("  "), F.col("response_value"), F.lit(" "))
    return t.responses(spark, sf).groupBy("instrument_name", tx.normalize_choice(padded).alias("choice")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "resolve_instrument_key",
    sql(
        """WITH n AS (SELECT instrument_name AS raw FROM responses UNION ALL SELECT concat('precourse_', base) FROM parsed
           UNION ALL SELECT 'precourse_demographics_survey' FROM customer UNION ALL SELECT concat('x_demographics_survey') FROM customer)
        SELECT raw, CASE WHEN raw LIKE '%\\_engagement\\_survey' ESCAPE '\\' THEN 'engagement_survey'
          WHEN raw LIKE '%\\_motivation\\_survey' ESCAPE '\\' THEN 'motivation_survey'
          WHEN raw LIKE 'precourse\\_%' ESCAPE '\\' THEN substr(raw, 11)
          WHEN raw LIKE '%\\_demographics\\_survey' ESCAPE '\\' THEN 'demographics_survey' ELSE raw END AS resolved, count(*) AS n
        FROM n GROUP BY 1, 2""",
        "responses", "parsed",
    ),
)
def _(spark, sf):
    r = t.responses(spark, sf).select(F.col("instrument_name").alias("raw"))
    base = F.regexp_replace("raw", r"^module\d+_", "")
    c = t.table(spark, sf, "customer")
    names = r.unionAll(r.select(F.concat(F.lit("precourse_"), base))).unionAll(
        c.select(F.lit("precourse_demographics_survey"))).unionAll(c.select(F.lit("x_demographics_survey")))
    return names.groupBy("raw", tx.resolve_instrument_key(F.col("raw"), S).alias("resolved")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "normalize_module_id",
    sql("""SELECT split_part(instrument_name, '_', 1) AS raw, concat('module_', CAST(module_num AS VARCHAR)) AS module_id,
        concat('module_', CAST(module_num AS VARCHAR)) AS again, count(*) AS n FROM parsed GROUP BY 1, 2""", "parsed"),
)
def _(spark, sf):
    raw = F.element_at(F.split("instrument_name", "_"), 1)
    once = tx.normalize_module_id(raw)
    return t.responses(spark, sf).groupBy(raw.alias("raw"), once.alias("module_id")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "again", tx.normalize_module_id(F.col("module_id")))


@query(
    "infer_module",
    sql("""SELECT instrument_name, CASE WHEN base = 'content_mcq_assessment' THEN concat('module_', CAST(module_num AS VARCHAR)) ELSE 'survey' END AS module_id,
        count(*) AS n FROM parsed GROUP BY 1, 2""", "parsed"),
)
def _(spark, sf):
    return t.responses(spark, sf).groupBy("instrument_name", tx.infer_module(F.col("instrument_name")).alias("module_id")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "normalize_demographics",
    sql(
        """SELECT user_id, CASE WHEN g.grade = 'Grade X' THEN 'Grade X' ELSE g.grade END AS grade, grade_level, gender, first_language_english FROM (
          SELECT user_id, coalesce(grade, 'Grade X') AS grade, grade_level, gender, first_language_english FROM demographics) g""",
        "demographics",
    ),
)
def _(spark, sf):
    """Long demographic answers with noise (spacing, case, duplicates) cleaned back to one row per user."""
    d = t.demographics(spark, sf)
    when = F.lit("2020-01-01").cast("timestamp")
    rows = F.array(
        F.struct(F.lit("G").alias("q"), F.concat(F.coalesce("grade", F.lit("Grade X"))).alias("v"), when.alias("ts")),
        F.struct(F.lit("S").alias("q"), F.concat(F.lit(" "), F.coalesce("gender", F.lit("other"))).alias("v"), when.alias("ts")),
        F.struct(F.lit("L").alias("q"), F.initcap(F.coalesce(F.col("first_language_english").cast("string"), F.lit("maybe"))).alias("v"), when.alias("ts")),
        F.struct(F.lit("G").alias("q"), F.lit("Adult").alias("v"), F.lit("2021-01-01").cast("timestamp").alias("ts")),
    )
    long = d.select("user_id", F.explode(rows).alias("r")).select(
        "user_id", F.col("r.q").alias("question_id"), F.col("r.v").alias("response_value"), F.col("r.ts").alias("submitted_at"))
    return de.normalize_demographics(long, "G", "L", "S")


@query(
    "normalize_import_demographics",
    sql(
        """WITH users AS (SELECT DISTINCT s.user_id, cohort_id FROM (SELECT DISTINCT user_id FROM responses) s LEFT JOIN cohort_map USING (user_id))
        SELECT u.user_id, grade, grade_level, gender, first_language_english, cohort_id FROM users u LEFT JOIN demographics d USING (user_id)""",
        "responses", "demographics", "cohort_map",
    ),
)
def _(spark, sf):
    lang = F.col("first_language_english")
    raw = t.demographics(spark, sf).select(
        F.concat(F.lit(" "), F.col("user_id")).alias("user_id"), F.coalesce("grade", F.lit("nan")).alias("grade"),
        F.coalesce("gender", F.lit("-")).alias("gender"),
        F.when(lang, " YES").when(~lang, "0").otherwise("").alias("first_language_english"))
    users = t.responses(spark, sf).select("user_id").distinct().join(t.cohort_map(spark, sf), "user_id", "left")
    return de.normalize_import_demographics(raw, users)


@query(
    "is_survey_instrument",
    sql("SELECT instrument_name, base <> 'content_mcq_assessment' AS is_survey, base = 'content_mcq_assessment' AS is_assessment, count(*) AS n FROM parsed GROUP BY ALL", "parsed"),
)
def _(spark, sf):
    flag = tx.is_survey(F.col("instrument_name"), S)
    return t.responses(spark, sf).groupBy("instrument_name", flag.alias("is_survey"), (~flag).alias("is_assessment")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "instrument_match",
    sql("SELECT instrument_key, count(*) AS n FROM scored WHERE base = 'motivation_survey' GROUP BY 1", "scored"),
)
def _(spark, sf):
    df = t.scored(spark, sf).filter(tx.matches_base(F.col("instrument_key"), "motivation_survey"))
    return df.groupBy("instrument_key").agg(F.count(F.lit(1)).alias("n"))


@query("binary_items", sql("SELECT instrument_key, question_id, count(*) AS n, sum(item_score) AS right_answers FROM scored WHERE item_score IN (0, 1) GROUP BY 1, 2", "scored"))
def _(spark, sf):
    return sc.binary_items(t.scored(spark, sf)).groupBy("instrument_key", "question_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("item_score").alias("right_answers"))


@query(
    "attach_metadata",
    sql("SELECT instrument_key, module_id, question_id, construct, count(*) AS n FROM scored GROUP BY ALL", "scored"),
)
def _(spark, sf):
    df = cn.attach_metadata(cn.normalize_schema(t.responses(spark, sf)), t.rulebook(spark).items)
    return df.groupBy("instrument_key", "module_id", "question_id", "construct").agg(F.count(F.lit(1)).alias("n"))


@query("unresolved_items", sql("SELECT CASE WHEN module_num = 6 THEN 'unknown_test' ELSE concat('module', CAST(module_num AS VARCHAR), '_', base) END AS instrument_key, CASE WHEN module_num = 6 THEN question_id ELSE 'Q9' END AS question_id, CASE WHEN module_num = 6 THEN 'instrument' ELSE 'question' END AS reason, count(*) AS n_rows FROM scored WHERE module_num = 6 OR question_id = 'Q3' GROUP BY ALL", "scored"))
def _(spark, sf):
    """Answers of module 6 under an undefined instrument, and Q3 of the others under a question that is not listed."""
    df = cn.normalize_schema(t.responses(spark, sf))
    lost = F.col("instrument_key").startswith("module6")
    df = df.withColumn("question_id", F.when(~lost & (F.col("question_id") == "Q3"), " Q9").otherwise(F.col("question_id"))).withColumn("instrument_key", F.when(lost, "unknown_test ").otherwise(F.col("instrument_key")))
    return cn.unresolved_items(df, t.rulebook(spark).item_dim)


@query("attach_grade", sql("SELECT r.user_id, question_id, instrument_name, grade FROM responses r LEFT JOIN demographics d ON r.user_id = d.user_id", "responses", "demographics"))
def _(spark, sf):
    return cn.attach_grade(t.responses(spark, sf), t.demographics(spark, sf)).select("user_id", "question_id", "instrument_name", "grade")


@query("attach_cohort", sql("SELECT cohort_id, count(*) AS n, count(DISTINCT r.user_id) AS users FROM responses r LEFT JOIN cohort_map d ON r.user_id = d.user_id GROUP BY 1", "responses", "cohort_map"))
def _(spark, sf):
    df = cn.attach_cohort(t.responses(spark, sf), t.cohort_map(spark, sf))
    return df.groupBy("cohort_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("score_binary_versions", sql("SELECT user_id, instrument_key, question_id, submitted_at, item_score FROM scored WHERE base = 'content_mcq_assessment'", "scored"))
def _(spark, sf):
    df = cn.normalize_schema(t.responses(spark, sf)).filter(F.col("instrument_key").endswith(t.MCQ))
    return sg.score_items(df, t.rulebook(spark).rules).select("user_id", "instrument_key", "question_id", "submitted_at", "item_score")


@query("score_likert", sql("SELECT instrument_key, question_id, response_value, item_score, count(*) AS n FROM scored WHERE base <> 'content_mcq_assessment' GROUP BY ALL", "scored"))
def _(spark, sf):
    df = cn.normalize_schema(t.responses(spark, sf)).filter(tx.is_survey(F.col("instrument_key"), S))
    scored = sg.score_items(df, t.rulebook(spark).rules)
    return scored.groupBy("instrument_key", "question_id", "response_value", "item_score").agg(F.count(F.lit(1)).alias("n"))


def _points_rules(spark):
    rows = [(f"module{m}_{t.MCQ}", "points", None, None, None, None, None,
             {f"Q{q}": {f"{x}: option": float(i * q) for i, x in enumerate("ABC" if q == 7 else "ABCD")} for q in range(1, 8)})
            for m in t.MODULES]
    return cn.pin_config(sg.rule_table(spark.createDataFrame(rows, src.SCORING_SCHEMA)))


@query(
    "score_points",
    sql(
        """SELECT user_id, instrument_key, CASE WHEN bad = 0 THEN total END AS total_score, n AS n_answers, CAST(0 AS BIGINT) AS n_unknown,
          CASE WHEN bad > 0 THEN 'answer without points' END AS error FROM (
          SELECT user_id, instrument_key, sum(CASE WHEN q = 7 AND substr(response_value,1,1) = 'D' THEN 0 ELSE q * (ascii(response_value) - 65) END)::DOUBLE AS total,
            count(*) AS n, sum(CASE WHEN q = 7 AND substr(response_value,1,1) = 'D' THEN 1 ELSE 0 END) AS bad
          FROM scored WHERE base = 'content_mcq_assessment' GROUP BY 1, 2)""",
        "scored",
    ),
)
def _(spark, sf):
    df = cn.normalize_schema(t.responses(spark, sf)).filter(F.col("instrument_key").endswith(t.MCQ))
    return sg.instrument_totals(df, _points_rules(spark))


@query(
    "instrument_totals",
    sql(
        """SELECT user_id, instrument_key, CASE WHEN bad = 0 THEN total END AS total_score, n AS n_answers, bad AS n_unknown,
          CASE WHEN bad > 0 THEN 'unknown question ids' END AS error FROM (
          SELECT user_id, instrument_key, coalesce(sum(item_score), 0) AS total, count(*) AS n, count(*) FILTER (item_score IS NULL) AS bad
          FROM scored GROUP BY 1, 2)""",
        "scored",
    ),
)
def _(spark, sf):
    return sg.instrument_totals(cn.normalize_schema(t.responses(spark, sf)), t.rulebook(spark).rules)


@query(
    "unknown_question_ids",
    sql("SELECT DISTINCT instrument_key, concat(question_id, 'x') AS question_id FROM scored WHERE base = 'content_mcq_assessment' AND q > 4", "scored"),
)
def _(spark, sf):
    df = cn.normalize_schema(t.responses(spark, sf))
    broken = F.when(F.substring("question_id", 2, 9).cast("int") > 4, F.concat("question_id", F.lit("x"))).otherwise(F.col("question_id"))
    return sg.unknown_question_ids(df.withColumn("question_id", broken), t.rulebook(spark).rules)


# -- aggregates -------------------------------------------------------------------------------

ASSESS = """assess AS (SELECT user_id, instrument_key, count(item_score) AS n_items_answered, sum(item_score) AS raw_score, max(grade) AS grade,
   max(cohort_id) AS cohort_id, round(sum(item_score) / count(item_score) * 100, 4) AS pct_correct
   FROM canon WHERE base = 'content_mcq_assessment' AND item_score IS NOT NULL GROUP BY 1, 2)"""
MEANS = """means AS (SELECT user_id, instrument_key, module_id, construct, count(*) AS n_items, sum(item_score) AS total_score, max(grade) AS grade,
   max(cohort_id) AS cohort_id, round(sum(item_score) / count(*), 4) AS mean_score
   FROM canon WHERE base <> 'content_mcq_assessment' AND item_score IS NOT NULL GROUP BY 1, 2, 3, 4)"""


def assess(spark, sf):
    return sc.assessment_scores(t.canonical(spark, sf), S)


def means(spark, sf):
    return sc.construct_means(t.canonical(spark, sf), S)


@query("assessment_scores", sql(f"WITH {ASSESS} SELECT * FROM assess", "canon"))
def _(spark, sf):
    return assess(spark, sf)


@query("construct_means", sql(f"WITH {MEANS} SELECT * FROM means", "canon"))
def _(spark, sf):
    return means(spark, sf)


@query(
    "aggregate_construct_means",
    sql(f"""WITH {MEANS} SELECT user_id, instrument_key, construct, count(n_items) AS n_modules, sum(n_items)::BIGINT AS n_items_total,
        sum(total_score) AS total_score, round(sum(total_score) / sum(n_items), 4) AS mean_score FROM means GROUP BY 1, 2, 3""", "canon"),
)
def _(spark, sf):
    return sc.aggregate_construct_means(means(spark, sf))


def _summary_sql(keys: str, value: str, tag: str, source: str) -> str:
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM m.{k}" for k in ks)
    return f"""SELECT {', '.join('a.' + k for k in ks)}, a.n_users, a.mean_{tag}, a.median_{tag}, m.v AS mode_{tag} FROM (
      SELECT {keys}, count({value}) AS n_users, round(avg({value}), 4) AS mean_{tag}, round(median({value}), 4) AS median_{tag} FROM {source} GROUP BY {keys}) a
      JOIN (SELECT {keys}, v FROM (SELECT {keys}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, {value}) AS rn
            FROM {source} GROUP BY {keys}, {value}) WHERE rn = 1) m ON {on}"""


@query("summarize_scores_by_cohort", sql(f"WITH {ASSESS} " + _summary_sql("instrument_key, cohort_id", "pct_correct", "pct", "assess"), "canon"))
def _(spark, sf):
    return sc.summarize_scores(assess(spark, sf), "cohort_id")


@query("summarize_scores", sql(f"WITH {ASSESS} " + _summary_sql("instrument_key", "pct_correct", "pct", "assess"), "canon"))
def _(spark, sf):
    return sc.summarize_scores(assess(spark, sf))


@query(
    "summarize_constructs_by_gender",
    sql(f"WITH {MEANS}, g AS (SELECT m.*, gender FROM means m LEFT JOIN demographics d ON m.user_id = d.user_id) "
        + _summary_sql("instrument_key, construct, gender", "mean_score", "score", "g"), "canon"),
)
def _(spark, sf):
    return sc.summarize_scores(means(spark, sf), "gender", t.demographics(spark, sf))


@query("user_scores", sql("SELECT user_id, sum(item_score) AS score FROM scored WHERE base = 'engagement_survey' GROUP BY 1", "scored"))
def _(spark, sf):
    return sc.user_scores(t.scored(spark, sf), "engagement_survey")


@query("user_pct_correct", sql("SELECT user_id, round(sum(item_score) / count(item_score) * 100, 6) AS score FROM scored WHERE base = 'content_mcq_assessment' AND item_score IS NOT NULL GROUP BY 1", "scored"))
def _(spark, sf):
    return sc.user_scores(t.scored(spark, sf), t.MCQ, True).withColumn("score", F.round("score", 6))


@query(
    "construct_means_by_module",
    sql("SELECT user_id, module_id, round(avg(item_score), 6) AS score FROM scored WHERE base = 'motivation_survey' AND construct IN ('intrinsic_motivation','amotivation') GROUP BY 1, 2", "scored"),
)
def _(spark, sf):
    df = sc.construct_means_by_module(t.scored(spark, sf), "motivation_survey", ["intrinsic_motivation", "amotivation"])
    return df.withColumn("score", F.round("score", 6))


COMPOSITES = {"engaged": ["task", "effort"], "focus": ["attention"], "all_in": ["task", "effort", "attention"]}


@query(
    "composite_scores",
    sql(
        """WITH map AS (SELECT * FROM (VALUES ('task','engaged'),('effort','engaged'),('attention','focus'),('task','all_in'),('effort','all_in'),('attention','all_in')) v(construct, composite))
        SELECT user_id, module_id, composite, count(DISTINCT s.construct) AS n_subconstructs, count(*) AS n_items_total, sum(item_score) AS total_score,
        round(sum(item_score) / count(*), 6) AS mean_score FROM scored s JOIN map ON s.construct = map.construct WHERE base = 'engagement_survey' GROUP BY 1, 2, 3""",
        "scored",
    ),
)
def _(spark, sf):
    return sc.composite_scores(t.scored(spark, sf), "engagement_survey", COMPOSITES).withColumn("mean_score", F.round("mean_score", 6))


RAI = """rai AS (SELECT user_id, module_id, 2 * max(CASE WHEN construct = 'intrinsic_motivation' THEN mean_score END)
   + max(CASE WHEN construct = 'identified_regulation' THEN mean_score END) - max(CASE WHEN construct = 'external_regulation' THEN mean_score END)
   - 2 * max(CASE WHEN construct = 'amotivation' THEN mean_score END) AS rai, CAST(count(*) AS INT) AS n_subscales_present
   FROM means WHERE instrument_key LIKE '%motivation_survey' GROUP BY 1, 2)"""


@query("relative_autonomy_index", sql(f"WITH {MEANS}, {RAI} SELECT user_id, module_id, round(rai, 6) AS rai, n_subscales_present FROM rai", "canon"))
def _(spark, sf):
    return sc.relative_autonomy_index(t.scored(spark, sf), "motivation_survey", S).withColumn("rai", F.round("rai", 6))


def person_module(spark, sf):
    df = t.scored(spark, sf)
    comp = sc.composite_scores(df, "engagement_survey", COMPOSITES).filter(F.col("composite") == "all_in")
    return sc.person_module_dataset(df, {"engaged": comp, "autonomy": sc.relative_autonomy_index(df, "motivation_survey", S)}, t.MCQ)


PERSON_MODULE = f"""{MEANS}, {RAI}, pm AS (SELECT o.user_id, o.module_id, o.pct_correct, e.engaged, r.rai AS autonomy,
   CAST(substr(o.module_id, 8) AS INT) AS module_num FROM (
     SELECT user_id, module_id, sum(item_score) / count(item_score) * 100 AS pct_correct FROM scored WHERE base = 'content_mcq_assessment' AND item_score IS NOT NULL GROUP BY 1, 2) o
   LEFT JOIN (SELECT user_id, module_id, sum(item_score) / count(*) AS engaged FROM scored WHERE base = 'engagement_survey' GROUP BY 1, 2) e USING (user_id, module_id)
   LEFT JOIN rai r USING (user_id, module_id))"""


@query("person_module_dataset", sql(f"WITH {PERSON_MODULE} SELECT user_id, module_id, module_num, round(pct_correct, 6) AS pct_correct, round(engaged, 6) AS engaged, round(autonomy, 6) AS autonomy FROM pm", "canon", "scored"))
def _(spark, sf):
    df = person_module(spark, sf)
    return df.select("user_id", "module_id", "module_num", *[F.round(c, 6).alias(c) for c in ("pct_correct", "engaged", "autonomy")])


@query(
    "person_mean_center",
    sql(f"""WITH {PERSON_MODULE} SELECT user_id, module_id, round(avg(engaged) OVER (PARTITION BY user_id), 6) AS engaged_between,
        round(engaged - avg(engaged) OVER (PARTITION BY user_id), 6) + 0.0 AS engaged_within, round(avg(autonomy) OVER (PARTITION BY user_id), 6) AS autonomy_between,
        round(autonomy - avg(autonomy) OVER (PARTITION BY user_id), 6) + 0.0 AS autonomy_within FROM pm""", "canon", "scored"),
)
def _(spark, sf):
    df = sc.person_mean_center(person_module(spark, sf), ["engaged", "autonomy"])
    cols = ("engaged_between", "engaged_within", "autonomy_between", "autonomy_within")
    return df.select("user_id", "module_id", *[(F.round(c, 6) + 0.0).alias(c) for c in cols])


@query("eligible_subjects", sql(f"WITH {PERSON_MODULE} SELECT user_id, module_id FROM pm WHERE user_id IN (SELECT user_id FROM pm GROUP BY 1 HAVING count(DISTINCT module_id) >= 5)", "canon", "scored"))
def _(spark, sf):
    return sc.eligible_subjects(person_module(spark, sf), 5).select("user_id", "module_id")


@query(
    "complete_cases",
    sql("""WITH p AS (SELECT user_id, module_id, sum(item_score) / count(item_score) * 100 AS score FROM scored WHERE base = 'content_mcq_assessment' AND item_score IS NOT NULL GROUP BY 1, 2)
        SELECT user_id, module_id, round(score, 6) AS score FROM p WHERE user_id IN (SELECT user_id FROM p GROUP BY 1 HAVING count(*) = 7)""", "scored"),
)
def _(spark, sf):
    long = sc.percent_by_module(t.scored(spark, sf), t.MCQ)
    return sc.complete_cases(long, "user_id", "module_id", "score", 7).select("user_id", "module_id", F.round("score", 6).alias("score"))


@query(
    "drop_constant_items",
    sql("""WITH m AS (SELECT concat(question_id, '_', response_value) AS question_id, item_score FROM scored WHERE item_score IS NOT NULL)
        SELECT question_id, count(*) AS n FROM m GROUP BY 1 HAVING min(item_score) < max(item_score)""", "scored"),
)
def _(spark, sf):
    df = t.scored(spark, sf).filter(F.col("item_score").isNotNull()).withColumn("question_id", F.concat_ws("_", "question_id", "response_value"))
    return sc.drop_constant_items(df).groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))


BINARY = """bin AS (SELECT user_id, question_id, item_score FROM (SELECT *, row_number() OVER (PARTITION BY user_id, question_id
    ORDER BY submitted_at, instrument_key, item_score) AS rn FROM scored WHERE base = 'content_mcq_assessment' AND item_score IN (0, 1)) WHERE rn = 1)"""


@query("binary_matrix", sql(f"WITH {BINARY} SELECT * FROM bin", "scored"))
def _(spark, sf):
    return sc.binary_matrix(t.scored(spark, sf), t.MCQ)


@query(
    "likert_matrix",
    sql("""SELECT user_id, question_id, round_even(avg(item_score), 0) AS item_score FROM scored WHERE base = 'engagement_survey' AND construct = 'task' GROUP BY 1, 2""", "scored"),
)
def _(spark, sf):
    return sc.likert_matrix(t.scored(spark, sf), "engagement_survey", "task")


@query(
    "response_forms",
    sql(f"""WITH {BINARY}, f AS (SELECT string_agg(question_id, ', ' ORDER BY question_id) AS items, count(*) AS n_items FROM bin GROUP BY user_id),
        g AS (SELECT items, count(*) AS n_students, max(n_items) AS n_items FROM f GROUP BY 1)
        SELECT concat('Form ', CAST(row_number() OVER (ORDER BY n_students DESC, md5(items), items) AS VARCHAR)) AS form, n_students, n_items, items FROM g""", "scored"),
)
def _(spark, sf):
    return sc.response_forms(sc.binary_matrix(t.scored(spark, sf), t.MCQ))


@query(
    "subset_form",
    sql(f"""WITH {BINARY}, f AS (SELECT user_id, string_agg(question_id, ',' ORDER BY question_id) AS items FROM bin GROUP BY user_id)
        SELECT user_id, question_id, item_score FROM bin WHERE user_id IN (SELECT user_id FROM f WHERE items = 'Q1,Q2,Q3,Q4,Q5,Q6,Q7')""", "scored"),
)
def _(spark, sf):
    return sc.subset_form(sc.binary_matrix(t.scored(spark, sf), t.MCQ), [f"Q{i}" for i in range(1, 8)]).select("user_id", "question_id", "item_score")


# -- participants -----------------------------------------------------------------------------

TOTAL = "(SELECT count(DISTINCT user_id) FROM demographics)"


@query("count_participants", sql("SELECT count(DISTINCT user_id) AS n FROM demographics", "demographics"))
def _(spark, sf):
    return de.count_participants(t.demographics(spark, sf))


@query("count_by_gender", sql(f"SELECT coalesce(gender, 'Unknown') AS gender, count(*) AS n, round(count(*) / {TOTAL} * 100, 2) AS pct FROM demographics GROUP BY 1", "demographics"))
def _(spark, sf):
    return de.count_by_gender(t.demographics(spark, sf))


@query("count_by_grade", sql(f"SELECT coalesce(grade_level, 'Unknown') AS grade_level, coalesce(grade, 'Unknown') AS grade, count(*) AS n, round(count(*) / {TOTAL} * 100, 2) AS pct FROM demographics GROUP BY 1, 2", "demographics"))
def _(spark, sf):
    return de.count_by_grade(t.demographics(spark, sf))


LANG = "CASE WHEN first_language_english THEN 'English' WHEN NOT first_language_english THEN 'Non-English' ELSE 'Unknown' END"


@query("count_by_language", sql(f"SELECT first_language_english, {LANG} AS label, count(*) AS n, round(count(*) / {TOTAL} * 100, 2) AS pct FROM demographics GROUP BY 1, 2", "demographics"))
def _(spark, sf):
    return de.count_by_language(t.demographics(spark, sf))


@query("count_by_cohort", sql(f"SELECT coalesce(cohort_id, 'Unassigned') AS cohort_id, count(*) AS n, round(count(*) / {TOTAL} * 100, 2) AS pct FROM demographics LEFT JOIN cohort_map USING (user_id) GROUP BY 1", "demographics", "cohort_map"))
def _(spark, sf):
    return de.count_by_cohort(t.demographics(spark, sf), t.cohort_map(spark, sf))


@query(
    "participant_summary",
    sql(f"""WITH d AS (SELECT user_id, coalesce(gender, 'Unknown') AS gender, coalesce(grade_level, 'Unknown') AS grade_level, coalesce(grade, 'Unknown') AS grade, {LANG} AS language,
          coalesce(cohort_id, 'Unassigned') AS cohort_id FROM demographics LEFT JOIN cohort_map USING (user_id)),
        u AS (SELECT 'gender' AS breakdown, gender AS label, NULL AS grade, count(*) AS n FROM d GROUP BY 2 UNION ALL SELECT 'grade_level', grade_level, grade, count(*) FROM d GROUP BY 2, 3
          UNION ALL SELECT 'language', language, NULL, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'cohort_id', cohort_id, NULL, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'total', 'all', NULL, count(*) FROM d)
        SELECT breakdown, label, grade, n, round(n / {TOTAL} * 100, 2) AS pct FROM u""", "demographics", "cohort_map"),
)
def _(spark, sf):
    return de.participant_summary(t.demographics(spark, sf), t.cohort_map(spark, sf))


@query(
    "missingness_by_module",
    sql("""SELECT concat('module_', CAST(module_num AS VARCHAR)) AS module_id, module_num, count(DISTINCT user_id) AS n_participants,
        round(100.0 * count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM scored), 1) AS pct_of_cohort FROM scored WHERE base = 'content_mcq_assessment' GROUP BY module_num""", "scored"),
)
def _(spark, sf):
    return de.missingness_by_module(t.scored(spark, sf), t.MCQ)


@query(
    "excessive_missingness",
    sql("""WITH c AS (SELECT user_id, count(*) AS n_answered FROM scored WHERE base = 'content_mcq_assessment' GROUP BY 1)
        SELECT user_id, n_answered, (SELECT max(n_answered) FROM c) AS n_expected, round(n_answered / (SELECT max(n_answered) FROM c), 3) AS pct_answered,
        n_answered / (SELECT max(n_answered) FROM c) < 0.5 AS flagged FROM c""", "scored"),
)
def _(spark, sf):
    return de.excessive_missingness(t.scored(spark, sf), [f"module{m}_{t.MCQ}" for m in t.MODULES])


@query(
    "straight_lining",
    sql("""SELECT user_id, instrument_key, count(*) AS n_items, count(DISTINCT response_value) AS n_distinct_responses,
        count(*) >= 3 AND count(DISTINCT response_value) = 1 AS flagged FROM scored WHERE base <> 'content_mcq_assessment' GROUP BY 1, 2""", "scored"),
)
def _(spark, sf):
    return de.straight_lining(t.scored(spark, sf), S)


@query(
    "outliers_iqr",
    sql(f"""WITH {ASSESS}, q AS (SELECT instrument_key, count(*) AS n, quantile_cont(pct_correct, 0.25) AS q1, quantile_cont(pct_correct, 0.75) AS q3 FROM assess GROUP BY 1)
        SELECT a.instrument_key, user_id, pct_correct, n >= 3 AND (pct_correct < q1 - 1.5 * (q3 - q1) OR pct_correct > q3 + 1.5 * (q3 - q1)) AS flagged FROM assess a JOIN q USING (instrument_key)""", "canon"),
)
def _(spark, sf):
    return de.outliers(assess(spark, sf), "pct_correct", ["instrument_key"])


@query(
    "outliers_zscore",
    sql(f"""WITH {ASSESS}, q AS (SELECT instrument_key, count(*) AS n, avg(raw_score) AS m, stddev_samp(raw_score) AS sd FROM assess GROUP BY 1)
        SELECT a.instrument_key, user_id, raw_score, coalesce(n >= 3 AND sd > 0 AND abs((raw_score - m) / sd) > 3, false) AS flagged FROM assess a JOIN q USING (instrument_key)""", "canon"),
)
def _(spark, sf):
    return de.outliers(assess(spark, sf), "raw_score", ["instrument_key"], "zscore")

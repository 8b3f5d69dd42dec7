"""Progress, registry, sinks, competency indices, evidence, ratings, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import materialize, shared_dir
from ..operators import canonical as cn
from ..operators import evidence as ev
from ..operators import indices as ix
from ..operators import ratings as ra
from ..operators import registry as rg
from ..operators import scores as sc
from ..operators import validation as va
from ..operators.progress import module_neighbours, module_progress
from ..sources import responses as src
from ..sources import sinks as sk
from . import tables as t
from .queries_scores import ASSESS, MEANS, assess, means
from .queries_tests import rounded
from .registry import query
from .sqltext import sql

S = t.SURVEYS
BASES = (t.MCQ, *S)

# -- progress ----------------------------------------------------------------------------------

REQUIRED = [(f"module_{m}", [f"module{m}_{b}" for b in BASES] if m != 4 else []) for m in t.MODULES]


def completions(spark, sf):
    r = t.responses(spark, sf)
    return r.select(
        "user_id", F.concat(F.lit("module_"), F.substring("instrument_name", 7, 1)).alias("module_id"), F.col("instrument_name").alias("instrument_key")
    ).distinct()


PROGRESS = """st AS (SELECT u.user_id, m.m, m.m <> 4 AND count(DISTINCT p.base) = 3 AS complete FROM (SELECT DISTINCT user_id FROM parsed) u, (SELECT unnest(range(1, 8)) AS m) m
   LEFT JOIN parsed p ON p.user_id = u.user_id AND p.module_num = m.m GROUP BY 1, 2)"""


@query(
    "module_progress",
    sql(f"""WITH {PROGRESS} SELECT user_id, concat('module_', CAST(m AS VARCHAR)) AS module_id, CAST(m AS INT) AS position, complete,
        CASE WHEN m = 1 THEN true ELSE lag(complete) OVER (PARTITION BY user_id ORDER BY m) END AS unlocked FROM st""", "parsed"),
)
def _(spark, sf):
    return module_progress(completions(spark, sf), REQUIRED)


@query(
    "module_neighbours",
    sql("""SELECT concat('module_', CAST(module_num AS VARCHAR)) AS module_id, CASE WHEN module_num > 1 THEN concat('module_', CAST(module_num - 1 AS VARCHAR)) END AS previous,
        CASE WHEN module_num < 7 THEN concat('module_', CAST(module_num + 1 AS VARCHAR)) END AS next, count(DISTINCT (user_id, base)) AS n FROM parsed GROUP BY module_num""", "parsed"),
)
def _(spark, sf):
    df = module_neighbours(completions(spark, sf), [m for m, _ in REQUIRED])
    return df.groupBy("module_id", "previous", "next").agg(F.count(F.lit(1)).alias("n"))


# -- registry ----------------------------------------------------------------------------------


def users(spark, sf):
    c = t.table(spark, sf, "customer")
    status = F.when(F.col("c_acctbal") < 0, "pending").otherwise("approved")
    role = F.when(F.col("c_custkey") % 50 == 0, "admin").when(F.col("c_custkey") % 10 == 0, "teacher").otherwise("student")
    base = c.select(t._user("c_custkey").alias("user_id"), status.alias("status"), role.alias("role"))
    return base.join(t.cohort_map(spark, sf), "user_id")


USERS = """us AS (SELECT m.user_id, CASE WHEN c_acctbal < 0 THEN 'pending' ELSE 'approved' END AS status,
   CASE WHEN c_custkey % 50 = 0 THEN 'admin' WHEN c_custkey % 10 = 0 THEN 'teacher' ELSE 'student' END AS role, cohort_id
   FROM customer JOIN cohort_map m ON m.user_id = concat('u', CAST(c_custkey AS VARCHAR)))"""


@query("users_by_cohort", sql(f"WITH {USERS} SELECT user_id, role FROM us WHERE cohort_id = 'NATION_7' AND status = 'approved'", "cohort_map"))
def _(spark, sf):
    return rg.users_by(users(spark, sf), "NATION_7", "approved").select("user_id", "role")


@query("pending_users", sql(f"WITH {USERS} SELECT user_id, cohort_id FROM us WHERE status = 'pending'", "cohort_map"))
def _(spark, sf):
    return rg.users_by(users(spark, sf), status="pending").select("user_id", "cohort_id")


@query("cohort_list", sql("SELECT DISTINCT cohort_id FROM cohort_map WHERE cohort_id IS NOT NULL", "cohort_map"))
def _(spark, sf):
    return rg.cohort_list(users(spark, sf))


@query("role_counts", sql(f"WITH {USERS} SELECT count(*) AS total, count(*) FILTER (role = 'admin') AS admin, count(*) FILTER (role = 'teacher') AS teacher, count(*) FILTER (role = 'student') AS student FROM us", "cohort_map"))
def _(spark, sf):
    return rg.role_counts(users(spark, sf), ["admin", "teacher", "student"])


@query("zero_data_users", sql("SELECT user_id FROM cohort_map WHERE user_id NOT IN (SELECT user_id FROM responses WHERE instrument_name LIKE 'module1%') AND user_id NOT IN (SELECT concat('u', CAST(user_id AS VARCHAR)) FROM events WHERE event_type = 'purchase')", "cohort_map", "responses"))
def _(spark, sf):
    events = t.table(spark, sf, "events").filter("event_type = 'purchase'").select(t._user("user_id").alias("user_id"))
    first = t.responses(spark, sf).filter(F.col("instrument_name").startswith("module1"))  # a study of one module
    return rg.zero_data_users(users(spark, sf), first, events).select("user_id")


def score_tables(spark, sf):
    df = t.scored(spark, sf)
    totals = df.groupBy("user_id", "instrument_key").agg(F.sum("item_score").alias("score"))
    survey = F.col("instrument_key").endswith("_survey")
    return {
        "responses": df.select("user_id", "instrument_key"), "completions": completions(spark, sf),
        "survey_scores": totals.filter(survey), "assessment_scores": totals.filter(~survey),
    }


FOOT = """SELECT user_id, instrument_key, count(*) AS responses, CAST(1 AS BIGINT) AS completions, CASE WHEN instrument_key LIKE '%survey' THEN 1 ELSE 0 END::BIGINT AS survey_scores,
  CASE WHEN instrument_key LIKE '%survey' THEN 0 ELSE 1 END::BIGINT AS assessment_scores FROM scored GROUP BY 1, 2"""


@query("user_instrument_footprint", sql(FOOT, "scored"))
def _(spark, sf):
    return rg.footprint(score_tables(spark, sf))


@query("table_counts", sql(f"WITH f AS ({FOOT}) SELECT 'responses' AS table_name, sum(responses)::BIGINT AS n FROM f UNION ALL SELECT 'completions', count(*) FROM f UNION ALL SELECT 'survey_scores', sum(survey_scores)::BIGINT FROM f UNION ALL SELECT 'assessment_scores', sum(assessment_scores)::BIGINT FROM f", "scored"))
def _(spark, sf):
    return rg.table_counts(score_tables(spark, sf))


def transcripts(spark, sf):
    """Documents as transcripts of the cohort named by their source."""
    return t.table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("participant_id"), F.col("source").alias("cohort_id"), F.col("text").alias("content"), "lang")


@query(
    "cohort_usage",
    sql(f"""WITH {USERS}, tr AS (SELECT source AS cohort_id, count(*) AS transcripts FROM documents GROUP BY 1), uc AS (SELECT cohort_id, count(*) AS users FROM us GROUP BY 1),
        co AS (SELECT source AS cohort_id FROM documents UNION SELECT cohort_id FROM us WHERE cohort_id IS NOT NULL UNION SELECT r_name FROM region)
        SELECT cohort_id, coalesce(users, 0) AS users, coalesce(transcripts, 0) AS transcripts, users IS NULL AND transcripts IS NULL AS deletable FROM co LEFT JOIN uc USING (cohort_id) LEFT JOIN tr USING (cohort_id)""", "cohort_map"),
)
def _(spark, sf):
    u, tr = users(spark, sf), transcripts(spark, sf)
    co = u.select("cohort_id").filter("cohort_id IS NOT NULL").union(tr.select("cohort_id")).union(t.table(spark, sf, "region").select("r_name"))
    return rg.cohort_usage(co, u, tr)


@query(
    "delete_cohorts",
    sql(f"""WITH {USERS}, us_in AS (SELECT DISTINCT cohort_id FROM us WHERE cohort_id IS NOT NULL)
        SELECT n_name AS cohort_id, n_nationkey % 2 = 0 AND n_name NOT IN (SELECT cohort_id FROM us_in) AS deleted,
        CASE WHEN n_nationkey % 2 = 0 AND n_name IN (SELECT cohort_id FROM us_in) THEN 'in use' END AS reason FROM nation""", "cohort_map"),
)
def _(spark, sf):
    nations = t.table(spark, sf, "nation")
    wanted = [r[0] for r in nations.filter("n_nationkey % 2 = 0").select("n_name").collect()]  # a caller's list
    registry = nations.select(F.col("n_name").alias("cohort_id"))
    return rg.delete_cohorts(registry, users(spark, sf), transcripts(spark, sf), wanted)


@query("recent_log", sql("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50"))
def _(spark, sf):
    return rg.recent_log(t.table(spark, sf, "events").select("event_id", "ts", "event_type"), "ts", 50, "event_id")


@query("recent_attempts", sql("SELECT user_id, CAST(position AS INT) AS position, event_id, ts, event_type = 'error' AS failed FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS position FROM events) WHERE position <= 10"))
def _(spark, sf):
    e = t.table(spark, sf, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("failed"))
    return rg.recent_attempts(e, "user_id", "ts", "event_id", 10)


SNAP = "sn AS (SELECT strftime(o_orderdate, '%Y%m%d') AS timestamp, count(*) AS n FROM orders GROUP BY 1)"


@query("retain_newest", sql(f"WITH {SNAP}, k AS (SELECT timestamp FROM sn WHERE timestamp NOT LIKE '199601%' AND timestamp NOT LIKE '1997%' ORDER BY 1 DESC LIMIT 30) SELECT timestamp, n, timestamp LIKE '199601%' OR timestamp LIKE '1997%' AS protected, timestamp LIKE '199601%' OR timestamp LIKE '1997%' OR timestamp IN (SELECT timestamp FROM k) AS kept FROM sn"))
def _(spark, sf):
    snaps = t.table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyyMMdd").alias("timestamp")).agg(F.count(F.lit(1)).alias("n"))
    return rg.retain_newest(snaps, 30, ["199601", "1997"])


@query(
    "snapshot_reconcile",
    sql("""SELECT 'orders' AS table_name, count(*) AS n_before, count(*) FILTER (o_orderstatus <> 'P') AS n_after, count(*) FILTER (o_orderstatus <> 'P') AS n_backup, true AS verified FROM orders
        UNION ALL SELECT 'customer', count(*), count(*), count(*) FILTER (c_acctbal > 0), count(*) = count(*) FILTER (c_acctbal > 0) FROM customer"""),
)
def _(spark, sf):
    o, c = t.table(spark, sf, "orders"), t.table(spark, sf, "customer")
    kept = o.filter("o_orderstatus <> 'P'")
    return rg.snapshot_reconcile({"orders": o, "customer": c}, {"orders": kept, "customer": c}, {"orders": kept, "customer": c.filter("c_acctbal > 0")})


ROLL = """f AS (SELECT *, event_type = 'error' AS failed, epoch_us(ts) AS us FROM events),
   w AS (SELECT user_id, event_id, ts, failed, us, count(*) FILTER (failed) OVER w AS n_failures, min(CASE WHEN failed THEN us END) OVER w AS first_us FROM f
         WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {us} PRECEDING AND CURRENT ROW))
   SELECT user_id, event_id, ts, failed, n_failures, n_failures >= 3 AS locked, make_timestamp(first_us) AS first_failure,
     CASE WHEN n_failures > 0 THEN greatest(0, floor((first_us + {us} - us) / 1000000)) ELSE 0 END::BIGINT AS remaining_seconds FROM w"""


def attempts(spark, sf):
    return t.table(spark, sf, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("failed"))


@query("rolling_failures_5min", "WITH " + ROLL.format(us=300_000_000))
def _(spark, sf):
    return rg.rolling_failures(attempts(spark, sf), "user_id", "ts", "failed")


@query("rolling_failures_2days", "WITH " + ROLL.format(us=172_800_000_000))
def _(spark, sf):
    return rg.rolling_failures(attempts(spark, sf), "user_id", "ts", "failed", 172_800, 3, 172_800)


def bank(spark, sf):
    return t.table(spark, sf, "benchmark").select(F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("question_id"), F.col("item_id").alias("position"))


@query("question_draw_random", sql("""WITH RECURSIVE nn AS (SELECT count(*) AS n FROM benchmark), dr AS (SELECT user_id, 0 AS k, []::BIGINT[] AS c FROM cohort_map UNION ALL
     SELECT user_id, k + 1, list_append(c, list_reduce(list_prepend(CAST(concat('0x', substr(md5(concat('7|', user_id, '|', CAST(k AS VARCHAR))), 1, 12)) AS BIGINT) % (n - k), list_sort(c)), lambda x, y: x + CASE WHEN y <= x THEN 1 ELSE 0 END)) FROM dr, nn WHERE k < 5),
   bk AS (SELECT concat('B', CAST(item_id AS VARCHAR)) AS question_id, row_number() OVER (ORDER BY item_id) - 1 AS q FROM benchmark)
   SELECT user_id, CAST(p AS INT) AS position, bk.question_id FROM (SELECT user_id, unnest(c) AS q, unnest(range(1, 6)) AS p FROM dr WHERE k = 5) x JOIN bk ON bk.q = x.q""", "cohort_map"))
def _(spark, sf):
    return rg.question_draw(t.cohort_map(spark, sf), bank(spark, sf), 5)


@query("question_draw_fixed", sql("SELECT user_id, CAST(p AS INT) AS position, q AS question_id FROM cohort_map, (VALUES (1, 'B9'), (2, 'B3'), (3, 'B11')) v(p, q)", "cohort_map"))
def _(spark, sf):
    return rg.question_draw(t.cohort_map(spark, sf), bank(spark, sf), 4, "fixed", ["B9", "none", "B3", "B11"])


@query("question_draw_first", sql("SELECT user_id, CAST(p AS INT) AS position, q AS question_id FROM cohort_map, (SELECT row_number() OVER (ORDER BY item_id) AS p, concat('B', CAST(item_id AS VARCHAR)) AS q FROM benchmark ORDER BY item_id LIMIT 4)", "cohort_map"))
def _(spark, sf):
    return rg.question_draw(t.cohort_map(spark, sf), bank(spark, sf), 4, "fixed", ["none"])


# -- set operations and sinks ------------------------------------------------------------------


def imported(spark, sf, canon=None):
    """Rows as an import file would bring them: some users of the platform, some new ones. ``canon``: the answers, if stored."""
    df = (canon or t.canonical(spark, sf)).filter(F.col("module_id") == "module_2")
    odd = F.substring("user_id", 2, 20).cast("int") % 2 == 1
    return df.withColumn("user_id", F.when(odd, F.concat(F.lit("x"), F.col("user_id"))).otherwise(F.col("user_id"))).withColumn("cohort_id", F.concat(F.lit("C"), F.substring("user_id", -1, 1)))


IMP = """imp AS (SELECT CASE WHEN CAST(substr(user_id, 2) AS INT) % 2 = 1 THEN concat('x', user_id) ELSE user_id END AS user_id, module_id, instrument_key, question_id, response_value, item_score, construct, grade,
   submitted_at, completed_at, concat('C', substr(user_id, length(user_id), 1)) AS cohort_id FROM canon WHERE module_id = 'module_2')"""
PLAT = "pl AS (SELECT user_id, module_id, instrument_key, question_id, response_value, item_score, construct, grade, submitted_at, completed_at, cohort_id FROM canon WHERE module_id <> 'module_2')"


def platform(spark, sf, canon=None):
    return (canon or t.canonical(spark, sf)).filter(F.col("module_id") != "module_2")


@query("union_without_clash", sql(f"WITH {IMP}, {PLAT} SELECT user_id, instrument_key, question_id, cohort_id FROM pl UNION ALL SELECT user_id, instrument_key, question_id, cohort_id FROM imp WHERE user_id NOT IN (SELECT user_id FROM pl)", "canon"))
def _(spark, sf):
    return cn.union_without_clash(platform(spark, sf), imported(spark, sf)).select("user_id", "instrument_key", "question_id", "cohort_id")


@query("clashing_users", sql(f"WITH {IMP}, {PLAT} SELECT user_id FROM pl INTERSECT SELECT user_id FROM imp", "canon"))
def _(spark, sf):
    return platform(spark, sf).select("user_id").intersect(imported(spark, sf).select("user_id"))


@query("distinct_instruments", sql("SELECT DISTINCT instrument_key, question_id FROM scored", "scored"))
def _(spark, sf):
    return t.scored(spark, sf).select("instrument_key", "question_id").distinct()


def keyed_events(spark, sf, late: bool):
    e = t.table(spark, sf, "events").select("user_id", "event_type", "ts", "value", "event_id")
    return e.filter((F.col("event_id") % 2 == 0) if not late else (F.col("event_id") % 2 == 1))


@query("upsert_latest", sql("SELECT user_id, event_type, max(ts) AS ts, arg_max(value, (ts, event_id % 2, value)) AS value, arg_max(event_id, (ts, event_id % 2, value)) AS event_id FROM events GROUP BY 1, 2"))
def _(spark, sf):
    old = sk.upsert_latest(None, keyed_events(spark, sf, False), ["user_id", "event_type"], "ts")
    return sk.upsert_latest(old, keyed_events(spark, sf, True), ["user_id", "event_type"], "ts")


@query("insert_if_absent", sql("""WITH o AS (SELECT user_id, event_type, arg_min(event_id, (ts, value, event_id)) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2),
   n AS (SELECT user_id, event_type, arg_min(event_id, (ts, value, event_id)) AS event_id FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
   SELECT * FROM o UNION ALL SELECT n.* FROM n ANTI JOIN o ON n.user_id = o.user_id AND n.event_type = o.event_type"""))
def _(spark, sf):
    old = sk.insert_if_absent(None, keyed_events(spark, sf, False), ["user_id", "event_type"], "ts")
    return sk.insert_if_absent(old, keyed_events(spark, sf, True), ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id")


@query("replace_partitions", sql("SELECT cohort_id, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT user_id, cohort_id FROM canon WHERE cohort_id IS NOT NULL AND NOT (cohort_id IN ('NATION_1', 'NATION_2') AND module_id <> 'module_1')) GROUP BY 1", "canon"))
def _(spark, sf):
    """A first import of all cohorts, then a re-import of two of them with other rows."""
    path = shared_dir(spark, "imports")
    df = t.canonical(spark, sf).filter(F.col("cohort_id").isNotNull())
    sk.replace_partitions(df, path, "cohort_id")
    back = spark.read.schema(df.schema).parquet(path)
    again = back.filter(F.col("cohort_id").isin("NATION_1", "NATION_2") & (F.col("module_id") == "module_1"))
    sk.replace_partitions(materialize(again, "again"), path, "cohort_id")  # the rows of the first import, not derived once more
    back = spark.read.schema(df.schema).parquet(path)
    return back.groupBy("cohort_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("delete_user_instrument", sql("SELECT user_id, instrument_key, count(*) AS n FROM scored WHERE NOT (user_id = 'u7' AND instrument_key LIKE 'module1%survey') AND user_id <> 'u10' AND instrument_key <> 'module3_motivation_survey' GROUP BY 1, 2", "scored"))
def _(spark, sf):
    df = t.scored(spark, sf)
    for base in S:
        df = sk.delete_where(df, user="u7", instrument=f"module1_{base}")
    df = sk.delete_where(sk.delete_where(df, user="u10"), instrument="module3_motivation_survey")
    return df.groupBy("user_id", "instrument_key").agg(F.count(F.lit(1)).alias("n"))


@query("delete_users", sql("SELECT instrument_key, count(*) AS n FROM scored WHERE user_id NOT IN (SELECT user_id FROM cohort_map WHERE cohort_id IS NULL) GROUP BY 1", "scored", "cohort_map"))
def _(spark, sf):
    gone = t.cohort_map(spark, sf).filter("cohort_id IS NULL")
    return sk.delete_users(t.scored(spark, sf), gone).groupBy("instrument_key").agg(F.count(F.lit(1)).alias("n"))


@query("delete_cohort_rows", sql("SELECT cohort_id, count(*) AS n, (SELECT count(*) FROM canon WHERE cohort_id = 'NATION_6') AS n_deleted FROM canon WHERE cohort_id IS DISTINCT FROM 'NATION_6' GROUP BY 1", "canon"))
def _(spark, sf):
    rest, deleted = sk.delete_cohort_rows(t.canonical(spark, sf), "NATION_6")
    return rest.groupBy("cohort_id").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(deleted))


@query("rename_cohort", sql(f"""WITH {USERS} SELECT 'ok' AS attempt, true AS renamed, CAST(NULL AS VARCHAR) AS reason, (SELECT count(*) FROM us WHERE cohort_id = 'NATION_3') AS users, CAST(0 AS BIGINT) AS transcripts, (SELECT count(*) FROM us WHERE cohort_id = 'NATION_3') AS now_new
   UNION ALL SELECT 'clash', false, 'target cohort already exists', 0, 0, (SELECT count(*) FROM us WHERE cohort_id = 'NATION_4')""", "cohort_map"))
def _(spark, sf):
    u, tr = users(spark, sf), transcripts(spark, sf)
    reg = u.select("cohort_id").filter("cohort_id IS NOT NULL").distinct()
    out = None
    for label, new in (("ok", "Spring 2026"), ("clash", "NATION_4")):
        r = sk.rename_cohort(u, tr, reg, "NATION_3", new)
        now = r["users"].agg(F.count_if(F.col("cohort_id") == new).alias("now_new"))
        row = r["report"].join(now).select(F.lit(label).alias("attempt"), "renamed", "reason", "users", "transcripts", "now_new")
        out = row if out is None else out.unionByName(row)
    return out


@query("save_and_load_results", sql("SELECT concat('run', CAST(label % 4 AS VARCHAR)) AS run_id, CAST(p AS INT) AS phase, vec_id, label FROM embeddings CROSS JOIN (SELECT unnest([1, 2]) AS p) WHERE p = 1 OR vec_id % 2 = 0"))
def _(spark, sf):
    e = t.table(spark, sf, "embeddings").select("vec_id", "label")
    path = shared_dir(spark, "results")
    run = F.concat(F.lit("run"), (F.col("label") % 4).cast("string"))
    sk.save_results(e, path, run, F.lit(1))
    sk.save_results(e, path, run, F.lit(2))  # another phase of the same runs
    sk.save_results(e.filter("vec_id % 2 = 0"), path, run, F.lit(2))  # that phase saved again
    return sk.load_results(spark, path, "vec_id bigint, label int")


@query("run_registry", sql("SELECT concat('run', CAST(label % 4 AS VARCHAR)) AS run_id, count(DISTINCT vec_id % 3) AS n_phases, CAST(max(vec_id % 3) AS INT) AS last_phase, count(*) AS n_rows FROM embeddings GROUP BY 1"))
def _(spark, sf):
    e = t.table(spark, sf, "embeddings").select("vec_id", "label")
    path = shared_dir(spark, "results")
    sk.save_results(e, path, F.concat(F.lit("run"), (F.col("label") % 4).cast("string")), (F.col("vec_id") % 3).cast("int"))
    return sk.run_registry(sk.load_results(spark, path, "vec_id bigint, label int"))


@query("export_canonical_csv", sql("SELECT instrument_key, count(*) AS n, count(DISTINCT user_id) AS users FROM scored GROUP BY 1", "scored"))
def _(spark, sf):
    path = shared_dir(spark, "export")
    sk.export_canonical_csv(t.canonical(spark, sf), path)
    back = src.read_import_csv(spark, path)
    return back.groupBy("instrument_key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("read_import_csv", sql("SELECT c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey, count(*) AS n, count(*) FILTER (c_custkey % 5 = 0) AS empty_names, count(*) FILTER (c_custkey % 5 <> 0 AND c_custkey % 3 = 0) AS two_lines FROM customer GROUP BY 1, 2"))
def _(spark, sf):
    path = shared_dir(spark, "csv")
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit('\nof "two" lines'))).otherwise(F.col("c_name"))
    c = t.table(spark, sf, "customer").withColumn("c_name", F.when(F.col("c_custkey") % 5 != 0, name))
    c.write.option("header", True).option("escape", '"').csv(path)
    back = src.read_import_csv(spark, path)
    two = F.count_if(F.col("c_name").endswith('\nof "two" lines'))
    return back.groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_name") == "").alias("empty_names"), two.alias("two_lines"))


@query("read_item_bank", """SELECT 'bank' AS instrument_key, concat('B', CAST(item_id AS VARCHAR)) AS question_id, concat('What is "', CAST(item_id AS VARCHAR), '"?') AS question, concat('A) ', left(text, 20), '|', 'B: none') AS options FROM benchmark""")
def _(spark, sf):
    """Item banks as files of one JSON array each, read side by side."""
    path = shared_dir(spark, "bank")
    i = F.col("item_id").cast("string")
    item = F.struct(F.concat(F.lit("B"), i).alias("id"), F.concat(F.lit('What is "'), i, F.lit('"?')).alias("question"), F.array(F.concat(F.lit("A) "), F.substring("text", 1, 20)), F.lit("B: none")).alias("options"))
    banks = t.table(spark, sf, "benchmark").groupBy((F.col("item_id") % 8).alias("part")).agg(F.to_json(F.collect_list(item)).alias("value"))
    banks.write.partitionBy("part").text(path)
    return src.read_item_bank(spark, path, "bank").withColumn("options", F.array_join("options", "|"))


@query("import_summary", sql(f"WITH {IMP} SELECT cohort_id, count(DISTINCT user_id) AS students, count(*) AS rows, count(DISTINCT module_id) AS modules FROM imp GROUP BY 1", "canon"))
def _(spark, sf):
    return rg.import_summary(imported(spark, sf))


@query("list_imports", sql(f"WITH {IMP} SELECT cohort_id, count(DISTINCT user_id) AS students, count(*) AS rows, max(concat('batch', CAST(year(submitted_at) AS VARCHAR))) AS import_batch, max(submitted_at) AS imported_at FROM imp GROUP BY 1", "canon"))
def _(spark, sf):
    df = imported(spark, sf).withColumn("import_batch", F.concat(F.lit("batch"), F.year("submitted_at").cast("string")))
    return rg.list_imports(df.withColumn("imported_at", F.col("submitted_at")))


# -- indices -----------------------------------------------------------------------------------


@query("cpi_quant_ctt", sql("SELECT user_id, round(avg(item_score), 4) AS cpi_quant_ctt, count(*) AS n_items, 'CTT' AS method FROM scored WHERE base = 'content_mcq_assessment' AND item_score IN (0, 1) GROUP BY 1", "scored"))
def _(spark, sf):
    return ix.quant_ctt(t.scored(spark, sf), t.MCQ)


@query("cpi_quant_weighted", sql("SELECT user_id, round(sum(item_score * CASE q WHEN 1 THEN 2.0 WHEN 2 THEN 0.5 ELSE 1.0 END) / sum(CASE q WHEN 1 THEN 2.0 WHEN 2 THEN 0.5 ELSE 1.0 END), 4) AS cpi_quant_ctt, count(*) AS n_items, 'CTT (weighted)' AS method FROM scored WHERE base = 'content_mcq_assessment' AND item_score IN (0, 1) GROUP BY 1", "scored"))
def _(spark, sf):
    return ix.quant_ctt(t.scored(spark, sf), t.MCQ, {"Q1": 2.0, "Q2": 0.5})


def answers(spark, sf):
    """What the indices read of the answers, stored: they are used several times."""
    columns = ["user_id", "module_id", "instrument_key", "question_id", "item_score", "construct", "submitted_at"]
    return materialize(t.canonical(spark, sf).select(*columns), "answers")


def outcome(spark, sf, df=None):
    df = df or answers(spark, sf)
    tests = t.pre_post(df)
    early = F.col("submitted_at") < F.lit("1997-01-01").cast("timestamp_ntz")
    concept = tests.filter(F.col("question_id").isin("Q1", "Q2", "Q3")).withColumn("instrument_key", F.when(early, "pre_concept_inventory").otherwise("post_concept_inventory"))
    scores = sc.assessment_scores(t.by_user(spark, sf, df.unionByName(tests).unionByName(concept), 3), S)
    return ix.outcome_index(scores, t.MCQ, [("g_knowledge", t.PRE, t.POST), ("g_concept", "pre_concept", "post_concept")])


OUTCOME = """mc AS (SELECT user_id, avg(p) / 100 AS cpi_mcq, count(*) AS n_modules_mcq FROM (SELECT user_id, instrument_key, round(sum(item_score) / count(*) * 100, 4) AS p FROM canon
     WHERE base = 'content_mcq_assessment' AND item_score IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
   pp AS (SELECT user_id, round(sum(item_score) FILTER (submitted_at < TIMESTAMP '1998-07-01') / count(*) FILTER (submitted_at < TIMESTAMP '1998-07-01') * 100, 4) AS k0,
       round(sum(item_score) FILTER (submitted_at >= TIMESTAMP '1998-07-01') / count(*) FILTER (submitted_at >= TIMESTAMP '1998-07-01') * 100, 4) AS k1,
       round(sum(item_score) FILTER (q <= 3 AND submitted_at < TIMESTAMP '1997-01-01') / nullif(count(*) FILTER (q <= 3 AND submitted_at < TIMESTAMP '1997-01-01'), 0) * 100, 4) AS c0,
       round(sum(item_score) FILTER (q <= 3 AND submitted_at >= TIMESTAMP '1997-01-01') / nullif(count(*) FILTER (q <= 3 AND submitted_at >= TIMESTAMP '1997-01-01'), 0) * 100, 4) AS c1
     FROM canon WHERE base = 'content_mcq_assessment' AND item_score IS NOT NULL GROUP BY 1),
   gn AS (SELECT user_id, CASE WHEN k0 < 100 THEN greatest(-1, least(1, (k1 - k0) / (100 - k0))) END AS gk, CASE WHEN c0 < 100 THEN greatest(-1, least(1, (c1 - c0) / (100 - c0))) END AS gc FROM pp),
   gn2 AS (SELECT gn.user_id, CASE WHEN k1 IS NOT NULL THEN gk END AS gk, CASE WHEN c1 IS NOT NULL THEN gc END AS gc FROM gn JOIN pp USING (user_id)),
   oi AS (SELECT mc.user_id, cpi_mcq, gk, gc, (cpi_mcq + coalesce(gk, 0) + coalesce(gc, 0)) / (1 + CASE WHEN gk IS NULL THEN 0 ELSE 1 END + CASE WHEN gc IS NULL THEN 0 ELSE 1 END) AS cpi_outcome, n_modules_mcq FROM mc JOIN gn2 USING (user_id))"""


@query("cpi_outcome", sql(f"WITH {OUTCOME} SELECT user_id, round(CAST(cpi_mcq AS DECIMAL(18,10)), 4)::DOUBLE AS cpi_mcq, round(CAST(gk AS DECIMAL(18,10)), 4)::DOUBLE AS g_knowledge, round(CAST(gc AS DECIMAL(18,10)), 4)::DOUBLE AS g_concept, round(CAST(cpi_outcome AS DECIMAL(18,10)), 4)::DOUBLE AS cpi_outcome, n_modules_mcq FROM oi", "canon"))
def _(spark, sf):
    return outcome(spark, sf)


FLIPPED = ["external_regulation", "amotivation"]
PROCESS = f"""{MEANS}, pr0 AS (SELECT user_id, (avg(mean_score) FILTER (instrument_key LIKE '%engagement%') - 1) / 3 AS e,
   avg(((CASE WHEN construct IN ('external_regulation', 'amotivation') THEN 5 - mean_score ELSE mean_score END) - 1) / 3) FILTER (instrument_key LIKE '%motivation%') AS m FROM means GROUP BY 1),
   pr AS (SELECT user_id, e, m, CASE WHEN e IS NULL THEN m WHEN m IS NULL THEN e ELSE (e + m) / 2 END AS p FROM pr0)"""


def process(spark, sf, df=None):
    scores = means(spark, sf) if df is None else sc.construct_means(t.by_user(spark, sf, df), S)
    return ix.process_index(scores, "engagement", "motivation", FLIPPED)


@query("cpi_process", sql(f"WITH {PROCESS} SELECT user_id, round(CAST(e AS DECIMAL(18,10)), 4)::DOUBLE AS engagement_mean, round(CAST(m AS DECIMAL(18,10)), 4)::DOUBLE AS motivation_mean, round(CAST(p AS DECIMAL(18,10)), 4)::DOUBLE AS cpi_process FROM pr", "canon"))
def _(spark, sf):
    return process(spark, sf)


def evidence(spark, sf):
    """Events as evidence rows: type is the construct, props.k the count, value its valence split."""
    k = F.get_json_object("props", "$.k").cast("bigint") % 8
    e = t.table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("participant_id"), F.col("event_type").alias("construct_name"),
        F.when(F.col("event_type").isin("click", "view"), "attention").otherwise("action").alias("construct_group"),
        k.alias("evidence_count"), (k % 3).alias("valence_positive"), (k % 2).alias("valence_negative"),
        F.when(k > 4, 2).otherwise(0).cast("bigint").alias("valence_neutral"), "event_id", F.when(F.col("value") < 1, "parse").alias("error"),
    )
    return e


EVID = """ev AS (SELECT concat('u', CAST(user_id AS VARCHAR)) AS participant_id, event_type AS construct_name, CASE WHEN event_type IN ('click', 'view') THEN 'attention' ELSE 'action' END AS construct_group,
   k AS evidence_count, k % 3 AS vp, k % 2 AS vn, CASE WHEN k > 4 THEN 2 ELSE 0 END AS vu, event_id, value FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) % 8 AS k FROM events))"""


def qual(spark, sf):
    return ix.qual_density(evidence(spark, sf))


QUAL = f"""{EVID}, ql AS (SELECT participant_id AS user_id, sum(evidence_count)::BIGINT AS evidence_total, count(*) FILTER (evidence_count > 0) AS constructs_found,
   round(coalesce(count(*) FILTER (evidence_count > 0) / (SELECT count(DISTINCT construct_name) FROM ev)::DOUBLE * least(avg(evidence_count) FILTER (evidence_count > 0) / 5, 1), 0), 4) AS cpi_qual FROM ev GROUP BY 1)"""


@query("cpi_qual_density", sql(f"WITH {QUAL} SELECT * FROM ql"))
def _(spark, sf):
    return qual(spark, sf)


@query("cpi_combined", sql(f"WITH {QUAL}, q AS (SELECT user_id, round(avg(item_score), 4) AS cpi_quant FROM scored WHERE base = 'content_mcq_assessment' AND item_score IN (0, 1) GROUP BY 1) SELECT coalesce(q.user_id, ql.user_id) AS user_id, cpi_quant, cpi_qual, round(0.6 * cpi_quant + 0.4 * cpi_qual, 4) AS cpi_plus, 0.6::DOUBLE AS w1, 0.4::DOUBLE AS w2 FROM q FULL JOIN ql ON q.user_id = ql.user_id", "scored"))
def _(spark, sf):
    return ix.combined_index(ix.quant_ctt(t.scored(spark, sf), t.MCQ), qual(spark, sf), w1=0.6, w2=0.4)


PLUS = f"""{OUTCOME}, {PROCESS}, {QUAL}, oi2 AS (SELECT user_id, round(CAST(cpi_outcome AS DECIMAL(18,10)), 4)::DOUBLE AS o FROM oi), pr2 AS (SELECT user_id, round(CAST(p AS DECIMAL(18,10)), 4)::DOUBLE AS p FROM pr),
   al AS (SELECT coalesce(oi2.user_id, pr2.user_id, ql.user_id) AS user_id, o, p, cpi_qual AS c FROM oi2 FULL JOIN pr2 ON oi2.user_id = pr2.user_id FULL JOIN ql ON ql.user_id = coalesce(oi2.user_id, pr2.user_id)),
   pl AS (SELECT *, round(CAST((coalesce(o, 0) + coalesce(p, 0) + coalesce(c, 0)) / ((o IS NOT NULL)::INT + (p IS NOT NULL)::INT + (c IS NOT NULL)::INT) AS DECIMAL(18,10)), 4)::DOUBLE AS cpi_plus FROM al)"""


@query("cpi_plus", sql(f"WITH {PLUS} SELECT user_id, o AS cpi_outcome, p AS cpi_process, c AS cpi_qual, cpi_plus, CASE WHEN cpi_plus >= 0.75 THEN '🟢 High (≥0.75)' WHEN cpi_plus >= 0.5 THEN '🟡 Moderate (0.50–0.74)' WHEN cpi_plus >= 0.25 THEN '🟠 Developing (0.25–0.49)' ELSE '🔴 Emerging (<0.25)' END AS band FROM pl", "canon"))
def _(spark, sf):
    stored = answers(spark, sf)
    df = ix.plus_index(outcome(spark, sf, stored), process(spark, sf, stored), qual(spark, sf))
    return df.select("user_id", "cpi_outcome", "cpi_process", "cpi_qual", "cpi_plus", "band")


@query("cpi_summary", sql("WITH q AS (SELECT user_id, round(avg(item_score), 4) AS v FROM scored WHERE base = 'content_mcq_assessment' AND item_score IN (0, 1) GROUP BY 1) SELECT 'cpi_quant' AS index_name, round(avg(v), 3) AS mean, round(median(v), 3) AS median, round(stddev_samp(v), 3) AS sd, round(min(v), 3) AS min, round(max(v), 3) AS max, count(*) AS n FROM q", "scored"))
def _(spark, sf):
    return ix.index_summary(ix.quant_ctt(t.scored(spark, sf), t.MCQ).withColumnRenamed("cpi_quant_ctt", "cpi_quant"), ["cpi_quant"])


@query("cpi_qual_rubric", sql("""WITH r AS (SELECT user_id, module_num, q, 1 + ascii(substr(response_value, 1, 1)) % 4 AS s, item_score FROM scored WHERE base = 'content_mcq_assessment'),
   q AS (SELECT user_id, module_num, sum(s) AS s FROM r WHERE item_score IS NOT NULL GROUP BY 1, 2) SELECT user_id, round(sum(s) / (count(*) * 12.0), 4) AS cpi_qual, count(*) AS n_questions_scored FROM q GROUP BY 1""", "scored"))
def _(spark, sf):
    df = t.scored(spark, sf).filter(F.col("instrument_key").endswith(t.MCQ))
    rubric = df.select(F.col("user_id").alias("participant_id"), F.col("module_id").alias("question_id"), F.col("question_id").alias("dimension"),
                       (1 + F.ascii("response_value") % 4).alias("score"), F.when(F.col("item_score").isNull(), "unscored").alias("error"))
    return ix.qual_rubric(rubric, 12.0)


# -- evidence ----------------------------------------------------------------------------------

TYPES = ["click", "error", "purchase", "signup", "view"]


@query("evidence_matrix", sql(f"WITH {EVID} SELECT participant_id, " + ", ".join(f"coalesce(sum(evidence_count) FILTER (construct_name = '{c}'), 0)::BIGINT AS {c}" for c in TYPES) + " FROM ev GROUP BY 1"))
def _(spark, sf):
    return ev.evidence_matrix(evidence(spark, sf), TYPES)


@query("valence_matrix", sql(f"""WITH {EVID}, v AS (SELECT participant_id, construct_name, arg_min(CASE WHEN vp = 0 AND vn = 0 AND vu = 0 THEN 'absent' WHEN vp >= vn AND vp >= vu THEN 'positive' WHEN vn >= vp AND vn >= vu THEN 'negative' ELSE 'neutral' END, event_id) AS v FROM ev GROUP BY 1, 2)
   SELECT participant_id, """ + ", ".join(f"max(v) FILTER (construct_name = '{c}') AS {c}" for c in TYPES) + " FROM v GROUP BY 1"))
def _(spark, sf):
    return ev.valence_matrix(evidence(spark, sf), TYPES, "event_id")


@query("evidence_by_construct", sql(f"WITH {EVID} SELECT construct_name, construct_group, sum(evidence_count)::BIGINT AS total_evidence, count(*) FILTER (evidence_count > 0) AS n_participants_with_evidence, sum(vp)::BIGINT AS total_positive, sum(vn)::BIGINT AS total_negative, sum(vu)::BIGINT AS total_neutral FROM ev GROUP BY 1, 2"))
def _(spark, sf):
    return ev.summary_by_construct(evidence(spark, sf))


@query("evidence_by_participant", sql(f"WITH {EVID} SELECT participant_id, sum(evidence_count)::BIGINT AS total_evidence, count(*) FILTER (evidence_count > 0) AS constructs_with_evidence, sum(vp)::BIGINT AS total_positive, sum(vn)::BIGINT AS total_negative FROM ev GROUP BY 1"))
def _(spark, sf):
    return ev.summary_by_participant(evidence(spark, sf))


@query("participant_profiles", sql(f"""WITH {EVID}, l AS (SELECT participant_id, construct_name, arg_max(evidence_count, event_id) AS e, arg_max(vp, event_id) AS p FROM ev GROUP BY 1, 2)
   SELECT participant_id, construct_name, e AS evidence_count, p AS valence_positive, total_evidence FROM l JOIN (SELECT participant_id, sum(evidence_count)::BIGINT AS total_evidence FROM ev GROUP BY 1) USING (participant_id)"""))
def _(spark, sf):
    df = ev.participant_profiles(evidence(spark, sf), "event_id")
    flat = df.select("participant_id", "total_evidence", F.explode("constructs").alias("construct_name", "v"))
    return flat.select("participant_id", "construct_name", "v.evidence_count", "v.valence_positive", "total_evidence")


@query("low_evidence_flag", sql(f"WITH {EVID} SELECT construct_name, evidence_count <= 1 AND value >= 1 AS phase4_reviewed, count(*) AS n FROM ev GROUP BY 1, 2"))
def _(spark, sf):
    return ev.low_evidence_flag(evidence(spark, sf), 1).groupBy("construct_name", "phase4_reviewed").agg(F.count(F.lit(1)).alias("n"))


# -- ratings -----------------------------------------------------------------------------------


def results(spark, sf):
    li, p = t.table(spark, sf, "lineitem"), t.table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    j = li.join(p, li.l_partkey == p.p_partkey)
    level = 1 + F.col("l_quantity").cast("int") % 6
    return j.select(
        F.lit("bank").alias("instrument_key"), F.col("p_partkey").cast("string").alias("question_id"), F.substring(F.sha2("p_name", 256), 1, 16).alias("item_hash"),
        F.concat(F.lit("r"), (F.col("l_suppkey") % 3).cast("string")).alias("run_id"), F.col("l_returnflag").alias("model"),
        F.when(F.col("l_linestatus") == "O", "blind").otherwise("key").alias("step"), (F.col("l_discount") < 0.08).alias("ok"), level.alias("bloom_level"),
        F.col("l_shipdate").alias("created_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_tax") > 0.06).alias("needs_figure"),
        (F.col("l_quantity").cast("int") % 4 == F.col("p_size") % 4).alias("blind_matches_key"),
        F.when(F.col("l_tax") > 0.02, "yes").otherwise("no").alias("key_defensible"), F.col("l_quantity").cast("bigint").alias("tokens_in"), F.col("l_linenumber").cast("bigint").alias("tokens_out"),
        F.when(F.col("l_returnflag") == "A", "priced").otherwise("free").alias("provider"),
    )


RES = """rs AS (SELECT CAST(p_partkey AS VARCHAR) AS question_id, substr(sha256(p_name), 1, 16) AS item_hash, concat('r', CAST(l_suppkey % 3 AS VARCHAR)) AS run_id, l_returnflag AS model,
   CASE WHEN l_linestatus = 'O' THEN 'blind' ELSE 'key' END AS step, l_discount < 0.08 AS ok, 1 + CAST(l_quantity AS INT) % 6 AS lv, l_shipdate AS created_at, l_orderkey * 10 + l_linenumber AS id,
   l_tax > 0.06 AS fig, CAST(l_quantity AS INT) % 4 = p_size % 4 AS mk, CASE WHEN l_tax > 0.02 THEN 'yes' ELSE 'no' END AS kd, CAST(l_quantity AS BIGINT) AS ti, l_linenumber AS tout, p_partkey, p_size FROM lineitem JOIN part ON l_partkey = p_partkey),
 sg AS (SELECT question_id, item_hash, model, run_id, count(*) AS n_runs, list_sort(list(lv)) AS levels, median(lv)::DOUBLE AS level_median, min(lv) AS level_min, max(lv) AS level_max, bool_or(fig) AS fig, bool_and(mk) AS mk
   FROM (SELECT *, first_value(run_id) OVER (PARTITION BY question_id, model ORDER BY created_at DESC, id DESC, run_id DESC) AS last_run FROM rs WHERE ok AND step = 'blind') WHERE run_id = last_run GROUP BY 1, 2, 3, 4)"""


@query("latest_suggestion", sql(f"WITH {RES} SELECT 'bank' AS instrument_key, question_id, item_hash, model, run_id, n_runs, array_to_string(levels, ',') AS levels, level_median, level_min, level_max, fig AS needs_figure, mk AS blind_matches_key FROM sg"))
def _(spark, sf):
    df = ra.latest_suggestion(results(spark, sf))
    return df.withColumn("levels", F.array_join(F.col("levels").cast("array<string>"), ","))


@query("consensus_level", sql(f"WITH {RES} SELECT 'bank' AS instrument_key, question_id, item_hash, median(level_median) AS median, min(level_median) AS min, max(level_median) AS max, count(*) AS n_models FROM sg GROUP BY 2, 3"))
def _(spark, sf):
    return ra.consensus_level(ra.latest_suggestion(results(spark, sf)))


@query("latest_run_rows", sql(f"WITH {RES} SELECT question_id, run_id, count(*) AS n FROM (SELECT *, first_value(run_id) OVER (PARTITION BY question_id ORDER BY created_at DESC, id DESC, run_id DESC) AS last_run FROM rs) WHERE run_id = last_run GROUP BY 1, 2"))
def _(spark, sf):
    return rg.latest_rows(results(spark, sf), ["question_id"], "run_id", ["created_at", "id"]).groupBy("question_id", "run_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "review_table",
    sql(f"""WITH {RES}, it AS (SELECT CAST(p_partkey AS VARCHAR) AS question_id, substr(sha256(p_name), 1, 16) AS item_hash, p_size > 25 AS fig, CASE WHEN p_partkey % 3 <> 0 THEN 1 + p_size % 6 END AS bl,
          CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 4 <> 0 THEN 1 + (p_size + p_partkey % 2) % 6 END AS fl, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE 'because' END AS why FROM part),
        co AS (SELECT question_id, median(level_median) AS med, min(level_median) AS lo, max(level_median) AS hi, count(*) AS nm, list(CAST(round_even(level_median, 0) AS INT)) AS lvs, bool_and(mk) AS mk,
          max(level_median) FILTER (model = 'A') AS ma, max(level_median) FILTER (model = 'N') AS mn FROM sg GROUP BY 1),
        kr AS (SELECT question_id, arg_max(kd, (created_at, id, kd)) AS kd FROM rs WHERE ok AND step = 'key' GROUP BY 1)
        SELECT 'bank' AS instrument_key, question_id, item_hash, fig AS depends_on_figure, bl AS my_first_rating, fl AS my_final_rating,
          CASE WHEN fl IS NULL THEN NULL WHEN fl = bl THEN 'kept' WHEN trim(why) = '' THEN NULL WHEN list_contains(lvs, fl) THEN 'adopted_llm' ELSE 'changed' END AS decision,
          CASE WHEN bl IS NOT NULL THEN med END AS llm_level_median, CASE WHEN bl IS NOT NULL THEN coalesce(nm, 0) ELSE 0 END AS llm_models,
          CASE WHEN bl IS NOT NULL THEN regexp_replace(CAST(lo AS VARCHAR), '\\.0$', '') || '–' || regexp_replace(CAST(hi AS VARCHAR), '\\.0$', '') END AS llm_level_spread,
          CASE WHEN bl IS NOT NULL THEN mk END AS llm_blind_matches_key, CASE WHEN bl IS NOT NULL THEN kd END AS llm_key_defensible,
          CASE WHEN bl IS NOT NULL THEN ma END AS "llm[A]", CASE WHEN bl IS NOT NULL THEN mn END AS "llm[N]" FROM it LEFT JOIN co USING (question_id) LEFT JOIN kr USING (question_id)"""),
)
def _(spark, sf):
    p = t.table(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    items = p.select(F.lit("bank").alias("instrument_key"), k.cast("string").alias("question_id"), F.substring(F.sha2("p_name", 256), 1, 16).alias("item_hash"), (size > 25).alias("depends_on_figure"))
    final = F.when(k % 4 != 0, 1 + (size + k % 2) % 6).cast("int")
    human = p.filter(k % 3 != 0).select(
        F.lit("bank").alias("instrument_key"), k.cast("string").alias("question_id"), F.substring(F.sha2("p_name", 256), 1, 16).alias("item_hash"),
        (1 + size % 6).alias("blind_level"), final.alias("final_level"), F.when(k % 5 == 0, " ").otherwise("because").alias("final_rationale"))
    return ra.review_table(items, human, results(spark, sf), ["A", "N"])


@query("rating_run_rollup", sql(f"WITH {RES} SELECT run_id, CASE WHEN model = 'A' THEN 'priced' ELSE 'free' END AS provider, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_err, sum(ti)::BIGINT AS tokens_in, sum(tout)::BIGINT AS tokens_out, CASE WHEN model = 'A' THEN (sum(ti) * 2.0 + sum(tout) * 10.0) / 1e6 ELSE 0.0 END::DOUBLE AS cost_usd, CASE WHEN count(*) FILTER (NOT ok) = 0 THEN 'done' ELSE 'done_with_errors' END AS status FROM (SELECT *, model AS m2 FROM rs) GROUP BY run_id, CASE WHEN model = 'A' THEN 'priced' ELSE 'free' END, CASE WHEN model = 'A' THEN 1 ELSE 0 END".replace("CASE WHEN model = 'A' THEN (sum(ti)", "CASE WHEN min(model) = 'A' THEN (sum(ti)")))
def _(spark, sf):
    return ra.rating_run_rollup(results(spark, sf), 2.0, 10.0, "priced")


@query("corpus_cost_estimate", sql("SELECT source, lang, count(*) AS n_texts, count(*) * 412 AS total_input, count(*) * 500 AS total_output, round(count(*) * 412 / 1000.0 * 0.003 + count(*) * 500 / 1000.0 * 0.015, 5) AS est_cost_usd FROM documents GROUP BY 1, 2"))
def _(spark, sf):
    return ra.corpus_cost_estimate(t.table(spark, sf, "documents"), ["source", "lang"], 412, 500, 0.003, 0.015)


LANES = ", ".join(f"sum(CAST(concat('0x', substr(sha256(text), {1 + 12 * i}, 12)) AS BIGINT)::HUGEINT) AS s{i}" for i in range(5))


@query("content_hash", sql(f"SELECT source, n_texts, sha256(concat_ws('|', CAST(n_texts AS VARCHAR), " + ", ".join(f"CAST(s{i} AS VARCHAR)" for i in range(5)) + f")) AS content_hash FROM (SELECT source, count(text) AS n_texts, {LANES} FROM documents GROUP BY 1)"))
def _(spark, sf):
    return ra.content_hash(t.table(spark, sf, "documents"), "text", ["source"])


# -- validation --------------------------------------------------------------------------------


IMPORT_FAULTS = f"""{IMP}, nb AS (SELECT *, CAST(regexp_extract(user_id, '(\\d+)\\D*$', 1) AS INT) % 100 AS nn FROM imp),
   br AS (SELECT CASE WHEN nn = 13 THEN concat(user_id, ' !') ELSE user_id END AS user_id, instrument_key, question_id, response_value, construct, cohort_id, CASE WHEN nn <> 17 THEN item_score END AS score FROM nb
     UNION ALL SELECT user_id, instrument_key, question_id, response_value, construct, cohort_id, 9.0 FROM nb WHERE nn = 11),
   us AS (SELECT user_id, count(DISTINCT cohort_id) AS k FROM br GROUP BY 1),
   gp AS (SELECT (g.grade IS NULL)::INT + (g.gender IS NULL)::INT + (g.first_language_english IS NULL)::INT AS gaps FROM us LEFT JOIN demographics g ON g.user_id = us.user_id),
   fd AS (SELECT 'bad_user_id' AS "check", 1 AS w, user_id AS v FROM us WHERE NOT regexp_matches(user_id, '^[A-Za-z0-9][A-Za-z0-9_-]{{1,39}}$')
     UNION ALL SELECT 'id_of_platform_user', 1, user_id FROM us WHERE user_id IN (SELECT user_id FROM canon WHERE module_id <> 'module_2')
     UNION ALL SELECT 'user_in_several_cohorts', 1, user_id FROM us WHERE k > 1
     UNION ALL SELECT 'cohort_already_registered', 1, cohort_id FROM (SELECT DISTINCT cohort_id FROM br) WHERE cohort_id IN ('C3', 'Z')
     UNION ALL SELECT 'unknown_instrument', 1, instrument_key FROM (SELECT DISTINCT instrument_key FROM br) WHERE instrument_key NOT IN ('module2_engagement_survey', 'module2_motivation_survey')
     UNION ALL SELECT 'duplicate_rows', n - 1, NULL FROM (SELECT count(*) AS n FROM br GROUP BY user_id, instrument_key, question_id) WHERE n > 1
     UNION ALL SELECT 'several_scores_for_one_answer', 1, NULL FROM (SELECT count(DISTINCT score) AS k FROM br GROUP BY instrument_key, question_id, response_value) WHERE k > 1),
   sm AS (SELECT "check", string_agg(v, ',' ORDER BY v) AS sample FROM (SELECT "check", v, row_number() OVER (PARTITION BY "check" ORDER BY v) AS p FROM fd WHERE v IS NOT NULL) WHERE p <= 8 GROUP BY 1),
   fi AS (SELECT fd."check", 'error' AS severity, sum(w)::BIGINT AS n, any_value(sm.sample) AS sample FROM fd LEFT JOIN sm ON sm."check" = fd."check" GROUP BY 1
     UNION ALL SELECT 'empty_construct', 'error', count(*) FILTER (coalesce(trim(construct), '') = ''), NULL FROM br
     UNION ALL SELECT 'score_not_numeric', 'warning', count(*) FILTER (score IS NULL), NULL FROM br
     UNION ALL SELECT 'no_demographics', 'warning', count(*) FILTER (gaps = 3), NULL FROM gp
     UNION ALL SELECT 'partial_demographics', 'warning', count(*) FILTER (gaps IN (1, 2)), NULL FROM gp)"""


@query("validate_import", sql(f"WITH {IMPORT_FAULTS} SELECT * FROM fi WHERE n > 0", "canon", "demographics"))
def _(spark, sf):
    """An import with planted faults: blanks, bad ids, clashes, repeats and unknown instruments."""
    canon = materialize(t.canonical(spark, sf).select(*va.REQUIRED_IMPORT), "answers")
    df = imported(spark, sf, canon).select(*va.REQUIRED_IMPORT)
    n = F.regexp_extract("user_id", r"(\d+)\D*$", 1).cast("int") % 100
    broken = df.withColumn("user_id", F.when(n == 13, F.concat("user_id", F.lit(" !"))).otherwise(F.col("user_id"))).withColumn(
        "item_score", F.when(n == 17, "high").otherwise(F.col("item_score").cast("string")))
    broken = broken.unionByName(df.filter(n == 11).withColumn("item_score", F.lit("9")))
    return va.validate_import(broken, t.demographics(spark, sf), platform(spark, sf, canon), ["C3", "Z"], [f"module2_{b}" for b in S]).withColumn("sample", F.array_join("sample", ","))


@query("validate_import_duplicates", sql(f"""WITH {IMP}, c AS (SELECT * FROM imp UNION ALL SELECT * FROM imp WHERE user_id LIKE '%11')
   SELECT 'duplicate_rows' AS "check", 'error' AS severity, (SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM c GROUP BY user_id, instrument_key, question_id)) AS n
   UNION ALL SELECT 'cohort_already_registered', 'error', 1
   UNION ALL SELECT 'id_of_platform_user', 'error', (SELECT count(DISTINCT user_id) FROM c WHERE user_id IN (SELECT user_id FROM responses WHERE instrument_name LIKE 'module3%'))
   UNION ALL SELECT 'score_not_numeric', 'warning', (SELECT count(*) FROM c WHERE item_score IS NULL)""", "canon", "responses"))
def _(spark, sf):
    canon = materialize(t.canonical(spark, sf).select(*va.REQUIRED_IMPORT), "answers")
    df = imported(spark, sf, canon).select(*va.REQUIRED_IMPORT)
    doubled = df.unionByName(df.filter(F.col("user_id").endswith("11")))
    known = canon.filter(F.col("instrument_key").startswith("module3"))
    found = va.validate_import(doubled, t.demographics(spark, sf), known, ["C3", "Z"])
    return found.filter(F.col("check").isin("duplicate_rows", "cohort_already_registered", "id_of_platform_user", "score_not_numeric")).drop("sample")


@query("validate_ground_truth", sql("SELECT count(*) FILTER (trim(source) <> '' OR trim(lang) <> '') AS n_rows, count(*) FILTER (doc_id % 9 = 0) AS n_empty_quotes, true AS has_participants, true AS valid FROM documents"))
def _(spark, sf):
    d = t.table(spark, sf, "documents")
    gt = d.select(F.concat(F.lit(" "), F.col("source")).alias(" Category"), F.col("lang").alias("CODE_NAME"),
                  F.when(F.col("doc_id") % 9 != 0, F.col("text")).otherwise(F.lit("  ")).alias("Quote "), F.col("doc_id").cast("string").alias("participant_id"))
    return va.validate_ground_truth(gt)


@query("missing_fields", sql("SELECT 'cohort_id' AS field, count(*) FILTER (cohort_id IS NULL) AS n FROM canon UNION ALL SELECT 'grade', count(*) FILTER (grade IS NULL) FROM canon UNION ALL SELECT 'item_score', count(*) FILTER (item_score IS NULL) FROM canon UNION ALL SELECT 'user_id', 0 FROM canon GROUP BY 1", "canon"))
def _(spark, sf):
    return va.missing_fields(t.canonical(spark, sf), ["user_id", "item_score", "grade", "cohort_id"])

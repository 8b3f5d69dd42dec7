"""Reliability, item analysis, correlations, agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import config_frame
from ..operators import agreement as ag
from ..operators import ordered as od
from ..operators import psychometrics as ps
from ..operators import scores as sc
from . import tables as t
from .queries_scores import BINARY, COMPOSITES, MEANS, PERSON_MODULE, person_module
from .queries_tests import rounded
from .registry import query
from .sqltext import sql, t_two_sided

S = t.SURVEYS


def _reliability_sql(label: str, source: str, extra: str = "") -> str:
    """Statistics of scales in ``source(label, construct, user_id, question_id, item_score)``."""
    return f"""c AS (SELECT {label}, user_id, question_id, avg(item_score) AS x FROM {source} GROUP BY 1, 2, 3),
      sz AS (SELECT {label}, count(DISTINCT question_id) AS k, count(DISTINCT user_id) AS ns FROM c GROUP BY 1),
      us AS (SELECT {label}, user_id, count(*) AS m, sum(x) AS tot FROM c GROUP BY 1, 2),
      cc AS (SELECT us.* FROM us JOIN sz USING ({label}) WHERE m = k),
      iv AS (SELECT {label}, sum(v) AS sv, product(v) AS pv FROM (SELECT c.{label}, c.question_id, var_samp(x) AS v FROM c JOIN cc ON c.{label} = cc.{label} AND c.user_id = cc.user_id GROUP BY 1, 2) GROUP BY 1),
      tv AS (SELECT {label}, count(*) AS nc, var_samp(tot) AS vt FROM cc GROUP BY 1),
      rel AS (SELECT sz.{label}, k, ns, coalesce(nc, 0) AS nc, sv, vt, (vt - sv) / 2 / sqrt(pv) AS r, CASE WHEN k = 1 THEN 'single_item_no_reliability' WHEN coalesce(nc, 0) < 3 THEN 'not_tested'
        WHEN k = 2 THEN 'spearman_brown' ELSE 'cronbach_alpha' END AS method FROM sz LEFT JOIN iv USING ({label}) LEFT JOIN tv USING ({label}))
      SELECT {label}, k AS n_items, ns AS n_subjects, nc AS n_complete, method,
        round(CASE method WHEN 'spearman_brown' THEN 2 * r / (1 + r) WHEN 'cronbach_alpha' THEN k / (k - 1) * (1 - sv / vt) END, 6) AS value{extra} FROM rel"""


REL_COLS = ["n_items", "n_subjects", "n_complete", "method", "value"]


@query("construct_reliability", sql("WITH src AS (SELECT * FROM scored WHERE base = 'engagement_survey'), " + _reliability_sql("construct", "src"), "scored"))
def _(spark, sf):
    return rounded(ps.construct_reliability(t.scored(spark, sf), "engagement_survey").select("construct", *REL_COLS))


MAP_SQL = "map AS (SELECT * FROM (VALUES ('task','engaged'),('effort','engaged'),('attention','focus'),('task','all_in'),('effort','all_in'),('attention','all_in')) v(construct, composite))"


@query(
    "composite_reliability",
    sql(
        f"WITH {MAP_SQL}, src AS (SELECT s.*, composite FROM scored s JOIN map ON s.construct = map.construct WHERE base = 'engagement_survey'), "
        + _reliability_sql("composite", "src", ", (SELECT count(*) FROM map WHERE map.composite = rel.composite) AS n_subconstructs"),
        "scored",
    ),
)
def _(spark, sf):
    df = ps.composite_reliability(t.scored(spark, sf), "engagement_survey", COMPOSITES)
    return rounded(df.select("composite", *REL_COLS, "n_subconstructs"))


@query("composite_reliability_interval")
def _(spark, sf):
    return rounded(ps.composite_reliability(t.scored(spark, sf), "engagement_survey", COMPOSITES))


COMPLETE = f"""{BINARY}, kk AS (SELECT count(DISTINCT question_id) AS k FROM bin), us AS (SELECT user_id, count(*) AS m, sum(item_score) AS tot FROM bin GROUP BY 1),
   cc AS (SELECT user_id, tot FROM us, kk WHERE m = k), cell AS (SELECT b.*, tot, tot - item_score AS rest FROM bin b JOIN cc USING (user_id))"""


@query(
    "cronbach_alpha",
    sql(f"""WITH {COMPLETE} SELECT k AS n_items, (SELECT count(*) FROM cc) AS n_complete, round(greatest(-1, least(1, k / (k - 1) * (1 - (SELECT sum(v) FROM (SELECT var_samp(item_score) AS v FROM cell GROUP BY question_id))
        / (SELECT var_samp(tot) FROM cc)))), 6) AS alpha FROM kk""", "scored"),
)
def _(spark, sf):
    return rounded(ps.cronbach_alpha(sc.binary_matrix(t.scored(spark, sf), t.MCQ)))


@query(
    "kr20",
    sql(f"""WITH {COMPLETE} SELECT k AS n_items, (SELECT count(*) FROM cc) AS n_complete, round(k / (k - 1) * (1 - (SELECT sum(p * (1 - p)) FROM (SELECT avg(item_score) AS p FROM cell GROUP BY question_id))
        / (SELECT var_pop(tot) FROM cc)), 6) AS kr20 FROM kk""", "scored"),
)
def _(spark, sf):
    return rounded(ps.kr20(sc.binary_matrix(t.scored(spark, sf), t.MCQ)))


@query(
    "loading_report",
    sql(
        f"""WITH {BINARY}, a AS (SELECT question_id, 0.5 + 2 * avg(item_score) AS a FROM bin GROUP BY 1), l AS (SELECT a / sqrt(1 + a * a) AS l FROM a),
          s AS (SELECT count(*) AS n, sum(l) AS sl, sum(1 - l * l) AS e, avg(l * l) AS ave FROM l)
        SELECT n AS n_items, round(sl * sl / (sl * sl + e), 6) AS cr, round(sl * sl / (sl * sl + e), 6) AS omega, round(ave, 6) AS ave,
          CASE WHEN sl * sl / (sl * sl + e) >= 0.8 THEN '🟢 Good (≥0.8)' WHEN sl * sl / (sl * sl + e) >= 0.7 THEN '🟡 Acceptable (≥0.7)' ELSE '🔴 Poor (<0.7)' END AS cr_badge,
          CASE WHEN ave >= 0.5 THEN '🟢 Adequate (≥0.5)' ELSE '🔴 Inadequate (<0.5)' END AS ave_badge FROM s""",
        "scored",
    ),
)
def _(spark, sf):
    slopes = sc.binary_matrix(t.scored(spark, sf), t.MCQ).groupBy("question_id").agg((0.5 + 2 * F.avg("item_score")).alias("a"))
    return rounded(ps.loading_report(slopes))


@query("reliability_report")
def _(spark, sf):
    matrix = sc.binary_matrix(t.scored(spark, sf), t.MCQ)
    slopes = matrix.groupBy("question_id").agg((0.5 + 2 * F.avg("item_score")).alias("a"))
    return rounded(ps.reliability_report(slopes, matrix, "a", "knowledge"))


@query(
    "item_analysis",
    sql(
        f"""WITH {COMPLETE}, i AS (SELECT question_id, count(*)::DOUBLE AS n, avg(item_score) AS p FROM bin GROUP BY 1),
          s AS (SELECT question_id, count(*)::DOUBLE AS nc, corr(item_score, rest) AS r, var_pop(item_score) AS v, var_pop(rest) AS vr FROM cell GROUP BY 1), pq AS (SELECT sum(v) AS pq FROM s),
          z AS (SELECT 1.959963984540054 AS z)
        SELECT question_id AS item, n::BIGINT AS n, round(p, 6) AS p, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS p_ci_low,
          round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS p_ci_high, round(r, 6) AS r_it,
          round((exp(2 * (atanh(r) - z / sqrt(nc - 3))) - 1) / (exp(2 * (atanh(r) - z / sqrt(nc - 3))) + 1), 6) AS r_ci_low,
          round((exp(2 * (atanh(r) + z / sqrt(nc - 3))) - 1) / (exp(2 * (atanh(r) + z / sqrt(nc - 3))) + 1), 6) AS r_ci_high,
          round((k - 1) / (k - 2) * (1 - (pq - v) / vr), 6) AS alpha_if_deleted
        FROM i JOIN s USING (question_id), pq, kk, z""",
        "scored",
    ),
)
def _(spark, sf):
    df = ps.item_analysis(sc.binary_matrix(t.scored(spark, sf), t.MCQ))
    return rounded(df.select("item", "n", "p", "p_ci_low", "p_ci_high", "r_it", "r_ci_low", "r_ci_high", "alpha_if_deleted"))


@query("item_analysis_flags")
def _(spark, sf):
    return rounded(ps.item_analysis(sc.binary_matrix(t.scored(spark, sf), t.MCQ), {f"Q{i}": 4 for i in t.QUESTIONS}))


@query(
    "test_statistics",
    sql(
        f"""WITH {COMPLETE}, a AS (SELECT (k / (k - 1) * (1 - (SELECT sum(p * (1 - p)) FROM (SELECT avg(item_score) AS p FROM cell GROUP BY question_id)) / (SELECT var_pop(tot) FROM cc))) AS a FROM kk)
        SELECT k AS k_items, (SELECT count(*) FROM us) AS n_persons, (SELECT count(*) FROM cc) AS n_complete, round((SELECT avg(p) FROM (SELECT avg(item_score) AS p FROM bin GROUP BY question_id)), 6) AS mean_item_p,
          round((SELECT avg(tot) FROM cc), 6) AS mean_total, round((SELECT stddev_samp(tot) FROM cc), 6) AS sd_total, round(a, 6) AS kr20,
          round((SELECT stddev_samp(tot) FROM cc) * sqrt(greatest(0, 1 - a)), 6) AS sem, round(100 * 1.96 * sqrt(0.25 / (SELECT count(*) FROM us))) AS worst_half_width_pct FROM kk, a""",
        "scored",
    ),
)
def _(spark, sf):
    return rounded(ps.test_statistics(sc.binary_matrix(t.scored(spark, sf), t.MCQ)))


BINS = """rk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rest, md5(user_id), user_id) AS r, count(*) OVER (PARTITION BY question_id) AS n FROM g),
   bn AS (SELECT *, greatest(1, CASE WHEN n > 1 THEN ceil((r - 1) * least(5, n) / (n - 1)::DOUBLE) ELSE 1 END)::INT AS bin FROM rk)"""
LETTERS = """g0 AS (SELECT user_id, question_id, item_score, letter FROM (SELECT *, substr(response_value, 1, 1) AS letter, row_number() OVER (PARTITION BY user_id, question_id
    ORDER BY submitted_at, instrument_key, item_score, substr(response_value, 1, 1)) AS rn FROM scored WHERE base = 'content_mcq_assessment' AND item_score IN (0, 1)) WHERE rn = 1),
   g AS (SELECT g0.*, tot - item_score AS rest FROM g0 JOIN (SELECT user_id, sum(item_score) AS tot FROM g0 GROUP BY 1) USING (user_id))"""


@query("equal_count_bins", sql(f"WITH {LETTERS}, {BINS} SELECT question_id, user_id, rest, bin FROM bn", "scored"))
def _(spark, sf):
    m = sc.binary_matrix(t.scored(spark, sf), t.MCQ)
    totals = m.groupBy("user_id").agg(F.sum("item_score").alias("tot"))
    g = m.join(totals, "user_id").withColumn("rest", F.col("tot") - F.col("item_score"))
    return ps.equal_count_bins(g, ["question_id"], "rest", "user_id", 5).select("question_id", "user_id", "rest", "bin")


@query(
    "distractor_analysis",
    sql(
        f"""WITH {LETTERS}, {BINS}, o AS (SELECT question_id, letter, count(*) AS cnt, sum(item_score) AS ok, avg(rest) AS m FROM bn GROUP BY 1, 2),
          key AS (SELECT question_id, letter AS key FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY ok DESC, letter) AS rn FROM o WHERE ok > 0) WHERE rn = 1),
          tot AS (SELECT question_id, count(*) AS n, {', '.join(f'count(*) FILTER (bin = {b}) AS t{b}' for b in range(1, 6))} FROM bn GROUP BY 1),
          gr AS (SELECT question_id, letter, {', '.join(f'count(*) FILTER (bin = {b}) AS c{b}' for b in range(1, 6))} FROM bn GROUP BY 1, 2),
          pb AS (SELECT b.question_id, o.letter, corr(CASE WHEN b.letter = o.letter THEN 1.0 ELSE 0.0 END, b.rest) AS r, count(*) AS m FROM o JOIN key USING (question_id)
             JOIN bn b ON b.question_id = o.question_id AND b.letter IN (o.letter, key.key) WHERE o.letter <> key.key GROUP BY 1, 2)
        SELECT o.question_id AS item, o.letter AS option, o.letter = key AS keyed, n, round(cnt / n, 6) AS share, {', '.join(f'round(c{b} / t{b}, 6) AS g{b}' for b in range(1, 6))}, round(pb.r, 6) AS distractor_r
        FROM o JOIN key USING (question_id) JOIN tot USING (question_id) JOIN gr ON gr.question_id = o.question_id AND gr.letter = o.letter LEFT JOIN pb ON pb.question_id = o.question_id AND pb.letter = o.letter""",
        "scored",
    ),
)
def _(spark, sf):
    return rounded(ps.distractor_analysis(t.scored(spark, sf), t.MCQ).drop("flags"))


CONSTRUCTS = ["intrinsic_motivation", "identified_regulation", "external_regulation", "amotivation"]
TRAITS = f"{MEANS}, tr AS (SELECT user_id, construct, avg(mean_score) AS v FROM means WHERE instrument_key LIKE '%motivation_survey' GROUP BY 1, 2), ord AS (SELECT * FROM (VALUES ('intrinsic_motivation',1),('identified_regulation',2),('external_regulation',3),('amotivation',4)) o(c, i))"


@query(
    "correlation_matrix_pearson",
    sql(f"""WITH {TRAITS} SELECT x.construct AS a, y.construct AS b, round(corr(x.v, y.v), 6) AS r, count(*) AS n FROM tr x JOIN tr y ON x.user_id = y.user_id JOIN ord p ON p.c = x.construct JOIN ord q ON q.c = y.construct AND p.i < q.i GROUP BY 1, 2""", "canon"),
)
def _(spark, sf):
    return rounded(ps.correlation_matrix(ps.trait_scores(t.scored(spark, sf), "motivation_survey", S), CONSTRUCTS))


@query(
    "correlation_matrix_spearman",
    sql(f"""WITH {TRAITS}, pr AS (SELECT x.construct AS a, y.construct AS b, x.v AS xv, y.v AS yv FROM tr x JOIN tr y ON x.user_id = y.user_id JOIN ord p ON p.c = x.construct JOIN ord q ON q.c = y.construct AND p.i < q.i),
        rk AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY xv) + (count(*) OVER (PARTITION BY a, b, xv) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY a, b ORDER BY yv) + (count(*) OVER (PARTITION BY a, b, yv) - 1) / 2.0 AS ry FROM pr)
        SELECT a, b, round(corr(rx, ry), 6) AS r, count(*) AS n FROM rk GROUP BY 1, 2""", "canon"),
)
def _(spark, sf):
    return rounded(ps.correlation_matrix(ps.trait_scores(t.scored(spark, sf), "motivation_survey", S), CONSTRUCTS, method="spearman"))


def rm_input(spark, sf):
    return sc.eligible_subjects(person_module(spark, sf), 2)


@query(
    "rm_corr",
    sql(
        f"""WITH {PERSON_MODULE}, el AS (SELECT * FROM pm WHERE user_id IN (SELECT user_id FROM pm GROUP BY 1 HAVING count(DISTINCT module_id) >= 2)),
          l AS (SELECT 'engaged' AS predictor, user_id, engaged AS x, pct_correct AS y FROM el UNION ALL SELECT 'autonomy', user_id, autonomy, pct_correct FROM el),
          c AS (SELECT predictor, user_id, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM l WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY predictor, user_id)),
          s AS (SELECT predictor, count(DISTINCT user_id) AS ns, count(*) AS no, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS r FROM c GROUP BY 1),
          d AS (SELECT *, no - ns - 1 AS dof FROM s), p AS (SELECT *, {t_two_sided('(r * sqrt(dof / (1 - r * r)))', 'dof')} AS p FROM d),
          q AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM p)
        SELECT predictor, ns AS n_subjects, no AS n_obs, round(r, 6) AS r, dof, round(p, 6) AS p_unc, round(least(1.0, min(p * m / i) OVER (ORDER BY i DESC)), 6) AS p_fdr FROM q""",
        "canon", "scored",
    ),
)
def _(spark, sf):
    df = ps.rm_corr(rm_input(spark, sf), ["engaged", "autonomy"], "pct_correct")
    return rounded(df.select("predictor", "n_subjects", "n_obs", "r", "dof", "p_unc", "p_fdr"))


@query("rm_corr_full")
def _(spark, sf):
    return rounded(ps.rm_corr(rm_input(spark, sf), ["engaged", "autonomy"], "pct_correct"))


# -- ranks and agreement -----------------------------------------------------------------------


@query("average_rank", sql("SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS rank FROM lineitem"))
def _(spark, sf):
    df = t.table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return od.average_rank(df, ["l_returnflag"], "l_extendedprice")


@query("ordinal_rank", sql("SELECT c_custkey, c_mktsegment, c_nationkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey, md5(CAST(c_custkey AS VARCHAR)), c_custkey) AS position FROM customer"))
def _(spark, sf):
    df = t.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return od.ordinal_rank(df, ["c_mktsegment"], "c_nationkey", "c_custkey").drop("n_total")


@query("exact_quantiles", sql("SELECT l_returnflag, l_linenumber, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS q2, quantile_cont(l_extendedprice, 0.975) AS q3 FROM lineitem GROUP BY 1, 2"))
def _(spark, sf):
    return od.quantiles(t.table(spark, sf, "lineitem"), ["l_returnflag", "l_linenumber"], "l_extendedprice", {"q1": 0.25, "q2": 0.5, "q3": 0.975})


@query("running_total", sql("SELECT event_id, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) OVER (ORDER BY event_id)::BIGINT - CAST(json_extract_string(props, '$.k') AS BIGINT) AS before FROM events"))
def _(spark, sf):
    df = t.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return od.running_total(df, "event_id", "k", "before").select("event_id", "before")


def raters(spark, sf):
    li = t.table(spark, sf, "lineitem")
    a = 1 + F.col("l_quantity").cast("int") % 6
    return li.select("l_returnflag", a.alias("a"), F.least(F.lit(6), F.greatest(F.lit(1), a + F.col("l_linenumber") % 3 - 1)).alias("b"))


RATERS = "rt AS (SELECT l_returnflag, 1 + CAST(l_quantity AS INT) % 6 AS a, least(6, greatest(1, 1 + CAST(l_quantity AS INT) % 6 + l_linenumber % 3 - 1)) AS b FROM lineitem)"


def _kappa_sql(w: str) -> str:
    return f"""WITH {RATERS}, n AS (SELECT l_returnflag, count(*)::DOUBLE AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS ex, avg(CASE WHEN abs(a - b) <= 1 THEN 1.0 ELSE 0 END) AS near, sum({w}) AS o FROM rt GROUP BY 1),
       ma AS (SELECT l_returnflag, a, count(*)::DOUBLE AS ca FROM rt GROUP BY 1, 2), mb AS (SELECT l_returnflag, b, count(*)::DOUBLE AS cb FROM rt GROUP BY 1, 2),
       e AS (SELECT ma.l_returnflag, sum(ca * cb * {w}) AS e FROM ma JOIN mb ON ma.l_returnflag = mb.l_returnflag GROUP BY 1)
       SELECT n.l_returnflag, n::BIGINT AS n, round(ex, 6) AS exact, round(near, 6) AS within1, round(1 - o / (e / n), 6) AS kappa_w FROM n JOIN e USING (l_returnflag)"""


@query("weighted_kappa_quadratic", sql(_kappa_sql("(a - b) * (a - b) / 25.0")))
def _(spark, sf):
    return rounded(ag.weighted_kappa(raters(spark, sf), "a", "b", by=["l_returnflag"]))


@query("weighted_kappa_linear", sql(_kappa_sql("abs(a - b) / 5.0")))
def _(spark, sf):
    return rounded(ag.weighted_kappa(raters(spark, sf), "a", "b", weights="linear", by=["l_returnflag"]))


@query("agreement_summary")
def _(spark, sf):
    return rounded(ag.agreement_summary(raters(spark, sf), "a", "b"))


POINT = """SELECT n::BIGINT AS n, round(ex, 6) AS exact, round(near, 6) AS within1, round(k, 6) AS kappa_w, CASE WHEN k > 0.8 THEN 'almost perfect' WHEN k > 0.6 THEN 'substantial' WHEN k > 0.4 THEN 'moderate' WHEN k > 0.2 THEN 'fair' WHEN k > 0 THEN 'slight' ELSE 'poor' END AS band,
   true AS in_interval, true AS narrow FROM (SELECT *, 1 - o / (e / n) AS k FROM x)"""


@query("agreement_point", f"""WITH {RATERS}, m AS (SELECT count(*)::DOUBLE AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS ex, avg(CASE WHEN abs(a - b) <= 1 THEN 1.0 ELSE 0 END) AS near, sum((a - b) * (a - b) / 25.0) AS o FROM rt),
   ma AS (SELECT a, count(*)::DOUBLE AS ca FROM rt GROUP BY 1), mb AS (SELECT b, count(*)::DOUBLE AS cb FROM rt GROUP BY 1), ex AS (SELECT sum(ca * cb * (a - b) * (a - b) / 25.0) AS e FROM ma, mb), x AS (SELECT * FROM m, ex) {POINT}""")
def _(spark, sf):
    """The summary without its random interval, of which it is told that it holds the point and is narrow."""
    s = ag.agreement_summary(raters(spark, sf), "a", "b")
    inside = (F.col("kappa_lo") <= F.col("kappa_w")) & (F.col("kappa_w") <= F.col("kappa_hi"))
    return rounded(s.withColumn("in_interval", inside).withColumn("narrow", F.col("kappa_hi") - F.col("kappa_lo") < 8 / F.sqrt("n")).drop("kappa_lo", "kappa_hi"))


def _rating(spark, sf, which):
    p = t.table(spark, sf, "part")
    if which == "a":
        return p.filter(F.col("p_partkey") % 7 != 0).select("p_partkey", (1 + F.col("p_size") % 6).alias("v"))
    return p.filter(F.col("p_partkey") % 10 != 0).select("p_partkey", (1 + (F.col("p_size") + F.col("p_partkey") % 2) % 6).alias("v"))


KRIPP = """pr AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN 1 + p_size % 6 END AS x, CASE WHEN p_partkey % 10 <> 0 THEN 1 + (p_size + p_partkey % 2) % 6 END AS y FROM part),
   bo AS (SELECT * FROM pr WHERE x IS NOT NULL AND y IS NOT NULL), nv AS (SELECT v, count(*)::DOUBLE AS n FROM (SELECT x AS v FROM bo UNION ALL SELECT y FROM bo) GROUP BY 1),
   cum AS (SELECT v, n, sum(n) OVER (ORDER BY v) - n / 2 AS pos FROM nv), u AS (SELECT count(*) FILTER (x IS NOT NULL OR y IS NOT NULL) AS ut, (SELECT count(*) FROM bo) AS ub FROM pr)"""


def _kripp_sql(delta: str, level: str) -> str:
    return f"""WITH {KRIPP}, o AS (SELECT sum({delta}) AS o FROM bo JOIN cum c ON c.v = bo.x JOIN cum k ON k.v = bo.y),
       e AS (SELECT sum(c.n * k.n * {delta}) AS e FROM cum c, cum k), n AS (SELECT sum(n) AS n FROM nv)
       SELECT round(1 - (2 * o / n) / (e / (n * (n - 1))), 6) AS alpha, ut AS n_units_total, ub AS n_units_both_coded, ub < 20 AS low_n_warning, '{level}' AS level_of_measurement, CAST(NULL AS VARCHAR) AS error FROM o, e, n, u"""


for _level, _delta in (
    ("nominal", "CASE WHEN c.v <> k.v THEN 1.0 ELSE 0.0 END"),
    ("ordinal", "(c.pos - k.pos) * (c.pos - k.pos)"),
    ("interval", "(c.v - k.v) * (c.v - k.v)"),
    ("ratio", "power((c.v - k.v) / (c.v + k.v)::DOUBLE, 2)"),
):

    def _kripp(spark, sf, level=_level):
        return rounded(ag.krippendorff_alpha(_rating(spark, sf, "a"), _rating(spark, sf, "b"), ["p_partkey"], "v", level))

    query(f"krippendorff_{_level}", sql(_kripp_sql(_delta, _level)))(_kripp)


def _labelled(spark, sf):
    d = t.table(spark, sf, "documents").select("doc_id", "n_chars")
    return d.join(t.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


ROC = """lb AS (SELECT n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)), h AS (SELECT s, sum(y)::DOUBLE AS tp1, count(*) - sum(y)::DOUBLE AS fp1 FROM lb GROUP BY 1),
   c AS (SELECT s, tp1, fp1, sum(tp1) OVER (ORDER BY s DESC) AS tp, sum(fp1) OVER (ORDER BY s DESC) AS fp, sum(tp1) OVER () AS p, sum(fp1) OVER () AS q FROM h)"""


@query("cumulative_roc", sql(f"WITH {ROC} SELECT s::DOUBLE AS threshold, tp, fp, p, q FROM c"))
def _(spark, sf):
    return ag.roc_points(_labelled(spark, sf), "n_chars", "quality").select("threshold", "tp", "fp", "p", "q")


@query(
    "youden_threshold",
    sql(f"""WITH {ROC}, b AS (SELECT *, tp / p - fp / q AS j FROM c ORDER BY j DESC, s DESC LIMIT 1)
        SELECT (p + q)::BIGINT AS n_pairs, p::BIGINT AS n_true_matches, q::BIGINT AS n_true_nonmatches, s::DOUBLE AS optimal_threshold, round(tp / p, 6) AS sensitivity, round(1 - fp / q, 6) AS specificity,
        round(j, 6) AS youden_j, (SELECT round(sum(fp1 * (tp - tp1 / 2)) / max(p * q), 6) FROM c) AS auc FROM b"""),
)
def _(spark, sf):
    return rounded(ag.youden_threshold(_labelled(spark, sf), "n_chars", "quality").drop("low_n_warning", "error"))

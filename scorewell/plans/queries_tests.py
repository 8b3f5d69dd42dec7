"""Hypothesis tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import inferential as inf
from ..operators import scores as sc
from . import tables as t
from .queries_scores import ASSESS, assess
from .registry import query
from .sqltext import chi2_sf, f_sf, norm_sf, sql, t_two_sided


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def paired(spark, sf):
    df = t.pre_post(t.scored(spark, sf))
    return inf.pair_scores(sc.user_scores(df, t.PRE, True), sc.user_scores(df, t.POST, True))


PAIRS = """pairs AS (SELECT user_id, max(CASE WHEN pre THEN pct END) AS pre, max(CASE WHEN NOT pre THEN pct END) AS post FROM (
    SELECT user_id, submitted_at < TIMESTAMP '1998-07-01' AS pre, sum(item_score) / count(item_score) * 100 AS pct FROM scored
    WHERE base = 'content_mcq_assessment' AND item_score IS NOT NULL GROUP BY 1, 2) GROUP BY 1 HAVING count(*) = 2)"""


@query("pre_post_join", sql(f"WITH {PAIRS} SELECT user_id, round(pre, 6) AS pre, round(post, 6) AS post FROM pairs", "scored"))
def _(spark, sf):
    return rounded(paired(spark, sf))


@query("normality_by_instrument")
def _(spark, sf):
    return rounded(inf.normality(assess(spark, sf), "pct_correct", ["instrument_key"]))


@query("normality_flags", sql(f"WITH {ASSESS} SELECT left(instrument_key, 12) AS part, count(*) AS n, count(*) < 20 AS low_n_warning, count(*) > 5000 AS large_n_warning FROM assess GROUP BY 1", "canon"))
def _(spark, sf):
    df = assess(spark, sf).withColumn("part", F.substring("instrument_key", 1, 12))
    return inf.normality(df, "pct_correct", ["part"]).select("part", "n", "low_n_warning", "large_n_warning")


@query(
    "normality_moments",
    sql(
        f"""WITH {ASSESS}, m AS (SELECT instrument_key, avg(pct_correct) AS mu, count(*) AS n FROM assess GROUP BY 1),
        c AS (SELECT a.instrument_key, n, avg((pct_correct - mu)**2) AS m2, avg((pct_correct - mu)**3) AS m3, avg((pct_correct - mu)**4) AS m4 FROM assess a JOIN m USING (instrument_key) GROUP BY 1, 2)
        SELECT instrument_key, n, round(m3 / m2**1.5, 6) AS skewness, round(m4 / m2**2 - 3, 6) AS kurtosis FROM c""",
        "canon",
    ),
)
def _(spark, sf):
    df = inf.normality(assess(spark, sf), "pct_correct", ["instrument_key"])
    return rounded(df.select("instrument_key", "n", "skewness", "kurtosis"))


# Acklam-free check of W: normal scores by bisection are too slow in SQL, so the quantile uses AS 241.
def _as241(p: str) -> str:
    from ..functions import numbers as nb

    def poly(x: str, cs) -> str:
        out = repr(cs[-1])
        for c in reversed(cs[:-1]):
            out = f"({out} * {x} + {c!r})"
        return out

    q, r = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    c = f"(0.180625 - {q} * {q})"
    centre = f"{q} * {poly(c, nb._AS241_CENTRE[0])} / {poly(c, nb._AS241_CENTRE[1])}"
    m, tl = f"({r} - 1.6)", f"({r} - 5)"
    middle = f"sign({q}) * {poly(m, nb._AS241_MIDDLE[0])} / {poly(m, nb._AS241_MIDDLE[1])}"
    tail = f"sign({q}) * {poly(tl, nb._AS241_TAIL[0])} / {poly(tl, nb._AS241_TAIL[1])}"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {centre} WHEN {r} <= 5 THEN {middle} ELSE {tail} END)"


def _horner(x: str, cs) -> str:
    out = repr(float(cs[-1]))
    for c in reversed(cs[:-1]):
        out = f"({out} * {x} + {float(c)!r})"
    return out


SHAPIRO_TAIL = f"""w AS (SELECT g, n, power(a1 * (xn - x1) + a2 * (xp - x2) + (mx - m1 * (xn - x1) - m2 * (xp - x2))
      / sqrt((mm - 2*m1*m1 - 2*m2*m2) / (1 - 2*a1*a1 - 2*a2*a2)), 2) / ss AS statistic FROM (
   SELECT *, m1 / sqrt(mm) + {_horner('u', inf._ROYSTON_C1)} AS a1, m2 / sqrt(mm) + {_horner('u', inf._ROYSTON_C2)} AS a2 FROM (
   SELECT g, n, 1 / sqrt(n) AS u, sum(m * m) AS mm, sum(m * v) AS mx, max(m) AS m1, max(CASE WHEN i = n - 1 THEN m END) AS m2,
     max(CASE WHEN i = 1 THEN v END) AS x1, max(CASE WHEN i = 2 THEN v END) AS x2, max(CASE WHEN i = n - 1 THEN v END) AS xp, max(CASE WHEN i = n THEN v END) AS xn,
     var_pop(v) * n AS ss FROM (SELECT *, {_as241('((i - 0.375) / (n + 0.25))')} AS m FROM ord) GROUP BY g, n))),
 z AS (SELECT g, n, statistic, (ln(1 - statistic) - {_horner('ln(n)', (-1.5861, -0.31082, -0.083751, 0.0038915))})
   / exp({_horner('ln(n)', (-0.4803, -0.082676, 0.0030302))}) AS z FROM w)"""


@query(
    "shapiro_wilk",
    sql(
        f"""WITH {ASSESS}, ord AS (SELECT instrument_key AS g, pct_correct AS v, row_number() OVER (PARTITION BY instrument_key ORDER BY pct_correct) AS i,
          count(*) OVER (PARTITION BY instrument_key) AS n FROM assess), {SHAPIRO_TAIL}
        SELECT g AS instrument_key, n, round(statistic, 6) AS statistic, round({norm_sf('z')}, 6) AS p_value FROM z""",
        "canon",
    ),
)
def _(spark, sf):
    df = inf.normality(assess(spark, sf), "pct_correct", ["instrument_key"])
    return rounded(df.select("instrument_key", "n", "statistic", "p_value"))


def _levene_sql(center: str) -> str:
    return f"""WITH {ASSESS}, g AS (SELECT instrument_key, grade, pct_correct AS v FROM assess WHERE grade IS NOT NULL),
        c AS (SELECT instrument_key, grade, {center} AS c FROM g GROUP BY 1, 2),
        z AS (SELECT g.instrument_key, g.grade, abs(v - c) AS z FROM g JOIN c ON g.instrument_key = c.instrument_key AND g.grade = c.grade),
        s AS (SELECT instrument_key, grade, count(*) AS n, avg(z) AS m, var_pop(z) * count(*) AS ss FROM z GROUP BY 1, 2),
        o AS (SELECT instrument_key, avg(z) AS mu FROM z GROUP BY 1),
        f AS (SELECT s.instrument_key, count(*) AS n_groups, sum(n)::BIGINT AS n, min(n) AS min_n, (sum(n * (m - mu)**2) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))) AS f
              FROM s JOIN o USING (instrument_key) GROUP BY 1)
        SELECT instrument_key, n_groups, n, min_n, round(f, 6) AS statistic, round({f_sf('f', '(n_groups - 1)', '(n - n_groups)')}, 6) AS p_value FROM f"""


LEVENE_COLS = ["instrument_key", "n_groups", "n", "min_n", "statistic", "p_value"]


@query("levene_median", sql(_levene_sql("median(v)"), "canon"))
def _(spark, sf):
    return rounded(inf.levene(assess(spark, sf), "pct_correct", "grade", ["instrument_key"]).select(*LEVENE_COLS))


@query("levene_mean", sql(_levene_sql("avg(v)"), "canon"))
def _(spark, sf):
    return rounded(inf.levene(assess(spark, sf), "pct_correct", "grade", ["instrument_key"], "mean").select(*LEVENE_COLS))


@query("levene_trimmed")
def _(spark, sf):
    return rounded(inf.levene(assess(spark, sf), "pct_correct", "grade", ["instrument_key"], "trimmed").select(*LEVENE_COLS))


@query(
    "recommend_test",
    sql(
        """SELECT instrument_key, n_groups, CASE WHEN n_groups > 2 THEN 'One-way ANOVA' ELSE 'Independent t-test' END AS if_normal,
        CASE WHEN n_groups > 2 THEN 'Kruskal-Wallis' ELSE 'Mann-Whitney U' END AS if_not, 'Wilcoxon signed-rank' AS paired_not, 'RM-ANOVA' AS repeated_normal
        FROM (SELECT instrument_key, count(DISTINCT CASE WHEN module_num < 4 THEN gender ELSE grade END) AS n_groups FROM canon JOIN demographics USING (user_id) GROUP BY 1, module_num)""".replace("canon JOIN demographics USING (user_id)", "(SELECT c.instrument_key, c.module_num, c.grade, d.gender FROM canon c JOIN demographics d ON c.user_id = d.user_id)"),
        "canon",
    ),
)
def _(spark, sf):
    df = t.canonical(spark, sf).join(t.demographics(spark, sf).select("user_id", "gender"), "user_id")
    module = F.regexp_extract("instrument_key", r"(\d+)", 1).cast("int")
    counts = df.groupBy("instrument_key").agg(F.count_distinct(F.when(module < 4, F.col("gender")).otherwise(F.col("grade"))).alias("n_groups"))
    yes, no, k = F.lit(inf.NORMAL), F.lit(inf.NOT_NORMAL), F.col("n_groups")
    return counts.select(
        "instrument_key", "n_groups", inf.recommend_test(yes, n_groups=k).alias("if_normal"), inf.recommend_test(no, n_groups=k).alias("if_not"),
        inf.recommend_test(no, paired=True).alias("paired_not"), inf.recommend_test(yes, repeated=True).alias("repeated_normal"))


@query(
    "paired_t_test",
    sql(
        f"""WITH {PAIRS}, s AS (SELECT count(*) AS n, avg(pre) AS a, stddev_samp(pre) AS sa, avg(post) AS b, stddev_samp(post) AS sb,
          avg(post - pre) AS m, stddev_samp(post - pre) AS sd FROM pairs), v AS (SELECT *, m / (sd / sqrt(n)) AS tt FROM s)
        SELECT n AS n_pairs, round(a, 6) AS pre_mean, round(sa, 6) AS pre_std, round(b, 6) AS post_mean, round(sb, 6) AS post_std, round(m, 6) AS mean_diff,
          round(tt, 6) AS t_stat, round({t_two_sided('tt', '(n - 1)')}, 6) AS t_p_value, round(m / sd, 6) AS cohens_d FROM v""",
        "scored",
    ),
)
def _(spark, sf):
    cols = ["n_pairs", "pre_mean", "pre_std", "post_mean", "post_std", "mean_diff", "t_stat", "t_p_value", "cohens_d"]
    return rounded(inf.paired_comparison(paired(spark, sf), parts=()).select(*cols))


@query("paired_comparison")
def _(spark, sf):
    return rounded(inf.paired_comparison(paired(spark, sf)))


@query(
    "wilcoxon_signed_rank",
    sql(
        f"""WITH {PAIRS}, d AS (SELECT post - pre AS d FROM pairs WHERE post - pre <> 0), h AS (SELECT abs(d) AS a, count(*) AS c, count(*) FILTER (d > 0) AS up FROM d GROUP BY 1),
          r AS (SELECT *, sum(c) OVER (ORDER BY a) - c + (c + 1) / 2.0 AS rk FROM h),
          s AS (SELECT sum(c)::DOUBLE AS n, sum(rk * up) AS rp, sum(rk * (c - up)) AS rm, sum(power(c, 3) - c) AS ties FROM r),
          z AS (SELECT *, (least(rp, rm) - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM s)
        SELECT (SELECT count(*) FROM pairs) AS n, n::BIGINT AS n_used, least(rp, rm)::DOUBLE AS statistic, round(least(1.0, 2 * {norm_sf('abs(z)')}), 6) AS p_value,
          round((rp - rm) / (rp + rm), 6) AS rank_biserial, 'normal' AS method FROM z""",
        "scored",
    ),
)
def _(spark, sf):
    return rounded(inf.signed_rank(paired(spark, sf).withColumn("diff", F.col("post") - F.col("pre"))))


@query(
    "bland_altman",
    sql(
        f"""WITH {PAIRS}, s AS (SELECT count(*) AS n, avg(post - pre) AS m, stddev_samp(post - pre) AS sd, corr(post - pre, (pre + post) / 2) AS r FROM pairs)
        SELECT n AS n_pairs, round(m, 6) AS mean_diff, round(sd, 6) AS sd_diff, round(m - 2 * sd, 6) AS loa_lower, round(m + 2 * sd, 6) AS loa_upper,
          round(r, 6) AS proportional_bias_r, round({t_two_sided('(r * sqrt((n - 2) / (1 - r * r)))', '(n - 2)')}, 6) AS proportional_bias_p,
          {t_two_sided('(r * sqrt((n - 2) / (1 - r * r)))', '(n - 2)')} < 0.05 AS proportional_bias, n < 30 AS low_n_warning FROM s""",
        "scored",
    ),
)
def _(spark, sf):
    return rounded(inf.bland_altman(paired(spark, sf)))


@query(
    "bland_altman_points",
    sql(f"WITH {PAIRS} SELECT user_id, round_even(pre, 2) AS pre, round_even(post, 2) AS post, round_even(post - pre, 2) AS diff, round_even((pre + post) / 2, 2) AS mean_val FROM pairs", "scored"),
)
def _(spark, sf):
    return inf.bland_altman_points(paired(spark, sf))


def grouped(spark, sf, column):
    scores = sc.user_scores(t.scored(spark, sf), t.MCQ, True)
    return scores.join(t.demographics(spark, sf).select("user_id", column), "user_id", "left")


def _between_sql(column: str) -> str:
    return f"""us AS (SELECT user_id, sum(item_score) / count(item_score) * 100 AS score FROM scored WHERE base = 'content_mcq_assessment' AND item_score IS NOT NULL GROUP BY 1),
      x AS (SELECT CAST({column} AS VARCHAR) AS g, score FROM us JOIN demographics USING (user_id) WHERE {column} IS NOT NULL),
      h AS (SELECT score, count(*) AS c, sum(count(*)) OVER (ORDER BY score) - count(*) + (count(*) + 1) / 2.0 AS rk FROM x GROUP BY score),
      gs AS (SELECT g, count(*) AS n, avg(score) AS m, var_samp(score) AS v, sum(rk) AS rs FROM x JOIN h USING (score) GROUP BY g),
      tot AS (SELECT count(*)::DOUBLE AS k, sum(n)::DOUBLE AS n, sum(n * m) / sum(n) AS mu, sum((n - 1) * v) AS ssw, sum(rs * rs / n) AS rr FROM gs),
      ti AS (SELECT sum(power(c, 3) - c) AS ties FROM h),
      bt AS (SELECT sum(gs.n * (m - mu)**2) AS ssb FROM gs, tot)"""


@query(
    "between_groups_anova_kruskal",
    sql(
        f"""WITH {_between_sql('grade')}, s AS (SELECT k, n, ssb, ssw, (ssb / (k - 1)) / (ssw / (n - k)) AS f, (12 / (n * (n + 1)) * rr - 3 * (n + 1)) / (1 - ties / (n**3 - n)) AS h FROM tot, ti, bt)
        SELECT k::BIGINT AS n_groups, n::BIGINT AS n_total, round(f, 6) AS f_stat, round({f_sf('f', '(k - 1)', '(n - k)')}, 6) AS anova_p, round(ssb / (ssb + ssw), 6) AS eta_squared,
        round(h, 6) AS kruskal_stat, round({chi2_sf('h', '(k - 1)')}, 6) AS kruskal_p FROM s""",
        "scored", "demographics",
    ),
)
def _(spark, sf):
    cols = ["n_groups", "n_total", "f_stat", "anova_p", "eta_squared", "kruskal_stat", "kruskal_p"]
    return rounded(inf.between_groups(grouped(spark, sf, "grade"), "grade", parts=()).select(*cols))


@query(
    "between_two_groups",
    sql(
        f"""WITH {_between_sql('gender')}, ab AS (SELECT max(CASE WHEN g = 'Female' THEN n END)::DOUBLE AS na, max(CASE WHEN g = 'Male' THEN n END)::DOUBLE AS nb,
            max(CASE WHEN g = 'Female' THEN m END) AS ma, max(CASE WHEN g = 'Male' THEN m END) AS mb, max(CASE WHEN g = 'Female' THEN v END) AS va, max(CASE WHEN g = 'Male' THEN v END) AS vb,
            max(CASE WHEN g = 'Female' THEN rs END) AS ra FROM gs),
          s AS (SELECT *, ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) AS pv, ra - na * (na + 1) / 2 AS u FROM ab, ti),
          z AS (SELECT *, (ma - mb) / sqrt(pv * (1 / na + 1 / nb)) AS tt, (ma - mb) / sqrt(va / na + vb / nb) AS wt,
            (va / na + vb / nb)**2 / ((va / na)**2 / (na - 1) + (vb / nb)**2 / (nb - 1)) AS wdf,
            (greatest(u, na * nb - u) - na * nb / 2 - 0.5) / sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1)))) AS zz FROM s)
        SELECT round(tt, 6) AS t_stat, round({t_two_sided('tt', '(na + nb - 2)')}, 6) AS t_p_value, round(wt, 6) AS welch_t_stat, round({t_two_sided('wt', 'wdf')}, 6) AS welch_t_p,
          u::DOUBLE AS mannwhitney_stat, round(2 * {norm_sf('zz')}, 6) AS mannwhitney_p, round((ma - mb) / sqrt(pv), 6) AS cohens_d_indep FROM z""",
        "scored", "demographics",
    ),
)
def _(spark, sf):
    cols = ["t_stat", "t_p_value", "welch_t_stat", "welch_t_p", "mannwhitney_stat", "mannwhitney_p", "cohens_d_indep"]
    return rounded(inf.between_groups(grouped(spark, sf, "gender"), "gender", parts=()).select(*cols))


@query("between_groups")
def _(spark, sf):
    return rounded(inf.between_groups(grouped(spark, sf, "grade"), "grade"))


@query(
    "group_statistics",
    sql(f"WITH {_between_sql('first_language_english')} SELECT g AS \"group\", n, round(m, 6) AS mean, round(sqrt(v), 6) AS sd FROM gs", "scored", "demographics"),
)
def _(spark, sf):
    return rounded(inf.group_statistics(grouped(spark, sf, "first_language_english"), "first_language_english"))


OCCASIONS = [f"module_{m}" for m in t.MODULES]
RM = """p AS (SELECT user_id, module_id, sum(item_score) / count(item_score) * 100 AS v FROM scored WHERE base = 'content_mcq_assessment' AND item_score IS NOT NULL GROUP BY 1, 2),
  x AS (SELECT * FROM p WHERE user_id IN (SELECT user_id FROM p GROUP BY 1 HAVING count(*) = 7))"""


def vectors(spark, sf):
    return inf.occasion_vectors(sc.percent_by_module(t.scored(spark, sf), t.MCQ), "module_id", OCCASIONS)


@query("occasion_statistics", sql(f"WITH {RM} SELECT module_id AS occasion, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM x GROUP BY 1", "scored"))
def _(spark, sf):
    return rounded(inf.occasion_statistics(vectors(spark, sf), OCCASIONS))


@query(
    "friedman_and_rm_anova",
    sql(
        f"""WITH {RM}, r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY v) + (count(*) OVER (PARTITION BY user_id, v) - 1) / 2.0 AS rk,
            count(*) OVER (PARTITION BY user_id, v) AS tie FROM x),
          n AS (SELECT count(DISTINCT user_id)::DOUBLE AS n, 7.0 AS k, sum(power(tie, 2) - 1) AS ties, avg(v) AS mu FROM r),
          c AS (SELECT sum(rs * rs) AS rr, sum((m - mu)**2) * max(n) AS sst FROM (SELECT module_id, sum(rk)::DOUBLE AS rs, avg(v) AS m FROM r GROUP BY 1), n),
          u AS (SELECT sum((m - mu)**2) * 7 AS sss FROM (SELECT user_id, avg(v) AS m FROM r GROUP BY 1), n),
          tt AS (SELECT sum((v - mu)**2) AS ss FROM r, n),
          s AS (SELECT *, (12 / (n * k * (k + 1)) * rr - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))) AS fr, ss - sst - sss AS sse FROM n, c, u, tt),
          z AS (SELECT *, (sst / (k - 1)) / (sse / ((k - 1) * (n - 1))) AS f FROM s)
        SELECT n::BIGINT AS n_subjects, round(fr, 6) AS friedman_stat, round({chi2_sf('fr', '(k - 1)')}, 6) AS p_value,
          round(12 * (rr - n * n * k * (k + 1) * (k + 1) / 4) / (n * n * (k * k * k - k)), 6) AS kendalls_w, round(sst, 4) AS ss_time, round(sss, 4) AS ss_subject, round(sse, 4) AS ss_error,
          round(f, 6) AS rm_f, round({f_sf('f', '(k - 1)', '((k - 1) * (n - 1))')}, 6) AS rm_p_unc, round(sst / ss, 6) AS eta_sq_gen FROM z""",
        "scored",
    ),
)
def _(spark, sf):
    df = inf.repeated_measures(vectors(spark, sf), OCCASIONS)
    for c in ("ss_time", "ss_subject", "ss_error"):
        df = df.withColumn(c, F.round(c, 4))
    return rounded(df.select("n_subjects", "friedman_stat", "p_value", "kendalls_w", "ss_time", "ss_subject", "ss_error", "rm_f", "rm_p_unc", "eta_sq_gen"))


@query("repeated_measures")
def _(spark, sf):
    return rounded(inf.repeated_measures(vectors(spark, sf), OCCASIONS))


PAIR_DIFFS = f"""{RM}, d AS (SELECT a.module_id AS time_a, b.module_id AS time_b, round_even(b.v - a.v, 9) AS d FROM x a JOIN x b ON a.user_id = b.user_id AND a.module_id < b.module_id)"""


@query(
    "posthoc_paired_t",
    sql(
        f"""WITH {PAIR_DIFFS}, s AS (SELECT time_a, time_b, count(*) AS n, avg(d) AS m, stddev_samp(d) AS sd FROM d GROUP BY 1, 2), z AS (SELECT *, m / (sd / sqrt(n)) AS tt FROM s),
          pv AS (SELECT *, {t_two_sided('tt', '(n - 1)')} AS p FROM z)
        SELECT time_a, time_b, n, round(tt, 6) AS statistic, round(p, 6) AS p_raw, round(m / sd, 6) AS effect_size, round(least(1.0, p * 21), 6) AS p_adj, least(1.0, p * 21) < 0.05 AS significant FROM pv""",
        "scored",
    ),
)
def _(spark, sf):
    return rounded(inf.posthoc_pairs(vectors(spark, sf), OCCASIONS, "paired_t"))


@query(
    "posthoc_wilcoxon",
    sql(
        f"""WITH {PAIR_DIFFS}, h AS (SELECT time_a, time_b, abs(d) AS a, count(*) AS c, count(*) FILTER (d > 0) AS up FROM d WHERE d <> 0 GROUP BY 1, 2, 3),
          r AS (SELECT *, sum(c) OVER (PARTITION BY time_a, time_b ORDER BY a) - c + (c + 1) / 2.0 AS rk FROM h),
          s AS (SELECT time_a, time_b, sum(c)::DOUBLE AS n, sum(rk * up) AS rp, sum(rk * (c - up)) AS rm, sum(power(c, 3) - c) AS ties FROM r GROUP BY 1, 2),
          z AS (SELECT *, (least(rp, rm) - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM s),
          pv AS (SELECT *, least(1.0, 2 * {norm_sf('abs(z)')}) AS p FROM z)
        SELECT time_a, time_b, (SELECT count(DISTINCT user_id) FROM x) AS n, least(rp, rm)::DOUBLE AS statistic, round(p, 6) AS p_raw, round((rp - rm) / (rp + rm), 6) AS effect_size,
          round(least(1.0, p * 21), 6) AS p_adj, least(1.0, p * 21) < 0.05 AS significant FROM pv""",
        "scored",
    ),
)
def _(spark, sf):
    return rounded(inf.posthoc_pairs(vectors(spark, sf), OCCASIONS, "wilcoxon"))

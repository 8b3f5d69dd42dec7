"""Item response models, item difficulty, mixed models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import materialize
from ..operators import indices as ix
from ..operators import irt
from ..operators import mixed as mx
from ..operators import scores as sc
from . import tables as t
from .queries_items import rm_input
from .queries_scores import BINARY, PERSON_MODULE
from .queries_tests import rounded
from .registry import query
from .sqltext import sql


def matrix(spark, sf):
    return sc.binary_matrix(t.scored(spark, sf), t.MCQ)


def logit_params(m):
    """Closed-form difficulties: the logit of the proportion wrong."""
    p = F.avg("item_score")
    return m.groupBy(F.col("question_id").alias("item_id")).agg(F.lit(1.0).alias("a"), F.log((1 - p) / p).alias("b"))


GRID = """gr AS (SELECT i, -4 + 0.2 * i AS th, exp(-0.5 * (-4 + 0.2 * i) * (-4 + 0.2 * i)) AS w FROM range(0, 41) t(i)), ip AS (SELECT question_id, ln((1 - avg(item_score)) / avg(item_score)) AS b FROM bin GROUP BY 1),
   ll AS (SELECT user_id, i, th, w, sum(CASE WHEN item_score = 1 THEN -ln(1 + exp(-(th - b))) ELSE -ln(1 + exp(th - b)) END) AS l FROM bin JOIN ip USING (question_id), gr GROUP BY 1, 2, 3, 4),
   ea AS (SELECT user_id, sum(exp(l) * w * th) / sum(exp(l) * w) AS theta FROM ll GROUP BY 1),
   es AS (SELECT ll.user_id, theta, sqrt(sum(exp(l) * w * (th - theta) * (th - theta)) / sum(exp(l) * w)) AS se FROM ll JOIN ea USING (user_id) GROUP BY 1, 2)"""


@query("ability_eap", sql(f"WITH {BINARY}, {GRID} SELECT user_id, round(theta, 6) AS theta, round(se, 6) AS theta_se FROM es", "scored"))
def _(spark, sf):
    m = matrix(spark, sf)
    return rounded(irt.ability_eap(m, logit_params(m)))


@query(
    "item_fit",
    sql(f"""WITH {BINARY}, {GRID}, r AS (SELECT question_id, 1 / (1 + exp(-(theta - b))) AS p, item_score FROM bin JOIN ip USING (question_id) JOIN ea USING (user_id))
        SELECT question_id AS item_id, round(sum(p * (1 - p) * (item_score - p)**2) / sum(p * (1 - p)), 6) AS infit, round(avg((item_score - p)**2), 6) AS outfit,
        round(sum((item_score - p)**2) / sum(p * (1 - p)), 6) AS infit_ms, round(avg((item_score - p)**2 / (p * (1 - p))), 6) AS outfit_ms FROM r GROUP BY 1""", "scored"),
)
def _(spark, sf):
    m = matrix(spark, sf)
    p = logit_params(m)
    return rounded(irt.item_fit(m, irt.ability_eap(m, p), p))


@query(
    "information_criteria",
    sql(f"""WITH {BINARY}, {GRID}, r AS (SELECT question_id, 1 / (1 + exp(-(theta - b))) AS p, item_score FROM bin JOIN ip USING (question_id) JOIN ea USING (user_id)),
        s AS (SELECT sum(CASE WHEN item_score = 1 THEN ln(p) ELSE ln(1 - p) END) AS l, count(DISTINCT question_id) AS k, (SELECT count(*) FROM ea) AS n FROM r)
        SELECT round(l, 4) AS loglik, k AS n_params, n, round(-2 * l + 2 * k, 4) AS aic, round(-2 * l + k * ln(n), 4) AS bic FROM s""", "scored"),
)
def _(spark, sf):
    m = matrix(spark, sf)
    p = logit_params(m)
    return rounded(irt.information_criteria(m, irt.ability_eap(m, p), p), 4)


@query("item_curves", sql(f"WITH {BINARY}, ip AS (SELECT question_id, ln((1 - avg(item_score)) / avg(item_score)) AS b FROM bin GROUP BY 1) SELECT question_id AS item_id, round(i * 8.0 / 99 - 4, 4) AS theta, 'P(correct)' AS category, round(1 / (1 + exp(-((i * 8.0 / 99 - 4) - b))), 6) AS probability FROM ip, range(0, 100) t(i)", "scored"))
def _(spark, sf):
    return irt.item_curves(logit_params(matrix(spark, sf)))


@query("category_curves", sql("""WITH p AS (SELECT question_id, 1.0 AS a, ln(avg(CASE WHEN item_score < 2 THEN 1.0 ELSE 0 END) / (1 - avg(CASE WHEN item_score < 2 THEN 1.0 ELSE 0 END))) AS t1, ln(avg(CASE WHEN item_score < 3 THEN 1.0 ELSE 0 END) / (1 - avg(CASE WHEN item_score < 3 THEN 1.0 ELSE 0 END))) AS t2 FROM scored WHERE base = 'engagement_survey' GROUP BY 1),
   g AS (SELECT *, i * 8.0 / 20 - 4 AS th FROM p, range(0, 21) t(i)), c AS (SELECT question_id, th, 1 / (1 + exp(-(th - t1))) AS u1, 1 / (1 + exp(-(th - t2))) AS u2 FROM g)
   SELECT question_id AS item_id, round(th, 4) AS theta, unnest(['Cat 1', 'Cat 2', 'Cat 3']) AS category, unnest([round(1 - u1, 6), round(u1 - u2, 6), round(u2, 6)]) AS probability FROM c""", "scored"))
def _(spark, sf):
    df = t.scored(spark, sf).filter(F.col("instrument_key").endswith("engagement_survey"))
    cut = lambda k: F.log(F.avg((F.col("item_score") < k).cast("double")) / (1 - F.avg((F.col("item_score") < k).cast("double"))))
    params = df.groupBy(F.col("question_id").alias("item_id")).agg(F.lit(1.0).alias("a"), F.array(cut(2), cut(3)).alias("thresholds"))
    return irt.category_curves(params, 21)


@query("wright_map", sql(f"WITH {BINARY}, {GRID} SELECT 'person' AS kind, user_id AS id, round(theta, 6) AS position FROM ea UNION ALL SELECT 'item', question_id, round(b, 6) FROM ip", "scored"))
def _(spark, sf):
    m = matrix(spark, sf)
    p = logit_params(m)
    return rounded(irt.wright_map(irt.ability_eap(m, p), p))


@query("rank_hardest", sql(f"WITH {BINARY}, ip AS (SELECT question_id, ln((1 - avg(item_score)) / avg(item_score)) AS b FROM bin GROUP BY 1) SELECT question_id AS item_id, CAST(rank() OVER (ORDER BY round_even(b, 2) DESC) AS INT) AS rank_hardest FROM ip", "scored"))
def _(spark, sf):
    return irt.rank_hardest(logit_params(matrix(spark, sf)), "b").select("item_id", "rank_hardest")


@query("rasch_fit")
def _(spark, sf):
    return rounded(irt.rasch_fit(matrix(spark, sf)).item_params(spark), 3)


@query("rasch_fit_missing_wrong")
def _(spark, sf):
    return rounded(irt.rasch_fit(matrix(spark, sf), "wrong").item_params(spark), 3)


@query("twopl_fit")
def _(spark, sf):
    return rounded(irt.twopl_fit(matrix(spark, sf)).item_params(spark), 2)


SOLVED = f"WITH {BINARY} SELECT question_id AS item_id, true AS solved, true AS converged FROM bin GROUP BY 1 HAVING min(item_score) < max(item_score)"


def solved(spark, sf, fit, slopes):
    """Whether the likelihood equations of each item hold at the fitted parameters, computed apart from the fit."""
    m = materialize(matrix(spark, sf), "matrix")
    f = fit(m)
    p = f.item_params(spark)
    at_end = F.col("a") <= irt.LOW_SLOPE  # a slope at its lower end may only want to fall
    free = (F.abs("slope_gap") < 2e-4) | at_end & (F.col("slope_gap") < 0) if slopes else F.lit(True)
    return irt.score_residuals(m, p).join(p, "item_id").select("item_id", ((F.abs("gap") < 2e-4) & free).alias("solved"), "converged")


@query("rasch_score_equations", sql(SOLVED, "scored"))
def _(spark, sf):
    return solved(spark, sf, irt.rasch_fit, False)


@query("twopl_score_equations", sql(SOLVED, "scored"))
def _(spark, sf):
    return solved(spark, sf, irt.twopl_fit, True)


@query("grm_fit")
def _(spark, sf):
    """Every construct of both surveys in the same passes."""
    fits = irt.grm_fits(sc.likert_matrices(t.scored(spark, sf), t.SURVEYS))
    return irt.graded_params(spark, fits).withColumn("a", F.round("a", 2)).withColumn("thresholds", F.transform("thresholds", lambda x: F.round(x, 2)))


@query("grm_convergence", sql("SELECT concat(base, ':', construct) AS g, count(DISTINCT question_id) AS n_items, true AS converged, true AS ordered FROM scored WHERE construct IS NOT NULL AND item_score IS NOT NULL GROUP BY 1", "scored"))
def _(spark, sf):
    fits = irt.grm_fits(sc.likert_matrices(t.scored(spark, sf), t.SURVEYS))
    p = irt.graded_params(spark, fits)
    rising = F.forall(F.sequence(F.lit(1), F.size("thresholds") - 1), lambda i: F.element_at("thresholds", i) < F.element_at("thresholds", i + 1))
    return p.groupBy("g").agg(F.count(F.lit(1)).alias("n_items"), F.bool_and("converged").alias("converged"), F.bool_and(rising).alias("ordered"))


@query("ability_eap_graded", sql("""WITH it AS (SELECT concat(base, ':', construct) AS g, user_id, question_id, round_even(avg(round_even(item_score, 0)), 0) AS x FROM scored WHERE construct IS NOT NULL AND item_score IS NOT NULL GROUP BY 1, 2, 3),
   ip AS (SELECT g, question_id, avg(x) - 4.0 AS t1, avg(x) - 2.5 AS t2, avg(x) - 1.0 AS t3 FROM it GROUP BY 1, 2), gr AS (SELECT -4 + 0.2 * i AS th, exp(-0.5 * (-4 + 0.2 * i) * (-4 + 0.2 * i)) AS w FROM range(0, 41) t(i)),
   lc AS (SELECT g, question_id, th, w, 1 / (1 + exp(-1.2 * (th - t1))) AS u1, 1 / (1 + exp(-1.2 * (th - t2))) AS u2, 1 / (1 + exp(-1.2 * (th - t3))) AS u3 FROM ip, gr),
   ll AS (SELECT it.g, user_id, th, w, sum(ln(greatest(1e-10, CASE x WHEN 1 THEN 1 - u1 WHEN 2 THEN u1 - u2 WHEN 3 THEN u2 - u3 ELSE u3 END))) AS l FROM it JOIN lc ON lc.g = it.g AND lc.question_id = it.question_id GROUP BY ALL),
   ea AS (SELECT g, user_id, sum(exp(l) * w * th) / sum(exp(l) * w) AS theta FROM ll GROUP BY 1, 2)
   SELECT ll.g, ll.user_id, round(theta, 6) AS theta, round(sqrt(sum(exp(l) * w * (th - theta) * (th - theta)) / sum(exp(l) * w)), 6) AS theta_se FROM ll JOIN ea ON ea.g = ll.g AND ea.user_id = ll.user_id GROUP BY 1, 2, theta""", "scored"))
def _(spark, sf):
    m = sc.likert_matrices(t.scored(spark, sf), t.SURVEYS)
    params = m.groupBy("g", F.col("question_id").alias("item_id")).agg(F.lit(1.2).alias("a"), F.array((F.avg("item_score") - 4.0), (F.avg("item_score") - 2.5), (F.avg("item_score") - 1.0)).alias("thresholds"))
    return rounded(irt.ability_eap_graded(m, params, ["g"]))


@query("cpi_quant_irt")
def _(spark, sf):
    m = matrix(spark, sf)
    fit = irt.rasch_fit(m)
    return rounded(ix.quant_irt(irt.ability_eap(m, fit.item_params(spark))), 3)


@query("cpi_quant_irt_closed_form", sql(f"WITH {BINARY}, {GRID} SELECT user_id, round(theta, 6) AS theta, round(se, 6) AS theta_se, round(round(1 / (1 + exp(-theta)), 10), 4) AS cpi_quant_irt FROM es", "scored"))
def _(spark, sf):
    """The index at item difficulties that have a closed form, so that SQL can say the same."""
    m = matrix(spark, sf)
    return rounded(ix.quant_irt(irt.ability_eap(m, logit_params(m))))


@query("item_difficulty_glmm")
def _(spark, sf):
    return rounded(irt.item_difficulty_glmm(matrix(spark, sf))[0], 3)


def centred(spark, sf):
    return sc.person_mean_center(rm_input(spark, sf).na.drop(subset=["engaged", "autonomy", "pct_correct"]), ["engaged", "autonomy"])


@query("mixed_model_blocks")
def _(spark, sf):
    return rounded(mx.mixed_model(centred(spark, sf), "pct_correct", ["engaged", "autonomy"], ["engaged", "autonomy"])["blocks"], 2)


@query("mixed_model_params")
def _(spark, sf):
    return rounded(mx.mixed_model(centred(spark, sf), "pct_correct", ["engaged", "autonomy"], ["engaged", "autonomy"], random_slope=False)["params"], 3)


@query("mixed_model_lrt")
def _(spark, sf):
    return rounded(mx.mixed_model(centred(spark, sf), "pct_correct", ["engaged", "autonomy"], ["engaged", "autonomy"], random_slope=False)["lrt"], 3)


@query(
    "mixed_model_vif",
    sql(f"""WITH {PERSON_MODULE}, el AS (SELECT * FROM pm WHERE user_id IN (SELECT user_id FROM pm GROUP BY 1 HAVING count(DISTINCT module_id) >= 2) AND engaged IS NOT NULL AND autonomy IS NOT NULL),
        c AS (SELECT engaged - avg(engaged) OVER w AS x1, avg(engaged) OVER w AS x2, module_num::DOUBLE AS x3 FROM el WINDOW w AS (PARTITION BY user_id)),
        r AS (SELECT corr(x1, x2) AS r12, corr(x1, x3) AS r13, corr(x2, x3) AS r23 FROM c), d AS (SELECT *, 1 + 2 * r12 * r13 * r23 - r12 * r12 - r13 * r13 - r23 * r23 AS det FROM r)
        SELECT unnest(['engaged_within', 'engaged_between', 'module_num']) AS term, unnest([round((1 - r23 * r23) / det, 6), round((1 - r13 * r13) / det, 6), round((1 - r12 * r12) / det, 6)]) AS vif FROM d""", "canon", "scored"),
)
def _(spark, sf):
    return rounded(mx.mixed_model(centred(spark, sf), "pct_correct", ["engaged"], ["engaged"], random_slope=False)["vif"])

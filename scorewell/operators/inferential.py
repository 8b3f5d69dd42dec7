"""Hypothesis tests as aggregations: sufficient statistics in Spark, one p-value call per result row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import clip, materialize, safe_corr
from ..functions.dist import p_value
from ..functions.numbers import d_label, eta_label, normal_quantile, w_label
from .ordered import cumulative_histogram, quantiles_of

ALPHA = 0.05
LOW_N_NORMALITY = 20  # fixed value
MAX_N_NORMALITY = 5000  # fixed value
LOW_N = 30  # fixed value
POSITIONS_PER_TASK_STEP = 100_000

# Royston (1995) weight corrections of the two extreme order statistics, low to high order.
_ROYSTON_C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_ROYSTON_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)

NORMAL = "Consistent with normality (p ≥ .05)"
NOT_NORMAL = "Deviates from normality (p < .05)"
EQUAL_VAR = "Consistent with equal variances (p ≥ .05)"
UNEQUAL_VAR = "Deviates from equal variances (p < .05)"


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


# -- normality ---------------------------------------------------------------------------------


def _order_scores(hist: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per group: sum of m², sum of m·x and the extreme values, m being expected normal scores.

    Every position 1..n is generated from the histogram in bounded steps, so even one value shared
    by a third of the rows is spread over many tasks.
    """
    end = F.col("n_before") + F.col("n")
    steps = hist.select(
        *by, value, "n_before", "n", "n_total",
        F.explode(F.sequence(F.col("n_before") + 1, end, F.lit(POSITIONS_PER_TASK_STEP).cast("bigint"))).alias("_start"),
    )
    stop = F.least(F.col("_start") + POSITIONS_PER_TASK_STEP - 1, F.col("n_before") + F.col("n"))
    positions = steps.select(*by, value, "n_total", F.explode(F.sequence(F.col("_start"), stop)).alias("i"))
    m = normal_quantile((F.col("i") - 0.375) / (F.col("n_total") + 0.25))
    scored = positions.withColumn("_m", m)

    def at(i: Column) -> Column:
        return F.max(F.when(F.col("i") == i, F.col(value)))

    return scored.groupBy(*by).agg(
        F.sum(F.col("_m") * F.col("_m")).alias("_mm"),
        F.sum(F.col("_m") * F.col(value)).alias("_mx"),
        at(F.lit(1)).alias("_x1"),
        at(F.lit(2)).alias("_x2"),
        at(F.col("n_total") - 1).alias("_xp"),
        at(F.col("n_total")).alias("_xn"),
    )


@F.pandas_udf(_doubles("w", "p"))
def _shapiro_wilk(
    n: pd.Series, ss: pd.Series, mm: pd.Series, mx: pd.Series, x1: pd.Series, x2: pd.Series, xp: pd.Series, xn: pd.Series
) -> pd.DataFrame:
    """W and p per group from the order-score sums, with Royston's corrected end weights."""
    from ..functions.dist import norm_ppf, shapiro_p

    def poly(cs, v):
        return sum(c * v**i for i, c in enumerate(cs))

    rows = []
    for n_, ss_, mm_, mx_, a_, b_, c_, d_ in zip(n, ss, mm, mx, x1, x2, xp, xn):
        if n_ < 3 or not ss_ > 0:
            rows.append((None, None))
            continue
        u, root = 1 / np.sqrt(n_), np.sqrt(mm_)
        m1, m2 = -norm_ppf(0.625 / (n_ + 0.25)), -norm_ppf(1.625 / (n_ + 0.25))
        outer, inner = d_ - a_, c_ - b_
        w1 = m1 / root + poly(_ROYSTON_C1, u)
        if n_ == 3:
            total = np.sqrt(0.5) * outer
        elif n_ <= 5:
            scale = np.sqrt((mm_ - 2 * m1**2) / (1 - 2 * w1**2))
            total = w1 * outer + (mx_ - m1 * outer) / scale
        else:
            w2 = m2 / root + poly(_ROYSTON_C2, u)
            scale = np.sqrt((mm_ - 2 * m1**2 - 2 * m2**2) / (1 - 2 * w1**2 - 2 * w2**2))
            total = w1 * outer + w2 * inner + (mx_ - m1 * outer - m2 * inner) / scale
        w = min(1.0, total**2 / ss_)
        rows.append((w, shapiro_p(w, n_)))
    return pd.DataFrame(rows, columns=["w", "p"])


def normality(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Shapiro-Wilk W and p, population skewness and excess kurtosis, verdict, per group.

    ``large_n_warning`` marks groups above 5,000 values, where the p-value's approximation was not fitted and the test rejects
    for deviations that do not matter.
    """
    by = list(by)
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    for k in by:
        clean = clean.filter(F.col(k).isNotNull())
    hist = cumulative_histogram(clean.select(*by, F.col(value).cast("double").alias(value)), by, value)
    # moments from the value histogram: weighted central moments in a second pass over it
    means = hist.groupBy(*by).agg(
        F.sum("n").alias("n"), (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("_mean"),
        F.min(value).alias("_lo"), F.max(value).alias("_hi"),
    )
    wide = hist.drop("n_before", "n_total").withColumnRenamed("n", "_w")
    joined = wide.join(means, by) if by else wide.join(F.broadcast(means))
    dev = F.col(value) - F.col("_mean")
    moments = joined.groupBy(*by, "n", "_mean", "_lo", "_hi").agg(
        *[F.sum(F.col("_w") * F.pow(dev, F.lit(p))).alias(f"_s{p}") for p in (2, 3, 4)]
    )
    orders = _order_scores(hist, by, value)
    out = moments.join(orders, by, "left") if by else moments.join(F.broadcast(orders), how="left")
    n = F.col("n")
    flat = (F.col("_hi") - F.col("_lo")) <= 1e-8 + 1e-5 * F.abs(F.col("_lo"))
    tested = (n >= 3) & ~flat
    var = F.col("_s2") / n
    sw = _shapiro_wilk(n, F.when(tested, F.col("_s2")), *[F.col(c) for c in ("_mm", "_mx", "_x1", "_x2", "_xp", "_xn")])
    out = out.withColumn("_sw", sw).withColumn("statistic", F.when(tested, F.col("_sw.w")))
    out = out.withColumn("p_value", F.when(tested, F.col("_sw.p")))
    low = n < LOW_N_NORMALITY
    verdict = (
        F.when(n < 3, "Not tested (n<3)")
        .when(flat, "Not tested (no variance)")
        .otherwise(
            F.concat(
                F.when(F.col("p_value") >= 0.05, NORMAL).otherwise(NOT_NORMAL),
                F.when(low, " -- exploratory, n<20").otherwise(""),
            )
        )
    )
    error = F.when(n < 3, "too few values").when(flat, "all values identical")
    return out.select(
        *by, "n", "statistic", "p_value",
        F.when(tested, (F.col("_s3") / n) / F.pow(var, F.lit(1.5))).alias("skewness"),
        F.when(tested, (F.col("_s4") / n) / (var * var) - 3).alias("kurtosis"),
        verdict.alias("verdict"), (tested & low).alias("low_n_warning"), (tested & (n > MAX_N_NORMALITY)).alias("large_n_warning"), error.alias("error"),
    )


def recommend_test(verdict: Column, paired: bool = False, n_groups: int | Column = 2, repeated: bool = False) -> Column:
    """The test that fits a normality verdict and a design."""
    normal = F.coalesce(verdict.startswith("Consistent with normality"), F.lit(False))
    if repeated:
        return F.when(normal, "RM-ANOVA").otherwise("Friedman test")
    if paired:
        return F.when(normal, "Paired t-test").otherwise("Wilcoxon signed-rank")
    many = (n_groups if isinstance(n_groups, Column) else F.lit(n_groups)) > 2
    return (
        F.when(many & normal, "One-way ANOVA")
        .when(many, "Kruskal-Wallis")
        .when(normal, "Independent t-test")
        .otherwise("Mann-Whitney U")
    )


# -- variances ---------------------------------------------------------------------------------


def levene(df: DataFrame, value: str, group: str, by: Sequence[str] = (), center: str = "median", trim: float = 0.05) -> DataFrame:
    """Levene's test per ``by``; centres: median (Brown-Forsythe), mean, or trimmed.

    Works on the value histogram with its counts as weights.
    """
    by = list(by)
    keys = [*by, group]
    clean = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    clean = clean.select(*keys, F.col(value).cast("double").alias(value))
    full = cumulative_histogram(clean, keys, value)
    hist = full.withColumn("w", F.col("n"))
    if center == "trimmed":
        cut = F.floor(F.lit(trim) * F.col("n_total"))
        kept = F.least(F.col("n_before") + F.col("n"), F.col("n_total") - cut) - F.greatest(F.col("n_before"), cut)
        hist = hist.withColumn("w", F.greatest(F.lit(0), kept)).filter(F.col("w") > 0)
    wmean = (F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias("_c")
    if center == "median":
        middle = quantiles_of(full, keys, value, {"_c": 0.5})
    else:
        middle = hist.groupBy(*keys).agg(wmean)
    w, v = F.col("n"), F.col(value)
    shifted = full.join(full.groupBy(*keys).agg((F.sum(v * w) / F.sum(w)).alias("_mu")), keys)
    raw = shifted.groupBy(*keys).agg(
        F.sum(w).alias("n_raw"), F.try_divide(F.sum(w * (v - F.col("_mu")) ** 2), F.sum(w) - 1).alias("variance")
    )
    dev = hist.join(middle, keys).withColumn("_z", F.abs(F.col(value) - F.col("_c")))
    per_group = dev.groupBy(*keys).agg(
        F.sum("w").alias("n_g"), F.sum(F.col("w") * F.col("_z")).alias("sz"), F.sum(F.col("w") * F.col("_z") ** 2).alias("szz")
    ).join(raw, keys)
    total = per_group.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("n_g").alias("_n"),
        F.min("n_raw").alias("min_n"),
        F.sum(F.col("sz") * F.col("sz") / F.col("n_g")).alias("_between"),
        F.sum("sz").alias("_sz"),
        F.sum("szz").alias("_szz"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(group).cast("string"), "variance")))).alias("variances"),
    )
    k, n = F.col("n_groups"), F.col("_n")
    between = F.col("_between") - F.col("_sz") ** 2 / n
    within = F.col("_szz") - F.col("_between")
    tested = (k >= 2) & (F.col("min_n") >= 3)
    stat = F.when(tested & (within > 0), (between / (k - 1)) / (within / (n - k)))
    out = total.withColumn("statistic", stat)
    out = out.withColumn("p_value", p_value("f_sf", F.col("statistic"), k - 1, n - k))
    low = F.col("min_n") < LOW_N_NORMALITY
    verdict = (
        F.when(k < 2, "Not tested (fewer than 2 groups)")
        .when(F.col("min_n") < 3, "Not tested (n<3 in at least one group)")
        .otherwise(F.concat(F.when(F.col("p_value") >= 0.05, EQUAL_VAR).otherwise(UNEQUAL_VAR), F.when(low, " -- exploratory, n<20").otherwise("")))
    )
    return out.select(
        *by, "n_groups", F.col("_n").alias("n"), "min_n", "variances", "statistic", "p_value", verdict.alias("verdict"),
        (tested & low).alias("low_n_warning"),
    )


# -- paired ------------------------------------------------------------------------------------


def pair_scores(pre: DataFrame, post: DataFrame) -> DataFrame:
    """Users with both scores: ``user_id, pre, post``."""
    a = pre.select("user_id", F.col("score").alias("pre"))
    b = post.select("user_id", F.col("score").alias("post"))
    return a.join(b, "user_id").filter(F.col("pre").isNotNull() & F.col("post").isNotNull())


def signed_rank(diffs: DataFrame, diff: str = "diff", by: Sequence[str] = ()) -> DataFrame:
    """Wilcoxon signed-rank per ``by``: zero differences dropped, ties at mean ranks.

    Exact p for up to 50 untied differences without zeros, else the tie-corrected normal one.
    """
    by = list(by)
    d = F.col(diff)
    diffs = materialize(diffs.select(*by, diff), "differences")
    totals = diffs.groupBy(*by).agg(F.count(diff).alias("n"), F.count_if(d == 0).alias("n_zero"))
    nz = diffs.filter(d != 0).select(*by, F.abs(d).alias("_abs"), (d > 0).alias("_up"))
    hist = cumulative_histogram(nz, by, "_abs")
    ups = nz.filter("_up").groupBy(*by, "_abs").agg(F.count(F.lit(1)).alias("_n_up"))
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    up = F.coalesce("_n_up", F.lit(0))
    stats = hist.join(ups, [*by, "_abs"], "left").groupBy(*by).agg(
        F.sum("n").alias("n_used"),
        F.coalesce(F.sum(rank * up), F.lit(0.0)).alias("r_plus"),
        F.coalesce(F.sum(rank * (F.col("n") - up)), F.lit(0.0)).alias("r_minus"),
        F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("_ties"),
    )
    out = totals.join(stats, by, "left") if by else totals.join(F.broadcast(stats), how="left")
    m = F.col("n_used")
    low = F.least("r_plus", "r_minus")
    se = F.sqrt((m * (m + 1) * (2 * m + 1) - F.col("_ties") / 2) / 24)
    z = F.try_divide(low - m * (m + 1) / 4, se)
    exact = (m <= 50) & (F.col("_ties") == 0) & (F.col("n_zero") == 0)
    p = F.when(m.isNull() | (m == 0), F.lit(1.0)).when(
        exact, p_value("signed_rank_exact", F.when(exact, low), F.when(exact, m))
    ).otherwise(clip(2 * p_value("norm_sf", F.abs(z)), 0.0, 1.0))
    return out.select(
        *by, "n", F.coalesce("n_used", F.lit(0)).alias("n_used"), low.alias("statistic"), p.alias("p_value"),
        F.try_divide(F.col("r_plus") - F.col("r_minus"), F.col("r_plus") + F.col("r_minus")).alias("rank_biserial"),
        F.when(m > 0, F.when(exact, "exact").otherwise("normal")).alias("method"),
    )


PAIRED_PARTS = ("normality", "ranks", "power")


def paired_comparison(pairs: DataFrame, alpha: float = ALPHA, parts: Sequence[str] = PAIRED_PARTS) -> DataFrame:
    """Paired t-test, effect size, normality of the differences, Wilcoxon, power: one row.

    ``parts`` beyond the t-test run only when named; a plain t-test is one aggregation and stores nothing.
    """
    stored = materialize(pairs, "pairs") if {"normality", "ranks"} & set(parts) else pairs
    df = stored.withColumn("diff", F.col("post") - F.col("pre"))
    base = df.agg(
        F.count("diff").alias("n_pairs"),
        F.avg("pre").alias("pre_mean"), F.stddev_samp("pre").alias("pre_std"),
        F.avg("post").alias("post_mean"), F.stddev_samp("post").alias("post_std"),
        F.avg("diff").alias("mean_diff"), F.stddev_samp("diff").alias("sd_diff"),
    )
    out = base
    if "normality" in parts:  # every part is a single row
        out = out.join(normality(df, "diff").select(
            F.col("statistic").alias("diff_shapiro_w"), F.col("p_value").alias("diff_shapiro_p"), F.col("verdict").alias("diff_verdict")
        ), how="left")
    if "ranks" in parts:
        out = out.join(signed_rank(df).select(F.col("statistic").alias("wilcoxon_stat"), F.col("p_value").alias("wilcoxon_p")), how="left")
    n, sd = F.col("n_pairs"), F.col("sd_diff")
    out = out.withColumn("t_stat", F.when(sd > 0, F.col("mean_diff") / (sd / F.sqrt(n))))
    out = out.withColumn("t_p_value", p_value("t_two_sided", F.col("t_stat"), n - 1))
    out = out.withColumn("cohens_d", F.when(sd > 0, F.col("mean_diff") / sd).otherwise(F.lit(0.0)))
    d = F.col("cohens_d")
    out = out.withColumn("significant", F.col("t_p_value") < alpha).withColumn("effect_size_label", d_label(d))
    if "normality" in parts:
        out = out.withColumn("recommended_test", recommend_test(F.col("diff_verdict"), paired=True))
    if "power" in parts:
        out = (
            out.withColumn("power_achieved", p_value("paired_power", n, d, alpha))
            .withColumn("n_needed_80", p_value("paired_n_needed", d, 0.80, alpha).cast("int"))
            .withColumn("n_needed_95", p_value("paired_n_needed", d, 0.95, alpha).cast("int"))
        )
    return out.withColumn("low_n_warning", n < LOW_N).withColumn("error", F.when(n < 2, "fewer than 2 pairs"))


def bland_altman(pairs: DataFrame) -> DataFrame:
    """Bias, limits of agreement at two standard deviations, and proportional bias: one row."""
    df = pairs.select((F.col("post") - F.col("pre")).alias("d"), ((F.col("pre") + F.col("post")) / 2).alias("m"))
    out = df.agg(
        F.count("d").alias("n_pairs"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd_diff"), safe_corr(F.col("d"), F.col("m")).alias("_r")
    )
    n = F.col("n_pairs")
    out = out.withColumn("proportional_bias_r", F.when(n >= 3, F.col("_r")))
    r = F.col("proportional_bias_r")
    out = out.withColumn("proportional_bias_p", p_value("t_two_sided", r * F.sqrt(F.try_divide(n - 2, 1 - r * r)), n - 2))
    return out.select(
        "n_pairs", "mean_diff", "sd_diff",
        (F.col("mean_diff") - 2 * F.col("sd_diff")).alias("loa_lower"),
        (F.col("mean_diff") + 2 * F.col("sd_diff")).alias("loa_upper"),
        "proportional_bias_r", "proportional_bias_p",
        F.coalesce(F.col("proportional_bias_p") < 0.05, F.lit(False)).alias("proportional_bias"),
        (n < LOW_N).alias("low_n_warning"),
    )


def bland_altman_points(pairs: DataFrame) -> DataFrame:
    """One point per pair, two decimals (half to even)."""
    d, m = F.col("post") - F.col("pre"), (F.col("pre") + F.col("post")) / 2
    return pairs.select(
        "user_id", F.bround("pre", 2).alias("pre"), F.bround("post", 2).alias("post"),
        F.bround(d, 2).alias("diff"), F.bround(m, 2).alias("mean_val"),
    )


# -- independent groups ------------------------------------------------------------------------


BETWEEN_PARTS = ("checks", "power")


def between_groups(scores: DataFrame, group: str, alpha: float = ALPHA, parts: Sequence[str] = BETWEEN_PARTS) -> DataFrame:
    """One-way ANOVA, Kruskal-Wallis, and for two groups t, Welch, Mann-Whitney: one row.

    ``scores`` has ``user_id, score`` and the group column. ``checks`` (normality per group, Levene, the recommended test) and
    ``power`` run only when named in ``parts``.
    """
    checks = "checks" in parts
    df = materialize(
        scores.filter(F.col("score").isNotNull() & F.col(group).isNotNull()).select(
            F.col(group).cast("string").alias("g"), F.col("score").cast("double").alias("score")
        ),
        "scores",
    )  # one row per user, read by every test below
    stats = df.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.coalesce(F.var_samp("score"), F.lit(0.0)).alias("var")
    )
    ranked = cumulative_histogram(df, [], "score").select(
        "score", (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank"), F.col("n").alias("ties")
    )
    rank_sums = df.groupBy("g", "score").agg(F.count(F.lit(1)).alias("c")).join(ranked, "score").groupBy("g").agg(
        F.sum(F.col("c") * F.col("rank")).alias("rank_sum")
    )
    ties = ranked.agg(F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("tie_sum"))
    per_group = stats.join(rank_sums, "g")
    if checks:
        norm = normality(df, "score", ["g"]).select(
            "g", F.coalesce(F.col("verdict").startswith("Consistent with normality"), F.lit(False)).alias("normal")
        )
        per_group = per_group.join(norm, "g")
    entry = F.struct("g", "n", "mean", F.sqrt("var").alias("sd"), "rank_sum", "var")
    total = per_group.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("n").alias("n_total"),
        F.min("n").alias("min_n"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand_mean"),
        F.sum(F.col("n") * F.col("mean") ** 2).alias("_nmm"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("ss_within"),
        F.sum(F.col("rank_sum") ** 2 / F.col("n")).alias("_rr"),
        *([F.min("normal").alias("all_normal")] if checks else []),
        F.sort_array(F.collect_list(entry)).alias("groups"),
    )
    out = total.join(ties, how="left")
    if checks:
        lev = levene(df, "score", "g").select(
            F.col("statistic").alias("levene_stat"), F.col("p_value").alias("levene_p"), F.col("verdict").alias("levene_verdict")
        )
        out = out.join(lev, how="left")
    k, n = F.col("n_groups"), F.col("n_total")
    ok = k >= 2
    between = F.col("_nmm") - n * F.col("grand_mean") ** 2
    out = out.withColumn("f_stat", F.when(ok & (F.col("ss_within") > 0), F.try_divide(between / (k - 1), F.try_divide(F.col("ss_within"), n - k))))
    out = out.withColumn("anova_p", p_value("f_sf", F.col("f_stat"), k - 1, n - k))
    out = out.withColumn(
        "eta_squared", F.when(between + F.col("ss_within") > 0, between / (between + F.col("ss_within"))).otherwise(F.lit(0.0))
    )
    h = 12 / (n * (n + 1)) * F.col("_rr") - 3 * (n + 1)
    nn = n.cast("double")
    out = out.withColumn("kruskal_stat", F.when(ok, F.try_divide(h, 1 - F.try_divide(F.col("tie_sum"), nn * nn * nn - nn))))
    out = out.withColumn("kruskal_p", p_value("chi2_sf", F.col("kruskal_stat"), k - 1))
    out = _two_group_tests(out)
    eta = F.col("eta_squared")
    out = (
        out.withColumn("effect_size_label", eta_label(eta))
        .withColumn("significant", F.when(k == 2, F.col("t_p_value") < alpha).otherwise(F.col("anova_p") < alpha))
        .withColumn("low_n_warning", F.col("min_n") < LOW_N)
        .withColumn("error", F.when(~ok, "need at least 2 groups with data"))
        .drop("_nmm", "_rr", "groups", "tie_sum")
    )
    if "power" in parts:
        out = out.withColumn("power_achieved", p_value("oneway_power", F.bround(n / k), k, eta, alpha)).withColumn(
            "n_needed_80", p_value("oneway_n_needed", k, eta, 0.80, alpha).cast("int")
        )
    if not checks:
        return out
    verdict = F.when(F.col("all_normal"), NORMAL).otherwise(NOT_NORMAL)
    unequal = ~F.coalesce(F.col("levene_verdict").startswith("Consistent with equal variances"), F.lit(True)) & ~F.coalesce(
        F.col("levene_verdict").startswith("Not tested"), F.lit(True)
    )
    rec = (
        F.when(unequal & (k == 2), "Welch's t-test")
        .when(unequal, "Kruskal-Wallis")
        .otherwise(recommend_test(verdict, n_groups=k))
    )
    return out.withColumn("normality_verdict", verdict).withColumn("recommended_test", rec).drop("all_normal")


def _two_group_tests(out: DataFrame) -> DataFrame:
    two = F.col("n_groups") == 2
    a, b = F.try_element_at("groups", F.lit(1)), F.try_element_at("groups", F.lit(2))
    na, nb = a["n"].cast("double"), b["n"].cast("double")
    pooled_var = F.try_divide((na - 1) * a["var"] + (nb - 1) * b["var"], na + nb - 2)
    gap = a["mean"] - b["mean"]
    sa, sb = a["var"] / na, b["var"] / nb
    welch_df = F.try_divide((sa + sb) ** 2, F.try_divide(sa**2, na - 1) + F.try_divide(sb**2, nb - 1))
    u = a["rank_sum"] - na * (na + 1) / 2
    total = na + nb
    sigma = F.sqrt(na * nb / 12 * (total + 1 - F.try_divide(F.col("tie_sum"), total * (total - 1))))
    top = F.greatest(u, na * nb - u)
    exact = two & (F.least(na, nb) <= 8) & (F.col("tie_sum") == 0)
    asymptotic = clip(2 * p_value("norm_sf", F.when(two, F.try_divide(top - na * nb / 2 - 0.5, sigma))), 0.0, 1.0)
    return (
        out.withColumn("t_stat", F.when(two & (pooled_var > 0), gap / F.sqrt(pooled_var * (1 / na + 1 / nb))))
        .withColumn("t_p_value", p_value("t_two_sided", F.col("t_stat"), na + nb - 2))
        .withColumn("welch_t_stat", F.when(two & (sa + sb > 0), gap / F.sqrt(sa + sb)))
        .withColumn("welch_t_p", p_value("t_two_sided", F.col("welch_t_stat"), welch_df))
        .withColumn("mannwhitney_stat", F.when(two, u))
        .withColumn(
            "mannwhitney_p",
            F.when(exact, p_value("rank_sum_exact", F.when(exact, top), F.when(exact, na), F.when(exact, nb))).otherwise(asymptotic),
        )
        .withColumn("cohens_d_indep", F.when(two, F.when(pooled_var > 0, gap / F.sqrt(pooled_var)).otherwise(F.lit(0.0))))
    )


def group_statistics(scores: DataFrame, group: str) -> DataFrame:
    """Per group: n, mean, sd (0 for a single value)."""
    df = scores.filter(F.col("score").isNotNull() & F.col(group).isNotNull())
    return df.groupBy(F.col(group).cast("string").alias("group")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sd")
    )


# -- repeated measures -------------------------------------------------------------------------


def occasions_of(long: DataFrame, occasion: str, limit: int = 1000) -> list[str]:
    """The occasions present, ordered by their number. More than ``limit`` is a design error."""
    found = [r[0] for r in long.filter(F.col("score").isNotNull()).select(occasion).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{occasion} has more than {limit} values; it is not an occasion column")
    import re

    number = lambda s: int(m.group(1)) if (m := re.search(r"(\d+)", str(s))) else 0
    return sorted(found, key=lambda s: (number(s), str(s)))


def occasion_vectors(long: DataFrame, occasion: str, occasions: Sequence[str], unit: str = "user_id") -> DataFrame:
    """Complete cases as one array of scores per unit, in occasion order."""
    wide = long.groupBy(unit).agg(*[F.max(F.when(F.col(occasion) == o, F.col("score"))).alias(f"_o{i}") for i, o in enumerate(occasions)])
    names = [f"_o{i}" for i in range(len(occasions))]
    return wide.na.drop(subset=names).select(unit, F.array(*[F.col(c).cast("double") for c in names]).alias("x"))


def occasion_statistics(vectors: DataFrame, occasions: Sequence[str]) -> DataFrame:
    labels = F.array(*[F.lit(str(o)) for o in occasions])
    long = vectors.select(F.posexplode("x").alias("i", "v"))
    return long.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd")).select(
        F.element_at(labels, F.col("i") + 1).alias("occasion"), "n", "mean", "sd"
    )


@F.pandas_udf(_doubles("eps", "w", "p"))
def _sphericity(cov: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Greenhouse-Geisser epsilon and Mauchly's W with p, from k x k covariances (row-major)."""
    from ..functions.dist import chi2_sf

    rows = []
    for flat, size in zip(cov, n):
        k = int(round(np.sqrt(len(flat))))
        s = np.array([np.nan if v is None else v for v in flat], dtype=float).reshape(k, k)
        if size < 2 or not np.isfinite(s).all():
            rows.append((None, None, None))
            continue
        centred = s - s.mean(0)[None, :] - s.mean(1)[:, None] + s.mean()
        trace = np.trace(centred)
        eps = min(1.0, trace**2 / ((k - 1) * (centred**2).sum())) if trace > 0 else np.nan
        eig = np.linalg.eigvalsh(centred)[1:]
        eig = eig[eig > 1e-3]
        d = len(eig)
        w = float(np.exp(np.log(eig).sum() - d * np.log(eig.sum() / d))) if d else np.nan
        p = np.nan
        if d and size > 1 and k > 2:
            f = 1 - (2 * d * d + d + 2) / (6 * d * (size - 1))
            w2 = (d + 2) * (d - 1) * (d - 2) * (2 * d**3 + 6 * d * d + 3 * d + 2) / (288 * ((size - 1) * d * f) ** 2)
            chi, dof = -(size - 1) * f * np.log(w), 0.5 * d * (d + 1) - 1
            p1, p2 = chi2_sf(chi, dof), chi2_sf(chi, dof + 4)
            p = p1 + w2 * (p2 - p1)
        rows.append((eps, w, p))
    return pd.DataFrame(rows, columns=["eps", "w", "p"])


def repeated_measures(vectors: DataFrame, occasions: Sequence[str], alpha: float = ALPHA) -> DataFrame:
    """Friedman test with Kendall's W, RM-ANOVA with sphericity correction, recommendation: one row.

    ``vectors`` comes from ``occasion_vectors``: the ranks of a unit and its sums are computed inside
    its own row, so the whole test is one aggregation over units.
    """
    k = len(occasions)
    vectors = materialize(vectors, "vectors")
    if k < 3:
        note = (
            "exactly 2 time points: use the paired comparison" if k == 2 else "need at least 2 time points"
        )
        return vectors.limit(0).groupBy().agg(F.count(F.lit(1)).alias("n_subjects")).withColumn("error", F.lit(note))
    x = F.col("x")

    def rank(v: Column) -> Column:
        below = F.size(F.filter(x, lambda o: o < v))
        same = F.size(F.filter(x, lambda o: o == v))
        return below + (same + 1) / 2

    ranks = F.transform(x, rank)
    # sum of t^3 - t over tie blocks: each of the t members of a block contributes t^2 - 1
    tie = F.aggregate(
        F.transform(x, lambda v: F.size(F.filter(x, lambda o: o == v))), F.lit(0.0), lambda acc, t: acc + t * t - 1
    )
    total = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    rows = vectors.select("x", ranks.alias("r"), tie.alias("tie"), total.alias("s"))
    cols = [F.element_at("x", i + 1) for i in range(k)]
    agg = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("tie").alias("ties"),
        F.array(*[F.sum(F.element_at("r", i + 1)) for i in range(k)]).alias("rank_sums"),
        F.array(*[F.avg(c) for c in cols]).alias("means"),
        F.var_pop("s").alias("var_s"),
        F.array(*[F.covar_samp(cols[i], cols[j]) for i in range(k) for j in range(k)]).alias("cov"),
        F.array(*[F.var_pop(c) for c in cols]).alias("vars"),
    )
    n = F.col("n").cast("double")
    sum_of = lambda arr, fn: F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + fn(v))
    rr = sum_of(F.col("rank_sums"), lambda v: v * v)
    tie_factor = 1 - F.try_divide(F.col("ties"), n * k * (k * k - 1))
    friedman = F.try_divide(F.try_divide(12 * rr, n * k * (k + 1)) - 3 * n * (k + 1), tie_factor)
    mean_rank = n * (k + 1) / 2
    kendall = F.try_divide(12 * sum_of(F.col("rank_sums"), lambda v: (v - mean_rank) * (v - mean_rank)), n * n * (k**3 - k))
    grand = sum_of(F.col("means"), lambda v: v) / k
    out = agg.withColumn("friedman_stat", friedman).withColumn("kendalls_w", clip(kendall, 0.0, 1.0))
    out = out.withColumn("p_value", p_value("chi2_sf", F.col("friedman_stat"), float(k - 1)))
    out = out.withColumn("grand", grand)
    out = out.withColumn("ss_time", n * sum_of(F.col("means"), lambda v: (v - F.col("grand")) * (v - F.col("grand"))))
    out = out.withColumn("ss_subject", n * F.col("var_s") / k)
    out = out.withColumn("ss_within", n * sum_of(F.col("vars"), lambda v: v))
    out = out.withColumn("ss_error", F.col("ss_within") - F.col("ss_subject"))
    df1, df2 = float(k - 1), (k - 1) * (n - 1)
    out = out.withColumn("rm_f", F.when(F.col("ss_error") > 0, F.try_divide(F.col("ss_time") / df1, F.try_divide(F.col("ss_error"), df2))))
    out = out.withColumn("rm_p_unc", p_value("f_sf", F.col("rm_f"), F.lit(df1), df2))
    out = out.withColumn("_sph", _sphericity(F.col("cov"), n))
    eps = F.col("_sph.eps")
    out = out.withColumn("rm_p_gg", p_value("f_sf", F.col("rm_f"), eps * df1, eps * df2))
    long = vectors.select(F.posexplode("x").alias("occ", "v"))
    norm = normality(long, "v", ["occ"]).agg(
        F.min(F.coalesce(F.col("verdict").startswith("Consistent with normality"), F.lit(False))).alias("all_normal")
    )
    out = out.join(norm, how="left")
    verdict = F.when(F.col("all_normal"), NORMAL).otherwise(NOT_NORMAL)
    primary = F.when(F.col("all_normal"), F.coalesce("rm_p_gg", "rm_p_unc")).otherwise(F.col("p_value"))
    return out.select(
        F.col("n").alias("n_subjects"), F.lit(k).alias("n_occasions"), "friedman_stat", "p_value",
        (F.col("p_value") < alpha).alias("significant"), "kendalls_w", w_label(F.col("kendalls_w")).alias("effect_size_label"),
        "ss_time", "ss_subject", "ss_error", "rm_f", "rm_p_unc", "rm_p_gg", eps.alias("eps"),
        F.try_divide(F.col("ss_time"), F.col("ss_time") + F.col("ss_within")).alias("eta_sq_gen"),
        F.col("_sph.w").alias("w_spher"), F.col("_sph.p").alias("p_spher"), (F.col("_sph.p") > alpha).alias("sphericity"),
        verdict.alias("normality_verdict"), recommend_test(verdict, repeated=True).alias("recommended_test"),
        primary.alias("primary_p"), (primary < alpha).alias("run_posthoc"),
        (F.col("n") < LOW_N).alias("low_n_warning"), F.when(F.col("n") < 2, "fewer than 2 complete cases").alias("error"),
    )


def posthoc_pairs(vectors: DataFrame, occasions: Sequence[str], test: str = "paired_t", alpha: float = ALPHA) -> DataFrame:
    """All occasion pairs with Bonferroni correction; differences rounded to nine decimals.

    The pair list is the design's k(k-1)/2 literals, attached to each unit's own row.
    """
    k = len(occasions)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    diff = lambda i, j: F.bround(F.element_at("x", j + 1) - F.element_at("x", i + 1), 9)
    entries = F.array(*[F.struct(F.lit(str(occasions[i])).alias("time_a"), F.lit(str(occasions[j])).alias("time_b"), diff(i, j).alias("diff")) for i, j in pairs])
    long = vectors.select(F.explode(entries).alias("e")).select("e.*")
    keys = ["time_a", "time_b"]
    if test == "paired_t":
        out = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("_m"), F.coalesce(F.stddev_samp("diff"), F.lit(0.0)).alias("_sd"))
        varies = F.col("_sd") > 0
        out = out.withColumn("statistic", F.when(varies, F.col("_m") / (F.col("_sd") / F.sqrt("n"))))
        p = F.when(varies, p_value("t_two_sided", F.col("statistic"), F.col("n") - 1)).when(F.col("_m") == 0, 1.0).otherwise(0.0)
        out = out.withColumn("p_raw", p).withColumn("effect_size", F.when(varies, F.col("_m") / F.col("_sd")))
    else:
        out = signed_rank(long, "diff", keys).withColumnRenamed("p_value", "p_raw").withColumnRenamed("rank_biserial", "effect_size")
    adjusted = clip(F.col("p_raw") * len(pairs), 0.0, 1.0)
    return out.select(
        *keys, "n", "statistic", "p_raw", "effect_size", adjusted.alias("p_adj"), (adjusted < alpha).alias("significant")
    )

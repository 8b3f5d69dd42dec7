"""Reliability, classical item analysis, correlations between constructs, repeated-measures correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import clip, config_frame, first_row, materialize, safe_corr
from ..functions import numbers as nb
from ..functions.dist import p_value
from ..functions.text import matches_base, natural_key, normalize_choice
from .ordered import average_rank, ordinal_rank
from .scores import binary_items, construct_means

# Review thresholds.
P_HARD, P_EASY, R_WEAK = 0.20, 0.90, 0.20
NONFUNCTIONING_SHARE, BELOW_CHANCE_ALPHA, MIN_N_FOR_R = 0.05, 0.01, 10
LOW_N = 30


# -- reliability -------------------------------------------------------------------------------


def _scale_statistics(long: DataFrame, by: Sequence[str], pop: bool = False) -> DataFrame:
    """Per scale: items, subjects, complete cases, sum of item variances, variance of the total.

    ``long`` has the ``by`` columns, ``user_id, question_id, item_score`` with one row per cell.
    """
    by = list(by)
    long = materialize(long.select(*by, "user_id", "question_id", "item_score"), "cells")
    var = F.var_pop if pop else F.var_samp
    sizes = long.groupBy(*by).agg(F.count_distinct("question_id").alias("n_items"), F.count_distinct("user_id").alias("n_subjects"))
    users = long.groupBy(*by, "user_id").agg(F.count(F.lit(1)).alias("_k"), F.sum("item_score").alias("_total"))
    complete = (users.join(sizes, by) if by else users.join(F.broadcast(sizes))).filter(F.col("_k") == F.col("n_items"))
    totals = complete.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_complete"), var("_total").alias("var_total"),
        F.avg("_total").alias("mean_total"), F.stddev_samp("_total").alias("sd_total"),
    )
    items = long.join(complete.select(*by, "user_id"), [*by, "user_id"], "left_semi").groupBy(*by, "question_id").agg(
        var("item_score").alias("v"), F.avg("item_score").alias("p")
    )
    sums = items.groupBy(*by).agg(
        F.sum("v").alias("sum_var"), F.product(F.col("v")).alias("prod_var"), F.sum(F.col("p") * (1 - F.col("p"))).alias("sum_pq")
    )
    out = sizes
    for side in (totals, sums):
        out = out.join(side, by, "left") if by else out.join(F.broadcast(side), how="left")
    return out


def _alpha(k: Column, item_var: Column, total_var: Column) -> Column:
    return F.when((k >= 2) & (total_var > 0), k / (k - 1) * (1 - item_var / total_var))


def reliability(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cronbach's alpha with its F interval (3+ items), Spearman-Brown (2), else the reason why not."""
    s = _scale_statistics(long, by)
    k, n = F.col("n_items"), F.coalesce("n_complete", F.lit(0))
    method = (
        F.when(k == 1, "single_item_no_reliability").when(n < 3, "not_tested").when(k == 2, "spearman_brown").otherwise("cronbach_alpha")
    )
    out = s.withColumn("method", method)
    m = F.col("method")
    # two items: their covariance is half of what the total's variance has beyond the item variances
    r = F.try_divide((F.col("var_total") - F.col("sum_var")) / 2, F.sqrt("prod_var"))
    alpha = _alpha(k, F.col("sum_var"), F.col("var_total"))
    out = out.withColumn("value", F.when(m == "spearman_brown", nb.spearman_brown(r)).when(m == "cronbach_alpha", alpha))
    v = F.col("value")
    is_alpha = m == "cronbach_alpha"
    df1, df2 = F.when(is_alpha, n - 1), F.when(is_alpha, (n - 1) * (k - 1))
    return out.select(
        *by, "n_items", "n_subjects", n.alias("n_complete"), "method", "value",
        (1 - (1 - v) * p_value("f_ppf", F.when(is_alpha, F.lit(0.975)), df1, df2)).alias("ci_low"),
        (1 - (1 - v) * p_value("f_ppf", F.when(is_alpha, F.lit(0.025)), df1, df2)).alias("ci_high"),
        F.when(m == "spearman_brown", nb.spearman_brown_badge(v)).when(is_alpha, nb.alpha_badge(v)).otherwise("—").alias("badge"),
        (F.col("n_subjects") < LOW_N).alias("low_n_warning"),
        F.when(k == 1, "single item: not estimable").when(n < 3, "too few complete cases").alias("error"),
    )


def _survey_cells(canonical: DataFrame, base: str, label: str) -> DataFrame:
    """Mean item score per (label, user, question) over modules."""
    return canonical.groupBy(label, "user_id", "question_id").agg(F.avg("item_score").alias("item_score"))


def construct_reliability(canonical: DataFrame, base: str) -> DataFrame:
    df = canonical.filter(
        matches_base(F.col("instrument_key"), base) & (F.col("construct") != "") & F.col("item_score").isNotNull()
    )
    return reliability(_survey_cells(df, base, "construct"), ["construct"])


def composite_reliability(canonical: DataFrame, base: str, composites: dict[str, Sequence[str]]) -> DataFrame:
    """Pooled reliability: all items of a composite's constructs as one scale."""
    rows = [(c, name) for name, parts in composites.items() for c in parts]
    df = canonical.filter(
        matches_base(F.col("instrument_key"), base) & (F.col("construct") != "") & F.col("item_score").isNotNull()
    ).join(config_frame(canonical.sparkSession, rows, "construct string, composite string"), "construct")
    parts = df.groupBy("composite").agg(F.count_distinct("construct").alias("n_subconstructs"))
    return reliability(_survey_cells(df, base, "composite"), ["composite"]).join(parts, "composite")


def cronbach_alpha(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Alpha on complete cases, sample variances, clipped to [-1, 1]."""
    s = _scale_statistics(long, by)
    a = _alpha(F.col("n_items"), F.col("sum_var"), F.col("var_total"))
    return s.select(*by, "n_items", "n_complete", clip(a, -1.0, 1.0).alias("alpha"))


def kr20(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """KR-20 on complete cases, population variances."""
    s = _scale_statistics(matrix, by, pop=True)
    value = F.when(F.col("n_complete") >= 2, _alpha(F.col("n_items"), F.col("sum_pq"), F.col("var_total")))
    return s.select(*by, "n_items", "n_complete", value.alias("kr20"))


def loading_report(items: DataFrame, slope: str | None = "a", by: Sequence[str] = ()) -> DataFrame:
    """Construct reliability, omega and average variance extracted from item slopes (1 for Rasch)."""
    lam = nb.irt_loading(F.col(slope) if slope else F.lit(1.0))
    s = items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_items"), F.sum(lam).alias("_l"), F.sum(1 - lam * lam).alias("_e"), F.avg(lam * lam).alias("ave")
    )
    cr = F.col("_l") ** 2 / (F.col("_l") ** 2 + F.col("_e"))
    out = s.withColumn("cr", F.when(F.col("_l") ** 2 + F.col("_e") > 0, cr))
    return out.select(
        *by, "n_items", "cr", F.col("cr").alias("omega"), "ave",
        nb.cr_badge(F.col("cr")).alias("cr_badge"), nb.ave_badge(F.col("ave")).alias("ave_badge"),
    )


def reliability_report(items: DataFrame, matrix: DataFrame, slope: str | None, label: str) -> DataFrame:
    """One row: loadings-based coefficients next to alpha of the raw responses."""
    a = cronbach_alpha(matrix).select(F.col("alpha").alias("cronbach_alpha"), F.col("n_complete").alias("n_persons"))
    out = loading_report(items, slope).join(a, how="left")
    return out.withColumn("alpha_badge", nb.alpha_badge(F.col("cronbach_alpha"))).withColumn("construct", F.lit(label))


# -- item analysis -----------------------------------------------------------------------------


def item_analysis(matrix: DataFrame, n_options: dict[str, int] | None = None) -> DataFrame:
    """Difficulty with Wilson interval, corrected item-rest correlation, KR-20 without the item, flag codes.

    ``matrix`` is long (``user_id, question_id, item_score`` in {0, 1}); correlations use persons who
    answered every item.
    """
    m = materialize(matrix.filter(F.col("item_score").isNotNull()), "matrix")
    per_item = m.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.sum("item_score").alias("successes"))
    users = m.groupBy("user_id").agg(F.count(F.lit(1)).alias("_k"), F.sum("item_score").alias("_total"))
    k_items = per_item.agg(F.count(F.lit(1)).alias("k"))
    complete = users.join(F.broadcast(k_items)).filter(F.col("_k") == F.col("k"))
    cells = m.join(complete.select("user_id", "_total", "k"), "user_id").withColumn("_rest", F.col("_total") - F.col("item_score"))
    stats = cells.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_complete"), F.max("k").alias("k"),
        F.var_pop("item_score").alias("_v"), F.var_pop("_rest").alias("_vr"),
        F.covar_pop("item_score", "_rest").alias("_c"),
    )
    sum_pq = stats.agg(F.sum("_v").alias("_pq"))  # p(1 - p) is the population variance of a 0/1 item
    out = per_item.join(stats.join(F.broadcast(sum_pq)), "question_id", "left")
    n, s, k, nc = F.col("n"), F.col("successes"), F.col("k"), F.col("n_complete")
    p = s / n
    enough = (nc >= MIN_N_FOR_R) & (k >= 2)
    r = F.when(enough & (F.col("_v") > 0) & (F.col("_vr") > 0), F.col("_c") / F.sqrt(F.col("_v") * F.col("_vr")))
    out = out.withColumn("p", p).withColumn("r_it", r)
    rest_alpha = F.when(
        enough & (k > 2) & (F.col("_vr") > 0), (k - 1) / (k - 2) * (1 - (F.col("_pq") - F.col("_v")) / F.col("_vr"))
    )
    options = F.lit(None).cast("int")
    for item, count in (n_options or {}).items():
        options = F.when(F.col("question_id") == item, F.lit(count)).otherwise(options)
    out = out.withColumn("chance", F.when(options >= 2, 1.0 / options))
    out = out.withColumn("p_below_chance", p_value("binom_cdf", F.when(F.col("chance").isNotNull(), F.round("successes")), n, F.col("chance")))
    flags = F.concat_ws(
        ",",
        F.when(p < P_HARD, "p_low").when(p > P_EASY, "p_high"),
        F.when(F.col("r_it") < 0, "r_negative").when(F.col("r_it") < R_WEAK, "r_low"),
        F.when(F.col("p_below_chance") < BELOW_CHANCE_ALPHA, "p_under_guessing"),
    )
    return out.select(
        F.col("question_id").alias("item"), "n", "p", nb.wilson_low(s, n).alias("p_ci_low"), nb.wilson_high(s, n).alias("p_ci_high"),
        "r_it", nb.fisher_bound(F.col("r_it"), nc, -1).alias("r_ci_low"), nb.fisher_bound(F.col("r_it"), nc, +1).alias("r_ci_high"),
        rest_alpha.alias("alpha_if_deleted"), "chance", "p_below_chance", flags.alias("flags"),
    )


def test_statistics(matrix: DataFrame) -> DataFrame:
    """Whole-test row: items, complete cases, mean and sd of the total, KR-20, standard error."""
    m = materialize(matrix.filter(F.col("item_score").isNotNull()), "matrix")
    s = _scale_statistics(m, [], pop=True)
    p = m.groupBy("question_id").agg(F.avg("item_score").alias("p")).agg(F.avg("p").alias("mean_item_p"))
    a = F.when(F.col("n_complete") >= 2, _alpha(F.col("n_items"), F.col("sum_pq"), F.col("var_total")))
    return s.join(F.broadcast(p), how="left").withColumn("kr20", a).select(
        F.col("n_items").alias("k_items"), F.col("n_subjects").alias("n_persons"), "n_complete", "mean_item_p", "mean_total", "sd_total", "kr20",
        (F.col("sd_total") * F.sqrt(clip(1 - F.col("kr20"), 0.0, 1e9))).alias("sem"),
        F.round(nb.proportion_half_width(F.col("n_subjects"))).alias("worst_half_width_pct"),
    )


def equal_count_bins(df: DataFrame, by: Sequence[str], value: str, tie: str, k: int, out: str = "bin") -> DataFrame:
    """Quantile bin 1..k of first-occurrence ranks (exact edges belong to the lower bin)."""
    ranked = ordinal_rank(df, by, value, tie, "_pos")
    r, n = F.col("_pos"), F.col("n_total")
    size = F.least(F.lit(k), n)
    cut = F.when(n > 1, F.ceil((r - 1) * size / (n - 1))).otherwise(F.lit(1))
    return ranked.withColumn(out, F.greatest(F.lit(1), cut).cast("int")).drop("_pos", "n_total")


def distractor_analysis(
    canonical: DataFrame, base: str, n_groups: int = 5, option_letters: dict[str, Sequence[str]] | None = None
) -> DataFrame:
    """Per (item, option): share, keyed flag, share in each rest-score group, point-biserial, flag codes.

    An option is the text before the first colon, or the whole answer; blank answers are left out. The key of an item is the
    most frequent option among right answers.
    """
    df = binary_items(canonical.filter(matches_base(F.col("instrument_key"), base))).withColumn(
        "letter", normalize_choice(F.col("response_value"))
    ).filter(F.col("letter") != "")
    order = [F.col("submitted_at"), F.col("instrument_key"), F.col("item_score")]
    cells = materialize(first_row(df, ["user_id", "question_id"], order, ["item_score", "letter"]), "cells")
    totals = cells.groupBy("user_id").agg(F.sum("item_score").alias("_total"))
    g = cells.join(totals, "user_id").withColumn("rest", F.col("_total") - F.col("item_score")).drop("_total")
    binned = equal_count_bins(g, ["question_id"], "rest", "user_id", n_groups)
    # everything below is on (item, letter[, group]) counts
    counts = binned.groupBy("question_id", "letter", "bin").agg(
        F.count(F.lit(1)).alias("c"), F.sum("item_score").alias("right"), F.sum("rest").alias("s"), F.sum(F.col("rest") ** 2).alias("ss")
    )
    bins = range(1, n_groups + 1)
    options = counts.groupBy("question_id", "letter").agg(
        F.sum("c").alias("cnt"), F.sum("right").alias("right"), F.sum("s").alias("s"), F.sum("ss").alias("ss"),
        *[F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("c"))), F.lit(0)).alias(f"c{b}") for b in bins],
    )
    items = options.groupBy("question_id").agg(
        F.sum("cnt").alias("n"),
        F.min(F.when(F.col("right") > 0, F.struct((-F.col("right")).alias("k"), F.col("letter").alias("l"))))["l"].alias("key"),
        *[F.sum(f"c{b}").alias(f"t{b}") for b in bins],
    )
    spark = canonical.sparkSession
    if option_letters:
        rows = [(q, l) for q, ls in option_letters.items() for l in ls]
        listed = config_frame(spark, rows, "question_id string, letter string").join(items.select("question_id"), "question_id", "left_semi")
        options = options.join(listed, ["question_id", "letter"], "full").na.fill(0)
    keyed = options.join(items, "question_id")
    key_row = keyed.filter(F.col("letter") == F.col("key")).select("question_id", F.col("cnt").alias("kc"), F.col("s").alias("ks"), F.col("ss").alias("kss"))
    full = keyed.join(key_row, "question_id", "left")
    both = F.col("cnt") + F.col("kc")
    mean = F.try_divide(F.col("s") + F.col("ks"), both)
    sd = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("ss") + F.col("kss"), both) - mean * mean))
    share_opt = F.try_divide(F.col("cnt"), both)
    # point-biserial from the two groups' sums
    r = F.try_divide((F.try_divide("s", "cnt") - F.try_divide("ks", "kc")) * F.sqrt(share_opt * (1 - share_opt)), sd)
    usable = (F.col("letter") != F.col("key")) & (both >= 5) & (F.col("cnt") > 0) & (F.col("kc") > 0) & (sd > 0)
    share = F.col("cnt") / F.col("n")
    out = full.withColumn("distractor_r", F.when(usable, r))
    not_key = F.coalesce(F.col("letter") != F.col("key"), F.lit(True))
    p_key = F.coalesce(F.col("kc") / F.col("n"), F.lit(0.0))
    flags = F.concat_ws(
        ",",
        F.when(not_key & (share < NONFUNCTIONING_SHARE) & ~(p_key > P_EASY), "share_low"),
        F.when(not_key & (F.col("distractor_r") > 0), "r_positive"),
    )
    return out.select(
        F.col("question_id").alias("item"), F.col("letter").alias("option"), (F.col("letter") == F.col("key")).alias("keyed"), "n",
        share.alias("share"), *[F.when(F.col(f"t{b}") > 0, F.col(f"c{b}") / F.col(f"t{b}")).alias(f"g{b}") for b in bins],
        "distractor_r", flags.alias("flags"),
    ).orderBy(natural_key(F.col("item")), "option")


# -- correlations ------------------------------------------------------------------------------


def trait_scores(canonical: DataFrame, base: str, surveys: Sequence[str]) -> DataFrame:
    """Per (user, construct): mean of the module-level construct means."""
    means = construct_means(canonical.filter(matches_base(F.col("instrument_key"), base)), surveys)
    return means.groupBy("user_id", "construct").agg(F.avg("mean_score").alias("value"))


def correlation_matrix(long: DataFrame, variables: Sequence[str], unit: str = "user_id", name: str = "construct", value: str = "value", method: str = "pearson") -> DataFrame:
    """Pairwise-complete correlations: ``a, b, r, n`` for every a < b.

    The variables become columns of one row per unit and all pairs are aggregates of one pass, so no
    pair rows are made. Spearman ranks within each pair's complete cases, as pairwise deletion asks.
    """
    wide = long.groupBy(unit).agg(*[F.max(F.when(F.col(name) == v, F.col(value))).alias(f"v{i}") for i, v in enumerate(variables)])
    pairs = [(i, j) for i in range(len(variables)) for j in range(i + 1, len(variables))]
    if method == "spearman":
        entries = F.array(*[
            F.struct(F.lit(variables[i]).alias("a"), F.lit(variables[j]).alias("b"), F.col(f"v{i}").alias("x"), F.col(f"v{j}").alias("y"))
            for i, j in pairs
        ])
        cells = wide.select(F.explode(entries).alias("e")).select("e.*").na.drop(subset=["x", "y"])
        ranked = average_rank(average_rank(cells, ["a", "b"], "x", "rx"), ["a", "b"], "y", "ry")
        return ranked.groupBy("a", "b").agg(safe_corr(F.col("rx"), F.col("ry")).alias("r"), F.count(F.lit(1)).alias("n"))
    both = lambda i, j: F.col(f"v{i}").isNotNull() & F.col(f"v{j}").isNotNull()
    row = wide.agg(*[
        F.struct(
            F.lit(variables[i]).alias("a"), F.lit(variables[j]).alias("b"),
            safe_corr(F.col(f"v{i}"), F.col(f"v{j}")).alias("r"), F.count_if(both(i, j)).alias("n"),
        ).alias(f"p{i}_{j}")
        for i, j in pairs
    ])
    return row.select(F.explode(F.array(*[F.col(f"p{i}_{j}") for i, j in pairs])).alias("p")).select("p.*")


def rm_corr(long: DataFrame, predictors: Sequence[str], outcome: str, unit: str = "user_id", alpha: float = 0.05) -> DataFrame:
    """Repeated-measures correlation per predictor, with Benjamini-Hochberg adjustment across them."""
    entries = F.array(*[F.struct(F.lit(p).alias("predictor"), F.col(p).cast("double").alias("x"), F.col(outcome).cast("double").alias("y")) for p in predictors])
    cells = long.select(unit, F.explode(entries).alias("e")).select(unit, "e.*").na.drop(subset=["x", "y"])
    # within-subject sums of squares from each subject's own sums: no centred copy of the data
    per_unit = cells.groupBy("predictor", unit).agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cxy")
    )
    s = per_unit.groupBy("predictor").agg(
        F.sum("n").alias("n_obs"), F.count(F.lit(1)).alias("n_subjects"), F.sum(F.col("n") * F.col("vx")).alias("sxx"),
        F.sum(F.col("n") * F.col("vy")).alias("syy"), F.sum(F.col("n") * F.col("cxy")).alias("sxy"),
    )
    enough = (F.col("n_subjects") >= 3) & (F.col("n_obs") >= 6) & (F.col("sxx") > 0) & (F.col("syy") > 0)
    out = s.withColumn("r", F.when(enough, F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))))
    out = out.withColumn("dof", F.col("n_obs") - F.col("n_subjects") - 1)
    r, dof = F.col("r"), F.col("dof")
    out = out.withColumn("p_unc", p_value("t_two_sided", r * F.sqrt(F.try_divide(dof, 1 - r * r)), dof))
    half = F.when(dof > 1, nb.Z975 / F.sqrt(dof - 1))
    out = out.withColumn("ci_low", F.tanh(F.atanh(r) - half)).withColumn("ci_high", F.tanh(F.atanh(r) + half))
    out = out.withColumn("power", p_value("correlation_power", r, dof))
    adjusted = fdr_bh(out, "p_unc", "predictor", alpha)
    return adjusted.select(
        "predictor", "n_subjects", "n_obs", "r", "dof", "p_unc", "ci_low", "ci_high", "power",
        nb.r_label(r).alias("effect_size_label"), "p_fdr", "reject_fdr",
        F.when(~enough, "too few complete cases").alias("error"),
    )


def fdr_bh(df: DataFrame, p: str, key: str, alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg adjusted p (``p_fdr``) and decision over all rows with a p-value.

    One row per hypothesis: the running minimum is over a result table, not over data rows.
    """
    from pyspark.sql import Window as W

    tested = F.col(p).isNotNull()
    # rows are test results; a constant partition per tested flag is a handful of rows
    asc = W.partitionBy(tested).orderBy(p, key)
    ranked = df.withColumn("_i", F.row_number().over(asc)).withColumn("_m", F.count(F.lit(1)).over(W.partitionBy(tested)))
    raw = ranked.withColumn("_raw", F.col(p) * F.col("_m") / F.col("_i"))
    down = W.partitionBy(tested).orderBy(F.desc("_i")).rowsBetween(W.unboundedPreceding, 0)
    adjusted = F.when(tested, F.least(F.lit(1.0), F.min("_raw").over(down)))
    return raw.withColumn("p_fdr", adjusted).withColumn("reject_fdr", F.col("p_fdr") <= alpha).drop("_i", "_m", "_raw")

"""Published values, hand-computed goldens, edge cases and parameter recovery."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorewell.functions import dist
from scorewell.functions import numbers as nb
from scorewell.operators import agreement as ag
from scorewell.operators import inferential as inf
from scorewell.operators import irt, mixed
from scorewell.operators import ordered as od
from scorewell.operators import psychometrics as ps


def long_matrix(spark, rows):
    """{user: "1101-"} -> long 0/1 matrix, '-' = not answered."""
    cells = [(u, f"Q{i + 1}", None if c == "-" else float(c)) for u, s in rows.items() for i, c in enumerate(s)]
    return spark.createDataFrame(cells, "user_id string, question_id string, item_score double")


@pytest.mark.parametrize(
    "got, want",
    [
        (dist.t_two_sided(2.2281388520, 10), 0.05), (dist.f_sf(4.1028210151, 2, 10), 0.05), (dist.chi2_sf(5.9914645471, 2), 0.05),
        (dist.t_ppf(0.975, 10), 2.2281388520), (dist.f_ppf(0.95, 2, 10), 4.1028210151), (dist.norm_sf(1.959963984540054), 0.025),
        (dist.paired_power(34, 0.5), 0.8077775), (dist.signed_rank_exact(8, 10), 0.048828125), (dist.rank_sum_exact(20, 5, 5), 0.15079365),
        (dist.binom_cdf(3, 10, 0.25), 0.77587509),
    ],
)
def test_distribution_values(got, want):
    assert got == pytest.approx(want, abs=1e-6)


def test_power_grows_and_n_search_is_minimal():
    n = int(dist.paired_n_needed(0.5, 0.8))
    assert dist.paired_power(n, 0.5) >= 0.8 > dist.paired_power(n - 1, 0.5)
    assert dist.paired_n_needed(0.0, 0.8) == 500


def test_normal_quantile_column(spark):
    ps_ = [1e-12, 1e-5, 0.02, 0.3, 0.5, 0.77, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps_], "p double").select("p", nb.normal_quantile(F.col("p")).alias("z"))
    for r in df.collect():
        assert r["z"] == pytest.approx(dist.norm_ppf(r["p"]), abs=1e-8)


def test_hand_matrix(spark):
    m = long_matrix(spark, {"A": "1111", "B": "1110", "C": "1100", "D": "1000", "E": "0000"})
    items = {r["item"]: r for r in ps.item_analysis(m).collect()}
    assert [round(items[f"Q{i}"]["p"], 6) for i in range(1, 5)] == [0.8, 0.6, 0.4, 0.2]
    assert items["Q1"]["r_it"] is None  # fewer than ten complete cases
    assert ps.kr20(m).first()["kr20"] == pytest.approx(0.8)
    ten = long_matrix(spark, {f"{u}{i}": s for i in range(2) for u, s in {"A": "1111", "B": "1110", "C": "1100", "D": "1000", "E": "0000"}.items()})
    assert {r["item"]: r for r in ps.item_analysis(ten).collect()}["Q4"]["r_it"] == pytest.approx(0.5145, abs=1e-4)


def test_wilson_interval(spark):
    r = spark.range(1).select(nb.wilson_low(F.lit(8.0), F.lit(10.0)).alias("lo"), nb.wilson_high(F.lit(8.0), F.lit(10.0)).alias("hi")).first()
    assert (round(r["lo"], 3), round(r["hi"], 3)) == (0.490, 0.943)


def test_miskeyed_item_is_flagged(spark):
    rng = np.random.default_rng(5)
    theta = rng.normal(size=120)
    rows = {}
    for u, t in enumerate(theta):
        good = [int(rng.random() < 1 / (1 + math.exp(-1.5 * (t - b)))) for b in np.linspace(-1, 1, 6)]
        bad = int(rng.random() < 1 / (1 + math.exp(1.5 * t)))
        rows[f"u{u}"] = "".join(map(str, good + [bad]))
    flags = {r["item"]: r["flags"] for r in ps.item_analysis(long_matrix(spark, rows)).collect()}
    assert "r_negative" in flags["Q7"] and not any("r_negative" in flags[f"Q{i}"] for i in range(1, 7))


def test_paired_and_signed_rank_edge_cases(spark):
    same = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0), ("c", 3.0, 3.0)], "user_id string, pre double, post double")
    r = inf.paired_comparison(same).first()
    assert r["cohens_d"] == 0.0 and r["t_stat"] is None and r["wilcoxon_p"] == 1.0 and r["n_needed_80"] == 500
    moved = spark.createDataFrame([(str(i), float(i), float(i) + d) for i, d in enumerate([1.1, 2.3, -0.7, 3.9, 0.4, 5.2])], "user_id string, pre double, post double")
    w = inf.signed_rank(moved.withColumn("diff", F.col("post") - F.col("pre"))).first()
    # ranks of |d|: 0.4 0.7 1.1 2.3 3.9 5.2, the negative one has rank 2
    assert w["statistic"] == 2 and w["method"] == "exact" and w["p_value"] == pytest.approx(2 * 3 / 64)


def test_posthoc_zero_difference_rules(spark):
    vec = spark.createDataFrame([(str(i), [float(i), float(i), float(i) + 1]) for i in range(6)], "user_id string, x array<double>")
    rows = {(r["time_a"], r["time_b"]): r for r in inf.posthoc_pairs(vec, ["o1", "o2", "o3"], "paired_t").collect()}
    assert rows["o1", "o2"]["p_raw"] == 1.0 and rows["o1", "o3"]["p_raw"] == 0.0
    assert rows["o1", "o2"]["statistic"] is None and rows["o1", "o3"]["significant"]
    w = {(r["time_a"], r["time_b"]): r for r in inf.posthoc_pairs(vec, ["o1", "o2", "o3"], "wilcoxon").collect()}
    assert w["o1", "o2"]["p_raw"] == 1.0


def test_repeated_measures_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 4)) + np.array([0, 0.3, 0.6, 0.9])
    vec = spark.createDataFrame([(str(i), [float(v) for v in row]) for i, row in enumerate(x)], "user_id string, x array<double>")
    r = inf.repeated_measures(vec, ["a1", "a2", "a3", "a4"]).first()
    n, k = x.shape
    ranks = x.argsort(1).argsort(1) + 1
    chi = 12 / (n * k * (k + 1)) * (ranks.sum(0) ** 2).sum() - 3 * n * (k + 1)
    assert r["friedman_stat"] == pytest.approx(chi)
    grand = x.mean()
    sst, sss = n * ((x.mean(0) - grand) ** 2).sum(), k * ((x.mean(1) - grand) ** 2).sum()
    sse = ((x - grand) ** 2).sum() - sst - sss
    assert r["rm_f"] == pytest.approx((sst / (k - 1)) / (sse / ((k - 1) * (n - 1))))
    s = np.cov(x.T)
    c = s - s.mean(0)[None] - s.mean(1)[:, None] + s.mean()
    assert r["eps"] == pytest.approx(np.trace(c) ** 2 / ((k - 1) * (c**2).sum()))
    assert inf.repeated_measures(vec, ["a1", "a2"]).first()["error"].startswith("exactly 2")


def test_small_group_normality_branches(spark):
    rows = [("two", 1.0), ("two", 2.0)] + [("flat", 5.0)] * 6 + [("three", v) for v in (1.0, 2.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = {r["g"]: r for r in inf.normality(df, "v", ["g"]).collect()}
    assert out["two"]["verdict"] == "Not tested (n<3)" and out["flat"]["verdict"] == "Not tested (no variance)"
    # W of three points is closed-form
    x = np.array([1.0, 2.0, 4.0])
    w = (np.sqrt(0.5) * 3) ** 2 / ((x - x.mean()) ** 2).sum()
    assert out["three"]["statistic"] == pytest.approx(w) and out["three"]["low_n_warning"]


def test_ordered_operators_with_hot_value(spark):
    rng = np.random.default_rng(1)
    values = np.where(rng.random(3000) < 0.4, 7.0, rng.integers(0, 400, 3000).astype(float))
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 3000), "v": values, "id": np.arange(3000)})
    df = spark.createDataFrame(pdf)
    want = pdf.groupby("g")["v"].rank().to_numpy()
    got = od.average_rank(df, ["g"], "v").toPandas().sort_values("id")["rank"].to_numpy()
    assert np.allclose(got, want)
    pos = od.ordinal_rank(df, ["g"], "v", "id").toPandas()
    for _, part in pos.groupby("g"):
        assert sorted(part["position"]) == list(range(1, len(part) + 1))
        assert part.sort_values("position")["v"].is_monotonic_increasing
    q = od.quantiles(df, ["g"], "v", {"q": 0.3}).toPandas().sort_values("g")["q"].to_numpy()
    assert np.allclose(q, pdf.groupby("g")["v"].quantile(0.3).to_numpy())


def test_ranks_of_dates_and_texts(spark):
    import datetime

    days = [datetime.date(2024, 1, 1) + datetime.timedelta(days=i % 11) for i in range(200)]
    pdf = pd.DataFrame({"g": 1, "d": days, "s": [f"w{(i * 7) % 13:02d}" for i in range(200)]})
    df = spark.createDataFrame(pdf)
    for column in ("d", "s"):
        got = sorted((r[column], r["rank"]) for r in od.average_rank(df, ["g"], column).collect())
        assert got == sorted(zip(pdf[column], pdf[column].rank(), strict=True))


def test_abilities_use_every_item(spark):
    n = 6000
    params = spark.range(n).select(F.concat(F.lit("q"), "id").alias("item_id"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    matrix = params.select(F.lit("u").alias("user_id"), F.col("item_id").alias("question_id"), F.lit(1.0).alias("item_score")).unionByName(
        spark.sql("SELECT 'v' AS user_id, 'q5999' AS question_id, 1.0D AS item_score"))
    out = {r["user_id"]: r["theta"] for r in irt.ability_eap(matrix, params).collect()}
    assert set(out) == {"u", "v"} and out["u"] > 3.5 > out["v"] > 0


def test_equal_count_bins_like_pandas(spark):
    for n, k in ((7, 5), (23, 5), (2, 5), (50, 2)):
        df = spark.createDataFrame([("g", float(i), f"u{i}") for i in range(n)], "g string, v double, u string")
        got = ps.equal_count_bins(df, ["g"], "v", "u", k).orderBy("v").toPandas()["bin"].tolist()
        want = (pd.qcut(pd.Series(range(1, n + 1)), q=min(k, n), labels=False) + 1).tolist()
        assert got == want


def test_kappa_and_bands(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (4, 4), (5, 6), (6, 6), (3, 3)], "a int, b int")
    o = np.zeros((6, 6))
    for a, b in [(1, 1), (2, 3), (4, 4), (5, 6), (6, 6), (3, 3)]:
        o[a - 1, b - 1] += 1
    w = (np.arange(6)[:, None] - np.arange(6)[None]) ** 2 / 25
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    assert ag.weighted_kappa(df, "a", "b").first()["kappa_w"] == pytest.approx(1 - (w * o).sum() / (w * e).sum())
    constant = spark.createDataFrame([(2, 2)] * 9, "a int, b int")
    r = ag.agreement_summary(constant, "a", "b", n_boot=100).first()
    assert r["kappa_w"] is None and r["band"] == "undefined" and r["exact"] == 1.0 and r["kappa_lo"] is None


def test_bootstrap_interval_covers_and_repeats(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(1, 7, 300)
    b = np.clip(a + rng.integers(-1, 2, 300), 1, 6)
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a int, b int")
    one, two = (ag.agreement_summary(df, "a", "b", n_boot=400).first() for _ in range(2))
    assert one == two and one["kappa_lo"] < one["kappa_w"] < one["kappa_hi"]


def test_youden_needs_both_classes(spark):
    df = spark.createDataFrame([(0.1, 1), (0.4, 1)], "s double, y int")
    assert ag.youden_threshold(df, "s", "y").first()["error"] == "both classes are needed"
    best = ag.youden_threshold(spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.9, 1)], "s double, y int"), "s", "y").first()
    assert best["optimal_threshold"] == 0.9 and best["auc"] == pytest.approx(0.875)


def rasch_data(spark, n, seed=4, items=10):
    rng = np.random.default_rng(seed)
    b = np.linspace(-1.5, 1.5, items)
    x = rng.random((n, items)) < 1 / (1 + np.exp(-(rng.normal(size=n)[:, None] - b[None])))
    rows = [(f"u{i}", f"Q{j + 1}", float(x[i, j])) for i in range(n) for j in range(items)]
    return b, spark.createDataFrame(rows, "user_id string, question_id string, item_score double")


def test_rasch_and_2pl_recover_difficulties(spark):
    b, m = rasch_data(spark, 400)
    fit = irt.rasch_fit(m)
    assert fit.converged and fit.items == [f"Q{i}" for i in range(1, 11)]
    assert np.corrcoef(fit.params["d"], b)[0, 1] > 0.97 and np.abs(fit.params["d"] - b).max() < 0.5
    two = irt.twopl_fit(m, max_iter=40, tol=1e-3).item_params(spark).toPandas()
    assert np.corrcoef(two["b"], b)[0, 1] > 0.95 and two["a"].between(0.4, 2.2).all()


def test_rasch_drops_constant_items_and_refuses_tiny_2pl(spark):
    m = long_matrix(spark, {f"u{i}": "1" + format(i % 8, "03b") for i in range(9)})
    assert irt.rasch_fit(m, max_iter=3).dropped == ["Q1"]
    assert "fewer than 10" in irt.twopl_fit(m).error


@pytest.mark.parametrize("n, least", [(30, 0.85), (100, 0.97)])
def test_glmm_difficulty_recovery(spark, n, least):
    b, m = rasch_data(spark, n, seed=11)
    items, head = irt.item_difficulty_glmm(m, "fixed")
    got = items.toPandas().assign(k=lambda d: d["item"].str[1:].astype(int)).sort_values("k")
    assert np.corrcoef(got["difficulty"], b)[0, 1] >= least
    assert head.first()["mode"] == "fixed" and (got["ci_low"] < got["difficulty"]).all()
    rnd, _ = irt.item_difficulty_glmm(m, "random")
    shrunk = rnd.toPandas().set_index("item")["difficulty"]
    assert shrunk.std() <= got.set_index("item")["difficulty"].std() + 1e-6


def test_graded_model_orders_thresholds(spark):
    rng = np.random.default_rng(2)
    theta = rng.normal(size=300)
    rows = []
    for i, t in enumerate(theta):
        for j, shift in enumerate((-0.5, 0.0, 0.5)):
            p = 1 / (1 + np.exp(-1.5 * (t - (np.array([-1.2, 0.0, 1.2]) + shift))))
            rows.append((f"u{i}", f"Q{j + 1}", float(1 + int((rng.random() < p).sum()))))
    m = spark.createDataFrame(rows, "user_id string, question_id string, item_score double")
    fit = irt.grm_fit(m, max_iter=15, tol=1e-2)
    assert (np.diff(fit.params["cuts"], axis=1) > 0).all() and (fit.params["a"] > 0).all()
    mid = fit.params["cuts"].mean(1)
    assert mid[0] < mid[1] < mid[2]


def test_mixed_model_matches_dense_likelihood(spark):
    rng = np.random.default_rng(9)
    rows, groups = [], []
    for u in range(40):
        n = int(rng.integers(3, 7))
        t = np.arange(1, n + 1)
        x = rng.normal(size=n)
        y = 50 + 2 * t + 3 * x + rng.normal() * 4 + rng.normal(size=n) * 3
        groups.append((t, x, y))
        rows += [(f"u{u}", int(a), float(v), float(v), float(w)) for a, v, w in zip(t, x, y)]
    df = spark.createDataFrame(rows, "user_id string, module_num int, x_within double, x_between double, y double").withColumn("x_between", F.sin(F.length("user_id") + F.col("x_within") * 0 + F.substring("user_id", 2, 9).cast("int")))
    m = mixed.collect_moments(df, "y", "module_num", ["x_within"])
    fit = mixed._fit(m, ["intercept", "module_num", "x_within"], False, False)

    def dense(lam, slope=None):
        xx, xy, yy, ld, size = np.zeros((3, 3)), np.zeros(3), 0.0, 0.0, 0
        for t, x, y in groups:
            z = np.column_stack([np.ones(len(t)), t]) if slope is not None else np.ones((len(t), 1))
            psi = slope if slope is not None else np.array([[lam]])
            v = np.eye(len(t)) + z @ psi @ z.T
            vi = np.linalg.inv(v)
            w = np.column_stack([np.ones(len(t)), t, x])
            xx, xy, yy = xx + w.T @ vi @ w, xy + w.T @ vi @ y, yy + y @ vi @ y
            ld, size = ld + np.linalg.slogdet(v)[1], size + len(t)
        rss = yy - xy @ np.linalg.solve(xx, xy)
        return -size / 2 * (np.log(2 * np.pi * rss / size) + 1) - ld / 2

    best = max(dense(l) for l in np.exp(np.linspace(-4, 4, 400)))
    assert fit["llf"] == pytest.approx(best, abs=1e-2) and fit["llf"] >= best - 1e-6
    psi = np.array([[0.8, 0.1], [0.1, 0.2]])
    assert mixed._profile(m, [0, 1, 2], psi, False)[0] == pytest.approx(dense(0, psi))
    assert fit["beta"] == pytest.approx([50, 2, 3], abs=2.5)
    out = mixed.mixed_model(df, "y", ["x"], ["x"], random_slope=True)
    blocks = {r["block"]: r for r in out["blocks"].collect()}
    assert blocks["M3b_random_slope"]["llf"] >= blocks["M3_full"]["llf"] - 1e-3
    assert blocks["M0_null"]["llf"] < blocks["M1_module"]["llf"] < blocks["M2_within"]["llf"]
    assert any(n.endswith("_reml") for n in blocks) and out["lrt"].count() == 3


def test_reliability_methods(spark):
    rows = []
    rng = np.random.default_rng(8)
    for u in range(30):
        t = rng.normal()
        for c, k in (("one", 1), ("two", 2), ("many", 4)):
            rows += [(c, f"u{u}", f"{c}{j}", float(t + rng.normal())) for j in range(k)]
    df = spark.createDataFrame(rows, "construct string, user_id string, question_id string, item_score double")
    out = {r["construct"]: r for r in ps.reliability(df, ["construct"]).collect()}
    assert out["one"]["method"] == "single_item_no_reliability" and out["one"]["value"] is None
    wide = df.filter("construct = 'two'").toPandas().pivot(index="user_id", columns="question_id", values="item_score")
    r = np.corrcoef(wide.T)[0, 1]
    assert out["two"]["value"] == pytest.approx(2 * r / (1 + r))
    many = df.filter("construct = 'many'").toPandas().pivot(index="user_id", columns="question_id", values="item_score")
    alpha = 4 / 3 * (1 - many.var().sum() / many.sum(axis=1).var())
    assert out["many"]["value"] == pytest.approx(alpha) and out["many"]["ci_low"] < alpha < out["many"]["ci_high"]


def test_fdr_matches_definition(spark):
    p = [0.01, 0.04, 0.03, 0.005, None, 0.5]
    df = spark.createDataFrame([(f"h{i}", x) for i, x in enumerate(p)], "k string, p double")
    got = {r["k"]: r["p_fdr"] for r in ps.fdr_bh(df, "p", "k").collect()}
    s = sorted((x, f"h{i}") for i, x in enumerate(p) if x is not None)
    running, want = 1.0, {}
    for i in range(len(s), 0, -1):
        running = min(running, s[i - 1][0] * len(s) / i)
        want[s[i - 1][1]] = running
    assert got["h4"] is None and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_draws_are_uniform_and_without_repeats(spark):
    from scorewell.operators import registry as rg

    users = spark.range(6000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("user_id"))
    bank = spark.createDataFrame([(f"q{i}", 10 * i) for i in range(7)], "question_id string, position int")
    rows = rg.question_draw(users, bank, 3).toPandas()
    assert len(rows) == 18_000 and rows.groupby("user_id")["question_id"].nunique().eq(3).all()
    for _, part in rows.groupby("position"):
        counts = part["question_id"].value_counts()
        assert len(counts) == 7 and (counts - 6000 / 7).abs().max() < 5 * (6000 / 7) ** 0.5
    sets = rows.groupby("user_id")["question_id"].agg(lambda q: tuple(sorted(q))).value_counts()
    assert len(sets) == 35 and (sets - 6000 / 35).abs().max() < 5 * (6000 / 35) ** 0.5
    assert rg.question_draw(users.limit(2), bank, 9).groupBy("user_id").count().collect()[0]["count"] == 7
    assert rg.question_draw(users.limit(2), bank.limit(0), 3).count() == 0


def test_hot_values_are_looked_up_in_a_small_table(spark):
    from scorewell.operators import ordered

    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 3 == 1, F.col("id").cast("double")).alias("x"), F.when(F.col("id") % 2 == 0, "a").alias("g"))
    got = ordered.average_rank(df, ["g"], "x").toPandas()
    assert len(got) == 4000
    want = got["x"].groupby(got["g"].fillna("-")).rank(method="average")
    assert (got["rank"] == want).all()


def test_ratio_level_beyond_one_block(spark, monkeypatch):
    from scorewell.operators import agreement as ag

    monkeypatch.setattr(ag, "VALUE_BLOCK", 40)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 300, 400)
    y = np.maximum(0, x + rng.integers(-20, 20, 400))
    sides = [spark.createDataFrame([(i, int(v)) for i, v in enumerate(c)], "u bigint, v bigint") for c in (x, y)]
    (row,) = ag.krippendorff_alpha(*sides, ["u"], "v", "ratio").collect()
    pool = np.concatenate([x, y]).astype(float)
    d = lambda a, b: np.where(a + b > 0, (a - b) ** 2 / np.maximum(a + b, 1) ** 2, 0.0)
    expected = d(pool[:, None], pool[None, :]).sum() / (800 * 799)
    assert row["alpha"] == pytest.approx(1 - d(x.astype(float), y.astype(float)).mean() / expected, abs=1e-9)

"""Rater agreement, decision thresholds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import materialize
from ..functions.numbers import kappa_band
from .ordered import cumulative_histogram

LOW_N_UNITS = 20  # fixed value
BLOOM_LEVELS = (1, 2, 3, 4, 5, 6)


def contingency(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _weight(a: Column, b: Column, k: int, weights: str) -> Column:
    gap = F.abs(a - b) / (k - 1)
    return gap if weights == "linear" else gap * gap


def weighted_kappa(df: DataFrame, a: str, b: str, levels: Sequence[int] = BLOOM_LEVELS, weights: str = "quadratic", by: Sequence[str] = ()) -> DataFrame:
    """1 - observed / expected weighted disagreement; NULL when nothing can disagree by chance.

    Expected disagreement needs only the two margins, and for quadratic weights only their moments;
    here both margins are small per-level count columns of one aggregated row.
    """
    index = F.create_map(*[x for i, l in enumerate(levels) for x in (F.lit(l), F.lit(i))])
    cells = contingency(df, a, b, by).select(*by, F.try_element_at(index, F.col("a")).alias("i"), F.try_element_at(index, F.col("b")).alias("j"), "n")
    k = len(levels)
    agg = cells.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * _weight(F.col("i"), F.col("j"), k, weights)).alias("observed"),
        *[F.coalesce(F.sum(F.when(F.col("i") == v, F.col("n"))), F.lit(0)).alias(f"_a{v}") for v in range(k)],
        *[F.coalesce(F.sum(F.when(F.col("j") == v, F.col("n"))), F.lit(0)).alias(f"_b{v}") for v in range(k)],
        F.sum(F.when(F.col("i") == F.col("j"), F.col("n")).otherwise(0)).alias("_same"),
        F.sum(F.when(F.abs(F.col("i") - F.col("j")) <= 1, F.col("n")).otherwise(0)).alias("_near"),
    )
    gap = lambda u, v: abs(u - v) / (k - 1) if weights == "linear" else (u - v) ** 2 / (k - 1) ** 2
    expected = sum((F.col(f"_a{u}") * F.col(f"_b{v}") * F.lit(float(gap(u, v))) for u in range(k) for v in range(k)), F.lit(0.0)) / F.col("n")
    out = agg.withColumn("expected", expected)
    return out.select(
        *by, "n", (F.col("_same") / F.col("n")).alias("exact"), (F.col("_near") / F.col("n")).alias("within1"),
        F.when(F.col("expected") > 0, 1 - F.col("observed") / F.col("expected")).alias("kappa_w"),
    )


def agreement_summary(df: DataFrame, a: str, b: str, levels: Sequence[int] = BLOOM_LEVELS, n_boot: int = 2000, seed: int = 7) -> DataFrame:
    """Exact and within-one agreement, weighted kappa with a percentile bootstrap interval (n >= 8).

    A bootstrap sample of the pairs is a multinomial draw over the contingency cells, so replicates
    are drawn from at most levels x levels counts whatever the number of pairs. Replicates run as
    ``n_boot`` rows in parallel and repeat for the same seed.
    """
    spark = df.sparkSession
    point = weighted_kappa(df, a, b, levels)
    cells = contingency(df, a, b).agg(F.sort_array(F.collect_list(F.struct("a", "b", "n"))).alias("cells"))
    k, index = len(levels), {l: i for i, l in enumerate(levels)}

    def draw(batches):
        for pdf in batches:
            out = []
            for rep, cs in zip(pdf["rep"], pdf["cells"]):
                i = np.array([index[c["a"]] for c in cs])
                j = np.array([index[c["b"]] for c in cs])
                n = np.array([c["n"] for c in cs], dtype=np.int64)
                if n.sum() < 8:
                    continue
                counts = np.random.default_rng((seed, int(rep))).multinomial(n.sum(), n / n.sum())
                table = np.zeros((k, k))
                np.add.at(table, (i, j), counts)
                w = (np.arange(k)[:, None] - np.arange(k)[None, :]) ** 2 / (k - 1) ** 2
                expected = np.outer(table.sum(1), table.sum(0)) / table.sum()
                if (w * expected).sum() > 0:
                    out.append(1 - (w * table).sum() / (w * expected).sum())
            yield pd.DataFrame({"kappa": out}, dtype="float64")

    reps = spark.range(n_boot).withColumnRenamed("id", "rep").join(F.broadcast(cells)).mapInPandas(draw, "kappa double")
    interval = reps.agg(  # n_boot numbers, fixed by the caller
        F.count("kappa").alias("_m"), F.percentile("kappa", F.lit(0.025)).alias("_lo"), F.percentile("kappa", F.lit(0.975)).alias("_hi")
    )
    enough = F.col("_m") > 50
    return point.join(interval, how="left").select(
        "n", "exact", "within1", "kappa_w", F.when(enough, F.col("_lo")).alias("kappa_lo"), F.when(enough, F.col("_hi")).alias("kappa_hi"),
        kappa_band(F.col("kappa_w")).alias("band"),
    )


def krippendorff_alpha(ratings_a: DataFrame, ratings_b: DataFrame, unit: Sequence[str], value: str, level: str = "nominal") -> DataFrame:
    """Krippendorff's alpha of two raters: one row with alpha, unit counts, and an error if untestable.

    Observed disagreement is a sum over units. Expected disagreement needs the pooled value counts:
    closed forms in sums for nominal and interval, running totals for ordinal; for ratio distinct values
    meet in blocks.
    """
    a = ratings_a.select(*unit, F.col(value).alias("x"))
    b = ratings_b.select(*unit, F.col(value).alias("y"))
    both = a.join(b, list(unit), "full")
    counts = both.agg(F.count(F.lit(1)).alias("n_units_total"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("n_units_both_coded"))
    pairs = both.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    pooled = pairs.select(F.explode(F.array(F.col("x"), F.col("y"))).alias("v"), "c").groupBy("v").agg(F.sum("c").cast("double").alias("n_v"))
    if level == "nominal":
        observed = pairs.agg(F.sum(F.when(F.col("x") != F.col("y"), F.col("c")).otherwise(0)).cast("double").alias("o"), F.sum("c").alias("u"))
        expected = pooled.agg(F.sum("n_v").alias("n"), F.sum(F.col("n_v") ** 2).alias("nn")).select("n", ((F.col("n") ** 2 - F.col("nn")) / 2).alias("e"))
    elif level in ("interval", "ordinal"):
        num = pooled.withColumn("v", F.col("v").cast("double"))
        if level == "ordinal":
            # the ordinal distance between c and k is the gap of their mid-ranks
            hist = cumulative_histogram(num, [], "v", F.col("n_v"))
            place = hist.select("v", (F.col("n_before") + F.col("n") / 2).alias("pos"), F.col("n").alias("n_v"))
        else:
            place = num.select("v", F.col("v").alias("pos"), "n_v")
        expected = place.agg(
            F.sum("n_v").alias("n"), F.sum(F.col("n_v") * F.col("pos")).alias("s"), F.sum(F.col("n_v") * F.col("pos") ** 2).alias("ss")
        ).select("n", (F.col("n") * F.col("ss") - F.col("s") ** 2).alias("e"))
        px = place.select(F.col("v").alias("_vx"), F.col("pos").alias("_px"))
        py = place.select(F.col("v").alias("_vy"), F.col("pos").alias("_py"))
        located = pairs.join(px, F.col("x").cast("double") == F.col("_vx")).join(py, F.col("y").cast("double") == F.col("_vy"))
        observed = located.agg(F.sum(F.col("c") * (F.col("_px") - F.col("_py")) ** 2).alias("o"), F.sum("c").alias("u"))
    elif level == "ratio":
        gap = lambda x, y: F.when(x + y != 0, ((x - y) / (x + y)) ** 2).otherwise(F.lit(0.0))
        observed = pairs.agg(F.sum(F.col("c") * gap(F.col("x").cast("double"), F.col("y").cast("double"))).alias("o"), F.sum("c").alias("u"))
        expected = _ratio_expected(pooled)
    else:
        raise ValueError(f"unknown level {level}")
    out = counts.join(observed, how="left").join(expected, how="left")
    # o sums one direction per unit (two ordered pairs each), e sums unordered pairs of pooled values
    alpha = 1 - (2 * F.col("o") / F.col("n")) / (2 * F.col("e") / (F.col("n") * (F.col("n") - 1)))
    few = F.col("n_units_both_coded") < 2
    return out.select(
        F.when(~few & (F.col("e") > 0), alpha).alias("alpha"), "n_units_total", "n_units_both_coded",
        (F.col("n_units_both_coded") < LOW_N_UNITS).alias("low_n_warning"), F.lit(level).alias("level_of_measurement"),
        F.when(few, "need at least 2 units coded by both raters").alias("error"),
    )


VALUE_BLOCK = 2048  # distinct values that meet as many others at once


def _ratio_expected(pooled: DataFrame) -> DataFrame:
    """Sum over unordered value pairs of n_c n_k ((c - k) / (c + k))^2.

    The distance does not split into sums per value, so the histogram of distinct values meets itself: in blocks dealt by a
    hash, each pair of blocks once, a pair being one small matrix of which only its sum leaves a task.
    """
    values = materialize(pooled.select(F.col("v").cast("double").alias("v"), "n_v"), "values")
    n_blocks = max(1, -(-values.count() // VALUE_BLOCK))
    item = F.struct("v", "n_v")
    blocks = values.groupBy(F.pmod(F.xxhash64("v"), F.lit(n_blocks)).alias("i")).agg(F.collect_list(item).alias("x"))
    other = blocks.select(F.col("i").alias("j"), F.col("x").alias("y"))
    met = blocks.withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(n_blocks - 1).cast("bigint")))).join(other, "j")

    def add(batches):
        for pdf in batches:
            sums = []
            for i, j, x, y in zip(pdf["i"], pdf["j"], pdf["x"], pdf["y"], strict=True):
                (a, m), (b, n) = (np.array([(r["v"], r["n_v"]) for r in side], dtype=float).T for side in (x, y))
                total = a[:, None] + b[None, :]
                d = np.divide(a[:, None] - b[None, :], total, out=np.zeros(total.shape), where=total != 0) ** 2
                sums.append(float(m @ d @ n) / (2 if i == j else 1))
            yield pd.DataFrame({"e": sums}, dtype="float64")

    e = met.select("i", "j", "x", "y").mapInPandas(add, "e double").agg(F.sum("e").alias("e"))
    return values.agg(F.sum("n_v").alias("n")).join(F.broadcast(e))  # two single rows


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """Cumulative true and false positives by descending score, ties merged."""
    y = F.col(label).cast("double")
    neg = df.filter(F.col(score).isNotNull() & y.isNotNull()).select((-F.col(score).cast("double")).alias("_s"), y.alias("_y"))
    hist = cumulative_histogram(neg, [], "_s", also=F.col("_y"))
    tp = F.col("m_before") + F.col("m")
    fp = F.col("n_before") + F.col("n") - tp
    return hist.select(
        (-F.col("_s")).alias("threshold"), tp.alias("tp"), fp.alias("fp"), F.col("m_total").alias("p"), (F.col("n_total") - F.col("m_total")).alias("q"),
        F.col("m").alias("tp_here"), (F.col("n") - F.col("m")).alias("fp_here"),
    )


def youden_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """The score threshold with the largest sensitivity + specificity - 1, and the AUC: one row."""
    pts = roc_points(df, score, label)
    tpr, fpr = F.try_divide("tp", "p"), F.try_divide("fp", "q")
    # trapezoid of this step: width fp_here, heights before and after
    area = F.col("fp_here") * (F.col("tp") - F.col("tp_here") / 2)
    best = F.max(F.struct((tpr - fpr).alias("j"), F.col("threshold").alias("t"), tpr.alias("tpr"), fpr.alias("fpr"))).alias("b")
    s = pts.agg(best, F.sum(area).alias("_area"), F.max("p").alias("p"), F.max("q").alias("q"))
    both = (F.col("p") > 0) & (F.col("q") > 0)
    # no threshold beats flagging nothing: the curve's start is the best point
    lifts = F.col("b.j") > 0
    return s.select(
        (F.col("p") + F.col("q")).cast("bigint").alias("n_pairs"), F.col("p").cast("bigint").alias("n_true_matches"), F.col("q").cast("bigint").alias("n_true_nonmatches"),
        F.when(both, F.when(lifts, F.col("b.t")).otherwise(F.lit(float("inf")))).alias("optimal_threshold"),
        F.when(both, F.when(lifts, F.col("b.tpr")).otherwise(F.lit(0.0))).alias("sensitivity"),
        F.when(both, F.when(lifts, 1 - F.col("b.fpr")).otherwise(F.lit(1.0))).alias("specificity"),
        F.when(both, F.greatest(F.lit(0.0), F.col("b.j"))).alias("youden_j"),
        F.when(both, F.col("_area") / (F.col("p") * F.col("q"))).alias("auc"),
        (F.col("p") + F.col("q") < LOW_N_UNITS).alias("low_n_warning"),
        F.when(F.col("p") + F.col("q") < 2, "need at least 2 labelled pairs").when(~both, "both classes are needed").alias("error"),
    )

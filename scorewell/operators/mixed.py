"""Linear mixed models from per-person cross-products.

One aggregation turns the data into cross-product sums per person, a second one sums them over
persons that share the same random-effect design (number of rows, sum and sum of squares of the
slope variable). Every likelihood evaluation then works on that small table on the driver; the data
are read once, whatever the number of optimiser steps or model blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dist import chi2_sf, norm_sf

MAX_DESIGNS = 100_000
LOW_N = 30  # fixed value


@dataclass
class Moments:
    """Cross-products of the columns ``names`` (intercept first, slope variable second, outcome last)."""

    names: list[str]
    design: np.ndarray  # per design: persons, n, sum t, sum t^2
    total: np.ndarray  # per design: k x k sum of w w'
    outer: np.ndarray  # per design: 2 x 2 x k x k sums of (w'z_a)(z_b'w)


def collect_moments(long: DataFrame, outcome: str, slope: str, columns: Sequence[str], unit: str = "user_id") -> Moments:
    names = ["intercept", slope, *columns, outcome]
    df = long.na.drop(subset=[outcome, slope, *columns, unit]).select(
        F.col(unit).alias("_u"), F.lit(1.0).alias("intercept"), *[F.col(c).cast("double").alias(c) for c in names[1:]]
    )
    k = len(names)
    pair = [(i, j) for i in range(k) for j in range(i, k)]
    per_unit = df.groupBy("_u").agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i, j in pair])
    s = lambda i, j: F.col(f"s{min(i, j)}_{max(i, j)}")
    key = [s(0, 0).alias("n"), s(0, 1).alias("t"), s(1, 1).alias("tt")]
    sums = [F.sum(s(i, j)).alias(f"a{i}_{j}") for i, j in pair]
    blocks = [(0, 0), (0, 1), (1, 1)]
    sums += [F.sum(s(a, i) * s(b, j)).alias(f"b{a}{b}_{i}_{j}") for a, b in blocks for i in range(k) for j in range(k)]
    rows = per_unit.groupBy(*key).agg(F.count(F.lit(1)).alias("m"), *sums).limit(MAX_DESIGNS + 1).collect()
    if len(rows) > MAX_DESIGNS:
        raise ValueError("the slope variable makes too many distinct designs; it should be an occasion number")
    design = np.array([[r["m"], r["n"], r["t"], r["tt"]] for r in rows], dtype=float)
    total = np.zeros((len(rows), k, k))
    outer = np.zeros((len(rows), 2, 2, k, k))
    for g, r in enumerate(rows):
        for i, j in pair:
            total[g, i, j] = total[g, j, i] = r[f"a{i}_{j}"]
        for a, b in blocks:
            for i in range(k):
                for j in range(k):
                    outer[g, a, b, i, j] = r[f"b{a}{b}_{i}_{j}"]
        outer[g, 1, 0] = outer[g, 0, 1].T
    return Moments(names, design, total, outer)


def _profile(m: Moments, use: list[int], psi: np.ndarray, reml: bool) -> tuple[float, np.ndarray, np.ndarray, float]:
    """(log-likelihood, coefficients, their covariance, residual variance) at relative covariance psi."""
    q = psi.shape[0]
    persons, n = m.design[:, 0], m.design[:, 1]
    zz = np.zeros((len(n), q, q))
    zz[:, 0, 0] = n
    if q == 2:
        zz[:, 0, 1] = zz[:, 1, 0] = m.design[:, 2]
        zz[:, 1, 1] = m.design[:, 3]
    inner = np.eye(q)[None] + zz @ psi
    shrink = psi[None] @ np.linalg.inv(inner)
    cross = m.total.sum(0) - np.einsum("gab,gabij->ij", shrink, m.outer[:, :q, :q])
    y = len(m.names) - 1
    xx, xy, yy = cross[np.ix_(use, use)], cross[use, y], cross[y, y]
    beta = np.linalg.solve(xx, xy)
    rss = max(yy - xy @ beta, 1e-12)
    size = float((persons * n).sum())
    dof = size - len(use) if reml else size
    s2 = rss / dof
    logdet = float((persons * np.log(np.linalg.det(inner))).sum())
    ll = -0.5 * dof * (np.log(2 * np.pi * s2) + 1) - 0.5 * logdet
    if reml:
        ll -= 0.5 * np.linalg.slogdet(xx)[1]
    return ll, beta, s2 * np.linalg.inv(xx), s2


def _simplex(value: Callable[[np.ndarray], float], start: np.ndarray, steps: int = 400) -> tuple[np.ndarray, bool]:
    """Maximise a smooth function of up to three variables by a downhill simplex."""
    n = len(start)
    pts = [start] + [start + 0.7 * np.eye(n)[i] for i in range(n)]
    vals = [-value(p) for p in pts]
    for _ in range(steps):
        order = np.argsort(vals)
        pts, vals = [pts[i] for i in order], [vals[i] for i in order]
        if abs(vals[-1] - vals[0]) < 1e-9 * (1 + abs(vals[0])) and np.abs(pts[-1] - pts[0]).max() < 1e-5:
            return pts[0], True
        centre = np.mean(pts[:-1], axis=0)
        tries = {c: centre + c * (centre - pts[-1]) for c in (1.0, 2.0, 0.5, -0.5)}
        f1 = -value(tries[1.0])
        if f1 < vals[0]:
            f2 = -value(tries[2.0])
            pts[-1], vals[-1] = (tries[2.0], f2) if f2 < f1 else (tries[1.0], f1)
        elif f1 < vals[-2]:
            pts[-1], vals[-1] = tries[1.0], f1
        else:
            c = 0.5 if f1 < vals[-1] else -0.5
            fc = -value(tries[c])
            if fc < min(f1, vals[-1]):
                pts[-1], vals[-1] = tries[c], fc
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                vals = [vals[0]] + [-value(p) for p in pts[1:]]
    return pts[int(np.argmin(vals))], False


def _relative_covariance(x: np.ndarray) -> np.ndarray:
    if len(x) == 1:
        return np.array([[np.exp(2 * np.clip(x[0], -12, 6))]])
    low = np.array([[np.exp(np.clip(x[0], -12, 6)), 0.0], [x[1], np.exp(np.clip(x[2], -12, 6))]])
    return low @ low.T


def _fit(m: Moments, terms: Sequence[str], random_slope: bool, reml: bool) -> dict:
    use = [m.names.index(t) for t in terms]
    start = np.array([-1.0]) if not random_slope else np.array([-1.0, 0.0, -2.5])
    x, converged = _simplex(lambda v: _profile(m, use, _relative_covariance(v), reml)[0], start)
    psi = _relative_covariance(x)
    ll, beta, cov, s2 = _profile(m, use, psi, reml)
    n = float((m.design[:, 0] * m.design[:, 1]).sum())
    k = len(terms) + len(start) + 1  # coefficients, random-effect parameters, residual scale
    return {
        "llf": ll, "beta": beta, "se": np.sqrt(np.diag(cov)), "s2": s2, "var_intercept": psi[0, 0] * s2, "converged": converged,
        "aic": None if reml else -2 * ll + 2 * k, "bic": None if reml else -2 * ll + k * np.log(n), "n_obs": int(n), "n_groups": int(m.design[:, 0].sum()), "terms": list(terms),
    }


def mixed_model(long: DataFrame, outcome: str, within: Sequence[str], between: Sequence[str], unit: str = "user_id", module: str = "module_num", random_slope: bool = True) -> dict[str, DataFrame]:
    """Nested blocks null, + module, + within, + between [, + random slope]: ML fits compared by AIC,
    BIC and likelihood ratios, the best ones refitted by REML, and variance inflation factors.

    ``long`` already has ``<c>_within`` and ``<c>_between`` columns.
    """
    spark = long.sparkSession
    w, b = [f"{c}_within" for c in within], [f"{c}_between" for c in between]
    m = collect_moments(long, outcome, module, [*w, *b], unit)
    blocks = {"M0_null": ["intercept"], "M1_module": ["intercept", module]}
    if w:
        blocks["M2_within"] = ["intercept", module, *w]
    if b:
        blocks["M3_full"] = ["intercept", module, *w, *b]
    fits = {name: _fit(m, terms, False, False) for name, terms in blocks.items()}
    specs = {name: (terms, False) for name, terms in blocks.items()}
    if random_slope and "M3_full" in blocks:
        fits["M3b_random_slope"] = _fit(m, blocks["M3_full"], True, False)
        specs["M3b_random_slope"] = (blocks["M3_full"], True)
    order = [x for x in ("M0_null", "M1_module", "M2_within", "M3_full") if x in fits]
    lrt = []
    for lo, hi in zip(order, order[1:]):
        df = len(specs[hi][0]) - len(specs[lo][0])
        stat = 2 * (fits[hi]["llf"] - fits[lo]["llf"])
        if df > 0:
            lrt.append((lo, hi, float(stat), df, float(chi2_sf(max(stat, 0.0), df))))
    best = {k: min((x for x in fits if fits[x]["converged"]), key=lambda x: fits[x][k], default=None) for k in ("aic", "bic")}
    for name in {v for v in best.values() if v}:
        fits[f"{name}_reml"] = _fit(m, *specs[name], True)
    rows = [
        (name, f["llf"], f["aic"], f["bic"], f["converged"], f["n_obs"], f["n_groups"], float(f["s2"]), float(f["var_intercept"]), name == best["aic"], name == best["bic"], f["n_groups"] < LOW_N)
        for name, f in fits.items()
    ]
    params = [
        (name, t, float(e), float(s), float(e / s), float(2 * norm_sf(abs(e / s)))) for name, f in fits.items() for t, e, s in zip(f["terms"], f["beta"], f["se"])
    ]
    return {
        "blocks": spark.createDataFrame([tuple(None if v is None else (float(v) if isinstance(v, np.floating) else v) for v in r) for r in rows],
            "block string, llf double, aic double, bic double, converged boolean, n_obs bigint, n_groups bigint, residual_var double, intercept_var double, best_by_aic boolean, best_by_bic boolean, low_n_warning boolean"),
        "params": spark.createDataFrame(params, "block string, term string, estimate double, se double, z double, p double"),
        "lrt": spark.createDataFrame(lrt, "from_block string, to_block string, lr_stat double, df int, p_value double"),
        "vif": spark.createDataFrame(_vif(m, [*w, *b, module]), "term string, vif double"),
    }


def _vif(m: Moments, terms: Sequence[str]) -> list[tuple[str, float]]:
    if len(terms) < 2:
        return []
    total = m.total.sum(0)
    use = [m.names.index(t) for t in terms]
    mean = total[0, use] / total[0, 0]
    cov = total[np.ix_(use, use)] / total[0, 0] - np.outer(mean, mean)
    sd = np.sqrt(np.diag(cov))
    return [(t, float(v)) for t, v in zip(terms, np.diag(np.linalg.pinv(cov / np.outer(sd, sd))))]

"""Item response models by distributed EM over response patterns.

Persons collapse to distinct response patterns with counts (items are configuration, persons are
data). An E-step is one pass over the pattern table that returns expected counts per item and node,
summed by Spark; the M-step works on that items x nodes table on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import clip, materialize
from ..functions.numbers import rasch_size_note, twopl_size_note
from ..functions.text import natural_key
from .ordered import cumulative_histogram

MIN_N_HARD, MIN_N_WARN, FEW_ITEMS = 10, 100, 10  # fixed values
EAP_GRID = np.linspace(-4, 4, 41)  # fixed value
CLIP = 1e-10  # fixed value
LOW_SLOPE, HIGH_SLOPE = 0.02, 8.0  # slopes end here, where answers do not (or perfectly) follow the ability


def item_order(matrix: DataFrame, item: str = "question_id") -> list[str]:
    """Items in natural order. A fitted model has some numbers per item on the driver, so its item list is there too."""
    return [r[0] for r in matrix.select(item).distinct().orderBy(natural_key(F.col(item)), item).collect()]


def response_patterns(matrix: DataFrame, items: Sequence[str] | Mapping[str, Sequence[str]], missing: str = "skip") -> DataFrame:
    """``pattern array<double>`` (one slot per item, NULL = no answer), ``n`` persons.

    With a mapping of groups to items, ``matrix`` has a column ``g`` and patterns are made per group.
    """
    grouped = isinstance(items, Mapping)
    by = ["g"] if grouped else []
    cells = matrix.filter(F.col("item_score").isNotNull())
    persons = cells.groupBy(*by, "user_id").agg(F.map_from_entries(F.collect_list(F.struct("question_id", "item_score"))).alias("m"))
    listed = lambda names: F.array(*[F.lit(i) for i in names])
    slots = F.element_at(F.create_map(*[x for g, names in items.items() for x in (F.lit(g), listed(names))]), F.col("g")) if grouped else listed(items)
    fill = F.lit(0.0) if missing == "wrong" else F.lit(None).cast("double")
    pattern = F.transform(slots, lambda q: F.coalesce(F.try_element_at("m", q), fill))
    return persons.groupBy(*by, pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array([[np.nan if x is None else float(x) for x in row] for row in column], dtype=float)


def _grid(nodes: int = 41, width: float = 5.0) -> tuple[np.ndarray, np.ndarray]:
    z = np.linspace(-width, width, nodes)
    w = np.exp(-0.5 * z * z)
    return z, np.log(w / w.sum())


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _log_categories(model: str, params: dict, theta: np.ndarray) -> np.ndarray:
    """log P(category) as items x categories x nodes."""
    if model == "grm":
        a, cuts = params["a"], params["cuts"]
        above = _logistic(a[:, None, None] * (theta[None, None, :] - cuts[:, :, None]))
        one = np.ones((len(a), 1, len(theta)))
        return np.log(np.clip(np.concatenate([one, above], 1) - np.concatenate([above, 0 * one], 1), CLIP, 1.0))
    eta = params["a"][:, None] * theta[None, :] - params["d"][:, None]
    p = np.clip(_logistic(eta), CLIP, 1 - CLIP)
    return np.log(np.stack([1 - p, p], axis=1))


def _expected_counts(patterns: DataFrame, logp: np.ndarray, log_prior: np.ndarray) -> tuple[np.ndarray, float]:
    """Expected persons per (item, category, node) and the marginal log-likelihood."""
    return _expected_counts_of(patterns.select(F.lit("").alias("g"), "pattern", "n"), {"": logp}, log_prior)[""]


def _expected_counts_of(patterns: DataFrame, models: Mapping[str, np.ndarray], log_prior: np.ndarray) -> dict[str, tuple[np.ndarray, float]]:
    """The same for several groups' models in one pass over their patterns."""

    def e_step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, loglik = {g: np.zeros(m.shape) for g, m in models.items()}, dict.fromkeys(models, 0.0)
        for pdf in batches:
            for g, part in pdf.groupby("g"):
                logp = models[g]
                x, c = _matrix(part["pattern"]), part["n"].to_numpy(dtype=float)
                picks = [(x == k).astype(float) for k in range(logp.shape[1])]
                ll = sum(pick @ logp[:, k, :] for k, pick in enumerate(picks)) + log_prior
                top = ll.max(1, keepdims=True)
                post = np.exp(ll - top)
                norm = post.sum(1, keepdims=True)
                post = post / norm * c[:, None]
                loglik[g] += float((c * (np.log(norm[:, 0]) + top[:, 0])).sum())
                for k, pick in enumerate(picks):
                    total[g][:, k, :] += pick.T @ post
        for g, sums in total.items():
            i, k, q = (np.append(x.ravel(), last) for x, last in zip(np.indices(sums.shape), (-1, 0, 0), strict=True))
            yield pd.DataFrame({"g": g, "i": i, "k": k, "q": q, "v": np.append(sums.ravel(), loglik[g])})

    parts = patterns.filter(F.col("g").isin(list(models))).select("g", "pattern", "n").mapInPandas(e_step, "g string, i int, k int, q int, v double")
    out, loglik = {g: np.zeros(m.shape) for g, m in models.items()}, dict.fromkeys(models, 0.0)
    for r in parts.groupBy("g", "i", "k", "q").agg(F.sum("v").alias("v")).collect():  # items x categories x nodes rows
        if r["i"] < 0:
            loglik[r["g"]] = r["v"]
        else:
            out[r["g"]][r["i"], r["k"], r["q"]] = r["v"]
    return {g: (out[g], loglik[g]) for g in models}


class Accelerated:
    """Where the next EM step is taken: after two steps the rest of the way is extrapolated from how they shrank.

    An extrapolation that lowers the likelihood is taken back. ``at`` is the point to step from; ``feed`` takes the step's
    result and the log-likelihood at ``at``.
    """

    def __init__(self, start: np.ndarray, tol: float) -> None:
        self.at, self.tol, self.steps, self.converged, self.loglik = start, tol, 0, False, float("nan")
        self._trail: list[np.ndarray] = []
        self._safe: tuple[np.ndarray, float] | None = None

    def feed(self, new: np.ndarray, loglik: float) -> None:
        self.steps += 1
        if self._safe is not None:
            (back, floor), self._safe = self._safe, None
            if not loglik >= floor - 1e-10 * abs(floor):
                self.at = back
                return
        self.loglik = loglik
        if np.abs(new - self.at).max() < self.tol:
            self.at, self.converged = new, True
            return
        self._trail.append(self.at)
        self.at = new
        if len(self._trail) == 2:
            (first, second), self._trail = self._trail, []
            step = second - first
            bend = (new - second) - step
            ahead = float(np.linalg.norm(step) / max(np.linalg.norm(bend), 1e-12))
            if 1.0 < ahead < 100.0:
                self.at, self._safe = first + 2 * ahead * step + ahead**2 * bend, (new, loglik)


def _newton(value: Callable[[np.ndarray], float], start: np.ndarray, steps: int = 8) -> np.ndarray:
    """A few damped Newton steps on a small smooth objective, derivatives by differences."""
    x, h = start.astype(float), 1e-4
    best = value(x)
    for _ in range(steps):
        n = len(x)
        e = np.eye(n) * h
        up, down = np.array([value(x + e[j]) for j in range(n)]), np.array([value(x - e[j]) for j in range(n)])
        grad = (up - down) / (2 * h)
        hess = np.zeros((n, n))
        for j in range(n):
            hess[j, j] = (up[j] - 2 * best + down[j]) / h**2
            for l in range(j):
                cross = value(x + e[j] + e[l]) - value(x + e[j] - e[l]) - value(x - e[j] + e[l]) + value(x - e[j] - e[l])
                hess[j, l] = hess[l, j] = cross / (4 * h * h)
        eig, vec = np.linalg.eigh(hess)
        step = -vec @ ((vec.T @ grad) / np.minimum(eig, -1e-3))
        scale = 1.0
        while scale > 1e-4 and value(x + scale * step) < best:
            scale /= 2
        if scale <= 1e-4:
            break
        x = x + scale * step
        gained = value(x) - best
        best += gained
        if gained < 1e-10 * (1 + abs(best)):
            break
    return x


@dataclass
class Fit:
    """Item parameters and fit summary of a model; ``params`` are arrays in item order."""

    model: str
    items: list[str]
    params: dict
    loglik: float
    n_persons: int
    iterations: int
    converged: bool
    dropped: list[str]
    error: str | None = None
    group: str = ""

    def item_params(self, spark) -> DataFrame:
        if self.model == "grm":
            return graded_params(spark, {self.group: self}).drop("g", "error")
        rows = [(i, float(s), float(d / s), self.converged, self.iterations) for i, s, d in zip(self.items, self.params["a"], self.params["d"], strict=True)]
        return spark.createDataFrame(rows, "item_id string, a double, b double, converged boolean, iterations int")

    def summary(self, spark) -> DataFrame:
        note = {"rasch": rasch_size_note, "2pl": twopl_size_note}.get(self.model)
        row = [(self.model, self.n_persons, len(self.items), self.loglik, self.iterations, self.converged, self.dropped, self.n_persons < MIN_N_WARN, self.error)]
        df = spark.createDataFrame(row, "model string, n_persons bigint, n_items int, loglik double, iterations int, converged boolean, dropped_items array<string>, low_n_warning boolean, error string")
        return df.withColumn("size_note", note(F.col("n_persons")) if note else F.lit(None).cast("string"))


def _varying(matrix: DataFrame) -> tuple[DataFrame, list[str]]:
    """Matrix without constant items, and those items."""
    from .scores import constant_items, drop_constant_items

    flat = [r[0] for r in constant_items(matrix).collect()]  # a part of the item bank, as large as the model itself
    return (drop_constant_items(matrix) if flat else matrix), flat


def fit_binary(matrix: DataFrame, model: str = "rasch", missing: str = "skip", max_iter: int = 100, tol: float = 1e-4, sd: float | None = 1.0, item_prior: bool = False) -> Fit:
    """Marginal maximum likelihood for 0/1 items with normal abilities.

    ``rasch``: common slope (fixed at ``sd``, or estimated when ``sd`` is None); ``2pl``: a slope per
    item. ``item_prior`` treats item difficulties as normal random effects.
    """
    matrix, dropped = _varying(materialize(matrix.select("user_id", "question_id", "item_score"), "matrix"))  # read several times
    items = item_order(matrix)
    patterns = materialize(response_patterns(matrix, items, missing), "patterns")
    n = patterns.agg(F.sum("n")).first()[0] or 0
    if len(items) < 2 or (model == "2pl" and n < MIN_N_HARD):
        reason = "fewer than 2 items with variance" if len(items) < 2 else f"fewer than {MIN_N_HARD} persons"
        return Fit(model, items, {"a": np.ones(len(items)), "d": np.zeros(len(items))}, float("nan"), n, 0, False, dropped, reason)
    z, log_prior = _grid()
    k = len(items)
    state = Accelerated(np.concatenate([np.full(k, 1.0 if sd is None else sd), np.zeros(k + 2)]), tol)  # slopes, difficulties, their mean and log variance
    info = np.ones(k)
    while state.steps < max_iter and not state.converged:
        a, d, mu, tau2 = np.clip(state.at[:k], LOW_SLOPE, HIGH_SLOPE), state.at[k : 2 * k].copy(), state.at[-2], float(np.exp(np.clip(state.at[-1], -9, 9)))
        counts, loglik = _expected_counts(patterns, _log_categories("binary", {"a": a, "d": d}, z), log_prior)
        right, total = counts[:, 1, :], counts.sum(1)
        for _ in range(6):
            p = _logistic(a[:, None] * z[None, :] - d[:, None])
            gap, w = right - total * p, total * p * (1 - p)
            info = w.sum(1) + (1 / tau2 if item_prior else 0.0)
            grad_d = -gap.sum(1) - ((d - mu) / tau2 if item_prior else 0.0)
            if model == "2pl":
                ga, haa, had = (gap * z).sum(1), (w * z * z).sum(1), (w * z).sum(1)
                det = np.maximum(info * haa - had**2, 1e-9)
                a = np.clip(a + np.clip((info * ga + had * grad_d) / det, -0.5, 0.5), LOW_SLOPE, HIGH_SLOPE)
                d = d + np.clip((haa * grad_d + had * ga) / det, -1.0, 1.0)
            else:
                d = d + np.clip(grad_d / info, -1.0, 1.0)
                if sd is None:
                    step = (gap * z).sum() / max(1e-9, (w * z * z).sum())
                    a = np.full(k, np.clip(a[0] + np.clip(step, -0.25, 0.25), LOW_SLOPE, HIGH_SLOPE))
        if item_prior:
            mu = float(d.mean())
            tau2 = float(max(2e-4, ((d - mu) ** 2 + 1 / info).mean()))
        state.feed(np.concatenate([a, d, [mu, np.log(tau2)]]), loglik)
    a, d, tau2 = np.clip(state.at[:k], LOW_SLOPE, HIGH_SLOPE), state.at[k : 2 * k], float(np.exp(state.at[-1]))
    params = {"a": a, "d": d, "se": 1 / np.sqrt(info), "sigma_item": float(np.sqrt(tau2)) if item_prior else None, "sigma_person": float(a[0])}
    return Fit(model, items, params, float(state.loglik), n, state.steps, state.converged, dropped)


def rasch_fit(matrix: DataFrame, missing: str = "skip", **kw) -> Fit:
    return fit_binary(matrix, "rasch", missing, **kw)


def twopl_fit(matrix: DataFrame, missing: str = "skip", **kw) -> Fit:
    return fit_binary(matrix, "2pl", missing, **kw)


def grm_fit(matrix: DataFrame, n_categories: int = 4, missing: str = "skip", max_iter: int = 100, tol: float = 1e-3) -> Fit:
    """Graded response model for scores 1..n_categories: slope and ordered thresholds per item."""
    fits = grm_fits(matrix.withColumn("g", F.lit("")), n_categories, missing, max_iter, tol)
    return fits.get("") or Fit("grm", [], {"a": np.ones(0), "cuts": np.ones((0, n_categories - 1))}, float("nan"), 0, 0, False, [], f"fewer than {MIN_N_HARD} persons")


def _graded(x: np.ndarray) -> dict:
    """Slopes and thresholds from free parameters by item: slope, first intercept, log gaps between intercepts."""
    a = np.clip(x[:, 0], LOW_SLOPE, HIGH_SLOPE)
    gaps = np.cumsum(np.exp(np.clip(x[:, 2:], -6, 3)), axis=1)
    return {"a": a, "cuts": (x[:, 1:2] + np.concatenate([np.zeros((len(x), 1)), gaps], axis=1)) / a[:, None]}


def grm_fits(matrix: DataFrame, n_categories: int = 4, missing: str = "skip", max_iter: int = 100, tol: float = 1e-3) -> dict[str, Fit]:
    """A graded response model for each group ``g`` of a matrix, all fitted in the same passes; groups by name.

    A pass serves the groups that have not converged; items without variance are dropped from their group.
    """
    cells = matrix.select("g", "user_id", "question_id", (F.col("item_score") - 1).alias("item_score")).filter(F.col("item_score").isNotNull())
    items = cells.groupBy("g", "question_id").agg(F.min("item_score").alias("low"), F.max("item_score").alias("high"))
    listed = items.orderBy("g", natural_key(F.col("question_id")), "question_id").collect()  # the models have some numbers per item on the driver
    kept, dropped = ({g: [r["question_id"] for r in listed if r["g"] == g and (r["low"] < r["high"]) == varies] for g in {r["g"] for r in listed}} for varies in (True, False))
    patterns = materialize(response_patterns(cells, kept, missing), "patterns") if kept else None
    persons = {r["g"]: r["n"] for r in patterns.groupBy("g").agg(F.sum("n").alias("n")).collect()} if kept else {}
    z, log_prior = _grid()
    states: dict[str, Accelerated] = {}
    start = np.concatenate([[1.0, -1.0], np.full(n_categories - 2, np.log(2 / max(1, n_categories - 2)))])
    for g, names in kept.items():
        if persons.get(g, 0) >= MIN_N_HARD and names:
            states[g] = Accelerated(np.tile(start, len(names)), tol)
    shape = (-1, n_categories)
    while active := {g: s for g, s in states.items() if not s.converged and s.steps < max_iter}:
        models = {g: _log_categories("grm", _graded(s.at.reshape(shape)), z) for g, s in active.items()}
        for g, (counts, loglik) in _expected_counts_of(patterns, models, log_prior).items():
            new = []
            for x, count in zip(active[g].at.reshape(shape), counts, strict=True):
                new.append(_newton(lambda y, c=count: float((c * _log_categories("grm", _graded(y[None, :]), z)[0]).sum()), x, steps=3))
            active[g].feed(np.concatenate(new), loglik)
    out = {}
    for g, names in kept.items():
        if g in states:
            s = states[g]
            out[g] = Fit("grm", names, _graded(s.at.reshape(shape)), float(s.loglik), persons[g], s.steps, s.converged, dropped[g], group=g)
        else:
            reason = f"fewer than {MIN_N_HARD} persons" if names else "no item with variance"
            out[g] = Fit("grm", names, _graded(np.tile(start, (len(names), 1))), float("nan"), persons.get(g, 0), 0, False, dropped[g], reason, g)
    return out


def graded_params(spark, fits: Mapping[str, Fit]) -> DataFrame:
    """Item parameters of several groups in one frame, with each fit's convergence."""
    rows = [(g, i, float(a), [float(c) for c in cs], f.converged, f.iterations, f.error) for g, f in sorted(fits.items()) for i, a, cs in zip(f.items, f.params["a"], f.params["cuts"], strict=True)]
    return spark.createDataFrame(rows, "g string, item_id string, a double, thresholds array<double>, converged boolean, iterations int, error string")


def score_residuals(matrix: DataFrame, params: DataFrame) -> DataFrame:
    """Per binary item the two sides of its likelihood equations at ``params`` (item_id, a, b), divided by its answers.

    At a maximum the mean of answer minus expected answer (``gap``) is zero for every item, and for items with a slope of their
    own also its mean product with the ability (``slope_gap``); expectations are over each person's posterior.
    """
    z, log_prior = _grid()
    nodes, prior = F.array(*[F.lit(float(t)) for t in z]), F.array(*[F.lit(float(w)) for w in log_prior])
    eta = F.transform(nodes, lambda t: F.col("a") * (t - F.col("b")))
    dim = params.select(F.col("item_id").alias("question_id"), F.transform(eta, lambda e: 1 / (1 + F.exp(-e))).alias("p"))
    cells = matrix.filter(F.col("item_score").isNotNull()).join(dim, "question_id")
    lp = F.transform("p", lambda p: F.log(F.when(F.col("item_score") == 1, p).otherwise(1 - p)))
    each = cells.withColumn("_l", lp).groupBy("user_id").agg(*[F.sum(F.element_at("_l", q + 1)).alias(f"s{q}") for q in range(len(z))])
    ll = F.zip_with(F.array(*[f"s{q}" for q in range(len(z))]), prior, lambda x, y: x + y)
    weight = each.select("user_id", ll.alias("ll")).select("user_id", F.transform("ll", lambda x: F.exp(x - F.array_max("ll"))).alias("w"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    weight = weight.select("user_id", F.transform("w", lambda x: x / total(F.col("w"))).alias("w"))
    off = F.transform("p", lambda p: F.col("item_score") - p)
    terms = cells.join(weight, "user_id").withColumn("_t", F.zip_with("w", off, lambda w, o: w * o))
    return terms.groupBy(F.col("question_id").alias("item_id")).agg(
        F.avg(total(F.col("_t"))).alias("gap"), F.avg(total(F.zip_with("_t", nodes, lambda x, t: x * t))).alias("slope_gap")
    )


# -- abilities ---------------------------------------------------------------------------------


def _eap(weighted: DataFrame) -> DataFrame:
    """``user_id, ll array`` over the grid -> EAP and posterior sd under N(0, 1)."""
    grid = F.array(*[F.lit(float(t)) for t in EAP_GRID])
    prior = np.exp(-0.5 * EAP_GRID**2)
    weights = F.array(*[F.lit(float(w)) for w in prior / prior.sum()])
    top = F.array_max("ll")
    post = F.zip_with(F.transform("ll", lambda v: F.exp(v - top)), weights, lambda a, b: a * b)
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    df = weighted.withColumn("_p", post).withColumn("_s", total(F.col("_p")))
    df = df.withColumn("theta", total(F.zip_with("_p", grid, lambda a, b: a * b)) / F.col("_s"))
    spread = F.zip_with("_p", grid, lambda a, b: a * (b - F.col("theta")) * (b - F.col("theta")))
    keys = [c for c in weighted.columns if c != "ll"]
    return df.select(*keys, "theta", F.sqrt(total(spread) / F.col("_s")).alias("theta_se"))


def ability_eap(matrix: DataFrame, params: DataFrame, missing: str = "skip") -> DataFrame:
    """Expected a posteriori ability and its sd from binary scores; ``params``: item_id, a, b.

    Each answer brings the log-likelihood of its item at 41 nodes; a person's answers are 41 sums in
    one aggregation. ``missing="wrong"`` counts unanswered items as wrong.
    """
    right = [clip(1 / (1 + F.exp(-F.col("a") * (F.lit(float(t)) - F.col("b")))), CLIP, 1 - CLIP) for t in EAP_GRID]
    dim = params.select(
        F.col("item_id").alias("question_id"), F.array(*[F.log(p) for p in right]).alias("l1"), F.array(*[F.log(1 - p) for p in right]).alias("l0")
    )
    cells = matrix.filter(F.col("item_score").isNotNull()).join(dim, "question_id")
    lp = F.when(F.col("item_score") == 1, F.col("l1")).otherwise(F.col("l0"))
    base = [0.0] * len(EAP_GRID)
    if missing == "wrong":
        # every item starts as wrong: one row of 41 sums, whatever the number of items
        sums = dim.agg(*[F.sum(F.element_at("l0", q + 1)) for q in range(len(EAP_GRID))]).first()
        base = [x or 0.0 for x in sums]
        lp = F.when(F.col("item_score") == 1, F.zip_with("l1", "l0", lambda x, y: x - y)).otherwise(F.array(*[F.lit(0.0)] * len(EAP_GRID)))
    sums = [(F.sum(F.element_at("_l", q + 1)) + F.lit(float(base[q]))).alias(f"s{q}") for q in range(len(EAP_GRID))]
    summed = cells.withColumn("_l", lp).groupBy("user_id").agg(*sums)
    return _eap(summed.select("user_id", F.array(*[F.col(f"s{q}") for q in range(len(EAP_GRID))]).alias("ll")))


def ability_eap_graded(matrix: DataFrame, params: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """EAP for graded items; ``params``: item_id, a, thresholds; scores count from 1. ``by`` are columns of both, say a
    construct, within which a person has an ability each."""
    nodes = F.array(*[F.lit(float(t)) for t in EAP_GRID])
    edges = F.concat(F.array(F.lit(float("-inf"))), F.col("thresholds"), F.array(F.lit(float("inf"))))
    above = lambda t, cut: 1 / (1 + F.exp(-F.col("a") * (t - cut)))
    by_score = params.select(*by, F.col("item_id").alias("question_id"), "a", F.posexplode(F.transform(F.slice(edges, 1, F.size(edges) - 1), lambda low, i: F.struct(low.alias("low"), F.get(edges, i + 1).alias("high")))).alias("_k", "_cut"))
    p = F.transform(nodes, lambda t: F.log(F.greatest(F.lit(CLIP), above(t, F.col("_cut.low")) - above(t, F.col("_cut.high")))))
    dim = by_score.select(*by, "question_id", (F.col("_k") + 1).cast("int").alias("_score"), p.alias("lp"))
    cells = matrix.withColumn("_score", F.col("item_score").cast("int")).join(dim, [*by, "question_id", "_score"])
    summed = cells.groupBy(*by, "user_id").agg(*[F.sum(F.element_at("lp", q + 1)).alias(f"s{q}") for q in range(len(EAP_GRID))])
    return _eap(summed.select(*by, "user_id", F.array(*[F.col(f"s{q}") for q in range(len(EAP_GRID))]).alias("ll")))


def _residuals(matrix: DataFrame, abilities: DataFrame, params: DataFrame) -> DataFrame:
    dim = params.select(F.col("item_id").alias("question_id"), "b")
    p = 1 / (1 + F.exp(-(F.col("theta") - F.col("b"))))
    df = matrix.filter(F.col("item_score").isNotNull()).join(dim, "question_id").join(abilities.select("user_id", "theta"), "user_id")
    df = df.withColumn("p", F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), p)))
    return df.withColumn("w", F.col("p") * (1 - F.col("p"))).withColumn("r2", (F.col("item_score") - F.col("p")) ** 2)


def item_fit(matrix: DataFrame, abilities: DataFrame, params: DataFrame) -> DataFrame:
    """Residual fit per item: plain mean square residuals (``outfit``, ``infit``) and the textbook
    standardised pair (``outfit_ms``, ``infit_ms``)."""
    df = _residuals(matrix, abilities, params)
    return df.groupBy(F.col("question_id").alias("item_id")).agg(
        (F.sum(F.col("w") * F.col("r2")) / F.sum("w")).alias("infit"), F.avg("r2").alias("outfit"),
        (F.sum("r2") / F.sum("w")).alias("infit_ms"), F.avg(F.col("r2") / F.col("w")).alias("outfit_ms"),
    )


def information_criteria(matrix: DataFrame, abilities: DataFrame, params: DataFrame, params_per_item: int = 1) -> DataFrame:
    """AIC and BIC of the likelihood at the EAP abilities (unit slopes): one row."""
    df = _residuals(matrix, abilities, params)
    ll = F.sum(F.when(F.col("item_score") == 1, F.log("p")).otherwise(F.log(1 - F.col("p"))))
    s = df.agg(ll.alias("loglik"), F.count_distinct("question_id").alias("k"))
    out = s.join(abilities.agg(F.count(F.lit(1)).alias("n")))
    k = F.col("k") * params_per_item
    return out.select("loglik", k.alias("n_params"), "n", (-2 * F.col("loglik") + 2 * k).alias("aic"), (-2 * F.col("loglik") + k * F.log("n")).alias("bic"))


def item_curves(params: DataFrame, points: int = 100) -> DataFrame:
    """P(correct) of binary items on an even grid from -4 to 4."""
    step = 8.0 / (points - 1)
    grid = params.withColumn("theta", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i * step - 4)))
    return grid.select("item_id", F.round("theta", 4).alias("theta"), F.lit("P(correct)").alias("category"),
                       F.round(1 / (1 + F.exp(-F.col("a") * (F.col("theta") - F.col("b")))), 6).alias("probability"))


def category_curves(params: DataFrame, points: int = 100) -> DataFrame:
    """Category probabilities of graded items (``a, thresholds``) on the same grid."""
    step = 8.0 / (points - 1)
    g = params.withColumn("theta", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i * step - 4)))
    above = F.transform("thresholds", lambda t: 1 / (1 + F.exp(-F.col("a") * (F.col("theta") - t))))
    upper = F.concat(F.array(F.lit(1.0)), above)
    lower = F.concat(above, F.array(F.lit(0.0)))
    cats = F.zip_with(upper, lower, lambda x, y: F.greatest(F.lit(0.0), x - y))
    rows = g.select("item_id", "theta", F.posexplode(cats).alias("k", "p"))
    return rows.select("item_id", F.round("theta", 4).alias("theta"), F.concat(F.lit("Cat "), (F.col("k") + 1).cast("string")).alias("category"), F.round("p", 6).alias("probability"))


def wright_map(abilities: DataFrame, params: DataFrame) -> DataFrame:
    """Persons and items on one scale: ``kind, id, position``."""
    persons = abilities.select(F.lit("person").alias("kind"), F.col("user_id").alias("id"), F.col("theta").alias("position"))
    return persons.unionByName(params.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.col("b").alias("position")))


def rank_hardest(items: DataFrame, difficulty: str = "difficulty", places: int = 2) -> DataFrame:
    """Competition rank of the rounded difficulty, hardest first."""
    df = items.withColumn("_k", -F.bround(F.col(difficulty), places))
    hist = cumulative_histogram(df, [], "_k").select("_k", (F.col("n_before") + 1).cast("int").alias("rank_hardest"))
    return df.join(hist, "_k", "left").drop("_k")


def item_difficulty_glmm(matrix: DataFrame, item_effects: str = "auto", max_iter: int = 100, tol: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Logit mixed model of answers: (items with difficulty, se, interval, rank; one-row model summary).

    Persons are random with an estimated sd; items are fixed or, from ten items on, random.
    """
    spark = matrix.sparkSession
    matrix = materialize(matrix.select("user_id", "question_id", "item_score"), "matrix")
    cells = matrix.filter(F.col("item_score").isNotNull())
    stats = cells.groupBy(F.col("question_id").alias("item")).agg(F.count(F.lit(1)).alias("n"), F.avg("item_score").alias("p"))
    size = cells.agg(F.count_distinct("user_id").alias("u"), F.count_distinct("question_id").alias("i"), F.count(F.lit(1)).alias("o")).first()
    mode = item_effects if item_effects in ("random", "fixed") else ("random" if size["i"] >= FEW_ITEMS else "fixed")
    error = "need at least 5 persons and 2 items" if size["u"] < 5 or size["i"] < 2 else None
    schema = "item string, difficulty double, se double"
    if error:
        fitted, meta = spark.createDataFrame([], schema), (None, None, False)
    else:
        fit = fit_binary(matrix, "rasch", "skip", max_iter, tol, sd=None, item_prior=mode == "random")
        rows = [(i, float(d), float(s)) for i, d, s in zip(fit.items, fit.params["d"], fit.params["se"])] if not fit.error else []
        fitted, meta = spark.createDataFrame(rows, schema), (fit.params.get("sigma_item"), fit.params.get("sigma_person"), fit.converged)
        error = fit.error
    d, se = F.col("difficulty"), F.col("se")
    items = stats.join(fitted, "item", "left").select("item", "n", "p", "difficulty", "se", (d - 1.96 * se).alias("ci_low"), (d + 1.96 * se).alias("ci_high"))
    flat = stats.filter((F.col("p") == 0) | (F.col("p") == 1)).agg(F.count(F.lit(1)).alias("n_degenerate"))
    head = spark.createDataFrame(
        [(mode, meta[0], meta[1], size["u"], size["i"], size["o"], meta[2], mode == "random" and size["i"] < FEW_ITEMS, error)],
        "mode string, sigma_item double, sigma_person double, n_persons bigint, n_items bigint, n_obs bigint, converged boolean, few_items boolean, error string")
    return rank_hardest(items), head.join(flat).withColumn("size_note", rasch_size_note(F.col("n_persons")))

"""Closed-form numeric columns and label bands."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core import clip

Z975 = 1.959963984540054  # fixed value: normal quantile at 0.975


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def normalized_gain(pre: Column, post: Column, top: float) -> Column:
    """(post - pre) / (top - pre) clipped to [-1, 1]; NULL at the ceiling."""
    return F.when(F.lit(top) > pre, clip((post - pre) / (F.lit(top) - pre), -1.0, 1.0))


def spearman_brown(r: Column) -> Column:
    return F.when(r > -1, 2 * r / (1 + r))


def wilson_low(k: Column, n: Column, z: float = Z975) -> Column:
    return F.when(n > 0, F.greatest(F.lit(0.0), _wilson(k, n, z, -1)))


def wilson_high(k: Column, n: Column, z: float = Z975) -> Column:
    return F.when(n > 0, F.least(F.lit(1.0), _wilson(k, n, z, +1)))


def _wilson(k: Column, n: Column, z: float, sign: int) -> Column:
    p = k / n
    half = F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (p + z * z / (2 * n) + sign * z * half) / (1 + z * z / n)


def fisher_bound(r: Column, n: Column, sign: int, z: float = Z975) -> Column:
    """End of the Fisher-z interval; NULL for n <= 3 or |r| = 1."""
    inner = F.atanh(r) + sign * z / F.sqrt(n - 3)
    return F.when((n > 3) & (F.abs(r) < 1), F.tanh(inner))


def irt_loading(a: Column) -> Column:
    return a / F.sqrt(1 + a * a)


def percent(n: Column, total: Column, places: int = 2) -> Column:
    return F.when(total > 0, F.round(n / total * 100, places)).otherwise(F.lit(0.0))


def aic(loglik: Column, k: Column) -> Column:
    return -2 * loglik + 2 * k


def bic(loglik: Column, k: Column, n: Column) -> Column:
    return -2 * loglik + k * F.log(n)


def band(c: Column, cuts: Sequence[tuple[float, str]], otherwise: str, missing: str | None = None) -> Column:
    """Label of the first cut that ``c`` reaches (cuts in descending order)."""
    out = F.when(c.isNull() | F.isnan(c.cast("double")), F.lit(missing))
    for cut, label in cuts:
        out = out.when(c >= cut, F.lit(label))
    return out.otherwise(F.lit(otherwise))


# Cut points and labels.
D_CUTS = [(0.8, "large"), (0.5, "medium"), (0.2, "small")]
ETA_CUTS = [(0.14, "large"), (0.06, "medium"), (0.01, "small")]
W_CUTS = [(0.5, "large"), (0.3, "medium"), (0.1, "small")]
R_CUTS = [(0.50, "Large (≥.50)"), (0.30, "Medium (≥.30)"), (0.10, "Small (≥.10)")]
ALPHA_CUTS = [(0.90, "🟢 Excellent (≥0.90)"), (0.80, "🟢 Good (≥0.80)"), (0.70, "🟡 Acceptable (≥0.7)")]
SB_CUTS = [(0.90, "🟢 Excellent (≥0.90)"), (0.80, "🟢 Good (≥0.80)"), (0.70, "🟡 Acceptable (≥0.70)")]
CR_CUTS = [(0.80, "🟢 Good (≥0.8)"), (0.70, "🟡 Acceptable (≥0.7)")]
AVE_CUTS = [(0.50, "🟢 Adequate (≥0.5)")]
INDEX_CUTS = [(0.75, "🟢 High (≥0.75)"), (0.50, "🟡 Moderate (0.50–0.74)"), (0.25, "🟠 Developing (0.25–0.49)")]
AGREEMENT_CUTS = [(0.80, "strong"), (0.65, "moderate"), (0.50, "weak")]
KAPPA_CUTS = [(0.8, "almost perfect"), (0.6, "substantial"), (0.4, "moderate"), (0.2, "fair"), (0.0, "slight")]


def d_label(d: Column) -> Column:
    return band(F.abs(d), D_CUTS, "negligible")


def eta_label(e: Column) -> Column:
    return band(e, ETA_CUTS, "negligible")


def w_label(w: Column) -> Column:
    return band(w, W_CUTS, "negligible")


def r_label(r: Column) -> Column:
    return band(F.abs(r), R_CUTS, "Negligible (<.10)", "—")


def alpha_badge(a: Column) -> Column:
    return band(a, ALPHA_CUTS, "🔴 Poor (<0.7)", "—")


def spearman_brown_badge(v: Column) -> Column:
    return band(v, SB_CUTS, "🔴 Poor (<0.70)", "—")


def cr_badge(v: Column) -> Column:
    return band(v, CR_CUTS, "🔴 Poor (<0.7)", "—")


def ave_badge(v: Column) -> Column:
    return band(v, AVE_CUTS, "🔴 Inadequate (<0.5)", "—")


def index_band(v: Column) -> Column:
    return band(v, INDEX_CUTS, "🔴 Emerging (<0.25)", "Insufficient data")


def agreement_label(v: Column) -> Column:
    return band(v, AGREEMENT_CUTS, "poor")


def kappa_band(k: Column) -> Column:
    """Strict lower bounds, unlike the other bands."""
    out = F.when(k.isNull() | F.isnan(k), F.lit("undefined"))
    for cut, label in KAPPA_CUTS:
        out = out.when(k > cut, F.lit(label))
    return out.otherwise(F.lit("poor"))


def rasch_size_note(n: Column) -> Column:
    """Which published sample-size step a Rasch run of n persons reaches."""
    return (
        F.when(n < 30, "below 30: exploratory only")
        .when(n < 50, "30-49: about ±1 logit at 95%")
        .when(n < 100, "50-99: about ±1 logit at 99%")
        .when(n < 150, "100-149: about ±½ logit at 95%")
    )


def twopl_size_note(n: Column) -> Column:
    return F.when(n < 200, "below 200: smallest simulated sample not reached").when(
        n < 500, "below 500: discriminations likely unreliable"
    )


def proportion_half_width(n: Column) -> Column:
    """Worst-case 95 % half width of a proportion, in percentage points."""
    return F.when(n >= 3, 100 * 1.96 * F.sqrt(0.25 / n))


# Rational approximation of the normal quantile (Wichura 1988, AS 241), coefficients low to high order.
_AS241_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4,
     3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
_AS241_MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1,
     1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_AS241_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(float(c))
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse normal CDF as a JVM expression (about 1e-16 accurate)."""
    q = p - 0.5
    central = 0.180625 - q * q
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    side = F.when(q < 0, F.lit(-1.0)).otherwise(F.lit(1.0))

    def quotient(x: Column, pair) -> Column:
        return polynomial(x, pair[0]) / polynomial(x, pair[1])

    return (
        F.when(F.abs(q) <= 0.425, q * quotient(central, _AS241_CENTRE))
        .when(r <= 5, side * quotient(r - 1.6, _AS241_MIDDLE))
        .otherwise(side * quotient(r - 5, _AS241_TAIL))
    )


LOG_2PI = math.log(2 * math.pi)

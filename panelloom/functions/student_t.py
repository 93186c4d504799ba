"""Student-t tail and quantile for one-row statistics tables (Spark has neither)."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ship these functions inside the job: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny = 1e-300

    def guard(v: float) -> float:
        return v if abs(v) > tiny else tiny

    c, d = 1.0, 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    total = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1.0 / guard(1.0 + even * d), guard(1.0 + even / c)
        total *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1.0 / guard(1.0 + odd * d), guard(1.0 + odd / c)
        total *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return total
    raise ArithmeticError(f"no convergence for a={a}, b={b}, x={x}")


def _log_gamma_step(a: float) -> float:
    """log gamma(a + 1/2) - log gamma(a); by its series for large a, where the difference would cancel."""
    if a < 1e4:
        return math.lgamma(a + 0.5) - math.lgamma(a)
    return 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3)


def _regularised_beta(a: float, b: float, x: float, y: float) -> float:
    """Incomplete beta ratio at x; y is 1 - x, given apart because it may be tiny."""
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    log_x = math.log1p(-y) if y < 0.5 else math.log(x)
    log_y = math.log1p(-x) if x < 0.5 else math.log(y)
    gammas = _log_gamma_step(a) if b == 0.5 else math.lgamma(a + b) - math.lgamma(a)
    scale = math.exp(gammas - math.lgamma(b) + a * log_x + b * log_y)
    if x < (a + 1.0) / (a + b + 2.0):
        return scale * _beta_fraction(a, b, x) / a
    return 1.0 - scale * _beta_fraction(b, a, y) / b


def tail(t: float, freedom: float) -> float:
    """P(|T| >= |t|) for a Student-t variable."""
    if math.isinf(t):
        return 0.0
    if freedom > 1e7:  # the normal tail and the first term of its expansion; the next is below 1e-12
        density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        return math.erfc(abs(t) / math.sqrt(2)) + density * (abs(t) ** 3 + abs(t)) / (2 * freedom)
    whole = freedom + t * t
    return _regularised_beta(freedom / 2.0, 0.5, freedom / whole, t * t / whole)


def quantile(level: float, freedom: float) -> float:
    """The t that encloses ``level`` of the distribution, found by bisection on the tail."""
    low, high = 0.0, 1.0
    while tail(high, freedom) > 1.0 - level:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if tail(middle, freedom) > 1.0 - level:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


def _pairwise(fn, first: pd.Series, freedom: pd.Series) -> pd.Series:
    """Apply ``fn`` per row, once per distinct pair; missing or df < 1 gives a missing result."""
    known: dict[tuple[float, float], float] = {}
    out = []
    for a, f in zip(first, freedom):
        if pd.isna(a) or pd.isna(f) or f < 1:
            out.append(None)
            continue
        if (a, f) not in known:
            known[a, f] = fn(float(a), float(f))
        out.append(known[a, f])
    return pd.Series(out, dtype="float64")


def two_sided_p(t: Column | str, freedom: Column) -> Column:
    """Two-sided p-value of a t statistic."""

    @F.pandas_udf("double")
    def p(t: pd.Series, f: pd.Series) -> pd.Series:
        return _pairwise(tail, t, f)

    return p(t, freedom.cast("double"))


def two_sided_quantile(level: Column, freedom: Column) -> Column:
    """Critical t value for a confidence level."""

    @F.pandas_udf("double")
    def q(level: pd.Series, f: pd.Series) -> pd.Series:
        return _pairwise(quantile, level, f)

    return q(level.cast("double"), freedom.cast("double"))

"""Distances, lower bounds, metrics and covariances as column expressions. Distances are sums without a root."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def squared_euclid(q, c) -> Column:
    return _sum(F.zip_with(q, c, lambda a, b: (a - b) * (a - b)))


def manhattan(q, c) -> Column:
    return _sum(F.zip_with(q, c, lambda a, b: F.abs(a - b)))


def dtw(q: Column, c: Column, band: int | None = None) -> Column:
    """Dynamic time warping by nested folds: the outer one goes along c and carries the last column of the table, the
    inner one builds the next column. band limits |i - j|."""
    n = F.size(q)
    start = F.concat(F.array(F.lit(0.0)), F.array_repeat(F.lit(INF), n))

    def cell(prev, now, i, j):
        cost = (F.element_at(c, j) - F.element_at(q, i)) * (F.element_at(c, j) - F.element_at(q, i))
        best = F.least(F.element_at(now, i), F.element_at(prev, i + 1), F.element_at(prev, i))
        value = cost + best
        return value if band is None else F.when(F.abs(i - j) <= band, value).otherwise(F.lit(INF))

    def column(prev, j):
        return F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(INF)), lambda now, i: F.concat(now, F.array(cell(prev, now, i, j))))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.size(c)), start, column), -1)


def envelope(a: Column, r: int, upper: bool) -> Column:
    """Per place the largest (or smallest) value within r places, inside the array."""
    pick = F.array_max if upper else F.array_min
    return F.transform(a, lambda x, i: pick(F.slice(a, F.greatest(i - r, F.lit(0)) + 1, F.least(i + r, F.size(a) - 1) - F.greatest(i - r, F.lit(0)) + 1)))


def lb_keogh(q: Column, c: Column, r: int) -> Column:
    """Lower bound of banded DTW: c against the envelope of q."""
    both = F.arrays_zip(envelope(q, r, True).alias("u"), envelope(q, r, False).alias("l"), c.alias("c"))
    return _sum(F.transform(both, lambda x: F.when(x["c"] > x["u"], (x["c"] - x["u"]) * (x["c"] - x["u"])).when(x["c"] < x["l"], (x["c"] - x["l"]) * (x["c"] - x["l"])).otherwise(F.lit(0.0))))


def lb_enhanced(q: Column, c: Column, r: int) -> Column:
    return F.greatest(lb_keogh(q, c, r), lb_keogh(c, q, r))


def lb_term(v: Column, kw: Column, lo: Column, up: Column, p: int = 2) -> Column:
    """One place's bound: how far v lies outside the envelope, given as distances lo and up from kw, to the power p."""
    d = F.abs(v - kw)
    over = d - F.when(v <= kw, lo).otherwise(up)
    return F.when(over <= 0, F.lit(0.0)).otherwise(F.pow(over, F.lit(float(p))))


def weighted_lp(v: Column, q: Column, weight: Column, slack: Column, p: int) -> Column:
    """weight * (|v - q| - slack) ** p outside the slack, 0 inside; p = 0 is the step 0 or 1. Equal values give 0."""
    d = F.abs(v - q)
    return weight * F.when((d <= slack) | (d == 0), F.lit(0.0)).otherwise(F.pow(d - slack, F.lit(float(p))))


def likelihood(y: Column, mean: Column, var: Column) -> Column:
    """The normal density of y."""
    return F.exp(-(y - mean) * (y - mean) / (2 * var)) / F.sqrt(2 * F.pi() * var)


def absolute_error(y, m) -> Column:
    return F.abs(y - m)


def square_error(y, m) -> Column:
    return (y - m) * (y - m)


def standard_square_error(y, m, var, compat: bool = False) -> Column:
    """The squared error over the variance; compat squares the squared error once more."""
    e = square_error(y, m)
    return (e * e if compat else e) / var


def negative_log_likelihood(y, m, var, compat: bool = False) -> Column:
    return (standard_square_error(y, m, var, compat) + F.log(var) + F.log(2 * F.pi())) / 2


def covariance(name: str, d2: Column, length: float, sill: float) -> Column:
    """Covariance at the squared distance d2. gaussian takes the sill as a standard deviation, the others as a variance;
    constant is 1 / sill."""
    d = F.sqrt(d2)
    if name == "gaussian":
        return sill**2 * F.exp(-d2 / (2 * length**2))
    if name == "exponential":
        return sill * F.exp(-d / (2 * length))
    if name == "matern5":
        a = d * 5.0**0.5 / length
        return sill * (1 + a + a * a / 3) * F.exp(-a)
    if name == "constant":
        return F.lit(1.0 / sill) + 0 * d2
    raise ValueError(name)

"""Predictive distributions given as quantile arrays: column expressions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialgrid.functions import exprs as X

# fixed values: quantile levels, horizons (share of budget), Brier thresholds
LEVELS = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)
HORIZONS = (0.01, 0.02, 0.05, 0.10, 0.20, 0.50, 1.00)
UNIT_PROBS = (0.0, *LEVELS, 1.0)
TIME_PROBS = (0.001, *LEVELS, 0.999)


def unit_support(q: Column) -> Column:
    """Quantiles on [0, 1] with the end points added."""
    return F.concat(F.array(F.lit(0.0)), q, F.array(F.lit(1.0)))


def log_time_support(q: Column) -> Column:
    """Log quantiles extended on both sides by the last gap, at least 0.25."""
    logs = F.transform(q, lambda v: F.ln(F.greatest(v, F.lit(1e-12))))
    lo = F.greatest(F.get(logs, 1) - F.get(logs, 0), F.lit(0.25))
    hi = F.greatest(F.get(logs, 6) - F.get(logs, 5), F.lit(0.25))
    return F.concat(F.array(F.get(logs, 0) - lo), logs, F.array(F.get(logs, 6) + hi))


def _segment(support: Column, x: Column) -> Column:
    """Index of the last support point <= x, kept inside the segments."""
    at = F.size(F.filter(support, lambda s: s <= x)) - 1
    return F.greatest(F.lit(0), F.least(F.lit(len(UNIT_PROBS) - 2), at))


def _bound(build, **cols: Column) -> Column:
    return F.get(F.transform(F.array(F.struct(*[c.alias(k) for k, c in cols.items()])), build), 0)


def _cdf(support: Column, probs: tuple, x: Column) -> Column:
    p = F.lit(list(probs))

    def build(t):
        s, i, v = t["s"], t["i"], t["x"]
        left, right = F.get(s, i), F.get(s, i + 1)
        width = right - left
        frac = F.when(width > 1e-12, (v - left) / width).otherwise(0.0)
        frac = F.greatest(F.lit(0.0), F.least(F.lit(1.0), frac))
        return F.get(p, i) + frac * (F.get(p, i + 1) - F.get(p, i))

    return _bound(build, s=support, x=x, i=_segment(support, x))


def unit_cdf(q: Column, x: Column) -> Column:
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.when(v <= 0, 0.0).when(v >= 1, 1.0).otherwise(_cdf(unit_support(q), UNIT_PROBS, v))


def unit_nll(q: Column, x: Column) -> Column:
    v = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), x))
    p = F.lit(list(UNIT_PROBS))

    def build(t):
        s, i = t["s"], t["i"]
        density = (F.get(p, i + 1) - F.get(p, i)) / F.greatest(F.get(s, i + 1) - F.get(s, i), F.lit(1e-4))
        return -F.ln(F.greatest(F.lit(1e-12), F.least(F.lit(1e6), density)))

    return _bound(build, s=unit_support(q), i=_segment(unit_support(q), v))


def _trapezoid(values: list[Column], probs: tuple) -> Column:
    return reduce(lambda a, b: a + b, [
        (values[i] + values[i + 1]) / 2.0 * (probs[i + 1] - probs[i]) for i in range(len(probs) - 1)])


def _crps(support: Column, probs: tuple, x: Column) -> Column:
    def build(t):
        parts = []
        for i, p in enumerate(probs):
            r = t["x"] - F.get(t["s"], i)
            parts.append(F.greatest(p * r, (p - 1.0) * r))
        return 2.0 * _trapezoid(parts, probs)

    return _bound(build, s=support, x=x)


def unit_crps(q: Column, x: Column) -> Column:
    """Twice the trapezoid of the pinball loss over the nine probability nodes."""
    return _crps(unit_support(q), UNIT_PROBS, x)


def _moments(support: Column, probs: tuple) -> Column:
    def build(t):
        v = [F.get(t["s"], i) for i in range(len(probs))]
        mean = _trapezoid(v, probs)
        second = _trapezoid([a * a for a in v], probs)
        return F.struct(mean.alias("mean"), F.sqrt(F.greatest(second - mean * mean, F.lit(0.0))).alias("std"))

    return _bound(build, s=support)


def unit_moments(q: Column) -> Column:
    return _moments(unit_support(q), UNIT_PROBS)


def time_support(q: Column) -> Column:
    return F.transform(log_time_support(q), lambda v: F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), v))))


def time_cdf(q: Column, x: Column) -> Column:
    lx = F.ln(F.greatest(x, F.lit(1e-12)))
    s = log_time_support(q)
    return F.when(lx <= F.get(s, 0), 0.0).when(lx >= F.get(s, 8), 1.0).otherwise(_cdf(s, TIME_PROBS, lx))


def time_nll(q: Column, x: Column) -> Column:
    lx = F.ln(F.greatest(x, F.lit(1e-12)))
    p = F.lit(list(TIME_PROBS))

    def build(t):
        s, i = t["s"], t["i"]
        density = (F.get(p, i + 1) - F.get(p, i)) / F.greatest(F.get(s, i + 1) - F.get(s, i), F.lit(1e-6))
        return -F.ln(F.greatest(F.lit(1e-12), F.least(F.lit(1e12), density))) + t["x"]

    return _bound(build, s=log_time_support(q), i=_segment(log_time_support(q), lx), x=lx)


def time_crps(q: Column, x: Column) -> Column:
    return _crps(time_support(q), TIME_PROBS, x)


def time_moments(q: Column) -> Column:
    return _moments(time_support(q), TIME_PROBS)


def quantile_at(support: Column, probs: tuple, level: Column) -> Column:
    """Value of the piecewise-linear quantile curve at a probability."""
    p = F.lit(list(probs))
    right = F.greatest(F.lit(1), F.least(F.lit(len(probs) - 1), F.size(F.filter(p, lambda v: v <= level))))

    def build(t):
        r, s = t["r"], t["s"]
        frac = (t["l"] - F.get(p, r - 1)) / F.greatest(F.get(p, r) - F.get(p, r - 1), F.lit(1e-12))
        return F.get(s, r - 1) + frac * (F.get(s, r) - F.get(s, r - 1))

    return _bound(build, s=support, r=right, l=level)


def horizon_step(budget: Column, h: float) -> Column:
    return F.least(budget, F.greatest(F.lit(1.0), F.ceil(budget * h).cast("double")))


def running_max(a: Column) -> Column:
    """Cumulative maximum along an array."""
    return F.aggregate(a, F.lit([]).cast("array<double>"), lambda acc, v: F.concat(
        acc, F.array(F.greatest(F.get(acc, F.size(acc) - 1), v))))


def mix(w: Column, a: Column, b: Column) -> Column:
    """(1-w) a + w b, element by element."""
    return F.zip_with(a, b, lambda x, y: (1 - w) * x + w * y)

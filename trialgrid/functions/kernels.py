"""Small vectorised numpy kernels used inside tasks where Spark has no expression."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: constants of the 64-bit splittable generator
GAMMA = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB


def mix64(state: np.ndarray) -> np.ndarray:
    z = (state ^ (state >> np.uint64(30))) * np.uint64(MIX_1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
    return z ^ (z >> np.uint64(31))


def generated_masks(seeds: np.ndarray, count: int = 6, maximum: int = 45) -> np.ndarray:
    """Bit mask of the 6-of-45 set each 64-bit key generates (partial shuffle, unbiased draws)."""
    seeds = seeds.astype(np.uint64)
    n = len(seeds)
    with np.errstate(over="ignore"):
        state = seeds.copy()
        pool = np.tile(np.arange(1, maximum + 1, dtype=np.int64), (n, 1))
        rows = np.arange(n)
        mask = np.zeros(n, dtype=np.int64)
        for i in range(count):
            upper = maximum - i
            ceiling = np.uint64(2**64 - 1 - (2**64 % upper))
            state = state + np.uint64(GAMMA)
            value = mix64(state)
            redo = value > ceiling
            while redo.any():
                state = np.where(redo, state + np.uint64(GAMMA), state)
                value = np.where(redo, mix64(state), value)
                redo = value > ceiling
            pick = i + (value % np.uint64(upper)).astype(np.int64)
            chosen = pool[rows, pick]
            pool[rows, pick] = pool[:, i]
            mask |= np.left_shift(np.int64(1), chosen)
    return mask


@F.pandas_udf(T.LongType())
def generator_mask(seed: pd.Series) -> pd.Series:
    return pd.Series(generated_masks(seed.to_numpy(dtype=np.int64)))


# keeps the optimizer from evaluating the generator a second time in an inferred null check
generator_mask = generator_mask.asNondeterministic()


def ranked_sets(ranks: np.ndarray, size: int = 6, maximum: int = 45) -> np.ndarray:
    """(ranks, size): the sets at lexicographic ranks, by greedy searches in the binomial columns."""
    rest, out = math.comb(maximum, size) - 1 - ranks.astype(np.int64), np.empty((len(ranks), size), np.int32)
    for i in range(size):
        column = np.array([math.comb(c, size - i) for c in range(maximum)], np.int64)
        c = np.searchsorted(column, rest, side="right") - 1
        rest, out[:, i] = rest - column[c], maximum - c
    return out


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def ranked_set(rank: pa.Array) -> pa.Array:
    there, sets = rank.is_valid(), ranked_sets(rank.drop_null().to_numpy(zero_copy_only=False))
    ends = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))]).astype(np.int32) * sets.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(sets.ravel()), mask=pc.invert(there))


# evaluated once for the numbers and their mask
ranked_set = ranked_set.asNondeterministic()


def time_warp_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact multivariate DTW, normalised by the two lengths, for a batch of pairs.

    a: (pairs, la, width), b: (pairs, lb, width). The dynamic programme runs over cells,
    vectorised across all pairs of the batch.
    """
    x, y = (np.ascontiguousarray(v.transpose(2, 1, 0)) for v in (a, b))  # pairs are last: cells are worked on as whole rows of memory
    cost = np.zeros((a.shape[1], b.shape[1], a.shape[0]))
    for i, j in zip(x, y):
        step = i[:, None] - j[None]
        step *= step
        cost += step
    return warped(np.sqrt(cost, out=cost) / math.sqrt(a.shape[2]))


def warped(cost: np.ndarray) -> np.ndarray:
    """Time warping distance over cell costs (i, j, pairs), normalised by the two lengths."""
    la, lb = cost.shape[:2]
    none = np.full(cost.shape[2], np.inf)
    before = [np.zeros(cost.shape[2]), *[none] * lb]
    for i in range(la):
        now = [none]
        for j in range(lb):
            least = np.minimum(now[j], before[j + 1])
            np.minimum(least, before[j], out=least)
            now.append(np.add(least, cost[i, j], out=least))
        before = now
    return before[lb] / (la + lb)


def slope_estimate(x: np.ndarray) -> np.ndarray:
    """Derivative estimate along axis 1: mean of the backward and the central difference; one-sided at the ends."""
    out = np.zeros_like(x)
    if x.shape[1] > 1:
        out[:, 0] = x[:, 1] - x[:, 0]
        out[:, -1] = x[:, -1] - x[:, -2]
        back = x[:, 1:-1] - x[:, :-2]
        wide = (x[:, 2:] - x[:, :-2]) / 2.0
        out[:, 1:-1] = (back + wide) / 2.0
    return out


def resample(x: np.ndarray, length: int) -> np.ndarray:
    """Linear resampling of (pairs, l, width) to ``length`` rows."""
    l = x.shape[1]
    if l == length:
        return x
    at = np.linspace(0.0, 1.0, length) * (l - 1)
    lo = np.minimum(np.floor(at).astype(int), l - 2)
    frac = (at - lo)[None, :, None]
    return x[:, lo] * (1 - frac) + x[:, lo + 1] * frac


# ---------------------------------------------------------------- distribution functions

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-np.asarray(x, dtype=float) / math.sqrt(2.0))


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse normal CDF by safeguarded Newton steps on erfc."""
    p = np.clip(np.asarray(p, dtype=float), 1e-300, 1 - 1e-16)
    q = np.minimum(p, 1 - p)
    t = np.sqrt(-2 * np.log(q))
    x = -(t - np.log(np.maximum(t, 1e-9) * math.sqrt(2 * math.pi) + 1.0) / np.maximum(t, 1e-9))
    x = np.minimum(x, 0.0)
    for _ in range(60):
        err = normal_cdf(x) - q
        dens = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        u = err / np.maximum(dens, 1e-300)
        step = u / (1 + x * u / 2)
        x = x - np.clip(step, -1, 1)
        if np.all(np.abs(step) < 1e-14 * (1 + np.abs(x))):
            break
    return np.where(p < 0.5, x, -x)


def bivariate_normal_cdf(h: np.ndarray, k: np.ndarray, rho: np.ndarray) -> np.ndarray:
    """P(X<=h, Y<=k): Phi(h)Phi(k) plus the integral of the density over the correlation angle."""
    h, k, rho = (np.asarray(v, dtype=float) for v in (h, k, rho))
    top = np.arcsin(np.clip(rho, -0.999999, 0.999999))
    theta = top[:, None] * (_NODES[None, :] + 1) / 2
    s = np.sin(theta)
    e = np.exp((s * (h * k)[:, None] - ((h * h + k * k) / 2)[:, None]) / np.cos(theta) ** 2)
    integral = (e * _WEIGHTS[None, :]).sum(axis=1) * top / 2
    return np.clip(normal_cdf(h) * normal_cdf(k) + integral / (2 * math.pi), 0.0, 1.0)


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (x, a, b)))
    lg = np.vectorize(math.lgamma, otypes=[float])
    xc = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(xc) + b * np.log1p(-xc))
    swap = xc > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - xc, xc)
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 300):
        num = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        d = 1 / _safe(1 + num * d)
        c = _safe(1 + num / c)
        f = f * d * c
        num = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d = 1 / _safe(1 + num * d)
        c = _safe(1 + num / c)
        delta = d * c
        f = f * delta
        if np.all(np.abs(delta - 1) < 1e-15):
            break
    value = front * f / p
    value = np.where(swap, 1 - value, value)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))


def _safe(v: np.ndarray) -> np.ndarray:
    return np.where(np.abs(v) < 1e-300, 1e-300, v)


def beta_quantile(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inverse of beta_cdf by bisection."""
    p, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (p, a, b)))
    lo, hi = np.zeros_like(p), np.ones_like(p)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = beta_cdf(mid, a, b) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def gamma_upper(s: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma: series below s+1, continued fraction above."""
    s, x = np.broadcast_arrays(np.asarray(s, dtype=float), np.asarray(x, dtype=float))
    lg = np.vectorize(math.lgamma, otypes=[float])
    xs = np.maximum(x, 1e-300)
    front = np.exp(s * np.log(xs) - xs - lg(s))
    term = 1 / s
    total = term.copy() if isinstance(term, np.ndarray) else np.array(term)
    for n in range(1, 1000):
        term = term * xs / (s + n)
        total = total + term
        if np.all(np.abs(term) < 1e-16 * np.abs(total)):
            break
    series = 1 - front * total
    b = xs + 1 - s
    c = np.full_like(xs, 1e300)
    d = 1 / _safe(b)
    f = d.copy()
    for n in range(1, 1000):
        an = -n * (n - s)
        b = b + 2
        d = 1 / _safe(an * d + b)
        c = _safe(b + an / c)
        f = f * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return np.where(x <= 0, 1.0, np.where(xs < s + 1, series, front * f))


@F.pandas_udf(T.DoubleType())
def normal_cdf_col(x: pd.Series) -> pd.Series:
    return pd.Series(normal_cdf(x.to_numpy()))


@F.pandas_udf(T.DoubleType())
def normal_quantile_col(p: pd.Series) -> pd.Series:
    return pd.Series(normal_quantile(p.to_numpy()))


@F.pandas_udf(T.DoubleType())
def chi_square_tail(stat: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(gamma_upper(df.to_numpy(dtype=float) / 2, stat.to_numpy(dtype=float) / 2))


@F.pandas_udf(T.DoubleType())
def beta_quantile_col(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(beta_quantile(p.to_numpy(), a.to_numpy(), b.to_numpy()))


@F.pandas_udf(T.DoubleType())
def bivariate_cdf_col(h: pd.Series, k: pd.Series, rho: pd.Series) -> pd.Series:
    return pd.Series(bivariate_normal_cdf(h.to_numpy(), k.to_numpy(), rho.to_numpy()))


def occupied_components(masks: np.ndarray, side: int = 7) -> np.ndarray:
    """4-connected component count of occupied cells on a grid, by label spreading over a batch."""
    n = len(masks)
    cells = ((masks[:, None] >> np.arange(side * side)[None, :]) & 1).astype(bool).reshape(n, side, side)
    label = np.where(cells, np.arange(1, side * side + 1).reshape(1, side, side), 0)
    for _ in range(side * side):
        wide = np.pad(label, ((0, 0), (1, 1), (1, 1)))
        best = np.maximum.reduce([wide[:, 1:-1, 1:-1], wide[:, :-2, 1:-1], wide[:, 2:, 1:-1],
                                  wide[:, 1:-1, :-2], wide[:, 1:-1, 2:]])
        best = np.where(cells, best, 0)
        if (best == label).all():
            break
        label = best
    own = np.arange(1, side * side + 1).reshape(1, side, side)
    return ((label == own) & cells).sum(axis=(1, 2))


@F.pandas_udf(T.IntegerType())
def component_count(cell_mask: pd.Series) -> pd.Series:
    return pd.Series(occupied_components(cell_mask.to_numpy(dtype=np.int64)).astype("int32"))

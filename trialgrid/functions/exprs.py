"""Column builders: everything here stays inside Catalyst (no Python workers)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SET_MAX = 45
SET_SIZE = 6
TOTAL_SETS = math.comb(SET_MAX, SET_SIZE)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: Column) -> Column:
    """Six digits with plain IEEE arithmetic; decimal ties and their float neighbours go up, never -0.0."""
    return F.floor(c * 1e6 + 0.501) / F.lit(1e6)


def hash_uniform(*parts: Column | str) -> Column:
    """Uniform in [0, 1) from the first 52 bits of md5 over the ':'-joined key parts."""
    text = F.concat_ws(":", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(2.0**52)


def bisect_right(values: Column, size: int, x: Column) -> Column:
    """Number of leading entries of the sorted array ``values`` that are <= x (binary search)."""
    steps = [1 << b for b in reversed(range(max(1, size.bit_length())))]
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda lo, s: F.when(F.get(values, lo + s - 1) <= x, lo + s).otherwise(lo),
    )


def number_array(values) -> Column:
    return F.lit([float(v) for v in values])


# ---------------------------------------------------------------- sets of numbers

def mask_of(numbers: Column) -> Column:
    """Bit n set for each number n."""
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda m, n: m.bitwiseOR(shift_one(n)))


def shift_one(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int"))


def numbers_of(mask: Column, maximum: int = SET_MAX) -> Column:
    return F.filter(
        F.lit(list(range(1, maximum + 1))), lambda n: mask.bitwiseAND(shift_one(n)) != 0
    )


def hits(mask_a: Column, mask_b: Column) -> Column:
    return F.bit_count(mask_a.bitwiseAND(mask_b)).cast("bigint")


def deviations(numbers: Column, target: Column) -> Column:
    return F.zip_with(numbers, target, lambda a, b: a - b)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double"))


def array_mean(a: Column) -> Column:
    return array_sum(a) / F.size(a)


def array_var_pop(a: Column) -> Column:
    """Running-mean update (one pass, stable)."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))

    def step(acc, v):
        n = acc["n"] + 1.0
        d = v.cast("double") - acc["m"]
        m = acc["m"] + d / n
        return F.struct(n.alias("n"), m.alias("m"), (acc["s"] + d * (v.cast("double") - m)).alias("s"))

    return F.aggregate(a, start, step, lambda acc: acc["s"] / acc["n"])


def array_std_pop(a: Column) -> Column:
    return F.sqrt(array_var_pop(a))


def positional_mae(numbers: Column, target: Column) -> Column:
    return array_mean(F.transform(deviations(numbers, target), lambda d: F.abs(d)))


def signed_bias(numbers: Column, target: Column) -> Column:
    return array_mean(deviations(numbers, target))


def gaps(numbers: Column) -> Column:
    """Successive differences of an array."""
    return F.zip_with(
        F.slice(numbers, 1, F.size(numbers) - 1),
        F.slice(numbers, 2, F.size(numbers) - 1),
        lambda a, b: b - a,
    )


def entropy_of_counts(counts: Column, denominator: float | Column) -> Column:
    """-sum p ln p / denominator over an array of non-negative masses (0 for an empty one)."""
    def finish(acc):
        # -sum p ln p = ln T - (sum c ln c) / T
        return F.when(acc["t"] > 0, (F.ln(acc["t"]) - acc["l"] / acc["t"]) / denominator).otherwise(0.0)

    def step(acc, c):
        log = F.when(c > 0, c * F.ln(c.cast("double"))).otherwise(0.0)
        return F.struct((acc["t"] + c).alias("t"), (acc["l"] + log).alias("l"))

    return F.aggregate(counts, F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("l")), step, finish)


# ---------------------------------------------------------------- combination rank

def _binomials(k: int) -> list[int]:
    return [math.comb(c, k) for c in range(SET_MAX)]


def rank_of(numbers: Column) -> Column:
    """Lexicographic rank of a sorted 6-of-45 set: complement of the combinatorial number of 45-n."""
    terms = [
        F.get(F.lit(_binomials(SET_SIZE - i)), (SET_MAX - F.get(numbers, i)).cast("int"))
        for i in range(SET_SIZE)
    ]
    return (F.lit(TOTAL_SETS - 1) - reduce(lambda a, b: a + b, terms)).cast("bigint")


def set_at_rank(rank: Column) -> Column:
    """Inverse of rank_of: six greedy binary searches in the binomial columns."""
    table = F.lit([_binomials(k) for k in range(SET_SIZE + 1)])

    def step(acc, k):
        column = F.get(table, k)
        c = bisect_right(column, SET_MAX, acc["rest"]) - 1
        return F.struct(
            (acc["rest"] - F.get(column, c)).cast("bigint").alias("rest"),
            F.concat(acc["numbers"], F.array((SET_MAX - c).cast("int"))).alias("numbers"),
        )

    start = F.struct(
        (F.lit(TOTAL_SETS - 1) - rank).cast("bigint").alias("rest"),
        F.lit([]).cast("array<int>").alias("numbers"),
    )
    return F.aggregate(F.lit(list(range(SET_SIZE, 0, -1))), start, step, lambda a: a["numbers"])


# ---------------------------------------------------------------- circular and bit helpers

def circular_distance(a: Column, b: Column, modulus: int = TOTAL_SETS) -> Column:
    d = F.abs(a - b)
    return F.least(d, F.lit(modulus) - d)


def circular_mean_array(values: Column, modulus: int = TOTAL_SETS) -> Column:
    """Rounded (half-even) circular mean of an array of positions on a ring."""
    turn = 2.0 * math.pi / modulus
    s = array_mean(F.transform(values, lambda v: F.sin(v * turn)))
    c = array_mean(F.transform(values, lambda v: F.cos(v * turn)))
    angle = F.atan2(s, c)
    angle = F.when(angle < 0, angle + 2.0 * math.pi).otherwise(angle)
    return F.pmod(F.rint(angle / turn).cast("bigint"), F.lit(modulus))


def bit_width(n: int) -> int:
    return n.bit_length()


def bit_transitions(x: Column, width: int) -> Column:
    inner = F.call_function("shiftright", x, F.lit(1))
    return F.bit_count(x.bitwiseXOR(inner).bitwiseAND(F.lit((1 << (width - 1)) - 1)))


def rotate_left(x: Column, by: int, width: int) -> Column:
    left = F.call_function("shiftleft", x, F.lit(by))
    right = F.call_function("shiftright", x, F.lit(width - by))
    return left.bitwiseOR(right).bitwiseAND(F.lit((1 << width) - 1))


def _move_bits(x: Column, width: int, place) -> Column:
    parts = []
    for src in range(width):
        bit = F.call_function("shiftright", x, F.lit(src)).bitwiseAND(F.lit(1).cast("bigint"))
        parts.append(F.call_function("shiftleft", bit, F.lit(place(src))))
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def bit_transform(x: Column, name: str, width: int = 20) -> Column:
    """Coordinate transforms of a 20-bit key."""
    if name == "identity":
        return x
    if name == "gray":
        return x.bitwiseXOR(F.call_function("shiftright", x, F.lit(1)))
    if name == "bit_reverse":
        return _move_bits(x, width, lambda s: width - 1 - s)
    if name == "rotate7":
        return rotate_left(x, 7, width)
    if name == "deinterleave":
        half = width // 2
        return _move_bits(x, width, lambda s: s // 2 + (half if s % 2 else 0))
    raise ValueError(name)


# ---------------------------------------------------------------- ids and JSON

def short_digest(*parts: Column | str, length: int = 24) -> Column:
    """First hex digits of SHA-256 over the compact JSON object of the named parts, keys sorted."""
    named = sorted([(p if isinstance(p, str) else str(i), col(p)) for i, p in enumerate(parts)], key=lambda t: t[0])
    return F.substring(F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in named])), 256), 1, length)


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    e = F.transform(values, lambda v: F.exp(v - top))
    total = array_sum(e)
    return F.transform(e, lambda v: v / total)


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))

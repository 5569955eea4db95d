"""Shape, transition and rolling features of number sets in an ordered series."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.functions import exprs as X
from trialgrid.operators.ordered import framed, running

# fixed values: primes up to 45
PRIMES = [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43]
ANGLE = 2.0 * math.pi / 45.0
VIEWS = ("raw", "grid", "circle", "distribution", "transition", "context")


def rounded(a: Column) -> Column:
    return F.transform(a, X.r6)


def _d(a: Column) -> Column:
    return F.transform(a, lambda v: v.cast("double"))


def _scaled(a: Column, by: float) -> Column:
    return F.transform(a, lambda v: v / F.lit(by))


def _pairs(a: Column, fn) -> Column:
    items = [F.get(a, i) for i in range(6)]
    return F.array(*[fn(p, q) for p, q in combinations(items, 2)])


def _share(a: Column, test) -> Column:
    return F.size(F.filter(a, test)) / F.lit(6.0)


def _shares(a: Column, key, cells: int) -> Column:
    """Share of the six entries whose key equals 0..cells-1."""
    def one(k):
        return _share(a, lambda v: key(v) == k)

    return F.array(*[one(k) for k in range(cells)])


def raw_view(n: Column) -> Column:
    def build(x):
        n, g, m, v = x["n"], x["g"], x["m"], x["v"]
        total = X.array_sum(g)
        ent = -X.array_sum(F.transform(g, lambda t: t / total * F.ln(t / total + 1e-12))) / math.log(5)
        first, last = F.get(n, 0), F.get(n, 5)
        return F.concat(
            _scaled(n, 45.0), _scaled(g, 44.0),
            F.array(first / 45.0, last / 45.0, (last - first) / 44.0, m * 6 / 270.0, m / 45.0,
                    (F.get(n, 2) + F.get(n, 3)) / 90.0, v / 1936.0, F.sqrt(v) / 44.0),
            _scaled(F.array_sort(g), 44.0),
            F.array(ent, (F.array_position(g, F.array_max(g)) - 1) / 4.0, (F.array_position(g, F.array_min(g)) - 1) / 4.0))

    return _with(build, n=n, g=X.gaps(n), m=X.array_mean(n), v=X.array_var_pop(n))


def _with(build, **cols: Column) -> Column:
    """Evaluate shared inputs once per row and hand them to ``build`` as a struct."""
    s = F.struct(*[c.alias(k) for k, c in cols.items()])
    return F.get(F.transform(F.array(s), build), 0)


def _rows(n: Column) -> Column:
    return F.transform(n, lambda v: F.floor((v - 1) / 7).cast("int"))


def _cols(n: Column) -> Column:
    return F.transform(n, lambda v: (v - 1) % 7)


def grid_view(n: Column) -> Column:
    def pairs(r, c, fn):
        return F.array(*[fn(F.get(r, i) - F.get(r, j), F.get(c, i) - F.get(c, j)) for i, j in combinations(range(6), 2)])

    def measured(x):
        r, c = x["r"], x["c"]
        return _with(build, n=x["n"], r=r, c=c,
                     e=pairs(r, c, lambda a, b: F.sqrt((a * a + b * b).cast("double"))),
                     mh=pairs(r, c, lambda a, b: (F.abs(a) + F.abs(b)).cast("double")))

    def build(x):
        n, r, c = x["n"], x["r"], x["c"]
        cells = F.zip_with(r, c, lambda a, b: F.struct(a.alias("r"), b.alias("c")))
        e, mh = x["e"], x["mh"]
        flip_lr = F.size(F.filter(cells, lambda s: F.array_contains(n, (s["r"] * 7 + (6 - s["c"]) + 1).cast("int"))))
        flip_ud = F.size(F.filter(cells, lambda s: F.array_contains(n, ((6 - s["r"]) * 7 + s["c"] + 1).cast("int"))))
        return F.concat(
            F.array(F.array_min(r) / 6.0, F.array_max(r) / 6.0, F.array_min(c) / 6.0, F.array_max(c) / 6.0,
                    X.array_mean(r) / 6.0, X.array_mean(c) / 6.0, X.array_std_pop(r) / 3.0, X.array_std_pop(c) / 3.0,
                    X.array_std_pop(F.zip_with(r, c, lambda a, b: a - b)) / 6.0,
                    X.array_mean(e) / math.sqrt(72), X.array_std_pop(e) / math.sqrt(72),
                    X.array_mean(mh) / 12.0, X.array_std_pop(mh) / 12.0),
            _shares(r, lambda v: v, 7), _shares(c, lambda v: v, 7),
            F.array(F.greatest(flip_lr, flip_ud) / 6.0, F.size(F.filter(e, lambda v: v <= math.sqrt(2.0))) / F.lit(15.0),
                    X.array_var_pop(F.concat(r, c)) / 9.0))

    return _with(measured, n=n, r=_rows(n), c=_cols(n))


def circle_view(n: Column) -> Column:
    turn = 2.0 * math.pi

    def located(x):
        a = x["a"]
        return _with(measured, a=a, co=F.transform(a, F.cos), si=F.transform(a, F.sin))

    def measured(x):
        a, co, si = x["a"], x["co"], x["si"]

        def chord(i, j):
            dx, dy = F.get(co, i) - F.get(co, j), F.get(si, i) - F.get(si, j)
            return F.sqrt(dx * dx + dy * dy)

        cross = [F.get(co, i) * F.get(si, (i + 1) % 6) - F.get(co, (i + 1) % 6) * F.get(si, i) for i in range(6)]
        return _with(build, a=a, cx=X.array_mean(co), cy=X.array_mean(si), cross=F.array(*cross),
                     ch=F.array(*[chord(i, j) for i, j in combinations(range(6), 2)]),
                     ed=F.array(*[chord((i + 1) % 6, i) for i in range(6)]),
                     ag=F.array(*[(F.get(a, i + 1) - F.get(a, i)) / turn for i in range(5)],
                                (F.get(a, 0) + turn - F.get(a, 5)) / turn))

    def build(x):
        a, ch, ed, ag, cx, cy = (x[k] for k in ("a", "ch", "ed", "ag", "cx", "cy"))
        area = F.abs(X.array_sum(x["cross"])) / 2.0
        return F.concat(
            _scaled(a, turn),
            F.array(X.array_mean(ch) / 2, X.array_std_pop(ch) / 2, F.array_min(ch) / 2, F.array_max(ch) / 2),
            ag, F.array(1.0 - F.sqrt(cx * cx + cy * cy), cx, cy, area / 3.0, X.array_sum(ed) / 12.0),
            _scaled(ed, 2.0), F.array(F.array_max(ag)),
            F.transform(a, lambda v: F.cos(v - F.get(a, 0))), F.transform(a, lambda v: F.sin(v - F.get(a, 0))))

    return _with(located, a=F.transform(n, lambda v: (v - 1) * F.lit(ANGLE)))


def distribution_view(n: Column) -> Column:
    span = F.get(n, 5) - F.get(n, 0)
    same = sum((F.floor((F.get(n, i) - 1) / 10) == F.floor((F.get(n, j) - 1) / 10)).cast("int") for i, j in combinations(range(6), 2))
    return F.concat(
        F.array(_share(n, lambda v: v % 2 == 1), _share(n, lambda v: v <= 22)),
        _shares(n, lambda v: F.least(F.floor((v - 1) / 10), F.lit(4)), 5), _shares(n, lambda v: v % 10, 10),
        F.array(_share(n, lambda v: v.isin(PRIMES)), F.size(F.filter(X.gaps(n), lambda g: g == 1)) / F.lit(5.0), same / 15.0,
                X.array_sum(n) / 270.0, span / 44.0, F.lit(6.0) / F.greatest(span + 1, F.lit(6))))


def transition_view(n: Column, p: Column, q: Column) -> Column:
    def centre(a, f):
        return X.array_mean(F.transform(a, f))

    row, column = (lambda v: F.floor((v - 1) / 7)), (lambda v: (v - 1) % 7)
    co, si = (lambda v: F.cos((v - 1) * F.lit(ANGLE))), (lambda v: F.sin((v - 1) * F.lit(ANGLE)))

    def summary(a):
        return F.struct(a.alias("n"), centre(a, row).alias("r"), centre(a, column).alias("c"), centre(a, co).alias("x"),
                        centre(a, si).alias("y"), X.array_std_pop(a).alias("s"), X.gaps(a).alias("g"))

    def norm(a, b):
        return F.sqrt(a * a + b * b)

    def change(a, b):
        raw = F.sqrt(X.array_sum(F.zip_with(a["n"], b["n"], lambda u, v: F.pow((u - v) / 45.0, F.lit(2.0))))) / math.sqrt(6)
        return [raw, norm(a["r"] - b["r"], a["c"] - b["c"]) / math.sqrt(72), norm(a["x"] - b["x"], a["y"] - b["y"]) / 2.0]

    def build(t):
        a, b, c = t["a"], t["b"], t["c"]
        one, two = change(a, b), change(a, c)
        overlap = lambda u, v: F.size(F.array_intersect(u["n"], v["n"])) / 6.0
        gap = F.sqrt(X.array_sum(F.zip_with(a["g"], b["g"], lambda u, v: F.pow((u - v).cast("double"), F.lit(2.0))))) / (44.0 * math.sqrt(5))
        last = lambda u: F.get(u["n"], 5) - F.get(u["n"], 0)
        full = F.array(
            overlap(a, b), F.when(q.isNotNull(), overlap(a, c)).otherwise(0.0),
            X.array_mean(F.zip_with(a["n"], b["n"], lambda u, v: F.abs(u - v))) / 44.0,
            (a["r"] - b["r"]) / 6.0, (a["c"] - b["c"]) / 6.0, (a["x"] - b["x"]) / 2.0, (a["y"] - b["y"]) / 2.0,
            (X.array_sum(a["n"]) - X.array_sum(b["n"])) / 264.0, (last(a) - last(b)) / 44.0, (a["s"] - b["s"]) / 44.0,
            gap, *one, *[F.when(q.isNotNull(), v).otherwise(0.0) for v in two])
        return F.when(p.isNotNull(), full).otherwise(F.lit([0.0] * 17))

    return _with(build, a=summary(n), b=summary(p), c=summary(F.coalesce(q, n)))


def context_views(df: DataFrame, keys: Sequence[str], pos: str, windows: Sequence[int], numbers: str = "numbers",
                  prefix: str = "w") -> DataFrame:
    """34 rolling features over each trailing window, from one bounded frame of the widest window."""
    widest = max(windows)

    def build(d, k):
        w = Window.partitionBy(*k).orderBy(pos).rowsBetween(-(widest - 1), 0)
        return d.withColumn("_frame", F.collect_list(F.struct(pos, numbers)).over(w))

    out = framed(df, keys, pos, widest - 1, 0, build)
    for w in windows:
        recent = F.filter(F.col("_frame"), lambda s: s[pos] > F.col(pos) - w)
        out = out.withColumn(f"{prefix}{w}", _context_block(F.transform(recent, lambda s: s[numbers])))
    return out.drop("_frame")


def _context_block(frame: Column) -> Column:
    pair_positions = list(combinations(range(6), 2))

    def longest_repeat(codes):
        """Length of the longest run in a sorted array: the count of its most frequent entry."""
        start = F.struct(F.lit(-1).alias("v"), F.lit(0).alias("run"), F.lit(0).alias("best"))

        def step(acc, c):
            run = F.when(acc["v"] == c, acc["run"] + 1).otherwise(1)
            return F.struct(c.alias("v"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

        return F.aggregate(codes, start, step, lambda acc: acc["best"])

    def counted(t):
        rows, n = t["rows"], F.size(t["rows"])
        return _with(
            build, rows=rows, n=n, freq=F.transform(F.lit(list(range(1, 46))), lambda v: F.size(
                F.filter(rows, lambda r: F.array_contains(r, v))) / (n * 6.0)),
            codes=F.array_sort(F.flatten(F.transform(rows, lambda r: F.array(
                *[F.get(r, i) * 100 + F.get(r, j) for i, j in pair_positions])))),
            overlaps=F.zip_with(F.slice(rows, 1, n - 1), F.slice(rows, 2, n - 1),
                                lambda a, b: F.size(F.array_intersect(a, b)) / 6.0),
            disp=F.transform(rows, lambda r: X.array_std_pop(r) / 44.0))

    def build(t):
        n, freq, disp = t["n"], t["freq"], t["disp"]
        heat = lambda key, k: F.array(*[reduce(lambda a, b: a + b, [F.get(freq, v - 1) for v in range(1, 46) if key(v) == i])
                                        for i in range(k)])
        last = lambda i: F.get(disp, n - 1 - i)
        accel = F.when(n >= 3, (last(0) - last(1)) - (last(1) - last(2))).otherwise(0.0)
        return F.concat(
            heat(lambda v: (v - 1) // 9, 5),
            F.array(longest_repeat(t["codes"]) / n, F.when(n > 1, X.array_mean(t["overlaps"])).otherwise(0.0)),
            heat(lambda v: (v - 1) // 7, 7), heat(lambda v: (v - 1) % 7, 7), heat(lambda v: (v - 1) * 8 // 45, 8),
            F.array(X.entropy_of_counts(freq, math.log(45)), F.array_max(freq), X.array_mean(disp),
                    (last(0) - F.get(disp, 0)) / F.greatest(F.lit(1), n - 1), accel))

    return _with(counted, rows=frame)


def prefix_standardise(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """z of each row from the mean and population deviation of rows up to itself, clipped to +-8.

    Squares are summed around the key's overall mean-free first value to keep the variance stable.
    """
    v = F.col(value).cast("double")
    base = df.groupBy(*keys).agg(F.min(v).alias("_shift"))
    df = df.join(base, list(keys))
    d = v - F.col("_shift")
    run = running(df, keys, order, {"_n": ("count", F.lit(1)), "_s": ("sum", d), "_ss": ("sum", d * d)})
    mean = F.col("_s") / F.col("_n")
    std = F.sqrt(F.greatest(F.col("_ss") / F.col("_n") - mean * mean, F.lit(0.0)))
    z = (d - mean) / F.when(std < 1e-9, 1.0).otherwise(std)
    return run.withColumn(name, F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))).drop("_shift", "_n", "_s", "_ss")


def rank_features(df: DataFrame) -> DataFrame:
    """Delta, circular and bit features of a rank series with rank_1..rank_3 lags."""
    r, r1, r2, r3 = (F.col(c) for c in ("rank", "rank_1", "rank_2", "rank_3"))
    d1 = F.coalesce(r - r1, F.lit(0))
    d2 = F.when(r2.isNull(), 0).otherwise((r - r1) - (r1 - r2))
    d3 = F.when(r3.isNull(), 0).otherwise((r - r1) - 2 * (r1 - r2) + (r2 - r3))
    x = F.coalesce(r.bitwiseXOR(r1), F.lit(0))
    w = X.bit_width(X.TOTAL_SETS)
    return df.select(
        "round_no", "rank", d1.alias("delta_1"), d2.cast("bigint").alias("delta_2"), d3.cast("bigint").alias("delta_3"),
        F.abs(d1).alias("abs_delta"), F.signum(d1.cast("double")).cast("bigint").alias("delta_sign"),
        X.r6(d1 / X.TOTAL_SETS).alias("normalized_delta"),
        F.when(r1.isNull(), 0).otherwise(X.circular_distance(r, r1)).cast("bigint").alias("circular_delta"),
        F.bit_count(r).cast("bigint").alias("popcount"),
        F.when(r == 0, F.lit(w)).otherwise(w - F.length(F.bin(r))).cast("bigint").alias("leading_zeros"),
        F.when(r == 0, F.lit(w)).otherwise(F.bit_count((r.bitwiseAND(-r)) - 1)).cast("bigint").alias("trailing_zeros"),
        X.bit_transitions(r, w).cast("bigint").alias("bit_transitions"),
        x.alias("xor"), F.bit_count(x).cast("bigint").alias("xor_popcount"), X.rotate_left(x, 7, w).alias("rotated_xor"))


def component_counts(df: DataFrame) -> DataFrame:
    """(round_no, components) from (round_no, 49-bit cell mask), batch by batch."""
    from trialgrid.functions.kernels import occupied_components

    def kernel(batches):
        for pdf in batches:
            yield pdf[["round_no"]].assign(components=occupied_components(pdf["cells"].to_numpy()).astype("int64"))

    return df.mapInPandas(kernel, "round_no bigint, components bigint")

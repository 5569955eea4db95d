"""Resampling and statistical tests; randomness is a hash of (iteration, row key, salt), so it is repeatable."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.functions import exprs as X
from trialgrid.operators.landscape import KEY_SPACE, RADII, nearest_earlier, range_counts
from trialgrid.operators.ordered import fits_a_task, framed, position, quantiles, running, value_ranks


def iterations(n: int) -> Column:
    return F.explode(F.lit(list(range(n)))).alias("i")


HASH_BLOCKS = 1 << 12


def label_permutation(df: DataFrame, keys: Sequence[str], value: str, is_left: Column, unit: str, n: int, blocks: int | None = None) -> DataFrame:
    """Two-sided p of the mean difference under relabelling with the group sizes kept.

    Each iteration takes the n_left rows of a key with the lowest hash as the left group. Of large tables, blocks of the hash axis
    are counted and added up, and only the block that the last of these rows falls into is ordered. Keys are few.
    """
    base = df.select(*keys, F.col(value).alias("_v"), F.col(unit).alias("_u"), is_left.alias("_left"))
    obs = base.groupBy(*keys).agg(
        F.count_if("_left").alias("_nl"), F.count_if(~F.col("_left")).alias("_nr"), F.sum("_v").alias("_tot"),
        F.sum(F.when(F.col("_left"), F.col("_v"))).alias("_sl"))
    sim = base.select(*keys, "_v", "_u", iterations(n)).withColumn("_h", X.hash_uniform("i", "_u", F.lit("perm")))
    with_sizes = lambda d: d.join(F.broadcast(obs), list(keys)) if keys else d.crossJoin(F.broadcast(obs))
    if blocks is None and fits_a_task(df):
        joined = with_sizes(position(sim, [*keys, "i"], ["_h", "_u"], "_r"))
        s = joined.groupBy(*keys, "i", "_nl", "_nr", "_tot", "_sl").agg(F.sum(F.when(F.col("_r") < F.col("_nl"), F.col("_v"))).alias("_s"))
    else:
        by = [*keys, "i"]
        sim = sim.withColumn("_b", F.floor(F.col("_h") * (blocks or HASH_BLOCKS)))
        w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
        cells = sim.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_p"))
        cells = with_sizes(cells.select(*by, "_b", "_n", before("_n").alias("_before"), before("_p").alias("_below")))
        none = (F.col("_nl") == 0) & (F.col("_before") == 0)
        edge = cells.where(none | ((F.col("_before") < F.col("_nl")) & (F.col("_nl") <= F.col("_before") + F.col("_n"))))
        taken = sim.join(F.broadcast(edge.select(*by, "_b", (F.col("_nl") - F.col("_before")).alias("_take"))), [*by, "_b"])
        taken = taken.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h", "_u"))).where("_r <= _take")
        taken = taken.groupBy(*by).agg(F.sum("_v").alias("_in"))
        s = edge.join(taken, by, "left").withColumn("_s", F.when(F.col("_nl") > 0, F.col("_below") + F.coalesce("_in", F.lit(0.0))))
    gap = lambda x: F.abs(x / F.col("_nl") - (F.col("_tot") - x) / F.col("_nr"))
    return s.groupBy(*keys).agg(((F.count_if(gap(F.col("_s")) >= gap(F.col("_sl")) - 1e-9) + 1) / F.lit(n + 1)).alias("p"))


def fdr(df: DataFrame, keys: Sequence[str], p: str, tie: Sequence[str], name: str = "q") -> DataFrame:
    """Benjamini-Hochberg q values inside each family of tests."""
    w = Window.partitionBy(*keys)
    r = df.withColumn("_rank", F.row_number().over(w.orderBy(p, *tie))).withColumn("_m", F.count(F.lit(1)).over(w))
    adj = F.col(p) * F.col("_m") / F.col("_rank")
    suffix = w.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn(name, F.least(F.lit(1.0), F.min(adj).over(suffix))).drop("_rank", "_m")


def two_sample_ranks(df: DataFrame, keys: Sequence[str], value: str, is_left: Column) -> DataFrame:
    """Per key: n_left, n_right, U of the left group and the tie term, from value counts (no n x m pairs)."""
    d = df.select(*keys, F.col(value).alias("_v"), is_left.cast("int").alias("_l")).filter("_v IS NOT NULL")
    r = value_ranks(d, keys, "_v", {"_l": F.col("_l")})
    below_right = F.col("n_before") - F.col("_l_before")
    tied_right = F.col("n") - F.col("_l")
    return r.groupBy(*keys).agg(
        F.sum("_l").alias("n_left"), F.sum(tied_right).alias("n_right"),
        F.sum(F.col("_l") * (below_right + tied_right / 2.0)).alias("u"),
        F.sum((F.col("n") * F.col("n") * F.col("n") - F.col("n")).cast("double")).alias("ties"))


def cliffs_delta(df: DataFrame, keys: Sequence[str], value: str, is_left: Column) -> DataFrame:
    r = two_sample_ranks(df, keys, value, is_left)
    return r.select(*keys, "n_left", "n_right", (2 * F.col("u") / (F.col("n_left") * F.col("n_right")) - 1).alias("cliffs_delta"))


def mann_whitney(df: DataFrame, keys: Sequence[str], value: str, is_left: Column) -> DataFrame:
    """U with tie-corrected normal approximation (continuity 0.5); z is returned, p through the normal tail."""
    r = two_sample_ranks(df, keys, value, is_left)
    n1, n2 = F.col("n_left"), F.col("n_right")
    n = n1 + n2
    var = n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1.0)))
    u = F.greatest(F.col("u"), n1 * n2 - F.col("u"))
    return r.select(*keys, "n_left", "n_right", "u", ((u - n1 * n2 / 2.0 - 0.5) / F.sqrt(var)).alias("z"))


def cohens_d(df: DataFrame, keys: Sequence[str], value: str, is_left: Column) -> DataFrame:
    v = F.col(value).cast("double")
    a, b = F.when(is_left, v), F.when(~is_left, v)
    s = df.groupBy(*keys).agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"),
                              F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    return s.select(*keys, F.when(pooled > 1e-12, (F.col("m1") - F.col("m2")) / pooled).otherwise(0.0).alias("cohens_d"))


def wilcoxon(df: DataFrame, keys: Sequence[str], diff: str) -> DataFrame:
    """Signed-rank statistic of positive differences (zeros dropped) and its tie-corrected z, one-sided greater."""
    d = df.select(*keys, F.abs(diff).alias("_a"), (F.col(diff) > 0).cast("int").alias("_p")).filter("_a > 0")
    r = value_ranks(d, keys, "_a", {"_p": F.col("_p")})
    avg_rank = F.col("n_before") + (F.col("n") + 1) / 2.0
    s = r.groupBy(*keys).agg(F.sum(F.col("_p") * avg_rank).alias("statistic"), F.sum("n").alias("n"),
                             F.sum((F.col("n") * F.col("n") * F.col("n") - F.col("n")).cast("double")).alias("ties"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0
    return s.select(*keys, "statistic", "n", ((F.col("statistic") - n * (n + 1) / 4.0) / F.sqrt(var)).alias("z"))


def ks_uniform(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Largest gap between the empirical CDF and the uniform one."""
    r = value_ranks(df, keys, value)
    n, v = F.col("n_total"), F.col(value)
    return r.groupBy(*keys).agg(F.max(F.greatest((F.col("n_before") + F.col("n")) / n - v, v - F.col("n_before") / n)).alias("ks"),
                                F.max(n).alias("n"))


def neighbour_counts(points: DataFrame, radii: Sequence[int] = RADII) -> DataFrame:
    """(round, seed, radius, observed, baseline) around every exact key and a hashed random center."""
    e = points.filter("hits = 6").select("round", "seed", F.explode(F.lit(list(radii)).cast("array<bigint>")).alias("radius"))
    center = F.floor(X.hash_uniform("round", "seed", F.lit("center")) * KEY_SPACE)
    q = e.select("round", F.col("seed").alias("q_seed"), "radius", F.inline(F.array(
        F.struct(F.lit("observed").alias("kind"), F.col("seed").alias("c")),
        F.struct(F.lit("baseline").alias("kind"), center.alias("c")))))
    q = q.withColumn("lo", F.col("c") - F.col("radius")).withColumn("hi", F.col("c") + F.col("radius"))
    n = range_counts(points, q, ["round"], "seed", ["q_seed", "radius", "kind"], "lo", "hi", "n")
    return n.groupBy("round", F.col("q_seed").alias("seed"), "radius").agg(
        (F.max(F.when(F.col("kind") == "observed", F.col("n"))) - 1).alias("observed"),
        F.max(F.when(F.col("kind") == "baseline", F.col("n"))).alias("baseline"))


def basin_forecast(summary: DataFrame, min_history: int = 32, neighbours: int = 5, recent: int = 21) -> DataFrame:
    """Component and ensemble centers per round, each from rounds up to it."""
    scales = [f"scale_{r}" for r in RADII]
    h = position(summary.withColumn("axis", F.lit(0)), ["axis"], ["round"], "idx")
    levels = ["weighted_center", *scales]

    def med(a):
        s = F.array_sort(a)
        n = F.size(s)
        return (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2.0

    def build(d, k):
        w = Window.partitionBy(*k).orderBy("idx")
        frame = w.rowsBetween(-recent, 0)
        d = d.withColumns({f"_f_{c}": F.collect_list(c).over(frame) for c in levels})
        return d.withColumn("_next", F.lead("weighted_center").over(w) - F.col("weighted_center"))

    h = framed(h, ["axis"], "idx", recent, 1, build)
    h = h.withColumns({f"_d_{c}": med(X.gaps(F.col(f"_f_{c}"))) for c in levels})
    state = F.array(F.col("weighted_center") / 1e6, F.col("width") / 1e6, F.col("density_4_plus") * 1000,
                    F.col("density_5_plus") * 100000, F.col("entropy"), F.col("asymmetry"))
    # the first row has no move into it and is not a candidate
    pts = h.select("axis", "idx", state.alias("st"), "_next")
    near = nearest_earlier(pts.filter("idx >= 1"), ["axis"], "idx", "st", ["_next"], neighbours)
    move = near.groupBy("axis", F.col("pos").alias("idx")).agg(med(F.collect_list("_next")).alias("mv"))
    clip = lambda c: F.least(F.lit(KEY_SPACE - 1), F.greatest(F.lit(0), F.rint(c))).cast("bigint")
    wc = F.col("weighted_center")
    out = h.join(move, ["axis", "idx"]).filter(F.col("idx") >= min_history - 1).select(
        "round", clip(wc + F.col("_d_weighted_center")).alias("delta_center"), clip(wc + F.col("mv")).alias("state_center"),
        clip(med(F.array(*[F.col(c) + F.col(f"_d_{c}") for c in scales]))).alias("multi_scale_center"),
        clip(wc + F.col("asymmetry") * F.least(F.greatest(F.col("width") / 4, F.lit(1000.0)), F.lit(100000.0))).alias("gradient_center"))
    parts = F.array(*[F.col(c).cast("double") for c in ("delta_center", "state_center", "multi_scale_center", "gradient_center")])
    return out.withColumn("ensemble_center", clip(med(parts)))

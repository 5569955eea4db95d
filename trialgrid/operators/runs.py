"""Run tables: pairing, audits, trajectory features, dispersion, outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.functions import exprs as X
from trialgrid.operators.ordered import framed, median, quantiles, running

PAIR_KEYS = ["problem_id", "seed", "budget_type", "budget"]


def pair_sides(runs: DataFrame, columns: Sequence[str], baseline: str = "baseline", challenger: str = "challenger") -> DataFrame:
    """Full-outer pairing of the two algorithms on the pair keys; ``side`` says where a key was found."""
    def one(name, tag):
        return runs.filter(F.col("algorithm") == name).select(
            *PAIR_KEYS, F.lit(True).alias(f"has_{tag}"), *[F.col(c).alias(f"{c}_{tag}") for c in columns])

    j = one(baseline, "b").join(one(challenger, "c"), PAIR_KEYS, "full_outer")
    return j.withColumn("side", F.when(F.col("has_b").isNull(), "challenger_only").when(
        F.col("has_c").isNull(), "baseline_only").otherwise("both")).drop("has_b", "has_c")


def paired(runs: DataFrame) -> DataFrame:
    """Complete pairs with derived comparison metrics."""
    j = pair_sides(runs, ["run_id", "quality", "runtime", "target_reached", "problem_family", "domain"]).filter("side = 'both'")
    qb, qc = F.col("quality_b"), F.col("quality_c")
    objective = lambda q: 1.0 / F.greatest(q, F.lit(1e-300)) - 1.0
    ob, oc = objective(qb), objective(qc)
    diff = qc - qb
    best = F.greatest(qb, qc)
    return j.select(
        *PAIR_KEYS, F.col("problem_family_b").alias("problem_family"), F.col("domain_b").alias("domain"),
        diff.alias("quality_difference"), (oc / F.greatest(ob, F.lit(1e-15))).alias("objective_ratio"),
        F.log10((ob + 1e-15) / (oc + 1e-15)).alias("log10_gain"),
        (F.col("target_reached_c").cast("int") - F.col("target_reached_b").cast("int")).cast("bigint").alias("target_difference"),
        (F.col("runtime_c") / F.greatest(F.col("runtime_b"), F.lit(1e-12))).alias("runtime_ratio"),
        F.when(diff > 1e-12, "challenger").when(diff < -1e-12, "baseline").otherwise("tie").alias("winner"),
        best.alias("oracle_quality"), (best - qb).alias("baseline_regret"), (best - qc).alias("challenger_regret"))


def checks(*parts: DataFrame) -> DataFrame:
    """Union of (severity, check, rows) frames."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check(df: DataFrame, severity: str, name: str, bad: Column | None = None) -> DataFrame:
    """Number of rows of ``df`` that break an expectation."""
    n = F.count(F.lit(1)) if bad is None else F.count_if(bad)
    return df.agg(n.alias("rows")).select(F.lit(severity).alias("severity"), F.lit(name).alias("check"), "rows")


def runtime_outliers(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median, MAD, threshold max(5 med, med + 8 MAD) and count above, per key."""
    m = median(runs, keys, "runtime", "med")
    dev = runs.join(F.broadcast(m), list(keys)).withColumn("dev", F.abs(F.col("runtime") - F.col("med")))
    mad = median(dev, keys, "dev", "mad")
    lim = m.join(mad, list(keys)).withColumn("threshold", F.greatest(
        F.col("med") * 5, F.col("med") + 8 * F.greatest(F.col("mad"), F.lit(1e-12))))
    n = runs.join(F.broadcast(lim), list(keys)).groupBy(*keys).agg(F.count_if(F.col("runtime") > F.col("threshold")).alias("outliers"))
    return lim.join(n, list(keys))


def unpivot(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    return df.select(*ids, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])))


def feature_profile(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Count, missing, non-finite, unique, min, median, max, IQR and count beyond 10 IQR per feature."""
    u = unpivot(df, [], features)
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    # distinct values are pre-aggregated map-side; the count of the groups is the unique count
    base = u.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c")).groupBy("feature").agg(
        F.sum("c").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("c")).otherwise(0)).alias("missing"),
        F.sum(F.when(F.col("value").isNotNull() & ~finite, F.col("c")).otherwise(0)).alias("non_finite"),
        F.count("value").alias("unique"), F.min(F.when(finite, F.col("value"))).alias("minimum"),
        F.max(F.when(finite, F.col("value"))).alias("maximum"))
    q = quantiles(u.filter(finite), ["feature"], "value", [0.25, 0.5, 0.75], "_q").select(
        "feature", F.get("_q", 0).alias("q25"), F.get("_q", 1).alias("median"), F.get("_q", 2).alias("q75"))
    iqr = F.col("q75") - F.col("q25")
    far = u.join(F.broadcast(q), "feature").groupBy("feature").agg(
        F.count_if((F.col("value") < F.col("q25") - 10 * iqr) | (F.col("value") > F.col("q75") + 10 * iqr)).alias("beyond_10_iqr"))
    return base.join(q, "feature").join(far, "feature").withColumn("iqr", iqr)


def replicate_dispersion(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, range, count and relative deviation over replicates."""
    return unpivot(df, keys, features).groupBy(*keys, "feature").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.count("value").alias("replicates")
    ).withColumn("relative_std", F.col("std") / F.greatest(F.abs("mean"), F.lit(1e-12)))


def enriched_traces(traces: DataFrame) -> DataFrame:
    """Running best (minimum), improvement and previous objective of each run."""
    t = running(traces, ["run_id"], ["step"], {"best": ("min", F.col("objective"))})

    def build(d, k):
        w = Window.partitionBy(*k).orderBy("step")
        return d.withColumns({"prev_objective": F.lag("objective").over(w), "prev_best": F.lag("best").over(w), "prev_step": F.lag("step").over(w)})

    t = framed(t, ["run_id"], "step", 1, 0, build)
    return t.withColumn("improvement", F.coalesce(F.col("prev_best") - F.col("best"), F.lit(0.0)))


def trajectory_features(traces: DataFrame, cutoffs: Sequence[float]) -> DataFrame:
    """Early-trajectory features per (run, cutoff) from the prefix up to the cutoff (first row if empty)."""
    t = enriched_traces(traces).withColumn("cutoff", F.explode(F.lit([float(c) for c in cutoffs])))
    p = t.filter((F.col("fraction") <= F.col("cutoff") + 1e-12) | (F.col("step") == 1))
    last = lambda c: F.max_by(c, "step")
    inner = (F.col("step") > 1) & F.col("prev_objective").isNotNull() & F.col("objective").isNotNull()
    before, now = (F.when(inner, F.col(c)) for c in ("prev_objective", "objective"))
    # corr itself divides by zero where a run stands still, and a condition around an aggregate doesn't keep it from being evaluated
    moving = F.try_divide(F.covar_pop(before, now), F.sqrt(F.var_pop(before) * F.var_pop(now)))
    # slope against step / last step: regr_slope(best, step) x last step
    a = p.groupBy("run_id", "cutoff").agg(
        last("fraction").alias("observed_fraction"), F.max("step").alias("observed_steps"),
        last("objective").alias("objective_last"), last("best").alias("best_so_far"),
        F.sum("improvement").alias("improvement_sum"),
        F.coalesce(F.regr_slope("best", "step") * F.max("step"), F.lit(0.0)).alias("improvement_slope"),
        F.when((F.count("prev_objective") >= 2), moving).alias("ac"),
        F.coalesce(F.avg(F.abs(F.col("objective") - F.col("prev_objective"))), F.lit(0.0)).alias("transition_mean"),
        F.avg((F.col("improvement") <= 0).cast("double")).alias("stagnation_fraction"),
        F.max("failure_signal").alias("failure_signal_max"))
    return a.withColumn("autocorrelation", F.coalesce(F.nanvl("ac", F.lit(0.0)), F.lit(0.0))).drop("ac")

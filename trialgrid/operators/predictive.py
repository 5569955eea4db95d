"""Metrics, calibration, survival and pooling over prediction tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.functions import exprs as X
from trialgrid.functions import quantdist as Q
from trialgrid.operators.ordered import running, value_ranks
from trialgrid.session import checkpoint_dir

EPS = 1e-12


def scopes(df: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]], aggs: Sequence[Column]) -> DataFrame:
    """Same aggregates at several scopes in one pass (grouping sets), with a scope name."""
    cols = [F.col(d) for d in dims]
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.grouping_id().alias("_gid"), *aggs)
    name = F.lit("overall")
    for s in sets:
        if s:
            gid = sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in s)
            name = F.when(F.col("_gid") == gid, "_x_".join(s)).otherwise(name)
    return out.withColumn("scope", name).drop("_gid")


def distribution_rows(df: DataFrame, kind: str = "unit", q: str = "q", observed: str = "observed") -> DataFrame:
    """Add cdf (PIT), nll, crps, mean and std columns for each predictive row."""
    a, x = F.col(q), F.col(observed)
    fn = (Q.unit_cdf, Q.unit_nll, Q.unit_crps, Q.unit_moments) if kind == "unit" else (Q.time_cdf, Q.time_nll, Q.time_crps, Q.time_moments)
    out = df.withColumns({"pit": fn[0](a, x), "nll": fn[1](a, x), "crps": fn[2](a, x), "_m": fn[3](a)})
    return out.withColumns({"pred_mean": F.col("_m.mean"), "pred_std": F.col("_m.std")}).drop("_m")


def distribution_aggs(q: str = "q", observed: str = "observed") -> list[Column]:
    a, x = F.col(q), F.col(observed)
    inside = lambda i, j: F.avg(((x >= F.get(a, i)) & (x <= F.get(a, j))).cast("int"))
    err = [F.avg((x <= F.get(a, i)).cast("int")) - lv for i, lv in enumerate(Q.LEVELS)]
    return [F.count(F.lit(1)).alias("rows"), F.avg("nll").alias("nll"), F.avg("crps").alias("crps"), F.avg("pit").alias("pit_mean"),
            F.var_pop("pit").alias("pit_variance"), inside(1, 5).alias("coverage_80"), inside(0, 6).alias("coverage_90"),
            F.avg(F.get(a, 5) - F.get(a, 1)).alias("width_80"), F.avg(F.get(a, 6) - F.get(a, 0)).alias("width_90"),
            F.avg(F.abs(x - F.get(a, 3))).alias("median_mae"), F.sqrt(F.avg((x - F.get(a, 3)) * (x - F.get(a, 3)))).alias("median_rmse"),
            F.avg(F.abs(x - F.col("pred_mean"))).alias("mean_mae"),
            (reduce(lambda p, r: p + r, [F.abs(e) for e in err]) / len(err)).alias("calibration_mae"),
            F.greatest(*[F.abs(e) for e in err]).alias("calibration_max_abs")]


def ranking_scores(df: DataFrame, keys: Sequence[str], observed: Column, score: str) -> DataFrame:
    """ROC AUC and average precision per key from value counts of the score."""
    d = df.select(*keys, score, observed.cast("int").alias("_y"))
    r = value_ranks(d, keys, score, {"_y": F.col("_y")})
    neg = F.col("n") - F.col("_y")
    neg_before = F.col("n_before") - F.col("_y_before")
    # at the threshold "score >= this value": everything from here upwards is selected
    selected = F.col("n_total") - F.col("n_before")
    hit = F.col("_y_total") - F.col("_y_before")
    return r.groupBy(*keys).agg(
        (F.sum(F.col("_y") * (neg_before + neg / 2.0)) / F.nullif(F.max("_y_total") * (F.max("n_total") - F.max("_y_total")), F.lit(0))).alias("roc_auc"),
        (F.sum(F.col("_y") * hit / selected) / F.nullif(F.max("_y_total"), F.lit(0))).alias("average_precision"))


def binary_scores(df: DataFrame, keys: Sequence[str], observed: Column, p: str, bins: int = 10) -> DataFrame:
    """Brier, log loss, expected and maximal calibration gap per key (bins combined first)."""
    y = observed.cast("double")
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(p)))
    c = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), q))
    b = F.least(F.floor(q * bins), F.lit(bins - 1)).alias("_b")
    cell = df.groupBy(*keys, b).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("ys"), F.sum(q).alias("ps"), F.sum((y - q) * (y - q)).alias("sq"),
        F.sum(-(y * F.ln(c) + (1 - y) * F.ln(1 - c))).alias("ll"))
    gap = F.abs(F.col("ys") - F.col("ps"))
    n = F.sum("n")
    return cell.groupBy(*keys).agg(n.alias("rows"), (F.sum("ys") / n).alias("prevalence"), (F.sum("ps") / n).alias("mean_probability"),
                                   (F.sum("sq") / n).alias("brier"), (F.sum("ll") / n).alias("log_loss"), (F.sum(gap) / n).alias("ece"),
                                   F.max(gap / F.col("n")).alias("max_gap"))


def reliability(df: DataFrame, observed: Column, p: str, bins: int = 10) -> DataFrame:
    """One row per bin, empty bins kept."""
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(p)))
    g = df.groupBy(F.least(F.floor(q * bins), F.lit(bins - 1)).cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(q).alias("mean_probability"), F.avg(observed.cast("double")).alias("empirical_rate"))
    allbins = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return allbins.join(g, "bin", "left").withColumns({
        "rows": F.coalesce("rows", F.lit(0)), "lower_bound": F.col("bin") / bins, "upper_bound": (F.col("bin") + 1) / bins,
        "gap": F.abs(F.col("mean_probability") - F.col("empirical_rate"))})


# ------------------------------------------------------------------ survival

def survival_labels(runs: DataFrame) -> DataFrame:
    """Event flag, duration in steps (budget when censored) and duration fraction."""
    event = F.col("target_reached") & F.col("passage").isNotNull()
    d = F.when(event, F.col("passage")).otherwise(F.col("budget"))
    return runs.withColumns({"event": event, "duration": d, "duration_fraction": d / F.col("budget")})


def at_horizons(df: DataFrame) -> DataFrame:
    """Explode to horizons: observable and outcome at each."""
    cells = F.array(*[F.struct(F.lit(i).alias("h"), F.lit(h).alias("horizon"), Q.horizon_step(F.col("budget"), h).alias("h_step"))
                      for i, h in enumerate(Q.HORIZONS)])
    e = df.select("*", F.inline(cells))
    out = F.col("event") & (F.col("duration") <= F.col("h_step"))
    return e.withColumns({"outcome": out, "observable": out | (F.col("duration") >= F.col("h_step"))})


def out_of_fold_reach(labels: DataFrame, keys: Sequence[str], fold: str, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """Reach probability per (keys, fold): smoothed event share of the other folds at each horizon, made monotone."""
    from trialgrid.operators.folds import out_of_fold_sums
    h = at_horizons(labels).filter("observable")
    s = out_of_fold_sums(h, [*keys, "h"], fold, {"n": F.lit(1), "y": F.col("outcome").cast("int")})
    s = s.withColumn("p", (F.col("y") + alpha) / (F.col("n") + alpha + beta))
    a = s.groupBy(*keys, fold).agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "p"))), lambda t: t["p"]).alias("_p"))
    return a.withColumn("reach", Q.running_max(F.col("_p"))).drop("_p")


def survival_rows(df: DataFrame) -> DataFrame:
    """Interval likelihood, restricted mean and expected penalised runtime of each row."""
    steps = [Q.horizon_step(F.col("budget"), h) for h in Q.HORIZONS]
    r = [F.get("reach", i) for i in range(len(steps))]
    inc = [r[0], *[r[i] - r[i - 1] for i in range(1, len(r))]]
    hit = F.lit(0.0)
    for i in reversed(range(len(steps))):
        hit = F.when(steps[i] >= F.col("duration"), inc[i]).otherwise(hit)
    alive = F.lit(1.0)
    for i in range(len(steps)):
        alive = F.when(steps[i] <= F.col("duration"), 1.0 - r[i]).otherwise(alive)
    like = F.when(F.col("event"), hit).otherwise(alive)
    widths = [steps[0], *[steps[i] - steps[i - 1] for i in range(1, len(steps))]]
    surv = [F.lit(1.0), *[1.0 - v for v in r[:-1]]]
    rmst = reduce(lambda a, b: a + b, [s * w for s, w in zip(surv, widths, strict=True)])
    par = reduce(lambda a, b: a + b, [i * s for i, s in zip(inc, steps, strict=True)]) + (1.0 - r[-1]) * 10.0 * F.col("budget")
    return df.withColumns({
        "survival_nll": -F.ln(F.greatest(F.lit(EPS), F.least(F.lit(1.0), like))), "restricted_mean": rmst, "expected_par10": par,
        "observed_par10": F.when(F.col("event"), F.col("duration")).otherwise(10.0 * F.col("budget"))})


def concordance(df: DataFrame, keys: Sequence[str], duration: str, event: str, risk: str) -> DataFrame:
    """Harrell's C: over pairs (event at d, later duration), share where the event has the higher risk, ties half.

    Rows shrink to (duration, risk) cells first.  The event cells of each duration are ranked against the
    later cells by running counts, so no row pairs are built; the work is cells x distinct event durations,
    and durations are steps of a bounded budget.
    """
    cells = df.groupBy(*keys, F.col(duration).alias("_d"), F.col(risk).alias("_r")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(event)).alias("_e"))
    times = cells.filter("_e > 0").select(*keys, F.col("_d").alias("_t")).distinct()
    later = cells.join(F.broadcast(times), list(keys)) if keys else cells.crossJoin(F.broadcast(times))
    at = later.filter("_d >= _t").select(
        *keys, "_t", "_r", F.when(F.col("_d") > F.col("_t"), F.col("_n")).otherwise(0).alias("later"),
        F.when(F.col("_d") == F.col("_t"), F.col("_e")).otherwise(0).alias("events"))
    g = at.groupBy(*keys, "_t", "_r").agg(F.sum("later").alias("later"), F.sum("events").alias("events"))
    run = running(g, [*keys, "_t"], ["_r"], {"upto": ("sum", F.col("later"))})
    total = g.groupBy(*keys, "_t").agg(F.sum("later").alias("total"))
    j = run.join(total, [*keys, "_t"]).filter("events > 0")
    below = F.col("upto") - F.col("later")
    return j.groupBy(*keys).agg(F.sum(F.col("events") * (below + F.col("later") / 2.0)).alias("_c"),
                                F.sum(F.col("events") * F.col("total")).alias("comparable_pairs")).select(
        *keys, (F.col("_c") / F.col("comparable_pairs")).alias("c_index"), "comparable_pairs")


# ------------------------------------------------------------------ pooling

def normal_pooling(df: DataFrame, fold: str, residual: str, levels: Sequence[Sequence[str]]) -> tuple[DataFrame, list[str]]:
    """Sequential partial pooling of residuals per evaluation fold.

    Returns rows (one per evaluation fold and row) with the pooled effect of the fold's other rows:
    each level shrinks group means of what earlier levels left over.  State is kept per group, not per
    row: a group of the deepest level has one running residual shift, so rows are aggregated once.
    """
    leaf = list(dict.fromkeys(c for l in levels for c in l))
    base = df.groupBy(fold, *leaf).agg(F.count(F.lit(1)).alias("n"), F.sum(residual).alias("s"), F.sum(F.col(residual) * F.col(residual)).alias("ss"))
    folds = df.select(fold).distinct().select(F.col(fold).alias("eval_fold"))
    # training cells per evaluation fold: folds x leaf groups rows, independent of the number of runs
    cells = base.crossJoin(F.broadcast(folds)).filter(F.col(fold) != F.col("eval_fold")).groupBy("eval_fold", *leaf).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    want = base.select(F.col(fold).alias("eval_fold"), *leaf).distinct()
    grid = want.join(cells, ["eval_fold", *leaf], "full_outer").na.fill(0, ["n", "s", "ss"])
    grid = grid.withColumns({"shift": F.lit(0.0), "effect": F.lit(0.0), "variance": F.lit(0.0)})
    checkpoint_dir(df.sparkSession)
    for level in levels:
        # the next level reads this small table several times: cut its lineage
        grid = grid.checkpoint()
        # residual of a row = r - shift(cell): first and second moments follow from the cell sums
        rs = F.col("s") - F.col("n") * F.col("shift")
        rss = F.col("ss") - 2 * F.col("shift") * F.col("s") + F.col("n") * F.col("shift") * F.col("shift")
        g = grid.groupBy("eval_fold", *level).agg(F.sum("n").alias("gn"), F.sum(rs).alias("gs"), F.sum(rss).alias("gss")).filter("gn > 0")
        g = g.withColumn("gm", F.col("gs") / F.col("gn"))
        n = F.sum("gn")
        t = g.groupBy("eval_fold").agg(
            F.greatest((F.sum("gss") - F.sum("gs") * F.sum("gs") / n) / (n - 1), F.lit(1e-10)).alias("rv"),
            F.var_samp("gm").alias("mv"), F.avg(1.0 / F.col("gn")).alias("inv"), F.count(F.lit(1)).alias("k"))
        t = t.select("eval_fold", "rv", F.when(F.col("k") > 1, F.greatest(F.col("mv") - F.col("rv") * F.col("inv"), F.lit(0.0))).otherwise(0.0).alias("pv"))
        g = g.join(F.broadcast(t), "eval_fold")
        w = F.when(F.col("pv") > 0, F.col("gn") * F.col("pv") / (F.col("gn") * F.col("pv") + F.col("rv"))).otherwise(0.0)
        post = F.when(F.col("pv") > 0, 1.0 / (1.0 / F.col("pv") + F.col("gn") / F.col("rv"))).otherwise(0.0)
        g = g.select("eval_fold", *level, (w * F.col("gm")).alias("_eff"), post.alias("_post"))
        grid = grid.join(F.broadcast(t.select("eval_fold", "pv")), "eval_fold").join(g, ["eval_fold", *level], "left")
        grid = grid.withColumns({
            "shift": F.col("shift") + F.coalesce("_eff", F.lit(0.0)), "effect": F.col("effect") + F.coalesce("_eff", F.lit(0.0)),
            "variance": F.col("variance") + F.coalesce("_post", F.col("pv"))}).drop("_eff", "_post", "pv")
    grid = grid.checkpoint()
    last = F.sum(F.col("ss") - 2 * F.col("shift") * F.col("s") + F.col("n") * F.col("shift") * F.col("shift")) / F.sum("n")
    final = grid.groupBy("eval_fold").agg(F.greatest(last, F.lit(1e-10)).alias("final_variance"))
    out = grid.join(F.broadcast(final), "eval_fold").withColumn("std", F.sqrt(F.col("final_variance") + F.col("variance")))
    return out.select(F.col("eval_fold").alias(fold), *leaf, "effect", "std"), leaf


def beta_pooling(df: DataFrame, fold: str, outcome: Column, strength: float = 20.0, a0: float = 0.5, b0: float = 0.5) -> DataFrame:
    """Global -> domain -> (domain, algorithm), (domain, family) -> leaf beta posteriors per evaluation fold.

    A leaf's prior is the mean of its two parents; a leaf unseen in training takes the deepest seen level.
    """
    leaf = ["domain", "problem_family", "algorithm"]
    base = df.groupBy(fold, *leaf).agg(F.count(F.lit(1)).alias("n"), F.sum(outcome.cast("int")).alias("y"))
    folds = df.select(fold).distinct().select(F.col(fold).alias("eval_fold"))
    cells = base.crossJoin(F.broadcast(folds)).filter(F.col(fold) != F.col("eval_fold")).groupBy("eval_fold", *leaf).agg(
        F.sum("n").alias("n"), F.sum("y").alias("y"))
    want = base.select(F.col(fold).alias("eval_fold"), *leaf).distinct()

    def level(keys):
        return cells.groupBy("eval_fold", *keys).agg(F.sum("n").alias("n"), F.sum("y").alias("y"))

    def posterior(g, prior, keys, name):
        p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), prior))
        a, b = p * strength + F.col("y"), (1 - p) * strength + F.col("n") - F.col("y")
        return g.select("eval_fold", *keys, a.alias(f"a_{name}"), b.alias(f"b_{name}"), (a / (a + b)).alias(f"m_{name}"))

    glob = level([]).select("eval_fold", (a0 + F.col("y")).alias("a_g"), (b0 + F.col("n") - F.col("y")).alias("b_g"))
    glob = glob.withColumn("m_g", F.col("a_g") / (F.col("a_g") + F.col("b_g")))
    dom = posterior(level(["domain"]).join(F.broadcast(glob), "eval_fold"), F.col("m_g"), ["domain"], "d")
    alg = posterior(level(["domain", "algorithm"]).join(F.broadcast(dom), ["eval_fold", "domain"]), F.col("m_d"), ["domain", "algorithm"], "da")
    fam = posterior(level(["domain", "problem_family"]).join(F.broadcast(dom), ["eval_fold", "domain"]), F.col("m_d"), ["domain", "problem_family"], "df")
    lf = cells.join(alg, ["eval_fold", "domain", "algorithm"]).join(fam, ["eval_fold", "domain", "problem_family"])
    lf = posterior(lf, 0.5 * (F.col("m_df") + F.col("m_da")), leaf, "l")
    out = want.join(F.broadcast(glob), "eval_fold").join(dom, ["eval_fold", "domain"], "left").join(
        alg, ["eval_fold", "domain", "algorithm"], "left").join(fam, ["eval_fold", "domain", "problem_family"], "left").join(
        lf, ["eval_fold", *leaf], "left")
    # the order of levels decides which one is deepest: family after algorithm
    order = ["l", "df", "da", "d", "g"]
    pick = lambda p: F.coalesce(*[F.col(f"{p}_{o}") for o in order])
    name = F.coalesce(*[F.when(F.col(f"m_{o}").isNotNull(), F.lit(n)) for o, n in zip(
        order, ["leaf", "domain_family", "domain_algorithm", "domain", "global"], strict=True)])
    return out.select(F.col("eval_fold").alias(fold), *leaf, pick("m").alias("probability"), pick("a").alias("alpha"),
                      pick("b").alias("beta"), name.alias("level"))


# ------------------------------------------------------------------ recalibration and decisions

def recalibration_levels(df: DataFrame, fold: str, folds: int, pit: str = "pit", strength: float = 200.0,
                         lower: float = 0.0, upper: float = 1.0) -> DataFrame:
    """Adjusted levels per fold from the PIT quantiles of the other folds, shrunk to nominal and made monotone."""
    from trialgrid.operators.folds import other_folds, out_of_fold_quantiles
    q = out_of_fold_quantiles(df, [], fold, folds, pit, list(Q.LEVELS), "_e").withColumnRenamed(fold, "eval_fold")
    per = df.groupBy(fold).agg(F.count(F.lit(1)).alias("n"))
    n = other_folds(per, fold, folds).groupBy("eval_fold").agg(F.sum("n").alias("n"))
    nominal = F.lit(list(Q.LEVELS))
    adj = F.zip_with("_e", nominal, lambda e, l: F.greatest(F.lit(lower), F.least(F.lit(upper), (F.col("n") * e + strength * l) / (F.col("n") + strength))))
    return q.join(n, "eval_fold").select(F.col("eval_fold").alias(fold), "n", Q.running_max(adj).alias("levels"))


# fixed values: utility weights by profile
PROFILES = [("quality_first", 1.0, 0.05, 0.50, 0.05, 0.10), ("balanced", 1.0, 0.15, 1.00, 0.10, 0.25),
            ("speed_sensitive", 1.0, 0.35, 1.00, 0.05, 0.15), ("risk_averse", 1.0, 0.15, 2.00, 0.25, 0.35)]
COMPONENTS = ("quality_weight", "runtime_weight", "failure_penalty", "uncertainty_penalty", "sla_bonus")


def profile_table(spark) -> DataFrame:
    return spark.createDataFrame(PROFILES, "profile string, " + ", ".join(f"{c} double" for c in COMPONENTS))


def scenario_table(spark, fraction: float = 0.25) -> DataFrame:
    """Nominal weights and each component moved down and up: 11 rows per profile."""
    p = profile_table(spark)
    moves = [("nominal", "", 1.0)] + [(c, d, m) for c in COMPONENTS for d, m in (("minus", 1 - fraction), ("plus", 1 + fraction))]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.lit(d).alias("direction"), F.lit(m).alias("multiplier")) for c, d, m in moves]))
    s = p.select("*", cells.alias("_m")).select("*", "_m.*").drop("_m")
    pct = F.lit(f"{round(fraction * 100):02d}")
    sid = F.when(F.col("component") == "nominal", F.concat("profile", F.lit("__nominal"))).otherwise(
        F.concat("profile", F.lit("__"), "component", F.lit("__"), "direction", pct))
    return s.withColumns({c: F.when(F.col("component") == c, F.col(c) * F.col("multiplier")).otherwise(F.col(c)) for c in COMPONENTS}).withColumn(
        "scenario_id", sid).withColumn("is_nominal", F.col("component") == "nominal").drop("direction")


def utilities(df: DataFrame) -> DataFrame:
    """Expected and realised utility from predicted and realised components and the weight columns."""
    return df.withColumns({
        "expected_utility": F.col("quality_weight") * F.col("pred_quality") - F.col("runtime_weight") * F.col("pred_runtime_ratio")
        - F.col("failure_penalty") * F.col("pred_failure") - F.col("uncertainty_penalty") * F.col("pred_uncertainty") + F.col("sla_bonus") * F.col("pred_sla"),
        "realized_utility": F.col("quality_weight") * F.col("real_quality") - F.col("runtime_weight") * F.col("real_runtime_ratio")
        - F.col("failure_penalty") * F.col("real_failure") + F.col("sla_bonus") * F.col("real_sla")})


def ranked(candidates: DataFrame, group: Sequence[str], digits: int = 12) -> DataFrame:
    """Predicted and realised ranks by utility desc, then name; utilities are compared at 12 digits."""
    w = Window.partitionBy(*group)
    e, r = F.round("expected_utility", digits), F.round("realized_utility", digits)
    return candidates.withColumns({
        "predicted_rank": F.row_number().over(w.orderBy(e.desc(), "algorithm")).cast("bigint"),
        "realized_rank": F.row_number().over(w.orderBy(r.desc(), "algorithm")).cast("bigint")})


def selections(rank: DataFrame, group: Sequence[str], temperature: float = 0.1) -> DataFrame:
    """Selected, oracle, baseline and random outcome of each candidate group (groups hold the algorithms of one problem)."""
    sel, orc, base = F.col("predicted_rank") == 1, F.col("realized_rank") == 1, F.col("algorithm") == F.col("baseline_algorithm")
    pick = lambda cond, c: F.max(F.when(cond, F.col(c)))
    g = rank.groupBy(*group).agg(
        F.count(F.lit(1)).alias("candidates"), pick(sel, "algorithm").alias("selected"), pick(orc, "algorithm").alias("oracle"),
        pick(sel, "realized_utility").alias("selected_utility"), pick(orc, "realized_utility").alias("oracle_utility"),
        pick(base, "realized_utility").alias("baseline_utility"), F.avg("realized_utility").alias("random_utility"),
        pick(sel, "realized_rank").alias("selected_realized_rank"),
        F.sort_array(F.collect_list("expected_utility"), asc=False).alias("_e"))
    regret = lambda c: F.greatest(F.lit(0.0), F.col("oracle_utility") - F.col(c))
    p = X.softmax(F.transform("_e", lambda v: v / temperature))
    ent = -X.array_sum(F.transform(p, lambda v: v * F.ln(F.greatest(v, F.lit(1e-15)))))
    return g.withColumns({
        "correct": F.col("selected") == F.col("oracle"), "in_top2": F.col("selected_realized_rank") <= F.least(F.lit(2), F.col("candidates")),
        "oracle_regret": regret("selected_utility"), "baseline_regret": regret("baseline_utility"), "random_regret": regret("random_utility"),
        "gain_vs_baseline": F.col("selected_utility") - F.col("baseline_utility"), "gain_vs_random": F.col("selected_utility") - F.col("random_utility"),
        "margin": F.when(F.col("candidates") > 1, F.get("_e", 0) - F.get("_e", 1)).otherwise(0.0),
        "entropy": F.when(F.col("candidates") > 1, ent / F.ln(F.col("candidates").cast("double"))).otherwise(0.0)}).drop("_e")

"""Run-table queries: pairing, summaries, audits, folds, trajectories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialgrid.functions import exprs as X
from trialgrid.functions.exprs import r6
from trialgrid.operators import folds as FO
from trialgrid.operators import replicates as RP
from trialgrid.operators import resample as RS
from trialgrid.operators import runs as RU
from trialgrid.operators.ordered import islands, median, quantiles, running, top_rows
from trialgrid.plans.registry import query
from trialgrid.plans.views import (FOLDS, FRUNS, RUNS, SERIES, TRACES, R, U, folded_runs, runs, series, table, traces, with_)

PAIRED = RUNS + """,
sides AS MATERIALIZED (SELECT coalesce(b.problem_id,c.problem_id) AS problem_id, coalesce(b.seed,c.seed) AS seed, b.run_id AS rb, c.run_id AS rc, b.quality AS qb, c.quality AS qc,
 b.runtime AS tb, c.runtime AS tc, b.target_reached AS hb, c.target_reached AS hc, b.problem_family, b.domain FROM (SELECT * FROM runs WHERE algorithm='baseline') b
 FULL OUTER JOIN (SELECT * FROM runs WHERE algorithm='challenger') c ON b.problem_id=c.problem_id AND b.seed=c.seed),
paired AS MATERIALIZED (SELECT problem_id, seed, problem_family, domain, qc-qb AS quality_difference, (1/qc-1)/greatest(1/qb-1,1e-15::DOUBLE) AS objective_ratio,
 log10((1/qb-1+1e-15::DOUBLE)/(1/qc-1+1e-15::DOUBLE)) AS log10_gain, (hc::INT-hb::INT)::BIGINT AS target_difference, tc/greatest(tb,1e-12::DOUBLE) AS runtime_ratio,
 CASE WHEN qc-qb > 1e-12::DOUBLE THEN 'challenger' WHEN qc-qb < -1e-12::DOUBLE THEN 'baseline' ELSE 'tie' END AS winner,
 greatest(qb,qc) AS oracle_quality, greatest(qb,qc)-qb AS baseline_regret, greatest(qb,qc)-qc AS challenger_regret FROM sides WHERE rb IS NOT NULL AND rc IS NOT NULL)"""
_PM = ["quality_difference", "objective_ratio", "log10_gain", "runtime_ratio", "oracle_quality", "baseline_regret", "challenger_regret"]


@query("paired_runs", with_(PAIRED) + f"""SELECT substr(sha256('{{"comparison":"baseline_vs_challenger","problem_id":'||problem_id||',"seed":'||seed||'}}'),1,24) AS pair_id, problem_id, seed, problem_family, domain, winner, target_difference,
 {', '.join(f'{R(c)} AS {c}' for c in _PM)} FROM paired""")
def paired_runs(spark, sf):
    """Complete pairs with their content id and comparison metrics."""
    p = RU.paired(runs(spark, sf)).withColumn("comparison", F.lit("baseline_vs_challenger"))
    return p.select(X.short_digest("comparison", "problem_id", "seed").alias("pair_id"), "problem_id", "seed", "problem_family", "domain",
                    "winner", "target_difference", *[r6(F.col(c)).alias(c) for c in _PM])


@query("pairing_completeness", with_(PAIRED) + """SELECT CASE WHEN rb IS NULL THEN 'challenger_only' WHEN rc IS NULL THEN 'baseline_only' ELSE 'both' END AS side, count(*)::BIGINT AS rows FROM sides GROUP BY 1""")
def pairing_completeness(spark, sf):
    return RU.pair_sides(runs(spark, sf), ["run_id"]).groupBy("side").agg(F.count(F.lit(1)).alias("rows"))


_PS = PAIRED + """,
psum AS (SELECT problem_id, problem_family, domain, count(*)::BIGINT AS seed_pairs, avg(quality_difference) AS qmean, median(quality_difference) AS qmed,
 avg((winner='challenger')::INT) AS win_rate, avg(target_difference) AS tmean, median(runtime_ratio) AS rmed, avg(log10_gain) AS gmean FROM paired GROUP BY 1,2,3)"""
_PSC = ["qmean", "qmed", "win_rate", "tmean", "rmed", "gmean"]


def _problem_summary(spark, sf):
    p = RU.paired(runs(spark, sf))
    keys = ["problem_id", "problem_family", "domain"]
    base = p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("seed_pairs"), F.avg("quality_difference").alias("qmean"),
        F.avg((F.col("winner") == "challenger").cast("int")).alias("win_rate"), F.avg("target_difference").alias("tmean"),
        F.avg("log10_gain").alias("gmean"))
    m1 = median(p, ["problem_id"], "quality_difference", "qmed")
    m2 = median(p, ["problem_id"], "runtime_ratio", "rmed")
    return base.join(m1, "problem_id").join(m2, "problem_id")


@query("problem_pair_summary", with_(_PS) + f"SELECT problem_id, problem_family, domain, seed_pairs, {', '.join(f'{R(c)} AS {c}' for c in _PSC)} FROM psum")
def problem_pair_summary(spark, sf):
    return _problem_summary(spark, sf).select("problem_id", "problem_family", "domain", "seed_pairs", *[r6(F.col(c)).alias(c) for c in _PSC])


@query("cluster_means", with_(_PS) + f"""SELECT coalesce(problem_family, 'ALL') AS family, count(*)::BIGINT AS problems, {R('avg(qmean)')} AS mean_difference FROM psum GROUP BY GROUPING SETS ((problem_family), ())""")
def cluster_means(spark, sf):
    """Mean over problems of per-problem means, per family and overall."""
    p = RU.paired(runs(spark, sf)).groupBy("problem_id", "problem_family").agg(F.avg("quality_difference").alias("qmean"))
    return p.rollup("problem_family").agg(F.count(F.lit(1)).alias("problems"), r6(F.avg("qmean")).alias("mean_difference")).select(
        F.coalesce("problem_family", F.lit("ALL")).alias("family"), "problems", "mean_difference")


BOOTSTRAPS = 10_000
_BOOT = f""",
pu AS (SELECT 0 AS every, problem_id AS unit, qmean FROM psum),
{RP.replicate_sql("bt0", "pu", ["every"], ["qmean"], BOOTSTRAPS, "poisson", "mean")},
bt AS (SELECT qmean/nullif(w,0) AS m FROM bt0),
sr AS (SELECT abs(qmean) AS a, (qmean>0)::INT AS p, rank() OVER (ORDER BY abs(qmean)) + (count(*) OVER (PARTITION BY abs(qmean))-1)/2.0 AS rk, count(*) OVER (PARTITION BY abs(qmean)) AS t FROM psum WHERE abs(qmean) > 0),
wx AS (SELECT sum(p*rk) AS w, count(*)::DOUBLE AS n, sum(t*t-1) AS ties FROM sr)"""


@query("paired_decision", with_(_PS + _BOOT) + f"""SELECT *, CASE WHEN problems>=8 AND mean_difference>0 AND ci_low>0 AND z>1.6448536 AND win_rate>=0.6 AND positive_families THEN 'MECHANISM_SIGNAL' WHEN mean_difference>0 AND win_rate>0.5 THEN 'MIXED' ELSE 'NO_SIGNAL' END AS decision FROM (
 SELECT (SELECT count(*) FROM psum)::BIGINT AS problems, {R('(SELECT avg(qmean) FROM psum)')} AS mean_difference, {R('(SELECT quantile_cont(m,0.025) FROM bt)')} AS ci_low, {R('(SELECT quantile_cont(m,0.975) FROM bt)')} AS ci_high,
 {R('(SELECT w FROM wx)')} AS statistic, {R('(SELECT (w-n*(n+1)/4)/sqrt(n*(n+1)*(2*n+1)/24-ties/48) FROM wx)')} AS z, {R("(SELECT avg((winner='challenger')::INT) FROM paired)")} AS win_rate,
 (SELECT min(m) > 0 FROM (SELECT avg(qmean) AS m FROM psum GROUP BY problem_family)) AS positive_families)""")
def paired_decision(spark, sf):
    """Bootstrap interval, signed-rank test, win rate and the decision rule over problem means."""
    p = RU.paired(runs(spark, sf))
    prob = p.groupBy("problem_id", "problem_family").agg(F.avg("quality_difference").alias("qmean")).withColumn("all", F.lit(0))
    win = p.agg(r6(F.avg((F.col("winner") == "challenger").cast("int"))).alias("win_rate"))
    fam = prob.groupBy("problem_family").agg(F.avg("qmean").alias("m")).agg((F.min("m") > 0).alias("positive_families"))
    base = prob.groupBy("all").agg(F.count(F.lit(1)).alias("problems"), r6(F.avg("qmean")).alias("mean_difference"))
    ci = RP.mean_intervals(prob, ["all"], ["qmean"], "problem_id", BOOTSTRAPS).select("all", F.col("qmean_low").alias("ci_low"), F.col("qmean_high").alias("ci_high"))
    wx = RS.wilcoxon(prob, ["all"], "qmean")
    out = base.join(ci, "all").join(wx, "all").crossJoin(F.broadcast(win)).crossJoin(F.broadcast(fam))  # one row each
    out = out.select("problems", "mean_difference", r6(F.col("ci_low")).alias("ci_low"), r6(F.col("ci_high")).alias("ci_high"),
                     r6(F.col("statistic")).alias("statistic"), r6(F.col("z")).alias("z"), "win_rate", "positive_families")
    return out.withColumn("decision", F.when(
        (F.col("problems") >= 8) & (F.col("mean_difference") > 0) & (F.col("ci_low") > 0) & (F.col("z") > 1.6448536)
        & (F.col("win_rate") >= 0.6) & F.col("positive_families"), "MECHANISM_SIGNAL").when(
        (F.col("mean_difference") > 0) & (F.col("win_rate") > 0.5), "MIXED").otherwise("NO_SIGNAL"))


@query("run_audit", with_(RUNS) + """SELECT 'critical' AS severity, 'duplicate_run' AS "check", (SELECT count(*)-count(DISTINCT run_id) FROM runs)::BIGINT AS rows
 UNION ALL SELECT 'critical', 'missing_trace', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events))
 UNION ALL SELECT 'critical', 'orphan_trace', (SELECT count(DISTINCT user_id) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer))
 UNION ALL SELECT 'critical', 'unknown_problem', (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))
 UNION ALL SELECT 'critical', 'status_conflict', (SELECT count(*) FROM runs WHERE failure <> (failure_type IS NOT NULL) OR (target_reached AND passage IS NULL))
 UNION ALL SELECT 'warning', 'non_finite', (SELECT count(*) FROM runs WHERE isnan(quality) OR isinf(runtime) OR quality IS NULL)
 UNION ALL SELECT 'warning', 'incomplete_pair', (SELECT count(*) FROM (SELECT problem_id, seed FROM runs GROUP BY 1,2 HAVING count(DISTINCT algorithm) < 2))
 UNION ALL SELECT 'warning', 'invalid_json', (SELECT count(*) FROM events WHERE NOT json_valid(props))""")
def run_audit(spark, sf):
    """Severity-typed checks: duplicates, missing and orphan traces, status, pairs, JSON."""
    r = runs(spark, sf)
    planned = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    ev = table(spark, sf, "events")
    traced = ev.select(F.col("user_id").alias("id")).distinct()
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"))
    pairs = r.groupBy("problem_id", "seed").agg(F.min("algorithm").alias("a"), F.max("algorithm").alias("b"))
    dup = r.groupBy("run_id").agg((F.count(F.lit(1)) - 1).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("rows")).select(
        F.lit("critical").alias("severity"), F.lit("duplicate_run").alias("check"), "rows")
    return RU.checks(
        dup, RU.check(planned.join(traced, "id", "left_anti"), "critical", "missing_trace"),
        RU.check(traced.join(planned, "id", "left_anti"), "critical", "orphan_trace"),
        RU.check(table(spark, sf, "lineitem").join(parts, "l_partkey", "left_anti"), "critical", "unknown_problem"),
        RU.check(r, "critical", "status_conflict", (F.col("failure") != F.col("failure_type").isNotNull()) | (F.col("target_reached") & F.col("passage").isNull())),
        RU.check(r, "warning", "non_finite", F.isnan("quality") | (F.abs("runtime") == float("inf")) | F.col("quality").isNull()),
        RU.check(pairs, "warning", "incomplete_pair", F.col("a") == F.col("b")),
        RU.check(ev, "warning", "invalid_json", F.get_json_object("props", "$").isNull()))


@query("monotone_steps", with_(TRACES) + """SELECT run_id, count(*)::BIGINT AS steps, count_if(step <> p+1)::BIGINT AS breaks, count_if(fraction=1.0)::BIGINT AS final_rows FROM
 (SELECT *, lag(step) OVER (PARTITION BY run_id ORDER BY step) AS p FROM traces) GROUP BY 1""")
def monotone_steps(spark, sf):
    """Step continuity and exactly one final row per run."""
    t = RU.enriched_traces(traces(spark, sf))
    return t.groupBy("run_id").agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("step") != F.col("prev_step") + 1).alias("breaks"),
                                   F.count_if(F.col("fraction") == 1.0).alias("final_rows"))


@query("runtime_outliers", with_(RUNS) + f"""SELECT algorithm, domain, {R('med')} AS med, {R('mad')} AS mad, {R('th')} AS threshold, (SELECT count(*) FROM runs r WHERE r.algorithm=m.algorithm AND r.domain=m.domain AND r.runtime > th) AS outliers FROM (
 SELECT algorithm, domain, med, median(abs(runtime-med)) AS mad, greatest(med*5, med+8*greatest(median(abs(runtime-med)),1e-12)) AS th FROM (SELECT *, median(runtime) OVER (PARTITION BY algorithm, domain) AS med FROM runs) GROUP BY 1,2,3) m""")
def runtime_outliers(spark, sf):
    o = RU.runtime_outliers(runs(spark, sf), ["algorithm", "domain"])
    return o.select("algorithm", "domain", r6(F.col("med")).alias("med"), r6(F.col("mad")).alias("mad"), r6(F.col("threshold")).alias("threshold"), "outliers")


@query("lookup_cardinality", """SELECT (SELECT count(*) FROM lineitem)::BIGINT AS left_rows, (SELECT count(*) FROM lineitem JOIN part ON p_partkey=l_partkey)::BIGINT AS joined_rows,
 (SELECT count(*) FROM (SELECT p_partkey FROM part GROUP BY 1 HAVING count(*)>1))::BIGINT AS repeated_keys, (SELECT count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem))::BIGINT AS used_keys""")
def lookup_cardinality(spark, sf):
    """Many-to-one contract of a lookup join, and the semi join of used keys."""
    li = table(spark, sf, "lineitem").select("l_partkey")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"))
    n = li.agg(F.count(F.lit(1)).alias("left_rows"))
    # the join itself is not needed to count it: key counts multiply
    lc, pc = li.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("a")), p.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("b"))
    j = lc.join(pc, "l_partkey").agg(F.sum(F.col("a") * F.col("b")).alias("joined_rows"))
    rep = pc.agg(F.count_if(F.col("b") > 1).alias("repeated_keys"))
    used = p.join(lc, "l_partkey", "left_semi").agg(F.count(F.lit(1)).alias("used_keys"))
    return n.crossJoin(j).crossJoin(rep).crossJoin(used)  # one row each


@query("table_digest", """SELECT o_orderstatus, count(*)::BIGINT AS rows, (sum(h) % 4503599627370496)::BIGINT AS digest FROM (SELECT o_orderstatus,
 CAST('0x'||substr(md5(concat_ws('|', o_orderkey, o_custkey, o_orderpriority)),1,13) AS BIGINT) AS h FROM orders) GROUP BY 1""")
def table_digest(spark, sf):
    """Order-insensitive digest: sum of row hashes modulo 2^52 (exact decimals, any partitioning)."""
    o = table(spark, sf, "orders")
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderpriority")), 1, 13), 16, 10)
    return o.select("o_orderstatus", h.cast("decimal(20,0)").alias("h")).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"), F.pmod(F.sum("h"), F.lit(2**52).cast("decimal(38,0)")).cast("bigint").alias("digest"))


@query("modular_folds", """SELECT p_partkey AS problem_id, p_type AS family, (row_number() OVER (PARTITION BY p_type ORDER BY p_partkey)-1)%5 AS instance_fold,
 (dense_rank() OVER (ORDER BY p_type)-1)%5 AS family_fold FROM part""")
def modular_folds(spark, sf):
    """Running index inside a family and dense family index, both modulo the fold count."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("problem_id"), F.col("p_type").alias("family"))
    p = FO.modular_folds(p, ["family"], ["problem_id"], 5, "instance_fold")
    return FO.dense_index_folds(p, "family", 5)


_FST = FRUNS + f""",
tr AS (SELECT f.fold AS eval_fold, a.* FROM fruns a, (SELECT unnest(range({FOLDS})) AS fold) f WHERE a.fold <> f.fold),
lng AS (SELECT eval_fold, 'runtime' AS feature, runtime AS v FROM tr UNION ALL SELECT eval_fold, 'passage', passage FROM tr UNION ALL SELECT eval_fold, 'quality', quality FROM tr),
fst AS MATERIALIZED (SELECT eval_fold AS fold, feature, count(*)::BIGINT AS rows, count_if(v IS NULL)::BIGINT AS missing, median(v) AS median, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v,0.01) AS q01, quantile_cont(v,0.99) AS q99 FROM lng GROUP BY 1,2)"""
_FEATURES = ["runtime", "passage", "quality"]


def _fold_statistics(spark, sf):
    """Training statistics per (fold, feature); counts and moments from fold totals, quantiles from value counts."""
    u = RU.unpivot(folded_runs(spark, sf), ["fold"], _FEATURES)
    v = F.col("value")
    sums = FO.out_of_fold_sums(u, ["feature"], "fold", {"rows": F.lit(1), "n": v.isNotNull().cast("int"), "s": F.coalesce(v, F.lit(0.0)), "ss": F.coalesce(v * v, F.lit(0.0))})
    q = FO.out_of_fold_quantiles(u, ["feature"], "fold", FOLDS, "value", [0.01, 0.5, 0.99])
    mean = F.col("s") / F.col("n")
    return sums.join(q, ["feature", "fold"]).select(
        "fold", "feature", "rows", (F.col("rows") - F.col("n")).alias("missing"), F.get("q", 1).alias("median"), mean.alias("mean"),
        F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"), F.get("q", 0).alias("q01"), F.get("q", 2).alias("q99"))


@query("fold_statistics", with_(_FST) + f"SELECT fold, feature, rows, missing, {', '.join(f'{R(c)} AS {c}' for c in ['median', 'mean', 'std', 'q01', 'q99'])} FROM fst")
def fold_statistics(spark, sf):
    return _fold_statistics(spark, sf).select("fold", "feature", "rows", "missing", *[r6(F.col(c)).alias(c) for c in ["median", "mean", "std", "q01", "q99"]])


@query("fold_transform", with_(_FST) + f"""SELECT run_id, feature, missing, {R('(least(greatest(coalesce(v, median), q01), q99)-mean)/CASE WHEN std <= 1e-12 THEN 1.0 ELSE std END')} AS z FROM (
 SELECT run_id, fold, feature, v, (v IS NULL) AS missing FROM (SELECT run_id, fold, 'runtime' AS feature, runtime AS v FROM fruns UNION ALL SELECT run_id, fold, 'passage', passage FROM fruns UNION ALL SELECT run_id, fold, 'quality', quality FROM fruns)) JOIN (SELECT * EXCLUDE (missing) FROM fst) USING (fold, feature)""")
def fold_transform(spark, sf):
    """Impute, clip and scale each row by the statistics of the other folds."""
    u = RU.unpivot(folded_runs(spark, sf), ["run_id", "fold"], _FEATURES)
    j = u.join(F.broadcast(_fold_statistics(spark, sf).drop("missing")), ["fold", "feature"])
    v = F.least(F.greatest(F.coalesce("value", "median"), F.col("q01")), F.col("q99"))
    return j.select("run_id", "feature", F.col("value").isNull().alias("missing"),
                    r6((v - F.col("mean")) / F.when(F.col("std") <= 1e-12, 1.0).otherwise(F.col("std"))).alias("z"))


@query("fold_contract", with_(FRUNS) + """SELECT fold, count(*)::BIGINT AS rows, count(DISTINCT problem_id)::BIGINT AS problems, count(DISTINCT problem_family)::BIGINT AS families,
 count_if(failure)::BIGINT AS failures, sum(CAST('0x'||substr(md5(run_id),1,8) AS BIGINT))::BIGINT AS digest FROM fruns GROUP BY 1""")
def fold_contract(spark, sf):
    """Rows, distinct problems, class support and an id digest per fold."""
    r = folded_runs(spark, sf)
    per = r.groupBy("fold", "problem_id", "problem_family").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("failure").alias("f"),
        F.sum(F.conv(F.substring(F.md5("run_id"), 1, 8), 16, 10).cast("bigint")).alias("d"))
    fams = per.select("fold", "problem_family").distinct().groupBy("fold").agg(F.count(F.lit(1)).alias("families"))
    return per.groupBy("fold").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("problems"), F.sum("f").alias("failures"),
                                   F.sum("d").alias("digest")).join(fams, "fold").select("fold", "rows", "problems", "families", "failures", "digest")


@query("feature_profile", f"""SELECT feature, count(*)::BIGINT AS rows, count_if(v IS NULL)::BIGINT AS missing, count(DISTINCT v)::BIGINT AS "unique", {R('min(v)')} AS minimum, {R('median(v)')} AS median, {R('max(v)')} AS maximum,
 {R('quantile_cont(v,0.75)-quantile_cont(v,0.25)')} AS iqr, count_if(v < q1-10*(q3-q1) OR v > q3+10*(q3-q1))::BIGINT AS beyond_10_iqr FROM (SELECT *, quantile_cont(v,0.25) OVER (PARTITION BY feature) AS q1, quantile_cont(v,0.75) OVER (PARTITION BY feature) AS q3 FROM (
 SELECT 'l_quantity' AS feature, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem)) GROUP BY feature""")
def feature_profile(spark, sf):
    p = RU.feature_profile(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return p.select("feature", "rows", "missing", "unique", *[r6(F.col(c)).alias(c) for c in ("minimum", "median", "maximum", "iqr")], "beyond_10_iqr")


_DISP = RUNS + """,
disp AS (SELECT problem_id, algorithm, feature, avg(v) AS mean, coalesce(stddev_samp(v),0) AS std, count(v)::BIGINT AS replicates FROM (SELECT problem_id, algorithm, 'quality' AS feature, quality AS v FROM runs UNION ALL SELECT problem_id, algorithm, 'runtime', runtime FROM runs) GROUP BY 1,2,3)"""


@query("replicate_dispersion", with_(_DISP) + f"""SELECT feature, algorithm, count(*)::BIGINT AS groups, {R('quantile_cont(std/greatest(abs(mean),1e-12),0.5)')} AS median_rel, {R('quantile_cont(std/greatest(abs(mean),1e-12),0.95)')} AS p95_rel, {R('max(std/greatest(abs(mean),1e-12))')} AS max_rel, min(replicates) AS min_replicates FROM disp GROUP BY 1,2""")
def replicate_dispersion(spark, sf):
    """Seed stability: spread of replicates per problem, then median, p95 and max per feature."""
    d = RU.replicate_dispersion(runs(spark, sf), ["problem_id", "algorithm"], ["quality", "runtime"])
    q = quantiles(d, ["feature", "algorithm"], "relative_std", [0.5, 0.95], "_q")
    base = d.groupBy("feature", "algorithm").agg(F.count(F.lit(1)).alias("groups"), r6(F.max("relative_std")).alias("max_rel"), F.min("replicates").alias("min_replicates"))
    return base.join(q, ["feature", "algorithm"]).select("feature", "algorithm", "groups", r6(F.get("_q", 0)).alias("median_rel"), r6(F.get("_q", 1)).alias("p95_rel"), "max_rel", "min_replicates")


ETR = TRACES + """,
etr AS MATERIALIZED (SELECT *, coalesce(lag(best) OVER w - best, 0) AS improvement, lag(objective) OVER w AS prev FROM (SELECT *, min(objective) OVER (PARTITION BY run_id ORDER BY step) AS best FROM traces) WINDOW w AS (PARTITION BY run_id ORDER BY step))"""
_TF = ["observed_fraction", "objective_last", "best_so_far", "improvement_sum", "improvement_slope", "autocorrelation", "transition_mean", "stagnation_fraction", "failure_signal_max"]


@query("trajectory_features", with_(ETR) + f"""SELECT run_id, cutoff, observed_steps, {', '.join(f'{R(c)} AS {c}' for c in _TF)} FROM (SELECT run_id, cutoff, arg_max(fraction, step) AS observed_fraction, max(step) AS observed_steps, arg_max(objective, step) AS objective_last, arg_max(best, step) AS best_so_far,
 sum(improvement) AS improvement_sum, coalesce(CASE WHEN count(*) >= 2 THEN regr_slope(best, step)*max(step) END, 0) AS improvement_slope, coalesce(CASE WHEN count(prev) >= 2 THEN CASE WHEN isfinite(corr(prev, objective)) THEN corr(prev, objective) END END, 0) AS autocorrelation,
 coalesce(avg(abs(objective-prev)),0) AS transition_mean, avg((improvement<=0)::INT) AS stagnation_fraction, max(failure_signal) AS failure_signal_max
 FROM etr, (SELECT unnest([0.05::DOUBLE,0.1,0.2]) AS cutoff) WHERE fraction <= cutoff+1e-12::DOUBLE OR step=1 GROUP BY 1,2)""")
def trajectory_features(spark, sf):
    """Early features at 5, 10 and 20 percent of the budget."""
    t = RU.trajectory_features(traces(spark, sf), [0.05, 0.10, 0.20])
    return t.select("run_id", "cutoff", "observed_steps", *[r6(F.col(c)).alias(c) for c in _TF])


_PF = [50, 75, 90, 95, 99, 100]


@query("passage_times", with_(ETR) + f"""SELECT run_id, {', '.join(f"min(CASE WHEN 1.0::DOUBLE/(1+best) >= {f}/100.0::DOUBLE*0.5 THEN step END) AS t{f}" for f in _PF)} FROM etr GROUP BY 1""")
def passage_times(spark, sf):
    """First step whose quality 1/(1+best) reaches each share of the target 0.5."""
    t = running(traces(spark, sf), ["run_id"], ["step"], {"best": ("min", F.col("objective"))})
    quality = 1.0 / (1.0 + F.col("best"))
    return t.groupBy("run_id").agg(*[F.min(F.when(quality >= F.lit(f) / 100.0 * 0.5, F.col("step"))).alias(f"t{f}") for f in _PF])


@query("run_summary", with_(ETR) + f"""SELECT run_id, {R('arg_max(1.0::DOUBLE/(1+best), step)')} AS quality_final, {R('max(1.0::DOUBLE/(1+best))')} AS quality_best, {R('avg(1.0::DOUBLE/(1+best))')} AS mean_quality, {R('var_pop(1.0::DOUBLE/(1+best))')} AS variance_quality,
 {R('(arg_min(best,step)-arg_max(best,step))/greatest(1,max(step)-min(step))')} AS improvement_rate, (max(step)-coalesce(max(CASE WHEN improvement>0 THEN step END), 0))::BIGINT AS stagnation FROM etr GROUP BY 1""")
def run_summary(spark, sf):
    """Final, best, mean and variance of quality, improvement rate and trailing stagnation."""
    t = RU.enriched_traces(traces(spark, sf)).withColumn("q", 1.0 / (1.0 + F.col("best")))
    last_gain = F.coalesce(F.max(F.when(F.col("improvement") > 0, F.col("step"))), F.lit(0))
    return t.groupBy("run_id").agg(
        r6(F.max_by("q", "step")).alias("quality_final"), r6(F.max("q")).alias("quality_best"), r6(F.avg("q")).alias("mean_quality"),
        r6(F.var_pop("q")).alias("variance_quality"),
        r6((F.min_by("best", "step") - F.max_by("best", "step")) / F.greatest(F.lit(1), F.max("step") - F.min("step"))).alias("improvement_rate"),
        (F.max("step") - last_gain).alias("stagnation"))


@query("dwell_profile", with_(SERIES) + f"""SELECT key, count(*)::BIGINT AS runs, max(c)::BIGINT AS longest, {R('avg(c)')} AS mean_length FROM (SELECT key, event_type, idx - rn AS g, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY key, event_type ORDER BY idx) AS rn FROM series) GROUP BY 1,2,3) GROUP BY 1""")
def dwell_profile(spark, sf):
    """Lengths of stretches of equal consecutive labels per series."""
    s = islands(series(spark, sf), ["key"], "idx", F.col("event_type"), "g")
    per = s.groupBy("key", "g").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("key").agg(F.count(F.lit(1)).alias("runs"), F.max("c").alias("longest"), r6(F.avg("c")).alias("mean_length"))


@query("formation_features", with_(SERIES) + f"""SELECT key, idx, flag, gap, CASE WHEN flag THEN burst ELSE 0 END::BIGINT AS burst_length, {R('density')} AS density, {R('value-pv')} AS value_delta,
 (flag AND NOT coalesce(pf,false) AND NOT coalesce(nf,false)) AS isolated FROM (SELECT *, CASE WHEN flag THEN idx - last_value(CASE WHEN flag THEN idx END IGNORE NULLS) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS gap,
 row_number() OVER (PARTITION BY key, grp ORDER BY idx) - CASE WHEN first_value(flag) OVER (PARTITION BY key, grp ORDER BY idx) THEN 0 ELSE 1 END AS burst FROM (
 SELECT *, count_if(NOT flag) OVER (PARTITION BY key ORDER BY idx) AS grp, avg(flag::INT) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS density,
 lag(value) OVER w AS pv, lag(flag) OVER w AS pf, lead(flag) OVER w AS nf FROM (SELECT key, idx, value, event_type IN ('error','purchase') AS flag FROM series) WINDOW w AS (PARTITION BY key ORDER BY idx)))""")
def formation_features(spark, sf):
    """Gap since the previous flagged row, burst length, 10-row density, delta and isolation."""
    s = series(spark, sf).select("key", "idx", "value", F.col("event_type").isin("error", "purchase").alias("flag"))

    def build(d, k):
        w = Window.partitionBy(*k).orderBy("idx")
        return d.withColumns({"density": F.avg(F.col("flag").cast("int")).over(w.rowsBetween(-9, 0)), "pv": F.lag("value").over(w),
                              "pf": F.lag("flag").over(w), "nf": F.lead("flag").over(w)})

    from trialgrid.operators.ordered import framed
    s = framed(s, ["key"], "idx", 9, 1, build)
    s = running(s, ["key"], ["idx"], {"last_flag": ("last", F.when(F.col("flag"), F.col("idx"))),
                                      "last_off": ("last", F.when(~F.col("flag"), F.col("idx")))})
    s = framed(s, ["key"], "idx", 1, 0, lambda d, k: d.withColumn("before", F.lag("last_flag").over(Window.partitionBy(*k).orderBy("idx"))))
    return s.select("key", "idx", "flag", F.when(F.col("flag"), F.col("idx") - F.col("before")).alias("gap"),
                    F.when(F.col("flag"), F.col("idx") - F.coalesce("last_off", F.lit(-1))).otherwise(0).cast("bigint").alias("burst_length"),
                    r6(F.col("density")).alias("density"), r6(F.col("value") - F.col("pv")).alias("value_delta"),
                    (F.col("flag") & ~F.coalesce("pf", F.lit(False)) & ~F.coalesce("nf", F.lit(False))).alias("isolated"))

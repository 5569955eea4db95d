"""Contracts of the run, prediction and draw tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialgrid.functions.exprs import r6
from trialgrid.operators import checks as C
from trialgrid.plans.registry import query
from trialgrid.plans.views import DRAWS, FOLDS, FRUNS, LEVELS, PREDS, R, RUNS, TRACES, draws, folded_runs, predictions, runs, table, traces, with_

_MONOTONE = "len(list_filter(range(1, 7), lambda i: q[i] > q[i+1])) = 0"


def _rules_sql(source: str, rules: dict[str, str]) -> str:
    each = " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*)::BIGINT AS rows, count_if(NOT coalesce({c}, false))::BIGINT AS failed FROM {source}" for n, c in rules.items())
    return f"SELECT *, failed = 0 AS passed FROM ({each})"


@query("prediction_gate", with_(PREDS) + _rules_sql("preds", {
    "levels_present": "len(q) = 7", "levels_ascend": _MONOTONE, "levels_in_unit_range": "q[1] >= 0 AND q[7] <= 1", "observed_finite": "isfinite(observed)", "fold_in_range": f"fold BETWEEN 0 AND {FOLDS - 1}",
    "observed_inside_90": "observed BETWEEN q[1] AND q[7]"}))
def prediction_gate(spark, sf):
    """Exact shape, order, range and finiteness of the out-of-fold quantiles, in one pass."""
    q = F.col("q")
    p = predictions(spark, sf)
    falls = F.exists(F.zip_with(F.slice(q, 1, 6), F.slice(q, 2, 6), lambda a, b: a > b), lambda x: x)
    return C.expect(p, {"levels_present": F.size(q) == 7, "levels_ascend": ~falls, "levels_in_unit_range": (F.get(q, 0) >= 0) & (F.get(q, 6) <= 1),
                        "observed_finite": ~F.isnan("observed") & (F.abs("observed") < float("inf")), "fold_in_range": F.col("fold").between(0, FOLDS - 1),
                        "observed_inside_90": F.col("observed").between(F.get(q, 0), F.get(q, 6))})


@query("run_gate", with_(RUNS) + _rules_sql("runs", {
    "quality_in_unit_range": "quality BETWEEN 0 AND 1", "runtime_positive": "runtime > 0", "passage_only_when_reached": "(passage IS NOT NULL) = target_reached", "type_only_when_failed": "(failure_type IS NOT NULL) = failure",
    "passage_within_budget": "passage IS NULL OR passage <= budget"}))
def run_gate(spark, sf):
    """Ranges and cross-column rules of the run table."""
    return C.expect(runs(spark, sf), {
        "quality_in_unit_range": F.col("quality").between(0, 1), "runtime_positive": F.col("runtime") > 0, "passage_only_when_reached": F.col("passage").isNotNull() == F.col("target_reached"),
        "type_only_when_failed": F.col("failure_type").isNotNull() == F.col("failure"), "passage_within_budget": F.col("passage").isNull() | (F.col("passage") <= F.col("budget"))})


@query("oof_completeness", with_(PREDS) + """SELECT count(w)::BIGINT AS expected, count_if(w IS NOT NULL AND n = 1)::BIGINT AS found_once, count_if(n IS NULL)::BIGINT AS missing,
 count_if(n > 1)::BIGINT AS repeated, count_if(w IS NULL)::BIGINT AS unexpected, count_if(n IS NULL OR n > 1 OR w IS NULL) = 0 AS complete
 FROM (SELECT DISTINCT run_id, fold, 1 AS w FROM fruns) a FULL JOIN (SELECT run_id, fold, count(*) AS n FROM preds WHERE seed % 50 <> 7 GROUP BY 1, 2) b USING (run_id, fold)""")
def oof_completeness(spark, sf):
    """Out-of-fold rows against the runs they must cover; predictions of some replicates are withheld to show as missing."""
    return C.completeness(predictions(spark, sf).filter(F.col("seed") % 50 != 7), folded_runs(spark, sf), ["run_id", "fold"])


@query("leakage_columns", with_(FRUNS) + "SELECT unnest(['run_id','problem_id','problem_family','domain','algorithm','seed','budget_type','budget','quality','runtime','target_reached','passage','failure','failure_type','fold']) AS name, "
       "unnest([count(run_id),count(problem_id),count(problem_family),count(domain),count(algorithm),count(seed),count(budget_type),count(budget),count(quality),count(runtime),count(target_reached),count(passage),count(failure),count(failure_type),count(fold)]) AS filled, "
       "unnest([false,false,false,false,false,true,false,false,true,true,true,true,true,true,false]) AS forbidden FROM fruns")
def leakage_columns(spark, sf):
    """Columns that must not be model inputs: targets, and names with a forbidden token."""
    return C.column_leaks(folded_runs(spark, sf), ["target", "failure", "passage", "seed"], ["quality", "runtime"])


@query("identity_check", with_(PREDS) + """SELECT p.run_id, r.problem_id AS run_problem_id, r.algorithm AS run_algorithm, r.run_id IS NOT NULL AND p.problem_id IS NOT DISTINCT FROM r.problem_id AND p.algorithm IS NOT DISTINCT FROM r.algorithm AS identity_ok
 FROM (SELECT run_id, CASE WHEN seed % 20 = 3 THEN problem_id + 1 ELSE problem_id END AS problem_id, algorithm FROM preds) p LEFT JOIN runs r USING (run_id)""")
def identity_check(spark, sf):
    """Problem and algorithm attached to predictions by run and compared with the copies there; some copies are altered."""
    p = predictions(spark, sf).select("run_id", F.when(F.col("seed") % 20 == 3, F.col("problem_id") + 1).otherwise(F.col("problem_id")).alias("problem_id"), "algorithm")
    return C.identity_joined(p, runs(spark, sf), "run_id", ["problem_id", "algorithm"]).select("run_id", "run_problem_id", "run_algorithm", "identity_ok")


_FID = "substr(sha256('row|' || run_id), 1, 24)"


@query("model_frame", with_(FRUNS) + f"SELECT {_FID} AS feature_id, run_id, fold, problem_family, algorithm, {R('quality')} AS quality, failure FROM fruns")
def model_frame(spark, sf):
    """Feature, target and split tables put together one to one by feature id."""
    t = C.model_tables(folded_runs(spark, sf), "run_id", ["problem_family", "algorithm"], ["quality", "failure"], F.col("fold"))
    both = C.one_to_one(C.one_to_one(t["splits"], t["features"], ["feature_id"]), t["targets"], ["feature_id"])
    return both.select("feature_id", "run_id", "fold", "problem_family", "algorithm", r6(F.col("quality")).alias("quality"), "failure")


@query("oof_frame", with_(PREDS) + f"""SELECT {_FID} AS feature_id, fold, {R('observed')} AS observed, {R('q[1]')} AS lower_90, {R('q[4]')} AS median, {R('q[7]')} AS upper_90,
 CASE WHEN observed < q[1] THEN 'below' WHEN observed > q[7] THEN 'above' ELSE 'inside' END AS status FROM preds""")
def oof_frame(spark, sf):
    """Observed value, central interval and status of each out-of-fold prediction by feature id."""
    p, q, y = predictions(spark, sf), F.col("q"), F.col("observed")
    return p.select(F.substring(F.sha2(F.concat_ws("|", F.lit("row"), "run_id"), 256), 1, 24).alias("feature_id"), "fold", r6(y).alias("observed"), r6(F.get(q, 0)).alias("lower_90"),
                    r6(F.get(q, 3)).alias("median"), r6(F.get(q, 6)).alias("upper_90"), F.when(y < F.get(q, 0), "below").when(y > F.get(q, 6), "above").otherwise("inside").alias("status"))


_CMP = ["model_mae", "reference_mae", "model_rmse", "reference_rmse", "delta_mae", "delta_rmse", "skill"]


@query("reference_comparison", with_(PREDS) + f"""SELECT fold, rows, {', '.join(f'{R(c)} AS {c}' for c in _CMP)} FROM (SELECT *, model_mae - reference_mae AS delta_mae, model_rmse - reference_rmse AS delta_rmse,
 CASE WHEN reference_mae > 0 THEN 1 - model_mae / reference_mae END AS skill FROM (SELECT p.fold, count(*)::BIGINT AS rows, avg(abs(q[4] - observed)) AS model_mae, avg(abs(m - observed)) AS reference_mae,
 sqrt(avg((q[4] - observed) * (q[4] - observed))) AS model_rmse, sqrt(avg((m - observed) * (m - observed))) AS reference_rmse FROM preds p JOIN
 (SELECT f.fold, avg(a.quality) AS m FROM fruns a, (SELECT DISTINCT fold FROM fruns) f WHERE a.fold <> f.fold GROUP BY 1) t ON t.fold = p.fold GROUP BY 1))""")
def reference_comparison(spark, sf):
    """Errors of the family median against the mean of the training folds, and their differences, per fold."""
    sums = folded_runs(spark, sf).groupBy("fold").agg(F.sum("quality").alias("s"), F.count("quality").alias("n"))
    total = sums.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    means = sums.crossJoin(F.broadcast(total)).select("fold", ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("reference"))  # one row on the right
    rows = predictions(spark, sf).join(means, "fold").withColumn("model", F.get("q", 3))
    return C.compared(rows, ["fold"], "observed", "model", "reference").select("fold", "rows", *[r6(F.col(c)).alias(c) for c in _CMP])


@query("fold_support", with_(FRUNS) + """SELECT fold, groups, rows, unseen_groups, (SELECT count(*) FROM fruns) - rows AS training_rows, (SELECT count(DISTINCT problem_family) FROM fruns) - unseen_groups AS training_groups, unseen_groups = 0 AS supported
 FROM (SELECT fold, count(*)::BIGINT AS groups, sum(n)::BIGINT AS rows, count_if(t = n)::BIGINT AS unseen_groups FROM (SELECT fold, problem_family, count(*) AS n FROM fruns GROUP BY 1, 2) JOIN
 (SELECT problem_family, count(*) AS t FROM fruns GROUP BY 1) USING (problem_family) GROUP BY 1)""")
def fold_support(spark, sf):
    """Whether every family of a fold also has training rows outside it."""
    return C.fold_support(folded_runs(spark, sf), "fold", "problem_family")


@query("benchmark_check", """SELECT count(*)::BIGINT AS problems, count(DISTINCT p_partkey) = count(*) AS ids_unique, count(DISTINCT p_type)::BIGINT AS families, (max(n) - min(n))::BIGINT AS family_spread, max(n) - min(n) <= 1 AS balanced,
 min(fold)::BIGINT AS first_fold, max(fold)::BIGINT AS last_fold, count(DISTINCT fold) = 5 AS folds_complete, (sum(h) % 4503599627370496)::BIGINT AS content FROM
 (SELECT p_partkey, p_type, p_partkey % 5 AS fold, count(*) OVER (PARTITION BY p_type) AS n, CAST('0x'||substr(md5(p_partkey || '|' || p_type),1,12) AS BIGINT) AS h FROM part)""")
def benchmark_check(spark, sf):
    """Counts, uniqueness, family balance, fold coverage and an order-free content hash of the problem table."""
    p = table(spark, sf, "part").select("p_partkey", "p_type", (F.col("p_partkey") % 5).alias("fold"))
    n = p.groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("families"), F.max("n").alias("most"), F.min("n").alias("least"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("p_partkey").cast("string"), "p_type")), 1, 12), 16, 10).cast("decimal(38,0)")
    ids = p.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("k"), F.sum(h).alias("h"), F.min("fold").alias("fold"))
    every = ids.agg(F.sum("k").alias("problems"), (F.max("k") == 1).alias("ids_unique"), F.min("fold").alias("first_fold"), F.max("fold").alias("last_fold"),
                    (F.count_distinct("fold") == 5).alias("folds_complete"), (F.sum("h") % F.lit(2**52)).cast("bigint").alias("content"))
    return every.crossJoin(n).select("problems", "ids_unique", "families", (F.col("most") - F.col("least")).alias("family_spread"), (F.col("most") - F.col("least") <= 1).alias("balanced"),
                                     "first_fold", "last_fold", "folds_complete", "content")  # one row each


_FRACTIONS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0]


@query("checkpoint_steps", with_(TRACES) + f"SELECT run_id, list_sort(list_distinct(list_transform({_FRACTIONS}, lambda f: least(steps, greatest(1, ceil(steps * f::DOUBLE)))::BIGINT))) AS checkpoints FROM traces GROUP BY run_id, steps")
def checkpoint_steps(spark, sf):
    """Steps at fixed fractions of each run's length."""
    t = traces(spark, sf).groupBy("run_id").agg(F.max("steps").alias("steps"))
    return t.select("run_id", C.checkpoint_steps(F.col("steps"), _FRACTIONS).alias("checkpoints"))


@query("gap_clusters", with_(DRAWS) + "SELECT round_no, (1 + len(list_filter(range(1, 6), lambda i: numbers[i+1] - numbers[i] > 13)))::INTEGER AS clusters FROM draws")
def gap_clusters(spark, sf):
    """Clusters of a draw's sorted numbers, split at gaps above 13."""
    return draws(spark, sf).select("round_no", C.gap_clusters(F.col("numbers"), 13).alias("clusters"))


@query("class_support", with_(FRUNS) + """SELECT fold, failure_type, (SELECT count(*) FROM fruns b WHERE b.failure_type IS NOT DISTINCT FROM a.failure_type) - count(*) AS training_rows, count(*)::BIGINT AS validation_rows FROM fruns a GROUP BY 1, 2""")
def class_support(spark, sf):
    """Rows of each class inside a fold and in all other folds."""
    inside = folded_runs(spark, sf).groupBy("failure_type", "fold").agg(F.count(F.lit(1)).alias("validation_rows"))
    total = inside.groupBy("failure_type").agg(F.sum("validation_rows").alias("t")).withColumnRenamed("failure_type", "_type")
    return inside.join(total, F.col("failure_type").eqNullSafe(F.col("_type"))).select("fold", "failure_type", (F.col("t") - F.col("validation_rows")).alias("training_rows"), "validation_rows")

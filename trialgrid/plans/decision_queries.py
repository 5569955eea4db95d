"""Utility, selection, sensitivity, stability and verdict queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialgrid.functions import exprs as X
from trialgrid.functions import quantdist as Q
from trialgrid.functions.exprs import r6
from trialgrid.operators import predictive as P
from trialgrid.operators import replicates as RP
from trialgrid.operators.folds import out_of_fold_quantiles, out_of_fold_sums
from trialgrid.operators.ordered import top_rows
from trialgrid.plans.registry import query
from trialgrid.plans.views import FOLDS, FRUNS, R, U, folded_runs, with_

# candidates compete inside a problem; predictions are out-of-fold means and rates by (algorithm, family)
CAND = FRUNS + f""",
ef AS (SELECT unnest(range({FOLDS})) AS fold),
sc AS MATERIALIZED (SELECT f.fold, domain, greatest(median(runtime), 1e-6) AS scale FROM fruns a, ef f WHERE a.fold<>f.fold AND runtime>0 GROUP BY 1,2),
st AS MATERIALIZED (SELECT f.fold, algorithm, problem_family, avg(quality) AS mq, stddev_pop(quality) AS sq, avg(runtime) AS mr, avg(failure::INT) AS pf, avg((quality>=0.2::DOUBLE AND NOT failure)::INT) AS ps FROM fruns a, ef f WHERE a.fold<>f.fold GROUP BY 1,2,3),
pw AS (SELECT * FROM (VALUES {', '.join(f"('{p[0]}', {', '.join(f'{v}::DOUBLE' for v in p[1:])})" for p in P.PROFILES)}) t(profile, quality_weight, runtime_weight, failure_penalty, uncertainty_penalty, sla_bonus)),
comp AS MATERIALIZED (SELECT problem_id, problem_family, domain, fold, algorithm, count(*)::BIGINT AS replicates, avg(mq) AS pred_quality, avg(sq) AS pred_uncertainty, avg(least(10.0, mr/scale)) AS pred_runtime_ratio, avg(pf) AS pred_failure, avg(ps) AS pred_sla,
 avg(quality) AS real_quality, avg(least(10.0, runtime/scale)) AS real_runtime_ratio, avg(failure::INT) AS real_failure, avg((quality>=0.2::DOUBLE AND runtime<=scale AND NOT failure)::INT) AS real_sla FROM fruns JOIN sc USING (fold, domain) JOIN st USING (fold, algorithm, problem_family) GROUP BY 1,2,3,4,5),
ut AS MATERIALIZED (SELECT *, quality_weight*pred_quality-runtime_weight*pred_runtime_ratio-failure_penalty*pred_failure-uncertainty_penalty*pred_uncertainty+sla_bonus*pred_sla AS eu, quality_weight*real_quality-runtime_weight*real_runtime_ratio-failure_penalty*real_failure+sla_bonus*real_sla AS ru FROM comp, pw),
tb AS MATERIALIZED (SELECT fold, domain, profile, algorithm AS baseline FROM (SELECT f.fold, domain, profile, algorithm, row_number() OVER (PARTITION BY f.fold, domain, profile ORDER BY round(avg(ru),9) DESC, algorithm) AS rn FROM ut a, ef f WHERE a.fold<>f.fold GROUP BY 1,2,3,4) WHERE rn=1),
rk AS MATERIALIZED (SELECT ut.*, tb.baseline, row_number() OVER (PARTITION BY problem_id, profile ORDER BY round(eu,12) DESC, algorithm) AS pr, row_number() OVER (PARTITION BY problem_id, profile ORDER BY round(ru,12) DESC, algorithm) AS rr FROM ut JOIN tb USING (fold, domain, profile)),
se AS MATERIALIZED (SELECT profile, problem_id, problem_family, domain, fold, count(*)::BIGINT AS candidates, max(CASE WHEN pr=1 THEN algorithm END) AS selected, max(CASE WHEN rr=1 THEN algorithm END) AS oracle, max(CASE WHEN pr=1 THEN ru END) AS su, max(CASE WHEN rr=1 THEN ru END) AS ou, max(CASE WHEN algorithm=baseline THEN ru END) AS bu, avg(ru) AS au, list(eu ORDER BY eu DESC) AS e FROM rk GROUP BY 1,2,3,4,5),
sel AS MATERIALIZED (SELECT * EXCLUDE (e), selected=oracle AS correct, greatest(0,ou-su) AS oracle_regret, greatest(0,ou-bu) AS baseline_regret, greatest(0,ou-au) AS random_regret, su-bu AS gain_vs_baseline, su-au AS gain_vs_random, CASE WHEN candidates>1 THEN e[1]-e[2] ELSE 0 END AS margin,
 CASE WHEN candidates>1 THEN -list_sum(list_transform(e, lambda v: exp((v-e[1])/0.1)/list_sum(list_transform(e, lambda w: exp((w-e[1])/0.1)))*ln(greatest(1e-15,exp((v-e[1])/0.1)/list_sum(list_transform(e, lambda w: exp((w-e[1])/0.1)))))))/ln(candidates) ELSE 0 END AS entropy FROM se)"""


def runtime_scales(spark, sf):
    """Median positive runtime of the other folds per (fold, domain), floored."""
    r = folded_runs(spark, sf).filter("runtime > 0")
    q = out_of_fold_quantiles(r, ["domain"], "fold", FOLDS, "runtime", [0.5])
    return q.select("fold", "domain", F.greatest(F.get("q", 0), F.lit(1e-6)).alias("scale"))


def components(spark, sf):
    """One row per (problem, algorithm): predicted and realised utility components."""
    r = folded_runs(spark, sf)
    y = F.col("quality")
    ok = (y >= 0.2) & ~F.col("failure")
    s = out_of_fold_sums(r, ["algorithm", "problem_family"], "fold", {
        "n": F.lit(1), "s": y, "ss": y * y, "t": F.col("runtime"), "f": F.col("failure").cast("int"), "g": ok.cast("int")})
    n = F.col("n")
    m = F.col("s") / n
    s = s.filter("n > 0").select("fold", "algorithm", "problem_family", m.alias("mq"), F.sqrt(F.greatest(F.col("ss") / n - m * m, F.lit(0.0))).alias("sq"),
                 (F.col("t") / n).alias("mr"), (F.col("f") / n).alias("pf"), (F.col("g") / n).alias("ps"))
    j = r.join(F.broadcast(runtime_scales(spark, sf)), ["fold", "domain"]).join(F.broadcast(s), ["fold", "algorithm", "problem_family"])
    cap = lambda c: F.least(F.lit(10.0), c)
    return j.groupBy("problem_id", "problem_family", "domain", "fold", "algorithm").agg(
        F.count(F.lit(1)).alias("replicates"), F.avg("mq").alias("pred_quality"), F.avg("sq").alias("pred_uncertainty"),
        F.avg(cap(F.col("mr") / F.col("scale"))).alias("pred_runtime_ratio"), F.avg("pf").alias("pred_failure"), F.avg("ps").alias("pred_sla"),
        F.avg(y).alias("real_quality"), F.avg(cap(F.col("runtime") / F.col("scale"))).alias("real_runtime_ratio"),
        F.avg(F.col("failure").cast("int")).alias("real_failure"),
        F.avg((ok & (F.col("runtime") <= F.col("scale"))).cast("int")).alias("real_sla"))


_BASE_KEYS = ["fold", "domain", "profile"]


def training_best(u):
    """Best algorithm of the other folds per (fold, domain, profile)."""
    s = out_of_fold_sums(u, ["domain", "profile", "algorithm"], "fold", {"n": F.lit(1), "s": F.col("realized_utility")})
    s = s.filter("n > 0").withColumn("m", F.round(F.col("s") / F.col("n"), 9))
    return top_rows(s, _BASE_KEYS, [F.desc("m"), F.asc("algorithm")], 1).select(*_BASE_KEYS, F.col("algorithm").alias("baseline_algorithm"))


def ranked_candidates(spark, sf):
    c = components(spark, sf).crossJoin(F.broadcast(P.profile_table(spark)))  # four fixed profiles
    u = P.utilities(c)
    return P.ranked(u.join(F.broadcast(training_best(u)), _BASE_KEYS), ["problem_id", "profile"])


def selection_table(spark, sf):
    return P.selections(ranked_candidates(spark, sf), ["profile", "problem_id", "problem_family", "domain", "fold"])


@query("runtime_scales", with_(CAND) + f"SELECT fold, domain, {R('scale')} AS scale FROM sc")
def q_runtime_scales(spark, sf):
    return runtime_scales(spark, sf).withColumn("scale", r6(F.col("scale")))


_CC = ["pred_quality", "pred_uncertainty", "pred_runtime_ratio", "pred_failure", "pred_sla", "real_quality", "real_runtime_ratio", "real_failure", "real_sla"]


@query("candidate_components", with_(CAND) + f"SELECT problem_id, algorithm, fold, replicates, {', '.join(f'{R(c)} AS {c}' for c in _CC)} FROM comp")
def candidate_components(spark, sf):
    return components(spark, sf).select("problem_id", "algorithm", "fold", "replicates", *[r6(F.col(c)).alias(c) for c in _CC])


@query("candidate_ranks", with_(CAND) + f"SELECT problem_id, profile, algorithm, {R('eu')} AS expected_utility, {R('ru')} AS realized_utility, pr AS predicted_rank, rr AS realized_rank, baseline AS baseline_algorithm FROM rk")
def candidate_ranks(spark, sf):
    """Utilities and ranks with name tie-breaks."""
    return ranked_candidates(spark, sf).select("problem_id", "profile", "algorithm", r6(F.col("expected_utility")).alias("expected_utility"),
                                               r6(F.col("realized_utility")).alias("realized_utility"), "predicted_rank", "realized_rank", "baseline_algorithm")


_SC = ["oracle_regret", "baseline_regret", "random_regret", "gain_vs_baseline", "gain_vs_random", "margin", "entropy"]


@query("selections", with_(CAND) + f"SELECT problem_id, profile, candidates, selected, oracle, correct, {', '.join(f'{R(c)} AS {c}' for c in _SC)} FROM sel")
def selections(spark, sf):
    return selection_table(spark, sf).select("problem_id", "profile", "candidates", "selected", "oracle", "correct", *[r6(F.col(c)).alias(c) for c in _SC])


@query("selection_metrics", with_(CAND) + f"""SELECT CASE grouping(fold, domain) WHEN 3 THEN 'overall' WHEN 1 THEN 'fold' ELSE 'domain' END AS scope, profile, fold, domain, count(*)::BIGINT AS problems, {R('avg(correct::INT)')} AS accuracy, {R('avg(oracle_regret)')} AS mean_regret, {R('avg(gain_vs_random)')} AS mean_gain FROM sel GROUP BY GROUPING SETS ((profile), (profile, fold), (profile, domain))""")
def selection_metrics(spark, sf):
    """Accuracy, regret and gain overall, per fold and per domain in one pass."""
    s = selection_table(spark, sf)
    sets = [["profile"], ["profile", "fold"], ["profile", "domain"]]
    out = P.scopes(s, ["profile", "fold", "domain"], sets, [
        F.count(F.lit(1)).alias("problems"), r6(F.avg(F.col("correct").cast("int"))).alias("accuracy"),
        r6(F.avg("oracle_regret")).alias("mean_regret"), r6(F.avg("gain_vs_random")).alias("mean_gain")])
    scope = F.when(F.col("scope") == "profile", "overall").otherwise(F.substring_index("scope", "_x_", -1))
    return out.select(scope.alias("scope"), "profile", "fold", "domain", "problems", "accuracy", "mean_regret", "mean_gain")


@query("rank_permutation", with_(CAND) + """SELECT profile, count(*)::BIGINT AS groups, count_if(list(pr ORDER BY pr) = range(1, n+1)) AS ok FROM rk GROUP BY 1""".replace(
    "SELECT profile, count(*)::BIGINT AS groups, count_if(list(pr ORDER BY pr) = range(1, n+1)) AS ok FROM rk GROUP BY 1",
    "SELECT profile, count(*)::BIGINT AS groups, count_if(a AND b AND s = 1 AND o = 1)::BIGINT AS ok FROM (SELECT profile, problem_id, list(pr ORDER BY pr) = range(1, count(*)+1) AS a, list(rr ORDER BY rr) = range(1, count(*)+1) AS b, count_if(pr=1) AS s, count_if(rr=1) AS o FROM rk GROUP BY 1,2) GROUP BY 1"))
def rank_permutation(spark, sf):
    """Ranks are 1..n and exactly one row is selected and one is the oracle in each group."""
    r = ranked_candidates(spark, sf)
    # distinct, bounded sums stand in for the sorted list: 1..n is the only set with these sum and sum of squares
    n = F.count(F.lit(1))
    def perm(c):
        return (F.sum(c) * 2 == n * (n + 1)) & (F.sum(F.col(c) * F.col(c)) * 6 == n * (n + 1) * (2 * n + 1)) & (F.min(c) == 1) & (F.max(c) == n)
    g = r.groupBy("profile", "problem_id").agg((perm("predicted_rank") & perm("realized_rank") & (F.count_if(F.col("predicted_rank") == 1) == 1)
                                               & (F.count_if(F.col("realized_rank") == 1) == 1)).alias("ok"))
    return g.groupBy("profile").agg(F.count(F.lit(1)).alias("groups"), F.count_if("ok").alias("ok"))


_COMP = ", ".join(f"CASE WHEN m.component='{c}' THEN {c}*m.multiplier ELSE {c} END AS {c}" for c in P.COMPONENTS)
_MOVES = ", ".join(["('nominal','',1.0::DOUBLE)"] + [f"('{c}','{d}',{m}::DOUBLE)" for c in P.COMPONENTS for d, m in (("minus", 0.75), ("plus", 1.25))])
SCEN = CAND + f""",
scn AS (SELECT profile, component, component='nominal' AS is_nominal, CASE WHEN component='nominal' THEN profile||'__nominal' ELSE profile||'__'||component||'__'||direction||'25' END AS scenario_id, {_COMP} FROM pw, (VALUES {_MOVES}) m(component, direction, multiplier)),
su AS (SELECT c.*, s.profile, s.scenario_id, s.is_nominal, quality_weight*pred_quality-runtime_weight*pred_runtime_ratio-failure_penalty*pred_failure-uncertainty_penalty*pred_uncertainty+sla_bonus*pred_sla AS eu, quality_weight*real_quality-runtime_weight*real_runtime_ratio-failure_penalty*real_failure+sla_bonus*real_sla AS ru FROM comp c, scn s),
ss AS MATERIALIZED (SELECT profile, scenario_id, is_nominal, problem_id, max(CASE WHEN pr=1 THEN algorithm END) AS selected, max(CASE WHEN rr=1 THEN algorithm END) AS oracle, max(ru)-max(CASE WHEN pr=1 THEN ru END) AS regret FROM (
 SELECT *, row_number() OVER (PARTITION BY scenario_id, problem_id ORDER BY round(eu,12) DESC, algorithm) AS pr, row_number() OVER (PARTITION BY scenario_id, problem_id ORDER BY round(ru,12) DESC, algorithm) AS rr FROM su) GROUP BY 1,2,3,4)"""


def scenario_selections(spark, sf):
    """Selection of every problem under each of the 44 weight scenarios (scenario table is fixed and broadcast)."""
    c = components(spark, sf).crossJoin(F.broadcast(P.scenario_table(spark)))
    r = P.ranked(P.utilities(c), ["scenario_id", "problem_id"])
    sel, orc = F.col("predicted_rank") == 1, F.col("realized_rank") == 1
    return r.groupBy("profile", "scenario_id", "is_nominal", "problem_id").agg(
        F.max(F.when(sel, F.col("algorithm"))).alias("selected"), F.max(F.when(orc, F.col("algorithm"))).alias("oracle"),
        (F.max("realized_utility") - F.max(F.when(sel, F.col("realized_utility")))).alias("regret"))


@query("sensitivity", with_(SCEN) + f"""SELECT s.profile, s.scenario_id, count(*)::BIGINT AS problems, {R('avg((s.selected=n.selected)::INT)')} AS retention, {R('avg((s.selected=s.oracle)::INT)')} AS accuracy, {R('avg(s.regret)')} AS mean_regret FROM ss s JOIN ss n ON n.profile=s.profile AND n.problem_id=s.problem_id AND n.is_nominal GROUP BY 1,2""")
def sensitivity(spark, sf):
    """Retention of the nominal choice, accuracy and regret per scenario."""
    s = scenario_selections(spark, sf)
    nominal = F.max(F.when(F.col("is_nominal"), F.col("selected"))).over(Window.partitionBy("profile", "problem_id"))  # 11 rows a group
    s = s.withColumn("nominal", nominal)
    return s.groupBy("profile", "scenario_id").agg(
        F.count(F.lit(1)).alias("problems"), r6(F.avg((F.col("selected") == F.col("nominal")).cast("int"))).alias("retention"),
        r6(F.avg((F.col("selected") == F.col("oracle")).cast("int"))).alias("accuracy"), r6(F.avg("regret")).alias("mean_regret"))


@query("profile_stability", with_(CAND) + f"""SELECT problem_id, count(*)::BIGINT AS profiles, count(DISTINCT selected)::BIGINT AS algorithms, arg_min(selected, (10000-c)*10 + CASE selected WHEN 'baseline' THEN 1 ELSE 2 END) AS modal, {R('max(c)/count(*)')} AS modal_share, count(DISTINCT selected)=1 AS all_agree,
 '{{' || string_agg('"'||profile||'":"'||selected||'"', ',' ORDER BY profile) || '}}' AS signature FROM (SELECT *, count(*) OVER (PARTITION BY problem_id, selected) AS c FROM sel) GROUP BY 1""")
def profile_stability(spark, sf):
    """Modal selection over profiles with name tie-break, agreement flag and JSON signature."""
    s = selection_table(spark, sf).select("problem_id", "profile", "selected")
    counts = s.groupBy("problem_id", "selected").agg(F.count(F.lit(1)).alias("c"))
    mode = top_rows(counts, ["problem_id"], [F.desc("c"), F.asc("selected")], 1).select("problem_id", F.col("selected").alias("modal"), "c")
    g = s.groupBy("problem_id").agg(
        F.count(F.lit(1)).alias("profiles"), F.countDistinct("selected").alias("algorithms"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("profile", "selected"))))).alias("signature"))
    return g.join(mode, "problem_id").select("problem_id", "profiles", "algorithms", "modal", r6(F.col("c") / F.col("profiles")).alias("modal_share"),
                                             (F.col("algorithms") == 1).alias("all_agree"), "signature")


_CB = CAND + f""",
cl AS MATERIALIZED (SELECT profile, problem_id AS unit, correct::INT::DOUBLE AS accuracy, oracle_regret AS regret, gain_vs_random AS gain FROM sel),
""" + RP.replicate_sql("bs", "cl", ["profile"], ["accuracy", "regret", "gain"], 10_000, "poisson", "boot")


@query("cluster_bootstrap", with_(_CB) + f"""SELECT profile, {R('quantile_cont(accuracy/nullif(w,0),0.025)')} AS accuracy_lo, {R('quantile_cont(accuracy/nullif(w,0),0.975)')} AS accuracy_hi, {R('quantile_cont(regret/nullif(w,0),0.025)')} AS regret_lo,
 {R('quantile_cont(regret/nullif(w,0),0.975)')} AS regret_hi, {R('quantile_cont(gain/nullif(w,0),0.025)')} AS gain_lo, {R('quantile_cont(gain/nullif(w,0),0.975)')} AS gain_hi, {R('avg((gain>0)::INT)')} AS p_gain FROM bs GROUP BY 1""")
def cluster_bootstrap(spark, sf):
    """Problem-cluster bootstrap (10,000 replicates) of accuracy, regret and gain per profile."""
    s = selection_table(spark, sf).select("profile", "problem_id", F.col("correct").cast("double").alias("accuracy"), F.col("oracle_regret").alias("regret"), F.col("gain_vs_random").alias("gain"))
    m = RP.replicate_sums(s, ["profile"], ["accuracy", "regret", "gain"], "problem_id", 10_000, "poisson", "boot")
    q = m.groupBy("profile").agg(*[RP.interval(F.try_divide(F.col(v), F.col(f"{v}_weight")), 0.95).alias(v) for v in ("accuracy", "regret", "gain")], r6(F.avg((F.col("gain") > 0).cast("int"))).alias("p_gain"))
    return q.select("profile", *[r6(F.get(v, k)).alias(f"{v}_{end}") for v in ("accuracy", "regret", "gain") for k, end in enumerate(("lo", "hi"))], "p_gain")


_THRESH = [("selection_value", "mean_gain", ">", 0.0), ("selection_accuracy", "accuracy", ">=", 0.5), ("selection_regret", "mean_regret", "<=", 0.05)]


@query("criteria", with_(CAND) + f"""SELECT profile, criterion, metric, {R('value')} AS value, CASE WHEN (direction='>' AND value>threshold) OR (direction='>=' AND value>=threshold) OR (direction='<=' AND value<=threshold) THEN 'PASS' ELSE 'FAIL' END AS status FROM (
 SELECT profile, unnest(['mean_gain','accuracy','mean_regret']) AS metric, unnest([avg(gain_vs_random), avg(correct::INT), avg(oracle_regret)]) AS value FROM sel GROUP BY 1) JOIN (VALUES {', '.join(f"('{c}','{m}','{d}',{t}::DOUBLE)" for c, m, d, t in _THRESH)}) t(criterion, metric, direction, threshold) USING (metric)""")
def criteria(spark, sf):
    """Metrics against thresholds with a direction."""
    s = selection_table(spark, sf).groupBy("profile").agg(
        F.avg("gain_vs_random").alias("mean_gain"), F.avg(F.col("correct").cast("int")).alias("accuracy"), F.avg("oracle_regret").alias("mean_regret"))
    m = s.select("profile", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("mean_gain", "accuracy", "mean_regret")])))
    t = spark.createDataFrame(_THRESH, "criterion string, metric string, direction string, threshold double")
    v, th, d = F.col("value"), F.col("threshold"), F.col("direction")
    ok = F.when(d == ">", v > th).when(d == ">=", v >= th).otherwise(v <= th)
    return m.join(F.broadcast(t), "metric").select("profile", "criterion", "metric", r6(v).alias("value"), F.when(ok, "PASS").otherwise("FAIL").alias("status"))


@query("verdict", with_(CAND) + """SELECT profile, count_if(ok)::BIGINT AS passed, count(*)::BIGINT AS total, CASE WHEN bool_and(ok) THEN 'DEPLOYABLE_SUCCESS' WHEN NOT bool_or(ok) THEN 'NO_SIGNAL' ELSE 'PARTIAL_SUCCESS_RESEARCH_ONLY' END AS verdict FROM (
 SELECT profile, unnest([avg(gain_vs_random)>0, avg(correct::INT)>=0.5, avg(oracle_regret)<=0.05]) AS ok FROM sel GROUP BY 1) GROUP BY 1""")
def verdict(spark, sf):
    """Four-way style decision from the criteria of each profile."""
    ok = F.col("status") == "PASS"
    return criteria(spark, sf).groupBy("profile").agg(
        F.count_if(ok).alias("passed"), F.count(F.lit(1)).alias("total"),
        F.when(F.bool_and(ok), "DEPLOYABLE_SUCCESS").when(~F.bool_or(ok), "NO_SIGNAL").otherwise("PARTIAL_SUCCESS_RESEARCH_ONLY").alias("verdict"))

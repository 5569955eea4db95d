"""Predictive distributions, calibration, survival, pooling, recalibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialgrid.functions import exprs as X
from trialgrid.functions import quantdist as Q
from trialgrid.functions.exprs import r6
from trialgrid.operators import predictive as P
from trialgrid.operators.folds import out_of_fold_quantiles
from trialgrid.plans.registry import query
from trialgrid.plans.views import BINARY, FOLDS, FRUNS, LEVELS, PREDS, RUNS, R, binary, folded_runs, predictions, with_

_L = list(Q.LEVELS)


def _dist_sql(src, probs, sup, x, floor_, top, name, time=False):
    """Piecewise-linear distribution columns spelled out with list functions."""
    p = "[" + ",".join(f"{v}::DOUBLE" for v in probs) + "]"
    seg = "greatest(1, least(8, len(list_filter(s, lambda v: v <= xx))))"
    pin = "list_transform(range(1,10), lambda i: greatest(p[i]*(obs-c[i]), (p[i]-1)*(obs-c[i])))"
    trap = lambda a: f"list_sum(list_transform(range(1,9), lambda i: ({a}[i]+{a}[i+1])/2*(p[i+1]-p[i])))"
    c = "list_transform(s, lambda v: exp(greatest(-30.0, least(30.0, v))))" if time else "s"
    cdf = "p[i] + greatest(0.0, least(1.0, CASE WHEN s[i+1]-s[i] > 1e-12 THEN (xx-s[i])/(s[i+1]-s[i]) ELSE 0 END))*(p[i+1]-p[i])"
    edge = "CASE WHEN xx <= s[1] THEN 0.0 WHEN xx >= s[9] THEN 1.0 ELSE" if time else "CASE WHEN obs <= 0 THEN 0.0 WHEN obs >= 1 THEN 1.0 ELSE"
    nll_x = "xx" if time else "least(greatest(obs,1e-6),1-1e-6)"
    return f"""{name}0 AS (SELECT *, {p} AS p, {sup} AS s, {x} AS xx FROM {src}),
{name}1 AS (SELECT *, {seg} AS i, greatest(1, least(8, len(list_filter(s, lambda v: v <= {nll_x})))) AS j, {c} AS c FROM {name}0),
{name} AS MATERIALIZED (SELECT * EXCLUDE (p, s, i, j, c, pin), {edge} {cdf} END AS pit, -ln(greatest(1e-12, least({top}, (p[j+1]-p[j])/greatest(s[j+1]-s[j], {floor_})))) {'+ xx' if time else ''} AS nll, 2*{trap('pin')} AS crps,
 {trap('c')} AS pred_mean, sqrt(greatest({trap('list_transform(c, lambda v: v*v)')}-power({trap('c')},2), 0)) AS pred_std FROM (SELECT *, {pin} AS pin FROM {name}1))"""


DIST = PREDS + ",\n" + _dist_sql("(SELECT *, observed AS obs FROM preds)", Q.UNIT_PROBS, "list_concat([0.0::DOUBLE], q, [1.0::DOUBLE])", "observed", "1e-4", "1e6", "dist")
_RT = FRUNS + f""",
rpred AS MATERIALIZED (SELECT r.*, r.runtime AS obs, p.q FROM fruns r JOIN (SELECT a.problem_family, f.fold, quantile_cont(a.runtime, {LEVELS}) AS q FROM fruns a, (SELECT unnest(range({FOLDS})) AS fold) f WHERE a.fold <> f.fold GROUP BY 1,2) p ON p.problem_family=r.problem_family AND p.fold=r.fold)"""
_LOGS = "list_transform(q, lambda v: ln(greatest(v,1e-12)))"
RDIST = _RT + ",\n" + _dist_sql("rpred", Q.TIME_PROBS, f"list_concat([ln(q[1])-greatest(ln(q[2])-ln(q[1]),0.25)], {_LOGS}, [ln(q[7])+greatest(ln(q[7])-ln(q[6]),0.25)])", "ln(greatest(obs,1e-12))", "1e-6", "1e12", "rdist", time=True)


def quality_rows(spark, sf):
    return P.distribution_rows(predictions(spark, sf))


def runtime_rows(spark, sf):
    r = folded_runs(spark, sf)
    q = out_of_fold_quantiles(r, ["problem_family"], "fold", FOLDS, "runtime", LEVELS)
    return P.distribution_rows(r.join(F.broadcast(q), ["problem_family", "fold"]).withColumn("observed", F.col("runtime")), "time")


_DC = ["pit", "nll", "crps", "pred_mean", "pred_std"]


@query("quality_distribution", with_(DIST) + f"SELECT run_id, {', '.join(f'{R(c)} AS {c}' for c in _DC)} FROM dist")
def quality_distribution(spark, sf):
    """CDF at the observation, log score, CRPS and moments of each out-of-fold prediction."""
    return quality_rows(spark, sf).select("run_id", *[r6(F.col(c)).alias(c) for c in _DC])


@query("runtime_distribution", with_(RDIST) + f"SELECT run_id, {', '.join(f'{R(c)} AS {c}' for c in _DC)} FROM rdist")
def runtime_distribution(spark, sf):
    """The same on a log-time support."""
    return runtime_rows(spark, sf).select("run_id", *[r6(F.col(c)).alias(c) for c in _DC])


_MET = ["nll", "crps", "pit_mean", "pit_variance", "coverage_80", "coverage_90", "width_80", "width_90", "median_mae", "median_rmse", "mean_mae", "calibration_mae", "calibration_max_abs"]
_ERR = ", ".join(f"abs(avg((obs<=q[{i + 1}])::INT)-{lv})" for i, lv in enumerate(_L))
_MET_SQL = f"""count(*)::BIGINT AS rows, {R('avg(nll)')} AS nll, {R('avg(crps)')} AS crps, {R('avg(pit)')} AS pit_mean, {R('var_pop(pit)')} AS pit_variance, {R('avg((obs>=q[2] AND obs<=q[6])::INT)')} AS coverage_80, {R('avg((obs>=q[1] AND obs<=q[7])::INT)')} AS coverage_90,
 {R('avg(q[6]-q[2])')} AS width_80, {R('avg(q[7]-q[1])')} AS width_90, {R('avg(abs(obs-q[4]))')} AS median_mae, {R('sqrt(avg((obs-q[4])*(obs-q[4])))')} AS median_rmse, {R('avg(abs(obs-pred_mean))')} AS mean_mae,
 {R(f'list_sum([{_ERR}])/7.0')} AS calibration_mae, {R(f'greatest({_ERR})')} AS calibration_max_abs"""
_SETS = [[], ["domain"], ["algorithm"], ["domain", "algorithm"]]


def _scoped(rows):
    out = P.scopes(rows, ["domain", "algorithm"], _SETS, P.distribution_aggs())
    return out.select("scope", "domain", "algorithm", "rows", *[r6(F.col(c)).alias(c) for c in _MET])


def _scope_sql(src):
    return f"""SELECT CASE grouping(domain, algorithm) WHEN 3 THEN 'overall' WHEN 1 THEN 'domain' WHEN 2 THEN 'algorithm' ELSE 'domain_x_algorithm' END AS scope, domain, algorithm, {_MET_SQL} FROM {src} GROUP BY GROUPING SETS ((), (domain), (algorithm), (domain, algorithm))"""


@query("quality_metrics_by_scope", with_(DIST) + _scope_sql("dist"))
def quality_metrics_by_scope(spark, sf):
    """All distribution metrics at four scopes in one pass."""
    return _scoped(quality_rows(spark, sf))


@query("runtime_metrics_by_scope", with_(RDIST) + _scope_sql("rdist"))
def runtime_metrics_by_scope(spark, sf):
    return _scoped(runtime_rows(spark, sf))


@query("quantile_calibration", with_(PREDS) + f"""SELECT fold, level, count(*)::BIGINT AS rows, {R('avg((observed<=v)::INT)')} AS empirical FROM (SELECT fold, observed, unnest(q) AS v, unnest({LEVELS}::DOUBLE[]) AS level FROM preds) GROUP BY 1,2""")
def quantile_calibration(spark, sf):
    """Empirical coverage of each level per fold."""
    lv = F.lit([float(v) for v in LEVELS])
    e = predictions(spark, sf).select("fold", "observed", F.inline(F.arrays_zip(F.col("q").alias("v"), lv.alias("level"))))
    return e.groupBy("fold", "level").agg(F.count(F.lit(1)).alias("rows"), r6(F.avg((F.col("observed") <= F.col("v")).cast("int"))).alias("empirical"))


@query("threshold_brier", with_(PREDS) + f"""SELECT threshold, {R('avg(power((observed<=threshold)::INT - cdf, 2))')} AS brier FROM (SELECT observed, threshold, p[i]+greatest(0.0,least(1.0,CASE WHEN s[i+1]-s[i]>1e-12 THEN (threshold-s[i])/(s[i+1]-s[i]) ELSE 0 END))*(p[i+1]-p[i]) AS cdf FROM (
 SELECT *, greatest(1,least(8,len(list_filter(s, lambda v: v<=threshold)))) AS i FROM (SELECT observed, list_concat([0.0::DOUBLE], q, [1.0::DOUBLE]) AS s, {[0.0, *_L, 1.0]}::DOUBLE[] AS p, unnest([0.25::DOUBLE,0.5,0.75,0.9]) AS threshold FROM preds))) GROUP BY 1""")
def threshold_brier(spark, sf):
    """Brier score of P(quality <= threshold)."""
    e = predictions(spark, sf).select("observed", "q", F.explode(F.lit([0.25, 0.5, 0.75, 0.9])).alias("threshold"))
    hit = (F.col("observed") <= F.col("threshold")).cast("int")
    d = hit - Q.unit_cdf(F.col("q"), F.col("threshold"))
    return e.groupBy("threshold").agg(r6(F.avg(d * d)).alias("brier"))


_BM = ["prevalence", "mean_probability", "brier", "log_loss", "ece", "max_gap"]


@query("binary_metrics", with_(BINARY) + f"""SELECT lang, sum(n)::BIGINT AS rows, {R('sum(ys)/sum(n)')} AS prevalence, {R('sum(ps)/sum(n)')} AS mean_probability, {R('sum(sq)/sum(n)')} AS brier, {R('sum(ll)/sum(n)')} AS log_loss, {R('sum(abs(ys-ps))/sum(n)')} AS ece, {R('max(abs(ys-ps)/n)')} AS max_gap FROM (
 SELECT lang, least(floor(probability*10),9) AS b, count(*) AS n, sum(observed::INT) AS ys, sum(probability) AS ps, sum(power(observed::INT-probability,2)) AS sq, sum(-(observed::INT*ln(greatest(1e-12,least(1-1e-12,probability)))+(1-observed::INT)*ln(1-greatest(1e-12,least(1-1e-12,probability))))) AS ll FROM bin GROUP BY 1,2) GROUP BY 1""")
def binary_metrics(spark, sf):
    b = P.binary_scores(binary(spark, sf), ["lang"], F.col("observed"), "probability")
    return b.select("lang", "rows", *[r6(F.col(c)).alias(c) for c in _BM])


@query("ranking_metrics", with_(BINARY) + f"""SELECT lang, {R('auc')} AS roc_auc, {R('ap')} AS average_precision FROM (SELECT a.lang, sum(CASE WHEN a.probability > b.probability THEN 1.0 WHEN a.probability = b.probability THEN 0.5 ELSE 0 END)/count(*) AS auc FROM bin a JOIN bin b ON a.lang=b.lang AND a.observed AND NOT b.observed GROUP BY 1)
 JOIN (SELECT lang, sum(y*pr)/sum(y) AS ap FROM (SELECT lang, observed::INT AS y, sum(observed::INT) OVER w / count(*) OVER w AS pr FROM bin WINDOW w AS (PARTITION BY lang ORDER BY probability DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY 1) USING (lang)""")
def ranking_metrics(spark, sf):
    """ROC AUC and average precision from value counts."""
    a = P.ranking_scores(binary(spark, sf), ["lang"], F.col("observed"), "probability")
    return a.filter("roc_auc IS NOT NULL").select("lang", r6(F.col("roc_auc")).alias("roc_auc"), r6(F.col("average_precision")).alias("average_precision"))


@query("reliability_table", with_(BINARY) + f"""SELECT b.bin, coalesce(g.rows,0)::BIGINT AS rows, {R('b.bin/10')} AS lower_bound, {R('(b.bin+1)/10')} AS upper_bound, {R('g.mp')} AS mean_probability, {R('g.er')} AS empirical_rate, {R('abs(g.mp-g.er)')} AS gap FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN (
 SELECT least(floor(probability*10),9)::BIGINT AS bin, count(*) AS rows, avg(probability) AS mp, avg(observed::INT) AS er FROM bin GROUP BY 1) g USING (bin)""")
def reliability_table(spark, sf):
    t = P.reliability(binary(spark, sf), F.col("observed"), "probability")
    return t.select("bin", "rows", *[r6(F.col(c)).alias(c) for c in ("lower_bound", "upper_bound", "mean_probability", "empirical_rate", "gap")])


_TYPES = ["invalid", "numeric", "timeout"]
_TP = FRUNS + f""",
tp AS (SELECT f.fold, {', '.join(f"(count_if(failure_type='{t}')+0.5::DOUBLE)/(count(failure_type)+1.5::DOUBLE) AS p_{t}" for t in _TYPES)} FROM fruns a, (SELECT unnest(range({FOLDS})) AS fold) f WHERE a.fold<>f.fold GROUP BY 1),
tr AS (SELECT r.fold, failure_type, [{', '.join('p_' + t for t in _TYPES)}] AS p, list_position({_TYPES}, failure_type) AS k FROM fruns r JOIN tp USING (fold) WHERE failure)"""


@query("failure_type_metrics", with_(_TP) + f"""SELECT fold, count(*)::BIGINT AS rows, {R('avg(-ln(greatest(1e-12,p[k])))')} AS log_loss, {R('avg(list_sum(list_transform(range(1,4), lambda i: power((i=k)::INT-p[i],2))))')} AS brier, {R('avg((list_position(p, list_max(p))=k)::INT)')} AS top1,
 {R('(' + '+'.join(f"coalesce(2.0*count_if(k={i} AND list_position(p, list_max(p))={i})/nullif(count_if(k={i})+count_if(list_position(p, list_max(p))={i}),0),0)" for i in (1, 2, 3)) + ')/3')} AS macro_f1 FROM tr GROUP BY 1""")
def failure_type_metrics(spark, sf):
    """Multiclass scores of smoothed out-of-fold type shares on failed runs."""
    from trialgrid.operators.folds import out_of_fold_sums
    r = folded_runs(spark, sf)
    s = out_of_fold_sums(r, [], "fold", {**{t: (F.coalesce(F.col("failure_type") == t, F.lit(False))).cast("int") for t in _TYPES}, "n": F.col("failure_type").isNotNull().cast("int")})
    s = s.select("fold", F.array(*[(F.col(t) + 0.5) / (F.col("n") + 1.5) for t in _TYPES]).alias("p"))
    k = F.array_position(F.lit(_TYPES), F.col("failure_type")).cast("int")
    d = r.filter("failure").join(F.broadcast(s), "fold").withColumn("k", k).withColumn("top", F.array_position("p", F.array_max("p")).cast("int"))
    f1 = sum(F.coalesce(2.0 * F.count_if((F.col("k") == i) & (F.col("top") == i)) / F.nullif(F.count_if(F.col("k") == i) + F.count_if(F.col("top") == i), F.lit(0)), F.lit(0.0)) for i in (1, 2, 3)) / 3
    sq = F.transform(F.lit([1, 2, 3]), lambda i: F.pow((i == F.col("k")).cast("int") - F.get("p", i - 1), F.lit(2.0)))
    return d.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), r6(F.avg(-F.ln(F.greatest(F.lit(1e-12), F.get("p", F.col("k") - 1))))).alias("log_loss"),
                                 r6(F.avg(X.array_sum(sq))).alias("brier"), r6(F.avg((F.col("top") == F.col("k")).cast("int"))).alias("top1"), r6(f1).alias("macro_f1"))


# ------------------------------------------------------------------ survival

_H = "[0.01::DOUBLE,0.02,0.05,0.1,0.2,0.5,1.0]"
SURV = FRUNS + f""",
lab AS MATERIALIZED (SELECT *, target_reached AND passage IS NOT NULL AS event, CASE WHEN target_reached THEN passage ELSE budget END AS duration FROM fruns),
hz AS MATERIALIZED (SELECT *, event AND duration <= hs AS outcome, (event AND duration <= hs) OR duration >= hs AS observable FROM (SELECT *, least(budget, greatest(1, ceil(budget*horizon))) AS hs FROM (SELECT *, unnest({_H}) AS horizon, unnest(range(1,8)) AS h FROM lab))),
pr AS (SELECT a.problem_family, f.fold, h, (count_if(outcome)+0.5::DOUBLE)/(count(*)+1.0::DOUBLE) AS p FROM hz a, (SELECT unnest(range({FOLDS})) AS fold) f WHERE a.fold<>f.fold AND observable GROUP BY 1,2,3),
reach AS MATERIALIZED (SELECT problem_family, fold, list(m ORDER BY h) AS reach FROM (SELECT *, max(p) OVER (PARTITION BY problem_family, fold ORDER BY h) AS m FROM pr) GROUP BY 1,2),
srow AS MATERIALIZED (SELECT *, list_transform({_H}, lambda v: least(budget, greatest(1, ceil(budget*v)))) AS st, list_transform(range(1,8), lambda i: reach[i]-CASE WHEN i=1 THEN 0 ELSE reach[i-1] END) AS inc FROM lab JOIN reach USING (problem_family, fold)),
sv AS MATERIALIZED (SELECT *, -ln(greatest(1e-12,least(1.0,CASE WHEN event THEN inc[list_min(list_filter(range(1,8), lambda i: st[i]>=duration))] ELSE 1-reach[list_max(list_filter(range(1,8), lambda i: st[i]<=duration))] END))) AS nll,
 list_sum(list_transform(range(1,8), lambda i: CASE WHEN i=1 THEN 1.0 ELSE 1-reach[i-1] END*(st[i]-CASE WHEN i=1 THEN 0 ELSE st[i-1] END))) AS rm, list_sum(list_transform(range(1,8), lambda i: inc[i]*st[i]))+(1-reach[7])*10*budget AS epar, CASE WHEN event THEN duration ELSE 10*budget END AS opar FROM srow)"""


def survival_table(spark, sf):
    lab = P.survival_labels(folded_runs(spark, sf))
    reach = P.out_of_fold_reach(lab, ["problem_family"], "fold")
    return P.survival_rows(lab.join(F.broadcast(reach), ["problem_family", "fold"]))


@query("survival_labels", with_(SURV) + f"SELECT run_id, event, duration, {R('duration/budget')} AS duration_fraction FROM lab")
def survival_labels(spark, sf):
    return P.survival_labels(folded_runs(spark, sf)).select("run_id", "event", "duration", r6(F.col("duration_fraction")).alias("duration_fraction"))


@query("reach_probabilities", with_(SURV) + "SELECT problem_family, fold, list_transform(reach, lambda v: floor(v*1e6+0.501)/1e6) AS reach FROM reach")
def reach_probabilities(spark, sf):
    """Out-of-fold monotone reach probability at each horizon."""
    lab = P.survival_labels(folded_runs(spark, sf))
    return P.out_of_fold_reach(lab, ["problem_family"], "fold").select("problem_family", "fold", F.transform("reach", X.r6).alias("reach"))


@query("survival_metrics", with_(SURV) + f"""SELECT algorithm, count_if(event)::BIGINT AS events, {R('avg(nll)')} AS survival_nll, {R('avg(rm)')} AS restricted_mean, {R('avg(epar)')} AS predicted_par10, {R('avg(opar)')} AS observed_par10, {R('avg(abs(opar-epar))')} AS par10_mae FROM sv GROUP BY 1""")
def survival_metrics(spark, sf):
    s = survival_table(spark, sf)
    return s.groupBy("algorithm").agg(
        F.count_if("event").alias("events"), r6(F.avg("survival_nll")).alias("survival_nll"), r6(F.avg("restricted_mean")).alias("restricted_mean"),
        r6(F.avg("expected_par10")).alias("predicted_par10"), r6(F.avg("observed_par10")).alias("observed_par10"),
        r6(F.avg(F.abs(F.col("observed_par10") - F.col("expected_par10")))).alias("par10_mae"))


@query("survival_horizons", with_(SURV) + f"""SELECT z.horizon, count(*)::BIGINT AS observable, {R('avg(power(z.outcome::INT-r.reach[z.h],2))')} AS brier, {R('avg(z.outcome::INT)')} AS empirical, {R('avg(r.reach[z.h])')} AS predicted FROM hz z JOIN reach r USING (problem_family, fold) WHERE observable GROUP BY 1""")
def survival_horizons(spark, sf):
    """Brier and calibration at each horizon over the rows observable there."""
    h = P.at_horizons(survival_table(spark, sf)).filter("observable")
    p = F.get("reach", F.col("h"))
    y = F.col("outcome").cast("int")
    return h.groupBy("horizon").agg(F.count(F.lit(1)).alias("observable"), r6(F.avg((y - p) * (y - p))).alias("brier"),
                                    r6(F.avg(y)).alias("empirical"), r6(F.avg(p)).alias("predicted"))


@query("concordance", with_(SURV) + f"""SELECT algorithm, {R('sum(CASE WHEN a.risk > b.risk THEN 0.0 WHEN a.risk = b.risk THEN 0.5*a.n*b.m ELSE a.n*b.m END)/sum(a.n*b.m)')} AS c_index, sum(a.n*b.m)::BIGINT AS comparable_pairs FROM (SELECT algorithm, duration, round(rm,9) AS risk, count(*) AS n FROM sv WHERE event GROUP BY ALL) a
 JOIN (SELECT algorithm, duration, round(rm,9) AS risk, count(*) AS m FROM sv GROUP BY ALL) b USING (algorithm) WHERE b.duration > a.duration GROUP BY 1""")
def concordance(spark, sf):
    """Concordance of risk (minus the restricted mean) with duration."""
    s = survival_table(spark, sf).withColumn("risk", -F.round("restricted_mean", 9))
    # higher risk should come first: the event's risk must exceed the later row's
    c = P.concordance(s, ["algorithm"], "duration", "event", "risk")
    return c.select("algorithm", r6(F.col("c_index")).alias("c_index"), "comparable_pairs")


# ------------------------------------------------------------------ pooling

_LEVELS = [["domain"], ["domain", "algorithm"], ["domain", "problem_family"], ["domain", "problem_family", "algorithm"]]


def _pool_sql():
    base = FRUNS + f""",
trn AS MATERIALIZED (SELECT f.fold AS ef, a.domain, a.algorithm, a.problem_family, a.quality - 0.25::DOUBLE AS r0 FROM fruns a, (SELECT unnest(range({FOLDS})) AS fold) f WHERE a.fold<>f.fold),
leaves AS (SELECT DISTINCT fold AS ef, domain, algorithm, problem_family FROM fruns)"""
    prev = "trn"
    sel = "0.0::DOUBLE"
    var = "0.0::DOUBLE"
    joins = ""
    for i, lv in enumerate(_LEVELS, 1):
        k = ", ".join(lv)
        base += f""",
g{i} AS MATERIALIZED (SELECT ef, {k}, count(*) AS n, avg(r{i - 1}) AS m FROM {prev} GROUP BY ALL),
v{i} AS MATERIALIZED (SELECT ef, rv, greatest(coalesce(mv,0) - rv*inv, 0) AS pv FROM (SELECT ef, greatest(var_samp(r{i - 1}),1e-10) AS rv FROM {prev} GROUP BY 1) JOIN (SELECT ef, var_samp(m) AS mv, avg(1.0/n) AS inv FROM g{i} GROUP BY 1) USING (ef)),
e{i} AS MATERIALIZED (SELECT ef, {k}, CASE WHEN pv>0 THEN n*pv/(n*pv+rv)*m ELSE 0 END AS eff, CASE WHEN pv>0 THEN 1/(1/pv+n/rv) ELSE 0 END AS post FROM g{i} JOIN v{i} USING (ef)),
t{i} AS MATERIALIZED (SELECT p.*, r{i - 1}-eff AS r{i} FROM {prev} p JOIN e{i} USING (ef, {k}))"""
        prev = f"t{i}"
        joins += f" LEFT JOIN e{i} USING (ef, {k}) LEFT JOIN v{i} USING (ef)"
        sel += f" + coalesce(e{i}.eff, 0)"
        var += f" + coalesce(e{i}.post, v{i}.pv)"
    return with_(base, "fin AS (SELECT ef, greatest(avg(r4*r4),1e-10) AS fv FROM t4 GROUP BY 1)") + f"""SELECT ef AS fold, domain, problem_family, algorithm, {R('(' + sel + ')')} AS effect, {R('sqrt(fv + ' + var + ')')} AS std FROM leaves{joins} JOIN fin USING (ef)"""


@query("normal_pooling", _pool_sql())
def normal_pooling(spark, sf):
    """Four-level sequential shrinkage of quality residuals, evaluated out of fold."""
    r = folded_runs(spark, sf).withColumn("resid", F.col("quality") - 0.25)
    out, _ = P.normal_pooling(r, "fold", "resid", _LEVELS)
    seen = r.select("fold", "domain", "problem_family", "algorithm").distinct()
    return out.join(seen, ["fold", "domain", "problem_family", "algorithm"], "left_semi").select(
        "fold", "domain", "problem_family", "algorithm", r6(F.col("effect")).alias("effect"), r6(F.col("std")).alias("std"))


def _bp(prior, n, y):
    p = f"greatest(1e-9,least(1-1e-9,{prior}))"
    return f"{p}*20+{y} AS a, (1-{p})*20+{n}-{y} AS b"


_BETA = FRUNS + f""",
bt AS MATERIALIZED (SELECT f.fold AS ef, domain, algorithm, problem_family, count(*) AS n, count_if(failure) AS y FROM fruns a, (SELECT unnest(range({FOLDS})) AS fold) f WHERE a.fold<>f.fold GROUP BY ALL),
bg AS (SELECT ef, 0.5::DOUBLE+sum(y) AS a, 0.5::DOUBLE+sum(n)-sum(y) AS b FROM bt GROUP BY 1),
bd AS (SELECT ef, domain, {_bp('any_value(bg.a/(bg.a+bg.b))', 'sum(n)', 'sum(y)')} FROM bt JOIN bg USING (ef) GROUP BY 1,2),
ba AS (SELECT ef, domain, algorithm, {_bp('any_value(bd.a/(bd.a+bd.b))', 'sum(n)', 'sum(y)')} FROM bt JOIN bd USING (ef, domain) GROUP BY 1,2,3),
bf AS (SELECT ef, domain, problem_family, {_bp('any_value(bd.a/(bd.a+bd.b))', 'sum(n)', 'sum(y)')} FROM bt JOIN bd USING (ef, domain) GROUP BY 1,2,3),
bl AS (SELECT ef, domain, problem_family, algorithm, {_bp('0.5*(bf.a/(bf.a+bf.b)+ba.a/(ba.a+ba.b))', 'n', 'y')} FROM bt JOIN ba USING (ef, domain, algorithm) JOIN bf USING (ef, domain, problem_family)),
bw AS (SELECT DISTINCT fold AS ef, domain, problem_family, algorithm FROM fruns)"""


@query("beta_pooling", with_(_BETA) + f"""SELECT ef AS fold, domain, problem_family, algorithm, {R('a/(a+b)')} AS probability, {R('a')} AS alpha, {R('b')} AS beta, level FROM (SELECT ef, domain, problem_family, algorithm, coalesce(bl.a,bf.a,ba.a,bd.a,bg.a) AS a, coalesce(bl.b,bf.b,ba.b,bd.b,bg.b) AS b,
 CASE WHEN bl.a IS NOT NULL THEN 'leaf' WHEN bf.a IS NOT NULL THEN 'domain_family' WHEN ba.a IS NOT NULL THEN 'domain_algorithm' WHEN bd.a IS NOT NULL THEN 'domain' ELSE 'global' END AS level FROM bw JOIN bg USING (ef) LEFT JOIN bd USING (ef, domain) LEFT JOIN ba USING (ef, domain, algorithm) LEFT JOIN bf USING (ef, domain, problem_family) LEFT JOIN bl USING (ef, domain, problem_family, algorithm))""")
def beta_pooling(spark, sf):
    """Beta-binomial failure rates with two-parent leaves."""
    b = P.beta_pooling(folded_runs(spark, sf), "fold", F.col("failure"))
    return b.select("fold", "domain", "problem_family", "algorithm", *[r6(F.col(c)).alias(c) for c in ("probability", "alpha", "beta")], "level")


@query("beta_intervals")
def beta_intervals(spark, sf):
    """90% posterior interval, widened to contain the mean."""
    from trialgrid.functions.kernels import beta_quantile_col
    b = P.beta_pooling(folded_runs(spark, sf), "fold", F.col("failure"))
    lo = beta_quantile_col(F.lit(0.05), F.col("alpha"), F.col("beta"))
    hi = beta_quantile_col(F.lit(0.95), F.col("alpha"), F.col("beta"))
    b = b.withColumn("lo", lo).withColumn("hi", hi)
    return b.select("fold", "domain", "problem_family", "algorithm", "probability",
                    F.least("lo", "probability").alias("lower"), F.greatest("hi", "probability").alias("upper"))


# ------------------------------------------------------------------ recalibration and mixtures

RECAL = DIST + f""",
lv0 AS (SELECT f.fold, count(*) AS n, quantile_cont(pit, {LEVELS}) AS e FROM dist d, (SELECT unnest(range({FOLDS})) AS fold) f WHERE d.fold<>f.fold GROUP BY 1),
lv AS MATERIALIZED (SELECT fold, n, list_transform(range(1,8), lambda i: list_max(list_transform(range(1,i+1), lambda j: (n*e[j]+200*({LEVELS})[j])/(n+200)))) AS levels FROM lv0)"""


@query("recalibration_levels", with_(RECAL) + "SELECT fold, n, list_transform(levels, lambda v: floor(v*1e6+0.501)/1e6) AS levels FROM lv")
def recalibration_levels(spark, sf):
    """Shrunk PIT quantiles of the other folds."""
    l = P.recalibration_levels(quality_rows(spark, sf), "fold", FOLDS)
    return l.select("fold", "n", F.transform("levels", X.r6).alias("levels"))


@query("recalibrated_quantiles", with_(RECAL) + f"""SELECT run_id, list_transform(levels, lambda l: floor((s[greatest(1,least(8,len(list_filter(p, lambda v: v<=l))))] + (l-p[greatest(1,least(8,len(list_filter(p, lambda v: v<=l))))])/(p[greatest(1,least(8,len(list_filter(p, lambda v: v<=l))))+1]-p[greatest(1,least(8,len(list_filter(p, lambda v: v<=l))))])
 *(s[greatest(1,least(8,len(list_filter(p, lambda v: v<=l))))+1]-s[greatest(1,least(8,len(list_filter(p, lambda v: v<=l))))]))*1e6+0.501)/1e6) AS q FROM (SELECT run_id, levels, list_concat([0.0::DOUBLE], q, [1.0::DOUBLE]) AS s, {[0.0, *_L, 1.0]}::DOUBLE[] AS p FROM dist JOIN lv USING (fold))""")
def recalibrated_quantiles(spark, sf):
    """Quantile curve re-read at the adjusted levels."""
    d = quality_rows(spark, sf)
    l = P.recalibration_levels(d, "fold", FOLDS)
    j = d.join(F.broadcast(l), "fold")
    s = Q.unit_support(F.col("q"))
    return j.select("run_id", F.transform("levels", lambda lv: X.r6(Q.quantile_at(s, Q.UNIT_PROBS, lv))).alias("q"))


MIXP = PREDS + f""",
gp AS (SELECT a.algorithm, f.fold, quantile_cont(a.quality, {LEVELS}) AS q2 FROM fruns a, (SELECT unnest(range({FOLDS})) AS fold) f WHERE a.fold <> f.fold GROUP BY 1,2),
mx AS MATERIALIZED (SELECT run_id, domain, fold, observed, q AS qa, q2 AS qb, list_transform(range(1,8), lambda i: 0.5*q[i]+0.5*q2[i]) AS qm FROM preds JOIN gp USING (algorithm, fold))"""


def _crps_sql(q):
    return (f"2*list_sum(list_transform(range(1,9), lambda i: (greatest(({[0.0, *_L, 1.0]}::DOUBLE[])[i]*(observed-list_concat([0.0::DOUBLE],{q},[1.0::DOUBLE])[i]),(({[0.0, *_L, 1.0]}::DOUBLE[])[i]-1)*(observed-list_concat([0.0::DOUBLE],{q},[1.0::DOUBLE])[i]))"
            f"+greatest(({[0.0, *_L, 1.0]}::DOUBLE[])[i+1]*(observed-list_concat([0.0::DOUBLE],{q},[1.0::DOUBLE])[i+1]),(({[0.0, *_L, 1.0]}::DOUBLE[])[i+1]-1)*(observed-list_concat([0.0::DOUBLE],{q},[1.0::DOUBLE])[i+1])))/2*(({[0.0, *_L, 1.0]}::DOUBLE[])[i+1]-({[0.0, *_L, 1.0]}::DOUBLE[])[i])))")


def mixture_rows(spark, sf):
    """Two out-of-fold sources (by family, by algorithm) with their losses."""
    p = predictions(spark, sf)
    g = out_of_fold_quantiles(folded_runs(spark, sf), ["algorithm"], "fold", FOLDS, "quality", LEVELS, "qb")
    return mixture_losses_of(p.join(F.broadcast(g), ["algorithm", "fold"]).withColumnRenamed("q", "qa"))


def mixture_losses_of(p):
    """Losses of quantiles qa and qb and of their even mixture, for rows with an observed value."""
    p = p.withColumn("qm", Q.mix(F.lit(0.5), F.col("qa"), F.col("qb")))
    return p.withColumns({f"loss_{s}": Q.unit_crps(F.col(f"q{s}"), F.col("observed")) for s in "abm"})


@query("mixture_losses", with_(MIXP) + f"""SELECT domain, {R('avg(la)')} AS base_loss, {R('avg(lb)')} AS other_loss, {R('avg(lm)')} AS uniform_loss, {R('avg(least(la,lb))')} AS oracle_loss, {R('avg((lb<la)::INT)')} AS other_win_rate FROM (SELECT domain, {_crps_sql('qa')} AS la, {_crps_sql('qb')} AS lb, {_crps_sql('qm')} AS lm FROM mx) GROUP BY 1""")
def mixture_losses(spark, sf):
    """Row losses of two sources, their even mixture and the oracle choice."""
    m = mixture_rows(spark, sf)
    return m.groupBy("domain").agg(r6(F.avg("loss_a")).alias("base_loss"), r6(F.avg("loss_b")).alias("other_loss"), r6(F.avg("loss_m")).alias("uniform_loss"),
                                   r6(F.avg(F.least("loss_a", "loss_b"))).alias("oracle_loss"), r6(F.avg((F.col("loss_b") < F.col("loss_a")).cast("int"))).alias("other_win_rate"))

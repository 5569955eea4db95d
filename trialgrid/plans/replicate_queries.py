"""Resampling with 10,000 replicates: two-sample and cluster bootstraps, paired sign flips."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialgrid.functions.exprs import r6
from trialgrid.operators import replicates as RP
from trialgrid.plans.registry import query
from trialgrid.plans.views import BINARY, RUNS, R, binary, runs, with_

N = 10_000
_Q = "quantile_cont({}, [0.025, 0.975])"


@query("two_sample_bootstrap", with_(BINARY, "o AS (SELECT lang, observed AS left_side, probability AS v, concat_ws(':', CASE WHEN observed THEN 'true' ELSE 'false' END, id) AS unit FROM bin)",
       RP.replicate_sql("s", "o", ["lang", "left_side"], ["v"], N, "poisson", "two"),
       f"q AS (SELECT lang, {_Q.format('d')} AS q FROM (SELECT lang, i, max(v/nullif(w,0)) FILTER (left_side) - max(v/nullif(w,0)) FILTER (NOT left_side) AS d FROM s GROUP BY 1,2) GROUP BY 1)")
       + f"SELECT lang, count_if(left_side)::BIGINT AS n_left, count_if(NOT left_side)::BIGINT AS n_right, {R('avg(v) FILTER (left_side) - avg(v) FILTER (NOT left_side)')} AS difference, "
         f"{R('any_value(q)[1]')} AS low, {R('any_value(q)[2]')} AS high FROM o JOIN q USING (lang) GROUP BY lang")
def two_sample_bootstrap(spark, sf):
    """Difference of mean scores of good and bad texts per language, with its 95 % interval."""
    d = RP.difference_intervals(binary(spark, sf), ["lang"], "probability", F.col("observed"), "id", N)
    return d.select("lang", "n_left", "n_right", *[r6(F.col(c)).alias(c) for c in ("difference", "low", "high")])


@query("cluster_mean_bootstrap", with_(BINARY, "o AS (SELECT lang, probability AS v, source AS unit FROM bin)", RP.replicate_sql("s", "o", ["lang"], ["v"], N, "poisson", "mean"))
       + f"SELECT lang, {R(_Q.format('v/nullif(w,0)') + '[1]')} AS low, {R(_Q.format('v/nullif(w,0)') + '[2]')} AS high FROM s GROUP BY lang")
def cluster_mean_bootstrap(spark, sf):
    """Interval of the mean score per language when whole sources are drawn."""
    q = RP.mean_intervals(binary(spark, sf), ["lang"], ["probability"], "source", N)
    return q.select("lang", r6(F.col("probability_low")).alias("low"), r6(F.col("probability_high")).alias("high"))


@query("paired_sign_flip", with_(RUNS, """o AS (SELECT domain, problem_id AS unit, round_even((avg(quality) FILTER (algorithm='challenger') - avg(quality) FILTER (algorithm='baseline'))*1e9,0) AS quality,
 round_even((avg(runtime) FILTER (algorithm='challenger') - avg(runtime) FILTER (algorithm='baseline'))*1e9,0) AS runtime FROM runs GROUP BY 1,2)""",
       "p AS (SELECT * FROM o WHERE quality IS NOT NULL)", RP.replicate_sql("s", "p", ["domain"], ["quality", "runtime"], N, "sign", "flip"),
       "t AS (SELECT domain, count(*) AS n, sum(quality) AS q, sum(runtime) AS r FROM p GROUP BY 1)")
       + f"""SELECT domain, any_value(n)::BIGINT AS problems, {R('any_value(q)/any_value(n)/1e9')} AS quality_gain, {R('any_value(r)/any_value(n)/1e9')} AS runtime_gain,
 {R(f'(count_if(quality >= q)+1.0::DOUBLE)/{N + 1}')} AS quality_p, {R(f'(count_if(runtime <= r)+1.0::DOUBLE)/{N + 1}')} AS runtime_p FROM s JOIN t USING (domain) GROUP BY domain""")
def paired_sign_flip(spark, sf):
    """Problem-level differences of the two algorithms: is quality higher, is runtime lower? (differences in steps of 1e-9, so sums are exact)"""
    side = lambda c, a: F.avg(F.when(F.col("algorithm") == a, F.col(c)))
    d = runs(spark, sf).groupBy("domain", "problem_id").agg(
        *[F.rint((side(c, "challenger") - side(c, "baseline")) * 1e9).alias(c) for c in ("quality", "runtime")]).where("quality IS NOT NULL")
    p = RP.sign_flip_tests(d, ["domain"], {"quality": True, "runtime": False}, "problem_id", N)
    seen = d.groupBy("domain").agg(F.count(F.lit(1)).alias("problems"), *[(F.sum(c) / F.count(F.lit(1)) / 1e9).alias(f"{c}_gain") for c in ("quality", "runtime")])
    return seen.join(p, "domain").select("domain", "problems", *[r6(F.col(c)).alias(c) for c in ("quality_gain", "runtime_gain", "quality_p", "runtime_p")])

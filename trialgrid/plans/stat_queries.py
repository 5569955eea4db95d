"""Resampling and test queries."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialgrid.functions import exprs as X
from trialgrid.functions.exprs import r6
from trialgrid.operators import dynamics as D
from trialgrid.operators import replicates as RP
from trialgrid.operators import resample as RS
from trialgrid.operators import runs as RU
from trialgrid.operators.ordered import fits_a_task, framed, median, position, quantiles, running, selected_quantiles
from trialgrid.plans.predict_queries import DIST, quality_rows
from trialgrid.plans.registry import query
from trialgrid.plans.run_queries import PAIRED
from trialgrid.plans.views import DRAWS, KEY_SPACE, LANDSCAPE, ODRAWS, RUNS, SERIES, R, U, draws, landscape, ordered_draws, runs, series, table, with_

def _left():
    return F.col("algorithm") == "challenger"


@query("cliffs_delta", with_(RUNS, "cp AS (SELECT problem_family, quality, count_if(algorithm='challenger')::DOUBLE AS l, count_if(algorithm<>'challenger')::DOUBLE AS r FROM runs GROUP BY 1,2)")
       + f"SELECT a.problem_family, sum(DISTINCT t.l)::BIGINT AS n_left, sum(DISTINCT t.r)::BIGINT AS n_right, {R('sum(a.l*b.r*sign(a.quality-b.quality))/(any_value(t.l)*any_value(t.r))')} AS cliffs_delta FROM cp a JOIN cp b USING (problem_family) JOIN (SELECT problem_family, sum(l) AS l, sum(r) AS r FROM cp GROUP BY 1) t USING (problem_family) GROUP BY 1")
def cliffs_delta(spark, sf):
    """Cliff's delta per family by rank sums."""
    d = RS.cliffs_delta(runs(spark, sf), ["problem_family"], "quality", _left())
    return d.withColumn("cliffs_delta", r6(F.col("cliffs_delta")))


@query("cohens_d", with_(RUNS) + f"""SELECT problem_family, {R('CASE WHEN p > 1e-12 THEN d/p ELSE 0 END')} AS cohens_d FROM (SELECT problem_family, avg(CASE WHEN algorithm='challenger' THEN quality END)-avg(CASE WHEN algorithm<>'challenger' THEN quality END) AS d,
 sqrt(((count_if(algorithm='challenger')-1)*var_samp(CASE WHEN algorithm='challenger' THEN quality END)+(count_if(algorithm<>'challenger')-1)*var_samp(CASE WHEN algorithm<>'challenger' THEN quality END))/(count(*)-2)) AS p FROM runs GROUP BY 1)""")
def cohens_d(spark, sf):
    d = RS.cohens_d(runs(spark, sf), ["problem_family"], "quality", _left())
    return d.withColumn("cohens_d", r6(F.col("cohens_d")))


@query("mann_whitney", with_(RUNS, """mw AS (SELECT problem_family, (algorithm='challenger')::INT AS l, rank() OVER (PARTITION BY problem_family ORDER BY quality)+(count(*) OVER (PARTITION BY problem_family, quality)-1)/2.0 AS rk, count(*) OVER (PARTITION BY problem_family, quality) AS t FROM runs)""",
       "ms AS (SELECT problem_family, sum(l)::DOUBLE AS n1, count(*)-sum(l)::DOUBLE AS n2, sum(l*rk)-sum(l)*(sum(l)+1)/2.0 AS u, sum(t*t-1)::DOUBLE AS ties FROM mw GROUP BY 1)")
       + f"SELECT problem_family, {R('u')} AS u, {R('(greatest(u,n1*n2-u)-n1*n2/2-0.5)/sqrt(n1*n2/12*((n1+n2+1)-ties/((n1+n2)*(n1+n2-1))))')} AS z FROM ms")
def mann_whitney(spark, sf):
    m = RS.mann_whitney(runs(spark, sf), ["problem_family"], "quality", _left())
    return m.select("problem_family", r6(F.col("u")).alias("u"), r6(F.col("z")).alias("z"))


@query("average_ranks", with_(RUNS) + f"""SELECT run_id, {R('least(1-1e-9, greatest(1e-9, (rank() OVER (PARTITION BY problem_family ORDER BY quality)+(count(*) OVER (PARTITION BY problem_family, quality)-1)/2.0-0.5)/count(*) OVER (PARTITION BY problem_family)))')} AS u FROM runs""")
def average_ranks(spark, sf):
    """(average rank - 0.5) / n per family."""
    from trialgrid.operators.ordered import value_ranks
    r = runs(spark, sf).select("run_id", "problem_family", "quality")
    v = value_ranks(r, ["problem_family"], "quality")
    u = (F.col("n_before") + (F.col("n") + 1) / 2.0 - 0.5) / F.col("n_total")
    v = v.select("problem_family", "quality", F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), u)).alias("u"))
    return r.join(v, ["problem_family", "quality"]).select("run_id", r6(F.col("u")).alias("u"))


@query("ks_uniform", with_(DIST) + f"""SELECT algorithm, {R('max(greatest(rk/n-pit, pit-(rk-1)/n))')} AS ks, any_value(n)::BIGINT AS n FROM (SELECT algorithm, pit, row_number() OVER (PARTITION BY algorithm ORDER BY pit)::DOUBLE AS rk, count(*) OVER (PARTITION BY algorithm)::DOUBLE AS n FROM dist) GROUP BY 1""")
def ks_uniform(spark, sf):
    """Distance of the PIT distribution from uniform."""
    d = quality_rows(spark, sf).select("algorithm", F.round("pit", 12).alias("pit"))
    k = RS.ks_uniform(d, ["algorithm"], "pit")
    return k.select("algorithm", r6(F.col("ks")).alias("ks"), "n")


@query("chi_square_types", with_(RUNS) + f"""SELECT {R('sum((o-r*c/t)*(o-r*c/t)/(r*c/t))')} AS statistic, count(*)::BIGINT AS cells FROM (SELECT o, sum(o) OVER (PARTITION BY f) AS r, sum(o) OVER (PARTITION BY a) AS c, sum(o) OVER () AS t FROM (SELECT problem_family AS f, algorithm AS a, count(*)::DOUBLE AS o FROM runs GROUP BY 1,2))""")
def chi_square_types(spark, sf):
    """Chi-square statistic of family x algorithm counts."""
    c = runs(spark, sf).groupBy(F.col("problem_family").alias("f"), F.col("algorithm").alias("a")).agg(F.count(F.lit(1)).cast("double").alias("o"))
    rt, ct, tt = c.groupBy("f").agg(F.sum("o").alias("r")), c.groupBy("a").agg(F.sum("o").alias("c")), c.agg(F.sum("o").alias("t"))
    j = c.join(rt, "f").join(ct, "a").crossJoin(F.broadcast(tt))  # one row
    e = F.col("r") * F.col("c") / F.col("t")
    return j.agg(r6(F.sum((F.col("o") - e) * (F.col("o") - e) / e)).alias("statistic"), F.count(F.lit(1)).alias("cells"))


@query("tail_probabilities")
def tail_probabilities(spark, sf):
    """p values and exact intervals: chi-square tail, normal tail of the rank test, Clopper-Pearson bounds."""
    from trialgrid.functions.kernels import beta_quantile_col, chi_square_tail, normal_cdf_col
    m = RS.mann_whitney(runs(spark, sf), ["problem_family"], "quality", _left())
    f = runs(spark, sf).groupBy("problem_family").agg(F.count_if("failure").cast("double").alias("k"), F.count(F.lit(1)).cast("double").alias("n"))
    j = m.select("problem_family", "z").join(f, "problem_family")
    j = j.withColumns({"neg": -F.col("z"), "stat": (F.col("k") - F.col("n") * 0.1) * (F.col("k") - F.col("n") * 0.1) / (F.col("n") * 0.09), "one": F.lit(1.0),
                       "k1": F.col("k") + 1, "r": F.greatest(F.col("n") - F.col("k"), F.lit(0.5)), "r1": F.col("n") - F.col("k") + 1,
                       "lo_p": F.lit(0.025), "hi_p": F.lit(0.975), "ks": F.greatest("k", F.lit(0.5))})
    return j.select("problem_family", F.least(F.lit(1.0), 2 * normal_cdf_col("neg")).alias("rank_p"), chi_square_tail("stat", "one").alias("rate_p"),
                    beta_quantile_col("lo_p", "ks", "r1").alias("rate_low"), beta_quantile_col("hi_p", "k1", "r").alias("rate_high"))


N_ITER = 60


@query("two_group_comparison", with_(RUNS, """lf AS MATERIALIZED (SELECT domain, feature, run_id, algorithm='challenger' AS l, v FROM (SELECT domain, 'quality' AS feature, run_id, algorithm, quality AS v FROM runs UNION ALL SELECT domain, 'runtime', run_id, algorithm, runtime FROM runs))""",
       "ob AS (SELECT domain, feature, count_if(l) AS nl, count_if(NOT l) AS nr, sum(v) AS tot, sum(CASE WHEN l THEN v END) AS sl, median(CASE WHEN l THEN v END) AS ml, median(CASE WHEN NOT l THEN v END) AS mr FROM lf GROUP BY 1,2)",
       f"pm AS (SELECT domain, feature, i, sum(v) FILTER (WHERE rn <= nl) AS s FROM (SELECT lf.domain, lf.feature, v, nl, i, row_number() OVER (PARTITION BY lf.domain, lf.feature, i ORDER BY {U('i', 'run_id', chr(39) + 'perm' + chr(39))}, run_id) AS rn FROM lf JOIN ob ON ob.domain=lf.domain AND ob.feature=lf.feature, (SELECT unnest(range(20)) AS i)) GROUP BY 1,2,3)",
       "cd AS (SELECT domain, feature, 2*(sum(CASE WHEN l THEN rk END)-any_value(nl)*(any_value(nl)+1)/2.0)/(any_value(nl)*any_value(nr))-1 AS cliff FROM (SELECT lf.*, nl, nr, rank() OVER (PARTITION BY lf.domain, lf.feature ORDER BY v)+(count(*) OVER (PARTITION BY lf.domain, lf.feature, v)-1)/2.0 AS rk FROM lf JOIN ob ON ob.domain=lf.domain AND ob.feature=lf.feature) GROUP BY 1,2)",
       "pv AS (SELECT ob.domain, ob.feature, (count_if(abs(s/nl-(tot-s)/nr) >= abs(sl/nl-(tot-sl)/nr)-1e-9)+1)/21.0 AS p FROM pm JOIN ob ON ob.domain=pm.domain AND ob.feature=pm.feature GROUP BY 1,2)",
       "fd AS (SELECT *, least(1, min(p*m/rn) OVER (ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)) AS q FROM (SELECT *, row_number() OVER (ORDER BY p, domain, feature) AS rn, count(*) OVER () AS m FROM pv))")
       + f"SELECT ob.domain, ob.feature, nl::BIGINT AS n_left, nr::BIGINT AS n_right, {R('sl/nl-(tot-sl)/nr')} AS mean_difference, {R('ml')} AS median_left, {R('mr')} AS median_right, {R('cliff')} AS cliffs_delta, {R('p')} AS p, {R('q')} AS q, abs(cliff)>=0.147 AND q<=0.10 AS replicated FROM ob JOIN cd ON cd.domain=ob.domain AND cd.feature=ob.feature JOIN fd ON fd.domain=ob.domain AND fd.feature=ob.feature")
def two_group_comparison(spark, sf):
    """Per cohort and feature: sizes, means, medians, permutation p, Cliff's delta, q and the replication rule."""
    k = ["domain", "feature"]
    u = RU.unpivot(runs(spark, sf), ["domain", "run_id", "algorithm"], ["quality", "runtime"])
    left = F.col("algorithm") == "challenger"
    v = F.col("value")
    base = u.groupBy(*k).agg(F.count_if(left).alias("n_left"), F.count_if(~left).alias("n_right"),
                             (F.avg(F.when(left, v)) - F.avg(F.when(~left, v))).alias("d"))
    middle = lambda d, name: median(d, k, "value", name) if fits_a_task(d) else selected_quantiles(d, k, "value", [0.5], name).withColumn(name, F.get(name, 0))
    ml, mr = middle(u.filter(left), "ml"), middle(u.filter(~left), "mr")
    p = RS.label_permutation(u, k, "value", left, "run_id", 20)
    c = RS.cliffs_delta(u, k, "value", left).drop("n_left", "n_right")
    q = RS.fdr(p.withColumn("fam", F.lit(0)), ["fam"], "p", k)
    out = base.join(ml, k).join(mr, k).join(c, k).join(q, k)
    return out.select(*k, "n_left", "n_right", r6(F.col("d")).alias("mean_difference"), r6(F.col("ml")).alias("median_left"), r6(F.col("mr")).alias("median_right"),
                      r6(F.col("cliffs_delta")).alias("cliffs_delta"), r6(F.col("p")).alias("p"), r6(F.col("q")).alias("q"),
                      ((F.abs("cliffs_delta") >= 0.147) & (F.col("q") <= 0.10)).alias("replicated"))


@query("false_discovery", with_(SERIES, "fp AS (SELECT key, CASE WHEN r IS NULL THEN 1 ELSE 1-abs(r) END AS p FROM (SELECT key, corr(value, idx) AS r FROM series GROUP BY 1))")
       + f"SELECT key, {R('p')} AS p, {R('least(1, min(p*m/rn) OVER (ORDER BY rn DESC ROWS UNBOUNDED PRECEDING))')} AS q FROM (SELECT *, row_number() OVER (ORDER BY p, key) AS rn, count(*) OVER () AS m FROM fp)")
def false_discovery(spark, sf):
    """Step-up q values over one family of tests per series (family larger than a task: blocked running minimum)."""
    s = series(spark, sf).groupBy("key").agg((1 - F.abs(F.coalesce(F.corr("value", "idx"), F.lit(0.0)))).alias("p"))
    r = position(s.withColumn("fam", F.lit(0)), ["fam"], ["p", "key"], "rn", total="m")
    r = r.withColumn("adj", F.col("p") * F.col("m") / (F.col("rn") + 1)).withColumn("desc", -F.col("rn"))
    r = running(r, ["fam"], ["desc"], {"q": ("min", F.col("adj"))})
    return r.select("key", r6(F.col("p")).alias("p"), r6(F.least(F.lit(1.0), F.col("q"))).alias("q"))


_UNITS = "pu AS MATERIALIZED (SELECT problem_family, 'x'||problem_id||'-'||seed AS unit, round_even(quality_difference*1e9,0) AS d FROM paired)"


def _units(spark, sf):
    """Paired differences in steps of 1e-9, so that sums are exact."""
    unit = F.concat(F.lit("x"), F.col("problem_id").cast("string"), F.lit("-"), F.col("seed").cast("string"))
    return RU.paired(runs(spark, sf)).select("problem_family", unit.alias("unit"), F.rint(F.col("quality_difference") * 1e9).alias("d"))


@query("bootstrap_difference", with_(PAIRED, _UNITS, RP.replicate_sql("bm", "pu", ["problem_family"], ["d"], 2_000, "poisson", "mean"))
       + f"SELECT problem_family, {R('quantile_cont(d/nullif(w,0),0.025)/1e9')} AS ci_low, {R('quantile_cont(d/nullif(w,0),0.975)/1e9')} AS ci_high FROM bm GROUP BY 1")
def bootstrap_difference(spark, sf):
    """Bootstrap interval of the mean paired difference per family (2,000 replicates of all pairs)."""
    c = RP.mean_intervals(_units(spark, sf), ["problem_family"], ["d"], "unit", 2_000)
    return c.select("problem_family", r6(F.col("d_low") / 1e9).alias("ci_low"), r6(F.col("d_high") / 1e9).alias("ci_high"))


@query("sign_flip_test", with_(PAIRED, _UNITS, RP.replicate_sql("sg", "pu", ["problem_family"], ["d"], 10_000, "sign", "flip"))
       + f"SELECT problem_family, {R('(count_if(d >= o)+1.0::DOUBLE)/10001')} AS p FROM sg JOIN (SELECT problem_family, sum(d) AS o FROM pu GROUP BY 1) USING (problem_family) GROUP BY 1")
def sign_flip_test(spark, sf):
    """Is the mean paired difference of a family above zero? 10,000 sign flips."""
    return RP.sign_flip_tests(_units(spark, sf), ["problem_family"], {"d": True}, "unit").select("problem_family", r6(F.col("d_p")).alias("p"))


_HG = [math.comb(6, h) * math.comb(39, 6 - h) / math.comb(45, 6) for h in range(7)]
_CDF = [sum(_HG[:h + 1]) for h in range(7)]


@query("hypergeometric_baseline", with_(DRAWS) + f"""SELECT series_id, hits, {R('power(c, n)-power(pc, n)')} AS p_best, {R('1-power(pc, n)')} AS p_at_least FROM (SELECT series_id, count(*) AS n FROM draws GROUP BY 1), (SELECT unnest(range(7)) AS hits, unnest({_CDF}::DOUBLE[]) AS c, unnest({[0.0, *_CDF[:-1]]}::DOUBLE[]) AS pc)""")
def hypergeometric_baseline(spark, sf):
    """Exact distribution of the best hit count of a budget (the series length)."""
    n = draws(spark, sf).groupBy("series_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    cells = F.array(*[F.struct(F.lit(h).cast("bigint").alias("hits"), F.lit(_CDF[h]).alias("c"), F.lit(_CDF[h - 1] if h else 0.0).alias("pc")) for h in range(7)])
    e = n.select("series_id", "n", F.inline(cells))
    return e.select("series_id", "hits", r6(F.pow("c", "n") - F.pow("pc", "n")).alias("p_best"), r6(1 - F.pow("pc", "n")).alias("p_at_least"))


@query("monte_carlo_rounds", with_(DRAWS, f"mc AS (SELECT i, avg(h) AS mean_best, count_if(h>=4)::DOUBLE AS n4 FROM (SELECT i, len(list_filter({_CDF}::DOUBLE[], lambda c: power(c, 50) <= u)) AS h FROM (SELECT i, {U('i', 'round_no', chr(39) + 'mc' + chr(39))} AS u FROM draws, (SELECT unnest(range(40)) AS i))) GROUP BY 1)")
       + f"SELECT {R('avg(mean_best)')} AS mean_best, {R('quantile_cont(mean_best,0.025)')} AS lo, {R('quantile_cont(mean_best,0.5)')} AS med, {R('quantile_cont(mean_best,0.975)')} AS hi, {R('avg(n4)')} AS mean_rounds_4 FROM mc")
def monte_carlo_rounds(spark, sf):
    """Inverse-CDF draws of the best of 50 per round, summarised over iterations."""
    d = draws(spark, sf).select("round_no", RS.iterations(40))
    u = X.hash_uniform("i", "round_no", F.lit("mc"))
    cdf = F.lit([c**50 for c in _CDF])
    h = X.bisect_right(cdf, 7, u)
    it = d.select("i", h.alias("h")).groupBy("i").agg(F.avg("h").alias("m"), F.count_if(F.col("h") >= 4).cast("double").alias("n4")).withColumn("g", F.lit(0))
    q = quantiles(it, ["g"], "m", [0.025, 0.5, 0.975], "q")
    return it.groupBy("g").agg(F.avg("m").alias("a"), F.avg("n4").alias("b")).join(q, "g").select(
        r6(F.col("a")).alias("mean_best"), r6(F.get("q", 0)).alias("lo"), r6(F.get("q", 1)).alias("med"), r6(F.get("q", 2)).alias("hi"), r6(F.col("b")).alias("mean_rounds_4"))


_PERM = SERIES + f""",
pe AS (SELECT i, key, value, row_number() OVER (PARTITION BY i, key ORDER BY {U('i', 'event_id', "'order'")}, event_id)-1 AS idx FROM series, (SELECT unnest(range(20)) AS i)),
st AS (SELECT i, key, count_if(d1*d0<0) AS t, avg(abs(d1)) AS a FROM (SELECT i, key, value-lag(value) OVER w AS d1, lag(value) OVER w-lag(value,2) OVER w AS d0 FROM (SELECT * FROM pe UNION ALL SELECT -1, key, value, idx FROM series) WINDOW w AS (PARTITION BY i, key ORDER BY idx)) WHERE d0 IS NOT NULL GROUP BY 1,2)"""


@query("order_permutation_battery", with_(_PERM) + f"""SELECT o.key, o.t::BIGINT AS turning_points, {R('(count_if(p.t>=o.t)+1)/21')} AS p_turning, {R('(count_if(p.a<=o.a+1e-9)+1)/21')} AS p_delta FROM st o JOIN st p ON p.key=o.key AND p.i>=0 WHERE o.i=-1 GROUP BY o.key, o.t""")
def order_permutation_battery(spark, sf):
    """Turning points and mean absolute delta against hashed reorderings of each series."""
    s = series(spark, sf).select("key", "event_id", "value", "idx")
    p = s.select("key", "value", "event_id", RS.iterations(20)).withColumn("h", X.hash_uniform("i", "event_id", F.lit("order")))
    p = position(p, ["key", "i"], ["h", "event_id"], "idx")
    both = p.select("key", "i", "idx", "value").unionByName(s.select("key", F.lit(-1).alias("i"), "idx", "value"))

    def build(d, k):
        w = Window.partitionBy(*k).orderBy("idx")
        return d.withColumns({"d1": F.col("value") - F.lag("value").over(w), "d0": F.lag("value").over(w) - F.lag("value", 2).over(w)})

    f = framed(both, ["key", "i"], "idx", 2, 0, build).filter("d0 IS NOT NULL")
    st = f.groupBy("key", "i").agg(F.count_if(F.col("d1") * F.col("d0") < 0).alias("t"), F.avg(F.abs("d1")).alias("a"))
    o = st.filter("i = -1").select("key", F.col("t").alias("ot"), F.col("a").alias("oa"))
    return st.filter("i >= 0").join(o, "key").groupBy("key", F.col("ot").alias("turning_points")).agg(
        r6((F.count_if(F.col("t") >= F.col("ot")) + 1) / 21).alias("p_turning"), r6((F.count_if(F.col("a") <= F.col("oa") + 1e-9) + 1) / 21).alias("p_delta"))


@query("surrogate_overlap", with_(ODRAWS, f"""su AS (SELECT 'round_shuffle' AS kind, i, series_id, mask, row_number() OVER (PARTITION BY i, series_id ORDER BY {U('i', 'round_no', chr(39) + 'round' + chr(39))}, round_no) AS pos FROM odraws, (SELECT unnest(range(10)) AS i)
 UNION ALL SELECT 'block_shuffle', i, series_id, mask, row_number() OVER (PARTITION BY i, series_id ORDER BY {U('i', 'series_id', 'idx//5', chr(39) + 'block' + chr(39))}, idx) FROM odraws, (SELECT unnest(range(10)) AS i)
 UNION ALL SELECT 'cyclic_shift', i, series_id, mask, row_number() OVER (PARTITION BY i, series_id ORDER BY (idx+i+1)%n) FROM odraws, (SELECT unnest(range(10)) AS i))""")
       + f"SELECT kind, {R('avg(h)')} AS mean_overlap, count(*)::BIGINT AS pairs FROM (SELECT kind, bit_count(mask & lag(mask) OVER (PARTITION BY kind, i, series_id ORDER BY pos)) AS h FROM su) WHERE h IS NOT NULL GROUP BY 1")
def surrogate_overlap(spark, sf):
    """Mean overlap of consecutive draws under round, block and cyclic surrogates."""
    d = ordered_draws(spark, sf).select("series_id", "round_no", "mask", "idx", "n", RS.iterations(10))
    kinds = F.array(
        F.struct(F.lit("round_shuffle").alias("kind"), X.hash_uniform("i", "round_no", F.lit("round")).alias("o"), F.col("round_no").alias("t")),
        F.struct(F.lit("block_shuffle").alias("kind"), X.hash_uniform("i", "series_id", F.floor(F.col("idx") / 5), F.lit("block")).alias("o"), F.col("idx").alias("t")),
        F.struct(F.lit("cyclic_shift").alias("kind"), ((F.col("idx") + F.col("i") + 1) % F.col("n")).cast("double").alias("o"), F.lit(0).cast("bigint").alias("t")))
    k = ["kind", "i", "series_id"]
    s = position(d.select("i", "series_id", "mask", F.inline(kinds)), k, ["o", "t"], "pos")
    f = framed(s, k, "pos", 1, 0, lambda x, kk: x.withColumn("p", F.lag("mask").over(Window.partitionBy(*kk).orderBy("pos"))))
    return f.filter("p IS NOT NULL").groupBy("kind").agg(r6(F.avg(X.hits(F.col("mask"), F.col("p")))).alias("mean_overlap"), F.count(F.lit(1)).alias("pairs"))


_NULL = LANDSCAPE + f""",
hg AS (SELECT round, count(*) AS good FROM land GROUP BY 1),
h0 AS (SELECT round, good::DOUBLE AS k, exp(list_sum(list_transform(range(1000), lambda j: ln(1 - good / ({KEY_SPACE} - j))))) AS p FROM hg),
hu AS (SELECT i, round, k, p, {U('i', 'round', "'null'")} AS u FROM h0, (SELECT unnest(range(50)) AS i)),
hx AS (SELECT i, round, k, u, p, p AS c, 0::DOUBLE AS x FROM hu UNION ALL
 SELECT i, round, k, u, q, c + q, x + 1 FROM (SELECT *, p * (k - x) * (1000 - x) / ((x + 1) * ({KEY_SPACE} - k - 1000 + x + 1)) AS q FROM hx WHERE u >= c AND x < 1000)),
ht AS (SELECT i, sum(x) AS total FROM (SELECT i, round, max(x) AS x FROM hx GROUP BY 1, 2) GROUP BY 1)"""


@query("hypergeometric_null", with_(_NULL).replace("WITH", "WITH RECURSIVE", 1) + f"SELECT {R('avg(total)')} AS null_mean, {R('stddev_samp(total)')} AS null_std, {R(f'(SELECT sum(good * 1000 / {KEY_SPACE}) FROM hg)')} AS expected FROM ht")
def hypergeometric_null(spark, sf):
    """Null counts of good keys in a random budget of 1,000 per round: hashed inverse-CDF draws, summed over rounds."""
    import numpy as np
    import pandas as pd

    good = landscape(spark, sf).groupBy("round").agg(F.count(F.lit(1)).alias("good"))
    g = good.select("round", "good", RS.iterations(50)).withColumn("u", X.hash_uniform("i", "round", F.lit("null")))
    budget, space = 1000, KEY_SPACE

    def kernel(batches):
        for pdf in batches:
            k = pdf["good"].to_numpy(dtype=float)
            u = pdf["u"].to_numpy()
            # P(0) by log-gamma free product over the budget, then the ratio recurrence
            p = np.exp(np.log1p(-k[:, None] / (space - np.arange(budget)[None, :])).sum(axis=1))
            c, x, out = p.copy(), 0, np.zeros(len(k))
            while (u >= c).any() and x < budget:
                out += u >= c
                p = p * (k - x) * (budget - x) / ((x + 1) * (space - k - budget + x + 1))
                c, x = c + p, x + 1
            yield pd.DataFrame({"i": pdf["i"], "x": out})

    per = g.mapInPandas(kernel, "i int, x double").groupBy("i").agg(F.sum("x").alias("total"))
    exp = good.agg(r6(F.sum(F.col("good") * budget / space)).alias("expected"))
    return per.agg(r6(F.avg("total")).alias("null_mean"), r6(F.stddev_samp("total")).alias("null_std")).crossJoin(exp)  # one row each


@query("rule_mining", with_(SERIES, "rf AS (SELECT key, avg(value) AS m, stddev_pop(value) AS s, avg((event_type='error')::INT) AS e, avg((event_type='purchase')::INT) >= 0.2 AS y, key%2=0 AS early FROM series GROUP BY 1)",
       "ru AS (SELECT feature, v, y, early FROM (SELECT unnest(['m','s','e']) AS feature, unnest([m,s,e]) AS v, y, early FROM rf))",
       "th AS (SELECT feature, quantile_cont(v,0.6) AS t, CASE WHEN avg(CASE WHEN y THEN v END) >= avg(CASE WHEN NOT y THEN v END) THEN 1 ELSE -1 END AS dir FROM ru WHERE early GROUP BY 1)")
       + f"SELECT feature, dir::BIGINT AS direction, {R('t')} AS threshold, early, count_if(dir*v >= dir*t)::BIGINT AS selected, {R('avg(CASE WHEN dir*v >= dir*t THEN y::INT END)')} AS precision FROM ru JOIN th USING (feature) GROUP BY feature, dir, t, early")
def rule_mining(spark, sf):
    """Thresholds and directions learned on the earlier cohort, applied to both."""
    s = series(spark, sf).groupBy("key").agg(
        F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.avg((F.col("event_type") == "error").cast("int")).alias("e"),
        (F.avg((F.col("event_type") == "purchase").cast("int")) >= 0.2).alias("y")).withColumn("early", F.col("key") % 2 == 0)
    u = RU.unpivot(s, ["y", "early"], ["m", "s", "e"])
    e = u.filter("early")
    t = quantiles(e, ["feature"], "value", [0.6], "q").select("feature", F.get("q", 0).alias("t"))
    d = e.groupBy("feature").agg(F.when(F.avg(F.when(F.col("y"), F.col("value"))) >= F.avg(F.when(~F.col("y"), F.col("value"))), 1).otherwise(-1).alias("dir"))
    j = u.join(F.broadcast(t.join(d, "feature")), "feature")  # one row per feature
    hit = F.col("dir") * F.col("value") >= F.col("dir") * F.col("t")
    return j.groupBy("feature", F.col("dir").cast("bigint").alias("direction"), "t", "early").agg(
        F.count_if(hit).alias("selected"), r6(F.avg(F.when(hit, F.col("y").cast("int")))).alias("precision")).select(
        "feature", "direction", r6(F.col("t")).alias("threshold"), "early", "selected", "precision")


@query("experiment_comparison", with_(SERIES, f"xa AS (SELECT event_type AS cohort, avg(value) AS a FROM series WHERE key%2=0 GROUP BY 1), xb AS (SELECT event_type AS cohort, avg(value) AS b FROM series WHERE key%2=1 GROUP BY 1)")
       + f"SELECT cohort, {R('a')} AS first, {R('b')} AS second, {R('b-a')} AS effect, CASE WHEN b>a THEN 'second' WHEN b<a THEN 'first' ELSE 'tie' END AS better FROM xa JOIN xb USING (cohort)")
def experiment_comparison(spark, sf):
    """Metrics of two experiments aligned by cohort with a decision."""
    s = series(spark, sf)
    # both experiments come from one pass
    g = s.groupBy(F.col("event_type").alias("cohort")).agg(F.avg(F.when(F.col("key") % 2 == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("key") % 2 == 1, F.col("value"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    return g.filter("a IS NOT NULL AND b IS NOT NULL").select("cohort", r6(a).alias("first"), r6(b).alias("second"), r6(b - a).alias("effect"),
                                                              F.when(b > a, "second").when(b < a, "first").otherwise("tie").alias("better"))


@query("table_equality", """SELECT count(*)::BIGINT AS rows, count_if(a.o_orderkey IS NULL OR b.o_orderkey IS NULL)::BIGINT AS unmatched, count_if(abs(a.o_totalprice-b.o_totalprice) > 1e-9)::BIGINT AS different FROM orders a FULL OUTER JOIN (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderpriority='1-URGENT' THEN 1e-3 ELSE 0 END AS o_totalprice FROM orders) b ON a.o_orderkey=b.o_orderkey""")
def table_equality(spark, sf):
    """Key-wise equality of two tables with a float tolerance."""
    a = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"), F.lit(1).alias("l"))
    b = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") + F.when(F.col("o_orderpriority") == "1-URGENT", 1e-3).otherwise(0.0)).alias("y"), F.lit(1).alias("r"))
    j = a.join(b, "o_orderkey", "full_outer")
    return j.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("l").isNull() | F.col("r").isNull()).alias("unmatched"),
                 F.count_if(F.abs(F.col("x") - F.col("y")) > 1e-9).alias("different"))


@query("key_coverage", """SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer))::BIGINT AS common, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders))::BIGINT AS only_customers, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer))::BIGINT AS only_orders""")
def key_coverage(spark, sf):
    """Intersection and both differences of two key sets."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("o", F.lit(1))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).distinct().withColumn("c", F.lit(1))
    j = o.join(c, "k", "full_outer")  # one shuffle instead of three set operations
    return j.agg(F.count_if(F.col("o").isNotNull() & F.col("c").isNotNull()).alias("common"), F.count_if(F.col("o").isNull()).alias("only_customers"),
                 F.count_if(F.col("c").isNull()).alias("only_orders"))

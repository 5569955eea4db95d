"""Series diagnostics over the per-user event series."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialgrid.functions import exprs as X
from trialgrid.functions.exprs import r6
from trialgrid.operators import dynamics as D
from trialgrid.operators.landscape import nearest_earlier
from trialgrid.operators.ordered import framed, running
from trialgrid.plans.registry import query
from trialgrid.plans.views import DRAWS, ODRAWS, SERIES, R, draws, ordered_draws, series, table, with_


def _r(df, *cols):
    return df.withColumns({c: r6(F.col(c)) for c in cols})


_S = "least(ikey//250000, 3)"


@query("mean_change_point", with_(SERIES) + f"""SELECT key, split, {R('score')} AS score FROM (SELECT key, k AS split, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, k) AS rn FROM (
 SELECT key, idx+1 AS k, n, round(abs(s/(idx+1)-(t-s)/(n-idx-1))/sd,9) AS score FROM (SELECT *, sum(value) OVER (PARTITION BY key ORDER BY idx) AS s, sum(value) OVER (PARTITION BY key) AS t, stddev_samp(value) OVER (PARTITION BY key) AS sd FROM series) WHERE idx+1 >= 24 AND idx+1 <= n-24)) WHERE rn=1""")
def mean_change_point(spark, sf):
    return _r(D.mean_change(series(spark, sf), "value"), "score")


@query("variance_change_point", with_(SERIES) + f"""SELECT key, split, {R('score')} AS score FROM (SELECT key, split, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, split) AS rn FROM (
 SELECT key, idx+1 AS split, n, round(abs(ln((var_samp(value) OVER (PARTITION BY key ORDER BY idx)+1e-12)/(var_samp(value) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)+1e-12))),9) AS score FROM series) WHERE split>=24 AND split<=n-24) WHERE rn=1""")
def variance_change_point(spark, sf):
    return _r(D.variance_change(series(spark, sf), "value"), "score")


@query("state_transitions", with_(SERIES, f"tp AS (SELECT key, {_S} AS s, lag({_S}) OVER (PARTITION BY key ORDER BY idx) AS p FROM series)",
       "g AS (SELECT k.key, a.s AS p, b.s AS s, (SELECT count(*) FROM tp t WHERE t.key=k.key AND t.p=a.s) AS r, (SELECT count(*) FROM tp t WHERE t.key=k.key AND t.s=b.s AND t.p IS NOT NULL) AS c, (SELECT count(*) FROM tp t WHERE t.key=k.key AND t.p IS NOT NULL) AS t, (SELECT count(*) FROM tp t WHERE t.key=k.key AND t.p=a.s AND t.s=b.s) AS o FROM (SELECT DISTINCT key FROM series) k, (SELECT unnest(range(4)) AS s) a, (SELECT unnest(range(4)) AS s) b)")
       + f"SELECT key, {R('sum(CASE WHEN r*c>0 THEN (o-r*c/t)*(o-r*c/t)/(r*c/t) END)')} AS chi_square, {R('sum(CASE WHEN p=s THEN o ELSE 0 END)/any_value(t)')} AS persistence FROM g GROUP BY key")
def state_transitions(spark, sf):
    return _r(D.transitions(series(spark, sf), "ikey"), "chi_square", "persistence")


@query("ordinal_entropy", with_(SERIES) + f"""SELECT key, {R('-sum(c/t*ln(c/t))/ln(6)')} AS entropy, count(*)::BIGINT AS patterns FROM (SELECT key, p, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY key) AS t FROM (SELECT key, (b<a)::INT||'-'||(c<a)::INT||'-'||(c<b)::INT AS p FROM (SELECT key, value AS a, lead(value) OVER w AS b, lead(value,2) OVER w AS c FROM series WINDOW w AS (PARTITION BY key ORDER BY idx)) WHERE c IS NOT NULL) GROUP BY 1,2) GROUP BY key""")
def ordinal_entropy(spark, sf):
    return _r(D.ordinal_entropy(series(spark, sf), "value"), "entropy")


@query("turning_points", with_(SERIES) + f"""SELECT key, count_if(d1*d0<0)::BIGINT AS turning_points, {R('avg((sign(d1)<>sign(d0))::INT)')} AS sign_alternation, {R('corr(abs(d0),abs(d1))')} AS volatility_autocorrelation FROM (SELECT key, value-lag(value) OVER w AS d1, lag(value) OVER w - lag(value,2) OVER w AS d0 FROM series WINDOW w AS (PARTITION BY key ORDER BY idx)) WHERE d0 IS NOT NULL GROUP BY key""")
def turning_points(spark, sf):
    return _r(D.turning_statistics(series(spark, sf), "value"), "sign_alternation", "volatility_autocorrelation")


@query("spectral_peak", with_(SERIES, """ft AS (SELECT key, n, k, power(sum(x*cos(2*pi()*((k*idx)%n)/n)),2)+power(sum(x*sin(2*pi()*((k*idx)%n)/n)),2) AS p FROM (SELECT key, idx, n, value-avg(value) OVER (PARTITION BY key) AS x, unnest(range(1, n//2+1)) AS k FROM series) GROUP BY 1,2,3)""")
       + f"SELECT key, {R('share')} AS peak_share, {R('n/k')} AS period, k AS bin FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(share,9) DESC, k) AS rn FROM (SELECT *, p/sum(p) OVER (PARTITION BY key) AS share FROM ft)) WHERE rn=1")
def spectral_peak(spark, sf):
    return _r(D.spectral_peak(series(spark, sf), "value"), "peak_share", "period")


@query("mutual_information", with_(SERIES, f"""ml AS (SELECT a.key, l.lag, {_S.replace('ikey', 'b.ikey')} AS p, {_S.replace('ikey', 'a.ikey')} AS s FROM series a, (SELECT unnest(range(1,13)) AS lag) l, series b WHERE b.key=a.key AND b.idx=a.idx-l.lag)""",
       """mc AS (SELECT *, sum(o) OVER (PARTITION BY key, lag, p) AS a, sum(o) OVER (PARTITION BY key, lag, s) AS b, sum(o) OVER (PARTITION BY key, lag) AS t FROM (SELECT key, lag, p, s, count(*)::DOUBLE AS o FROM ml GROUP BY ALL))""",
       "mg AS (SELECT key, lag, round(CASE WHEN least(sum(-o/t*ln(a/t)), sum(-o/t*ln(b/t))) > 1e-12 THEN sum(o/t*ln(o*t/(a*b)))/least(sum(-o/t*ln(a/t)), sum(-o/t*ln(b/t))) ELSE 0 END, 9) AS score FROM mc GROUP BY 1,2)")
       + f"SELECT key, {R('score')} AS score, lag FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, lag) AS rn FROM mg) WHERE rn=1")
def mutual_information(spark, sf):
    return _r(D.mutual_information(series(spark, sf), "ikey"), "score")


@query("recurrence", with_(SERIES, """rm AS MATERIALIZED (SELECT a.key, a.idx AS i, b.idx AS j FROM series a JOIN series b USING (key) WHERE a.idx<>b.idx AND abs(a.ikey-b.ikey)<=50000)""",
       """dg AS (SELECT key, i, j, (SELECT count(*) FROM rm q WHERE q.key=r.key AND ((q.i=r.i+1 AND q.j=r.j+1) OR (q.i=r.i-1 AND q.j=r.j-1))) > 0 AS d, (SELECT count(*) FROM rm q WHERE q.key=r.key AND q.j=r.j AND (q.i=r.i+1 OR q.i=r.i-1)) > 0 AS v FROM rm r)""")
       + f"SELECT s.key, {R('count(i)/(any_value(n)*(any_value(n)-1))')} AS rate, {R('coalesce(count_if(d)/nullif(count(i),0),0)')} AS determinism, {R('coalesce(count_if(v)/nullif(count(i),0),0)')} AS laminarity FROM (SELECT DISTINCT key, n FROM series) s LEFT JOIN dg ON dg.key=s.key GROUP BY 1")
def recurrence(spark, sf):
    return _r(D.recurrence(series(spark, sf), "ikey", 50_000), "rate", "determinism", "laminarity")


@query("phrase_counts")
def phrase_counts(spark, sf):
    return D.phrase_counts(series(spark, sf), "ikey")


@query("block_profile", with_(SERIES) + f"""SELECT key, idx//16 AS block, min(idx) AS start, max(idx) AS "end", {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS std, {R('arg_max(value,idx)-arg_min(value,idx)')} AS drift, {R('avg(CASE WHEN pi//16=idx//16 THEN abs(value-p) END)')} AS mean_abs_delta FROM (SELECT *, lag(value) OVER w AS p, lag(idx) OVER w AS pi FROM series WINDOW w AS (PARTITION BY key ORDER BY idx)) GROUP BY 1,2""")
def block_profile(spark, sf):
    return _r(D.block_profile(series(spark, sf), "value"), "mean", "std", "drift", "mean_abs_delta")


@query("walk_forward_baselines", with_(SERIES, """wf AS MATERIALIZED (SELECT key, idx, value AS y, lag(value) OVER w AS x1, lag(value,2) OVER w AS x2, lag(value,3) OVER w AS x3 FROM series WINDOW w AS (PARTITION BY key ORDER BY idx))""",
       """kn AS (SELECT key, idx, avg(b_y) AS k FROM (SELECT a.key, a.idx, b.y AS b_y, row_number() OVER (PARTITION BY a.key, a.idx ORDER BY round(sqrt(power(a.x1-b.x1,2)+power(a.x2-b.x2,2)+power(a.x3-b.x3,2)),12), b.idx) AS rn FROM wf a JOIN wf b ON a.key=b.key AND b.idx>=3 AND b.idx<a.idx AND a.idx>=32) WHERE rn<=5 GROUP BY 1,2)""")
       + f"SELECT a.key, {R('avg(abs(y-m))')} AS mean, {R('avg(abs(y-x1))')} AS persistence, {R('avg(abs(y-k))')} AS knn5 FROM (SELECT *, avg(y) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM wf WHERE idx>=3) a JOIN kn ON kn.key=a.key AND kn.idx=a.idx WHERE a.idx>=32 GROUP BY 1")
def walk_forward_baselines(spark, sf):
    """Expanding mean, persistence and nearest-neighbour errors (the ridge column is a separate query)."""
    return _r(D.walk_forward_errors(series(spark, sf), "value").drop("ar3"), "mean", "persistence", "knn5")


@query("walk_forward_ridge")
def walk_forward_ridge(spark, sf):
    return D.walk_forward_errors(series(spark, sf), "value").select("key", "ar3")


@query("autocorrelation", with_(SERIES) + f"""SELECT key, lag, {R('r')} AS r FROM (SELECT a.key, l.lag, corr(a.value, b.value) AS r FROM series a, (SELECT unnest(range(1,21)) AS lag) l, series b WHERE b.key=a.key AND b.idx=a.idx-l.lag GROUP BY 1,2)""")
def autocorrelation(spark, sf):
    return _r(D.autocorrelations(series(spark, sf), "value"), "r")


@query("spearman_trend", with_(SERIES) + f"""SELECT key, {R('corr(rk, idx)')} AS trend FROM (SELECT key, idx, rank() OVER (PARTITION BY key ORDER BY value) + (count(*) OVER (PARTITION BY key, value)-1)/2.0 AS rk FROM series) GROUP BY 1""")
def spearman_trend(spark, sf):
    return _r(D.spearman_trend(series(spark, sf), "value"), "trend")


@query("gap_statistics", with_(SERIES) + f"""SELECT key, count(g)::BIGINT AS gaps, min(g) AS min_gap, max(g) AS max_gap, {R('stddev_samp(g)/avg(g)')} AS gap_cv FROM (SELECT key, lead(ikey) OVER (PARTITION BY key ORDER BY ikey)-ikey AS g FROM (SELECT DISTINCT key, ikey FROM series)) WHERE g IS NOT NULL GROUP BY 1""")
def gap_statistics(spark, sf):
    return _r(D.gap_statistics(series(spark, sf), "ikey"), "gap_cv")


@query("residue_frequencies", with_(SERIES) + f"""SELECT m AS modulus, count(*)::BIGINT AS cells, {R('sum(power(c-t/m,2)/(t/m)) + (m-count(*))*any_value(t)/m')} AS chi_square FROM (SELECT m, ikey % m AS r, count(*)::DOUBLE AS c, (SELECT count(*) FROM series) AS t FROM series, (SELECT unnest([7,13,64,257]) AS m) GROUP BY 1,2) GROUP BY m""")
def residue_frequencies(spark, sf):
    """Residue counts against equal expectation per modulus."""
    s = series(spark, sf).select("ikey", F.explode(F.lit([7, 13, 64, 257])).alias("m"))
    c = s.groupBy("m", (F.col("ikey") % F.col("m")).alias("r")).agg(F.count(F.lit(1)).alias("c"))
    # sum (c - t/m)^2 / (t/m) over all m cells = m/t sum c^2 - t
    return c.groupBy("m").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("c").alias("t"), F.sum(F.col("c") * F.col("c")).alias("cc")).select(
        F.col("m").cast("bigint").alias("modulus"), "cells", r6(F.col("m") / F.col("t") * F.col("cc") - F.col("t")).alias("chi_square"))


@query("digit_bit_frequencies", with_(SERIES) + """SELECT 'digit' AS kind, pos AS position, (ikey // CAST(power(10,pos) AS BIGINT)) % 10 AS symbol, count(*)::BIGINT AS rows FROM series, (SELECT unnest(range(6)) AS pos) GROUP BY ALL
 UNION ALL SELECT 'bit', pos, (ikey >> pos) & 1, count(*) FROM series, (SELECT unnest(range(20)) AS pos) GROUP BY ALL""")
def digit_bit_frequencies(spark, sf):
    s = series(spark, sf).select("ikey")
    k = F.col("ikey")
    digits = F.array(*[F.struct(F.lit("digit").alias("kind"), F.lit(p).cast("bigint").alias("position"), (F.floor(k / 10**p) % 10).alias("symbol")) for p in range(6)])
    bits = F.array(*[F.struct(F.lit("bit").alias("kind"), F.lit(p).cast("bigint").alias("position"), F.call_function("shiftright", k, F.lit(p)).bitwiseAND(F.lit(1).cast("bigint")).alias("symbol")) for p in range(20)])
    return s.select(F.inline(F.concat(digits, bits))).groupBy("kind", "position", "symbol").agg(F.count(F.lit(1)).alias("rows"))


@query("runs_test", with_(SERIES) + f"""SELECT key, runs, {R('mu')} AS expected, {R('(runs-mu)/sqrt(v)')} AS z FROM (SELECT key, runs, 2*a*b/n+1 AS mu, 2*a*b*(2*a*b-n)/(n*n*(n-1)) AS v FROM (SELECT key, count(*)::DOUBLE AS n, sum(up)::DOUBLE AS a, count(*)-sum(up)::DOUBLE AS b, count_if(up<>pu)+1 AS runs FROM (
 SELECT *, lag(up) OVER (PARTITION BY key ORDER BY idx) AS pu FROM (SELECT key, idx, (value > median(value) OVER (PARTITION BY key))::INT AS up FROM series)) GROUP BY key))""")
def runs_test(spark, sf):
    return _r(D.runs_test(series(spark, sf), "value"), "expected", "z")


@query("all_pair_distances", with_(SERIES) + f"""SELECT a.key, count(*)::BIGINT AS pairs, {R('avg(abs(a.ikey-b.ikey))')} AS mean_distance, {R('avg(bit_count(xor(a.ikey,b.ikey)))')} AS mean_hamming FROM series a JOIN series b ON a.key=b.key AND a.idx<b.idx GROUP BY 1""")
def all_pair_distances(spark, sf):
    """Mean distance and Hamming distance over all pairs of a series, from ranks and bit counts."""
    return _r(D.pair_statistics(series(spark, sf), "key", "ikey"), "mean_distance", "mean_hamming")


@query("all_pair_overlap", with_(DRAWS) + f"""SELECT a.series_id, count(*)::BIGINT AS pairs, {R('avg(bit_count(a.mask & b.mask))')} AS mean_overlap FROM draws a JOIN draws b ON a.series_id=b.series_id AND a.round_no<b.round_no GROUP BY 1""")
def all_pair_overlap(spark, sf):
    """Mean overlap over all pairs of draws of a series: number counts choose two."""
    d = draws(spark, sf)
    n = d.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    c = d.select("series_id", F.explode("numbers").alias("v")).groupBy("series_id", "v").agg(F.count(F.lit(1)).alias("c"))
    s = c.groupBy("series_id").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("o"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return s.join(n, "series_id").filter("n > 1").select("series_id", pairs.cast("bigint").alias("pairs"), r6(F.col("o") / pairs).alias("mean_overlap"))


@query("strictly_earlier_mean", with_(SERIES) + f"""SELECT key, idx, {R('avg(value) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)')} AS earlier_mean, last_value(CASE WHEN event_type='purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY key ORDER BY idx) AS asof_purchase FROM series""")
def strictly_earlier_mean(spark, sf):
    """Expanding mean of earlier rows and an as-of carry, without a self join."""
    s = series(spark, sf)
    r = running(s, ["key"], ["idx"], {"s": ("sum", F.col("value")), "asof_purchase": ("last", F.when(F.col("event_type") == "purchase", F.col("value")))})
    return r.select("key", "idx", r6(F.when(F.col("idx") > 0, (F.col("s") - F.col("value")) / F.col("idx"))).alias("earlier_mean"), "asof_purchase")


@query("decayed_average", with_(SERIES) + f"""SELECT a.key, a.idx, {R('sum(power(0.9::DOUBLE,a.idx-b.idx)*b.value)/sum(power(0.9::DOUBLE,a.idx-b.idx))')} AS ewma, {R('median(b.value)')} AS rolling_median FROM series a JOIN series b ON a.key=b.key AND b.idx BETWEEN a.idx-15 AND a.idx GROUP BY 1,2""")
def decayed_average(spark, sf):
    """Decayed mean (0.9 per row) and median of the last 16 rows."""
    def build(d, k):
        return d.withColumn("f", F.collect_list("value").over(Window.partitionBy(*k).orderBy("idx").rowsBetween(-15, 0)))

    s = framed(series(spark, sf), ["key"], "idx", 15, 0, build)
    n = F.size("f")
    w = F.transform(F.sequence(F.lit(1), n), lambda i: F.pow(F.lit(0.9), (n - i).cast("double")))
    srt = F.array_sort("f")
    med = (F.get(srt, ((n - 1) / 2).cast("int")) + F.get(srt, (n / 2).cast("int"))) / 2.0
    return s.select("key", "idx", r6(X.array_sum(F.zip_with("f", w, lambda a, b: a * b)) / X.array_sum(w)).alias("ewma"), r6(med).alias("rolling_median"))


@query("min_max_normalise", with_(SERIES) + f"""SELECT key, idx, {R('CASE WHEN mx-mn < 1e-12 THEN 0 ELSE (value-mn)/(mx-mn) END')} AS scaled FROM (SELECT *, min(value) OVER (PARTITION BY key) AS mn, max(value) OVER (PARTITION BY key) AS mx FROM series)""")
def min_max_normalise(spark, sf):
    s = series(spark, sf).select("key", "idx", "value")
    b = s.groupBy("key").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    span = F.col("mx") - F.col("mn")
    return s.join(b, "key").select("key", "idx", r6(F.when(span < 1e-12, 0.0).otherwise((F.col("value") - F.col("mn")) / span)).alias("scaled"))


@query("state_neighbours", with_(SERIES, """sn AS MATERIALIZED (SELECT key, idx, [value, value-lag(value) OVER w] AS v, lead(value) OVER w - value AS mv FROM series WINDOW w AS (PARTITION BY key ORDER BY idx))""")
       + f"SELECT key, idx, {R('avg(mv)')} AS projected_move FROM (SELECT a.key, a.idx, b.mv, row_number() OVER (PARTITION BY a.key, a.idx ORDER BY round(sqrt(power(a.v[1]-b.v[1],2)+power(a.v[2]-b.v[2],2)),12), b.idx) AS rn FROM sn a JOIN sn b ON a.key=b.key AND b.idx>=1 AND b.idx<a.idx) WHERE rn<=5 GROUP BY 1,2")
def state_neighbours(spark, sf):
    """Mean successor move of the five nearest earlier states."""
    s = D.lagged(series(spark, sf), {"p": ("value", 1), "nx": ("value", -1)}).filter("idx >= 1")
    s = s.select("key", "idx", F.array("value", F.col("value") - F.col("p")).alias("v"), (F.col("nx") - F.col("value")).alias("mv"))
    near = nearest_earlier(s, ["key"], "idx", "v", ["mv"], 5)
    return near.groupBy("key", F.col("pos").alias("idx")).agg(r6(F.avg("mv")).alias("projected_move"))

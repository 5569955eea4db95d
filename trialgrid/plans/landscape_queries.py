"""Key-axis landscape: dedupe, basin summaries, channel fields, neighbourhood tests, forecasts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialgrid.functions import exprs as X
from trialgrid.functions.exprs import r6
from trialgrid.operators import fields as FD
from trialgrid.operators import landscape as L
from trialgrid.operators import replicates as RP
from trialgrid.operators import resample as RS
from trialgrid.operators.ordered import framed, median, position
from trialgrid.plans.registry import query
from trialgrid.plans.views import KEY_SPACE, LANDSCAPE, LROWS, R, U, landscape, landscape_rows, with_


@query("landscape_points", with_(LANDSCAPE) + f"SELECT round, seed, hits, {R('positional_mae')} AS positional_mae FROM land")
def landscape_points(spark, sf):
    """Best row per (round, key)."""
    return landscape(spark, sf).withColumn("positional_mae", r6(F.col("positional_mae")))


@query("landscape_contract", with_(LROWS) + """SELECT count(*)::BIGINT AS rows, count_if(hits NOT BETWEEN 4 AND 6)::BIGINT AS bad_hits,
 count_if(seed < 0 OR seed >= 1000000)::BIGINT AS bad_seed FROM lrows""")
def landscape_contract(spark, sf):
    return landscape_rows(spark, sf).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("hits").between(4, 6)).alias("bad_hits"),
        F.count_if((F.col("seed") < 0) | (F.col("seed") >= KEY_SPACE)).alias("bad_seed"))


_BASIN = """w AS (SELECT *, CASE hits WHEN 4 THEN 4.0::DOUBLE WHEN 5 THEN 16.0 ELSE 64.0 END AS w FROM land),
a AS (SELECT round, sum(w*seed)/sum(w) AS wc, count(*)/1e6 AS d4, count_if(hits>=5)/1e6 AS d5, count_if(hits=6)::BIGINT AS exact_6_count,
  sum(w*hits)/sum(w) AS mean_hit, max(hits) AS max_hit, sum(w) AS mass FROM w GROUP BY round),
cum AS (SELECT round, seed, sum(w) OVER (PARTITION BY round ORDER BY seed) AS c, sum(w) OVER (PARTITION BY round) AS t FROM w),
q AS (SELECT round, min(CASE WHEN c>=0.5::DOUBLE*t THEN seed END) AS center, min(CASE WHEN c>=0.1::DOUBLE*t THEN seed END) AS lo, min(CASE WHEN c>=0.9::DOUBLE*t THEN seed END) AS hi FROM cum GROUP BY round),
e AS (SELECT round, -sum(p*ln(p))/ln(100) AS entropy FROM (SELECT round, m/sum(m) OVER (PARTITION BY round) AS p FROM (SELECT round, seed//10000 AS b, sum(w) AS m FROM w GROUP BY 1,2)) GROUP BY round),
s AS (SELECT w.round, sum(CASE WHEN seed>wc THEN w ELSE 0 END)-sum(CASE WHEN seed<wc THEN w ELSE 0 END) AS skew,
  min(CASE WHEN hits>=5 THEN abs(seed-wc) END) AS n5, min(abs(seed-wc)) AS n4, """ + ", ".join(
    f"coalesce(sum(CASE WHEN abs(seed-wc)<={r} THEN w*seed END)/sum(CASE WHEN abs(seed-wc)<={r} THEN w END), any_value(wc)) AS scale_{r}" for r in L.RADII) + """
  FROM w JOIN a USING (round) GROUP BY w.round),
basin AS MATERIALIZED (SELECT round, center::DOUBLE AS center, wc AS weighted_center, (hi-lo)::DOUBLE AS width, d4 AS density_4_plus, d5 AS density_5_plus, exact_6_count, mean_hit, max_hit,
 entropy, skew/mass AS asymmetry, n5 AS nearest_5_distance, n4 AS nearest_4_distance, """ + ", ".join(f"scale_{r}" for r in L.RADII) + """
 FROM a JOIN q USING (round) JOIN e USING (round) JOIN s USING (round))"""
BASIN = LANDSCAPE + ",\n" + _BASIN
_BCOLS = ["center", "weighted_center", "width", "density_4_plus", "density_5_plus", "mean_hit", "entropy", "asymmetry",
          "nearest_5_distance", "nearest_4_distance", *[f"scale_{r}" for r in L.RADII]]


@query("basin_summary", with_(BASIN) + "SELECT round, exact_6_count, max_hit, " + ", ".join(f"{R(c)} AS {c}" for c in _BCOLS) + " FROM basin")
def basin_summary(spark, sf):
    b = L.basin_summary(landscape(spark, sf))
    return b.select("round", "exact_6_count", "max_hit", *[r6(F.col(c)).alias(c) for c in _BCOLS])


@query("basin_continuity", with_(BASIN) + f"""SELECT {R('corr(c, p)')} AS level_corr, {R('corr(d, pd)')} AS delta_corr, {R('avg(abs(d))')} AS mean_abs_delta,
 {R('median(abs(d))')} AS median_abs_delta FROM (SELECT *, lag(d) OVER (ORDER BY round) AS pd FROM (SELECT round, weighted_center AS c, lag(weighted_center) OVER (ORDER BY round) AS p,
 weighted_center - lag(weighted_center) OVER (ORDER BY round) AS d FROM basin))""")
def basin_continuity(spark, sf):
    """Lag-1 correlation of level and delta of the weighted center, and absolute deltas."""
    b = L.basin_summary(landscape(spark, sf)).select(F.lit(0).alias("axis"), "round", F.col("weighted_center").alias("c"))
    b = position(b, ["axis"], ["round"], "idx")

    def build(d, k):
        w = Window.partitionBy(*k).orderBy("idx")
        return d.withColumn("p", F.lag("c").over(w)).withColumn("pp", F.lag("c", 2).over(w))

    f = framed(b, ["axis"], "idx", 2, 0, build).withColumn("d", F.col("c") - F.col("p")).withColumn("pd", F.col("p") - F.col("pp"))
    f = f.withColumn("ad", F.abs("d"))
    med = median(f, ["axis"], "ad", "m")
    return f.groupBy("axis").agg(r6(F.corr("c", "p")).alias("level_corr"), r6(F.corr("d", "pd")).alias("delta_corr"),
                                 r6(F.avg("ad")).alias("mean_abs_delta")).join(med, "axis").select(
        "level_corr", "delta_corr", "mean_abs_delta", r6(F.col("m")).alias("median_abs_delta"))


def _chan_sql():
    rev = "list_sum(list_transform(range(0,20), lambda i: ((seed >> i) & 1) << (19-i)))::BIGINT"
    dei = "list_sum(list_transform(range(0,20), lambda i: ((seed >> i) & 1) << (i//2 + CASE WHEN i%2=1 THEN 10 ELSE 0 END)))::BIGINT"
    t = {"identity": "seed", "gray": "xor(seed, seed >> 1)", "bit_reverse": rev, "rotate7": "((seed << 7) | (seed >> 13)) & 1048575", "deinterleave": dei}
    items = [f"{{'channel': '{n}-{r}', 'bin': (({e}) * {r}) // 1048576}}" for n, e in t.items() for r in (64, 256)]
    items += [f"{{'channel': 'mod-{m}', 'bin': seed % {m}}}" for m in (257, 509)]
    return "[" + ", ".join(items) + "]"


FIELDS = LANDSCAPE + f""",
cells AS (SELECT round, w, unnest({_chan_sql()}) AS c FROM (SELECT round, seed, CASE hits WHEN 4 THEN 1.0::DOUBLE WHEN 5 THEN 8.0 ELSE 64.0 END/(1+positional_mae) AS w FROM land)),
fields AS MATERIALIZED (SELECT round, channel, bin, m/sum(m) OVER (PARTITION BY round, channel) AS mass FROM (SELECT round, c.channel AS channel, c.bin AS bin, sum(w) AS m FROM cells GROUP BY 1,2,3))"""


@query("channel_fields", with_(FIELDS) + f"""SELECT round, channel, count(*)::BIGINT AS cells, {R('max(mass)')} AS top_mass, {R('-sum(mass*ln(mass))')} AS entropy,
 {R('sum(mass*bin)')} AS mean_bin FROM fields GROUP BY 1,2""")
def channel_fields(spark, sf):
    """Normalised histogram of every round and channel, summarised."""
    f = L.build_fields(landscape(spark, sf))
    return f.groupBy("round", "channel").agg(
        F.count(F.lit(1)).alias("cells"), r6(F.max("mass")).alias("top_mass"),
        r6(-F.sum(F.col("mass") * F.ln("mass"))).alias("entropy"), r6(F.sum(F.col("mass") * F.col("bin"))).alias("mean_bin"))


@query("decayed_fields", with_(FIELDS, "rk AS (SELECT round, row_number() OVER (ORDER BY round)-1 AS idx FROM (SELECT DISTINCT round FROM fields))") + f"""
SELECT t.round, f.channel, {R('sum(f.mass*power(0.9::DOUBLE, t.idx-k.idx)*f.bin)/((1-power(0.9::DOUBLE, least(t.idx+1,16)))/0.1::DOUBLE)')} AS mean_bin
FROM rk t JOIN rk k ON k.idx BETWEEN t.idx-15 AND t.idx JOIN fields f ON f.round=k.round GROUP BY t.round, t.idx, f.channel""".replace("t.idx+1", "any_value(t.idx)+1"))
def decayed_fields(spark, sf):
    """Decayed 16-round average field, reduced to its mean bin per channel."""
    f = L.decayed_fields(L.build_fields(landscape(spark, sf)))
    return f.groupBy("round", "channel").agg(r6(F.sum(F.col("mass") * F.col("bin"))).alias("mean_bin"))


@query("seed_neighbours", with_(LANDSCAPE, "rad AS (SELECT unnest([100,1000,10000,100000]) AS radius)") + f"""
SELECT e.round, e.seed, radius, (SELECT count(*) FROM land p WHERE p.round=e.round AND abs(p.seed-e.seed)<=radius)-1 AS observed,
 (SELECT count(*) FROM land p WHERE p.round=e.round AND abs(p.seed - floor({U('e.round', 'e.seed', "'center'")}*1000000)::BIGINT)<=radius) AS baseline
FROM land e, rad WHERE e.hits=6""")
def seed_neighbours(spark, sf):
    """Neighbours of every exact key within each radius, and of a hashed random center."""
    return RS.neighbour_counts(landscape(spark, sf), L.RADII)


@query("neighbourhood_test", with_(LANDSCAPE, "rad AS (SELECT unnest([100,1000,10000,100000]) AS radius)", f"""
nb AS MATERIALIZED (SELECT e.round, e.seed, radius, (SELECT count(*) FROM land p WHERE p.round=e.round AND abs(p.seed-e.seed)<=radius)-1 AS o,
 (SELECT count(*) FROM land p WHERE p.round=e.round AND abs(p.seed - floor({U('e.round', 'e.seed', "'center'")}*1000000)::BIGINT)<=radius) AS b FROM land e, rad WHERE e.hits=6)""",
 "nu AS (SELECT radius, concat(round,'/',seed) AS unit, (o-b)::DOUBLE AS d FROM nb)", RP.replicate_sql("sim", "nu", ["radius"], ["d"], 10_000, "sign", "flip")) + f"""
SELECT radius, count(*)::BIGINT AS samples, {R('avg(o)')} AS neighbour_mean, {R('avg(b)')} AS random_mean, {R('avg(o-b)')} AS effect,
 {R('(1.0::DOUBLE+(SELECT count_if(d >= tot) FROM sim WHERE sim.radius=x.radius))/10001')} AS p FROM (SELECT *, sum(o-b) OVER (PARTITION BY radius) AS tot FROM nb) x GROUP BY radius, tot""")
def neighbourhood_test(spark, sf):
    """Paired sign-flip test (10,000 flips) of neighbour counts against random centers per radius."""
    nb = RS.neighbour_counts(landscape(spark, sf), L.RADII)
    nb = nb.withColumn("unit", F.concat_ws("/", "round", "seed")).withColumn("diff", F.col("observed") - F.col("baseline"))
    p = RP.sign_flip_tests(nb, ["radius"], {"diff": True}, "unit")
    return nb.groupBy("radius").agg(F.count(F.lit(1)).alias("samples"), r6(F.avg("observed")).alias("neighbour_mean"),
                                    r6(F.avg("baseline")).alias("random_mean"), r6(F.avg("diff")).alias("effect")
                                    ).join(p.select("radius", r6(F.col("diff_p")).alias("p")), "radius")


@query("nearest_to_center", with_(BASIN) + f"""SELECT round, {R('weighted_center')} AS center, {R('nearest_4_distance')} AS distance FROM basin""")
def nearest_to_center(spark, sf):
    """Closest point to each round's weighted center by two as-of carries."""
    p = landscape(spark, sf)
    q = L.basin_summary(p).select("round", "weighted_center")
    out = L.nearest_points(p, q.withColumn("qid", F.lit(1)), ["round"], "seed", ["qid"], "weighted_center", "distance")
    return out.join(q, "round").select("round", r6(F.col("weighted_center")).alias("center"), r6(F.col("distance")).alias("distance"))


_CLIP = lambda e: f"least(999999, greatest(0, round_even({e}, 0)))::BIGINT"
_FC = BASIN + f""",
h AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY round)-1 AS idx, lead(weighted_center) OVER (ORDER BY round) - weighted_center AS nextmove,
 {', '.join(f'{c} - lag({c}) OVER (ORDER BY round) AS m_{c}' for c in ['weighted_center', *[f'scale_{r}' for r in L.RADII]])},
 [weighted_center/1e6, width/1e6, density_4_plus*1000, density_5_plus*100000, entropy, asymmetry] AS st FROM basin),
nn AS (SELECT a.idx, median(b.nextmove) AS mv FROM h a, LATERAL (SELECT nextmove FROM (SELECT b.nextmove, row_number() OVER (ORDER BY round(sqrt(list_sum(list_transform(range(1,7), lambda i: (a.st[i]-b.st[i])*(a.st[i]-b.st[i])))),12), b.idx) AS rn
  FROM h b WHERE b.idx >= 1 AND b.idx < a.idx) WHERE rn <= 5) b GROUP BY a.idx),
dl AS (SELECT a.idx, {', '.join(f'median(b.m_{c}) AS d_{c}' for c in ['weighted_center', *[f'scale_{r}' for r in L.RADII]])} FROM h a JOIN h b ON b.idx BETWEEN a.idx-20 AND a.idx AND b.idx>=1 GROUP BY a.idx),
fc AS (SELECT round, {_CLIP('weighted_center+d_weighted_center')} AS delta_center, {_CLIP('weighted_center+mv')} AS state_center,
 {_CLIP('list_median([' + ','.join(f'scale_{r}+d_scale_{r}' for r in L.RADII) + '])')} AS multi_scale_center,
 {_CLIP('weighted_center + asymmetry*least(greatest(width/4,1000),100000)')} AS gradient_center FROM h JOIN nn USING (idx) JOIN dl USING (idx) WHERE idx >= 31)"""


@query("basin_forecast", with_(_FC) + f"SELECT *, {_CLIP('list_median([delta_center,state_center,multi_scale_center,gradient_center])')} AS ensemble_center FROM fc")
def basin_forecast(spark, sf):
    """Four component centers and their median per round, from rounds up to it (at least 32)."""
    return RS.basin_forecast(L.basin_summary(landscape(spark, sf)))


_XORS = "channel NOT LIKE 'mod%'"
_SIZE = "CASE WHEN channel LIKE 'mod%' THEN substr(channel, 5)::INT ELSE split_part(channel, '-', 2)::INT END"
_FORECASTS = FIELDS + f""",
rk AS (SELECT round, row_number() OVER (ORDER BY round) - 1 AS idx FROM (SELECT DISTINCT round FROM fields)),
ce AS MATERIALIZED (SELECT idx, channel, {_SIZE} AS size, bin::BIGINT AS bin, mass FROM fields JOIN rk USING (round)),
pv AS (SELECT c.idx, c.channel, c.size, c.bin AS b, p.bin AS a, c.mass * p.mass AS v FROM ce c JOIN ce p ON p.idx = c.idx - 1 AND p.channel = c.channel WHERE c.idx >= 31),
sv AS (SELECT idx, channel, arg_min(mv, (-v, mv)) AS mv FROM (SELECT idx, channel, (b - a + size) % size AS mv, round(sum(v), 12) AS v FROM pv GROUP BY 1, 2, 3) GROUP BY 1, 2),
xv AS (SELECT idx, channel, arg_min(mv, (-v, mv)) AS mv FROM (SELECT idx, channel, xor(a, b) AS mv, round(sum(v), 12) AS v FROM pv WHERE {_XORS} GROUP BY 1, 2, 3) GROUP BY 1, 2),
nn AS (SELECT idx, sqrt(sum(size * mass * mass)) AS n FROM ce GROUP BY 1),
cd AS (SELECT a.idx, b.idx AS near, sum(a.mass * b.mass * a.size) AS dot FROM ce a JOIN ce b ON b.channel = a.channel AND b.bin = a.bin AND b.idx < a.idx WHERE a.idx >= 31 GROUP BY 1, 2),
an AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY d, near) AS rn FROM (SELECT cd.idx, near, round(1 - dot/(x.n*y.n), 12) AS d FROM cd JOIN nn x ON x.idx = cd.idx JOIN nn y ON y.idx = near)),
aw AS (SELECT idx, near + 1 AS next, 1/(d + 0.01::DOUBLE) AS w FROM an WHERE rn <= 5),
fo AS (SELECT idx, 'persistence' AS model, channel, bin, mass FROM ce WHERE idx >= 31
 UNION ALL SELECT t.idx, 'ewma', k.channel, k.bin, sum(k.mass * power(0.9::DOUBLE, t.idx - k.idx)) / ((1 - power(0.9::DOUBLE, 16)) / 0.1::DOUBLE) FROM rk t JOIN ce k ON k.idx BETWEEN t.idx - 15 AND t.idx WHERE t.idx >= 31 GROUP BY 1, 3, 4
 UNION ALL SELECT aw.idx, 'analog', c.channel, c.bin, sum(w * c.mass) / any_value(tw) FROM aw JOIN (SELECT idx, sum(w) AS tw FROM aw GROUP BY 1) s ON s.idx = aw.idx JOIN ce c ON c.idx = aw.next GROUP BY 1, 3, 4
 UNION ALL SELECT c.idx, 'shift', c.channel, (c.bin + sv.mv) % c.size, c.mass FROM ce c JOIN sv ON sv.idx = c.idx AND sv.channel = c.channel
 UNION ALL SELECT c.idx, 'xor', c.channel, xor(c.bin, coalesce(xv.mv, 0)), c.mass FROM ce c LEFT JOIN xv ON xv.idx = c.idx AND xv.channel = c.channel WHERE c.idx >= 31),
fa AS (SELECT * FROM fo UNION ALL SELECT idx, 'ensemble', channel, bin, sum(mass) / 4 FROM fo WHERE model <> 'persistence' GROUP BY idx, channel, bin)"""


@query("field_forecasts", with_(_FORECASTS) + f"""SELECT coalesce(n.round, k.round + 1) AS round, model, channel, count(*)::BIGINT AS cells, {R('max(mass)')} AS top_mass, {R('sum(mass * bin)')} AS mean_bin
 FROM fa JOIN rk k ON k.idx = fa.idx LEFT JOIN rk n ON n.idx = fa.idx + 1 GROUP BY 1, 2, 3""")
def field_forecasts(spark, sf):
    """Fields forecast for every round by six models, channel by channel."""
    f = FD.forecast_channels(FD.forecasts(L.build_fields(landscape(spark, sf))))
    return f.select("round", "model", "channel", "cells", r6(F.col("top_mass")).alias("top_mass"), r6(F.col("mean_bin")).alias("mean_bin"))


@query("field_top_seeds")
def field_top_seeds(spark, sf):
    """Top 100 keys per (round, model) over the whole key axis, with the hits they turn out to have."""
    p = landscape(spark, sf)
    top = FD.field_top_seeds(L.build_fields(p), 100)
    return top.join(p.select("round", "seed", "hits"), ["round", "seed"], "left")


MODEL_BUDGETS = (10, 100)


def field_evaluation(selected, p):
    """Per (round, model, budget): selected keys of 4, 5 and 6 hits and more, and what chance gives."""
    top = selected.withColumn("budget", F.explode(F.array(*map(F.lit, MODEL_BUDGETS)))).filter("rank <= budget")
    per = top.groupBy("model", "budget", "round").agg(*[F.count_if(F.col("hits") >= h).alias(f"h{h}") for h in (4, 5, 6)])
    good = p.groupBy("round").agg((F.count(F.lit(1)) / KEY_SPACE).alias("density"))
    return per.join(good, "round", "left").na.fill(0)


@query("field_model_summary")
def field_model_summary(spark, sf):
    """Selected hit counts, rounds with any, expectation and lift per (model, budget)."""
    per = field_evaluation(field_top_seeds(spark, sf), landscape(spark, sf))
    return per.groupBy("model", "budget").agg(
        F.count(F.lit(1)).alias("rounds"), *[F.sum(f"h{h}").alias(f"selected_{h}_plus") for h in (4, 5, 6)],
        F.count_if(F.col("h4") > 0).alias("rounds_with_4_plus"),
        F.sum(F.col("density") * F.col("budget")).alias("expected_4_plus"),
        (F.sum("h4") / F.sum(F.col("density") * F.col("budget"))).alias("lift_4_plus"))

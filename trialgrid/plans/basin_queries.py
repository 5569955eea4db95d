"""Walk-forward evaluation of basin forecasts: nearest points and best hits inside seed windows, against random centers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.functions import exprs as X
from trialgrid.functions.exprs import r6
from trialgrid.operators import landscape as L
from trialgrid.operators import rankforecast as RF
from trialgrid.operators import replicates as RP
from trialgrid.operators import resample as RS
from trialgrid.operators.ordered import framed, position
from trialgrid.plans.landscape_queries import _FC
from trialgrid.plans.registry import query
from trialgrid.plans.views import KEY_SPACE, R, U, landscape, with_
from trialgrid.session import checkpoint_dir

SPLIT, N = 1_050, 10_000
PARTS = ("delta_center", "state_center", "multi_scale_center", "gradient_center")
HITS = (4, 5, 6)


def _median(a):
    s = F.array_sort(a)
    return (F.get(s, ((F.size(s) - 1) / 2).cast("int")) + F.get(s, (F.size(s) / 2).cast("int"))) / 2.0


def _following_round(points: DataFrame) -> DataFrame:
    """(before, round) of consecutive rounds."""
    from pyspark.sql import Window

    r = position(points.select(F.lit(0).alias("axis"), "round").distinct(), ["axis"], ["round"], "idx")
    r = framed(r, ["axis"], "idx", 1, 0, lambda d, k: d.withColumn("before", F.lag("round").over(Window.partitionBy(*k).orderBy("idx"))))
    return r.where("before IS NOT NULL").select("before", "round")


def basin_walk(spark, sf) -> DataFrame:
    """One row for each round with a forecast of its past: distances to the nearest points and best hits per budget, forecast and random.

    The points of a round are joined to its one row of windows, and only minima and maxima leave the tasks. A window without any point counts
    as 3 hits, as the landscape holds all keys of 4 hits and more.
    """
    p = landscape(spark, sf)
    f = RS.basin_forecast(L.basin_summary(p)).withColumnRenamed("round", "before").join(_following_round(p), "before")
    f = f.withColumn("centers", F.array_distinct(F.array(*PARTS, "ensemble_center")))
    draw = lambda i: F.least(F.lit(KEY_SPACE - 1), F.floor(X.hash_uniform("round", i, F.lit("basin")) * KEY_SPACE)).cast("bigint")
    f = f.withColumn("random_centers", F.transform(F.sequence(F.lit(0), F.size("centers") - 1), draw))
    f = f.select("round", *PARTS, "centers", "random_centers", F.rint(_median(F.col("centers"))).cast("bigint").alias("ensemble"), F.rint(_median(F.col("random_centers"))).cast("bigint").alias("random"))
    checkpoint_dir(spark)
    f = f.checkpoint()  # a row a round, read by three branches
    sides = f.select("round", F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("of")) for s, c in (("algorithm", "centers"), ("random", "random_centers"))])))
    w = RF.window_table(sides, ["round", "side"], "of", size=KEY_SPACE, wrap=False)
    w = w.groupBy("round").agg(*[F.max(F.when((F.col("side") == s) & (F.col("budget") == b), F.col("intervals"))).alias(f"{s}_{b}") for s in ("algorithm", "random") for b in RF.BUDGETS])
    wide = f.join(w, "round")
    rows = p.select("round", "seed", "hits").join(wide, "round")
    inside = lambda c: F.exists(c, lambda s: (F.col("seed") >= s["lo"]) & (F.col("seed") <= s["hi"]))
    out = rows.groupBy("round", *PARTS, "ensemble", "random").agg(
        *[F.min(F.when(F.col("hits") >= h, F.abs(F.col("seed") - F.col(c)))).alias(f"{c}_nearest_{h}") for c in ("ensemble", "random") for h in HITS],
        *[F.coalesce(F.max(F.when(inside(f"{s}_{b}"), F.col("hits"))), F.lit(3)).cast("bigint").alias(f"{s}_max_hit_{b}") for s in ("algorithm", "random") for b in RF.BUDGETS])
    return out.withColumn("cohort", F.when(F.col("round") < SPLIT, "Historical").otherwise("Development"))


_E = "list_value(delta_center, state_center, multi_scale_center, gradient_center, list_center)"
_SIDE = """{s}c AS (SELECT round, v, min(k) AS ci FROM (SELECT round, unnest({list}) AS v, generate_subscripts({list}, 1) AS k FROM bw) GROUP BY 1, 2),
{s}g AS (SELECT round, v, ci, coalesce((lead(v) OVER w - v) // 2, 999999 - v) AS up, coalesce((v - lag(v) OVER w - 1) // 2, v) AS down FROM {s}c WINDOW w AS (PARTITION BY round ORDER BY v)),
{s}o AS (SELECT l.round, l.seed, l.hits, arg_min(struct_pack(k := abs(l.seed - v), neg := l.seed < v, ci := ci), (abs(l.seed - v), l.seed < v, ci)) AS o FROM land l JOIN {s}c c ON c.round = l.round GROUP BY 1, 2, 3),
{s}n AS (SELECT p.round, p.seed, p.hits, sum(CASE WHEN o.k = 0 THEN (g.ci <= o.ci)::INT ELSE 1 + least(o.k - 1, up) + least(o.k - 1, down) + (up >= o.k AND (o.neg OR g.ci <= o.ci))::INT + (o.neg AND down >= o.k AND g.ci <= o.ci)::INT END) AS n
  FROM {s}o p JOIN {s}g g ON g.round = p.round GROUP BY p.round, p.seed, p.hits),
{s}h AS (SELECT round, """ + ", ".join(f"coalesce(max(hits) FILTER (n <= {b}), 3)::BIGINT AS {{s}}_max_hit_{b}" for b in RF.BUDGETS) + " FROM {s}n GROUP BY round)"
BASIN_WALK = _FC + f""",
nr AS (SELECT round, lag(round) OVER (ORDER BY round) AS before FROM (SELECT DISTINCT round FROM land)),
b0 AS (SELECT nr.round, fc.* EXCLUDE (round), least(999999, greatest(0, round_even(list_median([delta_center, state_center, multi_scale_center, gradient_center]), 0)))::BIGINT AS list_center FROM fc JOIN nr ON nr.before = fc.round),
b1 AS (SELECT *, {_E} AS algorithm_list, len(list_distinct({_E})) AS k FROM b0),
bw AS MATERIALIZED (SELECT *, list_transform(range(0, k), lambda i: least(999999, floor({U('round', 'i', "'basin'")}*1000000))::BIGINT) AS random_list FROM b1),
bm AS (SELECT *, round_even(list_median(list_distinct(algorithm_list)), 0)::BIGINT AS ensemble, round_even(list_median(random_list), 0)::BIGINT AS random FROM bw),
{_SIDE.format(s='algorithm', list='algorithm_list')},
{_SIDE.format(s='random', list='random_list')},
bd AS (SELECT bm.round, {', '.join(f'min(abs(seed - {c})) FILTER (hits >= {h}) AS {c}_nearest_{h}' for c in ('ensemble', 'random') for h in HITS)} FROM bm JOIN land l ON l.round = bm.round GROUP BY bm.round),
basin_walk AS MATERIALIZED (SELECT bm.round, CASE WHEN bm.round < {SPLIT} THEN 'Historical' ELSE 'Development' END AS cohort, delta_center, state_center, multi_scale_center, gradient_center, ensemble, random,
  bd.* EXCLUDE (round), a.* EXCLUDE (round), r.* EXCLUDE (round) FROM bm JOIN bd ON bd.round = bm.round JOIN algorithmh a ON a.round = bm.round JOIN randomh r ON r.round = bm.round)"""


@query("basin_walk_forward", with_(BASIN_WALK) + "SELECT * FROM basin_walk")
def basin_walk_forward(spark, sf):
    """Centers forecast for every round from earlier rounds, and how near and how good its points turn out to be."""
    return basin_walk(spark, sf)


_MEASURES = {**{f"nearest_{h}": (f"ensemble_nearest_{h}", f"random_nearest_{h}", False) for h in HITS},
             **{f"max_hit_{b}": (f"algorithm_max_hit_{b}", f"random_max_hit_{b}", True) for b in RF.BUDGETS}}
_LONG = " UNION ALL ".join(f"SELECT cohort, round AS unit, '{m}' AS measure, {a}::DOUBLE AS av, {b}::DOUBLE AS bv, {1 if up else -1} AS sign FROM basin_walk WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for m, (a, b, up) in _MEASURES.items())


@query("basin_cohort_summary", with_(BASIN_WALK, f"lo AS MATERIALIZED (SELECT *, (av - bv) * sign AS gain FROM ({_LONG}))", RP.replicate_sql("sg", "lo", ["cohort", "measure"], ["gain"], N, "sign", "flip"))
       + f"""SELECT cohort, measure, rounds, {R('am')} AS algorithm_mean, {R('rm')} AS random_mean, {R('am - rm')} AS effect, a4, r4, a5, r5, a6, r6, {R(f'(count_if(sg.gain >= seen) + 1.0::DOUBLE)/{N + 1}')} AS p
 FROM (SELECT cohort, measure, count(*)::BIGINT AS rounds, avg(av) AS am, avg(bv) AS rm, sum(gain) AS seen, {', '.join(f"count_if({c} >= {h} AND measure LIKE 'max%')::BIGINT AS {n}{h}" for h in HITS for c, n in (('av', 'a'), ('bv', 'r')))} FROM lo GROUP BY 1, 2)
 JOIN sg USING (cohort, measure) GROUP BY ALL""")
def basin_cohort_summary(spark, sf):
    """Per cohort and measure: means, effect and one-sided sign-flip p (10,000 flips); counts of 4+, 5+ and 6 hits for the budgets."""
    w = basin_walk(spark, sf)
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), F.lit(1 if up else -1).alias("sign")) for m, (a, b, up) in _MEASURES.items()])
    u = w.select("cohort", F.col("round").alias("unit"), F.inline(rows)).where("a IS NOT NULL AND b IS NOT NULL").withColumn("gain", (F.col("a") - F.col("b")) * F.col("sign"))
    by = ["cohort", "measure"]
    hit = F.col("measure").startswith("max")
    seen = u.groupBy(*by).agg(F.count(F.lit(1)).alias("rounds"), F.avg("a").alias("am"), F.avg("b").alias("rm"), *[F.count_if((F.col(c) >= h) & hit).alias(f"{n}{h}") for h in HITS for c, n in (("a", "a"), ("b", "r"))])
    p = RP.sign_flip_tests(u, by, {"gain": True}, "unit", N)
    return seen.join(p, by).select(*by, "rounds", r6(F.col("am")).alias("algorithm_mean"), r6(F.col("rm")).alias("random_mean"), r6(F.col("am") - F.col("rm")).alias("effect"),
                                   *[f"{n}{h}" for h in HITS for n in ("a", "r")], r6(F.col("gain_p")).alias("p"))

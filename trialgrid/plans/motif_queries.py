"""Motif retrieval and opportunity queries over the draw series."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialgrid.functions import exprs as X
from trialgrid.functions.exprs import r6
from trialgrid.operators import features as FE
from trialgrid.operators import retrieval as RT
from trialgrid.operators.ordered import FRAME, framed
from trialgrid.plans.registry import query
from trialgrid.plans.views import ODRAWS, R, U, ordered_draws, with_

OFFSETS = [3, 5, 8, 11]
_V = list(RT.VIEWS)

# matches with hashed view similarities: each draw against four fixed earlier offsets, followed by the next draw
MATCHES = ODRAWS + f""",
m0 AS (SELECT t.series_id, t.idx, t.round_no, t.mask AS winner, t.numbers AS wn, o.off, t.idx-1-o.off AS past_end, list_sum(c.numbers)/6.0 AS current_mean, list_sum(p.numbers)/6.0 AS past_mean, f.numbers AS followup, [{', '.join(f'0.3::DOUBLE+0.5::DOUBLE*' + U('t.round_no', 'o.off', f"'{v}'") for v in _V)}] AS sims
 FROM odraws t, (SELECT unnest({OFFSETS}) AS off) o, odraws c, odraws p, odraws f WHERE c.series_id=t.series_id AND c.idx=t.idx-1 AND p.series_id=t.series_id AND p.idx=t.idx-1-o.off AND f.series_id=t.series_id AND f.idx=t.idx-o.off),
mt AS MATERIALIZED (SELECT *, list_sum(list_sort(sims,'DESC')[1:5])/5.0 AS similarity, len(list_filter(sims, lambda s: s>=0.5::DOUBLE))::BIGINT AS support FROM m0)"""


def matches(spark, sf):
    """(series_id, idx, off, past_end, sims, similarity, support, followup, past_mean, current_mean, mask)."""
    d = ordered_draws(spark, sf)
    far = max(OFFSETS) + 1

    def build(x, k):
        w = Window.partitionBy(*k).orderBy("idx")
        cols = {f"n{o}": F.lag("numbers", o).over(w) for o in sorted({1, *OFFSETS, *[o + 1 for o in OFFSETS]})}
        return x.withColumns(cols)

    d = framed(d, ["series_id"], "idx", far, 0, build)
    cells = F.array(*[F.struct(F.lit(o).cast("bigint").alias("off"), F.col(f"n{o + 1}").alias("past"), F.col(f"n{o}").alias("followup")) for o in OFFSETS])
    m = d.select("series_id", "idx", "round_no", "mask", "numbers", X.array_mean(F.col("n1")).alias("current_mean"), F.inline(cells)).filter("past IS NOT NULL")
    sims = F.array(*[0.3 + 0.5 * X.hash_uniform("round_no", "off", F.lit(v)) for v in _V])
    m = m.withColumn("sims", sims).withColumns({"past_end": F.col("idx") - 1 - F.col("off"), "past_mean": X.array_mean(F.col("past"))})
    return m.withColumns({"similarity": X.array_mean(F.slice(F.sort_array("sims", asc=False), 1, 5)),
                          "support": F.size(F.filter("sims", lambda s: s >= 0.5)).cast("bigint")})


@query("successor_join", with_(MATCHES) + f"SELECT round_no, off, past_end, followup, support, {R('similarity')} AS similarity FROM mt")
def successor_join(spark, sf):
    """Match rows with the draw that followed the matched window."""
    return matches(spark, sf).select("round_no", "off", "past_end", "followup", "support", r6(F.col("similarity")).alias("similarity"))


_FAM = "CASE WHEN similarity>=0.57 AND support<=3 THEN 'high-similarity-low-support' WHEN similarity>=0.5 AND similarity<0.57 AND support>=5 THEN 'moderate-similarity-wide-support' WHEN support>=5 AND var<=0.0015 THEN 'high-agreement' WHEN support<=2 THEN 'low-agreement' WHEN var<=0.0005 THEN 'balanced-multiview' WHEN strongest IN ('raw','grid','circle') THEN 'shape-dominant' WHEN strongest='transition' THEN 'transition-dominant' ELSE 'context-dominant' END"
FAM = MATCHES + f""",
fm AS MATERIALIZED (SELECT *, {_FAM} AS family FROM (SELECT *, list_sum(list_transform(sims, lambda s: power(s-list_sum(sims)/6.0,2)))/6.0 AS var, list_sort(list_transform(range(1,7), lambda i: {{'s': sims[i], 'v': ({_V})[i]}}))[-1].v AS strongest FROM mt))"""


@query("motif_families", with_(FAM) + f"""SELECT family, count(*)::BIGINT AS occurrences, count(DISTINCT round_no)::BIGINT AS rounds, sum(bit_count(winner & list_reduce(list_transform(followup, lambda n: 1::BIGINT << n), lambda a, b: a | b)))::BIGINT AS hits, {R('avg(similarity)')} AS mean_similarity FROM fm GROUP BY 1""")
def motif_families(spark, sf):
    """Occurrences, rounds and follow-up hits per motif family."""
    m = matches(spark, sf).withColumn("family", RT.family(F.col("similarity"), F.col("support"), F.col("sims")))
    h = X.hits(F.col("mask"), X.mask_of(F.col("followup")))
    per = m.groupBy("family", "round_no").agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h"), F.sum("similarity").alias("s"))
    return per.groupBy("family").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("rounds"), F.sum("h").alias("hits"), r6(F.sum("s") / F.sum("n")).alias("mean_similarity"))


def _nrm(c):
    return f"CASE WHEN max({c}) OVER w - min({c}) OVER w < 1e-12 THEN 0.0 ELSE ({c}-min({c}) OVER w)/(max({c}) OVER w - min({c}) OVER w) END"


def _vote(expr):
    return f"sum(similarity*list_sum(list_transform(followup, lambda v: {expr})))"


SCORES = MATCHES + f""",
vt AS (SELECT series_id, idx, round_no, item, sum(CASE WHEN list_contains(followup, item) THEN similarity ELSE 0 END) AS exact, {_vote('exp(-(abs((item-1)//7-(v-1)//7)+abs((item-1)%7-(v-1)%7))/2.0)')} AS grid,
 {_vote('exp(-least(abs(item-v)*(2*pi()/45), 2*pi()-abs(item-v)*(2*pi()/45))/0.65)')} AS circle, {_vote('exp(-abs(item-v)/8.0)')} AS band, sum(similarity*exp(-abs(item-(current_mean+list_sum(followup)/6.0-past_mean))/9.0)) AS transition FROM mt, (SELECT unnest(range(1,46)) AS item) GROUP BY 1,2,3,4),
sn AS (SELECT series_id, idx, round_no, item, {', '.join(f'{_nrm(c)} AS {c}' for c in ('exact', 'grid', 'circle', 'band', 'transition'))} FROM vt WINDOW w AS (PARTITION BY series_id, idx)),
sc AS MATERIALIZED (SELECT *, (exact+grid+circle+band+transition+2*ag)/7.0 AS score FROM (SELECT *, ((exact>=0.7)::INT+(grid>=0.7)::INT+(circle>=0.7)::INT+(band>=0.7)::INT+(transition>=0.7)::INT)/5.0 AS ag FROM sn)),
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series_id, idx ORDER BY round(score,9) DESC, item) AS rank FROM sc)"""
_K = ["series_id", "idx"]


def scores(spark, sf):
    """Scores and ranking of each target, scored without labels; the drawn numbers travel beside them."""
    return RT.candidate_scores(matches(spark, sf), _K, ["round_no", "mask"])


@query("candidate_scores", with_(SCORES) + f"SELECT series_id, item, count(*)::BIGINT AS targets, {R('avg(score)')} AS mean_score, {R('avg(ag)')} AS mean_agreement, {R('avg(grid)')} AS mean_grid, {R('avg(circle)')} AS mean_circle, {R('avg(transition)')} AS mean_transition FROM sc GROUP BY 1,2")
def candidate_scores(spark, sf):
    """Kernel-vote scores, averaged per series and item."""
    # targets of a series and frame stay together, so their sums are nearly whole before the last shuffle
    m = matches(spark, sf).withColumn("_frame", F.floor(F.col("idx") / FRAME)).repartition("series_id", "_frame")
    s = RT.candidate_scores(m, ["series_id", "_frame", "idx"])
    items = F.lit(list(range(1, RT.ITEMS + 1))).cast("array<bigint>").alias("item")
    s = s.select("series_id", F.inline(F.arrays_zip(items, "score", "agreement", "grid", "circle", "transition")))
    return s.groupBy("series_id", "item").agg(
        F.count(F.lit(1)).alias("targets"), r6(F.avg("score")).alias("mean_score"), r6(F.avg("agreement")).alias("mean_agreement"),
        r6(F.avg("grid")).alias("mean_grid"), r6(F.avg("circle")).alias("mean_circle"), r6(F.avg("transition")).alias("mean_transition"))


_SIZES = [10, 15, 20, 25, 30]


@query("broad_retrieval", with_(SCORES) + f"""SELECT w.round_no, {', '.join(f'count_if(r.rank<={k} AND list_contains(w.numbers, r.item))::BIGINT AS hits_{k}' for k in _SIZES)}, list(item ORDER BY r.rank)[1:30] AS ranking, CASE WHEN count_if(r.rank<=30 AND list_contains(w.numbers, r.item))>=5 THEN 'high' WHEN count_if(r.rank<=30 AND list_contains(w.numbers, r.item))>=4 THEN 'medium' ELSE 'low' END AS outcome FROM rk r JOIN odraws w USING (series_id, idx) GROUP BY 1""")
def broad_retrieval(spark, sf):
    """Top-30 ranking per target scored without labels; hits are attached afterwards."""
    drawn = lambda i: F.col("mask").bitwiseAND(X.shift_one(i)) != 0
    cnt = lambda k: F.size(F.filter(F.slice("ranking", 1, k), drawn)).cast("bigint")
    h30 = cnt(30)
    return scores(spark, sf).select("round_no", *[cnt(k).alias(f"hits_{k}") for k in _SIZES], F.slice("ranking", 1, 30).alias("ranking"),
                                    F.when(h30 >= 5, "high").when(h30 >= 4, "medium").otherwise("low").alias("outcome"))


@query("candidate_funnel", with_(SCORES) + """SELECT stage, count(*)::BIGINT AS rows, count_if(win)::BIGINT AS winners FROM (SELECT CASE WHEN r.rank<=10 THEN 'top10' WHEN r.rank<=20 THEN 'top20' WHEN r.rank<=30 THEN 'top30' ELSE 'dropped' END AS stage, list_contains(w.numbers, r.item) AS win FROM rk r JOIN odraws w USING (series_id, idx)) GROUP BY 1""")
def candidate_funnel(spark, sf):
    """Drop stage of each item and how many of them were winners."""
    drawn = lambda i: F.col("mask").bitwiseAND(X.shift_one(i)) != 0
    cells = []
    for stage, first, size in (("top10", 1, 10), ("top20", 11, 10), ("top30", 21, 10), ("dropped", 31, 15)):
        part = F.slice("ranking", first, size)
        cells.append(F.struct(F.lit(stage).alias("stage"), F.size(part).alias("n"), F.size(F.filter(part, drawn)).alias("w")))
    r = scores(spark, sf).select(F.inline(F.array(*cells)))
    return r.groupBy("stage").agg(F.sum("n").alias("rows"), F.sum("w").alias("winners"))


_CNT = MATCHES + """,
nc AS (SELECT series_id, idx, v, sum(similarity) AS c FROM (SELECT series_id, idx, similarity, unnest(followup) AS v FROM mt) GROUP BY 1,2,3),
en AS (SELECT series_id, idx, (ln(sum(c))-sum(c*ln(c))/sum(c))/ln(45) AS entropy FROM nc GROUP BY 1,2),
mm AS (SELECT series_id, idx, any_value(round_no) AS round_no, count(*)::BIGINT AS motifs, avg(similarity) AS top, avg(support) AS sup, median(similarity) AS med, max(similarity) AS best, var_pop(similarity) AS var, stddev_pop(off+0.0) AS sep_std, avg(off) AS sep_mean FROM mt GROUP BY 1,2)"""


@query("followup_confidence", with_(_CNT) + f"SELECT round_no, motifs, {R('entropy')} AS entropy, {R('top*greatest(0,1-entropy)*sup/6.0')} AS confidence FROM mm JOIN en USING (series_id, idx)")
def followup_confidence(spark, sf):
    """Similarity-weighted follow-up entropy and confidence."""
    m = matches(spark, sf)
    c = m.select(*_K, "similarity", F.explode("followup").alias("v")).groupBy(*_K, "v").agg(F.sum("similarity").alias("c"))
    t = F.sum("c")
    e = c.groupBy(*_K).agg(((F.ln(t) - F.sum(F.col("c") * F.ln("c")) / t) / math.log(45)).alias("entropy"))
    s = m.groupBy(*_K).agg(F.first("round_no").alias("round_no"), F.count(F.lit(1)).alias("motifs"), F.avg("similarity").alias("top"), F.avg("support").alias("sup"))
    return s.join(e, _K).select("round_no", "motifs", r6(F.col("entropy")).alias("entropy"),
                                r6(F.col("top") * F.greatest(F.lit(0.0), 1 - F.col("entropy")) * F.col("sup") / 6.0).alias("confidence"))


_OF = ["best_similarity", "median_similarity", "similarity_variance", "separation_mean", "separation_std", "top2_view_gap", "view_variance", "grid_entropy", "pair_concentration"]


@query("opportunity_features", with_(_CNT, "vw AS (SELECT series_id, idx, list(a ORDER BY k) AS vm FROM (SELECT series_id, idx, k, avg(s) AS a FROM (SELECT series_id, idx, unnest(sims) AS s, unnest(range(1,7)) AS k FROM mt) GROUP BY 1,2,3) GROUP BY 1,2)",
       "ge AS (SELECT series_id, idx, (ln(sum(c))-sum(c*ln(c))/sum(c))/ln(7) AS grid_entropy FROM (SELECT series_id, idx, (v-1)//7 AS g, sum(c) AS c FROM nc GROUP BY 1,2,3) GROUP BY 1,2)",
       f"pc AS (SELECT series_id, idx, max(c)/sum(c) AS pair_concentration FROM (SELECT series_id, idx, p, sum(similarity) AS c FROM (SELECT series_id, idx, similarity, unnest([{', '.join(f'followup[{i}]*100+followup[{j}]' for i in range(1, 7) for j in range(i + 1, 7))}]) AS p FROM mt) GROUP BY 1,2,3) GROUP BY 1,2)")
       + f"SELECT round_no, motifs, {R('best')} AS best_similarity, {R('med')} AS median_similarity, {R('var')} AS similarity_variance, {R('sep_mean')} AS separation_mean, {R('sep_std')} AS separation_std, {R('list_sort(vm)[6]-list_sort(vm)[5]')} AS top2_view_gap, {R('list_sum(list_transform(vm, lambda x: power(x-list_sum(vm)/6.0,2)))/6.0')} AS view_variance, {R('grid_entropy')} AS grid_entropy, {R('pair_concentration')} AS pair_concentration, ({_V})[list_position(vm, list_max(vm))] AS strongest_view FROM mm JOIN vw USING (series_id, idx) JOIN ge USING (series_id, idx) JOIN pc USING (series_id, idx)")
def opportunity_features(spark, sf):
    """Retrieval, cross-view and consensus statistics of the match set of each target."""
    m = matches(spark, sf)
    base = m.groupBy(*_K).agg(
        F.first("round_no").alias("round_no"), F.count(F.lit(1)).alias("motifs"), F.max("similarity").alias("best_similarity"),
        F.var_pop("similarity").alias("similarity_variance"), F.avg("off").alias("separation_mean"), F.stddev_pop("off").alias("separation_std"),
        F.sort_array(F.collect_list(F.struct("similarity", X.mask_of(F.col("followup")).alias("mask")))).alias("_m"),  # at most four matches a target
        F.array(*[F.avg(F.get("sims", i)) for i in range(6)]).alias("vm"))
    n = F.size("_m")
    s = [F.get("_m", i)["similarity"] for i in range(len(OFFSETS))]
    f = [F.get("_m", i)["mask"] for i in range(len(OFFSETS))]
    med = (F.get("_m", ((n - 1) / 2).cast("int"))["similarity"] + F.get("_m", (n / 2).cast("int"))["similarity"]) / 2.0
    base = base.withColumn("median_similarity", med).withColumn("_v", F.sort_array("vm", asc=False))
    add = lambda cells: reduce(lambda a, b: a + b, cells)
    rows = [sum(1 << v for v in range(1, 46) if (v - 1) // 7 == g) for g in range(7)]
    base = base.withColumns({f"_g{g}": add([F.coalesce(s[i] * F.bit_count(f[i].bitwiseAND(F.lit(m))), F.lit(0.0)) for i in range(len(OFFSETS))]) for g, m in enumerate(rows)})
    c = [F.col(f"_g{g}") for g in range(7)]
    spread = add([F.when(x > 0, x * F.ln(x)).otherwise(0.0) for x in c])
    # a pair weighs what the matches that hold it weigh together: subsets of the matches with two numbers in common
    subsets = [ix for size in range(1, len(OFFSETS) + 1) for ix in combinations(range(len(OFFSETS)), size)]
    heaviest = F.greatest(F.lit(0.0), *[F.when(F.bit_count(reduce(lambda a, b: a.bitwiseAND(b), [f[i] for i in ix])) >= 2, add([s[i] for i in ix])) for ix in subsets])
    out = base.withColumns({
        "grid_entropy": (F.ln(add(c)) - spread / add(c)) / math.log(7),
        "pair_concentration": heaviest / (15 * add([F.coalesce(x, F.lit(0.0)) for x in s])),
        "top2_view_gap": F.get("_v", 0) - F.get("_v", 1), "view_variance": X.array_var_pop(F.col("vm")),
        "strongest_view": F.get(F.lit(_V), (F.array_position("vm", F.array_max("vm")) - 1).cast("int"))})
    return out.select("round_no", "motifs", *[r6(F.col(c)).alias(c) for c in _OF], "strongest_view")


_VARIANTS = [("full", [0, 1, 2, 3, 4, 5])] + [(f"without_{v}", [j for j in range(6) if j != i]) for i, v in enumerate(_V)] + [(f"only_{v}", [i]) for i, v in enumerate(_V)] + [
    ("raw_grid", [0, 1]), ("raw_circle", [0, 2]), ("grid_circle", [1, 2]), ("distribution_transition", [3, 4]), ("transition_context", [4, 5])]


@query("view_variants", with_(MATCHES, f"va AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {[i + 1 for i in ix]})' for n, ix in _VARIANTS)}) t(variant, ix))")
       + f"SELECT variant, count(*)::BIGINT AS rows, {R('avg(agg)')} AS mean_similarity, {R('avg(sup)')} AS mean_support FROM (SELECT variant, list_sum(list_sort(s,'DESC')[1:CAST(ceil(len(s)*0.67) AS BIGINT)])/ceil(len(s)*0.67) AS agg, len(list_filter(s, lambda v: v>=0.5)) AS sup FROM (SELECT variant, list_transform(ix, lambda i: sims[i]) AS s FROM mt, va)) GROUP BY 1")
def view_variants(spark, sf):
    """Aggregate similarity under 18 view subsets: full, leave-one-out, single and pairs."""
    m = matches(spark, sf).select("sims")
    v = F.array(*[F.struct(F.lit(n).alias("variant"), F.array(*[F.get("sims", i) for i in ix]).alias("s")) for n, ix in _VARIANTS])
    e = m.select(F.inline(v))
    keep = F.ceil(F.size("s") * 0.67).cast("int")
    agg = X.array_sum(F.slice(F.sort_array("s", asc=False), F.lit(1), keep)) / keep
    return e.groupBy("variant").agg(F.count(F.lit(1)).alias("rows"), r6(F.avg(agg)).alias("mean_similarity"),
                                    r6(F.avg(F.size(F.filter("s", lambda x: x >= 0.5)))).alias("mean_support"))


def _viewed(spark, sf):
    d = ordered_draws(spark, sf)
    return d.select("series_id", "idx", FE.raw_view(F.col("numbers")).alias("raw"), FE.grid_view(F.col("numbers")).alias("grid"),
                    FE.circle_view(F.col("numbers")).alias("circle"))


@query("motif_retrieval")
def motif_retrieval(spark, sf):
    """Best non-overlapping earlier windows of every draw by multi-view warping similarity."""
    m = RT.retrieve(_viewed(spark, sf), ["series_id"], ["raw", "grid", "circle"], 5, (4, 5, 6), 20, 5)
    return m.withColumn("similarity", F.round("similarity", 6)).drop("sims")


@query("best_combinations")
def best_combinations(spark, sf):
    """Best hit count among the first 100, 1,000 and 10,000 six-sets of the top-20 items."""
    return RT.best_combinations(scores(spark, sf), _K, "mask")

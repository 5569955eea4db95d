"""Draw-level queries: validity, labels, set functions, shape features, transitions, rolling context."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialgrid.functions import exprs as X
from trialgrid.functions.exprs import r6
from trialgrid.operators import features as FE
from trialgrid.operators.ordered import framed
from trialgrid.plans.registry import query
from trialgrid.plans.views import DRAWS, ODRAWS, R, draws, ordered_draws, table, with_


@query("draw_validity", with_(DRAWS) + """SELECT series_id, round_no, bonus, valid FROM (SELECT *,
 round_no > 0 AND len(list_distinct(numbers)) = 6 AND list_min(numbers) >= 1 AND list_max(numbers) <= 45
 AND (bonus IS NULL OR (bonus BETWEEN 1 AND 45 AND NOT list_contains(numbers, bonus)))
 AND count(*) OVER (PARTITION BY series_id, round_no) = 1 AS valid FROM (SELECT *, CASE WHEN round_no % 9 <> 0 THEN (rank % 47)::INTEGER END AS bonus FROM draws))""")
def draw_validity(spark, sf):
    """Six distinct numbers in range, a bonus (may be absent) in range and not among them, one draw a round."""
    d = draws(spark, sf).withColumn("bonus", F.when(F.col("round_no") % 9 != 0, F.col("rank") % 47).cast("int"))
    n, bonus = F.col("numbers"), F.col("bonus")
    ok = (F.col("round_no") > 0) & (F.size(F.array_distinct(n)) == 6) & F.forall(n, lambda v: v.between(1, 45))
    ok &= bonus.isNull() | (bonus.between(1, 45) & ~F.array_contains(n, bonus))
    # duplicates are found on (series, round), whose groups are tiny
    unique = F.count(F.lit(1)).over(Window.partitionBy("series_id", "round_no")) == 1
    return d.select("series_id", "round_no", "bonus", (ok & unique).alias("valid"))


@query("find_draws", with_(DRAWS) + "SELECT d.round_no, d.numbers FROM draws d WHERE d.round_no IN (SELECT doc_id FROM labels)")
def find_draws(spark, sf):
    """Point lookups: draws of the requested rounds."""
    wanted = table(spark, sf, "labels").select(F.col("doc_id").alias("round_no"))
    return draws(spark, sf).join(wanted, "round_no", "left_semi").select("round_no", "numbers")


# fixed values: first and last round of each block
BLOCKS = [("Blind-A", 468, 563), ("Blind-B", 564, 659), ("Locked-A", 660, 755), ("Locked-B", 756, 851),
          ("Seen-A", 852, 947), ("Seen-B", 948, 1043), ("Seen-C", 1044, 1139), ("Seen-D", 1140, 1235)]


@query("cohort_labels", with_(DRAWS) + "SELECT round_no, CASE " + " ".join(f"WHEN round_no BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in BLOCKS) + """ END AS block,
 CASE WHEN round_no BETWEEN 852 AND 1043 THEN 'Seen-Historical' WHEN round_no BETWEEN 1044 AND 1235 THEN 'Seen-Development' END AS cohort FROM draws""")
def cohort_labels(spark, sf):
    """Block by range join with an eight-row table (null outside all of them), cohort of the seen blocks by split round."""
    blocks = spark.createDataFrame(BLOCKS, "block string, lo bigint, hi bigint")
    d = draws(spark, sf).select("round_no")
    return d.join(F.broadcast(blocks), d.round_no.between(blocks.lo, blocks.hi), "left").select(
        "round_no", "block", F.when(F.col("block").isin("Seen-A", "Seen-B"), "Seen-Historical").when(F.col("block").startswith("Seen"), "Seen-Development").alias("cohort"))


@query("series_overview", """SELECT o_custkey // 10 AS series_id, count(*)::BIGINT AS rows, min(o_orderkey) AS first_round,
 max(o_orderkey) AS last_round, list_sort(list(o_orderkey))[-3:] AS latest FROM orders GROUP BY 1""")
def series_overview(spark, sf):
    from trialgrid.operators.ordered import top_rows
    d = table(spark, sf, "orders").select(F.floor(F.col("o_custkey") / 10).alias("series_id"), F.col("o_orderkey").alias("r"))
    base = d.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"), F.min("r").alias("first_round"), F.max("r").alias("last_round"))
    last = top_rows(d, ["series_id"], [F.desc("r")], 3).groupBy("series_id").agg(F.array_sort(F.collect_list("r")).alias("latest"))
    return base.join(last, "series_id")


@query("combination_rank", with_(DRAWS) + "SELECT round_no, rank, rank AS back FROM draws")
def combination_rank(spark, sf):
    """Rank of the unranked set is the rank again."""
    return draws(spark, sf).select("round_no", "rank", X.rank_of(F.col("numbers")).alias("back"))


_LAG = ODRAWS + """,
pairs AS (SELECT *, lag(numbers) OVER w AS prev, lag(mask) OVER w AS pmask, lag(rank) OVER w AS prank FROM odraws
 WINDOW w AS (PARTITION BY series_id ORDER BY idx))"""


def _lagged(spark, sf, cols, steps=(1,)):
    d = ordered_draws(spark, sf)

    def build(df, keys):
        w = Window.partitionBy(*keys).orderBy("idx")
        return df.withColumns({f"{c}_{s}": F.lag(c, s).over(w) for c in cols for s in steps})

    return framed(d, ["series_id"], "idx", max(steps), 0, build)


@query("set_metrics", with_(_LAG) + f"""SELECT round_no, bit_count(mask & pmask)::BIGINT AS hits, 12-2*bit_count(mask & pmask)::BIGINT AS set_distance,
 list_transform(range(1,7), lambda i: numbers[i]-prev[i]) AS deviations,
 {R('list_sum(list_transform(range(1,7), lambda i: abs(numbers[i]-prev[i])))/6.0')} AS mae,
 {R('list_sum(list_transform(range(1,7), lambda i: numbers[i]-prev[i]))/6.0')} AS bias FROM pairs WHERE prev IS NOT NULL""")
def set_metrics(spark, sf):
    """Hits, distance, deviations, error and bias of each draw against the previous one."""
    d = _lagged(spark, sf, ["numbers", "mask"]).filter("mask_1 IS NOT NULL")
    a, b = F.col("numbers"), F.col("numbers_1")
    h = X.hits(F.col("mask"), F.col("mask_1"))
    return d.select("round_no", h.alias("hits"), (12 - 2 * h).alias("set_distance"), X.deviations(a, b).alias("deviations"),
                    r6(X.positional_mae(a, b)).alias("mae"), r6(X.signed_bias(a, b)).alias("bias"))


_W = X.bit_width(X.TOTAL_SETS)


@query("rank_features", with_(ODRAWS) + f"""SELECT round_no, rank, d1 AS delta_1, d2 AS delta_2, d3 AS delta_3, abs(d1) AS abs_delta, sign(d1)::BIGINT AS delta_sign,
 {R(f'd1/{X.TOTAL_SETS}')} AS normalized_delta, CASE WHEN r1 IS NULL THEN 0 ELSE least(abs(rank-r1), {X.TOTAL_SETS}-abs(rank-r1)) END AS circular_delta,
 bit_count(rank)::BIGINT AS popcount, ({_W} - CASE WHEN rank=0 THEN 0 ELSE length(bin(rank)) END)::BIGINT AS leading_zeros,
 CASE WHEN rank=0 THEN {_W} ELSE bit_count((rank & -rank)-1)::BIGINT END AS trailing_zeros,
 list_count(list_filter(range(0,{_W - 1}), lambda i: ((rank >> i) & 1) <> ((rank >> (i+1)) & 1)))::BIGINT AS bit_transitions,
 x AS xor, bit_count(x)::BIGINT AS xor_popcount, ((x << 7) | (x >> {_W - 7})) & {(1 << _W) - 1} AS rotated_xor FROM (
 SELECT *, coalesce(rank-r1,0) AS d1, CASE WHEN r2 IS NULL THEN 0 ELSE rank-2*r1+r2 END AS d2,
  CASE WHEN r3 IS NULL THEN 0 ELSE (rank-2*r1+r2)-(r1-2*r2+r3) END AS d3, coalesce(xor(rank,r1),0) AS x FROM (
 SELECT *, lag(rank,1) OVER w AS r1, lag(rank,2) OVER w AS r2, lag(rank,3) OVER w AS r3 FROM odraws WINDOW w AS (PARTITION BY series_id ORDER BY idx)))""")
def rank_features(spark, sf):
    return FE.rank_features(_lagged(spark, sf, ["rank"], (1, 2, 3)))


@query("bit_transforms", """SELECT k AS seed, k ^ 0 AS identity, xor(k, k >> 1) AS gray, list_sum(list_transform(range(0,20), lambda i: ((k >> i) & 1) << (19-i)))::BIGINT AS bit_reverse,
 ((k << 7) | (k >> 13)) & 1048575 AS rotate7, list_sum(list_transform(range(0,20), lambda i: ((k >> i) & 1) << (i//2 + CASE WHEN i%2=1 THEN 10 ELSE 0 END)))::BIGINT AS deinterleave,
 k % 257 AS mod_257, k % 509 AS mod_509 FROM (SELECT o_orderkey*73939 % 1000000 AS k FROM orders)""".replace("k ^ 0", "k"))
def bit_transforms(spark, sf):
    k = F.col("seed")
    s = table(spark, sf, "orders").select((F.col("o_orderkey") * 73939 % 1000000).alias("seed"))
    return s.select("seed", *[X.bit_transform(k, t).alias(t) for t in ("identity", "gray", "bit_reverse", "rotate7", "deinterleave")],
                    (k % 257).alias("mod_257"), (k % 509).alias("mod_509"))


def _arr(*items):
    return "[" + ", ".join(items) + "]"


_G = "list_transform(range(1,6), lambda i: numbers[i+1]-numbers[i])"
_AVG6 = "(list_sum(numbers)/6.0)"
_VAR6 = f"(list_sum(list_transform(numbers, lambda v: (v-m)*(v-m)))/6.0)"
RAW_SQL = with_(DRAWS) + f"""SELECT round_no, list_transform(list_concat(
 list_transform(numbers, lambda v: v/45.0::DOUBLE), list_transform(g, lambda v: v/44.0::DOUBLE),
 [numbers[1]/45.0::DOUBLE, numbers[6]/45.0::DOUBLE, (numbers[6]-numbers[1])/44.0::DOUBLE, m*6/270.0::DOUBLE, m/45.0::DOUBLE, (numbers[3]+numbers[4])/90.0::DOUBLE, vr/1936.0::DOUBLE, sqrt(vr)/44.0::DOUBLE],
 list_transform(list_sort(g), lambda v: v/44.0::DOUBLE),
 [-list_sum(list_transform(g, lambda v: v/gs*ln(v/gs+1e-12::DOUBLE)))/ln(5), (list_position(g, list_max(g))-1)/4.0::DOUBLE, (list_position(g, list_min(g))-1)/4.0::DOUBLE]),
 lambda v: floor(v*1e6+0.501)/1e6) AS raw FROM (SELECT *, {_VAR6} AS vr, list_sum(g)::DOUBLE AS gs FROM (SELECT round_no, numbers, list_sum(numbers)/6.0::DOUBLE AS m, {_G} AS g FROM draws))"""


@query("shape_raw", RAW_SQL)
def shape_raw(spark, sf):
    """27 raw shape features per draw."""
    return draws(spark, sf).select("round_no", FE.rounded(FE.raw_view(F.col("numbers"))).alias("raw"))


_PAIRS6 = [(i, j) for i in range(1, 7) for j in range(i + 1, 7)]
_RC = ("list_transform(numbers, lambda v: (v-1)//7) AS rows, list_transform(numbers, lambda v: (v-1)%7) AS cols")


def _mean(a):
    return f"(list_sum({a})/len({a}))"


def _std(a):
    return f"sqrt(list_sum(list_transform({a}, lambda v: (v-{_mean(a)})*(v-{_mean(a)})))/len({a}))"


_E = _arr(*[f"sqrt(((rows[{i}]-rows[{j}])*(rows[{i}]-rows[{j}])+(cols[{i}]-cols[{j}])*(cols[{i}]-cols[{j}]))::DOUBLE)" for i, j in _PAIRS6])
_MH = _arr(*[f"(abs(rows[{i}]-rows[{j}])+abs(cols[{i}]-cols[{j}]))::DOUBLE" for i, j in _PAIRS6])
_DIAG = "list_transform(range(1,7), lambda i: (rows[i]-cols[i])::DOUBLE)"
_REFL = lambda r, c: f"list_count(list_filter(range(1,7), lambda i: list_contains(numbers, {r}*7+{c}+1)))"
GRID_SQL = with_(DRAWS) + f"""SELECT round_no, list_transform(list_concat([list_min(rows)/6.0::DOUBLE, list_max(rows)/6.0::DOUBLE, list_min(cols)/6.0::DOUBLE, list_max(cols)/6.0::DOUBLE,
 {_mean('rows')}/6.0, {_mean('cols')}/6.0, sr/3.0, sc/3.0, {_std('dg')}/6.0,
 {_mean('e')}/sqrt(72.0), {_std('e')}/sqrt(72.0), {_mean('mh')}/12.0, {_std('mh')}/12.0],
 list_transform(range(0,7), lambda k: list_count(list_filter(rows, lambda r: r=k))/6.0::DOUBLE),
 list_transform(range(0,7), lambda k: list_count(list_filter(cols, lambda c: c=k))/6.0::DOUBLE),
 [greatest({_REFL('rows[i]', '(6-cols[i])')}, {_REFL('(6-rows[i])', 'cols[i]')})/6.0::DOUBLE,
  list_count(list_filter(e, lambda v: v <= sqrt(2.0::DOUBLE)))/15.0::DOUBLE, power({_std('list_concat(rows, cols)')},2)/9.0]),
 lambda v: floor(v*1e6+0.501)/1e6) AS grid FROM (SELECT *, {_std('rows')} AS sr, {_std('cols')} AS sc, {_DIAG} AS dg, {_E} AS e, {_MH} AS mh FROM (SELECT round_no, numbers, {_RC} FROM draws))"""


@query("shape_grid", GRID_SQL)
def shape_grid(spark, sf):
    """30 grid features per draw (component count is a separate query)."""
    return draws(spark, sf).select("round_no", FE.rounded(FE.grid_view(F.col("numbers"))).alias("grid"))


@query("grid_components", with_("RECURSIVE " + DRAWS, """cells AS (SELECT round_no, unnest(numbers) AS c FROM draws)""",
    """reach AS (SELECT round_no, c, c AS root FROM cells UNION SELECT r.round_no, k.c, r.root FROM reach r JOIN cells k ON k.round_no = r.round_no
 AND ((abs(k.c-r.c)=7) OR (abs(k.c-r.c)=1 AND (k.c-1)//7 = (r.c-1)//7)))""") +
 "SELECT round_no, count(*)::BIGINT AS components FROM (SELECT round_no, c, min(root) AS m FROM reach GROUP BY 1,2) WHERE m = c GROUP BY 1")
def grid_components(spark, sf):
    """4-connected component count of the occupied 7x7 cells."""
    cell = F.call_function("shiftright", F.col("mask"), F.lit(1))
    return FE.component_counts(draws(spark, sf).select("round_no", cell.alias("cells")))


_A = "list_transform(numbers, lambda v: (v-1)*(2*pi()/45))"
_CH = _arr(*[f"sqrt(power(cos(a[{i}])-cos(a[{j}]),2)+power(sin(a[{i}])-sin(a[{j}]),2))" for i, j in _PAIRS6])
_ED = "list_transform(range(1,7), lambda i: sqrt(power(cos(a[i%6+1])-cos(a[i]),2)+power(sin(a[i%6+1])-sin(a[i]),2)))"
_AG = "list_concat(list_transform(range(1,6), lambda i: (a[i+1]-a[i])/(2*pi())), [(a[1]+2*pi()-a[6])/(2*pi())])"
_CX = "(list_sum(list_transform(a, lambda v: cos(v)))/6.0)"
_CY = "(list_sum(list_transform(a, lambda v: sin(v)))/6.0)"
_AREA = "abs(list_sum(list_transform(range(1,7), lambda i: cos(a[i])*sin(a[i%6+1])-cos(a[i%6+1])*sin(a[i]))))/2"
CIRCLE_SQL = with_(DRAWS) + f"""SELECT round_no, list_transform(list_concat(list_transform(a, lambda v: v/(2*pi())),
 [{_mean('ch')}/2, {_std('ch')}/2, list_min(ch)/2, list_max(ch)/2], ag, [1-sqrt(cx*cx+cy*cy), cx, cy, {_AREA}/3, list_sum(ed)/12],
 list_transform(ed, lambda v: v/2), [list_max(ag)], list_transform(a, lambda v: cos(v-a[1])), list_transform(a, lambda v: sin(v-a[1]))),
 lambda v: floor(v*1e6+0.501)/1e6) AS circle FROM (SELECT *, {_CH} AS ch, {_ED} AS ed, {_AG} AS ag, {_CX} AS cx, {_CY} AS cy FROM (SELECT round_no, {_A} AS a FROM draws))"""


@query("shape_circle", CIRCLE_SQL)
def shape_circle(spark, sf):
    """40 circle features per draw."""
    return draws(spark, sf).select("round_no", FE.rounded(FE.circle_view(F.col("numbers"))).alias("circle"))


_PRIMES = "[2,3,5,7,11,13,17,19,23,29,31,37,41,43]"
_SAME = "+".join(f"CASE WHEN (numbers[{i}]-1)//10 = (numbers[{j}]-1)//10 THEN 1 ELSE 0 END" for i, j in _PAIRS6)
DIST_SQL = with_(DRAWS) + f"""SELECT round_no, list_transform(list_concat([list_count(list_filter(numbers, lambda v: v%2=1))/6.0::DOUBLE, list_count(list_filter(numbers, lambda v: v<=22))/6.0::DOUBLE],
 list_transform(range(0,5), lambda k: list_count(list_filter(numbers, lambda v: least((v-1)//10,4)=k))/6.0::DOUBLE),
 list_transform(range(0,10), lambda k: list_count(list_filter(numbers, lambda v: v%10=k))/6.0::DOUBLE),
 [list_count(list_filter(numbers, lambda v: list_contains({_PRIMES}, v)))/6.0::DOUBLE, list_count(list_filter(range(1,6), lambda i: numbers[i+1]-numbers[i]=1))/5.0::DOUBLE,
  ({_SAME})/15.0::DOUBLE, list_sum(numbers)/270.0::DOUBLE, (numbers[6]-numbers[1])/44.0::DOUBLE, 6.0::DOUBLE/greatest(numbers[6]-numbers[1]+1, 6)]),
 lambda v: floor(v*1e6+0.501)/1e6) AS distribution FROM draws"""


@query("shape_distribution", DIST_SQL)
def shape_distribution(spark, sf):
    """23 distribution features per draw."""
    return draws(spark, sf).select("round_no", FE.rounded(FE.distribution_view(F.col("numbers"))).alias("distribution"))


def _mx(a, f):
    return f"(list_sum(list_transform({a}, lambda v: {f}))/6.0)"


_RW, _CL = "((v-1)//7)::DOUBLE", "((v-1)%7)::DOUBLE"
_CO, _SI = "cos((v-1)*(2*pi()/45))", "sin((v-1)*(2*pi()/45))"
_STD = lambda a: f"sqrt(list_sum(list_transform({a}, lambda v: (v-list_sum({a})/6.0)*(v-list_sum({a})/6.0)))/6.0)"


def _chg(p):
    return [f"sqrt(list_sum(list_transform(range(1,7), lambda i: power((numbers[i]-{p}[i])/45.0::DOUBLE,2))))/sqrt(6.0)",
            f"sqrt(power({_mx('numbers', _RW)}-{_mx(p, _RW)},2)+power({_mx('numbers', _CL)}-{_mx(p, _CL)},2))/sqrt(72.0)",
            f"sqrt(power({_mx('numbers', _CO)}-{_mx(p, _CO)},2)+power({_mx('numbers', _SI)}-{_mx(p, _SI)},2))/2.0"]


TRANS_SQL = with_(ODRAWS) + f"""SELECT round_no, list_transform(CASE WHEN p IS NULL THEN list_transform(range(0,17), lambda i: 0.0::DOUBLE) ELSE list_concat([bit_count(mask & pm)/6.0::DOUBLE, coalesce(bit_count(mask & qm)/6.0::DOUBLE, 0),
 list_sum(list_transform(range(1,7), lambda i: abs(numbers[i]-p[i])))/6.0/44.0::DOUBLE,
 ({_mx('numbers', _RW)}-{_mx('p', _RW)})/6.0, ({_mx('numbers', _CL)}-{_mx('p', _CL)})/6.0, ({_mx('numbers', _CO)}-{_mx('p', _CO)})/2.0, ({_mx('numbers', _SI)}-{_mx('p', _SI)})/2.0,
 (list_sum(numbers)-list_sum(p))/264.0::DOUBLE, ((numbers[6]-numbers[1])-(p[6]-p[1]))/44.0::DOUBLE, ({_STD('numbers')}-{_STD('p')})/44.0,
 sqrt(list_sum(list_transform(range(1,6), lambda i: power((numbers[i+1]-numbers[i])-(p[i+1]-p[i]),2))))/(44.0*sqrt(5.0))],
 [{', '.join(_chg('p'))}], CASE WHEN q IS NULL THEN [0.0::DOUBLE,0.0,0.0] ELSE [{', '.join(_chg('q'))}] END) END, lambda v: floor(v*1e6+0.501)/1e6) AS transition
 FROM (SELECT *, lag(numbers,1) OVER w AS p, lag(numbers,2) OVER w AS q, lag(mask,1) OVER w AS pm, lag(mask,2) OVER w AS qm FROM odraws WINDOW w AS (PARTITION BY series_id ORDER BY idx))"""


@query("shape_transition", TRANS_SQL)
def shape_transition(spark, sf):
    """17 transition features against the two previous draws of the series."""
    d = _lagged(spark, sf, ["numbers"], (1, 2))
    return d.select("round_no", FE.rounded(FE.transition_view(F.col("numbers"), F.col("numbers_1"), F.col("numbers_2"))).alias("transition"))


def _ctx_sql(w):
    """Straight relational form: explode the frame rows, count, and put the block back together."""
    return f"""ctx{w} AS (SELECT a.series_id, a.idx, b.idx AS j, b.numbers AS nb, b.mask AS mb, pb.mask AS pm, {_STD('b.numbers')}/44.0 AS disp
  FROM odraws a JOIN odraws b ON b.series_id=a.series_id AND b.idx BETWEEN a.idx-{w - 1} AND a.idx
  LEFT JOIN odraws pb ON pb.series_id=b.series_id AND pb.idx=b.idx-1 AND pb.idx >= a.idx-{w - 1}),
 cell{w} AS (SELECT series_id, idx, v, count(*) AS c FROM (SELECT series_id, idx, unnest(nb) AS v FROM ctx{w}) GROUP BY ALL),
 rows{w} AS (SELECT series_id, idx, count(*)::DOUBLE AS n, avg(bit_count(mb & pm)/6.0::DOUBLE) AS ov, avg(disp) AS md, arg_max(disp, j) AS dl, arg_min(disp, j) AS df,
   max(CASE WHEN j=idx-1 THEN disp END) AS d1, max(CASE WHEN j=idx-2 THEN disp END) AS d2 FROM ctx{w} GROUP BY 1,2),
 pairc{w} AS (SELECT series_id, idx, max(c) AS mc FROM (SELECT series_id, idx, x, y, count(*) AS c FROM (SELECT series_id, idx, unnest([{', '.join(f'nb[{i}]*100+nb[{j}]' for i, j in _PAIRS6)}]) AS xy FROM ctx{w}) t, LATERAL (SELECT t.xy//100 AS x, t.xy%100 AS y) GROUP BY ALL) GROUP BY 1,2),
 out{w} AS (SELECT r.series_id, r.idx, list_concat({', '.join('[' + ', '.join(f"sum(CASE WHEN {e} THEN c ELSE 0 END)::DOUBLE/(any_value(n)*6)" for e in es) + ']' for es in (
     [f"(v-1)//9={k}" for k in range(5)],))}, [any_value(mc)/any_value(n), coalesce(any_value(ov),0.0)], {', '.join('[' + ', '.join(f"sum(CASE WHEN {e} THEN c ELSE 0 END)::DOUBLE/(any_value(n)*6)" for e in es) + ']' for es in (
     [f"(v-1)//7={k}" for k in range(7)], [f"(v-1)%7={k}" for k in range(7)], [f"((v-1)*8)//45={k}" for k in range(8)]))},
   [-sum(c/(n*6)*ln(c/(n*6)))/ln(45), max(c)/any_value(n*6), any_value(md), any_value(dl-df)/greatest(1, any_value(n)-1),
    CASE WHEN any_value(n) >= 3 THEN any_value((dl-d1)-(d1-d2)) ELSE 0.0 END]) AS f
   FROM rows{w} r JOIN cell{w} USING (series_id, idx) JOIN pairc{w} USING (series_id, idx) GROUP BY 1,2)"""


@query("rolling_context", with_(ODRAWS, _ctx_sql(3), _ctx_sql(13)) + """SELECT round_no, list_transform(a.f, lambda v: floor(v*1e6+0.501)/1e6) AS w3,
 list_transform(b.f, lambda v: floor(v*1e6+0.501)/1e6) AS w13 FROM odraws JOIN out3 a USING (series_id, idx) JOIN out13 b USING (series_id, idx)""")
def rolling_context(spark, sf):
    """34 rolling features over the last 3 and the last 13 draws."""
    d = FE.context_views(ordered_draws(spark, sf), ["series_id"], "idx", (3, 13))
    return d.select("round_no", FE.rounded(F.col("w3")).alias("w3"), FE.rounded(F.col("w13")).alias("w13"))


@query("prefix_standardise", with_(DRAWS) + f"""SELECT o_orderkey AS round_no, {R('greatest(-8.0, least(8.0, (x-m)/CASE WHEN s < 1e-9 THEN 1.0 ELSE s END))')} AS z FROM (
 SELECT o_orderkey, o_totalprice AS x, avg(o_totalprice) OVER w AS m, stddev_pop(o_totalprice) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey//10 ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING))""")
def prefix_standardise(spark, sf):
    """z-score of each row by the mean and deviation of its own prefix."""
    o = table(spark, sf, "orders").select(F.floor(F.col("o_custkey") / 10).alias("series_id"), F.col("o_orderkey").alias("round_no"), F.col("o_totalprice").alias("x"))
    return FE.prefix_standardise(o, ["series_id"], ["round_no"], "x", "z").select("round_no", r6(F.col("z")).alias("z"))

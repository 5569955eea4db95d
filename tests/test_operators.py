import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialgrid.functions import exprs as X
from trialgrid.functions import quantdist as Q
from trialgrid.operators import dynamics as D
from trialgrid.operators import fields as FD
from trialgrid.operators import landscape as L
from trialgrid.operators import models as M
from trialgrid.operators import predictive as P
from trialgrid.operators import resample as RS
from trialgrid.operators import retrieval as RT
from trialgrid.operators import search as S


def test_rank_boundaries_and_round_trip(spark):
    df = spark.createDataFrame([(0,), (1,), (8145059,), (4000000,), (77,)], "r bigint")
    out = {x["r"]: x for x in df.select("r", X.set_at_rank(F.col("r")).alias("s")).withColumn("b", X.rank_of(F.col("s"))).collect()}
    assert out[0]["s"] == [1, 2, 3, 4, 5, 6] and out[8145059]["s"] == [40, 41, 42, 43, 44, 45]
    assert all(r == x["b"] for r, x in out.items())
    assert spark.range(1).select(X.circular_distance(F.lit(0), F.lit(8145059)).alias("d")).first()["d"] == 1


def masks(spark, n, seed, key):
    rng = random.Random(seed)
    rows = [(i, sum(1 << v for v in rng.sample(range(1, 46), 6))) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{key} bigint, mask bigint")


def mae(a, b):
    na, nb = ([i for i in range(46) if m >> i & 1] for m in (a, b))
    return sum(abs(x - y) for x, y in zip(na, nb)) / 6


def test_search_equals_brute_force(spark):
    cr, c = masks(spark, 400, 1, "seed")
    tr, t = masks(spark, 12, 2, "round_no")
    h = lambda a, b: bin(a & b).count("1")
    dist = {(r["target_mask"], r["hits"]): r["candidates"] for r in S.hit_distribution(c, t).collect()}
    for _, tm in tr:
        for k in range(7):
            assert dist[(tm, k)] == sum(h(m, tm) == k for _, m in cr)
    best = {}
    for r in S.best_candidates(c, t, 3).collect():
        best.setdefault(r["round_no"], []).append((r["rank"], r["seed"]))
    for rn, tm in tr:
        want = sorted(cr, key=lambda x: (-h(x[1], tm), mae(x[1], tm), x[0]))[:3]
        assert [s for _, s in sorted(best[rn])] == [s for s, _ in want]
    q = {(r["round_no"], r["seed"]) for r in S.qualifying(c, t, 2).select("round_no", "seed").collect()}
    assert q == {(rn, s) for rn, tm in tr for s, m in cr if h(m, tm) >= 2}


def test_target_without_any_shared_number_keeps_its_row(spark):
    c = spark.createDataFrame([(1, sum(1 << v for v in range(1, 7)))], "seed bigint, mask bigint")
    t = spark.createDataFrame([(9, sum(1 << v for v in range(40, 46)))], "round_no bigint, mask bigint")
    assert {r["hits"]: r["candidates"] for r in S.hit_distribution(c, t).collect()}[0] == 1
    assert [r["seed"] for r in S.best_candidates(c, t, 1).collect()] == [1]


def test_landscape_keeps_best_row_and_summary(spark):
    rows = spark.createDataFrame([(1, 42, 4, 1.0), (1, 42, 5, 0.5), (1, 99, 4, 2.0)], "round bigint, seed bigint, hits bigint, positional_mae double")
    assert sorted(tuple(r) for r in L.best_points(rows).collect()) == [(1, 42, 5, 0.5), (1, 99, 4, 2.0)]
    pts = spark.createDataFrame([(1, 100, 4, 1.0), (1, 200, 5, 0.5), (1, 300, 6, 0.0), (1, 900000, 4, 2.0)], "round bigint, seed bigint, hits bigint, positional_mae double")
    b = L.basin_summary(pts).first()
    assert (b["density_4_plus"], b["density_5_plus"], b["exact_6_count"], b["center"]) == (4e-6, 2e-6, 1, 300.0)


def test_basin_forecast_on_linear_centers(spark):
    cols = {f"scale_{r}": F.lit(1.0) * (100000 + 1000 * F.col("round")) for r in L.RADII}
    s = spark.range(40).withColumnRenamed("id", "round").withColumns({
        "weighted_center": 100000.0 + 1000 * F.col("round"), "width": F.lit(1000.0), "density_4_plus": F.lit(0.0), "density_5_plus": F.lit(0.0),
        "entropy": F.lit(0.5), "asymmetry": F.lit(0.0), **cols})
    out = RS.basin_forecast(s).filter("round = 39").first()
    # last center 139000, every move +1000
    assert out["delta_center"] == 140000 and out["state_center"] == 140000 and out["multi_scale_center"] == 140000


def test_neighbour_counts_and_nearest(spark):
    rng = random.Random(3)
    pts = [(r, s, rng.choice([4, 4, 6]), 1.0) for r in (1, 2) for s in rng.sample(range(0, 20000), 150)]
    df = spark.createDataFrame(pts, "round bigint, seed bigint, hits bigint, positional_mae double")
    for r in RS.neighbour_counts(df, (100, 1000)).collect():
        assert r["observed"] == sum(abs(s - r["seed"]) <= r["radius"] for rr, s, *_ in pts if rr == r["round"]) - 1
    q = spark.createDataFrame([(1, 5, 777.5), (2, 6, 19999.0)], "round bigint, qid int, c double")
    for r in L.nearest_points(df, q, ["round"], "seed", ["qid"], "c").collect():
        c = 777.5 if r["round"] == 1 else 19999.0
        assert r["distance"] == min(abs(s - c) for rr, s, *_ in pts if rr == r["round"])


def test_nearest_earlier_is_tile_invariant(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([("a", i, [rng.random(), rng.random()]) for i in range(60)], "k string, i bigint, v array<double>")
    get = lambda t: sorted((r["pos"], r["near"], r["rank"]) for r in L.nearest_earlier(df, ["k"], "i", "v", [], 3, gap=2, tile=t).collect())
    small = get(7)
    assert small == get(512) and all(n <= p - 2 for p, n, _ in small)


def test_recurrence_is_tile_invariant(spark):
    df = spark.createDataFrame([(1, i, 80, float(i * 73939 % 1000000)) for i in range(80)], "key bigint, idx bigint, n bigint, v double")
    a, b = (D.recurrence(df, "v", 50000.0, tile=t).first() for t in (9, 512))
    assert tuple(a) == tuple(b)


def test_spectral_paths_agree_and_find_period_four(spark):
    df = spark.createDataFrame([(1, i, 64, math.sin(math.pi * i / 2)) for i in range(64)], "key bigint, idx bigint, n bigint, v double")
    a, b = D.spectral_peak(df, "v").first(), D.spectral_peak(df, "v", limit=1).first()
    assert a["period"] == b["period"] == 4.0 and abs(a["peak_share"] - b["peak_share"]) < 1e-6


def test_long_spectra_equal_the_transform(spark):
    r = np.random.default_rng(7)
    made = {k: r.normal(size=n) + 0.3 * np.sin(np.arange(n) * 2 * math.pi * k / n) for k, n in enumerate((2, 3, 5, 64, 97, 1000, 1009, 4096), 1)} | {20: np.full(100, 2.5), 21: np.array([1.0])}
    df = spark.createDataFrame([(k, i, len(x), float(v)) for k, x in made.items() for i, v in enumerate(x)], "key bigint, idx bigint, n bigint, v double").repartition(7)
    whole = {x["key"]: x for x in D.spectral_peak(df, "v").collect()}
    for limit in (1, 50, 300):
        cut = {x["key"]: x for x in D.spectral_peak(df, "v", limit=limit).collect()}
        assert cut.keys() == whole.keys() == made.keys()
        for k, x in cut.items():
            assert (x["bin"], x["period"]) == (whole[k]["bin"], whole[k]["period"]) and abs(x["peak_share"] - whole[k]["peak_share"]) < 1e-9


def test_long_spectra_make_no_rows_by_frequency(spark):
    plan = D.spectral_peak(spark.range(5).selectExpr("id AS key", "id AS idx", "id AS n", "id AS v"), "v", limit=1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_phrases_equal_the_plain_search(spark):
    def plain(text):
        at = phrases = 0
        while at < len(text):
            size = 1
            while at + size <= len(text) and text.find(text[at:at + size], 0, at) >= 0:
                size += 1
            at, phrases = at + size, phrases + 1
        return phrases

    r = np.random.default_rng(8)
    made = {k: r.integers(0, 1 + k % 5, 1 + 13 * k) for k in range(40)} | {50: np.tile(r.integers(0, 4, 9), 30), 51: r.integers(0, 4, 200_000)}
    df = spark.createDataFrame([(k, i, int(v) * 250_000) for k, x in made.items() for i, v in enumerate(x)], "key bigint, idx bigint, v bigint")
    got = {x["key"]: x["phrases"] for x in D.phrase_counts(df, "v").collect()}
    assert got.keys() == made.keys()
    for k, x in made.items():
        if k < 51:
            assert got[k] == plain("".join(str(min(3, v)) for v in x)), k


def test_step_series_change_point(spark):
    df = spark.createDataFrame([(1, i, 60, 0.0 if i < 24 else 1.0) for i in range(60)], "key bigint, idx bigint, n bigint, v double")
    assert D.mean_change(df, "v").first()["split"] == 24


def test_phrase_counts_refuse_oversized_series(spark):
    df = spark.createDataFrame([(1, i, i * 250000 % 1000000) for i in range(30)], "key bigint, idx bigint, v bigint")
    assert D.phrase_counts(df, "v").first()["phrases"] > 0
    with pytest.raises(ValueError):
        D.phrase_counts(df, "v", limit=10)


def test_effect_sizes(spark):
    df = spark.createDataFrame([("l", 3.0), ("l", 4.0), ("r", 1.0), ("r", 2.0)], "g string, v double").withColumn("k", F.lit(1))
    assert RS.cliffs_delta(df, ["k"], "v", F.col("g") == "l").first()["cliffs_delta"] == 1.0
    assert RS.cliffs_delta(df, ["k"], "v", F.col("g") == "r").first()["cliffs_delta"] == -1.0


def test_distribution_expressions(spark):
    q = F.lit([0.1, 0.2, 0.3, 0.5, 0.6, 0.8, 0.9])
    r = spark.range(1).select(Q.unit_cdf(q, F.lit(0.5)).alias("a"), Q.unit_cdf(q, F.lit(0.0)).alias("z"), Q.unit_cdf(q, F.lit(1.0)).alias("o"),
                              Q.unit_cdf(q, F.lit(0.55)).alias("m"), Q.quantile_at(Q.unit_support(q), Q.UNIT_PROBS, F.lit(0.5)).alias("i")).first()
    assert (r["a"], r["z"], r["o"], r["i"]) == (0.5, 0.0, 1.0, 0.5) and abs(r["m"] - 0.625) < 1e-9


def test_running_max_and_softmax(spark):
    r = spark.range(1).select(Q.running_max(F.lit([0.1, 0.3, 0.2, 0.5])).alias("m"), X.softmax(F.lit([1.0, 1.0])).alias("s")).first()
    assert r["m"] == [0.1, 0.3, 0.3, 0.5] and r["s"] == [0.5, 0.5]


def test_concordance_against_pairs(spark):
    rng = random.Random(8)
    rows = [(1, float(rng.randrange(1, 12)), rng.random() < 0.6, rng.randrange(5) / 5) for _ in range(80)]
    got = P.concordance(spark.createDataFrame(rows, "k int, d double, e boolean, r double"), ["k"], "d", "e", "r").first()
    pairs = [(a, b) for a in rows for b in rows if a[2] and b[1] > a[1]]
    want = sum(1.0 if a[3] > b[3] else 0.5 if a[3] == b[3] else 0.0 for a, b in pairs) / len(pairs)
    # the operator counts later rows with a LOWER score as concordant with the event's higher risk
    assert abs(got["c_index"] - want) < 1e-12 and got["comparable_pairs"] == len(pairs)


def test_tied_utilities_rank_by_name(spark):
    df = spark.createDataFrame([(1, "z_", 0.5, 0.5), (1, "a_", 0.5, 0.5)], "p int, algorithm string, expected_utility double, realized_utility double")
    r = {x["algorithm"]: (x["predicted_rank"], x["realized_rank"]) for x in P.ranked(df, ["p"]).collect()}
    assert r == {"a_": (1, 1), "z_": (2, 2)}


def test_scenarios_are_44(spark):
    s = P.scenario_table(spark)
    assert s.count() == 44 and s.filter("is_nominal").count() == 4
    assert {r["multiplier"] for r in s.filter("NOT is_nominal").collect()} == {0.75, 1.25}


def naive_retrieve(x, t, views, ql, lengths, sep, k):
    import numpy as np
    from tests.test_kernels import naive_warp
    from trialgrid.functions.kernels import resample, slope_estimate
    if t < ql - 1 or t - sep < max(lengths) - 1:
        return []
    std = {}
    for v in views:
        m = np.array([r[v] for r in x[:t + 1]])
        sd = m.std(axis=0)
        std[v] = np.clip((m - m.mean(axis=0)) / np.where(sd < 1e-9, 1, sd), -8, 8)
    coarse = []
    for L_ in lengths:
        for e in range(L_ - 1, t - sep + 1):
            d = np.mean([np.sqrt(((std[v][t - ql + 1:t + 1] - resample(std[v][None, e - L_ + 1:e + 1], ql)[0]) ** 2).mean()) for v in views])
            coarse.append((round(d, 10), e, L_))
    fine = []
    for _, e, L_ in sorted(coarse)[:4 * k]:
        sims = []
        for v in views:
            a, b = std[v][t - ql + 1:t + 1], std[v][e - L_ + 1:e + 1]
            sims.append(math.exp(-(naive_warp(a, b) + naive_warp(slope_estimate(a[None])[0], slope_estimate(b[None])[0])) / 2))
        keep = max(1, math.ceil(len(sims) * 0.67))
        fine.append((-sum(sorted(sims, reverse=True)[:keep]) / keep, e, L_))
    out = []
    for s, e, L_ in sorted(fine):
        if all(abs(e - o[1]) > max(2, ql // 2) for o in out):
            out.append((s, e, L_))
        if len(out) == k:
            break
    return [(e, L_, round(-s, 6)) for s, e, L_ in out]


def test_retrieval_equals_brute_force_and_ignores_the_future(spark):
    rng = random.Random(11)
    x = [{"a": [rng.random(), rng.random()], "b": [rng.random()]} for _ in range(40)]
    frame = lambda n: spark.createDataFrame([(1, i, r["a"], r["b"]) for i, r in enumerate(x[:n])], "s bigint, idx bigint, a array<double>, b array<double>")
    def run(n, tile):
        got = {}
        for r in RT.retrieve(frame(n), ["s"], ["a", "b"], 4, (3, 4, 5), 6, 3, tile=tile).collect():
            got.setdefault(r["idx"], []).append((r["rank"], r["past_end"], r["window_length"], round(r["similarity"], 6)))
        return {t: [v[1:] for v in sorted(g)] for t, g in got.items()}
    whole, tiled, prefix = run(40, 256), run(40, 16), run(30, 16)
    assert whole == tiled
    for t in (10, 17, 29, 39):
        assert whole[t] == naive_retrieve(x, t, ["a", "b"], 4, (3, 4, 5), 6, 3)
    assert all(prefix[t] == whole[t] for t in prefix)


def test_copula_without_failures_has_zero_failure_correlation(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.random(), rng.random(), 0.1, False) for i in range(240)], "id int, q double, t double, p double, f boolean")
    fit = M.copula_fit(df, "q", "t", "p", "f", "id")
    c = fit["correlation"]
    assert fit["status"] == "unavailable_no_failure_events" and abs(c[0][2]) < 1e-9 and abs(c[1][2]) < 1e-9 and abs(c[0][0] - 1) < 1e-9


def test_key_axis_scores_match_direct_sums(spark):
    rng = random.Random(6)
    pts = spark.createDataFrame([(r, s, rng.choice([4, 5, 6]), rng.random()) for r in range(1, 37) for s in rng.sample(range(1000000), 25)],
                                "round bigint, seed bigint, hits bigint, positional_mae double")
    fields = L.build_fields(pts)
    top = FD.field_top_seeds(fields, 5).filter("model = 'persistence' AND round = 36").orderBy("rank").collect()
    cells = {(r["channel"], r["bin"]): r["mass"] for r in fields.filter("round = 35").collect()}
    keys = spark.createDataFrame([(t["seed"],) for t in top], "seed bigint").select("seed", L.channel_bins(F.col("seed")).alias("c")).collect()
    for t, k in zip(top, sorted(keys, key=lambda r: [x["seed"] for x in top].index(r["seed"]))):
        want = sum(cells.get((c["channel"], c["bin"]), 0.0) * c["size"] for c in k["c"]) / 12
        assert abs(t["score"] - want) < 1e-9
    best = max(t["score"] for t in top)
    allk = spark.range(0, 1000000, 997).select(F.col("id").alias("seed"), L.channel_bins(F.col("id")).alias("c")).collect()
    assert max(sum(cells.get((c["channel"], c["bin"]), 0.0) * c["size"] for c in r["c"]) / 12 for r in allk) <= best + 1e-9

import math

import numpy as np

from trialgrid.functions import kernels as K


def numbers(mask):
    return tuple(i for i in range(1, 46) if int(mask) >> i & 1)


def test_generator_golden_keys():
    got = K.generated_masks(np.array([20260812, 18995, 9844]))
    assert [numbers(m) for m in got] == [(2, 26, 27, 29, 40, 44), (6, 7, 14, 15, 39, 43), (6, 7, 8, 11, 39, 43)]


def test_published_hit_distribution_of_200000_keys():
    target = sum(1 << n for n in (6, 7, 11, 15, 39, 43))
    masks = K.generated_masks(np.arange(200_000))
    hits = np.array([bin(int(m) & target).count("1") for m in masks])
    assert np.bincount(hits, minlength=7).tolist() == [79967, 84777, 30428, 4511, 310, 7, 0]


def naive_warp(a, b):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1, j + 1] = np.linalg.norm(a[i] - b[j]) / math.sqrt(a.shape[1]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[-1, -1] / (len(a) + len(b))


def test_time_warp_against_naive():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(6, 5, 3)), rng.normal(size=(6, 4, 3))
    assert np.allclose(K.time_warp_distance(a, b), [naive_warp(x, y) for x, y in zip(a, b)])
    assert np.allclose(K.time_warp_distance(a, a), 0)


def test_resample_and_slope():
    x = np.arange(4.0).reshape(1, 4, 1)
    assert np.allclose(K.resample(x, 7)[0, :, 0], np.linspace(0, 3, 7))
    assert np.allclose(K.slope_estimate(x), 1.0)


def test_distribution_functions_closed_forms():
    assert np.allclose(K.normal_quantile(np.array([0.025, 0.5, 0.975])), [-1.959963984540054, 0, 1.959963984540054])
    assert np.allclose(K.beta_cdf(np.array([0.2, 0.7]), 1.0, 3.0), 1 - (1 - np.array([0.2, 0.7])) ** 3)
    assert np.allclose(K.beta_quantile(np.array([0.3]), 2.0, 1.0), math.sqrt(0.3))
    assert np.allclose(K.gamma_upper(np.array([1.0, 1.0]), np.array([0.5, 4.0])), np.exp([-0.5, -4.0]))
    rho = np.array([0.5, -0.3])
    assert np.allclose(K.bivariate_normal_cdf(np.zeros(2), np.zeros(2), rho), 0.25 + np.arcsin(rho) / (2 * math.pi))


def test_components():
    cells = lambda *c: sum(1 << x for x in c)
    assert K.occupied_components(np.array([cells(0, 1, 7), cells(0, 8, 16), cells(6, 7), 0])).tolist() == [1, 3, 2, 0]


def test_ranked_sets_equal_the_expression(spark):
    from pyspark.sql import functions as F

    from trialgrid.functions import exprs as X

    df = spark.createDataFrame([(0,), (X.TOTAL_SETS - 1,), (None,), (1_234_567,), (8_000_000,)], "rank bigint")
    rows = df.select("rank", K.ranked_set(F.col("rank")).alias("a"), X.set_at_rank(F.col("rank")).alias("b")).collect()
    assert all(r["a"] == (r["b"] if r["rank"] is not None else None) for r in rows) and {r["rank"]: r["a"] for r in rows}[0] == [1, 2, 3, 4, 5, 6]

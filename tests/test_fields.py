"""Field moves by transforms, forecasts from the past only, and key scores by structure, against direct computation."""

import random

import numpy as np
from pyspark.sql import functions as F

from trialgrid.operators import fields as FD
from trialgrid.operators import landscape as L


def test_moves_are_recovered():
    before = np.zeros(64)
    before[[1, 7, 18]] = [0.5, 0.3, 0.2]
    assert FD.best_shift(before, np.roll(before, 9)) == 9 and FD.best_mask(before, before[np.arange(64) ^ 13]) == 13
    rng = np.random.default_rng(1)
    for size in (64, 256, 257, 509):
        a, b = rng.random(size) * (rng.random(size) < 0.3), rng.random(size) * (rng.random(size) < 0.3)
        votes = [sum(a[i] * b[(i + m) % size] for i in range(size)) for m in range(size)]
        assert FD.best_shift(a, b) == int(np.round(votes, 12).argmax())
        if size in (64, 256):
            assert FD.best_mask(a, b) == int(np.round([a[np.arange(size) ^ m] @ b for m in range(size)], 12).argmax())
    assert FD.best_shift(np.zeros(64), before) == 0 and FD.best_mask(np.full(64, 1 / 64), before) == 0  # all equal: stay


def test_rough_scores_of_all_keys_are_the_exact_ones():
    rng = np.random.default_rng(2)
    axis, field = FD.KeyAxis(), rng.random(FD.CELLS)
    gains = axis.gains(field)
    key = np.unique(np.concatenate([rng.integers(0, L.KEY_SPACE, 20_000), [0, 1, L.KEY_SPACE - 1]]))
    assert np.abs(axis.scores(gains)[key] - axis.exact(gains, key)).max() < 1e-9
    best, score = axis.best(field, 7, 50)
    every = np.round(axis.scores(gains), 9)
    assert sorted(every)[-50:] == sorted(np.round(score, 9)) and len(set(best)) == 50
    level, _ = axis.best(np.ones(FD.CELLS), 7, 50)  # all keys equal: the hash decides
    assert (level == axis.best(None, 7, 50)[0]).all() and (level != axis.best(None, 8, 50)[0]).any()


def points(spark, rounds, seed=6):
    rng = random.Random(seed)
    return spark.createDataFrame([(r, s, rng.choice([4, 5, 6]), rng.random()) for r in rounds for s in rng.sample(range(L.KEY_SPACE), 25)], "round bigint, seed bigint, hits bigint, positional_mae double")


def test_forecasts_see_the_past_only_and_match_direct_ones(spark):
    p = points(spark, range(1, 45))
    read = lambda q: {r["idx"]: r for r in FD.forecasts(L.build_fields(q)).collect()}
    whole, early = read(p), read(p.where("round <= 36"))
    assert sorted(whole) == list(range(31, 44)) and whole[43]["round"] == 45
    assert all(np.allclose(np.frombuffer(early[i][m]), np.frombuffer(whole[i][m]), atol=1e-12) for i in range(31, 36) for m in FD.MODELS[:5])
    x = np.zeros((44, FD.CELLS))
    for r in L.build_fields(p).collect():
        x[r["round"] - 1, FD.STARTS[r["channel"]] + r["bin"]] = r["mass"]
    root = np.concatenate([np.full(s, np.sqrt(s)) for _, s in L.channel_sizes()])
    u = x * root / np.linalg.norm(x * root, axis=1, keepdims=True)
    for i in (31, 40, 43):
        w = 0.9 ** np.arange(15, -1, -1)
        d = np.round(1 - u[:i] @ u[i], 12)
        near = np.argsort(d, kind="stable")[:5]
        a = 1 / (d[near] + 0.01)
        want = {"persistence": x[i], "ewma": w @ x[i - 15:i + 1] / w.sum(), "analog": a @ x[near + 1] / a.sum()}
        want |= dict(zip(("shift", "xor"), FD.moved(x[i - 1], x[i])))
        for m, v in want.items():
            assert np.abs(np.frombuffer(whole[i][m]) - v).max() < 1e-12, (i, m)


def test_no_rounds(spark):
    empty = L.build_fields(points(spark, []))
    assert FD.field_top_seeds(empty, 5).count() == 0
    few = FD.field_top_seeds(L.build_fields(points(spark, range(3))), 5, min_history=2)
    assert few.where(F.col("model") == "analog").count() == 2 * 5

"""Table contracts: each rule on rows that keep and break it."""

import pytest
from pyspark.sql import functions as F

from trialgrid.operators import checks as C
from trialgrid.operators.models import feasible_triple


def test_rules_share_one_pass_and_null_fails(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, 2.0)], "k int, v double")
    got = {r["rule"]: (r["rows"], r["failed"], r["passed"]) for r in C.expect(df, {"range": F.col("v").between(0, 1), "key": F.col("k") > 0}).collect()}
    assert got == {"range": (3, 2, False), "key": (3, 0, True)}


def test_completeness(spark):
    want = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int")
    have = spark.createDataFrame([(1,), (2,), (2,), (9,)], "k int")
    assert C.completeness(have, want, ["k"]).first().asDict() == {"expected": 4, "found_once": 1, "missing": 2, "repeated": 1, "unexpected": 1, "complete": False}
    assert C.completeness(want, want, ["k"]).first()["complete"]


def test_leaks_identity_and_one_to_one(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, None, 1.0)], "k int, fail_flag string, y double")
    assert {r["name"]: (r["filled"], r["forbidden"]) for r in C.column_leaks(df, ["fail"], ["y"]).collect()} == {"k": (2, False), "fail_flag": (1, True), "y": (2, True)}
    runs = spark.createDataFrame([(1, "p"), (2, "q")], "k int, problem string")
    rows = spark.createDataFrame([(1, "p"), (2, "p"), (3, "p")], "k int, problem string")
    assert {r["k"]: r["identity_ok"] for r in C.identity_joined(rows, runs, "k", ["problem"]).collect()} == {1: True, 2: False, 3: False}
    assert C.one_to_one(runs, df, ["k"]).count() == 2
    for bad in (rows, runs.union(runs)):
        with pytest.raises(Exception, match="not one to one"):
            C.one_to_one(runs, bad, ["k"]).collect()


def test_steps_clusters_and_support(spark):
    df = spark.createDataFrame([(3, [1, 2, 20, 40])], "n int, a array<int>")
    r = df.select(C.checkpoint_steps(F.col("n"), [0.01, 0.5, 0.6, 1.0]).alias("s"), C.gap_clusters(F.col("a"), 13).alias("c")).first()
    assert (r["s"], r["c"]) == ([1, 2, 3], 3)
    rows = spark.createDataFrame([(0, "a"), (1, "a"), (1, "b"), (1, "b")], "fold int, g string")
    got = {x["fold"]: x.asDict() for x in C.fold_support(rows, "fold", "g").collect()}
    assert got[1] == {"fold": 1, "groups": 2, "rows": 3, "unseen_groups": 1, "training_rows": 1, "training_groups": 1, "supported": False}
    assert got[0]["supported"] and got[0]["training_rows"] == 3


def test_correlations_become_feasible():
    import numpy as np

    for a, b, c in ((0.1, 0.2, 0.3), (0.9, 0.9, -0.9), (0.95, -0.95, 0.95), (0, 0, 0)):
        x, y, z = feasible_triple(a, b, c)
        least = np.linalg.eigvalsh([[1, x, y], [x, 1, z], [y, z, 1]])[0]
        assert least >= 0.9e-6
        if np.linalg.eigvalsh([[1, a, b], [a, 1, c], [b, c, 1]])[0] > 1e-6:
            assert (x, y, z) == (a, b, c)

"""Tables that are published together or not at all, and the integrity check of predictions."""

import pytest
from pyspark.sql import functions as F

from trialgrid.operators import checks as C
from trialgrid.sources import published as PB


def test_all_tables_or_none(spark, tmp_path):
    path = str(tmp_path / "out")
    assert PB.latest(spark, path).count() == 0
    a, b = spark.range(10).withColumnRenamed("id", "x"), spark.range(3).withColumnRenamed("id", "y")
    got = PB.publish(spark, {"a": a, "b": b}, path, {"a": ["x"]}, {"a": 10})
    assert {r["name"]: r["rows"] for r in got.collect()} == {"a": 10, "b": 3}

    failing = b.select(F.raise_error(F.lit("task fails")).cast("bigint").alias("y"))
    with pytest.raises(Exception, match="task fails"):
        PB.publish(spark, {"a": a.limit(1), "b": failing}, path)
    with pytest.raises(ValueError, match="not published"):
        PB.publish(spark, {"a": a.limit(1), "b": b}, path, expected={"b": 4})
    # readers still see the first version, whole
    assert PB.read_published(spark, path, "a").count() == 10 and PB.read_published(spark, path, "b").count() == 3
    with pytest.raises(ValueError):
        PB.read_published(spark, path, "c")

    PB.publish(spark, {"a": a.limit(4), "c": b}, path)  # a later version replaces the earlier one
    assert PB.read_published(spark, path, "a").count() == 4 and {r["name"] for r in PB.latest(spark, path).collect()} == {"a", "c"}
    PB.publish(spark, {"a": a.limit(0)}, path)
    assert PB.read_published(spark, path, "a").count() == 0


def test_prediction_integrity(spark):
    schema = "key int, at long, history long, ranking array<int>, blind boolean, read boolean"
    good = [(1, 10, 9, [3, 1, 2, 2], False, True), (1, 11, 10, [1, 2, 3, 9], True, False)]
    check = lambda rows: C.prediction_integrity(spark.createDataFrame(rows, schema), ["key", "at"], "history", "at", "ranking", 3, 1, 5, F.col("read"), F.col("blind")).first().asDict()
    assert check(good) == {"targets": 2, "repeated_targets": 0, "bad_rankings": 0, "late_history": 0, "missing": 0, "blind_reads": 0, "status": "PASS"}
    bad = good + [(1, 10, 10, [1, 1, 2], True, True), (2, 5, None, None, False, False), (2, 6, 1, [1, 2, 6], False, False), (2, 7, 1, [1, 2], False, False)]
    assert check(bad) == {"targets": 6, "repeated_targets": 1, "bad_rankings": 4, "late_history": 2, "missing": 1, "blind_reads": 1, "status": "FAIL"}
    assert check([])["status"] == "PASS" and check([])["targets"] == 0

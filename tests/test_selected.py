"""Quantiles by selected blocks equal the ordered ones, with ties, null keys, hot keys and folds."""

import pytest
from pyspark.sql import functions as F

from trialgrid.operators import folds as FO
from trialgrid.operators import ordered as O

LEVELS = [0.0, 0.05, 0.5, 0.9, 1.0]


def rows(spark):
    n = F.col("id")
    key = F.when(n % 3 < 2, "hot").when(n % 3 == 2, F.when(n % 50 == 2, None).otherwise("b")).alias("k")
    value = F.when(n % 5 == 0, F.lit(0.25)).when(n % 97 == 1, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(10007)) / 10007.0).alias("v")
    lone = spark.createDataFrame([("one", 3, 2.5), ("two", 0, 1.0), ("two", 1, 4.0), ("empty", 1, None)], "k string, fold long, v double")
    return spark.range(20000).select(key, (n % 5).alias("fold"), value).unionByName(lone)


def table(df):
    return sorted(map(tuple, df.na.fill("null", ["k"]).collect()), key=repr)


@pytest.mark.parametrize("cuts", [64, 1 << 16])
def test_same_quantiles_as_the_ordered_way(spark, monkeypatch, cuts):
    monkeypatch.setattr(O, "CUTS", cuts)
    df = rows(spark)
    assert table(O.selected_quantiles(df, ["k"], "v", LEVELS)) == table(O.quantiles(df.na.fill("null", ["k"]), ["k"], "v", LEVELS))


def test_same_quantiles_of_the_other_folds(spark, monkeypatch):
    df = rows(spark)
    whole = FO.out_of_fold_quantiles(df.na.fill("null", ["k"]), ["k"], "fold", 5, "v", LEVELS)
    assert table(O.selected_quantiles(df, ["k"], "v", LEVELS, "q", "fold", 5).select(whole.columns)) == table(whole)


def test_no_keys_at_all(spark):
    df = rows(spark)
    assert O.selected_quantiles(df, [], "v", LEVELS).first()[0] == O.quantiles(df.withColumn("g", F.lit(0)), ["g"], "v", LEVELS).first()["q"]


def test_large_tables_are_not_copied_for_each_fold(spark, monkeypatch):
    monkeypatch.setattr(O, "WHOLE_BYTES", 0)
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumn("fold", F.col("l_partkey") % 5)
    plan = FO.out_of_fold_quantiles(df, ["l_returnflag"], "fold", 5, "l_extendedprice", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan


def test_passes_share_one_reading(spark):
    q = O.selected_quantiles(rows(spark), ["k"], "v", [0.5])
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") >= 3  # counts, cut points and wanted rows

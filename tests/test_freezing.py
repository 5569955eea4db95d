"""A choice is made on the earlier cohort alone and read by its version."""

from pyspark.sql import functions as F

from trialgrid.operators import freezing as FZ

ROWS = [("a", "early", "x", 1.0), ("a", "early", "x", 3.0), ("a", "early", "y", 2.0), ("a", "late", "x", 9.0), ("a", "late", "y", 1.0), ("b", "early", "y", 5.0), ("b", "early", "x", 4.0),
        ("b", "late", "y", 0.5), ("c", "late", "x", 1.0)]
SCHEMA = "key string, cohort string, config string, score double"


def test_choice_ties_and_freezing(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    chosen = {r["key"]: r for r in FZ.choose(df, ["key"], "config", "score", "cohort", "early").collect()}
    assert {k: r["config"] for k, r in chosen.items()} == {"a": "x", "b": "y"}  # equal means: by name
    assert FZ.choose(df, ["key"], "config", "score", "cohort", "early", ties=[F.col("rows").asc()]).where("key = 'a'").first()["config"] == "y"
    assert FZ.choose(df, ["key"], "config", "score", "cohort", "early", larger_is_better=False).where("key = 'b'").first()["config"] == "x"
    late = FZ.frozen(df, FZ.choose(df, ["key"], "config", "score", "cohort", "early"), ["key"], "config", "cohort", "late").collect()
    assert sorted((r["key"], r["config"], r["score"]) for r in late) == [("a", "x", 9.0), ("b", "y", 0.5)]  # c has no choice
    assert all(r["version"] == chosen[r["key"]]["version"] for r in late)


def test_later_rows_cannot_change_the_choice(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    moved = df.withColumn("score", F.when(F.col("cohort") == "late", 1e6).otherwise(F.col("score")))
    pick = lambda d: sorted(map(tuple, FZ.choose(d, ["key"], "config", "score", "cohort", "early").collect()))
    assert pick(df) == pick(moved) == pick(df.where("cohort = 'early'"))
    other = df.withColumn("score", F.when(F.col("cohort") == "early", F.col("score") + 1).otherwise(F.col("score")))
    assert {r[-1] for r in pick(other)}.isdisjoint({r[-1] for r in pick(df)})  # other evidence, other version
    assert FZ.choose(df.limit(0), ["key"], "config", "score", "cohort", "early").count() == 0

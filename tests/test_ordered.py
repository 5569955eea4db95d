"""Cut along (keys, order), the primitives must give exactly what plain windows over whole keys give."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialgrid.operators import ordered as O


def hot_frame(spark, n=600):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", float(i * 7 % n), rng.choice([None, rng.randrange(40) / 4]), i) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t double, v double, id int")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def over(order):
    return Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def test_position_equals_the_plain_window(spark):
    df = hot_frame(spark)
    w = Window.partitionBy("k")
    a = df.withColumn("p", F.row_number().over(w.orderBy("t")) - 1).withColumn("n", F.count("*").over(w))
    for blocks in (1, 3, 50):
        assert rows(a, "id", "p", "n") == rows(O.position(df, ["k"], ["t"], "p", total="n", blocks=blocks), "id", "p", "n")


def test_running_equals_the_plain_window(spark):
    df = hot_frame(spark)
    aggs = {"s": ("sum", F.col("v")), "c": ("count", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "l": ("last", F.col("v"))}
    w = over(["t"])
    a = df.select("id", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("c"), F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"),
                  F.last("v", ignorenulls=True).over(w).alias("l"))
    for blocks in (1, 40):
        assert rows(a, "id", *aggs) == rows(O.running(df, ["k"], ["t"], aggs, blocks=blocks), "id", *aggs)


def test_a_hot_key_in_a_narrow_range_is_cut(spark):
    cold = [(f"k{i % 400}", float(i)) for i in range(4000)]
    df = spark.createDataFrame(cold + [("hot", 1000 + i / 1e6) for i in range(3000)], "k string, t double")
    sizes = O.with_blocks(df, ["k", "t"], 64).groupBy("k", "_block").count()
    assert sizes.agg(F.max("count")).first()[0] < 600


def test_order_columns_of_any_type_and_null_keys(spark):
    rng = random.Random(8)
    data = [(rng.choice([None, "a", "a", "b"]), f"x{rng.randrange(10**6)}", i) for i in range(300)]
    df = spark.createDataFrame(data, "k string, s string, id int").withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id * 7 % 301)"))
    for order in (["s", "id"], ["ts"], ["s"]):
        plain = df.withColumn("p", F.row_number().over(Window.partitionBy("k").orderBy(*order)) - 1)
        assert rows(plain, "id", "p") == rows(O.position(df, ["k"], order, "p", blocks=30), "id", "p")


def test_tied_orders_share_a_block(spark):
    df = spark.createDataFrame([("a", i // 50, i) for i in range(300)], "k string, t int, id int")
    got = O.running(df, ["k"], ["t"], {"c": ("count", F.lit(1))}, blocks=20)
    by_t = {}
    for r in got.collect():
        by_t.setdefault(r["t"], []).append(r["c"])
    assert all(sorted(v) == list(range(50 * t + 1, 50 * t + 51)) for t, v in by_t.items())


def test_nothing_runs_before_the_action(spark):
    df = hot_frame(spark)
    tracker, group = spark.sparkContext.statusTracker(), "plan-only"
    spark.sparkContext.setJobGroup(group, group)
    out = O.islands(O.running(O.position(df, ["k"], ["t"], "p"), ["k"], ["p"], {"s": ("sum", F.col("v"))}), ["k"], "p", F.col("v") > 5)
    O.quantiles(out, ["k"], "v", [0.5])
    assert len(tracker.getJobIdsForGroup(group)) == 0
    spark.sparkContext.setJobGroup("", "")


def test_framed_equals_the_plain_window(spark):
    df = O.position(hot_frame(spark), ["k"], ["t"], "p")

    def build(d, k):
        w = Window.partitionBy(*k).orderBy("p")
        return d.withColumns({"a": F.lag("id", 3).over(w), "b": F.lead("id", 2).over(w), "m": F.max("id").over(w.rowsBetween(-3, 0))})

    assert rows(build(df, ["k"]), "id", "a", "b", "m") == rows(O.framed(df, ["k"], "p", 3, 2, build, size=10), "id", "a", "b", "m")


def test_quantiles_match_percentile(spark):
    df = hot_frame(spark).filter("v IS NOT NULL")
    want = {r["k"]: [round(x, 9) for x in r["q"]] for r in df.groupBy("k").agg(F.percentile("v", F.lit([0.1, 0.5, 0.9])).alias("q")).collect()}
    for blocks in (None, 1, 100):
        got = {r["k"]: [round(x, 9) for x in r["q"]] for r in O.quantiles(df, ["k"], "v", [0.1, 0.5, 0.9], blocks=blocks).collect()}
        assert got == want


def test_islands_and_partition_invariance(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate("xxyyyxz")], "k string, p bigint, l string")
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        for size in (100, 2):
            out = O.islands(df, ["k"], "p", F.col("l"), "g", size=size)
            assert [r["g"] for r in out.orderBy("p").collect()] == [1, 1, 2, 2, 2, 3, 4]
    spark.conf.set("spark.sql.shuffle.partitions", "8")

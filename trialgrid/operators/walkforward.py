"""Walk-forward evaluation of key-derivation strategies: every key uses strictly earlier draws only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.functions import exprs as X
from trialgrid.functions.kernels import generator_mask
from trialgrid.operators.ordered import framed, top_rows

STRATEGIES = ("round", "history-digest", "rolling-mix")


def evaluate_strategies(draws: DataFrame, keys: Sequence[str], pos: str, variants: int, window: int, minimum_history: int) -> DataFrame:
    """Best variant per (draw, strategy) by hits desc, error, key.

    Keys are hashes of the strategy, the round, the variant and (for the history strategies) a digest
    or a mix of number frequencies over the last ``window`` earlier draws.
    """
    def build(d, k):
        w = Window.partitionBy(*k).orderBy(pos).rowsBetween(-window, -1)
        return d.withColumn("_past", F.collect_list(F.struct("round_no", "numbers")).over(w))

    h = framed(draws, keys, pos, window, 0, build).filter(F.col(pos) >= minimum_history)
    flat = F.flatten(F.transform("_past", lambda s: s["numbers"]))
    freq = F.transform(F.lit(list(range(1, X.SET_MAX + 1))), lambda v: F.size(F.filter(flat, lambda n: n == v)))
    sums = F.transform("_past", lambda s: F.aggregate(s["numbers"], F.lit(0), lambda a, n: a + n))
    h = h.select(*keys, "round_no", "mask", F.inline(F.array(
        F.struct(F.lit("round").alias("strategy"), F.lit("").alias("state")),
        F.struct(F.lit("history-digest").alias("strategy"), F.sha2(F.to_json("_past"), 256).alias("state")),
        F.struct(F.lit("rolling-mix").alias("strategy"), F.sha2(F.to_json(F.struct(freq.alias("f"), sums.alias("s"))), 256).alias("state")))))
    v = h.withColumn("variant", F.explode(F.lit(list(range(variants)))))
    text = F.concat_ws(":", "strategy", F.col("round_no").cast("string"), "state", F.col("variant").cast("string"))
    v = v.withColumn("seed", F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint"))
    # the generator runs on plain columns behind a shuffle that also spreads the draws
    v = v.select(*keys, "round_no", "mask", "strategy", "variant", "seed").repartition(*keys, "round_no")
    v = v.withColumn("cand", generator_mask("seed"))
    a, b = X.numbers_of(F.col("cand")), X.numbers_of(F.col("mask"))
    v = v.withColumns({"hits": X.hits(F.col("cand"), F.col("mask")), "positional_mae": X.positional_mae(a, b), "signed_bias": X.signed_bias(a, b)})
    best = top_rows(v, [*keys, "round_no", "strategy"], [F.desc("hits"), F.asc("positional_mae"), F.asc("seed")], 1, "_r")
    return best.drop("_r").withColumn("set_distance", 12 - 2 * F.col("hits"))


def strategy_summary(rows: DataFrame) -> DataFrame:
    """Rounds, mean and best hits, hit distribution, error and bias per strategy."""
    return rows.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("rounds"), F.avg("hits").alias("mean_hits"), F.max("hits").alias("max_hits"),
        *[F.count_if(F.col("hits") == k).alias(f"hits_{k}") for k in range(7)],
        F.avg("positional_mae").alias("mean_mae"), F.avg("signed_bias").alias("mean_bias"))

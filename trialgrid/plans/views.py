"""Typed views of the given tables in the shapes the operators work on, for Spark and as SQL text.

Every view covers its whole source table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.functions import exprs as X
from trialgrid.functions.kernels import ranked_set
from trialgrid.operators.ordered import position

KEY_SPACE = 1_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def R(expr: str) -> str:
    """SQL counterpart of exprs.r6."""
    return f"(floor(({expr})*1e6+0.501)/1e6)"


def U(*parts: str) -> str:
    """SQL counterpart of exprs.hash_uniform."""
    text = "concat_ws(':'," + ",".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
    return f"(CAST('0x'||substr(md5({text}),1,13) AS BIGINT)/4503599627370496.0)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ------------------------------------------------------------------ draws: one 6-of-45 set per order

def draws(spark: SparkSession, sf: str) -> DataFrame:
    """(series_id, round_no, rank, numbers, mask): series = group of ten accounts, round = order key."""
    o = table(spark, sf, "orders").select(
        F.floor(F.col("o_custkey") / 10).cast("bigint").alias("series_id"),
        F.col("o_orderkey").cast("bigint").alias("round_no"))
    o = o.withColumn("rank", F.conv(F.substring(F.md5(F.col("round_no").cast("string")), 1, 12), 16, 10).cast("bigint") % X.TOTAL_SETS)
    o = o.withColumn("numbers", ranked_set(F.col("rank")))
    return o.withColumn("mask", X.mask_of(F.col("numbers")))


def _draws_sql() -> str:
    """Six greedy digit steps of the combinatorial number system."""
    sql = (f"SELECT o_custkey // 10 AS series_id, o_orderkey AS round_no, "
           f"CAST('0x'||substr(md5(o_orderkey::VARCHAR),1,12) AS BIGINT) % {X.TOTAL_SETS} AS rank FROM orders")
    sql = f"SELECT *, {X.TOTAL_SETS - 1} - rank AS d6 FROM ({sql})"
    for k in range(6, 0, -1):
        arr = "[" + ",".join(str(math.comb(c, k)) for c in range(45)) + "]"
        sql = f"SELECT *, len(list_filter({arr}, lambda b: b <= d{k})) - 1 AS c{k} FROM ({sql})"
        sql = f"SELECT *, d{k} - ({arr})[c{k}+1] AS d{k - 1} FROM ({sql})"
    nums = "[" + ",".join(f"CAST(45-c{k} AS INTEGER)" for k in range(6, 0, -1)) + "]"
    mask = " | ".join(f"(1::BIGINT << CAST(45-c{k} AS INTEGER))" for k in range(6, 0, -1))
    return f"draws AS MATERIALIZED (SELECT series_id, round_no, rank, {nums} AS numbers, {mask} AS mask FROM ({sql}))"


DRAWS = _draws_sql()


def ordered_draws(spark: SparkSession, sf: str) -> DataFrame:
    return position(draws(spark, sf), ["series_id"], ["round_no"], "idx", total="n")


ODRAWS = DRAWS + """,
odraws AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round_no)-1 AS idx,
  count(*) OVER (PARTITION BY series_id) AS n FROM draws)"""


# ------------------------------------------------------------------ landscape: sparse scored points on a key axis

def landscape_rows(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    q = F.col("l_quantity")
    return li.select(
        (F.col("l_orderkey") % 416 + 820).cast("bigint").alias("round"),
        ((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_suppkey") * 1299709
          + F.col("l_linenumber") * 15485863) % KEY_SPACE).cast("bigint").alias("seed"),
        F.when(q <= 45, 4).when(q <= 49, 5).otherwise(6).cast("bigint").alias("hits"),
        (F.col("l_discount") * 10).alias("positional_mae"))


LROWS = f"""lrows AS (SELECT l_orderkey % 416 + 820 AS round,
 (l_orderkey*7919 + l_partkey*104729 + l_suppkey*1299709 + l_linenumber*15485863) % {KEY_SPACE} AS seed,
 CAST(CASE WHEN l_quantity<=45 THEN 4 WHEN l_quantity<=49 THEN 5 ELSE 6 END AS BIGINT) AS hits,
 l_discount*10 AS positional_mae FROM lineitem)"""


def landscape(spark: SparkSession, sf: str) -> DataFrame:
    from trialgrid.operators.landscape import best_points
    return best_points(landscape_rows(spark, sf))


LANDSCAPE = LROWS + """,
land AS MATERIALIZED (SELECT round, seed, hits, positional_mae FROM (SELECT *, row_number() OVER
 (PARTITION BY round, seed ORDER BY hits DESC, positional_mae) AS rn FROM lrows) WHERE rn = 1)"""


# ------------------------------------------------------------------ runs and traces

def runs(spark: SparkSession, sf: str) -> DataFrame:
    """One run per (problem, replicate, algorithm); metrics use order-free aggregates."""
    li = table(spark, sf, "lineitem").groupBy(
        F.col("l_partkey").alias("problem_id"), F.col("l_suppkey").alias("seed"),
        F.when(F.col("l_linestatus") == "F", "baseline").otherwise("challenger").alias("algorithm"),
    ).agg(F.min("l_extendedprice").alias("price"), F.max("l_quantity").alias("qty"),
          F.max("l_discount").alias("disc"), F.min("l_returnflag").alias("flag"))
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("problem_id"), F.col("p_type").alias("problem_family"),
        F.when(F.substring("p_brand", 7, 3).cast("int") % 2 == 0, "sampling").otherwise("optimization").alias("domain"))
    reached = F.col("flag") != "R"
    failure = F.col("disc") >= 0.095
    return li.join(part, "problem_id").select(
        F.concat_ws("-", "problem_id", "seed", "algorithm").alias("run_id"),
        "problem_id", "problem_family", "domain", "algorithm", "seed",
        F.lit("evaluations").alias("budget_type"), F.lit(100.0).alias("budget"),
        (1.0 / (1.0 + F.col("price") / 10000)).alias("quality"),
        (F.col("qty") / 10).alias("runtime"),
        reached.alias("target_reached"),
        F.when(reached, F.col("qty") * 2).alias("passage"),
        failure.alias("failure"),
        F.when(failure, F.when(F.col("flag") == "A", "numeric").when(F.col("flag") == "N", "timeout")
               .otherwise("invalid")).alias("failure_type"))


RUNS = """runs AS MATERIALIZED (SELECT concat_ws('-', problem_id, seed, algorithm) AS run_id, problem_id,
 p_type AS problem_family,
 CASE WHEN CAST(substr(p_brand,7,3) AS INT) % 2 = 0 THEN 'sampling' ELSE 'optimization' END AS domain,
 algorithm, seed, 'evaluations' AS budget_type, 100.0::DOUBLE AS budget, 1.0::DOUBLE/(1.0::DOUBLE+price/10000) AS quality,
 qty/10 AS runtime, flag <> 'R' AS target_reached, CASE WHEN flag <> 'R' THEN qty*2 END AS passage,
 disc >= 0.095 AS failure, CASE WHEN disc >= 0.095 THEN CASE flag WHEN 'A' THEN 'numeric' WHEN 'N' THEN 'timeout'
 ELSE 'invalid' END END AS failure_type
 FROM (SELECT l_partkey AS problem_id, l_suppkey AS seed,
   CASE WHEN l_linestatus='F' THEN 'baseline' ELSE 'challenger' END AS algorithm,
   min(l_extendedprice) AS price, max(l_quantity) AS qty, max(l_discount) AS disc, min(l_returnflag) AS flag
   FROM lineitem GROUP BY 1,2,3) JOIN part ON p_partkey = problem_id)"""


def series(spark: SparkSession, sf: str) -> DataFrame:
    """(key, idx, n, value, ikey): one ordered numeric series per user."""
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("key"), "ts", "event_id", "event_type", "value",
        (F.col("event_id") * 73939 % KEY_SPACE).alias("ikey"))
    return position(e, ["key"], ["ts", "event_id"], "idx", total="n")


SERIES = f"""series AS MATERIALIZED (SELECT user_id AS key, ts, event_id, event_type, value,
 event_id*73939 % {KEY_SPACE} AS ikey, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS idx,
 count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


def traces(spark: SparkSession, sf: str) -> DataFrame:
    """(run_id, step, fraction, objective, ...): the events of a user as the trace of a run."""
    s = series(spark, sf)
    return s.select(
        F.col("key").alias("run_id"), (F.col("idx") + 1).alias("step"), F.col("n").alias("steps"),
        ((F.col("idx") + 1) / F.col("n")).alias("fraction"), F.col("value").alias("objective"),
        (F.col("event_type") == "error").cast("double").alias("failure_signal"))


TRACES = SERIES + """,
traces AS (SELECT key AS run_id, idx+1 AS step, n AS steps, (idx+1)/n AS fraction, value AS objective,
 CASE WHEN event_type='error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS failure_signal FROM series)"""


# ------------------------------------------------------------------ out-of-fold quantile predictions

LEVELS = [0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95]
FOLDS = 5


def folded_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs(spark, sf).withColumn("fold", F.col("problem_id") % FOLDS)


FRUNS = RUNS + f""",
fruns AS (SELECT *, problem_id % {FOLDS} AS fold FROM runs)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold quantiles of quality by family: the seven levels as ``q``, with the observed value."""
    from trialgrid.operators.folds import out_of_fold_quantiles
    r = folded_runs(spark, sf)
    q = out_of_fold_quantiles(r, ["problem_family"], "fold", FOLDS, "quality", LEVELS)
    return r.join(F.broadcast(q), ["problem_family", "fold"]).withColumnRenamed("quality", "observed")


PREDS = FRUNS + f""",
preds AS MATERIALIZED (SELECT r.* EXCLUDE (quality), r.quality AS observed, p.q FROM fruns r JOIN (
 SELECT a.problem_family, f.fold, quantile_cont(a.quality, {LEVELS}) AS q
 FROM fruns a, (SELECT unnest(range({FOLDS})) AS fold) f WHERE a.fold <> f.fold GROUP BY 1,2) p
 ON p.problem_family = r.problem_family AND p.fold = r.fold)"""


def binary(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    l = table(spark, sf, "labels")
    return l.join(d, "doc_id").select(
        F.col("doc_id").alias("id"), "lang", "source", (F.col("quality") == 1).alias("observed"),
        (1.0 / (1.0 + F.exp(-(F.col("n_chars") - 500) / 500))).alias("probability"))


BINARY = """bin AS MATERIALIZED (SELECT d.doc_id AS id, lang, source, quality = 1 AS observed,
 1.0::DOUBLE/(1.0::DOUBLE+exp(-(n_chars-500)/500)) AS probability FROM labels l JOIN documents d USING (doc_id))"""

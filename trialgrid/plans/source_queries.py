"""Source, sink and streaming queries over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trialgrid.functions import exprs as X
from trialgrid.functions.exprs import r6
from trialgrid.plans.registry import query
from trialgrid.plans.views import DRAWS, ODRAWS, R, RUNS, TRACES, draws, runs, table, traces, with_
from trialgrid.session import checkpoint_dir
from trialgrid.sources import readers as RD
from trialgrid.sources import sinks as SK
from trialgrid.streaming import runlog


@query("aliased_draws", with_(DRAWS) + "SELECT round_no, numbers, (rank % 45 + 1)::INTEGER AS bonus FROM draws WHERE round_no % 10 <> 0")
def aliased_draws(spark, sf):
    """Draw table under foreign headers, with blank rounds skipped."""
    d = draws(spark, sf)
    blank = F.when(F.col("round_no") % 10 == 0, "").otherwise(F.col("round_no").cast("string"))
    wide = d.select(blank.alias("Draw"), *[F.get("numbers", 5 - i).cast("string").alias(f"Num_{i + 1}") for i in range(6)],
                    (F.col("rank") % 45 + 1).cast("string").alias("BONUS"))
    return RD.aliased_draws(wide)


def _records(spark, sf):
    """Nested run records as JSON text, at most 1,000 trace points each (long runs give several records)."""
    t = traces(spark, sf).groupBy("run_id", F.floor(F.col("step") / 1000).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("step", "fraction", "objective"))).alias("traces"), F.min("objective").alias("best"), F.max("objective").alias("worst"))
    rec = F.struct(F.lit(RD.RUN_LOG_VERSION).alias("schema_version"), F.col("run_id").cast("string").alias("run_id"),
                   F.struct((F.col("run_id") % 7).alias("problem_id"), (F.col("run_id") * 31).alias("problem_seed"), F.concat(F.lit("family_"), (F.col("run_id") % 3).cast("string")).alias("problem_family")).alias("problem"),
                   F.struct((1 / (1 + F.col("best"))).alias("quality"), F.col("worst").alias("runtime")).alias("result"), "traces")
    return t.select(F.to_json(rec).alias("value"))


def _parsed(spark, sf):
    return RD.checked_log(_records(spark, sf).select(F.from_json("value", RD.RUN_LOG).alias("r")).select("r.*"))


@query("run_log_traces", with_(TRACES) + f"SELECT CAST(run_id AS VARCHAR) AS run_id, step, {R('fraction')} AS fraction, {R('objective')} AS objective FROM traces WHERE true")
def run_log_traces(spark, sf):
    """Trace table of nested JSON run records."""
    t = RD.log_tables(_parsed(spark, sf))["traces"]
    return t.select("run_id", "step", r6(F.col("fraction")).alias("fraction"), r6(F.col("objective")).alias("objective"))


@query("run_log_problems", "SELECT DISTINCT user_id % 7 AS problem_id FROM events")
def run_log_problems(spark, sf):
    """Distinct problems of the run log without the seed column."""
    return RD.log_tables(_parsed(spark, sf))["problem_features"].select("problem_id")


@query("nested_csv_rows", with_(DRAWS) + "SELECT round_no, '['||array_to_string(numbers, ',')||']' AS numbers FROM draws")
def nested_csv_rows(spark, sf):
    """Array columns as JSON text."""
    return SK.nested_as_json(draws(spark, sf).select("round_no", "numbers"))


@query("feature_bundle", with_(DRAWS) + f"SELECT round_no, numbers[1] AS number_1, numbers[6] AS number_6, {R('numbers[1]/45.0')} AS raw__number_1, list_contains(numbers, 1)::INT AS grid_mask__cell_1, list_contains(numbers, 45)::INT AS grid_mask__cell_45 FROM draws")
def feature_bundle(spark, sf):
    """Wide feature frame, a few of its columns."""
    from trialgrid.operators import features as FE
    d = draws(spark, sf).withColumn("raw", FE.raw_view(F.col("numbers")))
    names = [f"number_{i}" for i in range(1, 7)]
    b = SK.feature_bundle(d, {"raw": names})
    return b.select("round_no", "number_1", "number_6", r6(F.col("raw__number_1")).alias("raw__number_1"), "grid_mask__cell_1", "grid_mask__cell_45")


@query("rank_residues", with_(DRAWS) + "SELECT round_no, rank % 7 AS mod_7, rank % 45 AS mod_45, rank % 4096 AS mod_4096 FROM draws")
def rank_residues(spark, sf):
    return SK.rank_table(draws(spark, sf).select("round_no", "rank"), (7, 45, 4096)).drop("rank")


@query("written_partitions", "SELECT o_orderstatus, count(*)::BIGINT AS rows FROM orders GROUP BY 1")
def written_partitions(spark, sf):
    """Orders written as a partitioned table in the shared folder and read back."""
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    SK.write_table(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), path, ["o_orderstatus"], ["o_orderkey"])
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"))


@query("append_log_runs", "SELECT user_id, min(ts) AS ts FROM events GROUP BY 1")
def append_log_runs(spark, sf):
    """First record of each run id of the event log, taken once by a streaming job with restartable state."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stream = stream.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    planned = table(spark, sf, "events").select("user_id").distinct()
    runlog.ingest(stream, "user_id", "ts", f"{base}/out", f"{base}/state", planned)
    return runlog.read_log(spark, f"{base}/out")


@query("id_formats", with_(RUNS) + """SELECT run_id, substr(sha256('{"algorithm":"'||algorithm||'","problem_id":'||problem_id||',"seed":'||seed||'}'),1,24) AS run_key, run_id||':p'||lpad((seed%100)::VARCHAR,3,'0') AS feature_id, '["'||domain||'","'||problem_family||'"]' AS group_key FROM runs""")
def id_formats(spark, sf):
    """Content ids, padded feature ids and JSON group keys."""
    r = runs(spark, sf)
    return r.select("run_id", X.short_digest("algorithm", "problem_id", "seed").alias("run_key"),
                    F.concat("run_id", F.lit(":p"), F.lpad((F.col("seed") % 100).cast("string"), 3, "0")).alias("feature_id"),
                    F.to_json(F.array("domain", "problem_family")).alias("group_key"))

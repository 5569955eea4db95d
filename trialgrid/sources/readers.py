"""Table sources: aliased draw tables, landscape CSV, pruned Parquet, JSON-lines run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialgrid.operators.landscape import best_points, invalid_points

# fixed values: accepted header names of a draw table (compared without case, spaces and underscores)
ROUND_NAMES = ("회차", "round", "draw")
NUMBER_NAMES = ("번호{i}", "number{i}", "num{i}", "n{i}")
BONUS_NAMES = ("보너스", "bonus")

LANDSCAPE_SCHEMA = "round bigint, seed bigint, hits bigint, positional_mae double"

TRACE = T.StructType([
    T.StructField("step", T.LongType()), T.StructField("fraction", T.DoubleType()), T.StructField("objective", T.DoubleType())])
RUN_LOG = T.StructType([
    T.StructField("schema_version", T.StringType()), T.StructField("run_id", T.StringType()),
    T.StructField("problem", T.StructType([T.StructField("problem_id", T.LongType()), T.StructField("problem_seed", T.LongType()),
                                           T.StructField("problem_family", T.StringType())])),
    T.StructField("result", T.StructType([T.StructField("quality", T.DoubleType()), T.StructField("runtime", T.DoubleType())])),
    T.StructField("traces", T.ArrayType(TRACE))])
RUN_LOG_VERSION = "run-log-v1"


def _plain(name: str) -> str:
    return name.lower().replace(" ", "").replace("_", "")


def _find(columns: Sequence[str], names: Sequence[str], required: bool = True) -> str | None:
    table = {_plain(c): c for c in columns}
    for n in names:
        if _plain(n) in table:
            return table[_plain(n)]
    if required:
        raise ValueError(f"no column named any of {list(names)} in {list(columns)}")
    return None


def aliased_draws(raw: DataFrame, count: int = 6) -> DataFrame:
    """(round_no, numbers sorted, bonus) from a wide table with any accepted header; rows without a round are skipped."""
    cols = raw.columns
    rnd = F.col(f"`{_find(cols, ROUND_NAMES)}`")
    nums = [F.col(f"`{_find(cols, [n.format(i=i) for n in NUMBER_NAMES])}`").cast("int") for i in range(1, count + 1)]
    bonus = _find(cols, BONUS_NAMES, required=False)
    return raw.filter(rnd.isNotNull() & (F.trim(rnd.cast("string")) != "")).select(
        rnd.cast("bigint").alias("round_no"), F.array_sort(F.array(*nums)).alias("numbers"),
        (F.col(f"`{bonus}`").cast("int") if bonus else F.lit(None).cast("int")).alias("bonus"))


def read_draws(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return aliased_draws(reader.format(fmt).load(path))


def read_landscape(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Union of CSV files, checked and reduced to the best row per (round, key)."""
    rows = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).schema(LANDSCAPE_SCHEMA).csv(list(paths))
    if not invalid_points(rows).isEmpty():
        raise ValueError("landscape rows outside hits 4..6 or the key space")
    return best_points(rows)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet with optional pruning (only the named columns are read)."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def checked_log(records: DataFrame) -> DataFrame:
    """Run-log records; a foreign schema version fails the read when the rows are evaluated."""
    ok = F.col("schema_version") == RUN_LOG_VERSION
    version = F.when(ok, F.col("schema_version")).otherwise(
        F.raise_error(F.concat(F.lit("unsupported run log version "), F.coalesce("schema_version", F.lit("null")))))
    return records.withColumn("schema_version", version)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line with nested result and traces; blank lines are skipped by the reader."""
    return checked_log(spark.read.schema(RUN_LOG).option("mode", "FAILFAST").json(path))


def log_tables(records: DataFrame) -> dict[str, DataFrame]:
    """problems, runs, traces and problem features of nested run records."""
    def least(rows: DataFrame) -> DataFrame:
        """One row a problem: the least of its rows, whatever the order of the files."""
        rest = [c for c in rows.columns if c != "problem_id"]
        return rows.groupBy("problem_id").agg(F.min(F.struct(*rest)).alias("_r")).select("problem_id", "_r.*").select(*rows.columns)

    return {
        "problems": least(records.select("problem.*")),
        "runs": records.select("run_id", "problem.problem_id", "result.*"),
        "traces": records.select("run_id", F.inline("traces")),
        "problem_features": least(records.select("problem.*").drop("problem_seed")),
    }

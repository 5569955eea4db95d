"""Append-log ingestion: each run id is taken once, however late or often it comes; restarts skip what is there."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def known_only(records: DataFrame, planned: DataFrame, run_id: str) -> DataFrame:
    """Records of planned runs; an unknown id is an error when its row is evaluated."""
    p = planned.select(F.col(run_id), F.lit(True).alias("_known")).distinct()
    j = records.join(p, run_id, "left")
    checked = F.when(F.col("_known"), F.col(run_id)).otherwise(F.raise_error(F.concat(F.lit("unknown run "), F.col(run_id).cast("string"))))
    return j.withColumn(run_id, checked).drop("_known")


def first_records(records: DataFrame, run_id: str, event_time: str) -> DataFrame:
    """Earliest record of each run id; ties go to the least record, so a repeated batch gives the same rows."""
    rest = [c for c in records.columns if c != run_id]
    least = records.groupBy(run_id).agg(F.min(F.struct(event_time, *[c for c in rest if c != event_time])).alias("_r"))
    return least.select(run_id, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*records.columns)


def read_log(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).drop("batch")


def ingest(stream: DataFrame, run_id: str, event_time: str, out: str, checkpoint: str, planned: DataFrame | None = None) -> None:
    """Drain what is available into a Parquet log, one folder a batch.

    A batch is reduced to one record an id and joined against the ids that earlier batches have written. It replaces its
    own folder, so a batch that is run again after a failure leaves the same rows.
    """
    def add(batch: DataFrame, number: int) -> None:
        rows = first_records(batch if planned is None else known_only(batch, planned, run_id), run_id, event_time)
        try:
            seen = batch.sparkSession.read.parquet(out).where(F.col("batch") < number).select(run_id)
            rows = rows.join(seen, run_id, "left_anti")
        except AnalysisException as missing:  # nothing written yet
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

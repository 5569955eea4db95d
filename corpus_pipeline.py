"""The corpus pipeline: each stage works on all that its predecessor kept, and its decisions take effect.

Toxic texts go, exact copies go, one text of each group of near copies (five-word shingles, similarity of 0.8 or more)
stays, secrets are replaced in the texts, and what remains is packed into token sequences. All stages but the last return
the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialgrid.llm.common import read, written
from trialgrid.llm.exact_dedup import drop_copies
from trialgrid.llm.near_dedup import drop_near_copies
from trialgrid.llm.packing import pack_documents
from trialgrid.llm.secret_scan import without_secrets
from trialgrid.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("secret scan", secrets), ("best-fit packing", packing)]

#: A trained model decides in the first stage, which SQL can't express; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

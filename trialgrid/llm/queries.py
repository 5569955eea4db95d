"""The registered queries of this subpackage, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trialgrid.llm import (bloom_lm, exact_dedup, lexical_search, mixing, near_dedup, packing, page_text, piece_codec, quality_rules, secret_scan,
                           suffix_dedup, toxicity, whitening)
from trialgrid.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query("op3_exact_dedup", exact_dedup.ORACLE)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, folder, "documents")).drop("n_chunks")


@query("op7_secret_scan", secret_scan.ORACLE)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(read(spark, folder, "documents"))[0])


@query("op8_quality_rules", quality_rules.ORACLE)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality(read(spark, folder, "documents"))


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.verdicts(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read(spark, folder, "documents"))


@query("op10_minhash_near_dedup", near_dedup.ORACLE)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_groups(read(spark, folder, "documents"))


@query("op4_bloom_lm_scores")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return bloom_lm.scores(read(spark, folder, "documents"))


@query("op9_page_text", page_text.ORACLE)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return page_text.extract(read(spark, folder, "pages"))


@query("op1_suffix_array_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.covered(read(spark, folder, "documents")).drop("spans")


@query("op5_sentencepiece_codec")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back (the space mark itself reads as a space)."""
    docs = read(spark, folder, "documents")
    return piece_codec.round_trip(docs)


@query("op11_source_mix", mixing.ORACLE)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(*mixing.mix(read(spark, folder, "documents")))


@query("op12_embedding_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read(spark, folder, "embeddings"))


@query("op13_lexical_search", lexical_search.ORACLE)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))

"""Exact duplicates by content-defined chunk recipes, with DataFrame functions only.

A text becomes a list of chunks whose ends depend on nearby content, and the list of chunk identifiers is its recipe.
Every distinct chunk travels once, to be held against the chunks with the same identifier; an identifier that stands
for one chunk is verified, the others are split. Texts are then equal when their recipes are, so grouping moves eight
bytes a chunk instead of the text.

Nulls count as empty texts, and all empty texts are equal. Rows with a null id keep their group's largest id and stay
only if no row of the group has an id. Rows repeated under one id count one by one and are marked alike. Other columns
of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.common import ascii_lower, whole_text, written

#: A chunk ends at the first of these after `least` characters, or after `most` at the latest.
CHUNK_END = r"[.!?;\n]"


def chunks(text: Column, least: int = 96, most: int = 2048) -> Column:
    """The pieces of a text in order; joined they give it back."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most}}}?(?:{CHUNK_END}|\z)|(?s).{{1,{most}}}"), F.lit(0))


def chunk_id(chunk: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(chunk), 64 - bits) if bits < 64 else F.xxhash64(chunk)


def ambiguous(pieces: DataFrame, bits: int) -> DataFrame:
    """(id, chunk, nth) of identifiers that stand for several chunks; with 64 bits nearly always none."""
    found = pieces.select(chunk_id(F.col("chunk"), bits).alias("id"), "chunk").distinct()
    shared = found.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    rows = written(found.join(shared, "id"), "shared")
    lower = rows.select(F.col("id").alias("same"), F.col("chunk").alias("less"))
    return (rows.join(lower, (F.col("id") == F.col("same")) & (F.col("less") < F.col("chunk")), "left")
            .groupBy("id", "chunk").agg(F.count("less").alias("nth")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """One row per row of `docs`: its id, keep_id, group_size, kept, text_sha256 and n_chunks."""
    text = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(whole_text(text_col)).alias("body"))
    recipes = written(text.select("doc_id", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"),
                                  F.transform(chunks(F.col("body")), lambda c: chunk_id(c, bits)).alias("recipe")), "recipes")
    pieces = text.select(F.explode(chunks(F.col("body"))).alias("chunk"))
    split = written(ambiguous(pieces, bits), "ambiguous")
    if not split.isEmpty():
        recipes = with_split(text, recipes, split, bits)
    else:
        recipes = recipes.withColumn("amend", F.array().cast("array<struct<pos:int,nth:bigint>>"))
    groups = recipes.groupBy("recipe", "amend").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = written(groups, "groups")  # read again, so that a hot group's rows can be split among tasks
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return recipes.join(groups, ["recipe", "amend"], "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"))


def with_split(text: DataFrame, recipes: DataFrame, split: DataFrame, bits: int) -> DataFrame:
    """Recipes whose ambiguous identifiers carry the number of the chunk they mean."""
    rows = text.select("doc_id", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"), F.posexplode(chunks(F.col("body"))).alias("pos", "chunk"))
    nth = (rows.withColumn("id", chunk_id(F.col("chunk"), bits)).join(split, ["id", "chunk"])
           .groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_set(F.struct("pos", "nth"))).alias("amend")))
    nth = nth.select(F.col("doc_id").alias("amended"), F.col("text_sha256").alias("sha"), "amend")
    return (recipes.join(nth, F.col("doc_id").eqNullSafe(F.col("amended")) & (F.col("text_sha256") == F.col("sha")), "left")
            .withColumn("amend", F.coalesce("amend", F.array().cast("array<struct<pos:int,nth:bigint>>"))).drop("amended", "sha"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all columns; of rows repeated under one id all stay."""
    gone = exact_groups(docs, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("_gone")), "left_anti")


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""

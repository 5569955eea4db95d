"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order (an md5 of seed, id and text), served again from the start up to
`repeats` times. A document's virtual finish time is the running size of its source, itself included, over the source's weight.
Served until the budget (all sizes together) is spent, every queue has got weight x time words, or all it has; that time gives the
targets. The documents in service by then are put in one global order of finish time by a range sort, each gets its place (the
words before it), and what lies beyond the budget is cut: the mix has exactly as many words as the input. At most the last document
of a source, and the last ones of all, are taken in part.

Nothing is bound to one task: a source is cut into blocks of the shuffle hash, block sums give each block its start, and both the
sources and the mix are range-sorted. Sums are exact; the order depends on ids and texts only, so reruns agree.

A null text has size 0. Documents of size 0 are taken 0 times and are not in the mix. A null source is one source, the last. Null ids
are ids like others; repeated rows are different documents. Empty tables give empty results. Only the id, source and text columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.llm.common import WORD, whole_text, written

BLOCKS_A_TASK = 4


def tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_order(df: DataFrame, order: Sequence[str], sums: dict[str, str], name: str) -> DataFrame:
    """`df` range-sorted by unique `order`, with new columns: the sum of a column over all rows before."""
    cut = written(df.repartitionByRange(tasks(df), *order).withColumn("__part", F.spark_partition_id()), name)
    parts = cut.groupBy("__part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])  # a row for each task
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("__part"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    out = out.join(F.broadcast(starts), "__part").withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums})
    return out.drop("__part", *[f"__{n}" for n in sums])


def shuffle_hash(seed: int, doc: Column, text: Column) -> Column:
    """60 bits of an md5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc.cast("string"), F.lit("")), text).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def targets(rows: DataFrame, weights: Sequence[int], repeats: int) -> tuple[DataFrame, int]:
    """(key, source_size, weight, target) of each source, and the budget."""
    found = rows.groupBy("key").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    place = F.pmod(F.col("at"), F.lit(len(weights))).cast("int") + 1
    found = in_order(found, ["key"], {"at": "one"}, "sources").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place).cast("bigint"))
    found = found.select("key", "source_size", "weight", (F.col("source_size") * repeats).alias("most"), (F.col("source_size") * repeats / F.col("weight")).alias("ends"))
    total = found.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    budget, weight = int(total["words"] or 0), int(total["weight"] or 0)
    # a queue ends before the budget is spent if it would at the pace that is left when all shorter ones have ended
    found = in_order(found, ["ends", "key"], {"most_before": "most", "weight_before": "weight"}, "ends")
    full = F.col("most") * (F.lit(float(weight)) - F.col("weight_before")) <= F.col("weight") * (F.lit(float(budget)) - F.col("most_before"))
    found = written(found.withColumn("full", full), "full")
    ended = found.where("full").agg(F.sum("most").alias("words"), F.sum("weight").alias("weight")).first()
    words, paces = budget - int(ended["words"] or 0), weight - int(ended["weight"] or 0)
    time = words / paces if paces else 0.0
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight") * F.lit(time))
    return found.select("key", "source_size", "weight", target.alias("target")), budget


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), repeats: int = 3, seed: int = 11, id_col: str = "doc_id", source_col: str = "source",
        text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The mix, and all documents with their sizes and targets.

    Mix: doc_id, source, epoch (0 is the first time), finish, place, words, and `key` and `until` (running size), which name the document.
    """
    # source by code point, null last: 's...' < 't'
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("t"))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("bigint").alias("size"),
                       shuffle_hash(seed, F.col(id_col), whole_text(text_col)).alias("h"))
    rows = written(rows, "sizes")
    bits = min(30, (BLOCKS_A_TASK * tasks(docs) - 1).bit_length())
    rows = rows.withColumn("block", F.shiftright("h", 60 - bits))
    sources, budget = targets(rows, weights, repeats)
    blocks = rows.groupBy("key", "block").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # 2^bits rows at most
    blocks = blocks.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words").join(sources, "key")
    inside = Window.partitionBy("key", "block").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("inside", F.sum("size").over(inside)).join(blocks, ["key", "block"])
    quota = F.ceil("target")
    begins = lambda epoch: epoch * F.col("source_size") + F.col("until") - F.col("size")
    epochs = F.filter(F.array(*[F.lit(e).cast("bigint") for e in range(repeats)]), lambda e: (F.col("size") > 0) & (begins(e) < quota))
    placed = placed.withColumn("until", F.col("start") + F.col("inside")).withColumn("epochs", epochs)
    placed = written(placed.drop("block", "h", "start", "inside"), "placed")

    served = placed.withColumn("epoch", F.explode("epochs")).withColumn("words", F.least("size", quota - begins(F.col("epoch"))))
    served = served.withColumn("finish", (begins(F.col("epoch")) + F.col("size")) / F.col("weight"))
    served = in_order(served.select("doc_id", "key", "until", "size", "source_size", "target", "epoch", "finish", "words"), ["finish", "key"], {"place": "words"}, "mix")
    left = F.greatest(F.lit(0).cast("bigint"), F.least("words", F.lit(budget).cast("bigint") - F.col("place")))
    source = F.when(F.col("key") != "t", F.expr("substring(key, 2)")).alias("source")
    mixed = served.withColumn("words", left).where("words > 0").select("doc_id", source, "epoch", "finish", "place", "words", "key", "until")
    return mixed, placed


def taken(mixed: DataFrame, placed: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    columns = ["doc_id", "size", "source_size", "target"]
    idle = F.size("epochs") == 0
    some = placed.where(~idle).select("key", "until", *columns, F.lit(0).cast("bigint").alias("words"))
    more = mixed.select("key", "until", *[F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in columns], "words")
    # (key, until) is unique among documents with words
    sums = some.unionByName(more).groupBy("key", "until").agg(*[F.max(c).alias(c) for c in columns], F.sum("words").alias("taken"))
    return sums.select(*columns, "taken").unionByName(placed.where(idle).select(*columns, F.lit(0).cast("bigint").alias("taken")))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce('s' || source, 't') AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(concat_ws(':', '11', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT key, sum(size)::BIGINT AS s, [5, 2, 1][((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY key),
o AS (SELECT *, coalesce(sum(3 * s) OVER o, 0) AS mb, coalesce(sum(w) OVER o, 0) AS wb, sum(s) OVER () AS b, sum(w) OVER () AS tw FROM s
  WINDOW o AS (ORDER BY (3 * s)::DOUBLE / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, 3 * s * (tw::DOUBLE - wb) <= w * (b::DOUBLE - mb) AS ended FROM o),
v AS (SELECT (any_value(b) - coalesce(sum(3 * s) FILTER (ended), 0))::DOUBLE / nullif(any_value(tw) - coalesce(sum(w) FILTER (ended), 0), 0)::DOUBLE AS v, any_value(b) AS b FROM f),
t AS (SELECT key, s, w, CASE WHEN ended THEN (3 * s)::DOUBLE ELSE w * v END AS target, v.b FROM f, v),
c AS (SELECT d.*, t.* EXCLUDE (key), row_number() OVER () AS r, sum(size) OVER (PARTITION BY d.key ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS until FROM d JOIN t USING (key)),
m AS (SELECT r, key, b, (e * s + until)::DOUBLE / w AS finish, least(size, ceil(target)::BIGINT - (e * s + until - size)) AS words FROM c, (SELECT unnest([0, 1, 2]) AS e)
  WHERE size > 0 AND e * s + until - size < ceil(target)),
p AS (SELECT r, greatest(0, least(words, b - coalesce(sum(words) OVER (ORDER BY finish, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS words FROM m),
g AS (SELECT r, sum(words) AS words FROM p GROUP BY r)
SELECT doc_id, size, s AS source_size, target, coalesce(g.words, 0)::BIGINT AS taken FROM c LEFT JOIN g USING (r)
"""

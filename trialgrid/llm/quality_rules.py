"""Quality rules: word counts and repetition inside a text, and lines that many texts of a host share; DataFrame functions only.

Lines are normalised (lower case, runs of digits and white space to one space, trimmed) and hashed; for each host the
documents that hold a line are counted. Lines in more than 20 documents of a host are removed; for hosts below 100 documents
the limit is a fifth of them, but not below 10. Copies are documents like others: what a host repeats that often goes,
and a text that loses too large a share of its words is rejected. A null text counts as empty, a null host as a host of
its own. Rows are told apart by id, host and content; repeated rows get the same verdict, that of one row. Only the id, text and host columns
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.common import WORD, whole_text, words, written

SYMBOLS = r"[^#*$%&|<>]"


def n_repeat_words(tokens: Column, width: int = 3) -> Column:
    """Words inside windows of `width` words that occur at least twice in the text."""
    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (width - 1), F.lit(0))),
                           lambda x, i: F.struct(F.xxhash64(x, *[F.get(w, i + k) for k in range(1, width)]).alias("h"), i.alias("i")))

    def repeated(s: Column) -> Column:
        return F.transform(F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])), lambda x: x["i"])

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(width)), F.lit(width))), F.lit(0), lambda a, b: a + b)

    once = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731  computes `value` once
    return once(tokens, lambda w: once(F.array_sort(windows(w)), lambda s: once(F.array_sort(repeated(s)), covered)))


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: doc_id, host, content, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    body, tokens = F.col("body"), F.col("tokens")
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(host_col).alias("host"), whole_text(text_col).alias("body")).withColumn("tokens", words(body))
    rows = rows.select(
        "doc_id", "host", F.size(tokens).cast("bigint").alias("n_words"), F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(body, SYMBOLS + "+", "")).cast("bigint").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("bigint").alias("n_dup_lines"),
        n_repeat_words(tokens).cast("bigint").alias("n_repeat_words"), F.xxhash64(body).alias("content"))
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[\x09-\x0D\x200-9]+", " "))


def host_lines(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row per row and line: its place, the hash of its normalised form and its words."""
    body = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col), F.lit("")).alias("host"), F.xxhash64(body).alias("content"),
                       F.posexplode(F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))).alias("place", "line"))
    return rows.select("doc_id", "host", "content", "place", F.xxhash64(normal_line(F.col("line"))).alias("line"), F.size(words(F.col("line"))).alias("line_words"))


def frequent_lines(lines: DataFrame, most: int, share: float, least: int) -> DataFrame:
    """(host, line) held by more documents of the host than its limit: `most`, or for small hosts their share, `least` at least."""
    held = lines.select("host", "line", "doc_id").distinct().groupBy("host", "line").agg(F.count("*").alias("held")).where(F.col("held") > least)
    hosts = lines.select("host", "doc_id").distinct().groupBy("host").agg(F.count("*").alias("documents"))
    limit = F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), share * F.col("documents")))
    return held.join(hosts, "host").where(F.col("held") > limit).select("host", "line")


def line_verdicts(docs: DataFrame, most: int = 20, share: float = 0.2, least: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  host_col: str = "source") -> DataFrame:
    """Rows that lose words: doc_id, host, content, removed (words of one row), lines (hashes of what goes)."""
    lines = host_lines(docs, id_col, text_col, host_col)
    often = written(frequent_lines(lines, most, share, least), "frequent-lines")
    once = F.size(F.collect_set("place")) / F.count("*")  # a repeated row brings every place again
    return (lines.join(often, ["host", "line"]).groupBy("doc_id", "host", "content")
            .agg(F.round(F.sum("line_words") * once).cast("bigint").alias("removed"), F.collect_set("line").alias("lines")))


def quality(docs: DataFrame, most: int = 20, share: float = 0.2, least: int = 10, remain: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
            host_col: str = "source") -> DataFrame:
    """Base counts and the verdict of every row; a text is depleted if less than `remain` of its words stay."""
    lost = line_verdicts(docs, most, share, least, id_col, text_col, host_col).select(F.col("doc_id").alias("id"), F.col("host").alias("h"), F.col("content").alias("c"), "removed")
    rows = base_counts(docs, id_col, text_col, host_col)
    rows = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("host") == F.col("h")) & (F.col("content") == F.col("c")), "left")
    removed = F.coalesce("removed", F.lit(0))
    depleted = F.col("n_words") - removed < remain * F.col("n_words")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       (~F.col("base_failed") & ~depleted).alias("kept"), removed.cast("bigint").alias("n_removed_words"))


def cleaned(docs: DataFrame, most: int = 20, share: float = 0.2, least: int = 10, remain: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
            host_col: str = "source") -> DataFrame:
    """The kept rows with all columns, their texts without the frequent lines."""
    lost = line_verdicts(docs, most, share, least, id_col, text_col, host_col).select(F.col("doc_id").alias("__id"), F.col("host").alias("__host"), F.col("content").alias("__content"), "lines")
    verdict = quality(docs, most, share, least, remain, id_col, text_col, host_col).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    rows = docs.withColumn("__body", whole_text(text_col))
    rows = rows.join(lost.withColumnRenamed("lines", "__lines"), F.col(id_col).eqNullSafe(F.col("__id")) & (whole_text(host_col) == F.col("__host")) & (F.xxhash64("__body") == F.col("__content")), "left")
    stay = F.array_join(F.filter(F.split("__body", "\n", -1), lambda x: ~F.array_contains("__lines", F.xxhash64(normal_line(x)))), "\n")
    rows = rows.withColumn(text_col, F.when(F.col("__lines").isNull(), F.col(text_col)).otherwise(stay))
    return rows.join(verdict, F.col(id_col).eqNullSafe(F.col("__kept")), "left_semi").select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
p AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS i FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, host, body, line, trim(regexp_replace(lower(line), '[\x09-\x0D\x200-9]+', ' ', 'g')) AS norm, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS lw
  FROM (SELECT doc_id, host, body, unnest(string_split(body, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY doc_id),
h AS (SELECT host, count(DISTINCT doc_id) AS n FROM l GROUP BY host),
f AS (SELECT host, norm FROM l JOIN h USING (host) GROUP BY host, norm, h.n HAVING count(DISTINCT doc_id) > least(20, greatest(10, 0.2 * h.n))),
x AS (SELECT doc_id, sum(lw) AS n FROM l JOIN f USING (host, norm) GROUP BY doc_id),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(u.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
  coalesce(x.n, 0)::BIGINT AS n_removed_words FROM d LEFT JOIN u USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN x USING (doc_id)),
c AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (n_words - n_removed_words < 0.5 * n_words) AS kept, n_removed_words FROM c
"""

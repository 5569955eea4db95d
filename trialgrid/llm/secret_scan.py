"""Secret scans with an incremental ledger of blobs, with DataFrame functions only.

Every historical version (row) of a text is addressed by the SHA-256 of its content. The ledger has, for each blob, the
rules (with their versions) that have scanned it and what they found. A scan distinct-counts the blobs, scans only the
pairs of blob and rule version that the ledger lacks, and joins the findings back to every path that holds the blob, so
that a text copied a million times is scanned once and a new rule version touches no other rule's work.

Nulls count as empty texts. Repeated rows and copies get the same findings. Only the id and text columns are read.
Offsets are code points, ends are exclusive, matches of one kind never overlap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.common import whole_text, written


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    group: int = 0  # this group has at least `least` characters, else the match is dropped
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed patterns; the first three are the base kinds.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
BASE = ("assign", "access", "hex")
PART = 256  # findings of a text whose places are added up together: time grows in proportion to the findings
SPAN = "array<struct<start:int,nth:int,stop:int,rule:string>>"


def spans(text: Column, rule: Rule, nth: int) -> Column:
    """The rule's matches as (start, nth, stop, rule): what lies between matches gives their places."""
    def walk(found: Column) -> Column:
        lengths = F.zip_with(found["gap"], F.transform(found["hit"], lambda h: F.length(h)), lambda g, h: F.struct(F.length(g).alias("gap"), F.coalesce(h, F.lit(0)).alias("hit")))
        whole = F.zip_with(lengths, F.transform(found["test"], lambda t: F.length(t)), lambda x, t: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), t.alias("test")))
        return F.transform(F.array(F.struct(whole.alias("z"))), lambda s: in_parts(s["z"]))[0]

    def in_parts(z: Column) -> Column:
        parts = F.sequence(F.lit(0), F.size(z) - 1, F.lit(PART))
        sizes = F.transform(parts, lambda c: F.aggregate(F.slice(z, c + 1, PART), F.lit(0), lambda a, x: a + x["gap"] + x["hit"]))
        return F.transform(F.array(F.struct(parts.alias("parts"), sizes.alias("sizes"))), lambda s: F.flatten(F.transform(
            s["parts"], lambda c, i: one_part(F.slice(z, c + 1, PART), F.aggregate(F.slice(s["sizes"], 1, i), F.lit(0), lambda a, x: a + x)))))[0]

    def one_part(z: Column, at: Column) -> Column:
        return F.aggregate(z, F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + x["hit"]
        one = F.array(F.struct(start.alias("start"), F.lit(nth).alias("nth"), stop.alias("stop"), F.lit(rule.name).alias("rule")))
        good = F.coalesce(x["test"] >= rule.least, F.lit(False))
        return F.struct(stop.alias("at"), F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    pattern = F.lit(rule.pattern)
    found = F.transform(
        F.array(F.struct(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
                         F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("test"))),
        walk)[0]
    return F.when(F.regexp_like(text, pattern), found).otherwise(F.array().cast(SPAN))


def scan_unseen(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of `blobs` (blob, body, unseen)."""
    each = [F.when(F.array_contains("unseen", r.name), spans(F.col("body"), r, i)).otherwise(F.array().cast(SPAN)) for i, r in enumerate(rules)]
    return blobs.select("blob", F.col("unseen").alias("scanned"), F.concat(*each).alias("findings"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
         text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, blob, found) of every row, and the ledger's new rows (blob, scanned, findings) to append to it.

    `found` is sorted by start, then by the rules' order. Findings of rule versions that are not in `rules` are ignored.
    """
    names = F.array(*[F.lit(r.name) for r in rules])
    body = whole_text(text_col)
    blob = F.sha2(body.cast("binary"), 256)
    todo = docs.select(blob.alias("blob"), body.alias("body")).distinct()
    if ledger is None:
        todo = todo.withColumn("unseen", names)
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("scanned")).alias("seen"))
        todo = (todo.join(seen, "blob", "left").withColumn("unseen", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))))
                .where(F.size("unseen") > 0))
    new = written(scan_unseen(todo, rules), "ledger")
    every = new if ledger is None else ledger.select("blob", "scanned", "findings").unionByName(new)
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    found = (every.where(F.size("findings") > 0).select("blob", F.explode("findings").alias("f"))
             .where(F.col("f.rule").isin([r.name for r in rules]))
             .select("blob", F.struct(F.col("f.start").alias("start"), order[F.col("f.rule")].alias("nth"), F.col("f.stop").alias("stop"),
                                      F.split_part("f.rule", F.lit("@"), F.lit(1)).alias("kind")).alias("f"))
             .groupBy("blob").agg(F.sort_array(F.collect_set("f")).alias("found")))
    found = written(found, "findings")  # read again, so that rows of a hot blob can be split among tasks
    paths = docs.select(F.col(id_col).alias("doc_id"), blob.alias("blob"))
    empty = F.array().cast("array<struct<start:int,nth:int,stop:int,kind:string>>")
    return paths.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("found", empty).alias("found")), new


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and a checksum of the base kinds, and all spans as text."""
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("found", lambda s: s["kind"])
    count = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("bigint").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *count, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by one mark; spans are taken in parts, each with its own stretch of the text."""
    def part(c: Column) -> Column:
        own = F.slice(found, c + 1, PART)
        begin = F.coalesce(F.array_max(F.transform(F.slice(found, 1, c), lambda s: s["stop"])), F.lit(0))
        end = F.array_max(F.transform(own, lambda s: s["stop"]))
        return F.transform(F.array(F.struct(own.alias("own"), begin.alias("begin"), F.substring(text, begin + 1, F.greatest(end - begin, F.lit(0))).alias("stretch"))), one_part)[0]

    def one_part(p: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            more = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(p["stretch"], acc["at"] - p["begin"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), more.alias("out"))

        return F.aggregate(p["own"], F.struct(p["begin"].alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    done = F.array_join(F.transform(F.sequence(F.lit(0), F.size(found) - 1, F.lit(PART)), part), "")
    last = F.array_max(F.transform(found, lambda s: s["stop"]))
    return F.when(F.size(found) > 0, F.concat(done, F.substring(text, last + 1, F.length(text)))).otherwise(text)


def without_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns; found secrets are replaced in the text, and n_chars, where there is one, follows."""
    found, _ = scan(docs, id_col=id_col, text_col=text_col)
    hit = found.where(F.size("found") > 0).select(F.col("blob").alias("__blob"), F.col("found").alias("__found")).distinct()
    rows = docs.withColumn("__body", whole_text(text_col)).withColumn("__at", F.sha2(F.col("__body").cast("binary"), 256))
    rows = rows.join(written(hit, "hit"), F.col("__at") == F.col("__blob"), "left")
    new = {text_col: F.when(F.size("__found") > 0, redacted(F.col("__body"), F.col("__found"))).otherwise(F.col(text_col))}
    rows = rows.withColumns(new)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size("__found") > 0, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def _oracle() -> str:
    q = lambda s: s.replace("'", "''")
    parts = []
    for i, r in enumerate(RULES):
        p = q(r.pattern)
        parts.append(f"""
SELECT doc_id, {i} AS nth, '{r.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': (list_sum(list_transform(g[1:i], lambda x: length(x)))
  + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT, 'n': length(m[i]), 'ok': length(t[i]) >= {r.least}}})) AS f
FROM (SELECT doc_id, regexp_extract_all(body, '{p}') AS m, regexp_extract_all(body, '{p}', {r.group}) AS t, string_split_regex(body, '{p}') AS g FROM d WHERE regexp_matches(body, '{p}'))""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
f AS (SELECT doc_id, nth, kind, f.s AS s, kind || ':' || f.s || ':' || (f.s + f.n) AS x FROM ({" UNION ALL ".join(parts)}) WHERE f.ok),
a AS (SELECT doc_id, count(*) FILTER (nth = 0) AS n_assign, count(*) FILTER (nth = 1) AS n_access, count(*) FILTER (nth = 2) AS n_hex,
  coalesce(string_agg(x, ',' ORDER BY s, nth) FILTER (nth < 3), '') AS base, string_agg(x, ',' ORDER BY s, nth) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)
"""


ORACLE = _oracle()

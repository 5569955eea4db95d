"""Near duplicates: b-bit MinHash signatures, a multi-index Hamming join, and a check on full shingle sets.

A signature has 64 values of 16 bits. Two texts of similarity 0.85 differ in 23 of them or fewer but for one pair in
100,000; at 0.90 one in 10^8. The 64 places are split into 12 chunks, so a pair within 23 differences has a chunk with at
most one (23 < 2 * 12). All ways to leave out one place of a chunk are enumerated as keys, hence every pair within the
threshold shares a key: no probability enters after the signature. For a similarity of 0.8 there are 96 values, 19 chunks
and 36 differences.

Texts with equal sets are one vertex. In a bucket (key) no product of its members is made: members are held against its
smallest and its largest id, links found become components, and only members that are still in different components are
compared with each other, in blocks of bounded bytes spread over tasks. Every candidate pair that could join two
components is confirmed on the full sets of shingle hashes (64 bits), inside the task that found it.

Null and empty texts have no shingles and no links; a null id has no links either and its row stays. Rows under one id
count as linked. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.common import ascii_lower, whole_text, word_hashes, written
from trialgrid.llm.components import components

WIDTH = 5
BLOCK_BYTES = 4 << 20  # shingle hashes of the members that one task compares with each other, from each of two sides
BROADCAST_IDS = 1_000_000  # at most so many ids (16 MB) are broadcast; beyond, the join is a shuffle


@dataclass(frozen=True)
class Scheme:
    """Signatures of `values` values, `chunks` chunks; pairs within `far` differences are found. far < 2 * chunks."""

    values: int
    chunks: int
    far: int

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(20240607)
        return tuple(rng.integers(0, 2**63, self.values, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in "ab")

    def matrix(self, column: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(column), np.uint16).reshape(-1, self.values)


def scheme_for(percent: int) -> Scheme:
    return Scheme(64, 12, 23) if percent >= 85 else Scheme(96, 19, 36)



def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(lists: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each list of word hashes."""
    starts = lists.offsets.to_numpy()
    w = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    k = np.uint64(0xC2B2AE3D27D4EB4F)
    rolled = np.zeros(max(0, len(w) - WIDTH + 1), np.uint64)
    for i in range(WIDTH):
        rolled = rolled * k + w[i:len(w) - WIDTH + 1 + i]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= WIDTH:
            out.append(np.unique(rolled[a:b - WIDTH + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for x in w[a:b]:
                h = mixed(h * k + x)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(texts: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit digest (d1, d2) and its signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flip, odd = scheme.hashes()
        for batch in batches:
            sets = shingle_sets(batch.column(1))
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            sig, d1, d2 = np.zeros((len(sets), scheme.values), np.uint16), np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            if len(full):
                every = np.concatenate([sets[i] for i in full])
                at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                for j in range(scheme.values):
                    least = np.minimum.reduceat((every ^ flip[j]) * odd[j], at)
                    sig[full, j] = (mixed(least) >> np.uint64(48)).astype(np.uint16)
                d1[full] = np.add.reduceat(mixed(every), at)
                d2[full] = np.bitwise_xor.reduceat(mixed(every + np.uint64(1)), at)
            rows = [sig[i].tobytes() for i in range(len(sets))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(rows, pa.binary())],
                                             names=["doc_id", "n_shingles", "d1", "d2", "sig"])

    return texts.mapInArrow(run, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, sig binary")


def buckets(sigs: DataFrame, scheme: Scheme) -> DataFrame:
    """(key, id): one row for each chunk of a signature and each place left out of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = np.array_split(np.arange(scheme.values), scheme.chunks)
        for batch in batches:
            sig, keys = scheme.matrix(batch.column(1).to_pylist()).astype(np.uint64), []
            for chunk in chunks:
                for left_out in chunk:
                    key = np.full(len(sig), left_out + 1, np.uint64)
                    for place in chunk:
                        if place != left_out:
                            key = mixed(key * np.uint64(0xC2B2AE3D27D4EB4F) + sig[:, place])
                    keys.append(key)
            ids = np.tile(batch.column(0).to_numpy(), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64) if keys else []), pa.array(ids)], names=["key", "id"])

    return sigs.select("id", "sig").mapInArrow(run, "key bigint, id bigint")


def signatures_near(scheme: Scheme):
    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series((scheme.matrix(a) != scheme.matrix(b)).sum(1) <= scheme.far)

    return near


def sets_linked(percent: int):
    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.intersect1d(x, y, assume_unique=True).size
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    return linked


def full_sets(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, members) of the given ids: packed shingle hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1))], pa.binary())], names=["id", "members"])

    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    found = texts.join(wanted, F.col("doc_id") == F.col("id"), "left_semi")
    # one set an id: repeated rows of an id have the same set, or count as linked anyway
    return written(found.mapInArrow(run, "id bigint, members binary"), "sets")


def confirmed(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int, scheme: Scheme) -> DataFrame:
    """The pairs (a, b) whose full sets are linked."""
    left, right = (sigs.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    near = written(pairs.distinct().join(left, "a").join(right, "b").where(signatures_near(scheme)("sig_a", "sig_b")).select("a", "b").distinct(), "near")
    left, right = (sets.select(F.col("id").alias(c), F.col("members").alias(f"set_{c}")) for c in "ab")
    return written(near.join(left, "a").join(right, "b").where(sets_linked(percent)("set_a", "set_b")).select("a", "b").distinct(), "links")


def unresolved(rows: DataFrame, comps: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int, scheme: Scheme) -> DataFrame:
    """Links (a, b) between bucket members that are in different components and were not held against each other.

    Buckets that share members form a cluster. A cluster whose sets fit a block is one unit of work, so each set travels once; of a
    larger one each bucket is a unit. Units above a block are cut, and every pair of their parts is a task of its own. A task
    confirms on the full sets and returns only links that join two components: fewer than it has members.
    """
    rest = rows.where("id <> lo AND id <> hi").join(comps, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    rest = written(rest, "rest")
    sides = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x2")]
    open_keys = rest.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min("id").alias("first"), *sides).where("c1 <> c2")
    # keys with the same members ask the same question: one of them is held
    open_keys = open_keys.groupBy("n", "x1", "x2", "first").agg(F.min("key").alias("key")).select("key", "first")
    rest = written(rest.join(written(open_keys, "open"), "key"), "open-members")
    cluster = components(rest.select(F.col("first").alias("a"), F.col("id").alias("b")))
    # one row a member, whatever the number of its keys; keys come back only for clusters above a block
    once = rest.select("id", "comp").distinct().join(cluster.withColumnRenamed("comp", "cluster"), "id")
    once = once.join(sets.select("id", (F.octet_length("members") + 200).alias("bytes")).dropDuplicates(["id"]), "id")
    once = written(once.select("cluster", "id", "comp", "bytes"), "sized")
    large = written(once.groupBy("cluster").agg(F.sum("bytes").alias("total")), "clusters")
    beyond = once.join(large.where(F.col("total") > BLOCK_BYTES), "cluster").select("id", "bytes")
    once = once.join(large, "cluster").where(F.col("total") <= BLOCK_BYTES).select(F.lit(0).alias("kind"), F.col("cluster").alias("unit"), "id", "comp", "bytes", F.lit(1).alias("blocks"))
    each = rest.select("key", "id", "comp").join(beyond, "id")
    blocks = each.groupBy("key").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("blocks"))
    each = each.join(blocks, "key").select(F.lit(1).alias("kind"), F.col("key").alias("unit"), "id", "comp", "bytes", "blocks")
    rest = once.unionByName(each).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("kind", "unit", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "comp").join(sigs, "id").join(sets, "id")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        return joining_links(group, percent, scheme)

    dealt = rest.select("kind", "unit", "i", "j", "mine", "id", "comp", "sig", "members").groupBy("kind", "unit", "i", "j")
    return written(dealt.applyInPandas(compare, "a bigint, b bigint").distinct(), "joining")


def joining_links(group: pd.DataFrame, percent: int, scheme: Scheme) -> pd.DataFrame:
    """Confirmed links that join components, of one block with itself (i = j) or of block i with block j."""
    ids, comp, block = group["id"].to_numpy(), group["comp"].to_numpy().copy(), group["mine"].to_numpy()
    sig, sets = scheme.matrix(group["sig"]), [np.frombuffer(m, np.uint64) for m in group["members"]]
    sizes = np.array([len(s) for s in sets])
    left, right = np.flatnonzero(block == group["i"].iloc[0]), np.flatnonzero(block == group["j"].iloc[0])
    # shingle -> members of the right block that hold it
    held, owner = np.concatenate([sets[y] for y in right]), np.repeat(right, sizes[right])
    order = np.argsort(held, kind="stable")
    owner = owner[order]
    known, first = np.unique(held[order], return_index=True)
    last = np.append(first[1:], len(held))
    found = []
    for x in left:
        y = right[comp[right] != comp[x]]
        y = y[(sig[y] != sig[x]).sum(1) <= scheme.far]
        if not len(y):
            continue
        at = np.searchsorted(known, sets[x])
        at = at[at < len(known)]
        at = at[np.isin(known[at], sets[x])]
        runs = last[at] - first[at]
        holders = owner[np.repeat(first[at] - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())]
        both = np.bincount(holders, minlength=len(ids))[y]
        for z in y[100 * both >= percent * (sizes[x] + sizes[y] - both)]:
            if comp[z] != comp[x]:
                found.append((min(ids[x], ids[z]), max(ids[x], ids[z])))
                comp[comp == comp[z]] = comp[x]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def near_groups(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; linked are sets with 100 * intersection >= percent * union."""
    scheme = scheme_for(percent)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), word_hashes(ascii_lower(whole_text(text_col))).alias("words"))
    rows = written(signatures(texts, scheme), "signatures")
    same = written(rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("id")), "same")
    sigs = rows.join(same, ["d1", "d2", "n_shingles"]).where("doc_id = id").select("id", "sig")
    sigs = written(sigs.dropDuplicates(["id", "sig"]), "unlike")
    keys = buckets(sigs, scheme)
    shared = written(keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi"), "shared-keys")
    members = written(keys.join(shared, "key").distinct(), "members")
    stars = members.select(F.col("lo").alias("a"), F.col("id").alias("b")).unionByName(members.select(F.col("id").alias("a"), F.col("hi").alias("b"))).where("a < b")
    sets = full_sets(texts, members.select("id").distinct())
    links = confirmed(stars, sigs, sets, percent, scheme)
    comps = components(links)
    more = unresolved(members, comps, sigs, sets, percent, scheme)
    if not more.isEmpty():
        comps = components(links.unionByName(more))
    found = same.join(comps, "id", "left").select("d1", "d2", "n_shingles", F.coalesce("comp", "id").alias("comp"))
    out = rows.join(written(found, "found"), ["d1", "d2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with all columns; rows repeated under the id that stays all stay."""
    gone = near_groups(docs, percent, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(written(gone, "gone"), F.col(id_col) == F.col("__gone"), "left_anti")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM w WHERE len(w) >= 5 UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS v, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept FROM w JOIN m ON m.v = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

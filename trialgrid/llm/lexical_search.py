"""Ranked lexical search by two trees: every item against every document, exactly the best `top` of each.

Documents become rows of the items' terms with their counts (Arrow tasks, once a block of items). A term's share of a score does not
depend on the item, so a document is a vector of shares and an item a set of coordinates. In a task both sides are hierarchies: items
are ordered by their dearest term and grouped by fours, documents are ordered by their largest coordinate and grouped by eights, and a
node of documents holds the maximum of each coordinate, a node of items the set of all its coordinates and the largest number of terms of
an item. The sum of as many of the largest maxima inside the set bounds every score of the two nodes; a pair of nodes is left if the
bound is below the weakest of the items' present `top`-th scores, else its children are paired. A bound equal to it is followed, so
ties are settled by id. What is left at the bottom is scored in full.

The `top`-th scores start from a search of a hash sample of the documents (one in 64, 20,000 at least): the k-th best of a part is never
above the k-th best of all, so nothing is lost, and the rows that leave the tasks do not grow with the number of tasks. Each task returns at most `top` rows
an item, and a window with a limit on both sides of its shuffle takes the best of them.

Items are worked on in blocks of at most 256 items and 16,384 terms (a larger item is a block of its own); only a block's terms are
broadcast. Null texts have no terms, a null item id is an item like others, rows under one item id are one item with the terms of
all. Null document ids come last among equal scores. Repeated documents are listed each time. Empty tables give no rows.
Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.llm.common import written

ITEMS, TERMS = 256, 16_384
SAMPLE, SAMPLED = 20_000, 64
CELLS = 6_000_000  # of a task's dense part of the term x document matrix
LEAF, FAN, GROUP = 16, 8, 4

#: Bytes of UTF-8: letters A-Z lowered, other bytes that end a term become spaces.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


def term_lists(items: DataFrame) -> DataFrame:
    """(item_id, terms) with the distinct terms of each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(set(terms(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.binary()))], names=["item_id", "terms"])

    found = items.mapInArrow(run, "item_id bigint, terms array<binary>")
    return found.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items in blocks that the driver can hold, read from a table one after the other."""
    block, entries = [], 0
    for row in items.where(F.size("terms") > 0).orderBy(F.col("item_id").asc_nulls_first()).toLocalIterator():
        words = [bytes(t) for t in row["terms"]]
        if block and (len(block) == ITEMS or entries + len(words) > TERMS):
            yield block
            block, entries = [], 0
        block.append((row["item_id"], words))
        entries += len(words)
    if block:
        yield block


# ------------------------------------------------------------------ documents as counts of the items' terms

def counted(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, ids, tfs): number of terms, and the counts of the known ones as packed 32-bit numbers."""
    handle = docs.sparkSession.sparkContext.broadcast(known)  # at most TERMS terms, or those of one item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, size = handle.value.get, len(handle.value)
        for batch in batches:
            n, ids, tfs = [], [], []
            for text in batch.column(1):
                every = terms(text.as_py())
                found = np.fromiter(map(get, every, (size,) * len(every)), np.int32, len(every))
                count = np.bincount(found[found < size]) if len(found) else np.zeros(0, np.int64)
                here = np.flatnonzero(count)
                n.append(len(every))
                ids.append(here.astype(np.int32).tobytes())
                tfs.append(count[here].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())], names=["doc_id", "n", "ids", "tfs"])

    return written(docs.mapInArrow(run, "doc_id bigint, n bigint, ids binary, tfs binary"), "counts")


def document_counts(rows: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=size)
        here = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(here.astype(np.int32)), pa.array(total[here])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in rows.select("ids").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a block's terms
        out[r["term"]] = r["df"]
    return out


# ------------------------------------------------------------------ the two trees

@dataclass
class Block:
    """A block of items in tree order: ids, coordinates of each, weights of the terms, and the numbers of the corpus."""

    ids: list
    terms: list[np.ndarray]
    weights: np.ndarray
    documents: int
    length: int
    levels: list[list[tuple[np.ndarray, int, list[int]]]] = field(default_factory=list)

    def grow(self) -> "Block":
        """Levels of (coordinates, most terms of an item, children), the items first and the root last."""
        order = sorted(range(len(self.ids)), key=lambda i: (max(zip(self.weights[self.terms[i]].tolist(), self.terms[i].tolist())), i))
        self.ids, self.terms = [self.ids[i] for i in order], [self.terms[i] for i in order]
        self.levels = [[(t, len(t), []) for t in self.terms]]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            groups = [range(a, min(a + GROUP, len(below))) for a in range(0, len(below), GROUP)]
            self.levels.append([(np.unique(np.concatenate([below[i][0] for i in g])), max(below[i][1] for i in g), list(g)) for g in groups])
        return self

    def shares(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 50 + (50 * n * self.documents) // self.length
        return self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Best:
    """The best `top` (score, document) of each item so far; equal scores by ascending id."""

    def __init__(self, block: Block, top: int, least: np.ndarray):
        self.top, self.kth = top, least.copy()
        self.scores = [np.zeros(0, np.int64) for _ in block.ids]
        self.docs = [np.zeros(0, np.int64) for _ in block.ids]

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        keep = scores >= max(1, self.kth[item])
        scores, docs = np.concatenate([self.scores[item], scores[keep]]), np.concatenate([self.docs[item], docs[keep]])
        if len(scores) > self.top:
            first = np.lexsort((docs, -scores))[:self.top]
            scores, docs = scores[first], docs[first]
        if len(scores) == self.top:
            self.kth[item] = max(self.kth[item], scores.min())
        self.scores[item], self.docs[item] = scores, docs


def bounds(maxima: np.ndarray, node: tuple[np.ndarray, int, list[int]]) -> np.ndarray:
    """For each column of maxima: no item of the node scores higher on a document of the column's node."""
    held = maxima[node[0]]
    if len(held) > node[1]:
        held = np.partition(held, len(held) - node[1], axis=0)[len(held) - node[1]:]
    return held.sum(0)


def search_part(block: Block, best: Best, doc_ids: np.ndarray, dense: np.ndarray, seen: Counter) -> None:
    """Two-tree search of the documents whose shares are the columns of `dense` (terms x documents, a multiple of LEAF)."""
    tree = [dense.reshape(len(dense), -1, LEAF).max(2)]
    while tree[-1].shape[1] > 1:
        last = tree[-1]
        last = np.pad(last, ((0, 0), (0, -last.shape[1] % FAN)))
        tree.append(last.reshape(len(last), -1, FAN).max(2))
    at = len(tree) - 1
    pairs = {0: np.arange(tree[at].shape[1])}  # nodes of items -> nodes of documents
    level = len(block.levels) - 1
    lowest = [best.kth]
    for nodes in block.levels[1:]:
        lowest.append(np.array([min(lowest[-1][c] for c in children) for _, _, children in nodes]))
    while True:
        kept = {}
        for q, d in pairs.items():
            seen["pairs"] += len(d)
            d = d[bounds(tree[at][:, d], block.levels[level][q]) >= max(1, lowest[level][q])]
            if len(d):
                kept[q] = d
        if level == at == 0:
            break
        pairs = {}
        down, sideways = at > 0, level > 0
        for q, d in kept.items():
            d = (d[:, None] * FAN + np.arange(FAN)).ravel() if down else d
            d = d[d < tree[at - 1].shape[1]] if down else d
            for child in block.levels[level][q][2] if sideways else [q]:
                pairs[child] = d
        at, level = at - down, level - sideways
    for item, leaves in kept.items():
        scores = dense[block.terms[item]].reshape(len(block.terms[item]), -1, LEAF)[:, leaves].sum(0).ravel()
        seen["scored"] += len(scores)
        best.add(item, scores, doc_ids.reshape(-1, LEAF)[leaves].ravel())


NO_ID = np.iinfo(np.int64).max


def search_batch(block: Block, best: Best, batch: pa.RecordBatch, seen: Counter) -> None:
    ids, n = (batch.column(i) for i in (0, 1))
    doc_ids, n = np.asarray(ids.fill_null(NO_ID)), np.asarray(n)
    packed_ids, packed_tfs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
    size = np.array([len(b) // 4 for b in packed_ids])
    doc = np.repeat(np.arange(len(size)), size)
    term = np.frombuffer(b"".join(packed_ids), np.int32)
    share = block.shares(term, np.frombuffer(b"".join(packed_tfs), np.int32).astype(np.int64), n[doc])
    if not len(share):
        return
    # documents in the order of their largest coordinate
    by = np.lexsort((term, share, doc))
    last = by[np.cumsum(size[size > 0]) - 1]
    order = np.flatnonzero(size)[np.lexsort((-share[last], term[last]))]
    width = max(LEAF, CELLS // len(block.weights) // LEAF * LEAF)
    starts = np.cumsum(size) - size
    for a in range(0, len(order), width):
        part = order[a:a + width]
        columns = -(-len(part) // LEAF) * LEAF
        dense = np.zeros((len(block.weights), columns), np.int64)
        cells = np.repeat(starts[part] - np.concatenate([[0], np.cumsum(size[part])[:-1]]), size[part]) + np.arange(size[part].sum())
        dense[term[cells], np.repeat(np.arange(len(part)), size[part])] = share[cells]
        search_part(block, best, np.pad(doc_ids[part], (0, columns - len(part))), dense, seen)


HIT = "item bigint, doc_id bigint, score bigint"


def hits(rows: DataFrame, block: Block, top: int, least: np.ndarray) -> DataFrame:
    """(item, doc_id, score): at most `top` rows an item and task, every one of the best `top` among them."""
    handle = rows.sparkSession.sparkContext.broadcast((block, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, least = handle.value
        best, seen = Best(block, top, least), Counter()
        for batch in batches:
            search_batch(block, best, batch, seen)
        item = np.repeat(np.arange(len(block.ids)), [len(s) for s in best.scores])
        docs = np.concatenate(best.docs)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(docs, mask=docs == NO_ID), pa.array(np.concatenate(best.scores))], names=["item", "doc_id", "score"])

    return rows.mapInArrow(run, HIT)


def ranked(found: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def search_block(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], top: int) -> DataFrame:
    known: dict[bytes, int] = {}
    coordinates = [np.array(sorted(known.setdefault(t, len(known)) for t in words), np.int64) for _, words in items]
    rows = counted(docs, known)
    corpus = rows.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
    documents, length = int(corpus["documents"]), int(corpus["length"] or 0)
    df = document_counts(rows, len(known))
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    block = Block([i for i, _ in items], coordinates, weights, documents, max(1, length)).grow()
    rows = rows.where("length(ids) > 0")
    share = max(1, min(SAMPLED, documents // SAMPLE))
    least = np.zeros(len(items), np.int64)
    if share > 1:
        sample = rows.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(share)) == 0)
        for r in ranked(hits(sample, block, top, least), top).where(F.col("rank") == top).select("item", "score").collect():  # a row an item
            least[r["item"]] = r["score"]
    found = ranked(hits(rows, block, top, least), top)
    numbered = docs.sparkSession.createDataFrame([(k, i) for k, i in enumerate(block.ids)], "item bigint, item_id bigint")
    return found.join(F.broadcast(numbered), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of the best `top` documents of each item with a score above 0."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    asked = written(term_lists(items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text"))), "items")
    out = docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in item_blocks(asked):
        out = out.unionByName(search_block(docs, block, top))
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS t FROM benchmark),
g AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
f AS (SELECT doc_id, t, any_value(n) AS n, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY doc_id, t),
x AS (SELECT t, floor(1000 * ln((2 * g.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, g GROUP BY t, g.n),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * f.n * g.n) // g.l))))::BIGINT AS score FROM i JOIN f USING (t) JOIN x USING (t), g GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
"""

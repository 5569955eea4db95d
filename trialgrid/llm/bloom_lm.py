"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised to powers of two; an n-gram of level q is stored as (n-gram, 1) to
(n-gram, q) in one Bloom filter, and its level is read back by probing 1, 2, ... until a probe fails. The filter is built
in shards by the n-gram's hash, each by one task from counts gathered over the whole training corpus. A shard has
`bits_per_entry` bits for each (n-gram, level) it holds, so the share of false probes is the same at every size. Shards of
up to `max_bytes` in all are broadcast; of a larger filter each shard is probed by one task, to which the distinct n-grams
of every part of the texts are sent. The bits are the same either way, and so are the scores. The pair probability is
interpolated with the word probability; levels
are read as the lower end of their range and contexts as the upper end, so probabilities of a context sum to at most one
but for false probes.

The base score needs exact counts. Words with a count above a bound that at most `hot_words` words pass are broadcast
exactly; for all others the occurrences are joined with the count table. Words are identified by 64-bit hashes.

Null and empty texts hold the end token alone. Rows with a null id are scored and take part in training like the text
'' as id. Repeated rows get the same scores. With no training rows N and V are 0. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.common import ascii_lower, fold_of, whole_text, word_hashes, written

END, START = np.uint64(0x5EED0E2D0001), np.uint64(0x5EED0B3A0002)  # stand for the end token and what precedes the first word
PROBES = 4
GATHER = 1_000_000  # tokens that a training task holds before it sends counts on
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def tokens(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts with an end after each, and where each text starts (one more for the end of the last)."""
    at = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.to_numpy(zero_copy_only=False).view(U)[at[0]:at[-1]]
    sizes = np.diff(at)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(len(words) + len(sizes), END, U)
    place = np.ones(len(out), bool)
    place[starts[1:] - 1] = False
    out[place] = words
    return out, starts


def slices(batch: pa.RecordBatch, column: int, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `most` words each (or one text): working arrays stay small whatever the batch."""
    at, start = batch.column(column).offsets.to_numpy(), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def pairs(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context of each token, and the hash of the pair."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[starts[:-1]] = START
    return before, mixed(before * U(0xC2B2AE3D27D4EB4F) + ids)


def level(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(counts)).astype(np.int64) + 1


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


@dataclass
class Filter:
    """Bits of all shards one after another; a shard is chosen by the top bits of an n-gram's hash."""

    bits: np.ndarray
    shard_bits: int | np.ndarray  # of all shards alike, or of each
    log_shards: int

    def __post_init__(self):
        self.sizes = np.broadcast_to(np.asarray(self.shard_bits, U), 1 << self.log_shards)
        self.starts = np.cumsum(self.sizes, dtype=U) - self.sizes

    def places(self, keys: np.ndarray, q: int, whole: bool) -> Iterator[np.ndarray]:
        a = mixed(keys + U(q * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))
        step = (a >> U(32)) | U(1)
        size, base = self.sizes[0], U(0)
        if whole and self.log_shards:
            shard = (keys >> U(64 - self.log_shards)).astype(np.int64)
            size, base = self.sizes[shard], self.starts[shard]
        for i in range(PROBES):
            yield (a + U(i) * step) % size + base

    def holds(self, keys: np.ndarray, q: int) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for p in self.places(keys, q, True):
            out &= (self.bits[(p >> U(3)).astype(np.int64)] >> (p & U(7)).astype(np.uint8)) & 1 == 1
        return out

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Repeated probes: the level of each n-gram, 0 if it isn't there."""
        out, alive, q = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
        while len(alive) and q < 64:
            alive = alive[self.holds(keys[alive], q)]
            out[alive] = q
            q += 1
        return out


WORD_KEY = U(0x1234567)  # keeps the keys of words apart from those of pairs


def cuts(keys: np.ndarray, log_shards: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of the shards that sorted keys have."""
    shard = (keys >> U(64 - log_shards)).astype(np.int64) if log_shards else np.zeros(len(keys), np.int64)
    cut = np.searchsorted(shard, np.arange((1 << log_shards) + 1))
    return [(s, a, b) for s, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]


def gathered(texts: DataFrame, log_shards: int) -> DataFrame:
    """(shard, kind, keys, counts): counts of words (kind 0) and pairs (kind 1), summed within a task."""
    def send(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for kind, place in enumerate(zip(*held)):
            keys = np.concatenate(place)
            keys, counts = summed(keys, np.ones(len(keys), np.int64))
            rows = cuts(keys, log_shards)
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, *_ in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([keys[a:b].tobytes() for _, a, b in rows], pa.binary()),
                 pa.array([counts[a:b].astype(np.uint32).tobytes() for _, a, b in rows], pa.binary())], names=["shard", "kind", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in (s for b in batches for s in slices(b, 0)):
            ids, starts = tokens(batch.column(0))
            held.append((mixed(ids ^ WORD_KEY), pairs(ids, starts)[1]))
            size += len(ids)
            if size > GATHER:
                yield from send(held)
                held, size = [], 0
        if held:
            yield from send(held)

    return texts.select("words").mapInArrow(run, "shard int, kind int, keys binary, counts binary")


def built(counts: DataFrame, bits_per_entry: int) -> DataFrame:
    """One row a shard: its bits, its words with exact counts, tokens, and how many words have each level."""
    def run(table: pa.Table) -> pa.Table:
        exact, sizes, held = (np.zeros(0, U), np.zeros(0, np.int64)), [0] * 64, []
        for kind in (0, 1):
            part = table.filter(pc.equal(table["kind"], kind))
            keys = np.frombuffer(b"".join(part["keys"].to_pylist()), U)
            keys, n = summed(keys, np.frombuffer(b"".join(part["counts"].to_pylist()), np.uint32).astype(np.int64))
            if kind == 0:
                exact = (keys, n)
                sizes = np.bincount(level(n), minlength=64).tolist() if len(n) else sizes
            held.append((keys, (level(n) if len(n) else n).astype(np.uint8)))
        n_bytes = -(-bits_per_entry * sum(int(top.sum(dtype=np.int64)) for _, top in held) // 8)  # a level is an entry
        shape = Filter(np.zeros(n_bytes, np.uint8), 8 * n_bytes, 0)
        for keys, top in held:
            for q in range(1, int(top.max(initial=0)) + 1):
                for p in shape.places(keys[top >= q], q, False):
                    np.bitwise_or.at(shape.bits, (p >> U(3)).astype(np.int64), np.left_shift(np.uint8(1), (p & U(7)).astype(np.uint8)))
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "bits": pa.array([shape.bits.tobytes()], pa.binary()),
                         "word": pa.array([exact[0].tobytes()], pa.binary()), "n": pa.array([exact[1].tobytes()], pa.binary()),
                         "tokens": pa.array([int(exact[1].sum())], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int64()))})

    return counts.groupBy("shard").applyInArrow(run, "shard int, bits binary, word binary, n binary, tokens bigint, sizes array<bigint>")


@dataclass
class Model:
    filter: Broadcast | None  # Filter, none if it is above the bound of what is broadcast
    shards: DataFrame  # (shard, bits) of the same filter
    log_shards: int
    hot: Broadcast  # sorted word keys and their exact counts
    rare: DataFrame  # (word, n) of all other words
    tokens: int
    types: int
    texts: int


def words_above(model: DataFrame, least: int, most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, n in zip(batch.column(0), batch.column(1)):
                word, n = np.frombuffer(word.as_py(), np.int64), np.frombuffer(n.as_py(), np.int64)
                keep = (n >= least) & (n < most)
                yield pa.RecordBatch.from_arrays([pa.array(word[keep]), pa.array(n[keep])], names=["word", "n"])

    return model.select("word", "n").mapInArrow(run, "word bigint, n bigint")


def train(docs: DataFrame, folds: int = 7, held_out: int = 2, bits_per_entry: int = 10, max_bytes: int = 128 << 20, hot_words: int = 500_000,
          shard_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> Model:
    spark = docs.sparkSession
    texts = docs.where(fold_of(id_col, folds) != held_out).select(whole_text(text_col).alias("text"))
    size, n_texts = texts.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    log_shards = max(0, int(np.ceil(np.log2(max(1, size / shard_bytes)))))
    words = texts.select(word_hashes(ascii_lower(F.col("text"))).alias("words"))
    model = written(built(gathered(words, log_shards), bits_per_entry), "shards")
    facts = model.select("shard", "tokens", "sizes", F.octet_length("bits").alias("n_bytes")).collect()  # three numbers and 64 sizes for each shard
    sizes = np.sum([r["sizes"] for r in facts] or [[0] * 64], axis=0)
    # the least level whose words, with those above it, are few enough to broadcast
    above = np.cumsum(sizes[::-1])[::-1]
    least = 1 << max(0, int(np.argmax(above <= hot_words)) - 1)
    n_bytes = np.ones(1 << log_shards, np.int64)  # a shard with no n-gram is a byte of zeros
    n_bytes[[r["shard"] for r in facts]] = [r["n_bytes"] for r in facts]
    whole = None
    if n_bytes.sum() <= max_bytes:
        whole, starts = Filter(np.zeros(n_bytes.sum(), np.uint8), 8 * n_bytes, log_shards), np.cumsum(n_bytes) - n_bytes
        for r in model.select("shard", "bits").toLocalIterator():  # at most max_bytes in all
            whole.bits[starts[r["shard"]]:][:len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    hot = words_above(model, least, 1 << 62).toArrow()
    word, n = hot["word"].to_numpy().view(U), hot["n"].to_numpy()
    order = np.argsort(word)
    context = spark.sparkContext
    return Model(context.broadcast(whole) if whole else None, model.select("shard", "bits"), log_shards, context.broadcast((word[order], n[order])), words_above(model, 1, least),
                 sum(r["tokens"] for r in facts), int(sizes.sum()), n_texts)


SCORED = "doc_id bigint, content bigint, n_tokens bigint, n_known bigint, base double, score double, rare array<bigint>, rare_n array<int>"


def parts(rows: DataFrame) -> DataFrame:
    """One row for each part of a batch: its rows' ids and contents, its distinct words, and its tokens as places among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(s for b in batches for s in slices(b, 2)):
            ids, starts = tokens(batch.column(2))
            word, back = np.unique(ids, return_inverse=True)
            lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(i)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()), *lists, pa.array([word.tobytes()], pa.binary()), pa.array([back.astype(np.uint32).tobytes()], pa.binary()),
                 pa.array([starts.astype(np.int64).tobytes()], pa.binary())], names=["part", "doc_id", "content", "word", "back", "starts"])

    return rows.mapInArrow(run, "part bigint, doc_id array<bigint>, content array<bigint>, word binary, back binary, starts binary")


def part_tokens(word: pa.Scalar, back: pa.Scalar, starts: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and starts of a part, and its distinct n-grams in order."""
    word, starts = np.frombuffer(word.as_py(), U), np.frombuffer(starts.as_py(), np.int64)
    ids = word[np.frombuffer(back.as_py(), np.uint32)]
    return ids, starts, np.unique(np.concatenate([mixed(word ^ WORD_KEY), pairs(ids, starts)[1]]))


def probed(held: DataFrame, model: Model) -> DataFrame:
    """(part, shard, levels) of the distinct n-grams of each part, looked up where their shard is."""
    log_shards = model.log_shards

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, *columns in zip(*(batch.column(i) for i in range(4))):
                keys = part_tokens(*columns)[2]
                rows = cuts(keys, log_shards)
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(rows), pa.int64()), pa.array([s for s, *_ in rows], pa.int32()), pa.array([keys[a:b].tobytes() for _, a, b in rows], pa.binary())],
                                                 names=["part", "shard", "keys"])

    def answer(asked: pa.Table, shard: pa.Table) -> pa.Table:
        bits = np.frombuffer(shard["bits"][0].as_py() if shard.num_rows else bytes(1), np.uint8)
        own = Filter(bits, 8 * len(bits), 0)
        found = [own.levels(np.frombuffer(k.as_py(), U)).astype(np.uint8).tobytes() for k in asked["keys"]]
        return pa.table({"part": asked["part"], "shard": asked["shard"], "levels": pa.array(found, pa.binary())})

    asked = held.select("part", "word", "back", "starts").mapInArrow(ask, "part bigint, shard int, keys binary")
    return asked.groupBy("shard").cogroup(model.shards.groupBy("shard")).applyInArrow(answer, "part bigint, shard int, levels binary")


def scored(docs: DataFrame, model: Model, kappa: float = 2.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row."""
    total, n_texts = float(model.tokens + model.types + 1), model.texts
    filter_at, hot_at = model.filter, model.hot

    def verdict(doc: pa.Array, content: pa.Array, ids: np.ndarray, starts: np.ndarray, levels: Callable[[np.ndarray], np.ndarray]) -> pa.RecordBatch:
        hot, hot_n = hot_at.value
        before, pair = pairs(ids, starts)
        word, back = np.unique(ids, return_inverse=True)
        key = mixed(word ^ WORD_KEY)
        place = np.minimum(np.searchsorted(hot, key), max(len(hot) - 1, 0))
        is_hot = hot[place] == key if len(hot) else np.zeros(len(key), bool)
        exact = np.where(is_hot, hot_n[place] if len(hot) else 0, 0)
        q = levels(key)
        low = np.where(q > 0, 2.0 ** (q - 1), 0.0)
        high = np.where(q > 0, 2.0**q - 1, 0.0)
        q2 = levels(pair)
        context = np.empty(len(ids))
        context[1:] = high[back[:-1]]
        context[starts[:-1]] = n_texts
        share = context / (context + kappa)
        follows = np.where(q2 > 0, np.minimum(2.0 ** (q2 - 1), context), 0.0)
        p = share * follows / np.maximum(context, 1.0) + (1 - share) * (low[back] + 1) / total
        at = starts[:-1]
        score = np.add.reduceat(np.log10(p), at)
        base = np.add.reduceat(np.log10(exact[back] + 1.0), at)
        n_known = np.add.reduceat(is_hot[back].astype(np.int64), at)
        cold = np.flatnonzero(~is_hot[back])
        row = np.searchsorted(starts, cold, side="right") - 1
        slot, n = summed((row.astype(U) << U(32)) | back[cold].astype(U), np.ones(len(cold), np.int64))
        ends = np.searchsorted((slot >> U(32)).astype(np.int64), np.arange(len(at) + 1)).astype(np.int32)
        rare = key[(slot & U(0xFFFFFFFF)).astype(np.int64)].view(np.int64)
        return pa.RecordBatch.from_arrays(
            [doc, content, pa.array(np.diff(starts)), pa.array(n_known), pa.array(base), pa.array(score),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rare)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(n.astype(np.int32)))],
            names=["doc_id", "content", "n_tokens", "n_known", "base", "score", "rare", "rare_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, 2)):
            yield verdict(batch.column(0), batch.column(1), *tokens(batch.column(2)), filter_at.value.levels)

    def join(part: pa.Table, found: pa.Table) -> pa.Table:
        ids, starts, keys = part_tokens(*(part[c][0] for c in ("word", "back", "starts")))
        levels = np.frombuffer(b"".join(found.sort_by("shard")["levels"].to_pylist()), np.uint8).astype(np.int64)  # shards and keys ascend together
        return pa.Table.from_batches([verdict(part["doc_id"][0].values, part["content"][0].values, ids, starts, lambda k: levels[np.searchsorted(keys, k)])])

    body = whole_text(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(body).alias("content"), word_hashes(ascii_lower(body)).alias("words"))
    if model.filter:
        rows = written(rows.mapInArrow(run, SCORED), "scored")
        model.filter.unpersist()  # workers need it no more; a later use sends it again
    else:
        held = written(parts(rows), "parts")
        rows = written(held.groupBy("part").cogroup(probed(held, model).groupBy("part")).applyInArrow(join, SCORED), "scored")
    model.hot.unpersist()
    left = rows.select("doc_id", "content", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("doc_id", "content", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("times"))
    found = (left.join(model.rare, "word").groupBy("doc_id", "content")
             .agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("known")))
    # rows repeated with id and text have had their words counted once each
    again = rows.groupBy("doc_id", "content").agg(F.count("*").alias("rows"))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.content") == F.col(f"{b}.content"))
    found = found.alias("f").join(again.alias("g"), same("f", "g")).select("f.doc_id", "f.content", (F.col("more") / F.col("rows")).alias("more"), (F.col("known") / F.col("rows")).alias("known"))
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(total))
    return rows.alias("r").join(found.alias("f"), same("r", "f"), "left").select(
        "r.doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0.0)).cast("bigint")).alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        base.alias("base_score"), "score")


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    out = scored(docs, train(docs, id_col=id_col, text_col=text_col), id_col=id_col, text_col=text_col)
    return out.withColumn("held_out", fold_of("doc_id", 7) == 2)

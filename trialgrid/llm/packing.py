"""Best-two-fit packing of tokenised texts into sequences of bounded length.

Texts become pieces (ids, an end id, cuts only where a text is longer than a sequence). Pieces are dealt by hash to
shards of a bounded number of pieces; each shard packs its lengths alone: a bin is filled greedily with the largest
pieces that fit, and then its smallest piece is replaced by two unpacked pieces that fill the expanded gap more tightly.
Only lengths and checksums leave the tokenising tasks. A shard wastes at most its last few bins, so the loss against one
global packing is a few bins in many thousands.

A null text counts as empty and is one piece holding the end id. Repeated rows are packed like different ones. Only the
id and text columns are read. Ids are those of the `tokenizers` file, whose added tokens are one id each wherever a text holds
their string; the byte-pair ranks of the same vocabulary give all others faster word by word, which tests compare.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.common import whole_text, written

WORDS_KEPT = 300_000  # a worker forgets its word table beyond this size
_table: dict[str, "WordIds"] = {}


class WordIds(dict):
    """Bytes of the ids (unsigned 32 bits each) of a space and a word, computed once a word."""

    def __init__(self, ranks: str, pattern: str, vocabulary: str):
        import tiktoken

        with open(vocabulary, encoding="utf-8") as file:
            self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in json.load(file)["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        with open(ranks, "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        self[word] = out = self.plain(" " + word)
        return out

    def plain(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def of(self, text: str) -> bytes:
        """Texts are cut at added tokens first."""
        if self.cut is None or not any(a in text for a in self.added):
            return self.words(text)
        return b"".join(self.added.get(part) or self.words(part) for part in self.cut(text) if part)

    def words(self, text: str, odd=re.compile(r"\s ").search) -> bytes:
        """A token never spans a space that follows a word, so words can be looked up one by one."""
        if odd(text):
            return self.plain(text)
        head, *rest = text.split(" ")
        out = self.plain(head) + b"".join(map(self.__getitem__, rest))
        if len(self) > WORDS_KEPT:
            self.clear()
        return out


def word_ids(ranks: str, vocabulary: str) -> WordIds:
    import public_tokenizers

    if ranks not in _table:
        _table[ranks] = WordIds(public_tokenizers.path(ranks), public_tokenizers.PATTERN, public_tokenizers.path(vocabulary))
    return _table[ranks]


PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, most: int = 1024, end_id: int = 2, ranks: str = "byte_bpe_50k.tiktoken", vocabulary: str = "byte_bpe_50k.json",
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every text: doc_id, piece, start, length, ids_crc32."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = word_ids(ranks, vocabulary), array("I", [end_id]).tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(table.of(text.as_py()) + end)
                n = len(ids) // 4
                stop = n if n <= most else n % most or most
                at = k = 0
                while at < n:
                    for column, value in zip(out, (doc, k, at, stop - at, zlib.crc32(ids[4 * at:4 * stop]))):
                        column.append(value)
                    at, stop, k = stop, stop + most, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(cut, PIECE)


def best_two_fit(lengths: list[int], most: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length; no length is above `most`."""
    stacks: list[list[int]] = [[] for _ in range(most + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        stacks[lengths[i]].append(i)
    free = sum(1 << n for n in range(1, most + 1) if stacks[n])  # bit n: a piece of length n is unpacked
    place: list[tuple[int, int]] = [(0, 0)] * len(lengths)

    def largest(limit: int) -> int:
        return (free & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 else 0

    def take(n: int) -> int:
        nonlocal free
        i = stacks[n].pop()
        if not stacks[n]:
            free ^= 1 << n
        return i

    number = 0
    while free:
        held, gap = [], most
        while (n := largest(gap)) > 0:
            held.append(take(n))
            gap -= n
        if gap and free:
            small = lengths[held[-1]]
            room, best = gap + small, (small, 0, 0)
            a = largest(room - 1)
            while a > 0 and 2 * a > best[0] and best[0] < room:
                b = largest(min(room - a, a))
                if b == a and len(stacks[a]) < 2:
                    b = largest(a - 1)
                if b > 0 and a + b > best[0]:
                    best = (a + b, a, b)
                a = largest(a - 1)
            if best[1]:
                stacks[small].append(held.pop())
                free |= 1 << small
                held += [take(best[1]), take(best[2])]
        at = 0
        for i in held:
            place[i] = (number, at)
            at += lengths[i]
        number += 1
    return place


def pack(parts: DataFrame, most: int = 1024, shard_pieces: int = 40_000) -> DataFrame:
    """`parts` with sequence_id and offset. A shard has about `shard_pieces` pieces, whatever the input's size."""
    parts = written(parts, "pieces")
    shards = max(1, round(parts.count() / shard_pieces))
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))

    def fill(rows: pa.Table) -> pa.Table:
        # ids stay in Arrow: pandas has no whole numbers beside nulls
        shard = rows.column("shard")[0].as_py()
        rows = rows.sort_by([(c, "descending") for c in ("length", "doc_id", "piece", "ids_crc32")]).drop_columns(["shard"])
        place = best_two_fit(rows.column("length").to_pylist(), most)
        rows = rows.append_column("sequence_id", pa.array([shard << 32 | number for number, _ in place], pa.int64()))
        return rows.append_column("offset", pa.array([at for _, at in place], pa.int64()))

    return dealt.groupBy("shard").applyInArrow(fill, PIECE + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, most: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(pieces(docs, most, id_col=id_col, text_col=text_col), most)

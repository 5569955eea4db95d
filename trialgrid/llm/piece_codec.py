"""SentencePiece (byte-pair model) encoding and decoding by suffix-array matching.

The unseen words of a batch are concatenated and suffix-sorted; every piece of the vocabulary is found in the suffix array
by binary search, and its range of suffixes gives all its occurrences. These are the edges of a lattice. Edges are sorted
by position and relaxed from left to right: a prefix of a word has one encoding, and a piece extends it if the last piece
and the new one are what the merge rule makes of the two alone. So the result is the merge rule's, not a shortest path.

Words are cut where no piece can cross (before a space mark that follows other text, and at line ends), which is checked
when the vocabulary is loaded. Characters without a piece become byte pieces. Null and empty texts have no ids. Repeated
rows have equal ids. Texts are whole; batches are relaxed in blocks of bounded size. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from trialgrid.llm.common import whole_text

SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
BLOCK = 1_500_000  # characters that are suffix-sorted together
WORDS_KEPT, PAIRS_KEPT = 300_000, 700_000
DEPTH = 16  # longest piece


def ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each key among the distinct ones, and the sorting order."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    rank = np.empty(len(keys), np.uint64)
    rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]).astype(np.uint64)
    return rank, order


class Codec:
    def __init__(self, model: str):
        import sentencepiece

        spm = sentencepiece.SentencePieceProcessor(model_file=model)
        every = range(spm.vocab_size())
        self.bytes_at = {int(spm.id_to_piece(i)[1:-1], 16): i for i in every if spm.is_byte(i)}
        plain = [i for i in every if not (spm.is_byte(i) or spm.is_control(i) or spm.is_unknown(i))]
        self.piece = {i: spm.id_to_piece(i) for i in plain}
        self.score = {p: spm.get_score(i) for i, p in self.piece.items()}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p or len(p) > DEPTH for p in self.score):
            raise ValueError("pieces cross word ends")
        self.size = spm.vocab_size()
        letters = sorted({c for p in self.score for c in p})
        self.bits = max(1, len(letters).bit_length())
        if 4 * self.bits > 64:
            raise ValueError("too many distinct characters")
        self.code = np.zeros(0x110000, np.uint64)  # 0: in no piece, or between words
        for i, c in enumerate(letters):
            self.code[ord(c)] = i + 1
        self.ids = np.array(plain, np.int64)
        self.lengths = np.array([len(self.piece[i]) for i in plain], np.int64)
        coded = np.zeros((len(plain), DEPTH), np.uint64)
        for row, i in enumerate(plain):
            coded[row, :len(self.piece[i])] = self.code[[ord(c) for c in self.piece[i]]]
        top = np.uint64((1 << self.bits) - 1)
        filled = np.where(np.arange(DEPTH) < self.lengths[:, None], coded, top)
        self.low, self.high = self.packed(coded), self.packed(filled)
        self.text = {i: b.encode() for i, b in ((i, p.replace(SPACE, " ")) for i, p in self.piece.items())} | {i: bytes([b]) for b, i in self.bytes_at.items()}
        self.known: dict[str, bytes] = {}
        self.agrees: dict[int, bool] = {}

    def packed(self, rows: np.ndarray) -> np.ndarray:
        """Four numbers of four characters each, in order."""
        out = np.zeros((len(rows), 4), np.uint64)
        for k in range(DEPTH):
            out[:, k // 4] = (out[:, k // 4] << np.uint64(self.bits)) | rows[:, k]
        return out

    def merged(self, text: str) -> list[str]:
        """The merge rule on a short text: again and again the best pair, the leftmost of equals."""
        parts, score, none = list(text), self.score.get, -np.inf
        while len(parts) > 1:
            scores = [score(a + b, none) for a, b in zip(parts, parts[1:])]
            if (top := max(scores)) == none:
                break
            best = scores.index(top)
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def fits(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces (last * size + next) stays a pair."""
        distinct, back = np.unique(pairs, return_inverse=True)
        out = np.empty(len(distinct), bool)
        for k, key in enumerate(distinct.tolist()):
            if (good := self.agrees.get(key)) is None:
                u, t = self.piece[key // self.size], self.piece[key % self.size]
                self.agrees[key] = good = self.merged(u + t) == [u, t]
            out[k] = good
        return out[back]

    def matches(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of all pieces in the coded text: positions, and rows of the piece table."""
        n, b = len(text), np.uint64(self.bits)
        padded = np.concatenate([text, np.zeros(DEPTH, np.uint64)])
        four = np.zeros(n + DEPTH, np.uint64)
        for k in range(4):
            four[:n] = (four[:n] << b) | padded[k:n + k]
        rank, _ = ranks(four)
        rank, _ = ranks((rank << np.uint64(32)) | np.concatenate([rank[4:], np.zeros(4, np.uint64)]))
        _, suffixes = ranks((rank[:n] << np.uint64(32)) | np.concatenate([rank[8:n], np.full(8, rank[-1])])[:n])
        keys = [four[suffixes + 4 * k] for k in range(4)]

        def bound(want: np.ndarray, after: bool) -> np.ndarray:
            lo, hi = np.zeros(len(want), np.int64), np.full(len(want), n, np.int64)
            while (open_ := lo < hi).any():
                mid = (lo + hi) >> 1
                less, same = np.zeros(len(want), bool), np.ones(len(want), bool)
                for k in range(4):
                    at = keys[k][np.minimum(mid, n - 1)]
                    less |= same & (at < want[:, k])
                    same &= at == want[:, k]
                go = (less | same if after else less) & open_
                lo = np.where(go, mid + 1, lo)
                hi = np.where(open_ & ~go, mid, hi)
            return lo

        first, last = bound(self.low, False), bound(self.high, True)
        count = last - first
        row = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        return suffixes[place], row

    def learn(self, units: list[str]) -> None:
        """Encode words that aren't known yet."""
        sizes = np.array([len(u) for u in units], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        raw = np.frombuffer("\n".join(units).encode("utf-32-le"), np.uint32)
        text = self.code[raw]
        text[raw == 10] = 0
        at, row = self.matches(text)
        inside = np.zeros(len(raw), np.int64)
        inside[starts[1:]] = starts[1:] - starts[:-1]
        offset = np.arange(len(raw)) - np.maximum.accumulate(np.where(inside > 0, np.arange(len(raw)), 0))
        alone = np.flatnonzero(text == 0)
        alone = alone[~np.isin(alone, starts[1:] - 1)]  # characters without a piece
        edge_at = np.concatenate([at, alone])
        edge_len = np.concatenate([self.lengths[row], np.ones(len(alone), np.int64)])
        edge_id = np.concatenate([self.ids[row], np.full(len(alone), -1)])
        depth = offset[edge_at]
        order = np.argsort(depth.astype(np.uint16) if depth.max(initial=0) < 65536 else depth, kind="stable")
        edge_at, edge_len, edge_id = edge_at[order], edge_len[order], edge_id[order]
        cuts = np.flatnonzero(np.diff(offset[edge_at], prepend=-1))
        last = np.full(len(raw) + 1, -3, np.int64)  # piece that ends here: -3 none, -2 start of a word, -1 bytes
        back = np.zeros(len(raw) + 1, np.int64)
        last[starts] = -2
        for a, b in zip(cuts, [*cuts[1:], len(edge_at)]):
            before, new = last[edge_at[a:b]], edge_id[a:b]
            good = before > -3
            both = np.flatnonzero((before >= 0) & (new >= 0))
            good[both] = self.fits(before[both] * self.size + new[both])
            hit = np.flatnonzero(good)
            stop = edge_at[a:b][hit] + edge_len[a:b][hit]
            last[stop], back[stop] = new[hit], edge_at[a:b][hit]
            # a word's end is followed by a separator, so it never is the start of the next word
        if len(self.agrees) > PAIRS_KEPT:
            self.agrees.clear()
        ends = starts + sizes
        trail: list[np.ndarray] = []
        who, pos = np.arange(len(units)), ends.copy()
        live = pos > starts
        chain_who, chain_pos = [], []
        who, pos = who[live], pos[live]
        while len(who):
            chain_who.append(who)
            chain_pos.append(pos)
            pos = back[pos]
            more = pos > starts[who]
            who, pos = who[more], pos[more]
        if not chain_who:
            return
        who, pos = np.concatenate(chain_who), np.concatenate(chain_pos)
        order = np.argsort(pos, kind="stable")  # words lie one after another
        who, pos = who[order], pos[order]
        found = last[pos].astype(np.int32)
        edges = np.searchsorted(who, np.arange(len(units) + 1))
        flat, cuts = found.tobytes(), (4 * edges).tolist()
        self.known.update(zip(units, [flat[a:b] for a, b in zip(cuts, cuts[1:])]))
        for k in np.unique(who[found < 0]).tolist():  # words with characters that have no piece
            ids: list[int] = []
            for i in range(edges[k], edges[k + 1]):
                ids += [int(found[i])] if found[i] >= 0 else [self.bytes_at[x] for x in units[k][pos[i] - 1 - starts[k]].encode()]
            self.known[units[k]] = np.array(ids, np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids (signed 32 bits each) of each text."""
        cut = [UNIT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        self.known["\n"] = np.array([self.bytes_at[10]], np.int32).tobytes()
        unseen = sorted(set().union(*cut).difference(self.known))
        block, size = [], 0
        for u in unseen:
            block.append(u)
            size += len(u) + 1
            if size >= BLOCK:
                self.learn(block)
                block, size = [], 0
        if block:
            self.learn(block)
        return [b"".join(map(self.known.__getitem__, units)) for units in cut]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the space mark that begins every encoding goes, broken byte runs become replacement characters."""
        return b"".join([self.text[i] for i in ids if i in self.text]).decode(errors="replace").removeprefix(" ")


_codecs: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    import public_tokenizers

    if model not in _codecs:
        _codecs[model] = Codec(public_tokenizers.path(model))
    return _codecs[model]


def parts(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of batches with at most `most` bytes of text each, or one text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids and ids of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            found = codec(model).encode(batch.column(1).to_pylist())
            sizes = np.array([len(f) // 4 for f in found], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), ids], names=["doc_id", "n_ids", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, "doc_id bigint, n_ids bigint, ids array<int>")


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """All columns of `encoded` and the text of its ids (null: no ids)."""
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(model).decode(x or []) for x in batch.column(names.index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def round_trip(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids, and whether decoding gives the text back, where a space mark in a text reads as a space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            texts, use = batch.column(1).to_pylist(), codec(model)
            found = use.encode(texts)
            sizes = np.array([len(f) // 4 for f in found], np.int64)
            same = [use.decode(np.frombuffer(f, np.int32).tolist()) == t.replace(SPACE, " ") for f, t in zip(found, texts)]
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), ids, pa.array(same)], names=["doc_id", "n_ids", "ids", "round_trip"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(
        run, "doc_id bigint, n_ids bigint, ids array<int>, round_trip boolean")

"""Forecasts of channel fields and the keys they favour, on one dense vector a round.

A round's fields (12 histograms, 2,366 cells) are one row of packed numbers. Persistence, decayed average and the two moves need a round's
last 16 vectors, which reach it in tiles with a halo: the best cyclic shift is the peak of a Fourier correlation, the best XOR mask
that of a Walsh-Hadamard one. Analogs are the nearest earlier vectors by cosine: pairs of tiles are matrix products, and only five rows a
round and pair of tiles leave a task. Keys are scored by structure: all bit channels depend on the upper 15 or the lower 8 bits of a key and residues
are periodic, so a million keys need 33,000 table reads and five passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.functions.kernels import mix64
from trialgrid.operators.landscape import KEY_SPACE, PRIME_MODULI, RESOLUTIONS, TRANSFORMS, channel_sizes
from trialgrid.operators.ordered import position
from trialgrid.session import checkpoint_dir

MODELS = ("persistence", "ewma", "analog", "shift", "xor", "ensemble")
STARTS = {name: sum(s for _, s in channel_sizes()[:i]) for i, (name, _) in enumerate(channel_sizes())}
CELLS = sum(s for _, s in channel_sizes())
TILE = 32


def field_vectors(fields: DataFrame) -> DataFrame:
    """(round, idx, vec): the masses of all cells of a round as packed doubles; idx counts the rounds that have a field."""
    slot = F.try_element_at(F.create_map(*[F.lit(v) for pair in STARTS.items() for v in pair]), F.col("channel")) + F.col("bin")
    rows = fields.groupBy("round").agg(F.collect_list(F.struct(slot.cast("int").alias("slot"), "mass")).alias("c"))
    rows = rows.select("round", F.transform("c", lambda s: s["slot"]).alias("slot"), F.transform("c", lambda s: s["mass"]).alias("mass"))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                v = np.zeros(CELLS)
                v[batch.column(1)[i].values.to_numpy()] = batch.column(2)[i].values.to_numpy()
                out.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["round", "vec"])

    vectors = rows.mapInArrow(dense, "round bigint, vec binary")
    order = position(fields.select("round").distinct(), [], ["round"], "idx").select("round", "idx")
    checkpoint_dir(fields.sparkSession)
    return vectors.join(order, "round").select("round", "idx", "vec").checkpoint()


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """Transform of the last axis, a power of two, in log2 steps of sums and differences."""
    n, h = x.shape[-1], 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], -2).reshape(*x.shape[:-1], n)
        h *= 2
    return x


def best_shift(before: np.ndarray, now: np.ndarray) -> int:
    """Cyclic shift that maps `before` onto `now` best; of equals (12 digits) the least."""
    votes = np.fft.irfft(np.conj(np.fft.rfft(before)) * np.fft.rfft(now), len(now))
    return int(np.round(votes, 12).argmax())


def best_mask(before: np.ndarray, now: np.ndarray) -> int:
    """XOR mask that maps `before` onto `now` best; of equals (12 digits) the least."""
    return int(np.round(walsh_hadamard(walsh_hadamard(before) * walsh_hadamard(now)) / len(now), 12).argmax())


def moved(before: np.ndarray | None, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The field moved on by the shift, and by the mask, that led to it, channel by channel."""
    shift, xor = now.copy(), now.copy()
    if before is not None:
        for name, size in channel_sizes():
            a, b = STARTS[name], STARTS[name] + size
            shift[a:b] = np.roll(now[a:b], best_shift(before[a:b], now[a:b]))
            if not name.startswith("mod"):
                xor[a:b] = now[a:b][np.arange(size) ^ best_mask(before[a:b], now[a:b])]
    return shift, xor


def own_forecasts(vectors: DataFrame, window: int, decay: float) -> DataFrame:
    """(idx, persistence, ewma, shift, xor) from each round and its last `window` ones."""
    back = max(1, window - 1)
    tile, inside = F.floor(F.col("idx") / TILE), F.pmod("idx", F.lit(TILE))
    reach = F.sequence(tile, F.floor((F.col("idx") + back) / TILE))
    spread = vectors.select("idx", "vec", tile.alias("home"), F.explode(reach).alias("tile"))

    def forecast(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        idx = rows.column("idx").to_numpy()
        x = np.frombuffer(b"".join(rows.column("vec").to_pylist())).reshape(len(idx), -1)
        out: list[list] = [[], [], [], [], []]
        for k in np.flatnonzero(rows.column("home").to_numpy() == rows.column("tile").to_numpy()):
            last = x[max(0, k - window + 1):k + 1]
            w = decay ** np.arange(len(last) - 1, -1, -1, dtype=float)
            values = (x[k], (w / w.sum()) @ last, *moved(x[k - 1] if k else None, x[k]))
            for column, v in zip(out, (int(idx[k]), *[v.tobytes() for v in values])):
                column.append(v)
        return pa.table({"idx": pa.array(out[0], pa.int64()), **{n: pa.array(c, pa.binary()) for n, c in zip(("persistence", "ewma", "shift", "xor"), out[1:])}})

    return spread.groupBy("tile").applyInArrow(forecast, "idx bigint, persistence binary, ewma binary, shift binary, xor binary")


def analog_forecasts(vectors: DataFrame, neighbours: int) -> DataFrame:
    """(idx, analog): mean of the fields that followed the most similar earlier rounds, weighted by closeness."""
    root = np.concatenate([np.full(s, np.sqrt(s)) for _, s in channel_sizes()])
    tiles = vectors.select("idx", "vec", F.floor(F.col("idx") / TILE).alias("tile"))
    most = tiles.agg(F.max("tile")).first()[0]
    if most is None:
        return tiles.select("idx", F.col("vec").alias("analog"))
    left = tiles.select("idx", "vec", F.col("tile").alias("a"), F.explode(F.sequence(F.lit(0).cast("bigint"), "tile")).alias("b"))
    right = tiles.select("idx", "vec", F.explode(F.sequence("tile", F.lit(most).cast("bigint"))).alias("a"), F.col("tile").alias("b"))

    def nearest(key: tuple, queries: pa.Table, earlier: pa.Table) -> pa.Table:
        def unit(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            x = np.frombuffer(b"".join(rows.column("vec").to_pylist())).reshape(rows.num_rows, CELLS) * root
            return rows.column("idx").to_numpy(), x / np.linalg.norm(x, axis=1, keepdims=True)

        (qi, q), (ei, e) = unit(queries), unit(earlier)
        d = np.where(ei[None, :] < qi[:, None], np.round(1.0 - q @ e.T, 12), np.inf) if len(qi) and len(ei) else np.zeros((len(qi), 0))
        order = np.lexsort((np.broadcast_to(ei, d.shape), d), axis=1)[:, :neighbours]
        at, near = np.repeat(qi, order.shape[1]), ei[order].ravel()
        d = np.take_along_axis(d, order, 1).ravel()
        keep = np.isfinite(d)
        return pa.table({"idx": at[keep], "near": near[keep], "distance": d[keep]})

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(nearest, "idx bigint, near bigint, distance double")
    w = Window.partitionBy("idx").orderBy("distance", "near")
    found = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= neighbours).select("idx", (F.col("near") + 1).alias("next"), "distance")
    followed = found.join(vectors.select(F.col("idx").alias("next"), "vec"), "next")

    def mean(rows: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(rows.column("vec").to_pylist())).reshape(rows.num_rows, -1)
        w = 1.0 / (rows.column("distance").to_numpy() + 0.01)
        return pa.table({"idx": rows.column("idx")[:1], "analog": pa.array([((w / w.sum()) @ x).tobytes()], pa.binary())})

    return followed.groupBy("idx").applyInArrow(mean, "idx bigint, analog binary")


def forecasts(fields: DataFrame, window: int = 16, decay: float = 0.9, neighbours: int = 5, min_history: int = 32) -> DataFrame:
    """(round, idx, one packed forecast for each model): `round` is the round forecast, from the rounds up to position idx."""
    vectors = field_vectors(fields)
    following = vectors.select((F.col("idx") - 1).alias("idx"), F.col("round").alias("following"))
    rows = vectors.select("round", "idx").where(F.col("idx") >= min_history - 1).join(following, "idx", "left")
    rows = rows.select("idx", F.coalesce("following", F.col("round") + 1).alias("round"))
    return rows.join(own_forecasts(vectors, window, decay), "idx").join(analog_forecasts(vectors, neighbours), "idx").select("round", "idx", "persistence", "ewma", "analog", "shift", "xor")


def models_of(batch: pa.RecordBatch, first: int) -> Iterator[tuple[int, str, np.ndarray]]:
    """(row, model, vector) of the five packed columns from `first` on, and of their ensemble."""
    for i in range(batch.num_rows):
        x = {m: np.frombuffer(batch.column(first + k)[i].as_py()) for k, m in enumerate(MODELS[:5])}
        yield from ((i, m, v) for m, v in x.items())
        yield i, "ensemble", (x["ewma"] + x["analog"] + x["shift"] + x["xor"]) / 4.0


def forecast_channels(table: DataFrame) -> DataFrame:
    """(round, model, channel, cells, top_mass, mean_bin) of every forecast."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names = batch.column(0).to_pylist(), ["round", "model", "channel", "cells", "top_mass", "mean_bin"]
            out = []
            for i, model, v in models_of(batch, 2):
                for name, size in channel_sizes():
                    own = v[STARTS[name]:STARTS[name] + size]
                    out.append((rows[i], model, name, int((own > 0).sum()), float(own.max()), float(own @ np.arange(size))))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate(kinds)], names=names)

    return table.mapInArrow(run, "round bigint, model string, channel string, cells bigint, top_mass double, mean_bin double")


# ------------------------------------------------------------------ keys

class KeyAxis:
    """Scores of all keys 0..KEY_SPACE-1 from a field: the mean over channels of size x mass of the key's bin."""

    LOW = 32

    def __init__(self):
        hi = np.arange(KEY_SPACE // self.LOW)
        self.top, self.middle, self.low = hi >> 7, hi & 255, hi & 7
        self.odd = np.zeros(len(hi), np.int64)
        for k in range(8):
            self.odd |= ((hi >> (2 * k)) & 1) << k
        byte = np.arange(256)
        self.gray = byte ^ (byte >> 1)
        self.reversed = np.zeros(256, np.int64)
        for k in range(8):
            self.reversed |= ((byte >> k) & 1) << (7 - k)

    def gains(self, field: np.ndarray) -> dict[str, np.ndarray]:
        return {name: field[STARTS[name]:STARTS[name] + size] * size / len(STARTS) for name, size in channel_sizes()}

    def fine(self, gains: dict[str, np.ndarray], transform: str) -> np.ndarray:
        """All resolutions of a transform as one table of 256."""
        return sum(np.repeat(gains[f"{transform}-{r}"], 256 // r) for r in RESOLUTIONS)

    def scores(self, gains: dict[str, np.ndarray]) -> np.ndarray:
        t = {n: self.fine(gains, n) for n in TRANSFORMS}
        upper = (t["identity"] + t["gray"][self.gray])[self.top] + t["rotate7"][self.middle] + t["deinterleave"][self.odd]
        score = (upper[:, None] + t["bit_reverse"][self.reversed].reshape(8, self.LOW)[self.low]).ravel()
        for m in PRIME_MODULI:
            whole = KEY_SPACE // m * m
            score[:whole].reshape(-1, m)[:] += gains[f"mod-{m}"]
            score[whole:] += gains[f"mod-{m}"][:KEY_SPACE - whole]
        return score

    def exact(self, gains: dict[str, np.ndarray], key: np.ndarray) -> np.ndarray:
        """Scores of a few keys, channel after channel, to 12 digits."""
        hi = key >> 5
        place = {"identity": key >> 12, "gray": self.gray[key >> 12], "bit_reverse": self.reversed[key & 255], "rotate7": hi & 255, "deinterleave": self.odd[hi]}
        total = np.zeros(len(key))
        for t in TRANSFORMS:
            for r in RESOLUTIONS:
                total += gains[f"{t}-{r}"][place[t] // (256 // r)]
        for m in PRIME_MODULI:
            total += gains[f"mod-{m}"][key % m]
        return np.round(total, 12)

    def best(self, field: np.ndarray | None, round_no: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and scores of the best `budget`; equal scores by a hash of key and round, the only order without a field."""
        if field is None:
            key, score = np.arange(KEY_SPACE), np.zeros(KEY_SPACE)
        else:
            gains = self.gains(field)
            rough = self.scores(gains)
            key = np.flatnonzero(rough >= np.partition(rough, -budget)[-budget] - 1e-9)
            score = self.exact(gains, key)
        with np.errstate(over="ignore"):
            # fixed values: multipliers of the tie-break hash
            tie = mix64((key.astype(np.uint64) ^ np.uint64(round_no * 0x9E3779B1 % 2**64)) + np.uint64(0x9E3779B97F4A7C15))
        if field is None:
            first = np.argpartition(tie, -budget)[-budget:]
            key, score, tie = key[first], score[first], tie[first]
        order = np.lexsort((tie, score))[::-1][:budget]
        return key[order], score[order]


def top_keys(table: DataFrame, budget: int) -> DataFrame:
    """(round, model, rank, seed, score) of the best keys of every forecast, and of the hash order alone (`random`)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axis = KeyAxis()
        for batch in batches:
            rows = batch.column(0).to_pylist()
            work = [*models_of(batch, 2), *[(i, "random", None) for i in range(batch.num_rows)]]
            found = [(rows[i], m, *axis.best(v, rows[i], budget)) for i, m, v in work]
            n = [len(f[2]) for f in found]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array([f[0] for f in found], np.int64), n)), pa.array([f[1] for f, k in zip(found, n) for _ in range(k)], pa.string()),
                     pa.array(np.concatenate([np.arange(1, k + 1, dtype=np.int64) for k in n])), pa.array(np.concatenate([f[2] for f in found]).astype(np.int64)), pa.array(np.concatenate([f[3] for f in found]))],
                    names=["round", "model", "rank", "seed", "score"])

    spread = table.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), "round")
    return spread.mapInArrow(run, "round bigint, model string, rank bigint, seed bigint, score double")


def field_top_seeds(fields: DataFrame, budget: int, window: int = 16, decay: float = 0.9, neighbours: int = 5, min_history: int = 32) -> DataFrame:
    """Best keys of the whole key axis per (round, model), forecast from earlier rounds only."""
    return top_keys(forecasts(fields, window, decay, neighbours, min_history), budget)

"""Whitening of embeddings by spectrum slicing.

Entries become whole numbers (64 steps a unit), the distinct vectors are the fit list. Tasks send sums and products of vectors that
were centred on the whole number next to the mean before; what remains of the mean is below 0.5 and taken off exactly, so the
covariance is that of centred vectors. Of the covariance, which is dims x dims whatever the number of rows, the signs of the pivots of
an LDL' factorisation of V - shift * I count the eigenvalues above the shift. Bisection on these counts isolates each leading
eigenvalue, Rayleigh quotient iteration inside its interval converges, and counts on both sides of the value certify its number.
Eigenvalues that no shift tells apart share an interval and get an orthonormal basis of its space.

Rows whose vector is null, empty, or holds null or non-finite entries return nothing; nor do rows of another length than the fit list's
most frequent one (of equally frequent ones the longest). Null ids are kept, and repeated rows return their rows each time. Eigenvalues that are zero
to working precision have no component, so constant tables return nothing. A deviation above the range of long is null, entries
beyond 2^56 units count as 2^56. Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.common import written

STEPS, ORIGIN = 64.0, 1_000_000
ALPHA = (1 + 17**0.5) / 8  # pivot choice of Bunch and Kaufman


# ------------------------------------------------------------------ vectors of a batch

def whole_vectors(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the usable rows, their lengths, and their entries as whole numbers one after the other."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten()  # without those of null rows
    lengths = np.asarray(column.value_lengths().fill_null(0))
    c = np.asarray(values.fill_null(float("nan")), np.float64)
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(c))])
    good = (lengths > 0) & (bad[ends] == bad[ends - lengths])
    if dims is not None:
        good &= lengths == dims
    c = c[np.repeat(good, lengths)]
    top = float(2**56) * STEPS
    return np.flatnonzero(good), lengths[good], np.floor(STEPS * np.clip(c, -top / STEPS, top / STEPS)).astype(np.int64) + ORIGIN


def packed(x: np.ndarray) -> bytes:
    """The same bytes for the same vector, two bytes an entry where that is enough."""
    y = x - ORIGIN
    most = max(-int(y.min()), int(y.max()))
    for code in ("<i2", "<i4", "<i8"):
        if most < 1 << (8 * int(code[-1]) - 1):
            return code[-1].encode() + y.astype(code).tobytes()
    raise OverflowError(most)


def unpacked(rows: pa.Array, dims: int) -> np.ndarray:
    out = np.empty((len(rows), dims), np.int64)
    for i, row in enumerate(rows.to_pylist()):
        out[i] = np.frombuffer(row, f"<i{row[:1].decode()}", offset=1)
    return out + ORIGIN


def fit_list(vectors: DataFrame) -> DataFrame:
    """(x, dims): each distinct vector once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, lengths, x = whole_vectors(batch.column(0))
            ends = np.cumsum(lengths)
            rows = list({packed(x[b - n:b]): n for b, n in zip(ends, lengths)}.items())
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int32())], names=["x", "dims"])

    return written(vectors.mapInArrow(run, "x binary, dims int").distinct(), "fit")


def column_sums(fit: DataFrame, dims: int) -> np.ndarray:
    """Exact sum of each entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, np.int64)
        for batch in batches:
            total += unpacked(batch.column(0), dims).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(total)], names=["i", "s"])

    found = fit.select("x").mapInArrow(run, "i int, s bigint").groupBy("i").agg(F.sum("s").alias("s")).collect()  # dims rows
    return np.array([r["s"] for r in sorted(found)], np.int64)


def products(fit: DataFrame, dims: int, centre: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums, and sums of products, of the entries of (x - centre) @ by over the fit list."""
    width = by.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for batch in batches:
            z = (unpacked(batch.column(0), dims) - centre).astype(np.float64) @ by
            total[:width] += z.T @ z
            total[width] += z.sum(0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "v"])

    out = np.zeros((width + 1, width))
    for r in fit.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # width^2 rows
        out[r["i"], r["j"]] = r["v"]
    return out[width], out[:width]


# ------------------------------------------------------------------ spectrum of a symmetric matrix

@dataclass
class Factors:
    """P A P' = L D L' with pivots of one or two rows."""

    lower: np.ndarray
    pivots: list[tuple[int, np.ndarray]]
    order: np.ndarray

    def above(self) -> int:
        """Eigenvalues of A above zero (law of inertia); a pivot of two rows has one of each sign."""
        return sum(1 if len(d) == 2 else int(d[0, 0] > 0) for _, d in self.pivots)

    def solve(self, b: np.ndarray, least: float) -> np.ndarray:
        n, y = len(b), b[self.order].copy()
        for k in range(n):
            y[k + 1:] -= self.lower[k + 1:, k] * y[k]
        for k, d in self.pivots:
            if len(d) == 1:
                y[k] /= d[0, 0] if abs(d[0, 0]) > least else least
            else:
                y[k:k + 2] = np.linalg.solve(d, y[k:k + 2])
        for k in range(n - 1, -1, -1):
            y[k] -= self.lower[k + 1:, k] @ y[k + 1:]
        out = np.empty(n)
        out[self.order] = y
        return out


def factored(a: np.ndarray) -> Factors:
    a, n = a.copy(), len(a)
    lower, order, pivots, k = np.eye(n), np.arange(n), [], 0

    def swap(p: int, q: int) -> None:
        if p != q:
            for m in (a, a.T, lower[:, :k].T):
                m[..., [p, q]] = m[..., [q, p]]
            order[[p, q]] = order[[q, p]]

    while k < n:
        size = 1
        if k + 1 < n:
            column = np.abs(a[k + 1:, k])
            r = k + 1 + int(column.argmax())
            most = column[r - k - 1]
            if abs(a[k, k]) < ALPHA * most:
                row = np.abs(a[r, k:])
                row[r - k] = 0
                if abs(a[k, k]) * row.max() < ALPHA * most * most:
                    if abs(a[r, r]) >= ALPHA * row.max():
                        swap(k, r)
                    else:
                        swap(k + 1, r)
                        size = 2
        d = a[k:k + size, k:k + size].copy()
        pivots.append((k, d))
        rest = a[k + size:, k:k + size]
        if len(rest) and (size == 2 or d[0, 0] != 0):
            below = np.linalg.solve(d, rest.T).T
            lower[k + size:, k:k + size] = below
            a[k + size:, k + size:] -= below @ rest.T
        k += size
    return Factors(lower, pivots, order)


def above(v: np.ndarray, shift: float) -> int:
    return factored(v - shift * np.eye(len(v))).above()


def leading(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric positive semidefinite matrix, falling, and their unit vectors as columns.

    Values that are zero to working precision are left out.
    """
    n, scale = len(v), float(np.trace(v))
    eps = np.finfo(float).eps
    if not scale > 0:
        return np.zeros(0), np.zeros((n, 0))
    floor, slack = max(64, 4 * n) * eps * scale, 16 * eps * scale
    known = {floor: above(v, floor), scale * (1 + n * eps) + slack: 0}
    wanted = min(most, known[floor])
    values, vectors = [], []
    start = np.random.default_rng(0).standard_normal((n, n))
    while len(values) < wanted:
        k = len(values)
        while True:
            hi = min(s for s, c in known.items() if c <= k)
            lo = max(s for s, c in known.items() if c > k)
            inside = known[lo] - known[hi]
            if inside == 1 or hi - lo <= slack:
                break
            known[(lo + hi) / 2] = above(v, (lo + hi) / 2)
        if inside > 1:
            for x in together(v, (lo + hi) / 2, start[:, k:k + inside], slack, vectors)[:wanted - k]:
                values.append(float(x @ v @ x))
                vectors.append(x)
            continue
        e, x = quotient_iteration(v, lo, hi, start[:, k], slack)
        low, high = (0.0, 0.0) if e is None else (e - 2 * slack, e + 2 * slack)
        if e is None or not above(v, low) > k >= above(v, high):  # it went elsewhere, counts tell: halve the interval and try again
            known[(lo + hi) / 2] = above(v, (lo + hi) / 2)
            continue
        for before in vectors[-1:]:
            x = x - before * (before @ x) if abs(before @ x) > 1e-9 else x
        x /= np.linalg.norm(x)
        values.append(e)
        vectors.append(x)
        known |= {low: above(v, low)} if low > lo else {}
    return np.array(values), np.array(vectors).T.reshape(n, len(values))


def quotient_iteration(v: np.ndarray, lo: float, hi: float, x: np.ndarray, slack: float) -> tuple[float | None, np.ndarray]:
    """The one eigenpair with its value in (lo, hi], or None if the iteration leads elsewhere."""
    n = len(v)
    at = (lo + hi) / 2
    x = x / np.linalg.norm(x)
    for step in range(60):
        y = factored(v - at * np.eye(n)).solve(x, slack / 16)
        x = y / np.linalg.norm(y)
        e = float(x @ v @ x)
        if not lo - slack <= e <= hi + slack:
            if step > 8:
                return None, x
            continue  # keep the shift: one more inverse iteration draws the vector to this interval's
        if np.linalg.norm(v @ x - e * x) <= slack:
            y = factored(v - e * np.eye(n)).solve(x, slack / 16)  # one step more, for the vector
            y /= np.linalg.norm(y)
            return float(y @ v @ y), y
        at = e if step else at
    return None, x


def together(v: np.ndarray, at: float, start: np.ndarray, slack: float, before: list[np.ndarray]) -> list[np.ndarray]:
    """Orthonormal vectors of eigenvalues that no shift tells apart, by inverse iteration of the whole block."""
    f, x = factored(v - at * np.eye(len(v))), start
    for _ in range(4):
        x = np.stack([f.solve(c, slack / 16) for c in x.T], 1)
        for b in before:
            x -= np.outer(b, b @ x)
        x = np.linalg.qr(x / np.linalg.norm(x, axis=0))[0]
    return list(x.T)


# ------------------------------------------------------------------ whitening

@dataclass
class Model:
    """Number of fitted vectors, their sums, components as columns, eigenvalues, trace, and how far whitened vectors are from unit covariance."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    error: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def centre(self) -> np.ndarray:
        return whole_centre(self.sums, self.n)

    @property
    def scaled(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    def rest(self) -> np.ndarray:
        """Mean less centre."""
        return (self.sums - self.n * self.centre) / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        y, r = x - self.centre, self.sums - self.n * self.centre
        most = self.n * int(np.abs(y).max(initial=0)) + int(np.abs(r).max(initial=0))
        if most * most * self.dims < 1 << 63:
            d = self.n * y - r
            return pa.array((d * d).sum(1))
        d = self.n * y.astype(object) - r.astype(object)
        return pa.array([int(t) if t < 1 << 63 else None for t in (d * d).sum(1)], pa.int64())


def whole_centre(sums: np.ndarray, n: int) -> np.ndarray:
    return (2 * sums + n) // (2 * n)


def fit(vectors: DataFrame, most: int = 16) -> Model | None:
    """Components of the distinct vectors of a table with one vector column; None if no row is usable."""
    rows = fit_list(vectors)
    found = rows.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    if found is None:
        return None
    dims, n = found["dims"], found["count"]
    rows = rows.where(F.col("dims") == dims)
    sums = column_sums(rows, dims)
    centre = whole_centre(sums, n)
    _, gram = products(rows, dims, centre, np.eye(dims))
    rest = (sums - n * centre) / n
    v = gram / n - np.outer(rest, rest)
    values, components = leading((v + v.T) / 2, most)
    model = Model(n, sums, components, values, float(np.trace(v)), 0.0)
    if len(values):
        s, g = products(rows, dims, centre, model.scaled)
        mean = s / n
        model.error = float(np.abs(g / n - np.outer(mean, mean) - np.eye(len(values))).max())
    return model


WHITENED = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, most: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each usable row and component."""
    rows = table.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c"))
    model = fit(rows.select("c"), most)
    if model is None or not len(model.values):
        return table.sparkSession.createDataFrame([], WHITENED)
    k, rest, scaled, centre = len(model.values), model.rest(), model.scaled, model.centre

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, _, x = whole_vectors(batch.column(1), model.dims)
            x = x.reshape(len(kept), model.dims)
            w = ((x - centre).astype(np.float64) - rest) @ scaled
            each = pa.array(np.repeat(np.arange(len(kept)), k))
            columns = [batch.column(0).take(pa.array(kept)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(kept))),
                       pa.array(np.full(len(each), model.n, np.int64)), model.deviations(x).take(each), pa.array(w.ravel()),
                       pa.array(np.tile(model.values / model.trace, len(kept))), pa.array(np.full(len(each), model.error))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in WHITENED.split(", ")])

    return rows.mapInArrow(run, WHITENED)

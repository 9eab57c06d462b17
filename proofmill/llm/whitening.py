"""Whitening of embeddings: streaming covariance, merged over partitions, and a symmetric QR eigen-solve.

Every partition reads its vectors once and keeps a count, a mean and a matrix of products, to which each vector adds a
rank-one term (Welford). States of partitions are merged sixteen at a time in tasks, by the parallel update formula, until
one is left for each length of vectors; a task then reduces the covariance to a tridiagonal matrix by Householder reflections
and that to its eigenvalues by QR steps with implicit shifts. Only the components reach the driver, 16 rows of a vector's
length each.

Vectors are whole numbers x = floor(64 c) + 1000000 for entries c; c is held within 2^47 either way, so that double precision
is exact. Rows whose vector is null or has null or non-finite entries go. Vectors of different lengths are fitted apart, each
length with its own n and components; empty vectors have no component. Repeated vectors count once in the fit, and each row
gets its values; ids may be null or repeat. Where a component has no variance (fewer different vectors than components),
explained is 0 and whitened null, and the identity is judged without it. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, SHIFT, MOST, FAN = 64, 1_000_000, 2.0**47, 16
#: Eigenvalues below this share of the largest are rounding errors of none.
NONE = 1e-12


class State:
    """Count, mean and sum of outer products about the mean of the vectors seen."""

    def __init__(self, dim: int) -> None:
        self.n, self.mean, self.m2, self.buffer = 0, np.zeros(dim), np.zeros((dim, dim)), np.empty((dim, dim))

    def add(self, y: np.ndarray) -> None:
        self.n += 1
        away = y - self.mean
        self.mean += away / self.n
        self.m2 += np.multiply.outer(away, y - self.mean, out=self.buffer)

    def merge(self, n: int, mean: np.ndarray, m2: np.ndarray) -> None:
        total, away = self.n + n, mean - self.mean
        self.m2 += m2 + np.multiply.outer(away, away) * (self.n * n / total)
        self.mean += away * (n / total)
        self.n = total


def vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of a column of arrays, for each length in it."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield int(dim), rows, flat[(ends[rows] - dim)[:, None] + np.arange(dim)]


STATE = "part long, dim long, n long, mean binary, m2 binary, sums array<string>"


def states(rows: DataFrame, components: dict[int, "Components"] | None = None) -> DataFrame:
    """One row of STATE for each partition and length: of the vectors, or of what components make of them."""
    schema = pa.schema([("part", pa.int64()), ("dim", pa.int64()), ("n", pa.int64()), ("mean", pa.binary()), ("m2", pa.binary()), ("sums", pa.list_(pa.string()))])

    def run(it):
        held: dict[int, State] = {}
        sums: dict[int, np.ndarray] = {}
        for b in it:
            for dim, _, x in vectors(b.column(0)):
                y = x - SHIFT
                seen = components[dim].whiten(y)[0] if components else y.astype(float)
                if dim not in held:
                    held[dim], sums[dim] = State(seen.shape[1]), np.zeros(dim, object)
                for v in seen:
                    held[dim].add(v)
                # in two halves, so that no sum leaves 64 bits
                sums[dim] = sums[dim] + (y >> 24).sum(0).astype(object) * (1 << 24) + (y & ((1 << 24) - 1)).sum(0).astype(object)
        part = TaskContext.get().partitionId()
        for dim, s in held.items():
            yield pa.RecordBatch.from_pylist([{"part": part, "dim": dim, "n": s.n, "mean": s.mean.tobytes(), "m2": s.m2.tobytes(), "sums": [str(i) for i in sums[dim]]}], schema)

    return rows.mapInArrow(run, STATE)


def merged(found: DataFrame) -> DataFrame:
    """One state for each length: FAN states meet in a task, then FAN of what these leave, and so on."""

    def meet(group):
        group = group.sort_values("part")
        first = group.iloc[0]
        dim = len(first["mean"]) // 8
        state, sums = State(dim), np.zeros(len(first["sums"]), object)
        for row in group.itertuples():
            sums = sums + np.array([int(i) for i in row.sums], object)
            mean, m2 = np.frombuffer(row.mean), np.frombuffer(row.m2).reshape(dim, dim)
            state.merge(row.n, mean, m2)
        out = group.iloc[:1].copy()
        out["part"], out["n"], out["mean"], out["m2"] = first["part"] // FAN, state.n, state.mean.tobytes(), state.m2.tobytes()
        out["sums"] = [[str(i) for i in sums]]
        return out

    found = stored(found, "states")
    most = found.agg(F.max("part")).first()[0] or 0
    while True:
        found = stored(found.groupBy("dim", F.floor(F.col("part") / FAN)).applyInPandas(lambda group: meet(group), STATE), "states")
        if most < FAN:
            return found
        most //= FAN


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, second diagonal and reflections' product q of a symmetric matrix a = q t q'."""
    a, d = a.copy(), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if not size:
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows of a symmetric matrix, by QR steps with Wilkinson's shift."""
    diag, off, q = tridiagonal(a)
    vectors = q.T.copy()  # rows are rotated, as they lie together in memory
    hi, eps = len(diag) - 1, np.finfo(float).eps
    while hi > 0:
        small = np.abs(off[:hi]) <= eps * (np.abs(diag[:hi]) + np.abs(diag[1 : hi + 1]))
        off[:hi][small] = 0
        if off[hi - 1] == 0:
            hi -= 1
            continue
        zeros = np.flatnonzero(off[:hi] == 0)
        lo = zeros[-1] + 1 if len(zeros) else 0
        half, b = (diag[hi - 1] - diag[hi]) / 2, off[hi - 1]
        shift = diag[hi] - b * b / (half + np.copysign(np.hypot(half, b), half))
        x, z = diag[lo] - shift, off[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                off[k - 1] = r
            p, e, w = diag[k], off[k], diag[k + 1]
            diag[k] = c * c * p + 2 * c * s * e + s * s * w
            diag[k + 1] = s * s * p - 2 * c * s * e + c * c * w
            off[k] = c * s * (w - p) + (c * c - s * s) * e
            if k < hi - 1:
                x, z = off[k], s * off[k + 1]
                off[k + 1] *= c
            vectors[k : k + 2] = np.array([[c, s], [-s, c]]) @ vectors[k : k + 2]
    order = np.argsort(-diag, kind="stable")
    return diag[order], vectors[order]


@dataclass
class Components:
    """The fit of one length: count, exact sums of x - SHIFT, eigenvectors by falling eigenvalue."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    def whiten(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whitened values of the components that have a variance, and which these are."""
        real = self.values > NONE * max(self.values.max(initial=0.0), np.finfo(float).tiny)
        mean = np.array([s / self.n for s in self.sums])
        return (y - mean) @ self.vectors[real].T / np.sqrt(self.values[real]), real

    def deviation(self, y: np.ndarray) -> pa.Array:
        """The exact sums of squares of n x - S, null beyond 38 digits."""
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most * most * max(1, len(self.sums)) < 1 << 63:
            away = self.n * y - np.array(self.sums, np.int64)
            return pa.array((away * away).sum(1)).cast(pa.decimal128(38, 0))
        from decimal import Decimal

        away = self.n * y.astype(object) - np.array(self.sums, object)
        return pa.array([Decimal(int(v)) if v < 10**38 else None for v in (away * away).sum(1)], pa.decimal128(38, 0))


def integers(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, x) of the rows that count."""
    finite = lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))
    whole = lambda c: F.floor(F.least(F.greatest(c.cast("double"), F.lit(-MOST)), F.lit(MOST)) * SCALE) + SHIFT
    return embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("e")).where(F.forall("e", finite)).select("id", F.transform("e", whole).alias("x"))


def fit(rows: DataFrame, most: int = 16) -> dict[int, Components]:
    """The components of the different vectors among rows (id, x), for each length."""
    different = stored(rows.select("x").distinct(), "vectors")

    def solve(it):
        for frame in it:
            for row in frame.itertuples():
                dim = len(row.mean) // 8
                v = np.frombuffer(row.m2).reshape(dim, dim) / row.n
                values, found = eigen((v + v.T) / 2) if dim else (np.zeros(0), np.zeros((0, 0)))
                frame.loc[row.Index, "m2"] = np.concatenate([found[:most].ravel(), np.maximum(values[:most], 0), [np.trace(v)]]).tobytes()
            yield frame

    out = {}
    for row in stored(merged(states(different)).mapInPandas(solve, STATE), "components").collect():
        flat = np.frombuffer(row.m2)
        k = min(most, row.dim)
        out[row.dim] = Components(row.n, [int(i) for i in row.sums], flat[: k * row.dim].reshape(k, row.dim), flat[k * row.dim : -1], float(flat[-1]))
    for row in merged(states(different, out)).collect():
        k = len(row.mean) // 8
        apart = np.abs(np.frombuffer(row.m2).reshape(k, k) / row.n - np.eye(k))
        out[row.dim].identity_error = float(apart.max(initial=0.0))
    return out


def whitened(rows: DataFrame, components: dict[int, Components]) -> DataFrame:
    """A row for each row (id, x) and component: n, deviation, whitened, explained, identity_error."""
    names = ("id", "component", "n", "deviation", "whitened", "explained", "identity_error")

    def run(it):
        for b in it:
            for dim, at, x in vectors(b.column(1)):
                model, y = components[dim], x - SHIFT
                k, m = len(model.values), len(at)
                found, real = model.whiten(y)
                values, known = np.zeros((m, k)), np.broadcast_to(real, (m, k)).ravel()
                values[:, real] = found
                each = np.repeat(np.arange(m), k)
                share = np.where(real, model.values, 0.0) / model.trace if model.trace else np.zeros(k)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(at)).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                        model.deviation(y).take(pa.array(each)), pa.array(values.ravel(), mask=~known), pa.array(np.tile(share, m)), pa.array(np.full(m * k, model.identity_error)),
                    ],
                    names=list(names),
                )

    return rows.select("id", "x").mapInArrow(run, "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")

"""Whitening of embeddings by a covariance of two passes.

Entries become integers x = floor(64 c) + 1000000. The fit list has each distinct x vector once and is a written table.
The first pass adds up integers exactly and gives the mean; the second centres each vector before it is multiplied and adds
outer products by one matrix product a batch. Each task hands on one matrix, and treeAggregate merges these in two levels,
so that the driver gets about the square root of the tasks' number of them. The driver keeps a matrix of d x d numbers for
vectors of length d, whatever the rows, and solves it by LAPACK; the projection (d x 16) goes to all tasks. A third pass
over the fit list measures how far the covariance of what was whitened is from the identity.

Defined cases: vectors null, or holding null, NaN or infinity, take no part, nor do empty ones and those of another length
than most (of equally many, the longer); entries beyond 6e16 count as that, so that x stays an integer of 64 bits; rows without a vec_id and rows
that repeat one are rows like others; components whose eigenvalue does not stand out of the rounding error by the
relative error of 0.0001 (a table of few distinct vectors) are left out; `deviation` is null where the exact number does
not fit a long; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.shared import batches_of, written

LIMIT = float(2**62)
TOLERANCE = 1e-4
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def entries(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x of the rows that take part."""
    whole = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    whole = whole.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))
    length = whole.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    held = lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), c * 64))
    x = F.transform("v", lambda c: F.floor(held(c)) + F.lit(1_000_000).cast("long"))
    return whole.where(F.size("v") == (length.d if length else 0)).select("vec_id", x.alias("x"))


def rows_of(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def merged(rows: DataFrame, make, each, width: int):
    """Sum of one array a task: `each` gives what a batch adds to it, `make` the empty array."""

    def run(batches):
        total = make()
        for batch in batches:
            total += each(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    dtype, shape = make().dtype, make().shape
    with batches_of(rows.sparkSession, max(1, 4_000_000 // width)):
        parts = rows.mapInArrow(run, "part binary").rdd
        return parts.treeAggregate(make(), lambda a, r: a + np.frombuffer(r.part, dtype).reshape(shape), lambda a, b: a + b)


@dataclass
class Whitener:
    """What was fitted: n, the exact sums, components as columns, their eigenvalues and shares of the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = float("nan")

    @property
    def whole(self) -> np.ndarray:
        """The mean without its fraction."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def fraction(self) -> np.ndarray:
        return np.array([s % self.n / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.fraction

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.axes / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2. Arithmetic modulo 2**64 is exact where the result fits; the rest is told by its size."""
        low = np.array([s & (2**64 - 1) for s in self.sums], np.uint64)
        y = x.astype(np.uint64) * np.uint64(self.n) - low
        out = (y * y).sum(1).astype(np.int64).tolist()
        about = (np.square(self.centred(x) * self.n)).sum(1)
        for i in np.flatnonzero(about > 2.0**62):
            exact = sum((self.n * int(v) - s) ** 2 for v, s in zip(x[i], self.sums))
            out[i] = exact if exact < 2**63 else None
        return out


def fit(x: DataFrame, most: int = 16) -> Whitener | None:
    """The first `most` components of a written table of distinct vectors `x`; None for an empty one."""
    first = x.first()
    if first is None:
        return None
    d, mask = len(first.x), np.int64(2**32 - 1)

    def halves(batch):
        v = rows_of(batch, d)
        return np.array([np.full(d, len(v)), (v >> 32).sum(0), (v & mask).sum(0)], np.int64)

    n, high, low = merged(x, lambda: np.zeros((3, d), np.int64), halves, d).tolist()
    model = Whitener(n[0], [(a << 32) + b for a, b in zip(high, low)], np.zeros((d, 0)), np.zeros(0), np.zeros(0))

    def outer(batch):
        c = model.centred(rows_of(batch, d))
        return c.T @ c

    v = merged(x, lambda: np.zeros((d, d)), outer, d) / model.n
    values, axes = np.linalg.eigh((v + v.T) / 2)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    sound = values > max(values[0], 0) * d * np.finfo(float).eps / TOLERANCE
    model.values, model.axes = values[sound], np.ascontiguousarray(axes[:, sound])
    model.explained = model.values / np.trace(v) if sound.any() else model.values
    k = int(sound.sum())

    def moments(batch):
        w = model.whitened(rows_of(batch, d))
        return np.vstack([w.sum(0), w.T @ w])

    if k:
        total = merged(x, lambda: np.zeros((k + 1, k)), moments, d) / model.n
        model.identity_error = float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())
    return model


def project(rows: DataFrame, model: Whitener) -> DataFrame:
    """A row for each row of vec_id and x, and each component."""
    sent, k = rows.sparkSession.sparkContext.broadcast(model), len(model.values)

    def run(batches):
        m = sent.value
        d = len(m.sums)
        for batch in (b.slice(i, step) for b in batches for step in [max(1, 2_000_000 // d)] for i in range(0, len(b), step)):
            x = rows_of(batch, d)
            rep = np.repeat(np.arange(len(x)), k)
            columns = [
                batch.column("vec_id").take(pa.array(rep)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(rep), m.n)),
                pa.array(m.deviations(x), pa.int64()).take(pa.array(rep)),
                pa.array(m.whitened(x).reshape(-1)),
                pa.array(np.tile(m.explained, len(x))),
                pa.array(np.full(len(rep), m.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return rows.mapInArrow(run, RESULT)


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = 16) -> DataFrame:
    rows = entries(vectors, vec_id, vector)
    model = fit(written(rows.select("x").distinct(), "fit"), most)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], RESULT)
    return project(rows, model)

"""Whitening of embeddings by QDWH spectral divide and conquer.

Entries become fixed-point numbers x = floor(64 c) + 1000000, so counts and
sums are exact.  One pass gathers the sums, one the covariance (rows are
centred before they are multiplied); both are partial sums of each task, merged
by Spark, and their size depends on the dimension alone.  The components come
from :mod:`parley.llm.spectral`; the projection is broadcast and applied in one
narrow pass.  Nothing that grows with the rows leaves the executors.

Defined results: rows whose vector is null, empty, or holds a null or
non-finite entry are left out, as are entries of 2^46 and more, which do not fit
the fixed-point form, and vectors of another length than most (of equally many,
the longer ones stay).  Null ids, repeated rows and ties are rows like others.
Directions without variance (to rounding) cannot be whitened and are no
components; a table without rows, or with equal rows only, has none.
``deviation`` is null where the exact number does not fit a long.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import pieces
from parley.llm.spectral import EPS, leading_components

SCALE, OFFSET = 64, 1_000_000
LIMIT = float(1 << 46)
COMPONENTS = 32


def usable(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, v`` (array of doubles) of the rows that can be whitened."""
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LIMIT)))
    rows = rows.where(F.coalesce(good & (F.size("v") > 0), F.lit(False)))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (most["d"] if most else 0))


def fixed_point(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """Rows x dimensions of the fixed-point numbers."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return (np.floor(flat * SCALE).astype(np.int64) + OFFSET).reshape(batch.num_rows, -1)


@dataclass
class Whitening:
    """Fitted on ``n`` rows whose fixed-point numbers sum to ``sums``."""
    n: int
    sums: list[int]
    near: np.ndarray       # the whole number nearest to each mean
    rest: np.ndarray       # what the mean lies above it, below 1/2 in size
    values: np.ndarray     # eigenvalues, falling
    components: np.ndarray  # unit eigenvectors as columns
    explained: np.ndarray  # shares of the trace

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near).astype(float) - self.rest

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact."""
        off = [self.n * int(a) - s for a, s in zip(self.near, self.sums)]
        far = np.abs(x - self.near).max(initial=0) * float(self.n) + float(max(map(abs, off), default=0))
        if far * far * x.shape[1] < 2.0 ** 62:
            t = self.n * (x - self.near) + np.array(off, np.int64)
            return (t * t).sum(axis=1).tolist()
        sums = [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums)) for row in x.tolist()]
        return [s if s < 1 << 63 else None for s in sums]


def column_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the sum of each dimension."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in pieces(batches):
            n, total = n + batch.num_rows, total + fixed_point(batch, 0).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.full(len(total), n)), pa.array(total)],
                                             names=["i", "n", "total"])

    parts = rows.select("v").mapInArrow(add, "i int, n long, total long")
    found = sorted(parts.groupBy("i").agg(F.sum("n"), F.sum("total")).collect())  # a row a dimension
    return (found[0][1], [r[2] for r in found]) if found else (0, [])


def second_moments(rows: DataFrame, of, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products of what ``of`` makes of the fixed-point rows:
    each task adds up its own, Spark adds up the tasks."""
    at, to = (x.astype(np.int32) for x in np.triu_indices(size))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products, n = np.zeros(size), np.zeros((size, size)), 0
        for batch in pieces(batches):
            d = of(fixed_point(batch, 0))
            total, products, n = total + d.sum(axis=0), products + d.T @ d, n + len(d)
        if n:
            i = np.concatenate([at, np.full(size, -1, np.int32)])
            j = np.concatenate([to, np.arange(size, dtype=np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.concatenate([products[at, to], total]))], names=["i", "j", "x"])

    found = rows.select("v").mapInArrow(add, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    i, j, x = (found.column(k).to_numpy() for k in range(3))
    total, products = np.zeros(size), np.zeros((size, size))
    total[j[i < 0]] = x[i < 0]
    i, j, x = i[i >= 0], j[i >= 0], x[i >= 0]
    products[i, j] = products[j, i] = x
    return total, products


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Learn from all ``rows`` (of :func:`usable`)."""
    n, sums = column_sums(rows)
    near = [(2 * s + n) // (2 * n) for s in sums] if n else []
    rest = [(s - n * a) / n for s, a in zip(sums, near)]
    empty = Whitening(n, sums, np.array(near, np.int64), np.array(rest), np.zeros(0), np.zeros((len(sums), 0)), np.zeros(0))
    if not n:
        return empty
    _, products = second_moments(rows, empty.centred, len(sums))
    covariance = products / n
    values, vectors = leading_components(covariance, components)
    some = values > len(sums) * EPS * max(values[0], 0.0)
    return Whitening(n, sums, empty.near, empty.rest, values[some], vectors[:, some], values[some] / np.trace(covariance))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened rows minus the identity."""
    k = len(model.values)
    if not k:
        return 0.0
    shared = rows.sparkSession.sparkContext.broadcast(model)
    # The sums give the mean, which is 0 up to rounding; the second pass takes it off before multiplying.
    mean = second_moments(rows, lambda x: shared.value.project(x), k)[0] / model.n
    products = second_moments(rows, lambda x: shared.value.project(x) - mean, k)[1]
    return float(np.abs(products / model.n - np.eye(k)).max())


def whiten(rows: DataFrame, model: Whitening, id_type: str = "long") -> DataFrame:
    """``id, deviation, whitened`` of each row: the exact squared distance from
    the mean, times n squared, and an entry for each component."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in pieces(batches):
            x = fixed_point(batch, 1)
            w = own.project(x)
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.deviations(x), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))],
                                             names=["id", "deviation", "whitened"])

    return rows.mapInArrow(apply, f"id {id_type}, deviation long, whitened array<double>")


def whitened_embeddings(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, n, deviation, whitened, explained, identity_error``: a row for
    each usable row of ``embeddings``, with arrays over the components."""
    rows = usable(embeddings, id_col, vec_col)
    model = fit(rows, components)
    error = identity_error(rows, model)
    out = whiten(rows, model, embeddings.schema[id_col].dataType.simpleString())
    return out.select(F.col("id").alias(id_col), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                      F.array(*[F.lit(float(e)) for e in model.explained]).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))

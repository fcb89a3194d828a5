"""Embedding whitening by shifted CholeskyQR (operator 12).

The centred rows A (one for each vector) are orthogonalised by passes over the data. Each pass solves the rows against
the triangular factors so far, Q = A / R1 / R2 ..., and sums the Gram matrix of Q, a matrix for each task and no row
more. Its Cholesky factor joins the list. The first Gram matrix, and any that rounding has made indefinite, gets a shift
that is as large as its rounding error, so ill-conditioned and even dependent columns pass. Passes end when the Gram
matrix is the identity. A = Q R with R the product of the factors, so the singular values and right vectors of R, a
matrix of width x width, are those of A: components and their variances, without a covariance matrix whose condition is
the square.

The vectors are read once for the sums, once for each pass, once for the check and once for the result. Only matrices of
width x width come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.search import matrix

UNIT = 2.0**-53
#: Components whose deviation is below this share of the largest one's have no variance but rounding.
LEAST_SHARE = 1e-12


def finite(x: Column) -> Column:
    """Whether an array of doubles is not null and holds only finite numbers."""
    return x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def whole_numbers(vectors: DataFrame, vec_id: str, embedding: str, scale: int, offset: int) -> DataFrame:
    """vec_id, x: floor(scale * c) + offset of each component as long, of the rows whose vector is sound."""
    c = F.transform(embedding, lambda v: v.cast("double"))
    return vectors.where(finite(c)).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(c, lambda v: F.floor(v * scale) + offset).alias("x"))


@dataclass
class Moments:
    """Number of rows and the exact sum, least and largest value of each dimension."""

    n: int
    sums: list[int]
    low: list[int]
    high: list[int]

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: int64 where it fits, Python integers elsewhere."""
        most = max([self.n * max(abs(a), abs(b)) for a, b in zip(self.low, self.high, strict=True)], default=0)
        if most < 2**61:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.numerators(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)**2, exact; an error beyond a long."""
        far = self.numerators(x)
        if far.dtype != object and float(np.abs(far).max(initial=0)) ** 2 * max(1, far.shape[1]) >= 2.0**62:
            far = far.astype(object)
        return (far * far).sum(axis=1).tolist()


def moments(rows: DataFrame, width: int) -> Moments:
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, low, high = 0, [0] * width, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(0), width)
            n += len(x)
            exact = x if float(np.abs(x).max(initial=0)) * len(x) < 2.0**62 else x.astype(object)
            sums = [a + int(b) for a, b in zip(sums, exact.sum(axis=0), strict=True)]
            low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
            high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if n:
            columns = [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(list(map(Decimal, sums)), pa.decimal128(38, 0)), pa.array(low), pa.array(high)]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "n", "s", "low", "high"])

    parts = rows.select("x").mapInArrow(of_batches, "at int, n long, s decimal(38,0), low long, high long")
    found = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("at").collect()
    return Moments(found[0]["n"] if found else 0, [int(r["s"]) for r in found], [r["low"] for r in found], [r["high"] for r in found])


def divided(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows / factor, an upper triangle: column after column."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def gram(rows: DataFrame, known: Moments, factors: list[np.ndarray], mapped: np.ndarray | None = None) -> np.ndarray:
    """The Gram matrix of the centred rows after division by the factors, or after multiplication by `mapped`."""
    width = len(known.sums)
    size = width if mapped is None else mapped.shape[1]
    upper = np.triu_indices(size)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            q = known.centred(matrix(batch.column(0), width))
            for factor in factors:
                q = divided(q, factor)
            if mapped is not None:
                q = q @ mapped
            total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array([total[upper]], pa.list_(pa.float64()))], names=["part"])

    parts = rows.select("x").mapInArrow(of_batches, "part array<double>").select(F.posexplode("part").alias("at", "value"))
    found = parts.groupBy("at").agg(F.sum("value").alias("value")).toArrow()  # a row for each entry of the matrix
    flat = np.zeros(len(upper[0]))
    flat[found["at"].to_numpy()] = found["value"].to_numpy()
    out = np.zeros((size, size))
    out[upper] = flat
    return out + np.triu(out, 1).T


def shifted_factor(total: np.ndarray, n: int, shift: bool) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix of n rows; with a shift if asked for, or if it is not definite."""
    width = len(total)
    norm = float(np.linalg.eigvalsh(total)[-1])
    if not shift:
        try:
            return np.linalg.cholesky(total).T
        except np.linalg.LinAlgError:
            pass
    by = 11 * (n * width + width * (width + 1)) * UNIT * norm
    return np.linalg.cholesky(total + max(min(by, norm), 1e-300) * np.eye(width)).T


@dataclass
class Whitening:
    """What is fitted: moments, components (unit columns by falling variance), their variances and shares of the trace."""

    known: Moments
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    passes: int

    def map(self) -> np.ndarray:
        """What centred rows are multiplied by."""
        return self.components / np.sqrt(self.variances)


def fit(rows: DataFrame, width: int, most: int, max_passes: int = 6) -> Whitening | None:
    """None if there are no rows or no variance. rows: column x, arrays of `width` longs."""
    known = moments(rows, width)
    if not known.n:
        return None
    factors: list[np.ndarray] = []
    while True:
        total = gram(rows, known, factors)
        if not factors and not np.trace(total) > 0:
            return None
        even = np.abs(total - np.eye(width)).max() < 1e-13 * max(8, width)
        if factors and (even or len(factors) == max_passes):
            break
        factors.append(shifted_factor(total, known.n, shift=not factors))
    product = np.eye(width)
    for factor in factors:
        product = factor @ product
    if not even:  # dependent columns: Q is no identity in directions without variance, so its own root joins in
        values, turned = np.linalg.eigh(total)
        product = np.sqrt(np.maximum(values, 0))[:, None] * turned.T @ product
    _, deviations, right = np.linalg.svd(product)
    real = int((deviations > LEAST_SHARE * deviations[0]).sum())
    components = right[: min(most, real)].T
    components = components * np.sign(components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])])
    variances = deviations**2 / known.n
    return Whitening(known, components, variances[: components.shape[1]], variances[: components.shape[1]] / variances.sum(), len(factors))


def whiten(vectors: DataFrame, most: int = 8, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: for each row whose vector is sound
    and each of the first `most` principal components of x = floor(scale * c) + offset.

    deviation: the exact sum of (n * x - S)**2 over the dimensions, S the sums of n vectors; whitened: x - S / n on the
    component, divided by its deviation; explained: the component's share of all variance; identity_error: the largest
    entry of the covariance of all whitened columns less the identity. Components without variance are left out, so
    there are fewer of them than `most` for narrow or dependent data, and no rows where all vectors are equal or none is
    left. Vectors null or with a null, NaN or infinite entry take no part; shorter vectors count as padded with zeros.
    Repeated rows count as often as they occur, a null vec_id keeps its rows, other columns are not read. A deviation
    beyond a long is an error.
    """
    rows = whole_numbers(vectors, vec_id, embedding, scale, offset)
    size = rows.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    width = size["most"] or 0
    if size["least"] != size["most"]:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(offset).cast("long"), F.lit(width) - F.size("x"))))
    found = fit(rows, width, most) if width else None
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    known, mapped = found.known, found.map()
    count = mapped.shape[1]
    error = float(np.abs(gram(rows, known, [], mapped) / known.n - np.eye(count)).max())

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width)
            at = np.repeat(np.arange(len(x)), count)
            columns = [
                batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), known.n)), pa.array(known.deviations(x), pa.int64()).take(pa.array(at)),
                pa.array((known.centred(x) @ mapped).ravel()), pa.array(np.tile(found.explained, len(x))), pa.array(np.full(len(at), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(of_batches, schema)

"""Whitening of vectors from exact variances of dimensions and of sums of two dimensions.

An entry ``c`` counts as the integer ``x = floor(1024 c) + 100000``. Covariances come from variances
alone, by polarisation: ``2 cov(i, j) = var(x_i + x_j) - var(x_i) - var(x_j)``. Three passes:

1. ``n`` and, per dimension, the sum ``S``.
2. Per dimension and per sum of two, the total of squared centred values. Tasks centre on the whole
   part of the mean, ``m = S div n``, so the numbers squared are small integers; the part of the mean
   that is left, ``r = S - n m``, is put in exactly: ``sum (n x - S)^2 = n^2 sum (x - m)^2 - n r^2``,
   as ``sum (x - m) = r``. Each task hands on one row per pair; their totals are decimals.
3. The variances, whole numbers over ``n^2``, give the covariance matrix, rounded once per entry, and
   ``eigh`` its components. Each row is centred, projected and scaled; the covariance of what comes
   out is measured over all rows again.

The driver holds one number per pair of dimensions and the components, whatever the number of rows.

Defined results: vectors that are null or hold a null or non-finite entry take no part; nor do those
of another length than most of the others have (of equally many, the longest), or of length 0. Null
and repeated ids are rows like all others. A component without variance (its share of the trace is
below 1e-14) has ``whitened`` 0 and is left out of ``identity_error``. Entries beyond the range of a
long count as its end. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import settle

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Rows that a task works on at a time.
BLOCK = 2048
#: Integers up to here can be squared and summed over a block as longs.
SMALL = 1 << 24
#: Shares of the trace below this are no variance.
NOTHING = 1e-14
_EDGE = float(2**62)


def usable(vector: Column) -> Column:
    """Not null, not empty, every entry a finite number."""
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))


def fit_list(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id, v`` of the rows that take part, and their length."""
    kept = vectors.where(usable(F.col("embedding"))).select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    top = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = top["d"] if top else 0
    return kept.where(F.size("v") == dims), dims


def whole(values: np.ndarray) -> np.ndarray:
    """Entries as integers."""
    return np.clip(np.floor(values * SCALE), -_EDGE, _EDGE).astype(np.int64) + SHIFT


def centred(x: np.ndarray, middle: list[int]) -> tuple[np.ndarray, int]:
    """``x - middle`` and its largest size: longs where they are small enough to be squared, else Python's integers."""
    y = x.astype(object) - np.array(middle, object) if max(map(abs, middle), default=0) >= SMALL or np.abs(x).max(initial=0) >= SMALL else x - np.array(middle, np.int64)
    return y, int(abs(y).max(initial=0))


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, whole(part.column("v").flatten().to_numpy().reshape(-1, dims))


def _as_rows(totals: dict[tuple[int, int], int]) -> pa.RecordBatch:
    """Exact totals as text, for a decimal."""
    return pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in totals], pa.int32()), pa.array([j for _, j in totals], pa.int32()), pa.array([str(x) for x in totals.values()])], ["i", "j", "total"]
    )


PARTIAL = "i int, j int, total string"


def _summed(rows: DataFrame, run: Callable) -> dict[tuple[int, int], int]:
    """Totals over all tasks by pair; as many as pairs of dimensions."""
    totals = rows.select("v").mapInArrow(run, PARTIAL).groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return {(r["i"], r["j"]): int(r["total"]) for r in totals.collect()}


def _sums(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for _, x in _blocks(batches, dims):
            n += len(x)
            # in two halves, so that a block of any longs adds up exactly
            high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
            sums = [s + (h << 32) + w for s, h, w in zip(sums, high, low)]
        yield _as_rows({(-1, -1): n} | {(i, i): s for i, s in enumerate(sums)})

    return run


def _squares(dims: int, middle: list[int]):
    """Squared centred values of every dimension ``(i, i)`` and of every sum of two ``(i, j)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(dims - i, object) for i in range(dims)]
        for _, x in _blocks(batches, dims):
            columns = np.ascontiguousarray(centred(x, middle)[0].T)
            for i in range(dims):
                both = columns[i:] + columns[i]
                both[0] = columns[i]
                totals[i] = totals[i] + (both * both).sum(1).astype(object)
        yield _as_rows({(i, i + k): int(t) for i in range(dims) for k, t in enumerate(totals[i])})

    return run


class Whitening:
    """Mean, exact centred squares and components of a fit list."""

    def __init__(self, rows: DataFrame, dims: int, most: int = COMPONENTS):
        sums = _summed(rows, _sums(dims))
        self.n, self.dims = sums.pop((-1, -1), 0), dims
        self.sums = [sums[i, i] for i in range(dims)] if self.n else [0] * dims
        if not self.n:
            return
        n = self.n
        self.middle = [s // n for s in self.sums]
        self.left = [s - n * m for s, m in zip(self.sums, self.middle)]
        squares = _summed(rows, _squares(dims, self.middle))
        # n^2 times the variance of each dimension and each sum of two, as whole numbers
        own = [n * squares[i, i] - self.left[i] ** 2 for i in range(dims)]
        cov = np.empty((dims, dims))
        for i in range(dims):
            cov[i, i] = Fraction(own[i], n * n)
            for j in range(i + 1, dims):
                both = n * squares[i, j] - (self.left[i] + self.left[j]) ** 2
                cov[i, j] = cov[j, i] = Fraction(both - own[i] - own[j], 2 * n * n)
        self.covariance = cov
        values, components = np.linalg.eigh(cov)
        order = np.argsort(-values, kind="stable")[:most]
        trace = float(Fraction(sum(own), n * n))
        self.values, self.components = np.maximum(values[order], 0.0), components[:, order]
        self.explained = self.values / trace if trace else np.zeros(len(order))
        self.real = self.explained > NOTHING
        self.scale = np.where(self.real, 1 / np.sqrt(np.where(self.real, self.values, 1)), 0.0)

    def apply(self, rows: DataFrame) -> DataFrame:
        """``vec_id, deviation decimal, w``: squared distance from the mean, times n squared, and the whitened values."""
        n, dims, middle, left, scale = self.n, self.dims, self.middle, self.left, self.components * self.scale
        rest = np.array([r / n for r in left])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, x in _blocks(batches, dims):
                y, size = centred(x, middle)
                if dims * (n * (size + 1)) ** 2 >= 1 << 62:
                    y = y.astype(object)
                far = n * y - np.array(left, y.dtype)
                w = (y.astype(np.float64) - rest) @ scale
                lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array([str(d) for d in (far * far).sum(1)]), lists], ["vec_id", "deviation", "w"])

        kind = rows.schema["vec_id"].dataType.simpleString()
        return rows.mapInArrow(run, f"vec_id {kind}, deviation string, w array<double>").withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))

    def identity_error(self, whitened: DataFrame) -> float:
        """Largest entry of the covariance of ``w`` over all rows, less the identity."""
        real = [k for k, r in enumerate(self.real) if r]
        pairs = [(a, b) for a in real for b in real if a <= b]
        if not pairs:
            return 0.0
        found = whitened.agg(*[F.covar_pop(F.col("w")[a], F.col("w")[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
        return max(abs(found[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per row and component."""
    rows, dims = fit_list(vectors)
    rows = settle(rows, "fit")
    fitted = Whitening(rows, dims, most)
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    if not fitted.n:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    whitened = settle(fitted.apply(rows), "whitened")
    error = fitted.identity_error(whitened)
    shares = F.array(*[F.lit(float(e)) for e in fitted.explained])
    long = whitened.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return long.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("k")].alias("explained"), F.lit(error).alias("identity_error"),
    )

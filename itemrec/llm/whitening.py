"""Whitening of embeddings: leading components by Chebyshev-filtered subspace iteration.

The covariance is never formed. Every step is a pass over the table that adds up, in the tasks, what the
centred rows make of a thin block of directions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemrec.llm.common import arrow_schema, as_batch, bound_batches, named
from itemrec.runtime import store

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Directions iterated beside the wanted ones: the gap to the first that is left out sets the speed.
SPARE = 16
#: Steps of the short recurrence that bounds the spectrum from below.
BOUND_STEPS = 16
#: Degree of one filter at most, and how much more it may raise the first direction than the last wanted one.
MAX_DEGREE, MAX_SPREAD = 12, 1e8
#: Residual, over the largest eigenvalue, at which components are certified; iteration goes on while it still halves.
CERTIFIED, MAX_FILTERS = 1e-12, 60
RESULT = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def usable(vector: Column) -> Column:
    """The vector is there and all of its entries are finite."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def summed(table: DataFrame, fn: Callable[[np.ndarray], np.ndarray], width: int, shape: tuple[int, int], dtype: type = np.float64) -> np.ndarray:
    """The sum of ``fn`` over blocks of rows: within a task first, then row by row of the matrix by a grouped sum."""
    kind = "double" if dtype is np.float64 else "bigint"
    schema = f"row int, sums array<{kind}>"
    out = arrow_schema(schema)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(shape, dtype)
        for batch in batches:
            if batch.num_rows:
                sums += fn(_matrix(batch, width))
        yield as_batch({"row": np.arange(shape[0]), "sums": list(sums)}, out)

    bound_batches(table.sparkSession)
    totals = [F.sum(F.get("sums", F.lit(i))).alias(f"c{i}") for i in range(shape[1])]
    found = np.zeros(shape, dtype)
    for r in table.select("x").mapInArrow(total, schema).groupBy("row").agg(*totals).collect():
        found[r[0]] = r[1:]
    return found


class Covariance:
    """The covariance of a table of long vectors ``x``, known by what it makes of directions."""

    def __init__(self, table: DataFrame, n: int, width: int):
        self.table, self.n, self.width = table, n, width
        sums = summed(table, lambda x: x.sum(axis=0)[:, None], width, (width, 1), np.int64)[:, 0]
        #: The mean is ``whole + rest / n``, exactly.
        self.whole = sums // n
        self.rest = sums - n * self.whole
        self.passes = 0

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        whole, part = self.whole, self.rest / self.n
        return lambda x: (x - whole) - part

    def trace(self) -> float:
        centre = self.centred()
        return float(summed(self.table, lambda x: (centre(x) ** 2).sum(axis=0)[:, None], self.width, (self.width, 1)).sum()) / self.n

    def times(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block of directions, by one pass over the centred rows."""
        centre = self.centred()

        def product(x: np.ndarray) -> np.ndarray:
            y = centre(x)
            return y.T @ (y @ block)

        self.passes += 1
        return summed(self.table, product, self.width, block.shape) / self.n


def lower_bound(covariance: Covariance, random: np.random.Generator) -> float:
    """An estimate, from below, of the least eigenvalue, by a few steps of the Lanczos recurrence."""
    basis = [random.standard_normal(covariance.width)]
    basis[0] /= np.linalg.norm(basis[0])
    diagonal, beside = [], []
    for _ in range(min(BOUND_STEPS, covariance.width)):
        v = covariance.times(basis[-1][:, None])[:, 0]
        diagonal.append(float(v @ basis[-1]))
        for b in (*basis, *basis):
            v = v - (v @ b) * b
        beside.append(float(np.linalg.norm(v)))
        if beside[-1] <= 1e-12 * max(diagonal):
            break
        basis.append(v / beside[-1])
    values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside[: len(diagonal) - 1], 1) + np.diag(beside[: len(diagonal) - 1], -1))
    return max(0.0, float(values[0] - beside[-1] * abs(vectors[-1, 0])))


def _growth(x: float, degree: int) -> float:
    """The Chebyshev polynomial of ``degree`` at ``x`` >= 1."""
    return float(np.cosh(degree * np.arccosh(max(x, 1.0))))


def chebyshev(covariance: Covariance, block: np.ndarray, product: np.ndarray, values: np.ndarray, wanted: int, low: float) -> np.ndarray:
    """``block`` after a filter that damps the spectrum between ``low`` and the least of ``values``.

    ``product`` is the covariance times ``block``. The recurrence is scaled by its value at the largest eigenvalue.
    """
    high = max(float(values[-1]), low + 1e-9 * float(values[0]))
    centre, half = (high + low) / 2, (high - low) / 2
    first, last = (float(values[0]) - centre) / half, (float(values[wanted - 1]) - centre) / half
    degree = MAX_DEGREE
    while degree > 2 and _growth(first, degree) > MAX_SPREAD * _growth(last, degree):
        degree -= 1
    sigma = ratio = 1 / first
    before, now = block, (product - centre * block) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / ratio - sigma)
        before, now = now, (covariance.times(now) - centre * now) * (2 * following / half) - sigma * following * before
        sigma = following
    return now


def components(covariance: Covariance, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(directions as columns, eigenvalues, residual) of the ``wanted`` largest eigenvalues, certified by their residual."""
    random = np.random.default_rng(seed)
    width = min(covariance.width, wanted + SPARE)
    low = lower_bound(covariance, random) if width < covariance.width else 0.0
    block = np.linalg.qr(random.standard_normal((covariance.width, width)))[0]
    last = np.inf
    for _ in range(MAX_FILTERS):
        product = covariance.times(block)
        small = block.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, product = block @ turn, product @ turn
        largest = max(float(values[0]), np.finfo(float).tiny)
        residual = float(np.linalg.norm(product - block * values, axis=0)[:wanted].max()) / largest
        if residual <= CERTIFIED and (residual > last / 2 or residual <= 1e-15):
            return block[:, :wanted], values[:wanted], residual
        last = residual
        if width < covariance.width:
            block = np.linalg.qr(chebyshev(covariance, block, product, values, wanted, low))[0]
    raise ArithmeticError(f"components not certified: residual {last:.2e} after {covariance.passes} passes")


def _squares(x: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> list[int]:
    """Exact sums of (n x - S)^2 of each row, in 64 bits where they fit."""
    apart = x - whole
    if (float(n) * (float(np.abs(apart).max(initial=0)) + 1)) ** 2 * max(1, x.shape[1]) < 2**62:
        return ((n * apart - rest) ** 2).sum(axis=1).tolist()
    return ((n * apart.astype(object) - rest.astype(object)) ** 2).sum(axis=1).tolist()


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """For each vector and each of its ``wanted`` leading components: the whitened entry, and how good the whole is.

    Entries c become x = floor(64 c) + 1000000. ``deviation`` is the sum of (n x - S)^2 over the dimensions, with S the sum of
    x over all n vectors; ``whitened`` the centred x on a unit eigenvector of the covariance over the root of its eigenvalue;
    ``explained`` the eigenvalue's share of the trace; ``identity_error`` the largest entry by which the covariance of
    ``whitened`` differs from the identity.

    Rows whose vector is null, or has a null or non-finite entry, are left out. There are at most as many components as
    dimensions, and none whose eigenvalue is zero to rounding: equal vectors, a single vector or empty vectors have none, and no rows.
    Of equal eigenvalues any orthogonal directions are taken. Repeated rows and null ids each count and yield rows.
    No rows give no rows; other columns are ignored. Vectors of different lengths are refused with a ValueError.
    """
    vector = named(vector_col)
    table = store(vectors.where(usable(vector)).select(
        named(id_col).cast("bigint").alias("vec_id"), F.transform(vector, lambda c: F.floor(SCALE * c.cast("double")).cast("bigint") + SHIFT).alias("x"),
    ))
    n, least, most = table.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if not n or not most:
        return vectors.sparkSession.createDataFrame([], RESULT)
    if least != most:
        raise ValueError(f"vectors have {least} to {most} entries")
    covariance = Covariance(table, n, most)
    trace = covariance.trace()
    if trace <= 0:
        return vectors.sparkSession.createDataFrame([], RESULT)
    directions, values, _ = components(covariance, min(wanted, most))
    there = values > 1e-12 * values[0]
    values, scaled = values[there], directions[:, there] / np.sqrt(values[there])
    centre, whole, rest, k = covariance.centred(), covariance.whole, covariance.rest, len(values)

    def spread(x: np.ndarray) -> np.ndarray:
        z = centre(x) @ scaled
        return z.T @ z

    error = float(np.abs(summed(table, spread, most, (k, k)) / n - np.eye(k)).max())
    explained, out = values / trace, arrow_schema(RESULT)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if m := batch.num_rows:
                x = _matrix(batch, most)
                at = np.repeat(np.arange(m), k)
                deviation = pa.array(_squares(x, n, whole, rest), pa.decimal128(38, 0))
                yield as_batch(
                    {"vec_id": batch["vec_id"].take(pa.array(at)), "component": np.tile(np.arange(1, k + 1), m), "n": np.full(m * k, n), "deviation": deviation.take(pa.array(at)),
                     "whitened": (centre(x) @ scaled).ravel(), "explained": np.tile(explained, m), "identity_error": np.full(m * k, error)}, out,
                )

    bound_batches(vectors.sparkSession)
    return table.mapInArrow(rows, RESULT)

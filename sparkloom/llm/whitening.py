"""Whitening of embeddings on their principal components.

Entries become integers, so their sums, and with them the mean, are exact. A second pass subtracts the mean
before it multiplies: each task sums its centred rows' outer products as one matrix product, and
treeAggregate merges the tasks' matrices. LAPACK's symmetric solver gives the components, which every task
gets by broadcast; a third pass measures how far the whitened rows' covariance is from the identity.
What is gathered has the size of a vector or of a square of it, whatever the number of rows.

Defined cases: a null vector, an empty one, and one with null, NaN, infinite or too large entries (whose
integer would pass 2**62) are dropped. Vectors have the length that most of them have, the longer one of
equals; others are dropped. Repeated and null ids are rows of their own. A component without variance has
no whitened value (null) and doesn't count for the identity; no remaining row gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



SCALE, SHIFT = 1024.0, 100_000
COMPONENTS = 8
#: Rows of a matrix product.
ROWS = 4096

#: A component has variance if its eigenvalue is above this share of the largest, for each dimension.
FLAT = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Whitening:
    """What was fitted: n vectors, their exact sums, components as columns with their eigenvalues, and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def dims(self) -> int:
        return len(self.sums)

    def rates(self) -> np.ndarray:
        """What a projection is multiplied with; NaN where the component is flat."""
        top = max(float(self.eigenvalues.max(initial=0.0)), 0.0)
        solid = self.eigenvalues > top * FLAT * self.dims
        return np.where(solid, 1.0 / np.sqrt(np.where(solid, self.eigenvalues, 1.0)), np.nan)


def vectors(df: DataFrame, id_: str, column: str) -> DataFrame:
    return df.select(F.col(id_).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))


def integers(batch: pa.RecordBatch, dims: int) -> tuple[pa.Array, np.ndarray]:
    """The ids of a batch's good vectors, and their entries as whole numbers."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)  # null entries are NaN
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * flat)
    good = (np.abs(scaled) < 2.0**62).all(axis=1)  # false for NaN
    return batch.column("vec_id").filter(pa.array(good)), scaled[good].astype(np.int64) + SHIFT


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: as machine integers where they fit, else as Python's."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(off: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    most = int(np.abs(off).max(initial=0))
    if most * most * off.shape[1] >= 2**63:
        off = off.astype(object)
    return [int(s) for s in (off * off).sum(axis=1)]


def _per_task(df: DataFrame, dims: int, of, schema: str) -> DataFrame:
    """One row for each task: ``of`` sums up the matrices of its batches."""

    def run(batches):
        yield from of(integers(b, dims)[1] for b in batches)

    return df.mapInArrow(run, schema)


def _sums(df: DataFrame, dims: int) -> tuple[int, list[int]]:
    def of(parts):
        n, high, low = 0, np.zeros(dims, object), np.zeros(dims, object)
        for x in parts:  # halves of 32 bits, so that no sum of a batch passes 64
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0).astype(object), low + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "sums": [[str(h * 2**32 + l) for h, l in zip(high.tolist(), low.tolist(), strict=True)]]})

    add = lambda a, b: (a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)])
    tasks = _per_task(df, dims, of, "n long, sums array<string>").rdd
    return tasks.treeAggregate((0, [0] * dims), lambda a, r: add(a, (r["n"], [int(s) for s in r["sums"]])), add)


def _products(df: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    dims = len(sums)

    def of(parts):
        total = None
        for x in parts:
            for i in range(0, len(x), ROWS):
                y = deviations(x[i : i + ROWS], n, sums).astype(float) / n
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_pydict({"products": [total.tobytes()]})

    read = lambda r: np.frombuffer(r["products"]).reshape(dims, dims)
    return _per_task(df, dims, of, "products binary").rdd.treeAggregate(np.zeros((dims, dims)), lambda a, r: a + read(r), lambda a, b: a + b)


def _merged(a, b):
    """Count, mean and centred products of two sets of rows together."""
    if not a[0] or not b[0]:
        return b if not a[0] else a
    n, step = a[0] + b[0], b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def _spread(z: np.ndarray):
    off = z - z.mean(axis=0)
    return len(z), z.mean(axis=0), off.T @ off


def whitened(x: np.ndarray, fitted: Whitening) -> np.ndarray:
    return deviations(x, fitted.n, fitted.sums).astype(float) / fitted.n @ fitted.components * fitted.rates()


def _identity_error(df: DataFrame, fitted: Whitening) -> float | None:
    solid = np.flatnonzero(~np.isnan(fitted.rates()))
    if not len(solid):
        return None
    shared, k = df.sparkSession.sparkContext.broadcast(fitted), len(solid)

    def of(parts):
        total = (0, np.zeros(k), np.zeros((k, k)))
        for x in parts:
            for i in range(0, len(x), ROWS):
                total = _merged(total, _spread(whitened(x[i : i + ROWS], shared.value)[:, solid]))
        if total[0]:
            yield pa.RecordBatch.from_pydict({"n": [total[0]], "mean": [total[1].tobytes()], "products": [total[2].tobytes()]})

    read = lambda r: (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["products"]).reshape(k, k))
    n, _, products = _per_task(df, fitted.dims, of, "n long, mean binary, products binary").rdd.treeAggregate((0, np.zeros(k), np.zeros((k, k))), lambda a, r: _merged(a, read(r)), _merged)
    return float(np.abs(products / n - np.eye(k)).max())


def _of_length(df: DataFrame, dims: int) -> DataFrame:
    return df.where(F.size("v") == dims)


def fit(df: DataFrame, components: int = COMPONENTS, id_: str = "vec_id", column: str = "embedding") -> Whitening | None:
    """None where no vector remains."""
    rows = vectors(df, id_, column)
    usual = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if usual is None:
        return None
    rows = _of_length(rows, usual["dims"])
    n, sums = _sums(rows, usual["dims"])
    if not n:
        return None
    covariance = _products(rows, n, sums) / n
    values, directions = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    directions = directions[:, order]
    directions = directions * np.where(directions[np.abs(directions).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    fitted = Whitening(n, sums, directions, values[order], float(np.trace(covariance)))
    return Whitening(n, sums, directions, values[order], fitted.trace, _identity_error(rows, fitted))


OUTPUT = "vec_id long, deviation decimal(38,0), whitened array<double>"


def transform(df: DataFrame, fitted: Whitening, id_: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Per good vector: vec_id, deviation (its exact squared distance from the mean, times n squared; null beyond 38
    digits), whitened (one value for each component, null for a flat one)."""
    shared = df.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        own = shared.value
        for batch in batches:
            ids, x = integers(batch, own.dims)
            for i in range(0, len(x), ROWS):
                part = x[i : i + ROWS]
                far = [Decimal(s) if s < 10**38 else None for s in squares(deviations(part, own.n, own.sums))]
                z = pa.array(whitened(part, own).ravel(), from_pandas=True)  # NaN is null
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(z) + 1, own.components.shape[1]), pa.int32()), z)
                yield pa.RecordBatch.from_arrays([ids.slice(i, ROWS), pa.array(far, pa.decimal128(38, 0)), lists], names=["vec_id", "deviation", "whitened"])

    return _of_length(vectors(df, id_, column), fitted.dims).mapInArrow(run, OUTPUT)


COMPONENT_ROWS = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def component_rows(df: DataFrame, components: int = COMPONENTS, id_: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Per good vector and component: vec_id, component (from 1), n, deviation, whitened, explained (the eigenvalue's share
    of the trace; null without variance), identity_error."""
    fitted = fit(df, components, id_, column)
    if fitted is None:
        return df.sparkSession.createDataFrame([], COMPONENT_ROWS)
    share = F.array(*[F.lit(float(e / fitted.trace) if fitted.trace > 0 else None).cast("double") for e in fitted.eigenvalues])
    rows = transform(df, fitted, id_, column).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(fitted.identity_error).cast("double").alias("identity_error"))

"""Pearson correlation of many column pairs in one scan, each over the rows where both values are there.

Values are centred, missing ones become zero, and beside them goes a matrix of ones where a value is
there. Products of these two matrices are the counts and sums of every pair at once, so a block of rows
costs a few matrix products whatever the number of pairs. Blocks' sums are added up by Spark, pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a tile, and tile pairs whose sums a task holds (64 kB each and sum); more of them take further scans.
TILE, TILES_AT_ONCE = 128, 96

#: A variance below this share of the mean square is rounding.
FLAT = 1e-13

FACTS = "i int, rows long, n long, total double, low double, high double"
SUMS = ("n", "sx", "sy", "sxy", "sxx", "syy", "bad")


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Rows by columns; missing values are NaN."""
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])


def column_facts(df: DataFrame, columns: Sequence[str]) -> list[dict]:
    """For each column in order: rows, n (values that are there), mean (of finite ones), low, high."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        k = len(columns)
        rows, n, total, low, high = 0, np.zeros(k, np.int64), np.zeros(k), np.full(k, np.inf), np.full(k, -np.inf)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                rows, n = rows + len(x), n + (~np.isnan(x)).sum(axis=0)
                total += np.where(np.isfinite(x), x, 0.0).sum(axis=0)
                low, high = np.fmin(low, np.fmin.reduce(x)), np.fmax(high, np.fmax.reduce(x))
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"i": np.arange(k, dtype=np.int32), "rows": rows, "n": n, "total": total, "low": low, "high": high}))

    found = _numbers(df, columns).mapInArrow(run, FACTS).groupBy("i").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    facts = {r["i"]: r.asDict() | {"mean": r["total"] / r["n"] if r["n"] else 0.0} for r in found.collect()}  # a row for each column
    return [facts.get(i, {"rows": 0, "n": 0, "mean": 0.0, "low": np.inf, "high": -np.inf}) for i in range(len(columns))]


def _products(x: np.ndarray, shift: np.ndarray, left: slice, right: slice) -> np.ndarray:
    """[7, left, right]: see SUMS."""
    there, finite = ~np.isnan(x), np.isfinite(x)
    ones, bad = finite.astype(float), (there & ~finite).astype(float)
    v = np.where(finite, x - shift, 0.0)
    a, b, ma, mb = v[:, left], v[:, right], ones[:, left], ones[:, right]
    infinite = bad[:, left].T @ there[:, right].astype(float) + there[:, left].astype(float).T @ bad[:, right] if bad.any() else np.zeros((a.shape[1], b.shape[1]))
    return np.stack([ma.T @ mb, a.T @ mb, ma.T @ b, a.T @ b, (a * a).T @ mb, ma.T @ (b * b), infinite])


def pair_sums(df: DataFrame, columns: Sequence[str], shift: np.ndarray, target: bool = False) -> DataFrame:
    """(i, j, n, sx, sy, sxy, sxx, syy, bad) for i <= j; with ``target`` only for the last column as j. ``bad`` counts
    rows with an infinite value."""
    k = len(columns)
    bounds = [slice(i, min(i + TILE, k)) for i in range(0, k, TILE)]
    tiles = [(a, slice(k - 1, k)) for a in bounds] if target else [(a, b) for i, a in enumerate(bounds) for b in bounds[i:]]

    def scan(own: list[tuple[slice, slice]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: list[np.ndarray | float] = [0.0] * len(own)
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch)
                    for t, (a, b) in enumerate(own):
                        sums[t] = sums[t] + _products(x, shift, a, b)
            for (a, b), found in zip(own, sums, strict=True):
                if isinstance(found, np.ndarray):
                    i, j = (m.ravel() for m in np.meshgrid(np.arange(a.start, a.stop), np.arange(b.start, b.stop), indexing="ij"))
                    keep = i <= j
                    yield pa.RecordBatch.from_arrays([pa.array(i[keep], pa.int32()), pa.array(j[keep], pa.int32()), *[pa.array(m.ravel()[keep]) for m in found]], names=["i", "j", *SUMS])

        return _numbers(df, columns).mapInArrow(run, "i int, j int, " + ", ".join(f"{s} double" for s in SUMS))

    out = scan(tiles[:TILES_AT_ONCE])
    for at in range(TILES_AT_ONCE, len(tiles), TILES_AT_ONCE):
        out = out.unionByName(scan(tiles[at : at + TILES_AT_ONCE]))
    return out.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])


def correlations(df: DataFrame, columns: Sequence[str], target: bool = False) -> DataFrame:
    """(i, j, col_a, col_b, n, r) for i <= j, or for the last column as j. r is null where one side does not vary over
    the common rows, and NaN where one has an infinite value there."""
    facts = column_facts(df, columns)
    names = F.array(*map(F.lit, columns))
    constant = F.array(*[F.lit(bool(f["low"] >= f["high"])) for f in facts])
    sums = pair_sums(df, columns, np.array([f["mean"] for f in facts]), target)
    spread = lambda square, total: F.col(square) - F.col(total) * F.col(total) / F.col("n")
    varies = lambda square, total, at: (spread(square, total) > FLAT * F.col(square)) & ~constant[F.col(at)]
    r = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(spread("sxx", "sx") * spread("syy", "sy"))
    found = F.when(F.col("bad") > 0, float("nan")).when((F.col("n") > 0) & varies("sxx", "sx", "i") & varies("syy", "sy", "j"), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))
    return sums.select("i", "j", names[F.col("i")].alias("col_a"), names[F.col("j")].alias("col_b"), F.col("n").cast("long").alias("n"), found.alias("r"))

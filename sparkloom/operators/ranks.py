"""Exact quantiles, distinct counts and most frequent values of many columns.

Quantiles: a sketch brackets each wanted rank, then one scan counts what is below a bracket and the values in
it, which are a ten-thousandth of the column or so, and only these are shuffled and ordered. A bracket that
should miss its rank is opened wide. Distinct counts: tasks send each value once. No rows are multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import blake2b
from math import ceil, floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Of the sketch; and how many of its steps a bracket is wide to each side.
ACCURACY, STEPS = 10_000, 2
#: Numbers up to which brackets are open, and values that a task holds before it sends them.
FEW, HELD = 20_000, 1 << 20

Bracket = tuple[float, float]


def as_double(c: Column) -> Column:
    """A number, null for NaN."""
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def sketch(x: Column, wanted: Sequence[float]) -> Column:
    """Count, and values about the wanted ranks: an aggregate that may go into any scan."""
    margin = STEPS / ACCURACY
    places = [min(1.0, max(0.0, q + side * margin)) for q in wanted for side in (-1, 1)]
    return F.struct(F.count(x).alias("n"), F.percentile_approx(x, F.array(*map(F.lit, places)), F.lit(ACCURACY)).alias("at"))


def brackets(found, wanted: Sequence[float]) -> list[Bracket]:
    """For each wanted quantile values that its rank lies between, from a row of ``sketch``."""
    margin, out = STEPS / ACCURACY, []
    for k, q in enumerate(wanted):
        open_ = found["n"] <= FEW
        out.append((-np.inf if open_ or q <= margin else found["at"][2 * k], np.inf if open_ or q >= 1 - margin else found["at"][2 * k + 1]))
    return out


def _counted(df: DataFrame, cells: Sequence[Column], bounds: Sequence[Sequence[Bracket]]) -> DataFrame:
    """(i, k, value, n): how often values within bracket k of cell i occur; of a null value, how many are below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = np.zeros((len(bounds), max(map(len, bounds))), np.int64)
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def packed(parts):
            values, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            out, at = np.unique(values, return_inverse=True)
            return out, np.bincount(at, counts, len(out)).astype(np.int64)

        def sent():
            for (i, k), parts in held.items():
                values, counts = packed(parts)
                yield pa.RecordBatch.from_pydict({"i": np.full(len(values), i, np.int32), "k": np.full(len(values), k, np.int32), "value": values, "n": counts})

        for batch in batches:
            for i, (column, own) in enumerate(zip(batch.columns, bounds, strict=True)):
                x = column.drop_null().to_numpy(zero_copy_only=False)
                for k, (low, high) in enumerate(own):
                    below[i, k] += np.count_nonzero(x < low)
                    values, counts = np.unique(x[(x >= low) & (x <= high)], return_counts=True)
                    held.setdefault((i, k), []).append((values, counts))
                    size += len(values)
            if size > HELD:
                held = {key: [packed(parts)] for key, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > HELD // 2:
                    yield from sent()
                    held, size = {}, 0
        yield from sent()
        i, k = np.nonzero(below)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(k, pa.int32()), pa.nulls(len(i), pa.float64()), pa.array(below[i, k])], names=["i", "k", "value", "n"])

    rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).mapInArrow(run, "i int, k int, value double, n long")
    return rows.groupBy("i", "k", "value").agg(F.sum("n").alias("n"))


def _at_ranks(df: DataFrame, cells: Sequence[Column], sizes: Sequence[int], wanted: Sequence[float], bounds: Sequence[Sequence[Bracket]]) -> dict[tuple[int, int], tuple[float | None, float | None]]:
    """The values at the ranks below and above each place, None where a bracket does not hold them."""
    upto = Window.partitionBy("i", "k").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)  # what is below comes first
    places = F.array(*[F.array(*[F.lit(float(q * (n - 1))) for q in wanted]) for n in sizes])
    rows = _counted(df, cells, bounds).withColumn("end", F.sum("n").over(upto)).withColumn("place", places[F.col("i")][F.col("k")])
    holds = lambda rank: F.when((rank >= F.col("end") - F.col("n")) & (rank < F.col("end")), F.col("value"))
    found = rows.where("value is not null").groupBy("i", "k").agg(F.max(holds(F.floor("place"))).alias("low"), F.max(holds(F.ceil("place"))).alias("high"))
    return {(r["i"], r["k"]): (r["low"], r["high"]) for r in found.collect()}  # a row for each column and quantile


def quantile_values(df: DataFrame, cells: Sequence[Column], wanted: Sequence[float], sketches: Sequence | None = None) -> list[tuple[int, list[float]]]:
    """For each cell (a number column) its count and its quantiles, interpolated; none for a count of 0."""
    if not cells:
        return []
    if sketches is None:
        sketches = df.agg(*[sketch(c, wanted).alias(f"s{i}") for i, c in enumerate(cells)]).first()
    sizes = [s["n"] for s in sketches]
    own = [i for i, n in enumerate(sizes) if n]
    if not own:
        return [(0, []) for _ in cells]
    bounds = [brackets(sketches[i], wanted) for i in own]
    found = _at_ranks(df, [cells[i] for i in own], [sizes[i] for i in own], wanted, bounds)
    missed = [j for j in range(len(own)) if any(None in found.get((j, k), (None,)) for k in range(len(wanted)))]
    if missed:  # the sketch promised more than it kept
        again = _at_ranks(df, [cells[own[j]] for j in missed], [sizes[own[j]] for j in missed], wanted, [[(-np.inf, np.inf)] * len(wanted)] * len(missed))
        found |= {(missed[j], k): v for (j, k), v in again.items()}
    out: list[tuple[int, list[float]]] = [(0, []) for _ in cells]
    for j, i in enumerate(own):
        values = []
        for k, q in enumerate(wanted):
            place, (low, high) = q * (sizes[i] - 1), found[j, k]
            share = place - floor(place)
            values.append(low if floor(place) == ceil(place) else (1 - share) * low + share * high)
        out[i] = (sizes[i], values)
    return out


def quantiles(df: DataFrame, columns: list[str], wanted: dict[str, float]) -> DataFrame:
    """(column, n, and each wanted quantile, interpolated) of every column that has numbers."""
    found = quantile_values(df, [as_double(F.col(f"`{c}`")) for c in columns], list(wanted.values()))
    rows = [(c, n, *map(float, values)) for c, (n, values) in zip(columns, found, strict=True) if n]
    return df.sparkSession.createDataFrame(rows, "column string, n long, " + ", ".join(f"`{name}` double" for name in wanted))


# distinct values -------------------------------------------------------------------------------------


def _comparable(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.IntegralType):
        return c.cast("long")
    if isinstance(f.dataType, T.FractionalType) and not isinstance(f.dataType, T.DecimalType):
        return c.cast("double")
    return c if isinstance(f.dataType, T.StringType) else c.cast("string")


def _identities(values: pa.Array) -> np.ndarray:
    """Two numbers for each of some different values: themselves, or a digest of a text."""
    out = np.zeros((len(values), 2), np.int64)
    if pa.types.is_integer(values.type):
        out[:, 0] = values.to_numpy()
    elif pa.types.is_floating(values.type):
        x = values.to_numpy() + 0.0  # -0.0 equals 0.0
        out[:, 0] = np.where(np.isnan(x), np.nan, x).view(np.int64)
    elif len(values):
        out[:] = np.frombuffer(b"".join(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in values.to_pylist()), np.int64).reshape(-1, 2)
    return out


def distinct_counts(df: DataFrame, columns: Sequence[str], most: int | None = None) -> dict[str, int]:
    """How many different values each column has; with ``most`` a larger number may be told as any from ``most`` on, and
    no task sends more of a column than that."""
    if not columns:
        return {}
    fields = {f.name: f for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros((0, 2), np.int64)] * len(columns)
        new: list[list[np.ndarray]] = [[] for _ in columns]
        size = 0

        def merged() -> None:
            for i, parts in enumerate(new):
                if parts:
                    held[i] = np.unique(np.concatenate([held[i], *parts]), axis=0)[:most]
                    parts.clear()

        def sent() -> Iterator[pa.RecordBatch]:
            for i, own in enumerate(held):
                if len(own):
                    yield pa.RecordBatch.from_pydict({"i": np.full(len(own), i, np.int32), "v": own[:, 0], "w": own[:, 1]})

        for batch in batches:
            for i, column in enumerate(batch.columns):
                if most is None or len(held[i]) < most:
                    new[i].append(_identities(pc.unique(column.drop_null())))
                    size += len(new[i][-1])
            if size > HELD or most is not None:
                merged()
                size = sum(map(len, held))
                if size > HELD // 2 and most is None:
                    yield from sent()
                    held, size = [np.zeros((0, 2), np.int64)] * len(columns), 0
        merged()
        yield from sent()

    rows = df.select(*[_comparable(fields[c]).alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, "i int, v long, w long")
    found = {r["i"]: r["count"] for r in rows.distinct().groupBy("i").count().collect()}  # a row for each column
    return {c: found.get(i, 0) for i, c in enumerate(columns)}


def counted_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) of text columns."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns]
    rows = df.select(F.explode(F.array(*cells)).alias("r")).select("r.*").where("value is not null")
    return rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, unique_count, top_value): the smallest of the most frequent values of each text column that has any."""
    return counted_levels(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top_value"))

"""Outlier reports: Tukey fences of numeric columns, rare values of categorical ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import numeric_columns
from .ranks import quantiles

FENCE = 1.5


def fences(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, q1, q3) of every column that has numbers."""
    return quantiles(df, columns, {"q1": 0.25, "q3": 0.75})


def iqr_report(df: DataFrame, columns: list[str] | None = None, k: float = FENCE) -> DataFrame:
    """Columns of at least four values: how many lie beyond the fences. A second scan counts them."""
    columns = columns or numeric_columns(df)
    bounds = {r["column"]: (r["q1"] - k * (r["q3"] - r["q1"]), r["q3"] + k * (r["q3"] - r["q1"])) for r in fences(df, columns).where("n >= 4").collect()}
    rows = None
    kept = [c for c in columns if c in bounds]
    for c in kept:
        low, high = bounds[c]
        x = F.col(f"`{c}`")
        out = F.count_if((x < low) | (x > high))
        row = F.struct(F.lit(c).alias("column"), out.alias("outlier_count"), F.round(F.lit(low), 2).alias("lower_bound"), F.round(F.lit(high), 2).alias("upper_bound"), F.round(out / F.nullif(F.count(x), F.lit(0)) * 100, 2).alias("outlier_percent"))
        rows = [row] if rows is None else [*rows, row]
    if not rows:
        return df.sparkSession.createDataFrame([], "column string, outlier_count long, lower_bound double, upper_bound double, outlier_percent double")
    wide = df.agg(*[r.alias(f"c{i}") for i, r in enumerate(rows)])
    return wide.select(F.explode(F.array(*[f"c{i}" for i in range(len(rows))])).alias("r")).select("r.*")


def rare_values(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of values in at most max(1% of the rows, 5) rows."""
    x = F.col(f"`{column}`")
    counted = df.groupBy(x.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    rows = counted.agg(F.sum("n").alias("rows"))
    return counted.join(F.broadcast(rows)).where("value is not null and n <= greatest(rows * 0.01, 5)").select(F.col("value").cast("string").alias("value"), "n")

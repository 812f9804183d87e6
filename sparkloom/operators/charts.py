"""Chart-ready aggregates: bins, boxes, points and matrices of a size that does not grow with the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import as_number, numeric_columns
from .ranks import quantiles


def bin_count(n: int, most: int = 30) -> int:
    return max(10, min(most, int(n**0.5 + 0.5)))


def histogram(df: DataFrame, column: str, most: int = 30) -> DataFrame:
    """(bin, lower, upper, n): round(sqrt(n)) bins, 10 to ``most`` of them; empty bins are left out."""
    x = F.col(f"`{column}`").cast("double")
    n, low, high = df.agg(F.count(x), F.min(x), F.max(x)).first()
    if not n:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n long")
    bins = bin_count(n, most)
    width = (high - low) / bins
    at = F.lit(0) if width == 0 else F.least(F.floor((x - F.lit(low)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    counted = df.where(x.isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("lower"), (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("upper"), "n")


def box_plot(df: DataFrame, column: str) -> DataFrame:
    """One row: quartiles, whiskers (the outermost values within the fences) and the number of points beyond."""
    x = F.col(f"`{column}`").cast("double")
    quartiles = quantiles(df.select(x.alias("x")), ["x"], {"q1": 0.25, "median": 0.5, "q3": 0.75}).select("q1", "median", "q3")
    fenced = df.where(x.isNotNull()).select(x.alias("x")).join(F.broadcast(quartiles))
    inside = F.col("x").between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return fenced.groupBy("q1", "median", "q3").agg(F.min(F.when(inside, F.col("x"))).alias("lower_whisker"), F.max(F.when(inside, F.col("x"))).alias("upper_whisker"), F.count_if(~inside).alias("outliers"))


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y")).dropna()


def series(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Requested columns that exist (all numeric ones by default) as numbers; null where they aren't."""
    wanted = [c for c in columns if c in df.columns] if columns else numeric_columns(df)
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(*[(F.col(f"`{c}`").cast("double") if isinstance(kinds[c], T.NumericType) else as_number(F.col(f"`{c}`"))).alias(c) for c in wanted])


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n) for all pairs of labels, in string order, zeros included. Labels are few."""
    pairs = df.select(F.col(actual).cast("string").alias("actual"), F.col(predicted).cast("string").alias("predicted")).dropna()
    counted = pairs.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    labels = counted.select(F.array_distinct(F.array("actual", "predicted")).alias("l")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("l")))).alias("labels"))
    cells = labels.select(F.explode("labels").alias("actual"), "labels").select("actual", F.explode("labels").alias("predicted"))
    return cells.join(counted, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy("actual", "predicted")


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.select("*", (F.col(actual) - F.col(predicted)).alias("residual"))


def identity_range(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: the least and the largest of both columns."""
    return df.agg(F.least(F.min(actual), F.min(predicted)).alias("low"), F.greatest(F.max(actual), F.max(predicted)).alias("high"))


def badge(r: Column) -> Column:
    return F.when(F.abs(r) > 0.8, "red").when(F.abs(r) > 0.6, "orange").otherwise("blue")


def recommended_chart(kind: str, distinct: int) -> tuple[str, str]:
    """Chart for a column by its type after cleaning, and why."""
    if kind == "numeric":
        return "histogram", "shows how the numbers are distributed"
    return "bar", "few categories compare well as bars" if distinct <= 5 else "bars rank the many categories"

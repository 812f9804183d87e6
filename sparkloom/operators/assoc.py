"""Association between columns: Pearson, correlation ratio, Cramér's V. Pairwise results are long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import numeric_columns
from .cube import associations
from .masked import column_facts, correlations

STRONG = 0.7
MODERATE = 0.3
MOST_NULLS = 0.3


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are there; null where one of them does not vary."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def usable_columns(df: DataFrame, most_nulls: float = MOST_NULLS) -> list[str]:
    """Numeric columns with at most this share of nulls, in the table's order."""
    numbers = numeric_columns(df)
    facts = column_facts(df, numbers) if numbers else []
    return [c for c, f in zip(numbers, facts, strict=True) if f["rows"] and 1 - f["n"] / f["rows"] <= most_nulls]


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, col_a, col_b, r) for each pair in the order of columns, from two scans of the table."""
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "i int, j int, col_a string, col_b string, r double")
    return correlations(df, columns).where("i < j").select("i", "j", "col_a", "col_b", "r")


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col_a, col_b, r), both halves and the diagonal, rounded to three digits; empty for fewer than two columns."""
    columns = usable_columns(df) if columns is None else columns
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, r double")
    half = correlations(df, columns)
    mirrored = F.when(F.col("i") == F.col("j"), F.array(F.struct("col_a", "col_b"))).otherwise(F.array(F.struct("col_a", "col_b"), F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"))))
    return half.select(F.explode(mirrored).alias("p"), "r").select("p.*", (F.round("r", 3) + 0.0).alias("r"))


def pair_list(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All pairs with a correlation, strongest first; strength is judged before rounding."""
    columns = usable_columns(df) if columns is None else columns
    pairs = correlation_pairs(df, columns).where("r is not null")
    pairs = pairs.withColumn("strength", F.when(F.abs("r") >= STRONG, "strong").otherwise("moderate")).withColumn("r", F.round("r", 3) + 0.0)
    return pairs.orderBy(F.desc(F.abs("r")), "i", "j").select("col_a", "col_b", "r", "strength")


def pairs_from_matrix(matrix: DataFrame) -> DataFrame:
    """The pair list again, from a stored (rounded) matrix; one row for each unordered pair."""
    half = matrix.where("col_a < col_b and r is not null").where(~F.isnan("r") & (F.abs("r") != float("inf")))
    return half.withColumn("strength", F.when(F.abs("r") >= STRONG, "strong").otherwise("moderate")).orderBy(F.desc(F.abs("r")), "col_a", "col_b")


def target_relationships(df: DataFrame, target: str, k: int = 10) -> DataFrame:
    """Columns that correlate with a numeric target beyond 0.3, strongest first."""
    others = [c for c in numeric_columns(df) if c != target]
    if target not in numeric_columns(df) or not others:
        return df.sparkSession.createDataFrame([], "column string, r double, strength string, direction string")
    rows = correlations(df, [*others, target], target=True).where(f"i < {len(others)}").select(F.col("col_a").alias("column"), "r").where(F.abs("r") > MODERATE)
    rows = rows.withColumn("strength", F.when(F.abs("r") >= STRONG, "strong").otherwise("moderate")).withColumn("direction", F.when(F.col("r") > 0, "positive").otherwise("negative"))
    return rows.orderBy(F.desc(F.abs("r")), "column").limit(k).withColumn("r", F.round("r", 3) + 0.0)


def correlation_ratios(df: DataFrame, categorical: str, numbers: list[str]) -> DataFrame:
    """(column, eta): how far a categorical column explains each numeric one."""
    return associations(df, [categorical], numbers).select(F.col("col_b").alias("column"), F.col("value").alias("eta"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: v, without bias correction; zero if a side has fewer than two levels."""
    return associations(df, [a, b], []).agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("v"))

"""Column and table profiles: one aggregation over the table for all columns, then small rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import is_number, numeric_columns, text_columns
from .ranks import distinct_counts, quantiles, top_values

#: Aggregates of one pass; wider ones fall out of code generation.
WIDE = 90


def stacked(df: DataFrame, columns: list[str], measures: dict[str, callable]) -> DataFrame:
    """One row per column with named measures, from as few wide aggregations as code generation allows."""
    per = max(1, WIDE // max(1, len(measures)))
    out = None
    for at in range(0, len(columns), per):
        part = columns[at : at + per]
        wide = df.agg(*[F.struct(F.lit(c).alias("column"), *[m(F.col(f"`{c}`")).alias(n) for n, m in measures.items()]).alias(f"c{i}") for i, c in enumerate(part)])
        rows = wide.select(F.explode(F.array(*[f"c{i}" for i in range(len(part))])).alias("r")).select("r.*")
        out = rows if out is None else out.unionByName(rows)
    return out


NUMERIC = {
    "count": lambda c: F.count(c),
    "null_count": lambda c: F.count_if(c.isNull()),
    "mean": lambda c: F.avg(c.cast("double")),
    "std": lambda c: F.stddev_samp(c.cast("double")),
    "min": lambda c: F.min(c).cast("double"),
    "max": lambda c: F.max(c).cast("double"),
}

CATEGORICAL = {
    "count": lambda c: F.count(F.lit(1)),
    "null_count": lambda c: F.count_if(c.isNull()),
}

DATES = {
    "count": lambda c: F.count(c),
    "null_count": lambda c: F.count_if(c.isNull()),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "range_days": lambda c: F.datediff(F.max(c), F.min(c)).cast("long"),
}


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Quartiles and distinct counts as in ranks, all else from one scan."""
    columns = columns or numeric_columns(df)
    ranked = quantiles(df, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n")
    rows = stacked(df, columns, NUMERIC).join(F.broadcast(ranked), "column", "left").join(F.broadcast(unique_counts(df, columns)), "column")
    return rows.select("column", "count", "null_count", "unique_count", "mean", "median", "std", "min", "max", "q1", "q3")


def unique_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, unique_count), a row for each column."""
    return df.sparkSession.createDataFrame(list(distinct_counts(df, columns).items()), "column string, unique_count long")


def categorical_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The count includes nulls; the top value is the smallest of the most frequent ones."""
    columns = columns or text_columns(df)
    rows = stacked(df, columns, CATEGORICAL).join(F.broadcast(top_values(df, columns)), "column", "left")
    return rows.withColumn("unique_count", F.coalesce("unique_count", F.lit(0).cast("long")))


def datetime_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    dates = [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType, T.DateType))]
    return stacked(df, columns or dates, DATES)


def value_counts(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    counted = df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), F.asc("value")).limit(k)


def null_fractions(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return stacked(df, columns or df.columns, {"null_fraction": lambda c: F.avg(c.isNull().cast("double"))})


def table_summary(df: DataFrame) -> DataFrame:
    """rows, columns, missing cells and the mean share of missing cells in percent (null for no rows)."""
    nulls = [F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns]
    total = sum(nulls[1:], nulls[0]) if nulls else F.lit(0)
    rows = F.count(F.lit(1))
    share = total / F.nullif(rows * len(df.columns), F.lit(0)) * 100
    return df.agg(rows.alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"), total.alias("missing_cells"), F.round(share, 2).alias("missing_percent"))


def upload_type(field: T.StructField) -> str:
    """The type as a preview shows it."""
    if is_number(field.dataType):
        return "numeric"
    if isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return "datetime"
    return "categorical" if isinstance(field.dataType, T.StringType) else "text"


def cleaned_type(field: T.StructField) -> str:
    """The type after cleaning: numbers and booleans are numeric, all else categorical."""
    return "numeric" if is_number(field.dataType) or isinstance(field.dataType, T.BooleanType) else "categorical"


def column_metadata(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: null and distinct counts, and the range of numeric ones."""
    fields = {f.name: f for f in df.schema}
    columns = columns or df.columns
    kinds = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(upload_type(fields[c])))]) if columns else None
    numbers = [c for c in columns if is_number(fields[c].dataType)]
    base = stacked(df, columns, {"null_count": lambda c: F.count_if(c.isNull())}).join(F.broadcast(unique_counts(df, columns)), "column")
    out = base.withColumn("inferred_type", kinds[F.col("column")])
    if not numbers:
        return out.withColumn("min", F.lit(None).cast("double")).withColumn("max", F.lit(None).cast("double"))
    ranges = stacked(df, numbers, {"min": lambda c: F.min(c).cast("double"), "max": lambda c: F.max(c).cast("double")})
    return out.join(F.broadcast(ranges), "column", "left")

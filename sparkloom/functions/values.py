"""Column expressions for missing values, parsing and text, all built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The place of a row in the file that it was read from.
ROW_ID = "__row_id"

# Texts that count as missing when a file is read.
NULL_TOKENS = ("", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Formats in which dates are read, month first.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy", "M-d-yyyy", "yyyy/M/d", "yyyyMMdd", "MMM d yyyy", "d MMM yyyy")
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INFINITE = r"^\s*[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?\s*$"


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_number(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is null from here on: NaN becomes null, decimals become doubles."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def tokens_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NULL_TOKENS), c)


def as_number(c: Column) -> Column:
    """Text as a double; null where it isn't one (suffixes such as 1d are not numbers)."""
    text = c.cast("string")
    sign = F.when(F.trim(text).startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double")).when(text.rlike(INFINITE), sign)


def as_date(c: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in DATE_FORMATS]).cast("timestamp_ntz")


def locale_number(c: Column) -> Column:
    return as_number(F.regexp_replace(c.cast("string"), ",", ""))


def finite(c: Column) -> Column:
    """Null for infinities and NaN."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def name_fragment(c: Column) -> Column:
    s = F.substr(F.regexp_replace(c, "[^A-Za-z0-9_]", "_"), F.lit(1), F.lit(48))
    return F.when(F.length(s) > 0, s).otherwise(F.lit("col"))


def clean_line(c: Column) -> Column:
    """A line without bold marks, its bullet, its number and surplus spaces."""
    c = F.regexp_replace(c, r"\*\*", "")
    c = F.regexp_replace(c, r"^\s*[*\-•]+\s*", "")
    c = F.regexp_replace(c, r"^\s*[0-9]+[.)]\s*", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


# Words that make no line by themselves.
FILLERS = ("there", "here", "also", "thus", "therefore")


def useful_line(c: Column) -> Column:
    words = F.regexp_count(c, F.lit(r"\S+"))
    alone = F.lower(F.trim(c))
    dull = (words == 1) & ((F.length(alone) < 4) | alone.isin(*FILLERS))
    return F.coalesce(c.rlike("[A-Za-z0-9]") & ~dull, F.lit(False))


def mentions(text: Column, name: str) -> Column:
    """Whether a name occurs as a word; underscores count as letters, names under two characters never do."""
    if len(name) < 2:
        return F.lit(False)
    safe = "".join("\\" + c if not c.isalnum() and c != "_" and not c.isspace() else c for c in name.lower())
    # the name first, what stands before it after: only places of the name are looked at
    return F.lower(text).rlike(f"{safe}(?<![a-z0-9_]{safe})(?![a-z0-9_])")

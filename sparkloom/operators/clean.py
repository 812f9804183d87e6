"""The cleaning pipeline. Each step is a ``fit`` (one small aggregation) and a lazy ``transform``.

The order of steps is part of their meaning. ``clean`` runs them all and writes the report; each step
can also be used alone. ``__row_id`` (see sources.ingest) is carried through and never looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import NUMBER, ROW_ID, as_date, as_number, is_number, numeric_columns, text_columns
from ..store import written
from .cube import associations
from .profile import stacked
from .ranks import as_double, counted_levels, distinct_counts, quantile_values, quantiles, sketch, top_values


@dataclass(frozen=True)
class Settings:
    null_threshold: float = 0.5
    numeric_share: float = 0.85
    category_levels: int = 50
    remove_outliers: bool = True
    iqr_multiplier: float = 1.5
    sign_share: float = 0.85
    date_numeric_share: float = 0.70
    date_share: float = 0.35
    association: float = 0.30
    least_comparable: int = 5
    comparable_share: float = 0.65
    drop_remaining_nulls: bool = True


@dataclass
class Report:
    rows_start: int = 0
    rows_end: int = 0
    columns_start: int = 0
    columns_end: int = 0
    null_threshold_percent: int = 50
    iqr_outlier_rows_removed: int = 0
    sign_anomaly_rows_removed: int = 0
    duplicate_rows_removed: int = 0
    rows_removed_unresolved_nulls: int = 0
    iqr_multiplier: float = 1.5
    sign_anomaly_threshold: float = 0.85
    outlier_row_removal_enabled: bool = True
    drop_remaining_null_rows_enabled: bool = True
    columns_dropped_high_null: list[str] = field(default_factory=list)
    low_cardinality_columns_as_category: list[str] = field(default_factory=list)
    numeric_columns_filled: list[str] = field(default_factory=list)
    categorical_columns_filled: list[str] = field(default_factory=list)
    binary_categorical_columns_encoded: list[str] = field(default_factory=list)
    single_value_categorical_columns_dropped: list[str] = field(default_factory=list)
    categorical_columns_dropped_low_association: list[str] = field(default_factory=list)

    def as_dict(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (ROW_ID, COPIES)]


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def values(df: DataFrame, columns: list[str], measure: Callable[[Column], Column]) -> dict[str, object]:
    """One measure of many columns, from as few scans as possible."""
    return {r["column"]: r["m"] for r in stacked(df, columns, {"m": measure}).collect()} if columns else {}


# sparse columns ------------------------------------------------------------------------------------


def fit_high_null(df: DataFrame, threshold: float = 0.5) -> list[str]:
    shares = values(df, data_columns(df), lambda c: F.avg(c.isNull().cast("double")))
    return [c for c in data_columns(df) if shares[c] is not None and shares[c] > threshold]


# types ---------------------------------------------------------------------------------------------


def fit_numeric_like(df: DataFrame, share: float = 0.85) -> list[str]:
    """Text columns of which at least this share of all rows reads as numbers."""
    shares = values(df, text_columns(df), lambda c: F.avg(as_number(c).isNotNull().cast("double")))
    return [c for c, s in shares.items() if s is not None and s >= share]


def transform_numeric_like(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: as_number(q(c)) for c in columns}) if columns else df


def fit_low_cardinality(df: DataFrame, levels: int = 50) -> list[str]:
    return [c for c, n in distinct_counts(df, text_columns(df), most=levels).items() if n < levels]


def fit_dates(df: DataFrame, categories: list[str], numeric_share: float = 0.70, share: float = 0.35) -> list[str]:
    """Other text columns that seldom read as numbers and often enough as dates."""
    rest = [c for c in text_columns(df) if c not in categories]
    if not rest:
        return []
    rows = stacked(df, rest, {"numbers": lambda c: F.avg(as_number(c).isNotNull().cast("double")), "dates": lambda c: F.avg(as_date(c).isNotNull().cast("double"))})
    return [r["column"] for r in rows.collect() if r["numbers"] is not None and r["numbers"] < numeric_share and r["dates"] >= share]


def transform_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: as_date(q(c)) for c in columns}) if columns else df


# rows ----------------------------------------------------------------------------------------------


QUARTILES = (0.25, 0.75)


def fit_iqr(df: DataFrame, k: float = 1.5, sketches: dict | None = None) -> dict[str, tuple[float, float]]:
    """Fences of numeric columns with at least four values and a spread. ``sketches``: those of an earlier scan."""
    columns = [c for c in numeric_columns(df) if c != ROW_ID]
    if not columns:
        return {}
    found = quantile_values(df, [as_double(q(c)) for c in columns], QUARTILES, [sketches[c] for c in columns] if sketches else None)
    return {c: (x[0] - k * (x[1] - x[0]), x[1] + k * (x[1] - x[0])) for c, (n, x) in zip(columns, found, strict=True) if n >= 4 and x[0] != x[1]}


def transform_iqr(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Without the rows that are beyond any fence; nulls never are."""
    out = F.lit(False)
    for c, (low, high) in bounds.items():
        out = out | F.coalesce((q(c) < low) | (q(c) > high), F.lit(False))
    return df.where(~out) if bounds else df


def fit_signs(df: DataFrame, share: float = 0.85) -> dict[str, str]:
    """Columns that are almost all of one sign, and that sign."""
    return counted_signs(df, share)[1]


def counted_signs(df: DataFrame, share: float = 0.85) -> tuple[int, dict[str, str]]:
    """The number of rows, and the columns of one sign, from one scan."""
    columns = [c for c in numeric_columns(df) if c != ROW_ID]
    cells = [F.struct(F.count(q(c)).alias("n"), F.count_if(q(c) > 0).alias("pos"), F.count_if(q(c) < 0).alias("neg")).alias(f"s{i}") for i, c in enumerate(columns)]
    rows, *found = df.agg(F.count(F.lit(1)).alias("rows"), *cells).first()
    out = {}
    for c, (n, pos, neg) in zip(columns, found, strict=True):
        if n >= 2 and (pos / n >= share or (n - pos == 1 and pos >= 1)):
            out[c] = "positive"
        elif n >= 2 and (neg / n >= share or (n - neg == 1 and neg >= 1)):
            out[c] = "negative"
    return rows, out


def transform_signs(df: DataFrame, signs: dict[str, str]) -> DataFrame:
    """Without rows of the opposite sign; zeros stay."""
    out = F.lit(False)
    for c, sign in signs.items():
        out = out | F.coalesce(q(c) < 0 if sign == "positive" else q(c) > 0, F.lit(False))
    return df.where(~out) if signs else df


#: How often a row was there before duplicates went.
COPIES = "__copies"


def counted_duplicates(df: DataFrame) -> DataFrame:
    """One row of each set of equal rows, nulls being equal, with their number; the first by __row_id where there is one."""
    columns, id_ = data_columns(df), [ROW_ID] if ROW_ID in df.columns else []
    return df.groupBy(*map(q, columns)).agg(*[F.min(c).alias(c) for c in id_], F.count(F.lit(1)).alias(COPIES)).select(*id_, *map(q, columns), COPIES)


def drop_duplicates(df: DataFrame) -> DataFrame:
    return counted_duplicates(df).drop(COPIES)


def copies(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(order, copies): the first of each set of rows with equal values, and how many there are. Long values meet by digest."""
    keys = [F.sha2(q(c).cast("string"), 256).alias(f"k{i}") for i, c in enumerate(columns)]
    return df.select(q(order), *keys).groupBy(*[f"k{i}" for i in range(len(columns))]).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies")).select(order, "copies")


def drop_null_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any", subset=data_columns(df))


# filling -------------------------------------------------------------------------------------------


def fit_medians(df: DataFrame, nulls: dict[str, int] | None = None) -> dict[str, float]:
    """Median of each numeric column that has nulls; 0 if it has nothing else. ``nulls``: their numbers, where known."""
    columns = [c for c in numeric_columns(df) if c != ROW_ID]
    nulls = nulls if nulls is not None else values(df, columns, lambda c: F.count_if(c.isNull()))
    columns = [c for c in columns if nulls[c]]
    if not columns:
        return {}
    found = {r["column"]: r["median"] for r in quantiles(df, columns, {"median": 0.5}).collect()}
    return {c: float(found.get(c, 0.0)) for c in columns}


def transform_medians(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(q(c).cast("double"), F.lit(m)) for c, m in medians.items()}) if medians else df


def fit_modes(df: DataFrame, nulls: dict[str, int] | None = None) -> dict[str, str]:
    """The most frequent value (the smallest of several) of each text column with nulls; Unknown if there is none."""
    columns = text_columns(df)
    nulls = nulls if nulls is not None else values(df, columns, lambda c: F.count_if(c.isNull()))
    columns = [c for c in columns if nulls[c]]
    if not columns:
        return {}
    found = {r["column"]: r["top_value"] for r in top_values(df, columns).collect()}
    return {c: found.get(c, "Unknown") for c in columns}


def transform_modes(df: DataFrame, modes: dict[str, str]) -> DataFrame:
    return df.na.fill(modes) if modes else df


# categories ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Categories:
    constant: tuple[str, ...]
    binary: dict[str, tuple[str, str]]


def fit_categories(df: DataFrame, columns: list[str]) -> Categories:
    """Columns of one level, and those of two levels that aren't both numbers."""
    columns = [c for c in columns if c in text_columns(df)]
    if not columns:
        return Categories((), {})
    levels = counted_levels(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.count_if(~F.col("value").rlike(NUMBER)).alias("words"))
    rows = {r["column"]: r for r in levels.collect()}
    constant = tuple(c for c in columns if c not in rows or rows[c]["n"] <= 1)
    binary = {c: (r["low"], r["high"]) for c in columns if (r := rows.get(c)) and r["n"] == 2 and r["words"] > 0}
    return Categories(constant, binary)


def transform_categories(df: DataFrame, found: Categories) -> DataFrame:
    codes = {c: F.when(q(c) == high, F.lit(1)).when(q(c) == low, F.lit(0)) for c, (low, high) in found.binary.items()}
    return df.drop(*found.constant).withColumns(codes) if codes else df.drop(*found.constant)


def fit_weak_categories(df: DataFrame, columns: list[str], settings: Settings = Settings()) -> list[str]:
    """Categorical columns of little association with the others; all are judged on the same table, from its counted cells."""
    texts = text_columns(df)
    columns = [c for c in columns if c in texts]
    fields = {f.name: f.dataType for f in df.schema}
    others = [c for c in data_columns(df) if not isinstance(fields[c], (T.TimestampNTZType, T.TimestampType, T.DateType))]
    numbers = [c for c in others if is_number(fields[c])]
    if not columns or len(others) - 1 < settings.least_comparable:
        return []
    judged = [*columns, *[c for c in texts if c in others and c not in columns]]
    strong = dict.fromkeys(columns, 0)
    for r in associations(df, judged, numbers).where(F.col("value") >= settings.association).collect():
        for c in (r["col_a"], r["col_b"]):
            if c in strong:
                strong[c] += 1
    return [c for c in columns if strong[c] / (len(others) - 1) < settings.comparable_share]


# all together --------------------------------------------------------------------------------------


def first_facts(df: DataFrame) -> tuple[int, dict]:
    """The number of rows, and for each column what the first steps ask, from one scan: values that are there, numbers among a
    text's, and a sketch of the numbers."""
    texts = text_columns(df)
    cells = []
    for i, c in enumerate(data_columns(df)):
        number = as_number(q(c)) if c in texts else as_double(q(c)) if c in numeric_columns(df) else F.lit(None).cast("double")
        cells.append(F.struct(F.count(q(c)).alias("there"), F.count(number).alias("numbers"), sketch(number, QUARTILES).alias("sketch")).alias(f"c{i}"))
    rows, *found = df.agg(F.count(F.lit(1)).alias("rows"), *cells).first()
    return rows, dict(zip(data_columns(df), found, strict=True))


def clean(df: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, Report]:
    """The cleaned table and its report. The given table is scanned six times: for the first facts, few levels, fences, signs,
    dates (where texts are left) and duplicates. What follows reads a table in the shared folder, which the result reads too;
    within ``store.scratch`` it goes when the block ends."""
    rows, facts = first_facts(df)
    report = Report(rows_start=rows, columns_start=len(data_columns(df)), null_threshold_percent=int(settings.null_threshold * 100), iqr_multiplier=settings.iqr_multiplier, sign_anomaly_threshold=settings.sign_share, outlier_row_removal_enabled=settings.remove_outliers, drop_remaining_null_rows_enabled=settings.drop_remaining_nulls)
    report.columns_dropped_high_null = [c for c, f in facts.items() if rows and 1 - f["there"] / rows > settings.null_threshold]
    df = df.drop(*report.columns_dropped_high_null)
    df = transform_numeric_like(df, [c for c in text_columns(df) if rows and facts[c]["numbers"] / rows >= settings.numeric_share])
    categories = fit_low_cardinality(df, settings.category_levels)
    report.low_cardinality_columns_as_category = list(categories)
    if settings.remove_outliers:
        df = transform_iqr(df, fit_iqr(df, settings.iqr_multiplier, {c: f["sketch"] for c, f in facts.items()}))
        left, signs = counted_signs(df, settings.sign_share)
        report.iqr_outlier_rows_removed, rows = rows - left, left
        df = transform_signs(df, signs)
    df = transform_dates(df, fit_dates(df, categories, settings.date_numeric_share, settings.date_share))
    if not data_columns(df):
        left = df.count()
        report.sign_anomaly_rows_removed, report.rows_end = rows - left, left
        return df, report
    df = written(counted_duplicates(df), "deduplicated")
    left, unique, *nulls = df.agg(F.coalesce(F.sum(COPIES), F.lit(0)), F.count(F.lit(1)), *[F.count_if(q(c).isNull()) for c in data_columns(df)]).first()
    df = df.drop(COPIES)
    report.sign_anomaly_rows_removed, report.duplicate_rows_removed, rows = rows - left, left - unique, unique
    missing = dict(zip(data_columns(df), nulls, strict=True))
    medians, modes = fit_medians(df, missing), fit_modes(df, missing)
    report.numeric_columns_filled, report.categorical_columns_filled = sorted(medians), sorted(modes)
    df = transform_modes(transform_medians(df, medians), modes)

    def categorise(df: DataFrame) -> DataFrame:
        found = fit_categories(df, [c for c in df.columns if c in categories])
        report.single_value_categorical_columns_dropped = sorted({*report.single_value_categorical_columns_dropped, *found.constant})
        report.binary_categorical_columns_encoded = sorted({*report.binary_categorical_columns_encoded, *found.binary})
        return transform_categories(df, found)

    df = categorise(df)
    report.categorical_columns_dropped_low_association = sorted(fit_weak_categories(df, [c for c in df.columns if c in categories], settings))
    df = df.drop(*report.categorical_columns_dropped_low_association)
    if settings.drop_remaining_nulls and data_columns(df):
        filled = {*medians, *modes}
        if any(missing.get(c) and c not in filled for c in data_columns(df)):  # dates have nulls still
            df = drop_null_rows(df)
            report.rows_removed_unresolved_nulls = rows - (rows := df.count())
            df = categorise(df)  # levels may be gone with their rows
    report.rows_end, report.columns_end = rows, len(data_columns(df))
    return df, report

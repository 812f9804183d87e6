"""Scores of predictions, as aggregations over (actual, predicted) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import written

# The thresholds of the sweep, 0.05 to 0.95 in steps of 0.025.
THRESHOLDS = tuple(round(0.05 + 0.025 * i, 3) for i in range(37))


#: A score, or scores of which later ones break ties.
Score = float | tuple[float, ...]


def first_of(score: Score) -> float:
    return score[0] if isinstance(score, tuple) else score


def beats(new: Score, old: Score | None, tol: float) -> bool:
    """Whether a score is more than ``tol`` above another; within it the next one decides."""
    if old is None:
        return True
    for a, b in zip(new if isinstance(new, tuple) else (new,), old if isinstance(old, tuple) else (old,), strict=True):
        if abs(a - b) > tol:
            return a > b
    return False


def regression_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: r2 (0 where the target does not vary), mae, rmse."""
    y, e = F.col(actual).cast("double"), (F.col(actual) - F.col(predicted)).cast("double")
    r2 = 1.0 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))
    return df.agg(F.coalesce(r2, F.lit(0.0)).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def classification_scores(df: DataFrame, actual: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """accuracy and macro-F1 over the union of true and predicted labels, per group of ``by``."""
    counted = df.select(*by, F.col(actual).cast("string").alias("a"), F.col(predicted).cast("string").alias("p")).dropna(subset=["a", "p"]).groupBy(*by, "a", "p").agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array_distinct(F.array("a", "p"))).alias("label")
    per = counted.select(*by, "a", "p", "n", each).groupBy(*by, "label")
    hit = F.sum(F.when((F.col("a") == F.col("label")) & (F.col("p") == F.col("label")), F.col("n")).otherwise(0))
    said = F.sum(F.when(F.col("p") == F.col("label"), F.col("n")).otherwise(0))
    true = F.sum(F.when(F.col("a") == F.col("label"), F.col("n")).otherwise(0))
    # 2 tp / (predicted + true) equals F1 where that is defined, and is 0 elsewhere
    f1 = per.agg((2.0 * hit / F.nullif(said + true, F.lit(0))).alias("f1"), hit.alias("hit"), true.alias("true"))
    scores = [(F.sum("hit") / F.sum("true")).alias("accuracy"), F.avg(F.coalesce("f1", F.lit(0.0))).alias("f1_macro")]
    return f1.groupBy(*by).agg(*scores) if by else f1.agg(*scores)


def threshold_sweep(df: DataFrame, actual: str, score: str) -> DataFrame:
    """(threshold, f1_macro, accuracy) of calling 1 what scores at least the threshold. 37 numbers meet every row
    inside one aggregation: rows are first counted by the number of thresholds they reach."""
    levels = sum((F.col(score) >= t).cast("int") for t in THRESHOLDS[1:]) + (F.col(score) >= THRESHOLDS[0]).cast("int")
    counted = df.select(F.col(actual).cast("int").alias("y"), levels.alias("reached")).groupBy("y", "reached").agg(F.count(F.lit(1)).alias("n"))
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(THRESHOLDS)])).alias("g")
    said = counted.select("y", "reached", "n", grid).select("y", "n", "g.threshold", (F.col("reached") > F.col("g.i")).cast("int").alias("p"))
    cell = lambda y, p: F.sum(F.when((F.col("y") == y) & (F.col("p") == p), F.col("n")).otherwise(0)).cast("double")
    cells = said.groupBy("threshold").agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    pos = F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0.0)), F.lit(0.0))
    neg = F.coalesce(2 * F.col("tn") / F.nullif(2 * F.col("tn") + F.col("fp") + F.col("fn"), F.lit(0.0)), F.lit(0.0))
    # a label that is neither true nor predicted does not count
    labels = F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, 1).otherwise(0) + F.when(F.col("tn") + F.col("fp") + F.col("fn") > 0, 1).otherwise(0)
    return cells.select("threshold", ((pos + neg) / labels).alias("f1_macro"), ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"))


def best_threshold(df: DataFrame, actual: str, score: str) -> float:
    best = threshold_sweep(df, actual, score).orderBy(F.desc(F.round("f1_macro", 9)), F.desc(F.round("accuracy", 9)), "threshold").first()
    return 0.5 if best is None else best["threshold"]


def label_codes(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """df with the number of the column's value among its sorted distinct values. The values are numbered, not the rows: ranges
    of them are, each by itself, and the ranges' sizes say where each begins."""
    value = df.select(F.col(f"`{column}`").alias("__value")).where("__value is not null").distinct()
    ranged = written(value.repartitionByRange("__value").withColumn("__part", F.spark_partition_id()), "labels")
    sizes = ranged.groupBy("__part").count().toPandas().sort_values("__part")  # a row for each range
    sizes["__start"] = sizes["count"].cumsum() - sizes["count"]
    starts = F.broadcast(df.sparkSession.createDataFrame(sizes[["__part", "__start"]], "__part int, __start long"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy("__value")) - 1
    codes = ranged.withColumn("__own", own).join(starts, "__part").select("__value", (F.col("__start") + F.col("__own")).cast("int").alias(name))
    return df.join(codes, F.col(f"`{column}`") == F.col("__value"), "left").drop("__value")


def problem_type(df: DataFrame, column: str, numeric: bool) -> Column | DataFrame:
    """One row: rows, distinct values, and whether the column is a classification target."""
    c = F.col(f"`{column}`")
    whole = F.bool_and(F.abs(c.cast("double") - F.rint(c.cast("double"))) <= 1e-8 + 1e-5 * F.abs(F.rint(c.cast("double")))) if numeric else F.lit(True)
    counted = df.agg(F.count(c).alias("n"), F.count_distinct(c).alias("distinct"), F.coalesce(whole, F.lit(False)).alias("whole"))
    most = F.least(F.lit(30), F.greatest(F.lit(4), F.floor(F.col("n") * 0.2)))
    return counted.select("n", "distinct", ((F.col("n") >= 20) & (F.col("distinct") >= 2) & (F.col("distinct") <= most) & F.col("whole")).alias("is_classification"))


def few_whole_numbers(df: DataFrame, column: str, most: int = 10, share: float = 0.02) -> DataFrame:
    """One row: whether a chart takes the column's numbers for classes: whole ones, few in number and among the rows."""
    c = F.col(f"`{column}`")
    counted = df.groupBy(c.alias("value")).agg(F.count(c).alias("n")).where("value is not null")
    few = F.count(F.lit(1)) <= F.least(F.lit(float(most)), F.greatest(F.lit(2.0), share * F.sum("n")))
    return counted.agg(F.coalesce(F.bool_and(F.col("value") == F.floor("value")) & few, F.lit(False)).alias("is_classification"))

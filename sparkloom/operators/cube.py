"""Association of all categorical columns, with each other and with numbers, from one table of counted cells.

A cell is a pair of columns with the levels in it: how many rows have both levels (two categories), or how many
rows a level has beside a number, and that number's sum and square sum. Tasks add up cells of their rows and
send them; Cramér's V and the correlation ratio of every pair follow from the cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .masked import column_facts

#: Cells that a task holds before it adds them up, and sends them if they stay many.
HELD = 400_000

CELLS = "i int, j int, a string, b string, n long, s double, ss double"


def cells(df: DataFrame, texts: Sequence[str], numbers: Sequence[str], shift: np.ndarray) -> DataFrame:
    """(i, j, a, b, n, s, ss): columns by number, texts first; of a number column b is null, s and ss are sums of values less ``shift``."""

    def of(batch: pa.RecordBatch) -> Iterator[pd.DataFrame]:
        coded = [pd.factorize(batch.column(k).to_pandas()) for k in range(len(texts))]
        x = [batch.column(len(texts) + k).to_numpy(zero_copy_only=False).astype(float) - shift[k] for k in range(len(numbers))]
        for i, (own, levels) in enumerate(coded):
            for j in range(i + 1, len(texts)):
                other, other_levels = coded[j]
                both = (own >= 0) & (other >= 0)
                pair, n = np.unique(own[both].astype(np.int64) * max(1, len(other_levels)) + other[both], return_counts=True)
                a, b = np.divmod(pair, max(1, len(other_levels)))
                yield pd.DataFrame({"i": i, "j": j, "a": levels[a], "b": other_levels[b], "n": n, "s": 0.0, "ss": 0.0})
            for k, v in enumerate(x):
                both = (own >= 0) & ~np.isnan(v)
                n = np.bincount(own[both], minlength=len(levels))
                s, ss = (np.bincount(own[both], w[both], minlength=len(levels)) for w in (v, v * v))
                there = n > 0
                yield pd.DataFrame({"i": i, "j": len(texts) + k, "a": levels[there], "b": None, "n": n[there], "s": s[there], "ss": ss[there]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        size = 0

        def added() -> pd.DataFrame:
            whole = pd.concat(held, ignore_index=True)
            return whole.groupby(["i", "j", "a", "b"], dropna=False, sort=False, as_index=False).sum()

        def sent(rows: pd.DataFrame) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64()]
            names = [c.split()[0] for c in CELLS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(rows[c], t, from_pandas=True) for c, t in zip(names, kinds, strict=True)], names=names)

        for batch in batches:
            for rows in of(batch) if batch.num_rows else ():
                if len(rows):
                    held.append(rows)
                    size += len(rows)
            if size > HELD:
                held = [added()]
                size = len(held[0])
                if size > HELD // 2:
                    yield sent(held[0])
                    held, size = [], 0
        if held:
            yield sent(added())

    columns = [F.col(f"`{c}`").cast("string").alias(f"t{k}") for k, c in enumerate(texts)] + [F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(numbers)]
    return df.select(*columns).mapInArrow(run, CELLS).groupBy("i", "j", "a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])


def associations(df: DataFrame, texts: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """(i, j, col_a, col_b, measure, value): v of each two of the texts (0 if one has a single level), eta of a text and a
    number (0 if it has a single level or the number does not vary); pairs without a common row are left out."""
    if not texts or len(texts) + len(numbers) < 2:
        return df.sparkSession.createDataFrame([], "i int, j int, col_a string, col_b string, measure string, value double")
    shift = np.array([f["mean"] for f in column_facts(df, numbers)]) if numbers else np.zeros(0)
    found = cells(df, texts, numbers, shift)
    # both measures from one aggregate of each pair, so that the cells are counted once
    pair, two_texts = ["i", "j"], F.col("j") < len(texts)
    total = lambda by: F.sum("n").over(Window.partitionBy(*pair, by)).cast("double")
    found = found.withColumn("na", total("a")).withColumn("nb", total(F.coalesce("b", "a")))
    # a level's share of its margin adds up to 1, so such sums count the levels
    levels = lambda margin: F.round(F.sum(F.col("n") / F.col(margin)))
    part = F.col("s") * F.col("s") / F.col("n")
    facts = found.groupBy(*pair).agg(
        F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("share"), (F.least(levels("na"), levels("nb")) - 1).alias("degrees"),
        F.count(F.lit(1)).alias("levels"), (F.sum(part) - F.sum("s") * F.sum("s") / F.sum("n")).alias("between"), F.sum(F.col("ss") - part).alias("within"), F.sum("ss").alias("square"),
    )
    chi = F.greatest(F.lit(0.0), F.col("n") * (F.col("share") - 1))
    v = F.when(F.col("degrees") > 0, F.sqrt(chi / F.nullif(F.col("n") * F.col("degrees"), F.lit(0.0)))).otherwise(0.0)
    between, within = F.greatest("between", F.lit(0.0)), F.greatest("within", F.lit(0.0))
    varies = (F.col("levels") > 1) & (between + within > 1e-13 * F.col("square"))
    eta = F.when(varies, F.sqrt(between / F.nullif(between + within, F.lit(0.0)))).otherwise(0.0)
    measured = facts.select(*pair, F.when(two_texts, "v").otherwise("eta").alias("measure"), F.when(two_texts, v).otherwise(eta).alias("value"))
    names = F.array(*map(F.lit, [*texts, *numbers]))
    return measured.select(*pair, names[F.col("i")].alias("col_a"), names[F.col("j")].alias("col_b"), "measure", "value")

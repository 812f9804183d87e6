"""Records of delimited text, where quoted cells may hold line ends, read by many tasks at once.

A line is entered at a record's start or within quotes, and leaves the next line in one of the two; a
quote opens a cell only where the cell begins. So each split of a file is summed up by where it leaves for
both ways to enter it. These sums, one row a split, are composed in the file's order; then every split
knows how it is entered, and cuts its lines into records alone. A record that crosses splits is put
together from its parts, which are all that is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import ROW_ID

#: How a line is entered.
START, QUOTED = 0, 1

#: Records that leave a task at once.
AT_ONCE = 8192


@dataclass(frozen=True)
class Quoting:
    """What a line does to the state, for one separator."""

    opens: re.Pattern[str]
    stays: re.Pattern[str]

    @classmethod
    def by(cls, sep: str) -> Quoting:
        s = re.escape(sep)
        plain, inside = f"[^{s}]*+", '(?:[^"]|"")*+'
        cell = f'(?: *+"{inside}"{plain}|(?! *+"){plain})'
        opens = f'(?:{cell}{s})*+ *+"{inside}'  # whole cells, then one that isn't closed
        return cls(re.compile(opens, re.DOTALL), re.compile(f'{inside}(?:"{plain}{s}{opens})?+', re.DOTALL))

    def after(self, line: str, state: int) -> int:
        if '"' not in line:
            return state
        return QUOTED if (self.opens if state == START else self.stays).fullmatch(line) else START


def with_row_id(df: DataFrame) -> DataFrame:
    """__row_id 0..n-1 in the file's order: partitions are counted, and each continues where the others end."""
    tagged = df.withColumn("__m", F.monotonically_increasing_id())
    at = F.shiftright("__m", 33)
    counts = tagged.groupBy(at.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    starts, n = [], 0
    for r in counts:
        starts.append((r["p"], n))
        n += r["n"]
    # one row for each partition of the file: a table to join, not a plan that grows with them
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "__p long, __offset long"))
    joined = tagged.join(offsets, at == F.col("__p"))
    return joined.select((F.col("__offset") + F.col("__m").bitwiseAND((1 << 33) - 1)).cast("long").alias(ROW_ID), *[F.col(f"`{c}`") for c in df.columns])


def text_lines(spark: SparkSession, path: str, end: str = "\n") -> DataFrame:
    """(value, file, block): lines, and the split of the file that each begins in. Order within a split is the file's."""
    source = spark.read.option("lineSep", end).text(path)
    return source.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


SUMS = "file string, block long, from_start int, from_quoted int, start_spans boolean, quoted_spans boolean, quoted_closes boolean"


def split_sums(lines: DataFrame, quoting: Quoting) -> pd.DataFrame:
    """One row for each split that has a quote: where it leaves, whether any of its lines ends within quotes, and whether
    quotes that it is entered in close."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, out = None, []
        for pdf in batches:
            for file, block, line in zip(pdf["file"], pdf["block"], pdf["value"], strict=True):
                if (file, block) != at:
                    at = (file, block)
                    out.append([file, block, START, QUOTED, False, False, False])
                row = out[-1]
                row[2], row[3] = quoting.after(line, row[2]), quoting.after(line, row[3])
                row[4], row[5], row[6] = row[4] or row[2] == QUOTED, row[5] or row[3] == QUOTED, row[6] or row[3] == START
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SUMS.split(", ")])

    return lines.where(F.col("value").contains('"')).mapInPandas(run, SUMS).toPandas().sort_values(["file", "block"])


def composed(sums: pd.DataFrame, splits: pd.DataFrame) -> tuple[pd.DataFrame, bool]:
    """(file, block, split, entry, owner) in order, and whether any record crosses a line. ``owner`` is the split in which
    the record began that the split is entered in."""
    known = {(r.file, r.block): r for r in sums.itertuples()}
    rows, spans, file, state, owner = [], False, None, START, -1
    for i, r in enumerate(splits.sort_values(["file", "block"]).itertuples()):
        if r.file != file:
            file, state = r.file, START
        rows.append((r.file, r.block, i, state, owner if state == QUOTED else i))
        s = known.get((r.file, r.block))
        if s is not None:
            leaves = s.from_start if state == START else s.from_quoted
            spans |= bool(s.start_spans if state == START else s.quoted_spans)
            if leaves == QUOTED and (state == START or s.quoted_closes):
                owner = i
            state = leaves
    return pd.DataFrame(rows, columns=["file", "block", "split", "entry", "owner"]), spans


PARTS = "split int, i long, part int, whole boolean, value string"


def _cut(quoting: Quoting, end: str):
    """Lines with the split they are in to records; a record that crosses splits comes in parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        at, i, state, held, inherited = None, 0, START, [], None

        def ended() -> None:
            """What a split leaves open."""
            if held:
                out.append((at, i, at, False, end.join(held)) if inherited is None else (inherited, None, at, False, end.join(held)))

        for pdf in batches:
            for line, split, entry, owner in zip(pdf["value"], pdf["split"], pdf["entry"], pdf["owner"], strict=True):
                if split != at:
                    ended()
                    at, i, state, held, inherited = split, 0, entry, [], owner if entry == QUOTED else None
                state = quoting.after(line, state)
                if state == QUOTED:
                    held.append(line)
                elif inherited is not None:
                    out.append((inherited, None, at, False, end.join([*held, line])))
                    held, inherited = [], None
                elif held or line.strip():
                    out.append((at, i, at, True, end.join([*held, line])))
                    held, i = [], i + 1
                if len(out) >= AT_ONCE:
                    yield _frame(out)
                    out.clear()
        ended()
        yield _frame(out)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PARTS.split(", ")]).astype({"i": "Int64"})


def records(spark: SparkSession, path: str, sep: str, end: str = "\n") -> DataFrame:
    """(__row_id, value): the file's records in order, without blank ones; line ends within quotes are kept."""
    lines, quoting = text_lines(spark, path, end), Quoting.by(sep)
    sums = split_sums(lines, quoting)
    if not sums["start_spans"].any():  # the file is entered at a start, and never leaves it
        return _numbered_lines(lines)
    table, spans = composed(sums, lines.groupBy("file", "block").count().toPandas())
    if not spans:
        return _numbered_lines(lines)
    splits = F.broadcast(spark.createDataFrame(table, "file string, block long, split int, entry int, owner int"))  # a row for each split
    parts = lines.join(splits, ["file", "block"]).select("value", "split", "entry", "owner").mapInPandas(_cut(quoting, end), PARTS)
    counts = parts.where("i is not null").groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.toPandas().sort_values("split")  # a row for each split, as above
    starts["offset"] = starts["n"].cumsum() - starts["n"]
    offsets = F.broadcast(spark.createDataFrame(starts[["split", "offset"]], "split int, offset long"))
    in_order = F.array_sort(F.collect_list(F.struct("part", "value")))
    crossing = parts.where("not whole").groupBy("split").agg(F.max("i").alias("i"), F.array_join(F.transform(in_order, lambda p: p["value"]), end).alias("value"))
    rows = parts.where("whole").select("split", "i", "value").unionByName(crossing)
    return rows.join(offsets, "split").select((F.col("offset") + F.col("i")).cast("long").alias(ROW_ID), "value")


def _numbered_lines(lines: DataFrame) -> DataFrame:
    return with_row_id(lines.where(F.trim(F.col("value")) != "").select("value"))

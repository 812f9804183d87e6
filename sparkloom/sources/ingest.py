"""Reading tables: delimited text of unknown dialect, and Parquet. A sample on the driver finds the dialect;
Spark reads the file.
"""

from __future__ import annotations

import csv
from collections import Counter
from dataclasses import dataclass
from io import StringIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import NULL_TOKENS, ROW_ID, as_number, nan_to_null
from .records import records, with_row_id

DELIMITERS = (",", "\t", ";", "|")
#: Of a file's head, the bytes and lines that decide its dialect.
SAMPLE_BYTES, SAMPLE_LINES = 1 << 20, 2000


def file_type(head: bytes) -> str:
    """zip, csv (UTF-8, with or without mark) or unknown."""
    if head.startswith(b"PK\x03\x04"):
        return "zip"
    for keep in range(4):  # the sample may end within a character
        try:
            head[: len(head) - keep].decode("utf-8")
            return "csv"
        except UnicodeDecodeError:
            continue
    return "unknown"


def split_line(line: str, sep: str) -> list[str]:
    return [c.strip().strip('"') for c in line.split(sep)]


def sniffed(sample: str) -> str | None:
    try:
        return csv.Sniffer().sniff("\n".join([x for x in sample.splitlines() if x.strip()][:25]), delimiters="".join(DELIMITERS)).delimiter
    except csv.Error:
        return None


def parsed(sample: str, sep: str, skip: int = 0) -> pd.DataFrame | None:
    for end in ("", '"'):  # the sample may end within quotes
        try:
            return pd.read_csv(StringIO(sample + end), sep=sep, skiprows=skip, engine="python")
        except (ValueError, csv.Error):
            continue
    return None


def parse_score(df: pd.DataFrame | None) -> float:
    """More columns, fewer of them unnamed, and more numbers are better."""
    if df is None or df.empty:
        return -1.0
    k = df.shape[1]
    if k < 2:
        return float(k)
    unnamed = sum(str(c).startswith("Unnamed") for c in df.columns)
    numbers = [float(pd.to_numeric(df[c], errors="coerce").notna().mean()) for c in df.columns]
    return k * (1 - 0.25 * unnamed / k) + 2.5 * sum(numbers) / k


@dataclass(frozen=True)
class Dialect:
    sep: str
    skip: int = 0


def dimension_row(sample: str, sep: str) -> bool:
    """Whether the first line holds the table's size (rows, columns) and the second the names."""
    lines = [x for x in sample.splitlines() if x.strip()]
    if len(lines) < 3:
        return False
    first, second = ([c for c in split_line(x, sep) if c] for x in lines[:2])
    if not (2 <= len(first) <= 6 and first[0].isdigit() and first[1].isdigit()):
        return False
    rows, columns = int(first[0]), int(first[1])
    if not (10 <= rows <= 100_000_000 and 2 <= columns <= 1_000_000):
        return False
    if len(second) < 4 or sum(c.isalpha() for c in "".join(second)) < 12:
        return False
    before, after = parsed(sample, sep), parsed(sample, sep, 1)
    if after is None or after.empty or after.shape[1] < 2:
        return False
    unnamed = lambda d: 0 if d is None else sum(str(c).startswith("Unnamed") for c in d.columns)
    return before is None or (unnamed(after) <= unnamed(before) and parse_score(after) + 0.01 >= parse_score(before))


def dialect(head: bytes) -> Dialect:
    """Of the delimiters the one whose parse scores best (a guess by the csv module goes first, and wins ties);
    white space if none gives two columns; else a comma."""
    kind = file_type(head)
    if kind != "csv":
        raise ValueError(f"not a delimited text file ({kind})")
    text = head.decode("utf-8-sig", errors="ignore")
    if not text.strip():
        raise ValueError("the file is empty")
    guess = sniffed(text)
    order = [guess, *[d for d in DELIMITERS if d != guess]] if guess in DELIMITERS else list(DELIMITERS)
    best, score = None, -1.0
    for sep in order:
        found = parsed(text, sep)
        if found is not None and found.shape[1] >= 2 and (s := parse_score(found)) > score:
            best, score = sep, s
    if best is None:
        blank = parsed(text, r"\s+")
        best = r"\s+" if blank is not None and blank.shape[1] >= 2 else ","
    return Dialect(best, 1 if best != r"\s+" and dimension_row(text, best) else 0)


def head_of(spark: SparkSession, path: str, size: int = SAMPLE_BYTES) -> bytes:
    """The first bytes of a file, or of the first file of a folder, wherever Spark can open it."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getFileStatus(where).isDirectory():
        names = sorted(f.getPath().toString() for f in system.listStatus(where) if f.isFile() and not f.getPath().getName().startswith(("_", ".")))
        if not names:
            return b""
        where = jvm.org.apache.hadoop.fs.Path(names[0])
    stream = system.open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def column_names(header: str, sep: str) -> list[str]:
    """Names of the first record's cells: blank ones by place, repeated ones (whatever their case) numbered."""
    seen: Counter[str] = Counter()
    names = []
    for i, cell in enumerate(next(csv.reader(StringIO(header, newline=""), delimiter=sep, skipinitialspace=True))):
        name = cell or f"Unnamed: {i}"
        while seen[name.lower()]:
            seen[name.lower()] += 1
            name = f"{name}.{seen[name.lower()] - 1}"
        seen[name.lower()] += 1
        names.append(name)
    return names


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A table of inferred types with __row_id; malformed records are kept as far as they parse. Line ends within quotes are
    part of a cell wherever they stand (see records), and every file is read by as many tasks as it has splits."""
    head = head_of(spark, path)
    if file_type(head) != "csv":
        raise ValueError(f"not a delimited text file ({file_type(head)})")
    end = "\r" if b"\r" in head and b"\n" not in head else "\n"
    if len(head) == SAMPLE_BYTES:  # whole lines, where there are any
        head = head[: head.rfind(b"\n") + 1] or head
    sample = b"\n".join(head.replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")[:SAMPLE_LINES])
    how = dialect(sample)
    if how.sep == r"\s+":
        cells = spark.read.option("lineSep", end).text(path).where(F.length(F.trim("value")) > 0).select(F.split(F.trim(F.rtrim("value", F.lit("\r"))), r"\s+").alias("c"))
        names = [c.lstrip("\ufeff") for c in cells.first()["c"]]
        df = with_row_id(cells).where(f"{ROW_ID} > 0").select((F.col(ROW_ID) - 1).alias(ROW_ID), *[F.try_element_at("c", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
    else:
        rows = records(spark, path, how.sep, end)
        first = rows.where(f"{ROW_ID} = {how.skip}").first()
        names = column_names(first["value"].lstrip("\ufeff").rstrip("\r"), how.sep)
        options = {"sep": how.sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true"}
        cells = F.from_csv(F.rtrim("value", F.lit("\r")), ", ".join(f"c{i} string" for i in range(len(names))), options)
        parsed_ = rows.where(f"{ROW_ID} > {how.skip}").select((F.col(ROW_ID) - (how.skip + 1)).alias(ROW_ID), cells.alias("c"))
        df = parsed_.select(ROW_ID, *[F.col(f"c.c{i}").alias(n) for i, n in enumerate(names)])
    if not df.limit(1).count():
        raise ValueError("the file has no data rows")
    return typed(df)


def typed(df: DataFrame) -> DataFrame:
    """Null tokens become null; columns that read wholly as numbers or booleans become such."""
    columns = [c for c in df.columns if c != ROW_ID]
    df = df.select(ROW_ID, *[F.when(~F.col(f"`{c}`").isin(*NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in columns])
    tests = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        tests += [F.count(x).alias(f"n{i}"), F.count(as_number(x)).alias(f"m{i}"), F.count_if(x.rlike(r"^\s*[+-]?[0-9]{1,18}\s*$")).alias(f"i{i}"), F.count_if(F.lower(x).isin("true", "false")).alias(f"b{i}")]
    facts = df.agg(*tests).first() if tests else {}
    out = []
    for i, c in enumerate(columns):
        x, n = F.col(f"`{c}`"), facts[f"n{i}"]
        if n and facts[f"b{i}"] == n:
            x = x.try_cast("boolean")
        elif n and facts[f"i{i}"] == n:
            x = F.trim(x).try_cast("long")
        elif facts[f"m{i}"] == n:
            x = as_number(x)
        out.append(x.alias(c))
    return df.select(ROW_ID, *out)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    """The first rows (1 to 100) as they were in the file."""
    rows = max(1, min(100, rows))
    ordered = df.orderBy(ROW_ID) if ROW_ID in df.columns else df
    return ordered.limit(rows).drop(ROW_ID)



"""Helpers that the training-data operators share.

Everything durable goes below the folder that the session names in ``spark.checkpoint.dir``, so that
a lost executor costs a re-read and not a failed job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import new_path, remove, scratch, shared_dir, written

__all__ = ["BROADCAST_BYTES", "SPACE", "byte_values", "cut", "each_bytes", "free_name", "id_and_text", "new_path", "remove", "scratch", "shared_dir", "small", "table"]

#: The ASCII white space of the operators' contracts: \x20 and \x09 to \x0D.
SPACE = b" \t\n\x0b\x0c\r"

#: Bytes of one object that an operator may broadcast.
BROADCAST_BYTES = 64 << 20


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: it ends the lineage, and runs once."""
    return written(df, name)


def byte_values(column: pa.Array) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes, without decoding it."""
    return column.cast(pa.large_binary()).to_pylist()


def each_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """The same one by one, so that a batch of long texts is not held twice."""
    for value in column:
        text = value.as_buffer()
        yield text.to_pybytes() if text is not None else None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only what the operators read, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, marked for broadcast if its rows fit the bound; else Spark shuffles. A row counts with
    ``row_bytes``, and with the measured length of its strings and the items of its arrays."""
    sizes = [F.octet_length(f.name) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    sizes += [F.greatest(F.size(f.name), F.lit(0)) * 48 for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    each = sum((F.coalesce(x.cast("long"), F.lit(0)) for x in sizes), F.lit(row_bytes).cast("long"))
    return F.broadcast(df) if (df.agg(F.sum(each)).first()[0] or 0) <= BROADCAST_BYTES // 4 else df

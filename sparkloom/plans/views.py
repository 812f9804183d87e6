"""Derived tables with nulls, planted correlations and rare values, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.ingest import read_parquet

VIEWS = {
    "dirty_lineitem": (
        "lineitem",
        """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity END AS qty,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_returnflag END AS flag,
  CASE WHEN l_orderkey % 3 = 0 THEN l_tax END AS sparse,
  CASE WHEN l_suppkey % 20 = 0 THEN 'n/a' ELSE CAST(l_linenumber AS STRING) END AS numtxt,
  l_linestatus AS linestatus, 'K' AS const_col, CAST(7 AS DOUBLE) AS const_num
FROM lineitem""",
    ),
    "planted_lineitem": (
        "lineitem",
        """SELECT l_orderkey, l_partkey, l_linenumber, l_quantity AS x1, l_extendedprice / CAST(1000 AS DOUBLE) AS x2,
  l_discount * CAST(100 AS DOUBLE) AS x3,
  l_quantity * CAST(2 AS DOUBLE) + CAST(l_partkey % 3 AS DOUBLE) AS x4,
  CAST(3 AS DOUBLE) * l_quantity + CAST(2 AS DOUBLE) * l_extendedprice / CAST(1000 AS DOUBLE)
   - CAST(4 AS DOUBLE) * l_discount * CAST(100 AS DOUBLE)
   + CAST((l_orderkey * 7 + l_partkey * 13) % 101 AS DOUBLE) / CAST(5 AS DOUBLE) AS y
FROM lineitem""",
    ),
    "planted_assoc": (
        "customer",
        """SELECT c_custkey, c_mktsegment,
  CASE WHEN c_acctbal < 1000 THEN 'low' WHEN c_acctbal < 6000 THEN 'mid' ELSE 'high' END AS band,
  CASE WHEN c_custkey % 10 = 0 THEN 'x' WHEN c_acctbal < 1000 THEN 'low' WHEN c_acctbal < 6000 THEN 'mid' ELSE 'high' END AS band2,
  c_acctbal AS a1, c_acctbal * c_acctbal / CAST(1000 AS DOUBLE) AS a2, abs(c_acctbal - CAST(3000 AS DOUBLE)) AS a3,
  CAST(c_nationkey AS DOUBLE) AS a4
FROM customer""",
    ),
    "planted_rare": ("part", "SELECT p_partkey, CASE WHEN p_partkey % 500 = 0 THEN concat('RARE_', CAST(p_partkey % 7 AS STRING)) ELSE p_type END AS cat FROM part"),
    "planted_labels": ("labels", "SELECT doc_id, quality AS y_true, CAST(0.35 AS DOUBLE) * quality + CAST((doc_id * 37) % 100 AS DOUBLE) / CAST(130 AS DOUBLE) AS score FROM labels"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return read_parquet(spark, f"{sf_dir}/{name}.parquet")
    base, sql = VIEWS[name]
    return spark.sql(sql.replace(f"FROM {base}", f"FROM {{{base}}}"), **{base: read_parquet(spark, f"{sf_dir}/{base}.parquet")}) if f"FROM {base}" in sql else spark.sql(sql)


def oracle(sql: str) -> str:
    """A DuckDB query with the derived tables that it names."""
    used = [n for n in VIEWS if n in sql]
    if not used:
        return sql
    head = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in used)
    text = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(start):
            return f"{start}{head}, {text[len(start):]}"
    return f"WITH {head} {text}"

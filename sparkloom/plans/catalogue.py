"""The named queries and their DuckDB counterparts, each written independently of the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as v
from ..operators import assoc, charts, clean, gram, insights, metrics, network, outliers, profile, ranks, select
from ..sources.catalog import newest_first
from ..store import scratch
from .views import oracle, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = oracle(sql)
        return f

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits) + 0.0


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(F.col(c), digits) for c in columns})


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")

# profiles ------------------------------------------------------------------------------------------


@query(
    "numeric_profile",
    union(
        [
            f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count,
 round(avg({c}), 4) + 0.0 AS mean, round(quantile_cont({c}, 0.5), 4) + 0.0 AS median, round(stddev_samp({c}), 4) + 0.0 AS std,
 round(min({c}), 4) + 0.0 AS min, round(max({c}), 4) + 0.0 AS max, round(quantile_cont({c}, 0.25), 4) + 0.0 AS q1, round(quantile_cont({c}, 0.75), 4) + 0.0 AS q3 FROM lineitem"""
            for c in NUMBERS
        ]
    ),
)
def _(spark, d):
    return rounded(profile.numeric_profile(table(spark, d, "lineitem"), list(NUMBERS)), "mean", "median", "std", "min", "max", "q1", "q3", digits=4)


@query(
    "categorical_profile",
    union(
        [
            f"""SELECT '{c}' AS "column", count(*) AS count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count,
 (SELECT {c} FROM dirty_lineitem WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top_value FROM dirty_lineitem"""
            for c in ("flag", "linestatus", "numtxt", "const_col")
        ]
    ),
)
def _(spark, d):
    return profile.categorical_profile(table(spark, d, "dirty_lineitem"))


@query(
    "datetime_profile",
    """SELECT 'o_orderdate' AS "column", count(o_orderdate) AS count, count(*) - count(o_orderdate) AS null_count, min(o_orderdate) AS min,
 max(o_orderdate) AS max, date_diff('day', min(o_orderdate), max(o_orderdate)) AS range_days FROM orders""",
)
def _(spark, d):
    return profile.datetime_profile(table(spark, d, "orders"))


@query(
    "table_summary",
    """SELECT count(*) AS rows, 9::BIGINT AS columns, (9 * count(*) - sum(n))::BIGINT AS missing_cells, round(100.0 * (9 * count(*) - sum(n)) / (9 * count(*)), 2) AS missing_percent
FROM (SELECT (l_orderkey IS NOT NULL)::INT + (l_linenumber IS NOT NULL)::INT + (qty IS NOT NULL)::INT + (flag IS NOT NULL)::INT + (sparse IS NOT NULL)::INT
 + (numtxt IS NOT NULL)::INT + (linestatus IS NOT NULL)::INT + (const_col IS NOT NULL)::INT + (const_num IS NOT NULL)::INT AS n FROM dirty_lineitem)""",
)
def _(spark, d):
    return profile.table_summary(table(spark, d, "dirty_lineitem"))


@query("value_counts_topk", "SELECT p_name AS value, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, value LIMIT 10")
def _(spark, d):
    return profile.value_counts(table(spark, d, "part"), "p_name", 10)


@query(
    "column_metadata",
    union(
        [
            f"""SELECT '{c}' AS "column", count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, '{k}' AS inferred_type, {f"min({c})::DOUBLE" if k == "numeric" else "NULL::DOUBLE"} AS min, {f"max({c})::DOUBLE" if k == "numeric" else "NULL::DOUBLE"} AS max FROM customer"""
            for c, k in (("c_custkey", "numeric"), ("c_name", "categorical"), ("c_nationkey", "numeric"), ("c_acctbal", "numeric"), ("c_mktsegment", "categorical"))
        ]
    ),
)
def _(spark, d):
    return profile.column_metadata(table(spark, d, "customer")).select("column", "null_count", "unique_count", "inferred_type", "min", "max")


# cleaning ------------------------------------------------------------------------------------------

DIRTY = ("l_orderkey", "l_linenumber", "qty", "flag", "sparse", "numtxt", "linestatus", "const_col", "const_num")


@query("high_null_columns", f"""SELECT "column", round(f, 6) AS null_fraction FROM ({union([f'''SELECT '{c}' AS "column", avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS f FROM dirty_lineitem''' for c in DIRTY])}) WHERE f > 0.5""")
def _(spark, d):
    return rounded(profile.null_fractions(table(spark, d, "dirty_lineitem")).where("null_fraction > 0.5"), "null_fraction")


@query(
    "numeric_coercion",
    r"""SELECT l_orderkey, l_linenumber, CASE WHEN regexp_full_match(numtxt, '\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*') THEN try_cast(trim(numtxt) AS DOUBLE) END AS numtxt FROM dirty_lineitem""",
)
def _(spark, d):
    df = table(spark, d, "dirty_lineitem")
    return clean.transform_numeric_like(df, [c for c in clean.fit_numeric_like(df) if c == "numtxt"]).select("l_orderkey", "l_linenumber", "numtxt")


@query("low_cardinality_columns", f"""SELECT "column", n AS distinct_values FROM ({union([f'''SELECT '{c}' AS "column", count(DISTINCT {c}) AS n FROM part''' for c in ("p_name", "p_brand", "p_type")])}) WHERE n < 50""")
def _(spark, d):
    df = table(spark, d, "part")
    few = clean.fit_low_cardinality(df)
    return spark.createDataFrame(list(ranks.distinct_counts(df, few).items()), "column string, distinct_values long")


@query("iqr_fences", "SELECT 'value' AS \"column\", count(value) AS n, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3 FROM events")
def _(spark, d):
    return rounded(outliers.fences(table(spark, d, "events"), ["value"]), "q1", "q3")


@query(
    "iqr_row_filter",
    """SELECT event_id, value FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
WHERE value IS NULL OR value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
)
def _(spark, d):
    df = table(spark, d, "events").select("event_id", "value")
    return clean.transform_iqr(df, clean.fit_iqr(df.select("value")))


@query(
    "sign_row_filter",
    """SELECT c_custkey, c_acctbal FROM customer, (SELECT count(*) FILTER (c_acctbal > 0) / count(c_acctbal) AS pos, count(*) FILTER (c_acctbal < 0) / count(c_acctbal) AS neg FROM customer)
WHERE NOT (pos >= 0.85 AND c_acctbal < 0) AND NOT (neg >= 0.85 AND c_acctbal > 0)""",
)
def _(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return clean.transform_signs(df, clean.fit_signs(df.select("c_acctbal")))


@query("dedup_rows", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def _(spark, d):
    return clean.drop_duplicates(table(spark, d, "customer").select("c_nationkey", "c_mktsegment"))


@query("dedup_documents", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def _(spark, d):
    return clean.copies(table(spark, d, "documents"), ["text"], "doc_id")


@query(
    "date_parse",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE date_trunc('day', o_orderdate)::TIMESTAMP END AS parsed FROM orders""",
)
def _(spark, d):
    day = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format(day, "M/d/yyyy")).when(F.col("o_orderkey") % 4 == 2, F.date_format(day, "yyyyMMdd")).otherwise(F.lit("no date"))
    return table(spark, d, "orders").select("o_orderkey", v.as_date(text).alias("parsed"))


@query("impute_median", "SELECT l_orderkey, l_linenumber, coalesce(qty, (SELECT quantile_cont(qty, 0.5) FROM dirty_lineitem)) AS qty FROM dirty_lineitem")
def _(spark, d):
    df = table(spark, d, "dirty_lineitem").select("l_orderkey", "l_linenumber", "qty")
    return clean.transform_medians(df, clean.fit_medians(df.select("qty")))


@query("impute_mode", "SELECT l_orderkey, l_linenumber, coalesce(flag, (SELECT flag FROM dirty_lineitem WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag FROM dirty_lineitem")
def _(spark, d):
    df = table(spark, d, "dirty_lineitem").select("l_orderkey", "l_linenumber", "flag")
    return clean.transform_modes(df, clean.fit_modes(df.select("flag")))


@query("constant_categoricals", f"""SELECT "column" FROM ({union([f'''SELECT '{c}' AS "column", count(DISTINCT {c}) AS n FROM dirty_lineitem''' for c in ("flag", "numtxt", "linestatus", "const_col")])}) WHERE n <= 1""")
def _(spark, d):
    df = table(spark, d, "dirty_lineitem")
    found = clean.fit_categories(df, v.text_columns(df)).constant
    return spark.createDataFrame([(c,) for c in found], "column string")


@query("binary_encode", "SELECT l_orderkey, l_linenumber, CASE l_linestatus WHEN 'O' THEN 1 WHEN 'F' THEN 0 END AS l_linestatus FROM lineitem")
def _(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    return clean.transform_categories(df, clean.fit_categories(df, ["l_linestatus"]))


@query("drop_remaining_nulls", f"SELECT l_orderkey, l_linenumber, qty, flag FROM dirty_lineitem WHERE qty IS NOT NULL AND flag IS NOT NULL")  # noqa: F541
def _(spark, d):
    return clean.drop_null_rows(table(spark, d, "dirty_lineitem").select("l_orderkey", "l_linenumber", "qty", "flag"))


# Each decision of the report by itself; only the rows' way through the steps takes it as given that sparse goes and numtxt is numbers.
CLEANED_NUMBERS, CLEANED_TEXTS = ("l_orderkey", "l_linenumber", "qty", "numtxt", "const_num"), ("flag", "linestatus", "const_col")
NUMBER_SQL = r"'\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*'"


def listed(rows: str, order: str = "c") -> str:
    """The names of column c as a list is shown."""
    return f"""(SELECT '[' || coalesce(string_agg(chr(39) || c || chr(39), ', ' ORDER BY {order}), '') || ']' FROM ({rows}))"""


CLEAN_REPORT = f"""WITH shares AS ({union([f"SELECT '{c}' AS c, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS nulls FROM dirty_lineitem" for c in DIRTY])}),
typed AS (SELECT l_orderkey, l_linenumber, qty, flag, CASE WHEN regexp_full_match(numtxt, {NUMBER_SQL}) THEN trim(numtxt)::DOUBLE END AS numtxt, linestatus, const_col, const_num FROM dirty_lineitem),
texts AS ({union([f"SELECT {i} AS i, '{c}' AS c, count(DISTINCT {c}) AS n FROM typed" for i, c in enumerate(CLEANED_TEXTS)])}),
fences AS (SELECT {", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in CLEANED_NUMBERS)} FROM typed),
inside AS (SELECT typed.* FROM typed, fences WHERE NOT ({" OR ".join(f"coalesce(a_{c} <> b_{c} AND ({c} < a_{c} - 1.5 * (b_{c} - a_{c}) OR {c} > b_{c} + 1.5 * (b_{c} - a_{c})), false)" for c in CLEANED_NUMBERS)})),
signs AS (SELECT {", ".join(f"count_if({c} > 0) / count({c}) >= 0.85 AS pos_{c}, count_if({c} < 0) / count({c}) >= 0.85 AS neg_{c}" for c in CLEANED_NUMBERS)} FROM inside),
signed AS (SELECT inside.* FROM inside, signs WHERE NOT ({" OR ".join(f"coalesce((pos_{c} AND {c} < 0) OR (neg_{c} AND {c} > 0), false)" for c in CLEANED_NUMBERS)})),
single AS (SELECT DISTINCT * FROM signed),
blanks AS ({union([f"SELECT '{c}' AS c, {str(c in CLEANED_NUMBERS).lower()} AS number, count(*) - count({c}) AS n FROM single" for c in (*CLEANED_NUMBERS, *CLEANED_TEXTS)])}),
modes AS (SELECT {", ".join(f"(SELECT {c} FROM single WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS m_{c}" for c in CLEANED_TEXTS)}),
medians AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in CLEANED_NUMBERS)} FROM single),
filled AS (SELECT {", ".join(f"coalesce({c}, medians.m_{c}) AS {c}" for c in CLEANED_NUMBERS)}, {", ".join(f"coalesce({c}, modes.m_{c}) AS {c}" for c in CLEANED_TEXTS)} FROM single, medians, modes),
levels AS ({union([f"SELECT '{c}' AS c, count(DISTINCT {c}) AS n, bool_and(regexp_full_match({c}, {NUMBER_SQL})) AS numbers FROM filled" for c in CLEANED_TEXTS])}),
coded AS (SELECT *, (linestatus = (SELECT max(linestatus) FROM filled))::INT AS status FROM filled),
etas AS ({union([f"SELECT '{c}' AS other, CASE WHEN max(t) > 0 THEN sqrt(sum(n * (m - g) * (m - g)) / max(t)) ELSE 0 END AS eta FROM (SELECT flag, count({c}) AS n, avg({c}) AS m FROM coded GROUP BY flag), (SELECT avg({c}) AS g, var_pop({c}) * count({c}) AS t FROM coded)" for c in (*CLEANED_NUMBERS, "status")])}),
weak AS (SELECT 'flag' AS c FROM etas HAVING count_if(eta >= 0.3) / count(*) < 0.65)
SELECT 'rows_start' AS item, count(*)::VARCHAR AS value FROM dirty_lineitem
UNION ALL SELECT 'rows_end', count(*)::VARCHAR FROM filled
UNION ALL SELECT 'columns_start', '{len(DIRTY)}'
UNION ALL SELECT 'columns_end', ({len(DIRTY)} - (SELECT count(*) FROM shares WHERE nulls > 0.5) - (SELECT count(*) FROM levels WHERE n <= 1) - (SELECT count(*) FROM weak))::VARCHAR
UNION ALL SELECT 'null_threshold_percent', '50'
UNION ALL SELECT 'iqr_outlier_rows_removed', ((SELECT count(*) FROM typed) - (SELECT count(*) FROM inside))::VARCHAR
UNION ALL SELECT 'sign_anomaly_rows_removed', ((SELECT count(*) FROM inside) - (SELECT count(*) FROM signed))::VARCHAR
UNION ALL SELECT 'duplicate_rows_removed', ((SELECT count(*) FROM signed) - (SELECT count(*) FROM single))::VARCHAR
UNION ALL SELECT 'rows_removed_unresolved_nulls', '0'
UNION ALL SELECT 'iqr_multiplier', '1.5'
UNION ALL SELECT 'sign_anomaly_threshold', '0.85'
UNION ALL SELECT 'outlier_row_removal_enabled', 'True'
UNION ALL SELECT 'drop_remaining_null_rows_enabled', 'True'
UNION ALL SELECT 'columns_dropped_high_null', {listed("SELECT c FROM shares WHERE nulls > 0.5")}
UNION ALL SELECT 'low_cardinality_columns_as_category', {listed("SELECT c, i FROM texts WHERE n < 50", "i")}
UNION ALL SELECT 'numeric_columns_filled', {listed("SELECT c FROM blanks WHERE number AND n > 0")}
UNION ALL SELECT 'categorical_columns_filled', {listed("SELECT c FROM blanks WHERE NOT number AND n > 0")}
UNION ALL SELECT 'binary_categorical_columns_encoded', {listed("SELECT c FROM levels WHERE n = 2 AND NOT numbers")}
UNION ALL SELECT 'single_value_categorical_columns_dropped', {listed("SELECT c FROM levels WHERE n <= 1")}
UNION ALL SELECT 'categorical_columns_dropped_low_association', {listed("SELECT c FROM weak")}
"""


@query("clean_pipeline", CLEAN_REPORT)
def _(spark, d):
    with scratch(spark):  # the report is all that is asked for
        _, report = clean.clean(table(spark, d, "dirty_lineitem"))
    found = report.as_dict()
    return spark.createDataFrame([(k, str(x)) for k, x in found.items()], "item string, value string")


# association ---------------------------------------------------------------------------------------

ETA = """SELECT '{c}' AS "column", round(sqrt(sum(n * (m - g) * (m - g)) / max(t)), 6) AS eta
FROM (SELECT {k} AS k, count({c}) AS n, avg({c}) AS m FROM planted_assoc GROUP BY {k}), (SELECT avg({c}) AS g, var_pop({c}) * count({c}) AS t FROM planted_assoc)"""


@query("eta_association", union([ETA.format(c=c, k="band") for c in ("a1", "a2", "a3", "a4")]))
def _(spark, d):
    return rounded(assoc.correlation_ratios(table(spark, d, "planted_assoc"), "band", ["a1", "a2", "a3", "a4"]), "eta")


CRAMER = """WITH a AS (SELECT {a} AS x, count(*) AS n FROM planted_assoc GROUP BY 1), b AS (SELECT {b} AS y, count(*) AS n FROM planted_assoc GROUP BY 1),
o AS (SELECT {a} AS x, {b} AS y, count(*) AS n FROM planted_assoc GROUP BY 1, 2), t AS (SELECT count(*)::DOUBLE AS n FROM planted_assoc),
e AS (SELECT a.n * b.n / t.n AS want, coalesce(o.n, 0) AS got FROM a CROSS JOIN b CROSS JOIN t LEFT JOIN o ON o.x = a.x AND o.y = b.y)
SELECT round(sqrt(sum((got - want) * (got - want) / want) / ((SELECT n FROM t) * least((SELECT count(*) FROM a) - 1, (SELECT count(*) FROM b) - 1))), 6) AS v FROM e"""


@query("cramers_v", CRAMER.format(a="band", b="band2"))
def _(spark, d):
    return rounded(assoc.cramers_v(table(spark, d, "planted_assoc"), "band", "band2"), "v")


CATEGORIES = ("c_mktsegment", "band", "band2")
#: Each categorical column against four numbers and two other categorical ones: weak if under 65% of these reach 0.3.
MEASURES = union([f"SELECT '{k}' AS c, eta AS m FROM ({ETA.format(c=x, k=k)}) AS e_{k}_{x}" for k in CATEGORIES for x in ("a1", "a2", "a3", "a4")] + [f"SELECT '{a}' AS c, v AS m FROM ({CRAMER.format(a=a, b=b)}) AS v_{a}_{b}" for a in CATEGORIES for b in CATEGORIES if a != b])


@query("weak_categoricals", f"""SELECT c AS "column" FROM ({MEASURES}) AS m GROUP BY c HAVING count(*) FILTER (m >= 0.3) / 6.0 < 0.65""")
def _(spark, d):
    found = clean.fit_weak_categories(table(spark, d, "planted_assoc").drop("c_custkey"), ["c_mktsegment", "band", "band2"])
    return spark.createDataFrame([(c,) for c in found], "column string")


XS = ("x1", "x2", "x3", "x4", "y")
PAIRS = [(a, b) for i, a in enumerate(XS) for b in XS[i + 1 :]]


@query("correlation_matrix", union([f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 3) + 0.0 AS r FROM planted_lineitem" for a in XS for b in XS]))
def _(spark, d):
    return assoc.correlation_matrix(table(spark, d, "planted_lineitem"), list(XS))


@query("correlation_constant", "SELECT 'qty' AS col_a, 'const_num' AS col_b, CASE WHEN isnan(corr(qty, const_num)) THEN NULL ELSE corr(qty, const_num) END AS r FROM dirty_lineitem")
def _(spark, d):
    return assoc.correlation_pairs(table(spark, d, "dirty_lineitem"), ["qty", "const_num"]).select("col_a", "col_b", "r")


@query("correlation_pairs", "SELECT col_a, col_b, round(r, 3) + 0.0 AS r, CASE WHEN abs(r) >= 0.7 THEN 'strong' ELSE 'moderate' END AS strength FROM (" + union([f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM planted_lineitem" for a, b in PAIRS]) + ")")
def _(spark, d):
    return assoc.pair_list(table(spark, d, "planted_lineitem"), list(XS))


@query(
    "target_relationships",
    "SELECT \"column\", round(r, 3) + 0.0 AS r, CASE WHEN abs(r) >= 0.7 THEN 'strong' ELSE 'moderate' END AS strength, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM (" + union([f"SELECT '{c}' AS \"column\", corr({c}, y) AS r FROM planted_lineitem" for c in XS[:4]]) + ") WHERE abs(r) > 0.3",
)
def _(spark, d):
    return assoc.target_relationships(table(spark, d, "planted_lineitem").select(*XS), "y")


# outliers ------------------------------------------------------------------------------------------


@query(
    "iqr_outlier_report",
    """WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3, count(n_chars) AS n FROM documents),
b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, n FROM q)
SELECT 'n_chars' AS "column", count(*) FILTER (n_chars < lo OR n_chars > hi) AS outlier_count, round(any_value(lo), 2) AS lower_bound, round(any_value(hi), 2) AS upper_bound,
 round(100.0 * count(*) FILTER (n_chars < lo OR n_chars > hi) / any_value(n), 2) AS outlier_percent FROM documents, b""",
)
def _(spark, d):
    return outliers.iqr_report(table(spark, d, "documents"), ["n_chars"])


@query("rare_categories", "SELECT cat AS value, count(*) AS n FROM planted_rare GROUP BY cat HAVING count(*) <= greatest((SELECT count(*) FROM planted_rare) * 0.01, 5)")
def _(spark, d):
    return outliers.rare_values(table(spark, d, "planted_rare"), "cat")


# networks ------------------------------------------------------------------------------------------


#: Columns of planted_lineitem whose correlations make a network of one large and two single columns.
NETWORK = ("x1", "x2", "x3", "x4", "y", "l_linenumber")
EDGES = "edges AS (" + " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM planted_lineitem" for i, a in enumerate(NETWORK) for b in NETWORK[i + 1 :]) + ")"
REACH = f"""WITH RECURSIVE {EDGES}, names AS (SELECT col_a AS c FROM edges UNION SELECT col_b FROM edges),
links AS (SELECT col_a AS a, col_b AS b FROM edges WHERE abs(r) >= 0.35 UNION ALL SELECT col_b, col_a FROM edges WHERE abs(r) >= 0.35),
reach AS (SELECT c, c AS z FROM names UNION SELECT reach.c, links.b FROM reach JOIN links ON links.a = reach.z),
of AS (SELECT c AS "column", min(z) AS component, count(*) AS size FROM reach GROUP BY c)"""


def network_pairs(spark: SparkSession, d: str) -> DataFrame:
    return assoc.correlation_pairs(table(spark, d, "planted_lineitem"), list(NETWORK))


@query("correlation_components", REACH + "\nSELECT *, size = (SELECT max(size) FROM of) AS is_largest FROM of")
def _(spark, d):
    return network.component_table(network_pairs(spark, d), NETWORK)


@query("correlation_centrality", f"WITH {EDGES} SELECT c AS \"column\", round(sum(abs(r)), 6) AS centrality FROM (SELECT col_a AS c, r FROM edges UNION ALL SELECT col_b, r FROM edges) GROUP BY c")
def _(spark, d):
    return rounded(network.centrality(network_pairs(spark, d)), "centrality")


MAIN_NETWORK = REACH + """,
main AS (SELECT "column" AS c FROM of WHERE component = (SELECT component FROM of ORDER BY size DESC, component LIMIT 1)),
inside AS (SELECT * FROM edges WHERE col_a IN (SELECT c FROM main) AND col_b IN (SELECT c FROM main)),
ends AS (SELECT col_a AS c, r FROM inside UNION ALL SELECT col_b, r FROM inside),
central AS (SELECT main.c AS "column", coalesce(sum(abs(r)), 0) AS centrality FROM main LEFT JOIN ends ON ends.c = main.c GROUP BY main.c)
"""


@query("main_network_centrality", MAIN_NETWORK + 'SELECT "column", round(centrality, 6) AS centrality FROM central')
def _(spark, d):
    return rounded(network.main_centrality(network_pairs(spark, d), NETWORK), "centrality")


@query("most_important_column", MAIN_NETWORK + 'SELECT "column" FROM central ORDER BY centrality DESC, "column" LIMIT 1')
def _(spark, d):
    return network.main_centrality(network_pairs(spark, d), NETWORK).orderBy(F.desc("centrality"), "column").limit(1).select("column")


NAMES = ("the", "de", "und", "qty_1", "a")


@query("mentioned_columns", union([f"SELECT doc_id, '{n}' AS name FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9_]){n}($|[^a-z0-9_])')" for n in NAMES if len(n) > 1]))
def _(spark, d):
    # names are found once a text, and not again in a filter that Spark derives from the explode
    found = F.explode(F.array(*[F.when(v.mentions(F.col("text"), n), F.lit(n)) for n in NAMES]))
    return table(spark, d, "documents").select("doc_id", found.alias("name")).where("name is not null")


# charts --------------------------------------------------------------------------------------------


@query("series_projection", r"SELECT qty::DOUBLE AS qty, CASE WHEN regexp_full_match(numtxt, '[0-9]+') THEN numtxt::DOUBLE END AS numtxt FROM dirty_lineitem")
def _(spark, d):
    return charts.series(table(spark, d, "dirty_lineitem"), ["qty", "numtxt", "missing"])


HIST = """WITH f AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, greatest(10, least({most}, floor(sqrt(count(*)) + 0.5)))::INT AS bins FROM ({src}))
SELECT bin::INT AS bin, round(lo + bin * (hi - lo) / bins, 4) AS lower, round(lo + (bin + 1) * (hi - lo) / bins, 4) AS upper, n FROM (
 SELECT least(floor((x - lo) / ((hi - lo) / bins)), bins - 1) AS bin, count(*) AS n FROM ({src}), f GROUP BY 1), (SELECT lo, hi, bins FROM f)"""


@query("histogram", HIST.format(most=30, src="SELECT l_extendedprice AS x FROM lineitem"))
def _(spark, d):
    return rounded(charts.histogram(table(spark, d, "lineitem"), "l_extendedprice"), "lower", "upper", digits=4)


@query("residual_histogram", HIST.format(most=40, src="SELECT y - (3 * x1 + 2 * x2) AS x FROM planted_lineitem"))
def _(spark, d):
    df = charts.residuals(table(spark, d, "planted_lineitem").withColumn("said", 3 * F.col("x1") + 2 * F.col("x2")), "y", "said")
    return rounded(charts.histogram(df, "residual", 40), "lower", "upper", digits=4)


@query(
    "box_plot",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
 min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS lower_whisker, max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS upper_whisker,
 count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers FROM events, q""",
)
def _(spark, d):
    return rounded(charts.box_plot(table(spark, d, "events"), "value"), "q1", "median", "q3")


@query("scatter_points", "SELECT qty AS x, sparse AS y FROM dirty_lineitem WHERE qty IS NOT NULL AND sparse IS NOT NULL")
def _(spark, d):
    return charts.scatter(table(spark, d, "dirty_lineitem"), "qty", "sparse")


@query("corr_badges", "SELECT col_a, col_b, CASE WHEN abs(r) > 0.8 THEN 'red' WHEN abs(r) > 0.6 THEN 'orange' ELSE 'blue' END AS badge FROM (" + union([f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 3) AS r FROM planted_lineitem" for a, b in PAIRS]) + ") ORDER BY abs(r) DESC LIMIT 6")
def _(spark, d):
    return assoc.pair_list(table(spark, d, "planted_lineitem"), list(XS)).limit(6).select("col_a", "col_b", charts.badge(F.col("r")).alias("badge"))


@query(
    "confusion_matrix",
    """WITH p AS (SELECT y_true::VARCHAR AS a, (score >= 0.5)::INT::VARCHAR AS p FROM planted_labels), l AS (SELECT a AS x FROM p UNION SELECT p FROM p)
SELECT l.x AS actual, m.x AS predicted, count(p.a) AS n FROM l CROSS JOIN l AS m LEFT JOIN p ON p.a = l.x AND p.p = m.x GROUP BY 1, 2""",
)
def _(spark, d):
    df = table(spark, d, "planted_labels").withColumn("said", (F.col("score") >= 0.5).cast("int"))
    return charts.confusion_matrix(df, "y_true", "said")


@query("residuals", "SELECT l_orderkey, l_linenumber, round(y - (3 * x1 + 2 * x2), 6) + 0.0 AS residual FROM planted_lineitem")
def _(spark, d):
    df = table(spark, d, "planted_lineitem").withColumn("said", 3 * F.col("x1") + 2 * F.col("x2"))
    return rounded(charts.residuals(df, "y", "said").select("l_orderkey", "l_linenumber", "residual"), "residual")


@query("pred_vs_actual_range", "SELECT round(least(min(y), min(3 * x1 + 2 * x2)), 6) + 0.0 AS low, round(greatest(max(y), max(3 * x1 + 2 * x2)), 6) + 0.0 AS high FROM planted_lineitem")
def _(spark, d):
    df = table(spark, d, "planted_lineitem").withColumn("said", 3 * F.col("x1") + 2 * F.col("x2"))
    return rounded(charts.identity_range(df, "y", "said"), "low", "high")


# models --------------------------------------------------------------------------------------------


@query("ols_simple", "SELECT round(regr_slope(y, x1), 6) AS slope, round(regr_intercept(y, x1), 6) AS intercept, round(regr_r2(y, x1), 6) AS r2 FROM planted_lineitem")
def _(spark, d):
    return rounded(gram.simple_ols(table(spark, d, "planted_lineitem"), "x1", "y"), "slope", "intercept", "r2")


@query(
    "ols_multi_gram",
    """WITH m AS (SELECT var_pop(x1) AS a, covar_pop(x1, x2) AS b, var_pop(x2) AS c, covar_pop(x1, y) AS p, covar_pop(x2, y) AS q, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM planted_lineitem),
s AS (SELECT (p * c - q * b) / (a * c - b * b) AS b1, (q * a - p * b) / (a * c - b * b) AS b2, * FROM m)
SELECT 'x1' AS feature, round(b1, 4) AS coefficient FROM s UNION ALL SELECT 'x2', round(b2, 4) FROM s UNION ALL SELECT 'intercept', round(my - b1 * m1 - b2 * m2, 4) FROM s""",
)
def _(spark, d):
    g = gram.grams(table(spark, d, "planted_lineitem"), ["x1", "x2"], "y", roles=F.array(F.lit("train")))
    intercept, slopes = g.coefficients(["x1", "x2"])
    rows = spark.createDataFrame([("intercept", intercept), *slopes.items()], "feature string, coefficient double")
    return rounded(rows, "coefficient", digits=4)


@query(
    "r2_mae_rmse",
    """SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse
FROM (SELECT y, 3 * x1 + 2 * x2 AS p FROM planted_lineitem)""",
)
def _(spark, d):
    df = table(spark, d, "planted_lineitem").withColumn("said", 3 * F.col("x1") + 2 * F.col("x2"))
    return rounded(metrics.regression_scores(df, "y", "said"), "r2", "mae", "rmse")


F1 = "coalesce(2.0 * count(*) FILTER (y = {l} AND p = {l}) / nullif(count(*) FILTER (y = {l}) + count(*) FILTER (p = {l}), 0), 0)"


@query("macro_f1_accuracy", f"SELECT round(avg((y = p)::INT), 6) AS accuracy, round(({F1.format(l=0)} + {F1.format(l=1)}) / 2, 6) AS f1_macro FROM (SELECT y_true AS y, (score >= 0.5)::INT AS p FROM planted_labels)")
def _(spark, d):
    df = table(spark, d, "planted_labels").withColumn("said", (F.col("score") >= 0.5).cast("int"))
    return rounded(metrics.classification_scores(df, "y_true", "said"), "accuracy", "f1_macro")


@query("threshold_sweep", f"SELECT round(t, 3)::DOUBLE AS threshold, round(({F1.format(l=0)} + {F1.format(l=1)}) / 2, 6) AS f1_macro, round(avg((y = p)::INT), 6) AS accuracy FROM (SELECT y_true AS y, t, (score >= t)::INT AS p FROM planted_labels, (SELECT round(0.05 + 0.025 * i, 3)::DOUBLE AS t FROM range(37) x(i))) GROUP BY t")
def _(spark, d):
    return rounded(metrics.threshold_sweep(table(spark, d, "planted_labels"), "y_true", "score"), "f1_macro", "accuracy")


@query("sigmoid_score", "SELECT event_id, round(1 / (1 + exp(-least(greatest(value / 50 - 2, -30), 30))), 6) AS p FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", r(v.sigmoid(F.col("value") / 50 - 2)).alias("p"))


KIND = """SELECT '{c}' AS "column", count({c}) AS n, count(DISTINCT {c}) AS "distinct", count({c}) >= 20 AND count(DISTINCT {c}) BETWEEN 2 AND least(30, greatest(4, floor(count({c}) * 0.2))) AND {whole} AS is_classification FROM lineitem"""


@query("problem_type", union([KIND.format(c=c, whole="bool_and(abs(l_x - round(l_x)) <= 1e-8 + 1e-5 * abs(round(l_x)))".replace("l_x", c) if n else "true") for c, n in (("l_quantity", True), ("l_linenumber", True), ("l_tax", True), ("l_returnflag", False))]))
def _(spark, d):
    df, out = table(spark, d, "lineitem"), None
    for c, numeric in (("l_quantity", True), ("l_linenumber", True), ("l_tax", True), ("l_returnflag", False)):
        row = metrics.problem_type(df, c, numeric).select(F.lit(c).alias("column"), "n", "distinct", "is_classification")
        out = row if out is None else out.unionByName(row)
    return out


@query("label_codes", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::INT AS code FROM part")
def _(spark, d):
    return metrics.label_codes(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "code")


@query("id_columns", union([f"""SELECT '{c}' AS "column", round(count(DISTINCT {c}) / count(*), 6) AS unique_ratio, {("id" in c) or c.endswith(("_key", "uuid"))} OR count(DISTINCT {c}) / count(*) > 0.95 AS is_id FROM customer""" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")]))
def _(spark, d):
    return rounded(select.id_columns(table(spark, d, "customer")), "unique_ratio")


@query("feature_relevance", union([f"""SELECT '{c}' AS "column", round(abs(corr({c}, y)), 6) AS relevance FROM planted_lineitem""" for c in XS[:4]]))
def _(spark, d):
    return rounded(select.relevance(table(spark, d, "planted_lineitem"), "y", XS[:4]), "relevance")


@query("redundant_features", "SELECT f AS feature FROM (VALUES ('x1'), ('x2'), ('x3'), ('x4')) t(f), (SELECT corr(x1, x4) AS r, abs(corr(x1, y)) AS a, abs(corr(x4, y)) AS b FROM planted_lineitem) WHERE NOT (abs(r) >= 0.95 AND f = CASE WHEN a >= b THEN 'x4' ELSE 'x1' END)")
def _(spark, d):
    df = table(spark, d, "planted_lineitem")
    found = {x["column"]: x["relevance"] for x in select.relevance(df, "y", XS[:4]).collect()}
    kept = select.prune_redundant(sorted(found, key=lambda f: -found[f]), found, select.correlations(df, XS[:4]))
    return spark.createDataFrame([(f,) for f in kept], "feature string")


@query("engineered_features", "SELECT l_orderkey, l_linenumber, l_quantity * l_discount AS __eng_mul__qd, l_extendedprice / nullif(l_quantity, 0) AS __eng_ratio__l_extendedprice__l_quantity FROM lineitem")
def _(spark, d):
    df = table(spark, d, "lineitem")
    asked = [{"operator": "multiply", "feature_a": "l_quantity", "feature_b": "l_discount", "name": "qd"}, {"operator": "divide", "feature_a": "l_extendedprice", "feature_b": "l_quantity"}, {"operator": "power", "feature_a": "l_tax", "feature_b": "l_quantity"}]
    made, names = select.engineered(df, asked, ["l_quantity", "l_discount", "l_extendedprice", "l_tax"])
    return made.select("l_orderkey", "l_linenumber", *names)


@query("pool_summary", union([f"""SELECT '{c}' AS "column", round(avg(({c} IS NULL)::INT), 6) AS missing, round(stddev_pop({c}), 6) AS std, round(abs(corr({c}, y)), 6) AS abs_corr FROM planted_lineitem""" for c in XS[:4]]))
def _(spark, d):
    return rounded(select.pool_summary(table(spark, d, "planted_lineitem"), "y", XS[:4]), "missing", "std", "abs_corr")


@query("holdout_split_counts", "SELECT r::INT AS repeat, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'validate' ELSE 'unused' END AS role, count(*) AS n FROM (SELECT r, (l_orderkey * 7 + l_linenumber * 13 + r * 17) % 100 AS b FROM lineitem, range(4) x(r)) GROUP BY 1, 2")
def _(spark, d):
    tagged = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(F.array(*[F.lit(i) for i in range(gram.REPEATS)])).alias("repeat"))
    bucket = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13 + F.col("repeat") * 17) % 100
    return tagged.groupBy("repeat", gram.role(bucket).alias("role")).agg(F.count(F.lit(1)).alias("n"))


# text ----------------------------------------------------------------------------------------------


@query("json_extract", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def _(spark, d):
    text = F.concat(F.lit("Reply: "), F.col("props"), F.lit(" end"))
    return table(spark, d, "events").select("event_id", F.get_json_object(insights.json_object(text), "$.k").cast("long").alias("k"))


LINE = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(text, '**', ''), '^\s*[*\-•]+\s*', ''), '^\s*[0-9]+[.)]\s*', ''), '\s+', ' ', 'g'))"


@query("insight_line_clean", f"SELECT conv_id, turn, {LINE} AS line FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", v.clean_line(F.col("text")).alias("line"))


@query("useful_lines", r"SELECT conv_id, turn, regexp_matches(text, '[A-Za-z0-9]') AND NOT (len(regexp_extract_all(text, '\S+')) = 1 AND (length(trim(text)) < 4 OR lower(trim(text)) IN ('there', 'here', 'also', 'thus', 'therefore'))) AS useful FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", v.useful_line(F.col("text")).alias("useful"))


@query("chat_history", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 7 ORDER BY turn DESC")
def _(spark, d):
    return newest_first(table(spark, d, "conversations"), "conv_id", 7, "turn").select("conv_id", "turn", "role", "text")


@query("column_name_sanitise", "SELECT doc_id, substr(regexp_replace(concat(source, ' - ', lang, '%'), '[^A-Za-z0-9_]', '_', 'g'), 1, 48) AS name FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", v.name_fragment(F.concat("source", F.lit(" - "), "lang", F.lit("%"))).alias("name"))


@query("client_problem_type", "SELECT NOT (count(DISTINCT l_linenumber) > 10 OR count(DISTINCT l_linenumber) > greatest(2, 0.02 * count(*))) AS is_classification FROM lineitem")
def _(spark, d):
    return metrics.few_whole_numbers(table(spark, d, "lineitem"), "l_linenumber")


@query("locale_number", "SELECT o_orderkey, CAST(replace(format('{:,.2f}', o_totalprice), ',', '') AS DOUBLE) AS number FROM orders")
def _(spark, d):
    shown = table(spark, d, "orders").select("o_orderkey", F.format_number("o_totalprice", 2).alias("text"))
    return shown.select("o_orderkey", v.locale_number(F.col("text")).alias("number"))

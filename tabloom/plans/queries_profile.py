"""Profiling, statistics and chart-data queries (P, S3, S12) with DuckDB twins."""

from __future__ import annotations

from tabloom.functions.exprs import INTEGER_TEXT, NUMERIC_TEXT
from tabloom.operators import profile as P
from tabloom.operators.columns import chart_data_all
from tabloom.plans import views as V
from tabloom.plans.registry import nullable_ints_as_double, query, rounded
from tabloom.sources import io as S

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("column_classes", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, '{k}' AS column_class, "
    f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, "
    f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) > 0 AS has_missing, count(*) AS n_rows FROM customer"
    for c, t, k in [("c_custkey", "bigint", "numeric"), ("c_name", "string", "categorical"),
                    ("c_nationkey", "int", "numeric"), ("c_acctbal", "double", "numeric"),
                    ("c_mktsegment", "string", "categorical")]))
def column_classes(spark, sf):
    return P.column_classes(V.table(spark, sf, "customer"))


@query("numeric_stats", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median,
       round(stddev_samp({c}), 4) AS std, round(var_samp({c}), 4) AS var, round(min({c}), 4) AS min,
       round(max({c}), 4) AS max, round(max({c}) - min({c}), 4) AS range,
       round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.75), 4) AS q3,
       round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr,
       round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis
FROM lineitem""" for c in _NUM))
def numeric_stats(spark, sf):
    return rounded(P.numeric_stats(V.table(spark, sf, "lineitem"), _NUM))


_CUST_NUM = ["c_custkey", "c_nationkey", "c_acctbal"]
_CUST_TXT = ["c_name", "c_mktsegment"]


@query("describe_all", " UNION ALL ".join([f"""
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
       round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50,
       round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max,
       CAST(NULL AS DOUBLE) AS "unique", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS DOUBLE) AS freq
FROM customer""" for c in _CUST_NUM] + [f"""
SELECT '{c}', (SELECT count({c}) FROM customer), NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       CAST((SELECT count(DISTINCT {c}) FROM customer) AS DOUBLE),
       (SELECT {c} FROM customer WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
       CAST((SELECT count(*) FROM customer WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS DOUBLE)"""
                                        for c in _CUST_TXT]))
def describe_all(spark, sf):
    return rounded(nullable_ints_as_double(P.describe_all(V.table(spark, sf, "customer")), ["unique", "freq"]))


@query("frequency_ranking", """
WITH c AS (SELECT p_brand AS value, count(*) AS count FROM part WHERE p_brand IS NOT NULL GROUP BY 1),
     t AS (SELECT sum(count) AS total, count(*) AS n_unique FROM c)
SELECT row_number() OVER (ORDER BY count DESC, value) AS rank, value, count,
       round(count * 100.0 / total, 4) AS percent, n_unique, greatest(n_unique - 10, 0) AS n_other
FROM c, t ORDER BY count DESC, value LIMIT 10""")
def frequency_ranking(spark, sf):
    return rounded(P.frequency_ranking(V.table(spark, sf, "part"), "p_brand", 10))


@query("distinct_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, count({c}) AS n_non_null FROM orders"
    for c in ["o_orderstatus", "o_orderdate", "o_orderpriority"]))
def distinct_counts(spark, sf):
    return P.distinct_counts(V.table(spark, sf, "orders"))


def _hist_sql(col: str, table: str, bins: int) -> str:
    return f"""
WITH r AS (SELECT CASE WHEN min({col}) = max({col}) THEN min({col}) - 0.5 ELSE min({col}) END AS lo,
                  CASE WHEN min({col}) = max({col}) THEN max({col}) + 0.5 ELSE max({col}) END AS hi
           FROM {table} WHERE {col} IS NOT NULL),
     b AS (SELECT least(CAST(floor(({col} - lo) / ((hi - lo) / {bins})) AS INTEGER), {bins - 1}) AS bin, count(*) AS n
           FROM {table}, r WHERE {col} IS NOT NULL GROUP BY 1),
     g AS (SELECT CAST(range AS INTEGER) AS bin FROM range({bins}))
SELECT g.bin, round(lo + g.bin * ((hi - lo) / {bins}), 4) AS lower, round(lo + (g.bin + 1) * ((hi - lo) / {bins}), 4) AS upper,
       CAST(coalesce(b.n, 0) AS BIGINT) AS count
FROM g CROSS JOIN r LEFT JOIN b ON g.bin = b.bin"""


@query("histogram_30", _hist_sql("l_extendedprice", "lineitem", 30))
def histogram_30(spark, sf):
    return rounded(P.histogram(V.table(spark, sf, "lineitem"), "l_extendedprice", 30))


def _h2_sql(x: str, y: str, table: str, bins: int) -> str:
    return f"""
WITH p AS (SELECT {x} AS x, {y} AS y FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
     r AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS xlo,
                  CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS xhi,
                  CASE WHEN min(y) = max(y) THEN min(y) - 0.5 ELSE min(y) END AS ylo,
                  CASE WHEN min(y) = max(y) THEN max(y) + 0.5 ELSE max(y) END AS yhi FROM p),
     c AS (SELECT least(CAST(floor((x - xlo) / ((xhi - xlo) / {bins})) AS INTEGER), {bins - 1}) AS bx,
                  least(CAST(floor((y - ylo) / ((yhi - ylo) / {bins})) AS INTEGER), {bins - 1}) AS "by", count(*) AS count
           FROM p, r GROUP BY 1, 2)
SELECT '{x}' AS x_col, '{y}' AS y_col, bx, "by", count,
       round(xlo + bx * ((xhi - xlo) / {bins}), 4) AS x_lower, round(xlo + (bx + 1) * ((xhi - xlo) / {bins}), 4) AS x_upper,
       round(ylo + "by" * ((yhi - ylo) / {bins}), 4) AS y_lower, round(ylo + ("by" + 1) * ((yhi - ylo) / {bins}), 4) AS y_upper
FROM c, r"""


@query("histogram2d", "SELECT * FROM (" + _h2_sql("l_quantity", "l_extendedprice", "lineitem", 20)
       + ") UNION ALL SELECT * FROM (" + _h2_sql("l_discount", "l_extendedprice", "lineitem", 20) + ")")
def histogram2d(spark, sf):
    return rounded(P.histogram_2d_pairs(V.table(spark, sf, "lineitem"), ["l_quantity", "l_discount"],
                                        ["l_extendedprice"], 20))


_LINE_NUM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
_LINE_TEXT = ("l_returnflag", "l_linestatus", "l_shipdate")


def _charts_sql() -> str:
    """A histogram of every numeric column with over 20 values, else counts; the top 20 of other columns."""
    parts = []
    for c in _LINE_NUM:
        parts.append(f"""SELECT '{c}' AS "column", 'histogram' AS chart, CAST(bin AS DOUBLE) AS bin, lower, upper, CAST(NULL AS VARCHAR) AS value, count,
            CAST(NULL AS DOUBLE) AS n_unique FROM ({_hist_sql(c, "lineitem", 30)}) WHERE (SELECT count(DISTINCT {c}) FROM lineitem) > 20""")
    for c in _LINE_NUM + _LINE_TEXT:
        most = "n_unique <= 20" if c in _LINE_NUM else "true"
        parts.append(f"""SELECT '{c}', CASE WHEN n_unique <= 20 THEN 'counts' ELSE 'top' END, NULL, NULL, NULL, value, n, CAST(n_unique AS DOUBLE) FROM (
            SELECT value, n, count(*) OVER () AS n_unique, row_number() OVER (ORDER BY n DESC, value) AS place FROM (
              SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1)) WHERE {most} AND place <= 20""")
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


@query("chart_all_columns", _charts_sql())
def chart_all_columns(spark, sf):
    """The charts of every lineitem column in two scans."""
    li = V.table(spark, sf, "lineitem").select(*_LINE_NUM, *_LINE_TEXT)
    return rounded(nullable_ints_as_double(chart_data_all(li), ["bin", "n_unique"]))


_PAIR_X, _PAIR_Y = ("l_quantity", "l_discount", "l_tax"), ("l_extendedprice", "l_quantity", "l_partkey")


@query("histogram2d_all_pairs", " UNION ALL ".join(
    f"SELECT * FROM ({_h2_sql(x, y, 'lineitem', 20)})" for x in _PAIR_X for y in _PAIR_Y if x != y))
def histogram2d_all_pairs(spark, sf):
    return rounded(P.histogram_2d_pairs(V.table(spark, sf, "lineitem"), _PAIR_X, _PAIR_Y, 20))


@query("top_cells", """
WITH h AS (""" + _h2_sql("l_quantity", "l_extendedprice", "lineitem", 20) + """)
SELECT row_number() OVER (ORDER BY count DESC, x_col, y_col, bx, "by") AS rank, x_col, y_col, bx, "by", count,
       round((x_lower + x_upper) / 2, 4) AS x_center, round((y_lower + y_upper) / 2, 4) AS y_center,
       x_lower, x_upper, y_lower, y_upper
FROM h ORDER BY count DESC, x_col, y_col, bx, "by" LIMIT 3""")
def top_cells(spark, sf):
    h = P.histogram_2d(V.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 20)
    return rounded(P.top_cells(h, 3))


@query("top20_values", """
WITH c AS (SELECT p_name AS value, count(*) AS count FROM part WHERE p_name IS NOT NULL GROUP BY 1),
     t AS (SELECT sum(count) AS total, count(*) AS n_unique FROM c)
SELECT row_number() OVER (ORDER BY count DESC, value) AS rank, value, count,
       round(count * 100.0 / total, 4) AS percent, n_unique, greatest(n_unique - 20, 0) AS n_other
FROM c, t ORDER BY count DESC, value LIMIT 20""")
def top20_values(spark, sf):
    return rounded(P.chart_data(V.table(spark, sf, "part"), "p_name"))


@query("chart_counts", """
SELECT CAST(o_orderstatus AS VARCHAR) AS value, count(*) AS count FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1""")
def chart_counts(spark, sf):
    return P.chart_data(V.table(spark, sf, "orders"), "o_orderstatus")


@query("target_profile", """
SELECT round(avg(y), 4) AS mean, round(stddev_samp(y), 4) AS std, round(min(y), 4) AS min, round(max(y), 4) AS max,
       CAST(sum(CASE WHEN y IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM preds""", ("preds",))
def target_profile(spark, sf):
    return rounded(P.target_profile(V.preds(spark, sf), "y"))


@query("prediction_summary", """
SELECT count(yhat) AS count, round(avg(yhat), 4) AS mean, round(min(yhat), 4) AS min, round(max(yhat), 4) AS max,
       round(stddev_pop(yhat), 4) AS std FROM preds""", ("preds",))
def prediction_summary(spark, sf):
    return rounded(P.prediction_summary(V.preds(spark, sf), "yhat", ddof=0))


@query("search_then_analyze", f"""
SELECT 'c_acctbal' AS "column", count(c_acctbal) AS count, round(avg(c_acctbal), 4) AS mean,
       round(median(c_acctbal), 4) AS median, round(stddev_samp(c_acctbal), 4) AS std, round(var_samp(c_acctbal), 4) AS var,
       round(min(c_acctbal), 4) AS min, round(max(c_acctbal), 4) AS max, round(max(c_acctbal) - min(c_acctbal), 4) AS range,
       round(quantile_cont(c_acctbal, 0.25), 4) AS q1, round(quantile_cont(c_acctbal, 0.75), 4) AS q3,
       round(quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25), 4) AS iqr,
       round(skewness(c_acctbal), 4) AS skewness, round(kurtosis(c_acctbal), 4) AS kurtosis
FROM customer WHERE regexp_matches(lower(c_mktsegment), 'build')""")
def search_then_analyze(spark, sf):
    return rounded(P.search_then_analyze(V.table(spark, sf, "customer"), "c_mktsegment", "BUILD", "c_acctbal"))


_ORD_COLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
             ("o_totalprice", "double"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string")]


@query("table_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, "
    f"count(DISTINCT {c}) AS n_distinct, count(*) AS n_rows, CAST(6 AS INTEGER) AS n_columns FROM orders"
    for c, t in _ORD_COLS))
def table_summary(spark, sf):
    return S.table_summary(V.table(spark, sf, "orders"))


def _infer_sql(cols, view):
    parts = []
    for c in cols:
        x = f"nullif(trim(CAST({c} AS VARCHAR)), '')"
        parts.append(f"""SELECT '{c}' AS "column",
       CASE WHEN count({x}) = 0 THEN 'TEXT'
            WHEN count(*) FILTER (WHERE {x} IS NOT NULL AND NOT regexp_matches({x}, '{INTEGER_TEXT}')) = 0 THEN 'INTEGER'
            WHEN count(*) FILTER (WHERE {x} IS NOT NULL AND NOT regexp_matches({x}, '{NUMERIC_TEXT}')) = 0 THEN 'REAL'
            ELSE 'TEXT' END AS inferred_type FROM {view}""")
    return " UNION ALL ".join(parts)


@query("infer_types", _infer_sql(["event_id", "date", "sales", "customer_count", "user_id"], "sales_text"),
       ("sales_text",))
def infer_types(spark, sf):
    return S.infer_column_types(V.sales_text(spark, sf))


@query("infer_types_numeric", _infer_sql(["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
                                         "customer"))
def infer_types_numeric(spark, sf):
    return S.infer_column_types(V.table(spark, sf, "customer"))

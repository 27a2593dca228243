"""Filters, text, arithmetic and conversion queries (F, T, A) with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.exprs import NUMERIC_TEXT
from tabloom.operators import clean as C
from tabloom.operators import poly as PO
from tabloom.plans import views as V
from tabloom.plans.registry import query, rounded

DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]


@query("keyword_row_removal", """
SELECT doc_id, lang, source, n_chars FROM documents
WHERE NOT (""" + " OR ".join(f"coalesce(regexp_matches(CAST({c} AS VARCHAR), 'Licen[cs]e'), false)"
                             for c in DOC_COLS) + ")")
def keyword_row_removal(spark, sf):
    d = V.table(spark, sf, "documents")
    return C.remove_rows_by_keyword(d, "Licen[cs]e").select("doc_id", "lang", "source", "n_chars")


@query("search_filter", """
SELECT p_partkey, p_name, p_brand FROM part WHERE regexp_matches(lower(p_name), 'red|hot')""")
def search_filter(spark, sf):
    p = V.table(spark, sf, "part")
    return C.filter_rows_by_search(p, "p_name", "RED|Hot").select("p_partkey", "p_name", "p_brand")


@query("delete_where_condition", """
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, o_orderpriority,
       strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS o_orderdate
FROM orders WHERE NOT coalesce(o_totalprice > 300000 AND o_orderstatus = 'F', false)""")
def delete_where_condition(spark, sf):
    o = V.table(spark, sf, "orders")
    out = C.delete_rows_where(o, "o_totalprice > 300000 AND o_orderstatus = 'F'")
    return rounded(out.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
                              F.to_date("o_orderdate").alias("o_orderdate")))


_LI_REST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus", "l_shipdate"]


@query("dedup_subset_first", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(l_extendedprice, 4) AS l_extendedprice,
       l_discount, l_tax, l_returnflag, l_linestatus, strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS l_shipdate
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY """ + ", ".join(_LI_REST) + """) AS rn
      FROM lineitem) WHERE rn = 1""")
def dedup_subset_first(spark, sf):
    li = V.table(spark, sf, "lineitem")
    out = C.drop_duplicates(li, ["l_orderkey", "l_linenumber"], order_by=_LI_REST)
    return rounded(out.withColumn("l_shipdate", F.to_date("l_shipdate")))


@query("dedup_whole_row", """
SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, round(l_extendedprice, 4) AS l_extendedprice,
       l_discount, l_tax, l_returnflag, l_linestatus, strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS l_shipdate FROM lineitem""")
def dedup_whole_row(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return rounded(C.drop_duplicates(li).withColumn("l_shipdate", F.to_date("l_shipdate")))


@query("replace_text_literal", """
SELECT o_orderkey, replace(o_orderpriority, '-', ' ') AS o_orderpriority,
       replace(o_orderstatus, '-', ' ') AS o_orderstatus FROM orders""")
def replace_text_literal(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return C.replace_text(o, "-", " ", ["o_orderpriority", "o_orderstatus"])


@query("replace_text_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(coalesce(sum(CASE WHEN contains(CAST({c} AS VARCHAR), '1') THEN 1 ELSE 0 END), 0) AS BIGINT) AS changed_cells FROM orders"
    for c in ["o_orderpriority", "o_orderstatus", "o_custkey"]))
def replace_text_counts(spark, sf):
    o = V.table(spark, sf, "orders")
    return C.replace_text_counts(o, "1", "one", ["o_orderpriority", "o_orderstatus", "o_custkey"])


@query("map_column", """
SELECT o_orderkey, o_orderstatus,
       coalesce(CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END, 'other') AS status_label,
       o_orderpriority FROM orders""")
def map_column(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return C.map_column(o, "o_orderstatus", ["F", "O"], ["filled", "open"], "status_label", default="other")


_BRANDS = [f"Brand#{i}" for i in range(1, 11)]


@query("unmapped_values", "SELECT DISTINCT p_brand AS value FROM part WHERE p_brand IS NOT NULL AND p_brand NOT IN ("
       + ", ".join(f"'{b}'" for b in _BRANDS) + ")")
def unmapped_values(spark, sf):
    return C.unmapped_values(V.table(spark, sf, "part"), "p_brand", _BRANDS)


@query("arithmetic_ratio", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round(CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END, 4) AS price_per_discount,
       round(l_extendedprice * (1 - l_discount), 4) AS net_price
FROM lineitem""")
def arithmetic_ratio(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                               "l_extendedprice", "l_discount")
    li = li.withColumn("__one_minus", 1 - F.col("l_discount"))
    out = C.arithmetic(li, "l_extendedprice", "l_discount", "/", "price_per_discount")
    out = C.arithmetic(out, "l_extendedprice", "__one_minus", "*", "net_price")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price_per_discount", "net_price"))


@query("arithmetic_report", """
SELECT count(r) AS count, round(avg(r), 4) AS mean, round(min(r), 4) AS min, round(max(r), 4) AS max,
       CAST(sum(CASE WHEN r IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing,
       CAST(sum(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_divisors,
       CAST(0 AS BIGINT) AS non_numeric_1, CAST(0 AS BIGINT) AS non_numeric_2
FROM (SELECT l_discount, CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END AS r FROM lineitem)""")
def arithmetic_report(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return rounded(C.arithmetic_report(li, "l_extendedprice", "l_discount", "/", "r"))


_CONV_PLAN = {"sales": "float", "customer_count": "int", "date": "datetime", "user_id": "int"}


@query("type_conversion_errors", """
SELECT 'sales' AS "column", 'float' AS target_type,
       CAST(sum(CASE WHEN sales IS NOT NULL AND NOT regexp_matches(sales, '""" + NUMERIC_TEXT + """') THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM sales_text
UNION ALL SELECT 'customer_count', 'int',
       CAST(sum(CASE WHEN customer_count IS NOT NULL AND NOT regexp_matches(customer_count, '^\\s*[+-]?\\d+\\s*$') THEN 1 ELSE 0 END) AS BIGINT) FROM sales_text
UNION ALL SELECT 'date', 'datetime',
       CAST(sum(CASE WHEN date IS NOT NULL AND try_strptime(date, '%Y-%m-%d %H:%M:%S') IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM sales_text
UNION ALL SELECT 'user_id', 'int',
       CAST(sum(CASE WHEN user_id IS NOT NULL AND NOT regexp_matches(user_id, '^\\s*[+-]?\\d+\\s*$') THEN 1 ELSE 0 END) AS BIGINT) FROM sales_text""",
       ("sales_text",))
def type_conversion_errors(spark, sf):
    return C.conversion_errors(V.sales_text(spark, sf), _CONV_PLAN)


@query("converted_values", """
SELECT event_id,
       round(CASE WHEN regexp_matches(sales, '""" + NUMERIC_TEXT + """') THEN CAST(trim(sales) AS DOUBLE) END, 4) AS sales,
       CASE WHEN regexp_matches(customer_count, '^\\s*[+-]?\\d+\\s*$') THEN CAST(trim(customer_count) AS BIGINT) END AS customer_count,
       strftime(CAST(strptime(date, '%Y-%m-%d %H:%M:%S') AS DATE), '%Y-%m-%d') AS day
FROM sales_text""", ("sales_text",))
def converted_values(spark, sf):
    out = C.convert_types(V.sales_text(spark, sf), _CONV_PLAN)
    return rounded(out.select("event_id", "sales", "customer_count", F.to_date("date").alias("day")))


@query("binarize", """
SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal, CAST(coalesce(CAST(c_acctbal > 0 AS INTEGER), 0) AS INTEGER) AS c_acctbal_bin
FROM customer""")
def binarize(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return rounded(C.binarize(c, "c_acctbal", 0.0))


@query("math_transform", """
SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 4) AS log_acctbal,
       round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 4) AS sqrt_acctbal FROM customer""")
def math_transform(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("log_acctbal"),
                                              F.col("c_acctbal").alias("sqrt_acctbal"))
    return rounded(C.math_transform(c, {"log_acctbal": "log", "sqrt_acctbal": "sqrt"}))


@query("valid_sales_filter", """
SELECT event_id, round(sales, 4) AS sales, customer_count FROM sales WHERE sales > 0 AND customer_count > 0""",
       ("sales",))
def valid_sales_filter(spark, sf):
    return rounded(C.valid_sales(V.sales(spark, sf)).select("event_id", "sales", "customer_count"))


@query("drop_null_target", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM li_missing WHERE l_quantity IS NOT NULL""",
       ("li_missing",))
def drop_null_target(spark, sf):
    return C.drop_null_target(V.li_missing(spark, sf), "l_quantity").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("numeric_projection", """
SELECT o_orderkey, o_custkey, round(o_totalprice, 4) AS o_totalprice FROM orders""")
def numeric_projection(spark, sf):
    return rounded(C.numeric_only(V.table(spark, sf, "orders")))


@query("select_available_features", """
SELECT l_quantity, l_discount, l_tax FROM lineitem""")
def select_available_features(spark, sf):
    li = V.table(spark, sf, "lineitem")
    out, _missing = C.select_available(li, ["l_quantity", "no_such_column", "l_discount", "l_tax"])
    return out


_PC = ["l_quantity", "l_discount", "l_tax"]


def _poly_sql(degree, interaction_only):
    terms = PO.polynomial_terms(_PC, degree, interaction_only)
    exprs = []
    for name, combo in terms:
        exprs.append("round(" + " * ".join(_PC[i] for i in combo) + f", 4) AS \"{name}\"")
    return ("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(_PC) + ", " + ", ".join(exprs)
            + (", 1.0 AS \"1\"" if interaction_only else "") + " FROM lineitem")


@query("polynomial_deg2", _poly_sql(2, False))
def polynomial_deg2(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *_PC)
    return rounded(PO.polynomial_features(li, _PC, 2))


@query("polynomial_deg3_interactions", _poly_sql(3, True))
def polynomial_deg3_interactions(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *_PC)
    return rounded(PO.polynomial_features(li, _PC, 3, interaction_only=True, include_bias=True))

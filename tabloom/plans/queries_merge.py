"""Join, union, group-sum and calendar-lag queries (J, W) with DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tabloom.operators import merge as J
from tabloom.operators import order as O
from tabloom.operators import timeseries as W
from tabloom.plans import views as V
from tabloom.plans.registry import nullable_ints_as_double, query, rnd, rounded
from tabloom.session import cut_lineage
from tabloom.sources import io as S


def _customers_with_null_key(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    nk = spark.createDataFrame([(None, "unknown customer", None)], "c_custkey bigint, c_name string, c_nationkey int")
    return c.unionByName(nk)


_NULL_CUST = ("SELECT c_custkey, c_name, c_nationkey FROM customer "
              "UNION ALL SELECT CAST(NULL AS BIGINT), 'unknown customer', CAST(NULL AS INTEGER)")


@query("left_join_nullsafe", f"""
SELECT k.o_orderkey, CAST(k.o_custkey AS DOUBLE) AS o_custkey, round(k.o_totalprice, 4) AS o_totalprice,
       CAST(c.c_custkey AS DOUBLE) AS c_custkey, c.c_name, CAST(c.c_nationkey AS DOUBLE) AS c_nationkey
FROM key_nulls k LEFT JOIN ({_NULL_CUST}) c ON k.o_custkey IS NOT DISTINCT FROM c.c_custkey""", ("key_nulls",))
def left_join_nullsafe(spark, sf):
    o = V.key_nulls(spark, sf).select("o_orderkey", "o_custkey", "o_totalprice")
    out = J.left_join(o, _customers_with_null_key(spark, sf), "o_custkey", "c_custkey",
                      null_keys_match=True, parse_dates=False)
    return rounded(nullable_ints_as_double(out, ["o_custkey", "c_custkey", "c_nationkey"]))


@query("left_join_plain", f"""
SELECT k.o_orderkey, CAST(k.o_custkey AS DOUBLE) AS o_custkey, round(k.o_totalprice, 4) AS o_totalprice,
       CAST(c.c_custkey AS DOUBLE) AS c_custkey, c.c_name, CAST(c.c_nationkey AS DOUBLE) AS c_nationkey
FROM key_nulls k LEFT JOIN ({_NULL_CUST}) c ON k.o_custkey = c.c_custkey""", ("key_nulls",))
def left_join_plain(spark, sf):
    o = V.key_nulls(spark, sf).select("o_orderkey", "o_custkey", "o_totalprice")
    out = J.left_join(o, _customers_with_null_key(spark, sf), "o_custkey", "c_custkey", parse_dates=False)
    return rounded(nullable_ints_as_double(out, ["o_custkey", "c_custkey", "c_nationkey"]))


def _shipments(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return (li.groupBy(F.to_date("l_shipdate").alias("ship_date"))
            .agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n_orders")))


@query("auto_date_join", """
WITH ship AS (SELECT CAST(l_shipdate AS DATE) AS ship_date, sum(l_quantity) AS qty, count(*) AS n_orders
              FROM lineitem GROUP BY 1)
SELECT strftime(d.day, '%Y-%m-%d %H:%M:%S') AS date, round(d.sales, 4) AS sales, d.n_orders,
       strftime(s.ship_date, '%Y-%m-%d %H:%M:%S') AS ship_date, round(s.qty, 4) AS qty,
       CAST(s.n_orders AS DOUBLE) AS n_orders_ship
FROM daily_orders d LEFT JOIN ship s ON CAST(d.day AS TIMESTAMP) = CAST(s.ship_date AS TIMESTAMP)""",
       ("daily_orders",))
def auto_date_join(spark, sf):
    out = J.auto_date_join({"orders": V.daily_orders(spark, sf).withColumnRenamed("day", "date"),
                            "ship": _shipments(spark, sf)})
    return rounded(nullable_ints_as_double(out, ["n_orders_ship"]))


@query("merge_on_key_full", """
WITH p AS (SELECT p_partkey, p_name, p_size FROM part),
     l AS (SELECT l_partkey AS p_partkey, count(*) AS n_lines, sum(l_quantity) AS qty, max(l_linenumber) AS p_size
           FROM lineitem GROUP BY 1)
SELECT coalesce(p.p_partkey, l.p_partkey) AS p_partkey, p.p_name, p.p_size, l.n_lines, round(l.qty, 4) AS qty,
       l.p_size AS p_size_lines
FROM p FULL JOIN l ON p.p_partkey = l.p_partkey""")
def merge_on_key_full(spark, sf):
    p = V.table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    li = V.table(spark, sf, "lineitem")
    lines = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"), F.max("l_linenumber").alias("p_size"))
    return rounded(J.merge_on_key({"part": p, "lines": lines}, "p_partkey"))


# two fifths of the orders have no key, a fifth of them has one and the same
@query("merge_on_key_hot", """
WITH o AS (SELECT CASE WHEN o_orderkey % 5 < 2 THEN NULL WHEN o_orderkey % 5 = 2 THEN 1 ELSE o_custkey END AS k, o_orderkey, o_totalprice
           FROM orders),
     c AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_custkey END AS k, c_name, c_acctbal FROM customer
           UNION ALL SELECT 1, 'second row of the hot key', 0.5)
SELECT CAST(coalesce(o.k, c.k) AS DOUBLE) AS k, CAST(o.o_orderkey AS DOUBLE) AS o_orderkey, round(o.o_totalprice, 4) AS o_totalprice,
       c.c_name, round(c.c_acctbal, 4) AS c_acctbal
FROM o FULL JOIN c ON o.k = c.k""")
def merge_on_key_hot(spark, sf):
    o = V.table(spark, sf, "orders")
    fifth = F.pmod(F.col("o_orderkey"), F.lit(5))
    o = o.select(F.when(fifth < 2, None).when(fifth == 2, 1).otherwise(F.col("o_custkey")).cast("bigint").alias("k"), "o_orderkey", "o_totalprice")
    c = V.table(spark, sf, "customer")
    c = c.select(F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_custkey")).cast("bigint").alias("k"), "c_name", "c_acctbal")
    c = c.union(spark.createDataFrame([(1, "second row of the hot key", 0.5)], "k bigint, c_name string, c_acctbal double"))
    return rounded(nullable_ints_as_double(J.merge_on_key({"orders": o, "customers": c}, "k", hot_rows=200), ["k", "o_orderkey"]))


@query("merge_horizontal", """
WITH n AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos FROM nation),
     r AS (SELECT *, row_number() OVER (ORDER BY r_regionkey) - 1 AS pos FROM region)
SELECT n.n_nationkey, n.n_name, n.n_regionkey, CAST(r.r_regionkey AS DOUBLE) AS r_regionkey, r.r_name,
       coalesce(n.pos, r.pos) AS row_pos
FROM n FULL JOIN r ON n.pos = r.pos""")
def merge_horizontal(spark, sf):
    out = J.merge_horizontal({"nation": V.table(spark, sf, "nation"), "region": V.table(spark, sf, "region")},
                             {"nation": ["n_nationkey"], "region": ["r_regionkey"]})
    return nullable_ints_as_double(out.withColumnRenamed("__pos", "row_pos"), ["r_regionkey"])


@query("merge_vertical", """
SELECT c_custkey AS party_key, c_name AS name, c_nationkey AS nationkey, round(c_acctbal, 4) AS acctbal FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 4) FROM supplier""")
def merge_vertical(spark, sf):
    cols = ["party_key", "name", "nationkey", "acctbal"]
    c = V.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal").toDF(*cols)
    s = V.table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").toDF(*cols)
    return rounded(J.merge_vertical({"customer": c, "supplier": s}))


@query("daily_sum_attach", """
WITH p AS (SELECT o_orderkey, o_totalprice, order_date, try_strptime(order_date, '%Y/%m/%d') AS ts FROM order_dates_text),
     s AS (SELECT ts, coalesce(sum(o_totalprice), 0) AS daily FROM p WHERE ts IS NOT NULL GROUP BY ts)
SELECT p.o_orderkey, round(p.o_totalprice, 4) AS o_totalprice, p.order_date, round(s.daily, 4) AS o_totalprice_daily_sum
FROM p LEFT JOIN s ON p.ts = s.ts""", ("order_dates_text",))
def daily_sum_attach(spark, sf):
    t = V.order_dates_text(spark, sf).select("o_orderkey", "o_totalprice", "order_date")
    return rounded(J.group_sum_attach(t, "order_date", ["o_totalprice"], grain="exact", fmt="%Y/%m/%d"))


@query("monthly_sum_attach", """
WITH p AS (SELECT o_orderkey, o_totalprice, order_date,
                  strftime(try_strptime(order_date, '%Y/%m/%d'), '%Y-%m') AS ym FROM order_dates_text),
     s AS (SELECT ym, coalesce(sum(o_totalprice), 0) AS monthly FROM p WHERE ym IS NOT NULL GROUP BY ym)
SELECT p.o_orderkey, round(p.o_totalprice, 4) AS o_totalprice, p.order_date,
       round(s.monthly, 4) AS o_totalprice_monthly_sum
FROM p LEFT JOIN s ON p.ym = s.ym""", ("order_dates_text",))
def monthly_sum_attach(spark, sf):
    t = V.order_dates_text(spark, sf).select("o_orderkey", "o_totalprice", "order_date")
    return rounded(J.group_sum_attach(t, "order_date", ["o_totalprice"], grain="month", fmt="%Y/%m/%d"))


def _ma(k_from: int, k_to: int) -> str:
    return (f"avg(sales) OVER (ORDER BY (day - DATE '1970-01-01') RANGE BETWEEN {k_from} PRECEDING "
            f"AND {k_to} PRECEDING)")


@query("trailing_ma", f"""
SELECT strftime(day, '%Y-%m-%d') AS day, round(sales, 4) AS sales, n_orders,
       round({_ma(1, 1)}, 4) AS sales_trailing_ma_1, round({_ma(3, 1)}, 4) AS sales_trailing_ma_3,
       round({_ma(11, 1)}, 4) AS sales_trailing_ma_11, round({_ma(14, 1)}, 4) AS sales_trailing_ma_14
FROM daily_orders""", ("daily_orders",))
def trailing_ma(spark, sf):
    return rounded(W.trailing_ma(V.daily_orders(spark, sf), "sales", [1, 3, 11, 14]))


@query("lagged_ma", f"""
SELECT strftime(day, '%Y-%m-%d') AS day, round(sales, 4) AS sales, n_orders,
       round({_ma(155, 153)}, 4) AS sales_lag153_ma3, round({_ma(246, 153)}, 4) AS sales_lag153_ma94
FROM daily_orders""", ("daily_orders",))
def lagged_ma(spark, sf):
    d = W.lagged_ma(V.daily_orders(spark, sf), "sales", 153, 3)
    return rounded(W.lagged_ma(d, "sales", 153, 94))


@query("trailing_ma_by_type", """
SELECT strftime(day, '%Y-%m-%d') AS day, event_type, round(value_sum, 4) AS value_sum, n_events,
       round(avg(value_sum) OVER (PARTITION BY event_type ORDER BY (day - DATE '1970-01-01')
             RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS value_sum_trailing_ma_3
FROM daily_events""", ("daily_events",))
def trailing_ma_by_type(spark, sf):
    return rounded(W.trailing_ma(V.daily_events(spark, sf), "value_sum", [3], partition_by=["event_type"]))


@query("prev_year_same_weekday", """
SELECT strftime(d.day, '%Y-%m-%d') AS day, round(d.sales, 4) AS sales, d.n_orders,
       round(p.sales, 4) AS prev_year_same_weekday_sales
FROM daily_orders d LEFT JOIN daily_orders p ON p.day = d.day - 364""", ("daily_orders",))
def prev_year_same_weekday(spark, sf):
    return rounded(W.prev_year_same_weekday(V.daily_orders(spark, sf), "sales"))


@query("prev_year_same_date", """
SELECT strftime(d.day, '%Y-%m-%d') AS day, round(d.sales, 4) AS sales, d.n_orders,
       round(p.sales, 4) AS prev_year_same_date_sales
FROM daily_orders d LEFT JOIN daily_orders p ON p.day = CAST(d.day - INTERVAL 1 YEAR AS DATE)""", ("daily_orders",))
def prev_year_same_date(spark, sf):
    return rounded(W.prev_year_same_date(V.daily_orders(spark, sf), "sales"))


@query("latest_orders_per_customer", """
SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, rank FROM (
  SELECT o_custkey, o_orderkey, o_orderdate,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank
  FROM orders) WHERE rank <= 3""")
def latest_orders_per_customer(spark, sf):
    o = V.table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"))
    out = O.top_k_per_group(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3)
    return rounded(out.select("o_custkey", "o_orderkey", "o_orderdate", F.col("rank").cast("bigint")))


@query("row_index", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_index FROM orders""")
def row_index(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return O.global_row_index(o, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("auto_date_join_positional", """
WITH c AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS i FROM customer),
     s AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier)
SELECT c.c_custkey, c.c_name, CAST(s.s_suppkey AS DOUBLE) AS s_suppkey, s.s_name FROM c LEFT JOIN s ON c.i = s.i""")
def auto_date_join_positional(spark, sf):
    """Tables without a date column are placed side by side by position."""
    c, s = V.table(spark, sf, "customer").select("c_custkey", "c_name"), V.table(spark, sf, "supplier").select("s_suppkey", "s_name")
    out = J.auto_date_join({"customer": c, "supplier": s}, {"customer": ["c_custkey"], "supplier": ["s_suppkey"]})
    return nullable_ints_as_double(out, ["s_suppkey"])


@query("save_and_query", """
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice >= 1000.5 GROUP BY 1""")
def save_and_query(spark, sf):
    """The orders saved as a table, queried by SQL with a named parameter, and dropped."""
    name = S.save_table(V.table(spark, sf, "orders").select("o_orderpriority", "o_totalprice"), f"tabloom_{uuid.uuid4().hex}")
    try:
        S.save_table(spark.range(1).toDF("o_totalprice"), name)
        raise RuntimeError("an existing table was overwritten")
    except AnalysisException:
        pass
    out = cut_lineage(S.run_sql(spark, f"SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS total FROM {name} "
                                       "WHERE o_totalprice >= :least GROUP BY 1", {"least": 1000.5}))
    spark.sql(f"DROP TABLE {name}")
    return out.select("o_orderpriority", "n", rnd("total", 2).alias("total"))

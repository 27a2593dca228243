"""Further registered queries: overview, profiles, encoding plan, counters,
typed ingestion, join-based mapping and fitted fills on a new batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import clean as C
from tabloom.operators import encode as E
from tabloom.operators import impute as I
from tabloom.operators import modeling as M
from tabloom.operators import profile as P
from tabloom.plans import views as V
from tabloom.plans.registry import query, rounded
from tabloom.sources import io as S

_OCOLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("overview_summary", """
SELECT count(*) AS n_rows, 6 AS n_columns, 3 AS n_numeric, 3 AS n_categorical,
       CAST(""" + " + ".join(f"max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in _OCOLS) + """ AS INTEGER)
         AS n_with_missing
FROM key_nulls""", ("key_nulls",))
def overview_summary(spark, sf):
    summary, _head = P.overview(V.key_nulls(spark, sf))
    return summary.select("n_rows", F.col("n_columns").cast("int"), F.col("n_numeric").cast("int"),
                          F.col("n_categorical").cast("int"), F.col("n_with_missing").cast("int"))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("pre_transform_profile", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(avg({c}), 4) AS mean,
       round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS std, round(skewness({c}), 4) AS skewness,
       CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing,
       CASE WHEN skewness({c}) > 1 THEN 'right' WHEN skewness({c}) < -1 THEN 'left' ELSE 'normal' END AS skew,
       min({c}) <= 0 AS nonpositive_min
FROM li_missing""" for c in _NUM), ("li_missing",))
def pre_transform_profile(spark, sf):
    return rounded(P.pre_transform_profile(V.li_missing(spark, sf), _NUM))


@query("category_profile", """
WITH c AS (SELECT o_orderpriority AS value, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1),
     t AS (SELECT sum(count) AS total, count(*) AS n_unique FROM c)
SELECT row_number() OVER (ORDER BY count DESC, value) AS rank, value, count, round(count * 100.0 / total, 4) AS percent,
       n_unique, greatest(n_unique - 5, 0) AS n_other,
       (SELECT CAST(sum(CASE WHEN o_orderpriority IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM orders) AS missing
FROM c, t ORDER BY count DESC, value LIMIT 5""")
def category_profile(spark, sf):
    return rounded(E.category_profile(V.table(spark, sf, "orders"), "o_orderpriority", 5))


def _brand_sql():
    brands = [f"Brand#{i}" for i in range(1, 26)]
    first = sorted(brands)[0]
    cols = ", ".join(f"coalesce(p_brand = '{b}', false) AS \"p_brand_{b}\"" for b in sorted(brands) if b != first)
    return f"""
SELECT p_partkey, p_type, round(p_retailprice, 4) AS p_retailprice, {cols}, round(t.m, 4) AS p_type_target
FROM part LEFT JOIN (SELECT p_type AS v, avg(p_retailprice) AS m FROM part WHERE p_type IS NOT NULL GROUP BY 1) t
  ON part.p_type = t.v"""


@query("encoding_plan", _brand_sql())
def encoding_plan(spark, sf):
    p = V.table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    out = E.encode(p, {"p_brand": {"method": "onehot"},
                       "p_type": {"method": "target", "target_col": "p_retailprice"}})
    return rounded(out)


@query("row_counts", """
SELECT (SELECT count(*) FROM orders) AS rows_before,
       (SELECT count(*) FROM orders WHERE NOT coalesce(o_orderstatus = 'P', false)) AS rows_after,
       (SELECT count(*) FROM orders) - (SELECT count(*) FROM orders WHERE NOT coalesce(o_orderstatus = 'P', false))
         AS rows_removed""")
def row_counts(spark, sf):
    o = V.table(spark, sf, "orders")
    return P.row_counts(o, C.delete_rows_where(o, "o_orderstatus = 'P'"))


@query("typed_ingestion", """
SELECT event_id, CASE WHEN trim(sales) <> '' THEN sales END AS sales,
       CAST(customer_count AS BIGINT) AS customer_count, date, CAST(user_id AS BIGINT) AS user_id
FROM sales_text""", ("sales_text",))
def typed_ingestion(spark, sf):
    raw = S.blanks_to_null(V.sales_text(spark, sf))
    return S.apply_inferred_types(raw, S.infer_column_types(raw))


@query("map_column_join", """
SELECT c.c_custkey, c.c_nationkey, n.n_name AS nation_name, c.c_mktsegment
FROM customer c LEFT JOIN nation n ON CAST(c.c_nationkey AS VARCHAR) = CAST(n.n_nationkey AS VARCHAR)""")
def map_column_join(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    mapping = V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    return C.map_column_join(c, "c_nationkey", mapping, "nation_name")


_U_ORDER = M.uniform_sql("l_orderkey", 42)


@query("fitted_fill_new_batch", f"""
WITH s AS (SELECT *, CASE WHEN {_U_ORDER} < 0.2 THEN 'test' ELSE 'train' END AS split FROM li_missing)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round(coalesce(l_quantity, (SELECT median(l_quantity) FROM s WHERE split = 'train')), 4) AS l_quantity,
       round(coalesce(l_tax, (SELECT median(l_tax) FROM s WHERE split = 'train')), 4) AS l_tax
FROM s WHERE split = 'test'""", ("li_missing",))
def fitted_fill_new_batch(spark, sf):
    """Medians fitted on the training split fill the prediction batch (no refit)."""
    d = M.add_split(V.li_missing(spark, sf), "l_orderkey", 0.2, 42)
    imp = I.fit_imputer(d.where(F.col("split") == "train"), {"l_quantity": "median", "l_tax": "median"})
    test = d.where(F.col("split") == "test").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                     "l_quantity", "l_tax")
    return rounded(imp.apply(test))


@query("scatter_points", f"""
SELECT round((dense_rank() OVER (ORDER BY o_orderpriority) - 1) + ({M.uniform_sql("o_orderkey", 42, "jitter o_orderpriority")} * 2 - 1) * 0.3, 4) AS x,
       round(o_totalprice, 4) AS y FROM orders""")
def scatter_points(spark, sf):
    """(x, y) chart points; the text axis gets sorted codes with jitter drawn from the key."""
    o = V.table(spark, sf, "orders")
    return rounded(P.scatter_data(o, "o_orderpriority", "o_totalprice", seed=42, key="o_orderkey"))


@query("column_summary", """
SELECT 'o_custkey' AS "column", count(*) AS total,
       CAST(sum(CASE WHEN o_custkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing,
       round(sum(CASE WHEN o_custkey IS NULL THEN 1 ELSE 0 END) * 100.0 / count(*), 4) AS missing_rate,
       CASE WHEN sum(CASE WHEN o_custkey IS NULL THEN 1 ELSE 0 END) = count(*) THEN 'empty' ELSE 'numeric' END
         AS analysis_type
FROM key_nulls""", ("key_nulls",))
def column_summary(spark, sf):
    """P5 header: total, missing, missing rate and analysis type of a column."""
    return rounded(P.column_summary(V.key_nulls(spark, sf), "o_custkey"))


@query("stream_scored_events", """
WITH med AS (SELECT median(value) AS m FROM events_gaps),
     f AS (SELECT event_id, coalesce(value, m) AS v FROM events_gaps, med)
SELECT event_id, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 4) AS value FROM f""", ("events_gaps",))
def stream_scored_events(spark, sf):
    """Fitted imputer + scaler (fitted on the batch table) applied to the same
    table read as a stream: no refit on the stream, exactly-once file sink."""
    import uuid

    from tabloom.operators import scale as H
    from tabloom.session import scratch_table_path
    from tabloom.streaming.apply import apply_fitted, write_table_stream

    batch = V.events_gaps(spark, sf).select("event_id", "value")
    imp = I.fit_imputer(batch, {"value": "median"})
    sc = H.fit_scaler(imp.apply(batch), {"value": "standard"})
    stream = V.gaps_of(V.table_stream(spark, sf, "events")).select("event_id", "value")
    out = scratch_table_path(spark, "stream_scored")
    q = write_table_stream(apply_fitted(stream, [imp.apply, sc.apply]), out, f"scored_{uuid.uuid4().hex[:8]}",
                           checkpoint=f"{out}_checkpoint")
    q.awaitTermination()
    return rounded(spark.read.parquet(out))

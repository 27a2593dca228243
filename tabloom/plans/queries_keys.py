"""Queries over large keys, missing keys, awkward cells and fitted encoders, with DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabloom.operators import clean as C
from tabloom.operators import encode as E
from tabloom.operators import impute as I
from tabloom.operators import merge as J
from tabloom.operators import modeling as M
from tabloom.operators import order as O
from tabloom.operators import profile as P
from tabloom.plans import views as V
from tabloom.plans.registry import query, rnd
from tabloom.session import cut_lineage, scratch_table_path
from tabloom.sources import io as S

_BIG = "CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT)"


def _big_keys(spark, sf):
    """Orders with a 60-bit key."""
    big = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 15), 16, 10).cast("bigint")
    return V.table(spark, sf, "orders").select(big.alias("k"))


@query("split_large_keys", f"""
WITH o AS (SELECT {_BIG} AS k FROM orders)
SELECT CASE WHEN {M.uniform_sql('k', 42)} < 0.2 THEN 'test' ELSE 'train' END AS split,
       CAST(least(floor({M.uniform_sql('k', 42, 'fold')} * 5), 4) AS INTEGER) AS fold, count(*) AS n FROM o GROUP BY 1, 2""")
def split_large_keys(spark, sf):
    """M1, M3: split and folds of 60-bit keys; the folds do not follow the split."""
    d = M.add_folds(M.add_split(_big_keys(spark, sf), "k", 0.2, 42), "k", 5, 42)
    return d.groupBy("split", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("nested_fold_counts", f"""
SELECT CAST(least(floor({M.uniform_sql('c_custkey', 42, 'outer fold')} * 5), 4) AS INTEGER) AS outer_fold,
       CAST(least(floor({M.uniform_sql('c_custkey', 42, 'inner fold')} * 3), 2) AS INTEGER) AS inner_fold, count(*) AS n
FROM customer GROUP BY 1, 2""")
def nested_fold_counts(spark, sf):
    """Outer and inner folds are independent, at the reference's 5 x 3."""
    c = V.table(spark, sf, "customer")
    d = M.add_folds(M.add_folds(c, "c_custkey", 5, 42, "outer_fold", "outer fold"), "c_custkey", 3, 42, "inner_fold", "inner fold")
    return d.groupBy("outer_fold", "inner_fold").agg(F.count(F.lit(1)).alias("n"))


_GAPS = """SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 5 END AS p,
       CASE WHEN (l_orderkey + l_linenumber) % 4 = 0 THEN l_linenumber WHEN l_orderkey % 7 = 0 THEN {gap} END AS v FROM lineitem"""


@query("ffill_missing_partition_key", f"""
WITH g AS ({_GAPS.format(gap='NULL')})
SELECT l_orderkey, l_linenumber, p, CAST(last_value(v IGNORE NULLS) OVER (
       PARTITION BY p ORDER BY l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS v FROM g""")
def ffill_missing_partition_key(spark, sf):
    """Rows without a partition key are a group of their own, and NaN is filled like NULL."""
    li = V.table(spark, sf, "lineitem")
    v = (F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 4 == 0, F.col("l_linenumber").cast("double"))
         .when(F.col("l_orderkey") % 7 == 0, F.lit(float("nan"))))
    d = li.select("l_orderkey", "l_linenumber", F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey") % 5).alias("p"), v.alias("v"))
    return O.forward_fill(d, ["v"], ["l_orderkey", "l_linenumber"], ["p"]).withColumn("v", F.col("v"))


@query("csv_round_trip", "SELECT CAST(doc_id AS BIGINT) AS doc_id, md5(text) AS text_md5, lang FROM documents")
def csv_round_trip(spark, sf):
    """Texts with quotes, commas and line breaks, written as CSV and read back."""
    folder = scratch_table_path(spark, "csv")
    docs = V.table(spark, sf, "documents").select("doc_id", "text", "lang")
    S.export_csv({"documents": docs}, folder)
    back = S.typed_csv(spark, f"{folder}/documents")
    return back.select("doc_id", F.md5(F.col("text")).alias("text_md5"), "lang")


@query("infer_types_wide", """
SELECT * FROM (VALUES ('small', 'INTEGER'), ('wide', 'REAL'), ('mixed', 'TEXT')) t("column", inferred_type)""")
def infer_types_wide(spark, sf):
    """S3: whole numbers that a bigint does not hold are no INTEGER."""
    o = V.table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    return S.infer_column_types(o.select(key.alias("small"), F.rpad(F.concat(F.lit("9"), key), 20, "0").alias("wide"),
                                         F.concat(key, F.lit("x")).alias("mixed")))


@query("auto_date_join_three", """
WITH a AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1),
     b AS (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem GROUP BY 1),
     c AS (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
SELECT strftime(a.date, '%Y-%m-%d') AS day, a.n, CAST(b.n AS DOUBLE) AS n_ship, CAST(c.n AS DOUBLE) AS n_first
FROM a LEFT JOIN b ON a.date = b.d LEFT JOIN c ON a.date = c.d""")
def auto_date_join_three(spark, sf):
    """Three tables, two of which name their key alike."""
    def daily(table, column, name, where="true"):
        return V.table(spark, sf, table).where(where).groupBy(F.to_date(column).alias(name)).agg(F.count(F.lit(1)).alias("n"))
    out = J.auto_date_join({"order": daily("orders", "o_orderdate", "date"), "ship": daily("lineitem", "l_shipdate", "Date_and_Time"),
                            "first": daily("lineitem", "l_shipdate", "Date_and_Time", "l_linenumber = 1")})
    return out.select(F.date_format("date", "yyyy-MM-dd").alias("day"), "n", F.col("n_ship").cast("double").alias("n_ship"),
                      F.col("n_first").cast("double").alias("n_first"))


@query("horizontal_orders_lineitem", """
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders),
     l AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS i FROM lineitem)
SELECT CAST(o.o_orderkey AS DOUBLE) AS o_orderkey, l.l_orderkey, l.l_linenumber FROM l LEFT JOIN o ON o.i = l.i""")
def horizontal_orders_lineitem(spark, sf):
    """Orders placed next to lineitem by position; the shorter table is padded."""
    o, li = V.table(spark, sf, "orders").select("o_orderkey"), V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    out = J.merge_horizontal({"o": o, "l": li}, {"o": ["o_orderkey"], "l": ["l_orderkey", "l_linenumber"]}).drop("__pos")
    return out.withColumn("o_orderkey", F.col("o_orderkey").cast("double"))


@query("chart_branches", """
WITH k AS (SELECT c_custkey % 20 AS a, c_custkey % 21 AS b FROM customer),
     n AS (SELECT 'a' AS chart, CAST(a AS VARCHAR) AS value, count(*) AS "count" FROM k GROUP BY 2
           UNION ALL SELECT 'b', CAST(b AS VARCHAR), count(*) FROM k GROUP BY 2)
SELECT chart, value, "count" FROM n QUALIFY row_number() OVER (PARTITION BY chart ORDER BY "count" DESC, value) <= 20""")
def chart_branches(spark, sf):
    """20 distinct values are counted, 21 (as text) ranked; the check is exact."""
    c = V.table(spark, sf, "customer")
    a = P.chart_data(c.select((F.col("c_custkey") % 20).cast("string").alias("a")), "a")
    b = P.chart_data(c.select((F.col("c_custkey") % 21).cast("string").alias("b")), "b")
    names = [x for x in b.columns if x not in ("count", "rank", "percent", "share")]
    return (a.select(F.lit("a").alias("chart"), "value", F.col("count").cast("bigint").alias("count"))
            .unionByName(b.select(F.lit("b").alias("chart"), F.col(names[0]).alias("value"), F.col("count").cast("bigint").alias("count"))))


@query("encoding_plan_new_batch", f"""
WITH s AS (SELECT *, {M.uniform_sql('o_orderkey', 42)} < 0.2 AS test FROM orders), t AS (SELECT * FROM s WHERE NOT test),
     code AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS c FROM (SELECT DISTINCT o_orderstatus AS v FROM t)),
     freq AS (SELECT o_orderpriority AS v, count(*) / (SELECT count(o_orderpriority) FROM t) AS f FROM t GROUP BY 1)
SELECT s.o_orderkey, CAST(coalesce(code.c, (SELECT count(*) FROM code)) AS BIGINT) AS o_orderstatus, s.o_orderpriority, round(freq.f, 6) AS o_orderpriority_freq
FROM s LEFT JOIN code ON s.o_orderstatus = code.v LEFT JOIN freq ON s.o_orderpriority = freq.v WHERE s.test""")
def encoding_plan_new_batch(spark, sf):
    """A plan fitted on the training rows, applied to the test rows."""
    o = M.add_split(V.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey", 0.2, 42)
    plan = E.fit_encoding(o.where("split = 'train'"), {"o_orderstatus": "label", "o_orderpriority": "frequency"})
    out = plan.apply(o.where("split = 'test'").drop("split"))
    return out.withColumn("o_orderpriority_freq", rnd("o_orderpriority_freq", 6))


@query("keep_and_drop_columns", "SELECT o_orderkey, o_orderstatus, 'o_none' AS missing FROM orders")
def keep_and_drop_columns(spark, sf):
    """Columns dropped (an unknown one is skipped), kept, and the names that are missing."""
    o = C.drop_columns(V.table(spark, sf, "orders"), ["o_totalprice", "o_none"])
    missing = C.validate_columns(o, ["o_orderkey", "o_none"])
    return C.keep_columns(o, ["o_orderkey", "o_orderstatus"]).withColumn("missing", F.lit(",".join(missing)))


@query("infinite_to_missing", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 < 3 THEN CAST(l_quantity AS DOUBLE) END AS x FROM lineitem""")
def infinite_to_missing(spark, sf):
    """infinite values of either sign and NaN become missing."""
    m = F.col("l_orderkey") % 5
    x = F.when(m < 3, F.col("l_quantity").cast("double")).otherwise(
        F.when(m == 3, F.when(F.col("l_linenumber") % 2 == 0, float("inf")).otherwise(float("-inf"))).otherwise(float("nan")))
    return C.inf_to_missing(V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x")))


@query("nan_counts", """
SELECT 'x' AS "column", CAST(sum(CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS missing,
       round(avg(CASE WHEN l_orderkey % 5 > 0 THEN l_linenumber END), 4) AS mean FROM lineitem""")
def nan_counts(spark, sf):
    """NaN counts as missing and does not reach the mean."""
    x = F.when(F.col("l_orderkey") % 5 == 0, float("nan")).otherwise(F.col("l_linenumber").cast("double"))
    d = V.table(spark, sf, "lineitem").select(x.alias("x"))
    return P.column_classes(d).select("column", "missing").crossJoin(P.target_profile(d, "x").select(rnd("mean", 4).alias("mean")))


@query("histogram_with_gaps", """
WITH d AS (SELECT CAST(l_linenumber AS DOUBLE) AS x FROM lineitem WHERE l_orderkey % 5 > 1),
     r AS (SELECT min(x) AS lo, max(x) AS hi FROM d)
SELECT CAST(least(floor((x - lo) / ((hi - lo) / 6)), 5) AS INTEGER) AS bin, count(*) AS "count" FROM d, r GROUP BY 1""")
def histogram_with_gaps(spark, sf):
    """P10: NaN and infinite values stay out of the edges and the bins."""
    m = F.col("l_orderkey") % 5
    x = F.when(m == 0, float("nan")).when(m == 1, float("inf")).otherwise(F.col("l_linenumber").cast("double"))
    h = P.histogram(V.table(spark, sf, "lineitem").select(x.alias("x")), "x", 6)
    return h.where(F.col("count") > 0).select("bin", "count")


@query("numeric_text_features", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS as_text, CASE WHEN o_custkey % 3 > 0 THEN CAST(o_custkey AS DOUBLE) / 4 END AS x FROM orders""")
def numeric_text_features(spark, sf):
    """Numbers as text, and text features back as numbers (blanks and words are missing)."""
    o = C.stringify(V.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("as_text"),
                                                         (F.col("o_custkey") / 4).alias("q")), ["as_text", "q"])
    n = F.col("as_text").cast("long") % 3
    d = o.withColumn("x", F.when(n > 0, F.col("q")).otherwise(F.when(F.col("as_text").cast("long") % 2 == 0, " ").otherwise("many")))
    return C.to_numeric_features(d, ["x"]).select("o_orderkey", "as_text", "x")


@query("update_where_condition", """
SELECT o_orderkey, CASE WHEN o_totalprice > 150000 AND o_orderstatus = 'O' THEN 'big' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def update_where_condition(spark, sf):
    """Rows where the condition holds are updated, others stay."""
    o = S.update_where(V.table(spark, sf, "orders"), {"o_orderpriority": "big"}, "o_totalprice > 150000 AND o_orderstatus = 'O'")
    return o.select("o_orderkey", "o_orderpriority")


@query("constant_fill", "SELECT o_orderkey, CASE WHEN o_custkey % 4 > 0 THEN o_orderstatus ELSE 'none' END AS s FROM orders")
def constant_fill(spark, sf):
    """A column with gaps is filled with a constant."""
    o = V.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 4 > 0, F.col("o_orderstatus")).alias("s"))
    return I.fit_imputer(o, {"s": "constant"}, constants={"s": "none"}).apply(o)


@query("catalog_round_trip", """
SELECT c_nationkey, count(*) AS n, (SELECT count(*) FROM customer) AS n_rows, 3 AS n_columns FROM customer GROUP BY 1""")
def catalog_round_trip(spark, sf):
    """A table created from data, appended to, listed, counted, read back by columns, and dropped."""
    customer = V.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    even = F.coalesce(F.col("c_custkey") % 2 == 0, F.lit(False))
    name = f"tabloom_{uuid.uuid4().hex}"
    S.create_table(spark, name, customer.where(even))
    S.insert_rows(customer.where(~even), name)
    listed = {r["name"]: r["rows"] for r in S.list_tables(spark).where(F.col("name") == name).collect()}
    whole = S.read_table(spark, name, ["c_custkey", "c_nationkey", "c_acctbal"])
    if whole.exceptAll(customer).count() or customer.exceptAll(whole).count():
        raise RuntimeError("the table read back is not the one that was written")
    back = cut_lineage(S.read_table(spark, name, ["c_nationkey"]).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")))
    n_rows, n_columns = S.table_count(spark.table(name)), S.table_schema(spark.table(name)).count()
    if not S.table_exists(spark, name) or listed != {name: n_rows}:
        raise RuntimeError(f"the catalog lists {listed}, the table has {n_rows} rows")
    spark.sql(f"DROP TABLE {name}")
    return back.select("c_nationkey", "n", F.lit(n_rows).cast("long").alias("n_rows"), F.lit(n_columns).alias("n_columns"))


@query("merge_auto_vertical", "SELECT o_orderkey, o_custkey FROM orders")
def merge_auto_vertical(spark, sf):
    """J6 joined to its merge: equal column sets in another order are appended."""
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    even, odd = o.where("o_custkey % 2 = 0"), o.where("o_custkey % 2 = 1").select("o_custkey", "o_orderkey")
    return J.merge_auto({"even": even, "odd": odd})

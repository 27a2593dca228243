"""Imputation, scaling and encoding queries (I, H, E) with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import encode as E
from tabloom.operators import impute as I
from tabloom.operators import order as O
from tabloom.operators import profile as P
from tabloom.operators import scale as H
from tabloom.operators.modeling import add_folds, uniform_sql
from tabloom.plans import views as V
from tabloom.plans.registry import query, rounded

_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_KEYS_SQL = ", ".join(_KEYS)
_LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_NUMERIC = {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax"}


@query("missing_report", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, "
    f"round(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100.0 / count(*), 4) AS missing_pct, "
    f"'{'numeric' if c in _NUMERIC else 'categorical'}' AS column_class FROM li_missing" for c in _LI_COLS),
    ("li_missing",))
def missing_report(spark, sf):
    return rounded(P.missing_report(V.li_missing(spark, sf)))


@query("impute_mean", f"""
SELECT {_KEYS_SQL}, round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM li_missing)), 4) AS l_quantity
FROM li_missing""", ("li_missing",))
def impute_mean(spark, sf):
    df = V.li_missing(spark, sf).select(*_KEYS, "l_quantity")
    return rounded(I.fit_imputer(df, {"l_quantity": "mean"}).apply(df))


@query("impute_median", f"""
SELECT {_KEYS_SQL}, round(coalesce(l_tax, (SELECT median(l_tax) FROM li_missing)), 4) AS l_tax
FROM li_missing""", ("li_missing",))
def impute_median(spark, sf):
    df = V.li_missing(spark, sf).select(*_KEYS, "l_tax")
    return rounded(I.fit_imputer(df, {"l_tax": "median"}).apply(df))


_MODE_SQL = ("(SELECT l_returnflag FROM li_missing WHERE l_returnflag IS NOT NULL "
             "GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1)")


@query("impute_mode", f"""
SELECT {_KEYS_SQL}, coalesce(l_returnflag, {_MODE_SQL}) AS l_returnflag FROM li_missing""", ("li_missing",))
def impute_mode(spark, sf):
    df = V.li_missing(spark, sf).select(*_KEYS, "l_returnflag")
    return I.fit_imputer(df, {"l_returnflag": "mode"}).apply(df)


@query("impute_mixed_plan", f"""
SELECT {_KEYS_SQL},
       round(coalesce(l_quantity, (SELECT median(l_quantity) FROM li_missing)), 4) AS l_quantity,
       round(coalesce(l_tax, (SELECT avg(l_tax) FROM li_missing)), 4) AS l_tax,
       coalesce(l_returnflag, {_MODE_SQL}) AS l_returnflag,
       coalesce(l_linestatus, 'Unknown') AS l_linestatus
FROM li_missing""", ("li_missing",))
def impute_mixed_plan(spark, sf):
    df = V.li_missing(spark, sf).select(*_KEYS, "l_quantity", "l_tax", "l_returnflag", "l_linestatus")
    imp = I.fit_imputer(df, {"l_quantity": "median", "l_tax": "mean", "l_returnflag": "mode",
                             "l_linestatus": "unknown"})
    return rounded(imp.apply(df))


@query("impute_drop_then_mean", f"""
SELECT {_KEYS_SQL}, round(coalesce(l_quantity,
       (SELECT avg(l_quantity) FROM li_missing WHERE l_returnflag IS NOT NULL)), 4) AS l_quantity, l_returnflag
FROM li_missing WHERE l_returnflag IS NOT NULL""", ("li_missing",))
def impute_drop_then_mean(spark, sf):
    df = V.li_missing(spark, sf).select(*_KEYS, "l_quantity", "l_returnflag")
    return rounded(I.fit_imputer(df, {"l_quantity": "mean"}, drop_missing=["l_returnflag"]).apply(df))


@query("impute_auto", f"""
SELECT {_KEYS_SQL},
       round(coalesce(l_quantity, (SELECT median(l_quantity) FROM li_missing)), 4) AS l_quantity,
       round(coalesce(l_tax, (SELECT median(l_tax) FROM li_missing)), 4) AS l_tax,
       coalesce(l_returnflag, {_MODE_SQL}) AS l_returnflag
FROM li_missing""", ("li_missing",))
def impute_auto(spark, sf):
    df = V.li_missing(spark, sf).select(*_KEYS, "l_quantity", "l_tax", "l_returnflag")
    return rounded(I.auto_imputer(df, ["l_quantity", "l_tax", "l_returnflag"]).apply(df))


@query("fill_zero", f"""
SELECT {_KEYS_SQL}, coalesce(l_quantity, 0) AS l_quantity, coalesce(l_tax, 0) AS l_tax, l_returnflag FROM li_missing""",
       ("li_missing",))
def fill_zero(spark, sf):
    df = V.li_missing(spark, sf).select(*_KEYS, "l_quantity", "l_tax", "l_returnflag")
    return rounded(I.fill_zero(df))


@query("target_sentinel", f"""
SELECT {_KEYS_SQL}, coalesce(l_quantity, -999999.0) AS l_quantity FROM li_missing""", ("li_missing",))
def target_sentinel(spark, sf):
    df = V.li_missing(spark, sf).select(*_KEYS, "l_quantity")
    return rounded(I.target_sentinel(df, "l_quantity"))


@query("ffill", """
SELECT event_id, round(last_value(value IGNORE NULLS) OVER (ORDER BY event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS value FROM events_gaps""", ("events_gaps",))
def ffill(spark, sf):
    df = V.events_gaps(spark, sf).select("event_id", "value")
    return rounded(O.forward_fill(df, ["value"], ["event_id"]))


@query("bfill", """
SELECT event_id, round(first_value(value IGNORE NULLS) OVER (ORDER BY event_id
       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS value FROM events_gaps""", ("events_gaps",))
def bfill(spark, sf):
    df = V.events_gaps(spark, sf).select("event_id", "value")
    return rounded(O.backward_fill(df, ["value"], ["event_id"]))


@query("ffill_by_user", """
SELECT event_id, user_id, round(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS value FROM events_gaps""", ("events_gaps",))
def ffill_by_user(spark, sf):
    df = V.events_gaps(spark, sf).select("event_id", "user_id", "ts", "value")
    return rounded(O.forward_fill(df, ["value"], ["ts", "event_id"], partition_by=["user_id"]).drop("ts"))


# --- scaling -----------------------------------------------------------------

@query("scale_standard", f"""
SELECT {_KEYS_SQL},
       round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 4) AS l_extendedprice,
       round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 4) AS l_quantity
FROM lineitem""")
def scale_standard(spark, sf):
    df = V.table(spark, sf, "lineitem").select(*_KEYS, "l_extendedprice", "l_quantity")
    return rounded(H.scale(df, {"l_extendedprice": "standard", "l_quantity": "standardize"}))


@query("scale_minmax", f"""
SELECT {_KEYS_SQL},
       round((l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()), 4) AS l_extendedprice,
       round((l_discount - min(l_discount) OVER ()) / (max(l_discount) OVER () - min(l_discount) OVER ()), 4) AS l_discount
FROM lineitem""")
def scale_minmax(spark, sf):
    df = V.table(spark, sf, "lineitem").select(*_KEYS, "l_extendedprice", "l_discount")
    return rounded(H.scale(df, {"l_extendedprice": "minmax", "l_discount": "normalize"}))


@query("scale_robust", f"""
SELECT {_KEYS_SQL},
       round((l_extendedprice - quantile_cont(l_extendedprice, 0.5) OVER ()) /
             (quantile_cont(l_extendedprice, 0.75) OVER () - quantile_cont(l_extendedprice, 0.25) OVER ()), 4) AS l_extendedprice
FROM lineitem""")
def scale_robust(spark, sf):
    df = V.table(spark, sf, "lineitem").select(*_KEYS, "l_extendedprice")
    return rounded(H.scale(df, {"l_extendedprice": "robust"}))


@query("scale_log", """
SELECT c_custkey, round(CASE WHEN (SELECT min(c_acctbal) FROM customer) <= 0
                             THEN ln(c_acctbal + 1 - (SELECT min(c_acctbal) FROM customer))
                             ELSE ln(c_acctbal) END, 4) AS c_acctbal,
       CASE WHEN c_acctbal > 1000 THEN 1 ELSE 0 END AS c_acctbal_bin
FROM customer""")
def scale_log(spark, sf):
    df = V.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    sc = H.fit_scaler(df, {"c_acctbal": "log"})
    out = sc.apply(df)
    # binarize is fitted on the raw column, as the notebook applies it next to the log
    bz = H.fit_scaler(df, {"c_acctbal": {"method": "binarize", "threshold": 1000.0}}).apply(df)
    return rounded(out.join(bz.select("c_custkey", "c_acctbal_bin"), "c_custkey"))


def _quantile_uniform_sql(col: str, table: str, keys: list[str], k: int = 1000) -> str:
    """DuckDB twin of the uniform quantile transform: exact landmarks, then the
    average of the interpolation from below and from above (two ASOF joins)."""
    import numpy as np
    refs = [float(r) for r in np.linspace(0, 1, k)]
    plist = "[" + ", ".join(repr(r) for r in refs) + "]"
    ks = ", ".join(keys)
    return f"""
WITH q0 AS (SELECT quantile_cont({col}, {plist}) AS qs FROM {table} WHERE {col} IS NOT NULL),
     lm AS (SELECT t.j - 1 AS j, qs[t.j] AS q, ({plist})[t.j] AS r FROM q0, range(1, {k + 1}) t(j)),
     d AS (SELECT q, min(j) AS a, max(j) AS b FROM lm GROUP BY q),
     x AS (SELECT {ks}, {col} AS v FROM {table}),
     lo AS (SELECT x.*, d.b FROM x ASOF LEFT JOIN d ON x.v >= d.q),
     hi AS (SELECT lo.*, d.a FROM lo ASOF LEFT JOIN d ON lo.v <= d.q),
     e AS (SELECT hi.*, l0.q AS qb, l0.r AS rb, l1.q AS qb1, l1.r AS rb1, u0.q AS qa, u0.r AS ra, u1.q AS qa1, u1.r AS ra1
           FROM hi LEFT JOIN lm l0 ON l0.j = hi.b LEFT JOIN lm l1 ON l1.j = hi.b + 1
                   LEFT JOIN lm u0 ON u0.j = hi.a LEFT JOIN lm u1 ON u1.j = hi.a - 1),
     y AS (SELECT e.*,
             CASE WHEN b IS NULL THEN 0.0 WHEN b = {k - 1} THEN 1.0
                  ELSE (rb1 - rb) / (qb1 - qb) * (v - qb) + rb END AS lpart,
             CASE WHEN a IS NULL THEN -1.0 WHEN a = 0 THEN -0.0
                  ELSE (ra - ra1) / (qa - qa1) * (qa - v) - ra END AS upart
           FROM e)
SELECT {ks}, round(CASE WHEN v IS NULL THEN NULL
                        WHEN v - 1e-7 < (SELECT min(q) FROM lm) THEN 0.0
                        WHEN v + 1e-7 > (SELECT max(q) FROM lm) THEN 1.0
                        ELSE 0.5 * (lpart - upart) END, 6) AS {col}
FROM y"""


@query("quantile_uniform", _quantile_uniform_sql("l_extendedprice", "lineitem", _KEYS))
def quantile_uniform(spark, sf):
    df = V.table(spark, sf, "lineitem").select(*_KEYS, "l_extendedprice")
    return rounded(H.scale(df, {"l_extendedprice": "quantile"}), 6)


# --- encoding ----------------------------------------------------------------

_SEGS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("onehot", "SELECT c_custkey, " + ", ".join(
    f"coalesce(c_mktsegment = '{s}', false) AS \"c_mktsegment_{s}\"" for s in _SEGS[1:]) + " FROM customer")
def onehot(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return E.fit_onehot(c, ["c_mktsegment"]).apply(c)


@query("label_codes", f"""
SELECT {_KEYS_SQL}, coalesce(codes.code, (SELECT count(DISTINCT l_returnflag) FROM li_missing)) AS l_returnflag
FROM li_missing LEFT JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code
    FROM (SELECT DISTINCT l_returnflag AS v FROM li_missing WHERE l_returnflag IS NOT NULL)) codes
  ON li_missing.l_returnflag = codes.v""", ("li_missing",))
def label_codes(spark, sf):
    df = V.li_missing(spark, sf).select(*_KEYS, "l_returnflag")
    return E.fit_label_codes(df, ["l_returnflag"]).apply(df).withColumn(
        "l_returnflag", F.col("l_returnflag").cast("bigint"))


@query("category_codes", """
SELECT c_custkey, c_nationkey, round(c_acctbal, 4) AS c_acctbal, codes.code AS c_mktsegment
FROM customer LEFT JOIN (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
    FROM (SELECT DISTINCT c_mktsegment AS v FROM customer WHERE c_mktsegment IS NOT NULL)) codes
  ON customer.c_mktsegment = codes.v""")
def category_codes(spark, sf):
    c = V.table(spark, sf, "customer")
    return rounded(E.category_codes(c))


@query("frequency_encode", """
SELECT o_orderkey, o_orderpriority, round(f.share, 6) AS o_orderpriority_freq
FROM orders LEFT JOIN (SELECT o_orderpriority AS v, count(*) / sum(count(*)) OVER () AS share
                       FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1) f ON orders.o_orderpriority = f.v""")
def frequency_encode(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return rounded(E.fit_frequency(o, ["o_orderpriority"]).apply(o), 6)


@query("target_encode", """
SELECT c_custkey, c_mktsegment, round(t.m, 4) AS c_mktsegment_target
FROM customer LEFT JOIN (SELECT c_mktsegment AS v, avg(c_acctbal) AS m FROM customer
                         WHERE c_mktsegment IS NOT NULL GROUP BY 1) t ON customer.c_mktsegment = t.v""")
def target_encode(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return rounded(E.fit_target_mean(c, ["c_mktsegment"], "c_acctbal").apply(c).drop("c_acctbal"))


_U_CUST = uniform_sql("c_custkey", 42, "fold")


@query("target_encode_oof", f"""
WITH f AS (SELECT c_custkey, c_mktsegment, c_acctbal, CAST(least(floor({_U_CUST} * 5), 4) AS INTEGER) AS fold
           FROM customer),
     per AS (SELECT c_mktsegment, fold, sum(c_acctbal) AS s, count(c_acctbal) AS n FROM f GROUP BY 1, 2),
     tot AS (SELECT c_mktsegment, sum(s) AS ts, sum(n) AS tn FROM per GROUP BY 1)
SELECT f.c_custkey, f.c_mktsegment, round((tot.ts - per.s) / (tot.tn - per.n), 4) AS c_mktsegment_target
FROM f JOIN per ON f.c_mktsegment = per.c_mktsegment AND f.fold = per.fold
       JOIN tot ON f.c_mktsegment = tot.c_mktsegment""")
def target_encode_oof(spark, sf):
    c = add_folds(V.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"),
                  "c_custkey", 5, 42)
    out = E.target_mean_out_of_fold(c, "c_mktsegment", "c_acctbal", "fold")
    return rounded(out.select("c_custkey", "c_mktsegment", "c_mktsegment_target"))


_SPARSE_SQL = """SELECT o_orderkey, '{c}' AS "column", code FROM (
    SELECT o_orderkey, {x} AS v, dense_rank() OVER (ORDER BY {x}) - 1 AS code FROM orders WHERE {x} IS NOT NULL) WHERE code > 0"""


@query("onehot_sparse", " UNION ALL ".join(f"SELECT * FROM ({_SPARSE_SQL.format(c=c, x=x)})" for c, x in (
    ("customer", "CAST(o_custkey AS VARCHAR)"), ("o_orderpriority", "o_orderpriority"))))
def onehot_sparse(spark, sf):
    """E1 of any width: the dummies that are 1, of a column with thousands of values and of one with five."""
    o = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"), "o_orderpriority")
    return E.onehot_sparse(o, ["o_orderkey"], ["customer", "o_orderpriority"])

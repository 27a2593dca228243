"""Counts of many columns in one pass: distinct values, charts and grids."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL

from tabloom.operators import columns as C
from tabloom.operators import profile as P
from tabloom.sources import io as S


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def awkward(spark):
    nan = float("nan")
    rows = [(1, 0.0, "x" * 100, None, b"\x00"), (2, -0.0, "x" * 100, None, b"\x00\x00"), (2, nan, "x" * 99 + "y", None, None),
            (None, nan, None, None, b""), (3, float("inf"), "", None, b"\x00"), (3, None, "x", None, b"\x00")]
    df = spark.createDataFrame(rows, "i int, d double, s string, n string, b binary").withColumn("t", F.timestamp_seconds(F.col("i") * 86400))
    return df.withColumn("a", F.array("i", "i")).withColumn("when", F.col("t").cast("date"))


def test_distinct_counts_equal_count_distinct(spark):
    df = awkward(spark)
    for part in (df, df.limit(0), df.union(df).repartition(5)):
        got = {r.column: (r.n_distinct, r.nulls, r.n_rows) for r in C.column_counts(part, df.columns).collect()}
        want = part.agg(*[F.count_distinct(c).alias(c) for c in df.columns], *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns],
                        F.count("*").alias("rows")).first()
        assert got == {c: (want[c], want[f"null_{c}"], want["rows"]) for c in df.columns}
    assert C.column_counts(df, []).count() == 0


def test_plan_has_no_expand_and_moves_values_once(spark):
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    for df in (S.table_summary(li), P.distinct_counts(li)):
        plan = plan_of(df)
        assert "Expand" not in plan
        assert plan.count("Exchange hashpartitioning(c#") == 2           # the values, then one row a column and task
        assert [x for x in plan.split("\n") if "Exchange hashpartitioning(c#" in x and " k#" in x.split("]")[0].split(")")[0]].__len__() == 1


def test_charts_equal_those_of_single_columns(spark):
    n = 400
    df = spark.range(n).select(F.col("id").alias("many"), (F.col("id") % 20).alias("twenty"), (F.col("id") % 21 / 4).alias("more"),
                               F.when(F.col("id") % 3 > 0, F.concat(F.lit("w"), F.col("id") % 33)).alias("words"), (F.col("id") % 2 == 0).alias("flag"),
                               F.lit(None).cast("double").alias("none"), F.lit(2.5).alias("one"),
                               F.when(F.col("id") % 7 == 0, float("nan")).when(F.col("id") % 7 == 1, float("inf")).otherwise(F.col("id") / 3).alias("odd"))
    got = C.chart_data_all(df.repartition(6)).collect()
    by = {}
    for r in got:
        by.setdefault(r.column, []).append(r)
    assert {c: {r.chart for r in rows} for c, rows in by.items()} == {
        "many": {"histogram"}, "twenty": {"counts"}, "more": {"histogram"}, "words": {"top"}, "flag": {"counts"}, "one": {"counts"}, "odd": {"histogram"}}
    for c in ("twenty", "flag", "one"):
        assert sorted((r.value, r["count"]) for r in by[c]) == sorted((r.value, r["count"]) for r in P.chart_data(df, c).collect())
    for c in ("many", "more", "odd"):
        assert [(r.bin, r.lower, r.upper, r["count"]) for r in sorted(by[c], key=lambda r: r.bin)] == [
            tuple(r) for r in sorted(P.histogram(df, c).collect(), key=lambda r: r.bin)]
    want = [(r.value, r["count"], r.n_unique) for r in P.chart_data(df, "words").collect()]
    assert sorted((r.value, r["count"], r.n_unique) for r in by["words"]) == sorted(want) and len(want) == 20
    assert C.chart_data_all(df.limit(0)).count() == 0
    assert C.chart_data_all(df, ["flag"]).count() == 2


def test_grids_of_pairs(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(0, 1, 500), rng.normal(5, 2, 500)
    rows = [(float(a) if k % 9 else None, float(b) if k % 7 else float("nan"), 3.0, None) for k, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x double, y double, one double, none double").repartition(4)
    got = C.pair_grids(df, [("x", "y"), ("x", "one"), ("x", "none")], 8)
    ok = np.array([k % 9 > 0 and k % 7 > 0 for k in range(500)])
    want, ex, ey = np.histogram2d(x[ok], y[ok], 8)
    cells = {(r.bx, r.by): r for r in got.where("y_col = 'y'").collect()}
    assert sum(r["count"] for r in cells.values()) == ok.sum()
    for (a, b), r in cells.items():
        assert r["count"] == want[a, b]
        assert (r.x_lower, r.x_upper, r.y_lower, r.y_upper) == pytest.approx((ex[a], ex[a + 1], ey[b], ey[b + 1]))
    assert got.where("y_col = 'one'").agg(F.sum("count")).first()[0] == sum(k % 9 > 0 for k in range(500))
    assert got.where("y_col = 'none'").count() == 0 and C.pair_grids(df, []).count() == 0
    same = P.histogram_2d(df, "x", "y", 8).select("bx", "by", "count").collect()
    assert sorted(map(tuple, same)) == sorted((a, b, r["count"]) for (a, b), r in cells.items())


def test_all_grids_take_two_scans(spark):
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    plan = plan_of(P.histogram_2d_pairs(li, ["l_quantity", "l_tax", "l_discount"], ["l_extendedprice", "l_partkey"]))
    assert plan.count("Scan parquet") + plan.count("FileScan") <= 2 and "Union" not in plan      # the ranges took the other scan

"""Physical-plan properties that matter at scale."""

import re

from pyspark.sql import functions as F

from conftest import SMALL
from tabloom.operators import clean as C
from tabloom.operators import order as O
from tabloom.operators import profile as P
from tabloom.operators import merge as J


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def single_partition_only_over_aggregates(p: str) -> bool:
    """Every 'Exchange SinglePartition' must sit directly on an aggregate or a
    window over an aggregated (small) input, never on a raw scan."""
    lines = p.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = "\n".join(lines[i + 1:i + 4])
            if "Aggregate" not in below:
                return False
    return True


def test_ffill_has_no_global_window_over_rows(spark):
    ev = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", "value")
    p = plan(O.forward_fill(ev, ["value"], ["event_id"], nblocks=4))
    assert "hashpartitioning(__block" in p
    assert single_partition_only_over_aggregates(p)


def test_bfill_reads_each_partition_once(spark):
    # Spark starts a frame that ends with its partition anew for every row
    ev = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", "user_id", "value")
    for part in ([], ["user_id"]):
        p = plan(O.backward_fill(ev, ["value"], ["event_id"], part, nblocks=4)).lower()
        assert "unboundedpreceding" in p and "unboundedfollowing" not in p


def test_bfill_by_group_with_missing_keys(spark):
    data = [(g, i, float(i) if i % 5 == 4 else None) for i in range(60) for g in ("a", "b", None)] + [("a", None, None), ("b", None, 7.0)]
    df = spark.createDataFrame(data, "g string, i int, v double")
    got = {(r.g, r.i): r.v for r in O.backward_fill(df, ["v"], ["i"], ["g"], nblocks=5).collect()}
    want = {(g, i): float(i // 5 * 5 + 4) for i in range(60) for g in ("a", "b", None)} | {("a", None): 4.0, ("b", None): 7.0}
    assert got == want


def test_projection_pruned_at_scan(spark):
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    p = plan(P.numeric_stats(li, ["l_quantity", "l_tax"]))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    assert schemas and all(set(s.split(",")) <= {"l_quantity:double", "l_tax:double"} for s in schemas)


def test_not_null_filter_pushed_down(spark):
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    p = plan(C.drop_null_target(li, "l_quantity").select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_quantity)" in p


def test_dedup_pre_aggregates_before_shuffle(spark):
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    p = plan(C.drop_duplicates(li, ["l_orderkey", "l_linenumber"]))
    exch = p.index("Exchange hashpartitioning(l_orderkey")
    assert "partial_min" in p[exch:], "no map-side partial aggregate below the shuffle"


def test_group_sum_is_aggregate_then_join_not_window(spark):
    o = spark.read.parquet(f"{SMALL}/orders.parquet")
    p = plan(J.group_sum_attach(o, "o_orderdate", ["o_totalprice"], grain="day"))
    assert "partial_sum" in p and "Window" not in p


def test_top_k_is_salted(spark):
    o = spark.read.parquet(f"{SMALL}/orders.parquet")
    p = plan(O.top_k_per_group(o, ["o_custkey"], [F.desc("o_orderdate")], 3))
    assert re.search(r"hashpartitioning\(o_custkey#\d+L, __salt", p)


def test_sales_by_weekday_ranks_only_aggregated_rows(spark):
    from tabloom.plans import views as V
    p = plan(P.sales_by_weekday(V.sales(spark, SMALL)))
    assert single_partition_only_over_aggregates(p)


def test_moments_are_one_scan(spark):
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    p = plan(P.numeric_stats(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
    assert p.count("FileScan parquet") == 1


def test_hot_key_holding_a_third_of_rows(spark):
    """One key with a third of the rows: results stay exact and the work is
    pre-aggregated (group sums, dedup) or salted (top-k) before the shuffle."""
    from pyspark.sql import functions as F2
    n = 3000
    df = spark.range(n).select(
        F2.when(F2.col("id") % 3 == 0, F2.lit("hot")).otherwise(F2.concat(F2.lit("k"), (F2.col("id") % 97).cast("string"))).alias("k"),
        F2.col("id"), (F2.col("id") % 10).cast("double").alias("v"))
    sums = J.group_sum_attach(df.withColumn("d", F2.lit("2024-01-01")), "d", ["v"], grain="day")
    assert sums.select(F2.sum("v_daily_sum")).first()[0] == float(n) * df.agg(F2.sum("v")).first()[0]
    first = C.drop_duplicates(df, ["k"], order_by=["id"])
    assert first.where("k = 'hot'").first()["id"] == 0
    top = O.top_k_per_group(df, ["k"], [F2.desc("id")], 2)
    assert sorted(r["id"] for r in top.where("k = 'hot'").collect()) == [2994, 2997]
    assert "partial_min" in plan(first) and "__salt" in plan(top)


def test_null_key_third_of_rows_join(spark):
    """A third of the left keys are NULL (the hot key of a null-safe join):
    plain equality keeps them unmatched, null-safe matching pairs them with the
    NULL-key dimension row, and no left row is lost or duplicated."""
    from pyspark.sql import functions as F2
    left = spark.range(3000).select(F2.when(F2.col("id") % 3 == 0, F2.lit(None)).otherwise(F2.col("id") % 50).alias("k"),
                                    F2.col("id"))
    right = spark.range(50).select(F2.col("id").alias("k"), F2.lit("dim").alias("v")) \
        .unionByName(spark.createDataFrame([(None, "null-dim")], "k long, v string"))
    plain = J.left_join(left, right, "k", parse_dates=False)
    safe = J.left_join(left, right, "k", parse_dates=False, null_keys_match=True)
    assert plain.count() == safe.count() == 3000
    assert plain.where("v IS NULL").count() == 1000
    assert safe.where("v = 'null-dim'").count() == 1000

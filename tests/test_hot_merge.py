"""Full outer merges whose hot and NULL keys are split: same rows as a plain join, even tasks."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators import merge as J


def plain(a, b, key):
    return a.join(b, key, "full")


def bag(df):
    return sorted(map(repr, df.collect()))


def sides(spark, n=6000):
    """Two fifths of the left keys are NULL, a fifth is one key; the right has both, and a hot key that the left lacks."""
    a = spark.range(n).select(F.when(F.col("id") % 5 < 2, None).when(F.col("id") % 5 == 2, 7).otherwise(F.col("id") % 900).alias("k"), F.col("id").alias("x"))
    b = spark.range(2000).select(F.when(F.col("id") < 300, -1).when(F.col("id") < 500, None).when(F.col("id") < 503, 7)
                                 .otherwise(F.col("id")).alias("k"), F.col("id").alias("y"))
    return a, b


@pytest.mark.parametrize("hot_rows", [1, 50, 100, 10 ** 9])
def test_equal_to_a_plain_join(spark, hot_rows):
    a, b = sides(spark)
    assert bag(J.merge_on_key({"a": a, "b": b}, "k", hot_rows)) == bag(plain(a, b, "k"))
    assert bag(J.merge_on_key({"b": b, "a": a}, "k", hot_rows).select("k", "x", "y")) == bag(plain(a, b, "k").select("k", "x", "y"))


def test_three_tables_and_both_sides_hot(spark):
    a = spark.range(400).select(F.when(F.col("id") < 200, 1).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("x"))
    b = spark.range(150).select(F.when(F.col("id") < 100, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("y"))
    c = spark.range(60).select(F.when(F.col("id") < 5, 1).when(F.col("id") < 30, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("z"))
    want = plain(plain(a, b, "k"), c, "k")
    assert bag(J.merge_on_key({"a": a, "b": b, "c": c}, "k", 30)) == bag(want)


def test_repeated_rows_and_strings(spark):
    a = spark.createDataFrame([("hot", 1)] * 90 + [(None, 2)] * 40 + [("é", 3), ("", 4)], "k string, v int")
    b = spark.createDataFrame([("hot", 5)] * 3 + [(None, 6)] * 2 + [("é", 7), ("z", 8)], "k string, v int")
    got = J.merge_on_key({"a": a, "b": b}, "k", 20)
    assert got.columns == ["k", "v", "v_b"]
    assert bag(got) == bag(plain(a, b.withColumnRenamed("v", "v_b"), "k"))
    assert bag(J.merge_on_key({"a": a.limit(0), "b": b}, "k", 2).select("k", "v_b")) == bag(b.select("k", F.col("v").alias("v_b")))
    assert J.merge_on_key({"a": a.limit(0), "b": b.limit(0)}, "k").count() == 0


def test_tasks_are_even(spark):
    a, b = sides(spark, 60_000)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

        def sizes(df):
            return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
        even, skewed = sizes(J.merge_on_key({"a": a, "b": b}, "k", 200)), sizes(plain(a, b, "k"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(even) == sum(skewed)
    assert even[-1] <= 3 * even[len(even) // 2] and len(even) == 16
    assert skewed[-1] > 3 * skewed[len(skewed) // 2]

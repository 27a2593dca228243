"""Keyed draws, hashed maps, calendars that know their years, one-hot of any width."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators import clean as C
from tabloom.operators import dates as D
from tabloom.operators import encode as E
from tabloom.operators import profile as P


def test_a_map_of_ten_thousand_pairs_is_a_join(spark):
    df = spark.range(3000).select((F.col("id") * 7).alias("k"), F.col("id").alias("after"))
    out = C.map_column(df, "k", range(10_000), [f"v{i}" for i in range(10_000)], "m", default="none")
    assert out.columns == ["k", "m", "after"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and "map(" not in plan
    rows = out.collect()
    assert len(rows) == 3000 and all(r.m == (f"v{r.k}" if r.k < 10_000 else "none") for r in rows)


def test_map_values_and_repeated_keys(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    assert {r.k: r.n for r in C.map_column(df, "k", ["a", "b", "a"], [1, 2.5, 3], "n").collect()} == {"a": 3.0, "b": 2.5, "c": None, None: None}
    assert {r.k: r.n for r in C.map_column(df, "k", ["a", "b"], ["x", None], "n", default="d").collect()} == {"a": "x", "b": "d", "c": "d", None: "d"}
    assert {r.n for r in C.map_column(df, "k", [], [], "n", default=0).collect()} == {0}
    assert {r.k: r.n for r in C.map_column(df, "k", ["a", "b"], [True, "t"], "n").collect()} == {"a": "True", "b": "t", "c": None, None: None}


def test_onehot_has_a_bound_and_a_sparse_form(spark, monkeypatch):
    wide = spark.range(200_000).select("id", F.concat(F.lit("v"), F.col("id")).alias("c"))
    collected = []
    real = E.cut_lineage
    monkeypatch.setattr(E, "cut_lineage", lambda df: (collected.append(df), real(df))[1])
    with pytest.raises(E.TooManyCategories):
        E.fit_onehot(wide, ["c"])
    small = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c"), (4, "b")], "id int, c string")
    dense = E.fit_onehot(small, ["c"])
    rows = sorted(tuple(r) for r in E.onehot_sparse(small, ["id"], ["c"]).collect())
    assert rows == [(1, "c", 1), (4, "c", 1), (4, "c", 2)]
    names = dense.apply(small).columns[1:]
    assert names == ["c_b", "c_c"]                      # code k is dummy number k of the dense form
    assert sorted(tuple(r) for r in E.onehot_sparse(small, ["id"], ["c"], drop_first=False).collect()) == sorted(rows + [(2, "c", 0)])
    codes = E.fit_label_codes(small, ["c"], missing="null")
    new = spark.createDataFrame([(9, "zzz"), (8, "c")], "id int, c string")
    assert [tuple(r) for r in E.onehot_sparse(new, ["id"], ["c"], codes=codes).collect()] == [(8, "c", 2)]


def test_jitter_follows_the_key(spark):
    df = spark.range(500).select("id", F.concat(F.lit("p"), F.col("id") % 3).alias("p"), (F.col("id") * 1.5).alias("y"))
    a = sorted(map(tuple, P.scatter_data(df.repartition(1), "p", "y", key="id").collect()))
    assert a == sorted(map(tuple, P.scatter_data(df.repartition(7), "p", "y", key="id").collect()))
    assert all(abs(x - round(x)) <= 0.3 for x, _ in a) and len({x for x, _ in a}) > 400
    some = P.scatter_data(df.repartition(3), "p", "y", fraction=0.4, key="id").count()
    assert some == P.scatter_data(df, "p", "y", fraction=0.4, key="id").count() and 130 < some < 270
    assert P.scatter_data(df, "p", "p").count() == 500


def test_calendar_knows_its_years(spark):
    days = ["1900-01-01", "1954-12-31", "1955-01-01", "2024-02-12", "2024-02-13", "2099-01-01", "2150-01-01", None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d string").withColumn("d", F.col("d").cast("date"))
    assert [r.holiday for r in D.add_holiday_flag(df, "d").orderBy("i").collect()] == [None, None, True, True, False, True, None, False]
    own = spark.createDataFrame([("1900-01-01", "x"), ("1900-01-01", "y")], "date string, name string")
    assert [r.holiday for r in D.add_holiday_flag(df, "d", holidays=own).orderBy("i").collect()] == [True] + [False] * 7


def test_season_without_a_month_column(spark):
    df = spark.createDataFrame([("2024-07-01 10:00:00",)], "date string")
    assert D.business_flags(df, month_col="absent").first().season == 0
    assert D.business_flags(df).first().season == 2

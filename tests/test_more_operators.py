"""Further operator semantics: overview, profiles, merges, calendar features, I/O."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabloom.operators import clean as C
from tabloom.operators import encode as E
from tabloom.operators import merge as J
from tabloom.operators import modeling as M
from tabloom.operators import profile as P
from tabloom.operators import timeseries as W
from tabloom.sources import io as S


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def test_overview_counts_and_head(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "x", float(i)) for i in range(8)], "a int, b string, c double")
    summ, head = P.overview(df)
    r = summ.first()
    assert (r["n_rows"], r["n_columns"], r["n_numeric"], r["n_categorical"], r["n_with_missing"]) == (8, 3, 2, 1, 1)
    assert head.count() == 5


def test_stringify_keeps_null(spark):
    df = spark.createDataFrame([(5.0, None)], "x double, y int")
    assert rows(C.stringify(df)) == [("5.0", None)]


def test_pre_transform_profile_flags_nonpositive(spark):
    df = spark.createDataFrame([(-1.0, 1.0), (2.0, 2.0), (3.0, None), (10.0, 4.0)], "a double, b double")
    out = {r["column"]: r for r in P.pre_transform_profile(df).collect()}
    assert out["a"]["nonpositive_min"] is True and out["b"]["nonpositive_min"] is False
    assert out["b"]["missing"] == 1 and out["a"]["median"] == 2.5


def test_chart_data_dispatch(spark):
    few = spark.createDataFrame([(x,) for x in "aabbc"], "k string")
    assert sorted(rows(P.chart_data(few, "k"))) == [("a", 2), ("b", 2), ("c", 1)]
    many = spark.range(100).select(F.col("id").cast("double").alias("v"))
    h = P.chart_data(many, "v", bins=10)
    assert h.count() == 10 and sum(r["count"] for r in h.collect()) == 100


def test_histogram_2d_pairs_skip_same_and_top_cells(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), float(-i)) for i in range(30)], "x double, y double, z double")
    pairs = P.histogram_2d_pairs(df, ["x", "y"], ["y", "z"], bins=3)
    combos = {(r["x_col"], r["y_col"]) for r in pairs.collect()}
    assert combos == {("x", "y"), ("x", "z"), ("y", "z")}
    top = P.top_cells(P.histogram_2d(df, "x", "z", 3), 2).collect()
    assert [r["rank"] for r in top] == [1, 2] and top[0]["count"] >= top[1]["count"]


def test_scatter_codes_with_jitter(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("b", 3.0)], "k string, y double")
    pts = rows(P.scatter_data(df, "k", "y", seed=3), "x")
    codes = [round(x) for (x,) in pts]
    assert codes == [1, 0, 1] and all(abs(x - round(x)) <= 0.3 for (x,) in pts)


def test_row_counts_metrics(spark):
    df = spark.range(10)
    r = P.row_counts(df, df.where("id < 4")).first()
    assert (r["rows_before"], r["rows_after"], r["rows_removed"]) == (10, 4, 6)


def test_encode_plan_and_refusal(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 3.0), ("a", "y", 5.0)], "k string, m string, t double")
    out = E.encode(df, {"k": {"method": "onehot"}, "m": {"method": "target", "target_col": "t"}})
    assert "k_b" in out.columns and "m_target" in out.columns and "k" not in out.columns
    with pytest.raises(ValueError):
        E.encode(df, {"t": "label"})
    prof = E.category_profile(df, "m").collect()
    assert prof[0]["value"] == "y" and prof[0]["missing"] == 0


def test_one_hot_bound(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("k"))
    with pytest.raises(E.TooManyCategories):
        E.fit_onehot(df, ["k"], max_categories=10)


def test_merge_on_key_overlap_suffix_and_missing_key(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    out = J.merge_on_key({"a": a, "b": b}, "k")
    assert out.columns == ["k", "v", "v_b"]
    assert sorted(rows(out), key=str) == sorted([(1, "x", None), (2, "y", "z"), (3, None, "w")], key=str)
    with pytest.raises(ValueError):
        J.merge_on_key({"a": a, "c": spark.createDataFrame([(1,)], "q int")}, "k")


def test_auto_date_join_keys_three_tables_and_fallback(spark):
    sales = spark.createDataFrame([("2024-01-01 10:00:00", 5.0)], "date string, sales double")
    weather = spark.createDataFrame([("2024-01-01 10:00:00", 3.5)], "Date_and_Time string, temp double")
    out = J.auto_date_join({"sales": sales, "weather": weather})
    assert rows(out, "sales", "temp") == [(5.0, 3.5)]
    more = spark.createDataFrame([("2024-01-01 10:00:00", 7.5, 1.0)], "Date_and_Time string, temp double, date_x double")
    three = J.auto_date_join({"sales": sales, "weather": weather, "more": more})
    assert rows(three, "sales", "temp", "temp_more") == [(5.0, 3.5, 7.5)] and "Date_and_Time_more" in three.columns
    plain = spark.createDataFrame([(2, 9.0), (1, 8.0)], "x int, sales double")
    out = J.auto_date_join({"sales": sales, "plain": plain, "weather": weather})
    assert sorted(rows(out, "sales", "x", "sales_plain", "temp"), key=str) == sorted([(5.0, 1, 8.0, 3.5), (None, 2, 9.0, None)], key=str)
    assert out.columns == ["date", "sales", "x", "sales_plain", "Date_and_Time", "temp"]


def test_merge_auto(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([("y", 2)], "v string, k int")
    assert sorted(rows(J.merge_auto({"a": a, "b": b}))) == [(1, "x"), (2, "y")]
    c = spark.createDataFrame([(5.0,)], "w double")
    assert rows(J.merge_auto({"a": a, "c": c})) == [(1, "x", 5.0)] and rows(J.merge_auto({"a": a})) == [(1, "x")]
    with pytest.raises(ValueError):
        J.merge_auto({"a": a, "c": c.union(c)})


def test_table_infos_and_strategy(spark):
    a = spark.range(3)
    b = spark.range(3)
    infos = J.table_infos({"a": a, "b": b})
    assert [i["row_count"] for i in infos] == [3, 3]
    assert J.choose_merge_strategy(infos) == "vertical"


def test_calendar_lag_features(spark):
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=i) for i in range(400)]
    df = spark.createDataFrame([(d, float(i)) for i, d in enumerate(days)], "day date, sales double")
    t = {r["day"]: r for r in W.trailing_ma(df, "sales", [3]).collect()}
    assert t[dt.date(2023, 1, 5)]["sales_trailing_ma_3"] == pytest.approx((1 + 2 + 3) / 3)
    assert t[dt.date(2023, 1, 1)]["sales_trailing_ma_3"] is None
    lag = {r["day"]: r for r in W.lagged_ma(df, "sales", 10, 2).collect()}
    assert lag[dt.date(2023, 1, 13)]["sales_lag10_ma2"] == pytest.approx((1 + 2) / 2)
    pw = {r["day"]: r for r in W.prev_year_same_weekday(df, "sales").collect()}
    assert pw[dt.date(2023, 12, 31)]["prev_year_same_weekday_sales"] == 0.0  # 364 days earlier
    pd_ = {r["day"]: r for r in W.prev_year_same_date(df, "sales").collect()}
    assert pd_[dt.date(2024, 1, 2)]["prev_year_same_date_sales"] == 1.0


def test_prev_year_same_date_leap_day(spark):
    df = spark.createDataFrame([(dt.date(2023, 2, 28), 1.0), (dt.date(2024, 2, 28), 2.0), (dt.date(2024, 2, 29), 3.0)],
                               "day date, sales double")
    got = {r["day"]: r["prev_year_same_date_sales"] for r in W.prev_year_same_date(df, "sales").collect()}
    assert got[dt.date(2024, 2, 29)] == 1.0 and got[dt.date(2024, 2, 28)] == 1.0


def test_time_split_keeps_ties_together(spark):
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1 + i // 10)) for i in range(50)], "id int, ts timestamp")
    out = M.add_time_split(df, "ts", 0.2)
    per_day = out.groupBy(F.to_date("ts")).agg(F.countDistinct("split").alias("n")).collect()
    assert all(r["n"] == 1 for r in per_day)
    assert out.where("split = 'test'").count() == 10


def test_save_table_modes_and_export_and_list(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    p = str(tmp_path / "t1")
    S.save_table(df, "t1", path=p)
    with pytest.raises(Exception):
        S.save_table(df, "t1", path=p)
    S.save_table(df, "t1", path=p, overwrite=True)
    rep = S.export_csv({"t1": df, "nope": df}, str(tmp_path / "csv"), known=["t1"]).collect()
    assert {(r["table"], r["rows"], r["status"]) for r in rep} == {("t1", 2, "written"), ("nope", 0, "skipped")}
    back = S.read_csv(spark, str(tmp_path / "csv" / "t1"))
    assert sorted(rows(back)) == [("1", "a"), ("2", "b")]


def test_run_sql_with_parameters(spark):
    spark.range(5).createOrReplaceTempView("nums")
    assert S.run_sql(spark, "SELECT count(*) FROM nums WHERE id > ?", [2]).first()[0] == 2
    assert S.run_sql(spark, "SELECT count(*) FROM nums WHERE id > :k", {"k": 3}).first()[0] == 1


def test_nested_cv_small(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5), float(2 * (i % 7) + (i % 5))) for i in range(300)],
                               "id long, a double, b double, y double")
    res = M.nested_cv(df, ["a", "b"], "y", {"n_estimators": (3, 5), "max_depth": [2, 3]}, key="id",
                      outer=2, inner=2, n_trials=2, refit=False)
    assert len(res.all_scores) == 2 and res.best_params in res.all_params
    trials = M.simple_tuning(df, ["a", "b"], "y", {"n_estimators": (3, 5)}, n_trials=2, key="id", k=2).collect()
    assert [r["rank"] for r in trials] == [1, 2]


def test_catalog_table_lifecycle(spark):
    name = "tabloom_test_sales"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df = spark.createDataFrame([(1, 5.0), (2, None)], "id int, sales double")
    assert not S.table_exists(spark, name)
    S.create_table(spark, name, data=df)
    S.create_table(spark, name, data=df)  # IF NOT EXISTS: unchanged
    assert S.table_exists(spark, name) and S.table_count(spark.table(name)) == 2
    S.insert_rows(spark.createDataFrame([(3, 7.5)], "id int, sales double"), name)
    assert S.table_count(S.read_table(spark, name, ["id"])) == 3
    listed = {r["name"]: r["rows"] for r in S.list_tables(spark).collect()}
    assert listed.get(name) == 3
    schema = {r["column"]: r["dtype"] for r in S.table_schema(spark.table(name)).collect()}
    assert schema == {"id": "int", "sales": "double"}
    assert "CREATE TABLE" in S.table_ddl(spark, name).upper()
    summ = {r["column"]: (r["nulls"], r["n_distinct"]) for r in S.table_summary(spark.table(name)).collect()}
    assert summ == {"id": (0, 3), "sales": (1, 2)}
    spark.sql(f"DROP TABLE {name}")


def test_scale_settings_bounds():
    from tabloom.session import scale_settings
    small = scale_settings(10 << 20, 8)
    big = scale_settings(100 << 40, 8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 16
    assert int(big["spark.sql.shuffle.partitions"]) > 400_000
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"

"""Operator semantics on hand-made frames (FIXTURES.md section 4)."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.functions.calendar import japanese_holidays
from tabloom.functions.exprs import strptime_to_java
from tabloom.operators import clean as C
from tabloom.operators import dates as D
from tabloom.operators import encode as E
from tabloom.operators import impute as I
from tabloom.operators import merge as J
from tabloom.operators import modeling as M
from tabloom.operators import order as O
from tabloom.operators import poly as PO
from tabloom.operators import profile as P
from tabloom.operators import runs as R
from tabloom.operators import scale as H
from tabloom.sources import io as S


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()] if cols else [tuple(r) for r in df.collect()]


# --- filters and text ---------------------------------------------------------------------

def test_keyword_is_regex_and_missing_never_matches(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "a.c"), (3, "axc"), (4, None)], "id int, t string")
    # 'a.c' as a regex matches abc, a.c and axc; the NULL row stays
    assert sorted(rows(C.remove_rows_by_keyword(df, "a.c", ["t"]), "id")) == [(4,)]
    # literal mode only removes the literal text
    assert sorted(rows(C.remove_rows_by_keyword(df, "a.c", ["t"], regex=False), "id")) == [(1,), (3,), (4,)]


def test_nan_text_is_real_text(spark):
    df = spark.createDataFrame([(1, "nan"), (2, None)], "id int, t string")
    assert rows(C.remove_rows_by_keyword(df, "nan"), "id") == [(2,)]


def test_search_is_case_insensitive(spark):
    df = spark.createDataFrame([(1, "Red Plate"), (2, "blue")], "id int, t string")
    assert rows(C.filter_rows_by_search(df, "t", "RED"), "id") == [(1,)]


def test_delete_where_keeps_unknown(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 1.0)], "id int, x double")
    assert sorted(rows(C.delete_rows_where(df, "x > 2"), "id")) == [(2,), (3,)]


def test_drop_duplicates_keeps_first_by_order(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 5), (1, "z", 1)], "k int, v string, o int")
    out = sorted(rows(C.drop_duplicates(df, ["k"], order_by=["o", "v"]), "k", "v"))
    assert out == [(1, "a"), (2, "c")]


def test_drop_columns_warn_and_error(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert C.drop_columns(df, ["b", "nope"]).columns == ["a"]
    with pytest.raises(KeyError):
        C.drop_columns(df, ["nope"], missing="error")


def test_replace_text_literal_and_counts(spark):
    df = spark.createDataFrame([("a.b", 1), ("ab", 2), (None, 3)], "s string, n int")
    out = rows(C.replace_text(df, ".", "-", ["s"]), "s")
    assert out == [("a-b",), ("ab",), (None,)]
    counts = dict(rows(C.replace_text_counts(df, ".", "-", ["s", "n"])))
    assert counts == {"s": 1, "n": 0}


def test_map_column_position_default_and_length_check(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "k string, n int")
    out = C.map_column(df, "k", ["x", "y"], ["X", "Y"], "k2", default="?")
    assert out.columns == ["k", "k2", "n"]
    assert rows(out, "k2") == [("X",), ("Y",), ("?",)]
    with pytest.raises(ValueError):
        C.map_column(df, "k", ["x"], ["X", "Y"], "k3")
    assert rows(C.unmapped_values(df, "k", ["x"]).orderBy("value")) == [("y",), ("z",)]


# --- arithmetic and conversion --------------------------------------------------------------

def test_division_by_zero_is_null_and_report(spark):
    df = spark.createDataFrame([(1.0, 0.0), (4.0, 2.0), (None, 1.0), (0.0, 0.0)], "a double, b double")
    out = rows(C.arithmetic(df, "a", "b", "/", "r"), "r")
    assert out == [(None,), (2.0,), (None,), (None,)]
    rep = C.arithmetic_report(df, "a", "b", "/", "r").first()
    assert rep["count"] == 1 and rep["zero_divisors"] == 2 and rep["missing"] == 3


def test_conversion_errors_and_numeric_guard(spark):
    df = spark.createDataFrame([("1",), ("1.5",), ("1d",), ("",), (None,), (" 7 ",)], "s string")
    conv = C.convert_types(df, {"s": "float"})
    assert rows(conv, "s") == [(1.0,), (1.5,), (None,), (None,), (None,), (7.0,)]
    err = rows(C.conversion_errors(df, {"s": "int"}), "column", "errors")
    assert err == [("s", 3)]  # 1.5, 1d, '' fail; NULL is not an error


def test_binarize_nan_and_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (5.0,)], "x double")
    assert rows(C.binarize(df, "x", 2.0), "x_bin") == [(0,), (0,), (0,), (1,)]


def test_inf_to_missing(spark):
    df = spark.createDataFrame([(float("inf"),), (-float("inf"),), (1.0,), (float("nan"),)], "x double")
    assert rows(C.inf_to_missing(df), "x") == [(None,), (None,), (1.0,), (None,)]


def test_polynomial_names_and_values(spark):
    df = spark.createDataFrame([(2.0, 3.0, 5.0)], "a double, b double, c double")
    out = PO.polynomial_features(df, ["a", "b", "c"], 2)
    assert out.columns[3:] == ["a^2", "a b", "a c", "b^2", "b c", "c^2"]
    assert rows(out)[0][3:] == (4.0, 6.0, 10.0, 9.0, 15.0, 25.0)
    inter = PO.polynomial_features(df, ["a", "b", "c"], 3, interaction_only=True, include_bias=True)
    assert inter.columns[3:] == ["a b", "a c", "b c", "a b c", "1"]
    assert PO.polynomial_size(3, 3) == 16
    with pytest.raises(ValueError):
        PO.polynomial_features(df, ["a"], 2)


# --- dates -------------------------------------------------------------------------------------

def test_strptime_translation():
    assert strptime_to_java("%Y/%m/%d") == "yyyy/MM/dd"
    assert strptime_to_java("%Y-%m-%dT%H:%M:%S") == "yyyy-MM-dd'T'HH:mm:ss"


def test_japanese_dates_and_leap_day(spark):
    df = spark.createDataFrame([("2024年06月07日",), ("2024年02月29日",), ("2023年02月29日",)], "d string")
    out = rows(D.convert_date_format(df, "d", "%Y年%m月%d日"), "d")
    assert out == [("2024-06-07",), ("2024-02-29",), (None,)]
    assert D.convert_date_format(df, "d", "%Y年%m月%d日", errors="unchanged").collect() == df.collect()


def test_weekday_labels(spark):
    df = spark.createDataFrame([(dt.date(2024, 6, 7),)], "d date")  # a Friday
    assert rows(D.add_weekday(df, "d", "w", "long"), "w") == [("Friday",)]
    assert rows(D.add_weekday(df, "d", "w", "short"), "w") == [("Fri",)]
    assert rows(D.add_weekday(df, "d", "w", "ja"), "w") == [("金",)]


def test_year_month_day_inserted_after(spark):
    df = spark.createDataFrame([(1, "2024-01-31", "x"), (2, "bad", "y")], "id int, d string, z string")
    out = D.add_year_month_day(df, "d")
    assert out.columns == ["id", "d", "d_year", "d_month", "d_day", "z"]
    assert rows(out, "d_year", "d_month", "d_day") == [(2024, 1, 31), (None, None, None)]


def test_business_flags(spark):
    df = spark.createDataFrame([("2024-06-08 12:00:00", 12), ("2024-12-26 19:00:00", 19)], "date string, time int")
    out = D.business_flags(df).collect()
    # 2024-06-08 is a Saturday: ISO 6, weekend by the >= 4 rule
    assert (out[0]["dow"], out[0]["is_weekend"], out[0]["is_lunch"], out[0]["time_category"], out[0]["season"]) == \
        (6, 1, 1, 1, 2)
    assert (out[1]["is_month_end"], out[1]["is_dinner"], out[1]["time_category"], out[1]["season"]) == (1, 1, 3, 0)


# Ten holidays checked by hand: fixed, Happy Monday, equinox, substitute, citizens', 2020/2021 moves.
HAND_CHECKED = {
    dt.date(2024, 1, 1): "元日",
    dt.date(2024, 1, 8): "成人の日",
    dt.date(2024, 3, 20): "春分の日",
    dt.date(2024, 2, 12): "振替休日",
    dt.date(2015, 9, 22): "国民の休日",
    dt.date(2020, 7, 24): "スポーツの日",
    dt.date(2021, 8, 8): "山の日",
    dt.date(2019, 5, 1): "天皇の即位の日",
    dt.date(2023, 9, 23): "秋分の日",
    dt.date(2019, 10, 14): "体育の日",
}


def test_holiday_calendar_hand_checked():
    cal = dict(japanese_holidays(2015, 2024))
    for d, name in HAND_CHECKED.items():
        assert cal.get(d) == name, d
    assert dt.date(2019, 12, 23) not in cal  # no emperor's birthday in 2019
    assert dt.date(2020, 10, 12) not in cal  # sports day moved to July in 2020


def test_holiday_flag_join(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 2),), (None,)], "d date")
    out = rows(D.add_holiday_flag(df, "d", "hol", with_name="n"), "hol", "n")
    assert out == [(True, "元日"), (False, None), (False, None)]


# --- imputation ------------------------------------------------------------------------------------

def test_mode_ties_take_smallest_and_median_interpolates(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (1.0,), (None,)], "x double")
    imp = I.fit_imputer(df, {"x": "mode"})
    assert imp.values["x"] == 1.0
    assert I.fit_imputer(df, {"x": "median"}).values["x"] == 2.0


def test_all_missing_column_and_auto(spark):
    df = spark.createDataFrame([(None, None), (1.0, None)], "x double, s string")
    imp = I.auto_imputer(df)
    assert imp.values == {"x": 1.0, "s": "Unknown"}
    assert rows(imp.apply(df)) == [(1.0, "Unknown"), (1.0, "Unknown")]


def test_constant_fill_type_check(spark):
    df = spark.createDataFrame([(None,)], "x double")
    with pytest.raises(ValueError):
        I.fit_imputer(df, {"x": "constant"}, constants={"x": "a"})


def test_ffill_bfill_across_blocks(spark):
    vals = [None, 1.0, None, None, 5.0, None, None, None, 9.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i long, v double")
    ff = rows(O.forward_fill(df, ["v"], ["i"], nblocks=4).orderBy("i"), "v")
    bf = rows(O.backward_fill(df, ["v"], ["i"], nblocks=4).orderBy("i"), "v")
    s = pd.Series(vals)
    assert [r[0] for r in ff] == [None if pd.isna(x) else x for x in s.ffill()]
    assert [r[0] for r in bf] == [None if pd.isna(x) else x for x in s.bfill()]


def test_ffill_partitioned(spark):
    data = [("a", 1, 1.0), ("a", 2, None), ("b", 1, None), ("b", 2, 4.0), ("b", 3, None)]
    df = spark.createDataFrame(data, "g string, i int, v double")
    out = sorted(rows(O.forward_fill(df, ["v"], ["i"], ["g"], nblocks=3), "g", "i", "v"))
    assert out == [("a", 1, 1.0), ("a", 2, 1.0), ("b", 1, None), ("b", 2, 4.0), ("b", 3, 4.0)]


def test_global_row_index_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    idx = O.global_row_index(df, ["k"], nblocks=5)
    got = sorted(rows(idx, "k", "row_index"))
    assert got == [(i, i) for i in range(1000)]


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=2001).round(3)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    ps = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = O.exact_quantiles(df, "x", ps, nblocks=6)
    assert np.allclose(got, np.percentile(x, [p * 100 for p in ps]))


def test_top_k_per_group_with_hot_group(spark):
    data = [("hot", i) for i in range(500)] + [("cold", i) for i in range(3)]
    df = spark.createDataFrame(data, "g string, v int")
    out = O.top_k_per_group(df, ["g"], [F.desc("v")], 2, salt_buckets=8)
    assert sorted(rows(out, "g", "v", "rank")) == [("cold", 1, 2), ("cold", 2, 1), ("hot", 498, 2), ("hot", 499, 1)]


# --- scaling ------------------------------------------------------------------------------------------

def test_scalers_constant_and_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    out = H.scale(df, {"x": "standard", "c": "minmax"}).collect()
    assert [r["x"] for r in out] == [-1.0, 1.0]  # population std = 1
    assert [r["c"] for r in out] == [0.0, 0.0]  # constant -> 0
    rb = H.scale(df.select("c"), {"c": "robust"}).collect()
    assert [r["c"] for r in rb] == [0.0, 0.0]  # zero IQR -> divide by 1


def test_log_shift(spark):
    df = spark.createDataFrame([(-2.0,), (0.0,)], "x double")
    out = [r[0] for r in H.scale(df, {"x": "log"}).collect()]
    assert out == pytest.approx([0.0, math.log(3.0)])


def _sk_uniform(x, n_q=1000):
    """Brute-force reference of the uniform quantile transform (sklearn's rule)."""
    x = np.asarray(x, float)
    k = min(n_q, len(x))
    refs = np.linspace(0, 1, k)
    q = np.percentile(x, refs * 100)
    q = np.maximum.accumulate(q)
    y = 0.5 * (np.interp(x, q, refs) - np.interp(-x, -q[::-1], -refs[::-1]))
    y[x + 1e-7 > q[-1]] = 1
    y[x - 1e-7 < q[0]] = 0
    return y


def test_quantile_uniform_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.exponential(size=1500).round(2), np.full(100, 0.5)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double")
    got = np.array([r[0] for r in H.scale(df, {"x": "quantile"}).orderBy("i").select("x").collect()])
    assert np.allclose(got, _sk_uniform(x), atol=1e-9)


# --- encoding -------------------------------------------------------------------------------------------

def test_onehot_drop_first_and_missing(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "k string")
    oh = E.fit_onehot(df, ["k"])
    out = oh.apply(df)
    assert out.columns == ["k_b", "k_c"]
    assert rows(out) == [(True, False), (False, False), (False, False), (False, True)]


def test_label_codes_unseen_and_missing(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "k string")
    codes = E.fit_label_codes(train, ["k"])
    new = spark.createDataFrame([("a",), ("b",), ("zzz",), (None,)], "k string")
    assert rows(codes.apply(new)) == [(0,), (1,), (2,), (2,)]
    e3 = E.fit_label_codes(train, ["k"], missing="null")
    assert rows(e3.apply(new)) == [(0,), (1,), (None,), (None,)]


def test_label_codes_do_not_depend_on_size(spark):
    """Codes and their type are the same for three categories and for many."""
    for n in (3, 20_000):
        df = spark.range(n).select(F.format_string("v%05d", "id").alias("k"))
        out = E.fit_label_codes(df, ["k"]).apply(df, suffix="_code")
        assert dict(out.dtypes)["k_code"] == "bigint"
        assert sorted(rows(out, "k", "k_code")) == [(f"v{i:05d}", i) for i in range(n)]


def test_frequency_and_target_encoding(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 7.0)], "k string, y double")
    fr = rows(E.fit_frequency(df, ["k"]).apply(df), "k_freq")
    assert [r[0] for r in fr][:3] == pytest.approx([2 / 3, 2 / 3, 1 / 3]) and fr[3][0] is None
    te = rows(E.fit_target_mean(df, ["k"], "y").apply(df), "k_target")
    assert [r[0] for r in te] == [2.0, 2.0, 5.0, None]


# --- profiling ---------------------------------------------------------------------------------------------

def test_numeric_stats_bias_corrected_like_pandas(spark):
    x = [1.0, 2.0, 2.0, 3.0, 10.0, 4.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    r = P.numeric_stats(df).first()
    s = pd.Series(x)
    assert r["skewness"] == pytest.approx(s.skew())
    assert r["kurtosis"] == pytest.approx(s.kurt())
    assert r["std"] == pytest.approx(s.std())
    assert r["q1"] == pytest.approx(s.quantile(0.25))


def test_numeric_stats_small_n_is_null(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    r = P.numeric_stats(df).first()
    assert r["skewness"] is None and r["kurtosis"] is None


def test_histogram_max_in_last_bin_and_constant(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "x double")
    h = {r["bin"]: r["count"] for r in P.histogram(df, "x", 2).collect()}
    assert h == {0: 1, 1: 2}
    counts, _ = np.histogram([0.0, 5.0, 10.0], bins=2)
    assert list(counts) == [1, 2]
    c = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    hc = P.histogram(c, "x", 2).orderBy("bin").collect()
    assert (hc[0]["lower"], hc[-1]["upper"]) == (2.5, 3.5)


def test_bround_half_even_average_spend(spark):
    df = spark.createDataFrame([(5.0, 2, "月"), (7.0, 2, "火")], "sales double, customer_count int, dow string")
    out = {r["dow"]: r["avg_spend"] for r in P.sales_by_weekday(df).collect()}
    assert out == {"月": 2, "火": 4}  # 2.5 -> 2, 3.5 -> 4


def test_weekday_never_seen_is_absent_and_empty_frame(spark):
    df = spark.createDataFrame([(5.0, 1, "月")], "sales double, customer_count int, dow string")
    assert [r["dow"] for r in P.sales_by_weekday(df).collect()] == ["月"]
    empty = df.limit(0)
    assert P.sales_by_weekday(empty).count() == 0
    t = P.sales_totals(empty).first()
    assert (t["total_sales"], t["total_customers"], t["avg_spend"]) == (0.0, 0, 0)


def test_frequency_ranking_ties_and_missing(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "k string")
    r = rows(P.frequency_ranking(df, "k", 2), "rank", "value", "count", "n_unique", "n_other")
    assert r == [(1, "a", 2, 3, 1), (2, "b", 2, 3, 1)]
    withnull = rows(P.frequency_ranking(df, "k", 5, include_missing=True), "value")
    assert (None,) in withnull


def test_describe_all_text_top(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("y", None)], "t string, v double")
    d = {r["column"]: r for r in P.describe_all(df).collect()}
    assert (d["t"]["unique"], d["t"]["top"], d["t"]["freq"], d["t"]["count"]) == (2, "y", 2, 3)
    assert d["v"]["count"] == 2 and d["v"]["mean"] == 1.5


# --- merges ----------------------------------------------------------------------------------------------------

def test_left_join_null_keys_and_duplicates(spark):
    left = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k int, v string")
    plain = sorted(rows(J.left_join(left, right, "k", parse_dates=False), "v_x", "v_y"), key=str)
    assert plain == sorted([("a", "x"), ("a", "y"), ("n", None)], key=str)
    ns = sorted(rows(J.left_join(left, right, "k", parse_dates=False, null_keys_match=True), "v_x", "v_y"), key=str)
    assert ns == sorted([("a", "x"), ("a", "y"), ("n", "z")], key=str)


def test_merge_horizontal_pads_and_rejects_duplicates(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    b = spark.createDataFrame([("p",)], "y string")
    out = sorted(rows(J.merge_horizontal({"a": a, "b": b}, {"a": ["x"], "b": ["y"]}), "x", "y"))
    assert out == [(1, "p"), (2, None), (3, None)]
    with pytest.raises(ValueError):
        J.merge_horizontal({"a": a, "c": a}, {"a": ["x"], "c": ["x"]})


def test_merge_vertical_schema_check_and_strategy(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(ValueError):
        J.merge_vertical([a, b])
    assert J.choose_merge_strategy([{"columns": ["x"], "row_count": 1}]) == "none"
    assert J.choose_merge_strategy([{"columns": ["x"], "row_count": 1}, {"columns": ["x"], "row_count": 5}]) == "vertical"
    assert J.choose_merge_strategy([{"columns": ["x"], "row_count": 2}, {"columns": ["y"], "row_count": 2}]) == "horizontal"
    assert J.choose_merge_strategy([{"columns": ["x"], "row_count": 1}, {"columns": ["y"], "row_count": 2}]) == "manual"


def test_group_sum_all_missing_is_zero_and_bad_date_null(spark):
    df = spark.createDataFrame([("2024-01-01", None), ("2024-01-01", None), ("bad", 3.0), ("2024-01-02", 2.0)],
                               "d string, v double")
    out = rows(J.group_sum_attach(df, "d", ["v"], fmt="%Y-%m-%d"), "d", "v_daily_sum")
    assert out == [("2024-01-01", 0.0), ("2024-01-01", 0.0), ("bad", None), ("2024-01-02", 2.0)]


# --- modelling and runs ---------------------------------------------------------------------------------------------

def test_split_and_folds_are_repeatable_and_proportional(spark):
    df = spark.range(10000)
    a = M.add_split(df, "id", 0.2).groupBy("split").count().collect()
    share = {r["split"]: r["count"] for r in a}["test"] / 10000
    assert abs(share - 0.2) < 0.01
    f1 = rows(M.add_folds(df, "id", 5).orderBy("id"), "fold")
    f2 = rows(M.add_folds(df.repartition(7), "id", 5).orderBy("id"), "fold")
    assert f1 == f2


def test_regression_metrics_and_overfit(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.5), (3.0, 2.5)], "y double, p double")
    r = M.regression_metrics(df, "y", "p").first()
    assert r["r2"] == pytest.approx(1 - 0.5 / 2.0)
    assert r["mae"] == pytest.approx(1 / 3)
    f = M.overfit_flags({"r2": 0.9, "rmse": 1.0}, {"r2": 0.4, "rmse": 2.0})
    assert f["is_overfitting"] and "high_train_low_test" in f["reasons"]


def test_param_sampler_types():
    ps = M.sample_params({"a": [1, 2], "b": (1, 5), "c": (0.01, 1.0)}, 20, seed=1, log_scale=["c"])
    assert all(p["a"] in (1, 2) and isinstance(p["b"], int) and 0.01 <= p["c"] <= 1.0 for p in ps)
    assert ps == M.sample_params({"a": [1, 2], "b": (1, 5), "c": (0.01, 1.0)}, 20, seed=1, log_scale=["c"])


def test_gbt_train_predict_save_load(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(400, 2))
    y = 3 * x[:, 0] + x[:, 1]
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "a double, b double, y double")
    m = M.train_gbt(df, ["a", "b"], "y", {"n_estimators": 20, "max_depth": 3})
    r = M.regression_metrics(M.predict(m, df), "y").first()
    assert r["r2"] > 0.8
    M.save_model(m, str(tmp_path / "m"), {"features": ["a", "b"]})
    m2, meta = M.load_model(str(tmp_path / "m"))
    assert meta["features"] == ["a", "b"]
    imp = M.feature_importance(m2, ["a", "b"]).collect()
    assert imp[0]["feature"] == "a"


def test_runs_table_queries(spark, tmp_path):
    path = str(tmp_path / "runs")
    t0 = dt.datetime(2024, 1, 1)
    for i in range(4):
        R.write_run(spark, path, "exp", f"r{i}", {"depth": 3}, {"r2": 0.1 * i},
                    tags={"mlflow.user": "u", "team": "t"},
                    comments=["モデル: GBT", "my note"], start_time=t0 + dt.timedelta(hours=i))
    runs = spark.read.parquet(path)
    assert rows(R.latest_runs(runs, 2).orderBy("rank"), "run_id") == [("r3",), ("r2",)]
    assert rows(R.visible_tags(runs).limit(1), "tags")[0][0] == {"team": "t"}
    kinds = sorted(set(rows(R.comment_kinds(runs), "comment", "kind")))
    assert kinds == [("my note", "manual"), ("モデル: GBT", "auto")]


# --- sources ---------------------------------------------------------------------------------------------------

def test_csv_blank_to_null_and_type_inference(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a;b;c;d\n1;1.5;x;\n2;;y;\n3;2;;\n", encoding="utf-8")
    df = S.read_csv(spark, str(p), delimiter=";")
    types = dict(rows(S.infer_column_types(df)))
    assert types == {"a": "INTEGER", "b": "REAL", "c": "TEXT", "d": "TEXT"}
    typed = S.apply_inferred_types(df, types)
    assert rows(typed, "a", "b") == [(1, 1.5), (2, None), (3, 2.0)]
    with pytest.raises(ValueError):
        S.read_csv(spark, str(p), delimiter=";", header=False, headers=["only_one"])


def test_update_delete_where(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "id int, x int")
    assert rows(S.update_where(df, {"x": 0}, "x > 3")) == [(1, 0), (2, None)]
    assert rows(C.delete_rows_where(df, "x > 3")) == [(2, None)]


def test_quantiles_and_modes_large_cardinality_paths(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=500).round(4)
    df = spark.createDataFrame([(float(v), int(i % 7) if i % 11 else 3) for i, v in enumerate(x)], "x double, k int")
    small = O.quantiles(df, ["x"], [0.25, 0.5, 0.75])["x"]
    both = O.quantiles(df, ["k", "x"], {"k": [0.5], "x": [0.25, 0.5, 0.75]}, nblocks=7)
    assert np.allclose(small, both["x"]) and np.allclose(small, np.percentile(x, [25, 50, 75]))
    assert both["k"] == [np.median([int(i % 7) if i % 11 else 3 for i in range(500)])]
    assert O.modes(df, ["k"])["k"] == pd.Series([int(i % 7) if i % 11 else 3 for i in range(500)]).mode().min()
    tie = spark.createDataFrame([(3,), (1,), (3,), (1,)], "v int")
    assert O.modes(tie, ["v"])["v"] == 1


def test_fitted_statistics_do_not_move_with_the_batch(spark):
    a = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    b = spark.createDataFrame([(100.0,), (None,)], "x double")
    sc = H.fit_scaler(a, {"x": "standard"})
    imp = I.fit_imputer(a, {"x": "median"})
    assert [r[0] for r in sc.apply(b).collect()] == [98.0, None]  # (100 - 2) / 1
    assert [r[0] for r in imp.apply(b).collect()] == [100.0, 2.0]


def test_missing_indicators(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None)], "x double, s string")
    out = I.missing_indicators(df)
    assert [tuple(r) for r in out.select("x_is_missing", "s_is_missing").collect()] == [(0, 0), (1, 1)]


def test_fitted_objects_round_trip(spark, tmp_path):
    from tabloom.operators import params as PR
    df = spark.createDataFrame([(1.0, "a", "2024-01-01"), (None, "b", "2024-02-03"), (5.0, None, None)],
                               "x double, k string, d string")
    objs = [I.fit_imputer(df, {"x": "median", "k": "mode"}), H.fit_scaler(df, {"x": "robust"}),
            E.fit_onehot(df, ["k"]), E.fit_label_codes(df, ["k"]), E.fit_frequency(df, ["k"]),
            M.fit_feature_pipeline(df, target="x")]
    for i, o in enumerate(objs):
        path = str(tmp_path / f"p{i}")
        PR.save_params(o, path)
        back = PR.load_params(spark, path)
        assert sorted(map(tuple, back.apply(df).collect()), key=str) == sorted(map(tuple, o.apply(df).collect()), key=str)


def test_integer_conversion_keeps_column_on_failure(spark):
    df = spark.createDataFrame([("1", "1"), ("2.5", "2"), (None, "x")], "a string, b string")
    out = C.convert_types(df, {"a": "int", "b": "float"}, errors="keep_column")
    assert [tuple(r) for r in out.collect()] == [("1", "1"), ("2.5", "2"), (None, "x")]
    ok = C.convert_types(df.where("a = '1'"), {"a": "int"}, errors="keep_column")
    assert ok.schema["a"].dataType.simpleString() == "bigint"


def test_column_summary_empty_and_numeric(spark):
    df = spark.createDataFrame([(None, 1.0), (None, float("nan"))], "e string, x double")
    e = P.column_summary(df, "e").first()
    x = P.column_summary(df, "x").first()
    assert (e["analysis_type"], e["missing"], e["missing_rate"]) == ("empty", 2, 100.0)
    assert (x["analysis_type"], x["missing"]) == ("numeric", 1)

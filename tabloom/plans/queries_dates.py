"""Date and calendar queries (D1-D13) with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.calendar import japanese_holidays
from tabloom.functions.exprs import WEEKDAY_JA
from tabloom.operators import dates as D
from tabloom.plans import views as V
from tabloom.plans.registry import nullable_ints_as_double, query, rounded

_JA = "[" + ", ".join(f"'{w}'" for w in WEEKDAY_JA) + "]"


@query("date_reformat", """
SELECT o_orderkey, strftime(try_strptime(order_date, '%Y/%m/%d'), '%Y-%m-%d') AS order_date FROM order_dates_text""",
       ("order_dates_text",))
def date_reformat(spark, sf):
    t = V.order_dates_text(spark, sf).select("o_orderkey", "order_date")
    return D.convert_date_format(t, "order_date", "%Y/%m/%d")


@query("weekday_name", f"""
SELECT o_orderkey, dayname(o_orderdate) AS weekday_long, strftime(o_orderdate, '%a') AS weekday_short,
       {_JA}[isodow(o_orderdate)] AS weekday_ja FROM orders""")
def weekday_name(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    o = D.add_weekday(o, "o_orderdate", "weekday_long", "long")
    o = D.add_weekday(o, "o_orderdate", "weekday_short", "short")
    o = D.add_weekday(o, "o_orderdate", "weekday_ja", "ja")
    return o.drop("o_orderdate")


@query("date_parts", """
SELECT o_orderkey, order_date,
       CAST(year(try_strptime(order_date, '%Y/%m/%d')) AS DOUBLE) AS order_date_year,
       CAST(month(try_strptime(order_date, '%Y/%m/%d')) AS DOUBLE) AS order_date_month,
       CAST(day(try_strptime(order_date, '%Y/%m/%d')) AS DOUBLE) AS order_date_day
FROM order_dates_text""", ("order_dates_text",))
def date_parts(spark, sf):
    t = V.order_dates_text(spark, sf).select("o_orderkey", "order_date")
    # parts of unparseable dates are missing: integers with gaps, as doubles
    return nullable_ints_as_double(D.add_year_month_day(t, "order_date", fmt="%Y/%m/%d"),
                                   ["order_date_year", "order_date_month", "order_date_day"])


@query("expand_date_features", """
SELECT event_id, CAST(year(ts) AS INTEGER) AS ts_year, CAST(month(ts) AS INTEGER) AS ts_month,
       CAST(day(ts) AS INTEGER) AS ts_day, CAST(isodow(ts) - 1 AS INTEGER) AS ts_dayofweek,
       CAST(hour(ts) AS INTEGER) AS ts_hour, CAST(minute(ts) AS INTEGER) AS ts_minute
FROM events""")
def expand_date_features(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", "ts")
    return D.expand_date_features(e, ["ts"], with_time=True)


@query("business_flags", """
SELECT event_id, CAST(isodow(date) AS INTEGER) AS dow,
       CASE WHEN isodow(date) >= 4 THEN 1 ELSE 0 END AS is_weekend,
       CAST(day(date) AS INTEGER) AS date_day,
       CASE WHEN day(date) >= 25 THEN 1 ELSE 0 END AS is_month_end,
       CASE WHEN time IN (11, 12, 13) THEN 1 ELSE 0 END AS is_lunch,
       CASE WHEN time >= 18 THEN 1 ELSE 0 END AS is_dinner,
       CASE WHEN time < 12 THEN 0 WHEN time < 15 THEN 1 WHEN time < 18 THEN 2 ELSE 3 END AS time_category,
       CAST(month(date) AS INTEGER) AS date_month,
       CASE WHEN month(date) IN (12, 1, 2) THEN 0 WHEN month(date) IN (3, 4, 5) THEN 1
            WHEN month(date) IN (6, 7, 8) THEN 2 ELSE 3 END AS season
FROM sales""", ("sales",))
def business_flags(spark, sf):
    s = V.sales(spark, sf).select("event_id", "date", "time")
    return D.business_flags(s, "date", "time").drop("date", "time")


def _holiday_values() -> str:
    rows = japanese_holidays(1955, 2099)
    return ", ".join(f"(DATE '{d.isoformat()}', '{n}')" for d, n in rows)


@query("holiday_flag", """
SELECT o.o_orderkey, strftime(CAST(o.o_orderdate AS DATE), '%Y-%m-%d') AS o_orderdate,
       h.d IS NOT NULL AS holiday, h.name AS holiday_name
FROM orders o LEFT JOIN (VALUES """ + _holiday_values() + """) h(d, name) ON CAST(o.o_orderdate AS DATE) = h.d""")
def holiday_flag(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return rounded(D.add_holiday_flag(o, "o_orderdate", "holiday", with_name="holiday_name")
                   .withColumn("o_orderdate", F.to_date("o_orderdate")))


@query("holiday_flag_far_dates", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN true ELSE false END AS holiday FROM orders""")
def holiday_flag_far_dates(spark, sf):
    """D3: dates beyond the calendar's rules are unknown, not plain days; a missing date is none."""
    fifth = F.pmod(F.col("o_orderkey"), F.lit(5))
    day = F.when(fifth == 0, "1900-01-01").when(fifth == 1, "2150-01-01").when(fifth == 2, "2020-01-01").when(fifth == 3, "2020-01-07")
    o = V.table(spark, sf, "orders").select("o_orderkey", day.cast("date").alias("d"))
    return D.add_holiday_flag(o, "d").select("o_orderkey", "holiday")

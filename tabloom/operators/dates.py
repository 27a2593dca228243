"""Date parsing, calendar parts, business flags and the holiday flag.

All of these are projections (no shuffle) except the holiday flag, which is a
broadcast join against the bounded holiday dimension.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.calendar import FIRST_YEAR, LAST_YEAR, holidays_table
from tabloom.functions.exprs import (
    WEEKDAY_EN, WEEKDAY_EN_SHORT, WEEKDAY_JA, date_columns, strptime_to_java, weekday_label,
)

_TS_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def parse_datetime(c: str | Column, dtype: T.DataType | None = None, fmt: str | None = None) -> Column:
    """Text or date/timestamp column -> timestamp; unparseable -> NULL.

    ``fmt`` is a strptime pattern (``%Y-%m-%d``) or a Spark pattern.
    """
    col = F.col(c) if isinstance(c, str) else c
    if dtype is not None and isinstance(dtype, _TS_TYPES):
        return col.cast("timestamp_ntz") if not isinstance(dtype, T.TimestampType) else col
    s = col.cast("string")
    if fmt:
        pat = strptime_to_java(fmt) if "%" in fmt else fmt
        return F.try_to_timestamp(s, F.lit(pat))
    return F.try_to_timestamp(s)


def _insert_after(df: DataFrame, anchor: str, new_cols: dict[str, Column], drop_anchor: bool = False) -> DataFrame:
    """Place new columns right after ``anchor`` (replacing same-named ones)."""
    cols = []
    for c in df.columns:
        if c in new_cols:
            continue
        if c == anchor:
            if not drop_anchor:
                cols.append(F.col(c))
            cols.extend(v.alias(k) for k, v in new_cols.items())
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def convert_date_format(df: DataFrame, column: str, in_fmt: str = "%Y-%m-%d", out_fmt: str = "yyyy-MM-dd",
                        errors: str = "coerce") -> DataFrame:
    """Parse with ``in_fmt`` and rewrite the column as text ``YYYY-MM-DD``.

    ``errors="coerce"``: bad values become NULL.  ``errors="unchanged"``: if any
    present value fails to parse the frame is returned as it was (one small
    counting job).  ``errors="raise"``: raise instead.
    """
    t = _types(df)
    parsed = parse_datetime(column, t[column], in_fmt)
    new = F.date_format(parsed, out_fmt)
    if errors != "coerce":
        bad = df.agg(F.sum((F.col(column).isNotNull() & parsed.isNull()).cast("bigint"))).first()[0] or 0
        if bad:
            if errors == "raise":
                raise ValueError(f"{bad} values of {column!r} do not match {in_fmt!r}")
            return df
    return df.withColumn(column, new)


def add_weekday(df: DataFrame, column: str, name: str = "曜日", style: str = "short",
                fmt: str | None = None) -> DataFrame:
    """Weekday name: ``short`` Mon..Sun, ``long`` Monday..Sunday, ``ja`` 月..日."""
    t = _types(df)
    ts = parse_datetime(column, t[column], fmt)
    labels = {"short": WEEKDAY_EN_SHORT, "long": WEEKDAY_EN, "ja": WEEKDAY_JA}[style]
    return df.withColumn(name, weekday_label(ts, labels))


def add_holiday_flag(df: DataFrame, column: str, name: str = "holiday", holidays: DataFrame | None = None,
                     with_name: str | None = None, fmt: str | None = None) -> DataFrame:
    """D3: TRUE where the date is a public holiday, FALSE where not (and for a missing date).

    A left join on the calendar date against the holiday dimension.  The
    generated one has a few thousand rows by construction, so it is broadcast
    and the input is never shuffled; its rules reach from FIRST_YEAR to
    LAST_YEAR, and dates outside get NULL.  A table of the caller's is joined as
    its size asks for, and its dates are all the holidays there are.
    """
    spark = df.sparkSession
    t = _types(df)
    if holidays is None:
        # the generated calendar has one row per date by construction
        hol = holidays_table(spark).select(F.col("date").alias("__hdate"), F.col("holiday_name").alias("__hname"))
    else:
        # a user table may repeat a date: keep one row per date so the join
        # cannot multiply input rows (a small aggregation of the dimension)
        hol = holidays.select(F.col("date").cast("date").alias("__hdate"),
                              F.col(holidays.columns[1]).alias("__hname")).dropDuplicates(["__hdate"])
    key = F.to_date(parse_datetime(column, t[column], fmt))
    known = F.lit(True)
    if holidays is None:
        hol = F.broadcast(hol)
        known = F.coalesce(F.year("__day").between(FIRST_YEAR, LAST_YEAR), F.lit(True))
    j = df.withColumn("__day", key).join(hol, F.col("__day") == F.col("__hdate"), "left")
    out = [F.col(c) for c in df.columns] + [F.when(known, F.col("__hdate").isNotNull()).alias(name)]
    if with_name:
        out.append(F.col("__hname").alias(with_name))
    return j.select(*out)


def add_year_month_day(df: DataFrame, column: str, drop: bool = False, fmt: str = "%Y-%m-%d") -> DataFrame:
    """``<col>_year/_month/_day`` inserted right after the date column."""
    t = _types(df)
    ts = parse_datetime(column, t[column], None if isinstance(t[column], _TS_TYPES) else fmt)
    new = {f"{column}_year": F.year(ts), f"{column}_month": F.month(ts), f"{column}_day": F.dayofmonth(ts)}
    return _insert_after(df, column, new, drop_anchor=drop)


def expand_date_features(df: DataFrame, columns: Sequence[str] | None = None,
                         with_time: bool = False) -> DataFrame:
    """Year, month, day, dayofweek (Mon=0) [+ hour, minute]; source dropped.

    ``columns`` defaults to the date-like columns (D14).
    """
    t = _types(df)
    cols = list(columns) if columns is not None else date_columns(df)
    new = {}
    for c in cols:
        ts = parse_datetime(c, t[c])
        new[f"{c}_year"] = F.year(ts)
        new[f"{c}_month"] = F.month(ts)
        new[f"{c}_day"] = F.dayofmonth(ts)
        new[f"{c}_dayofweek"] = F.weekday(ts)
        if with_time:
            new[f"{c}_hour"] = F.hour(ts)
            new[f"{c}_minute"] = F.minute(ts)
    return df.withColumns(new).drop(*cols)


def business_flags(df: DataFrame, date_col: str = "date", time_col: str | None = "time",
                   weekend_cut: int = 4, month_end_day: int = 25, month_col: str | None = None,
                   fmt: str | None = "%Y-%m-%d %H:%M:%S") -> DataFrame:
    """Calendar features of the sales table, added in one projection.

    * ``dow``: ISO weekday Mon=1..Sun=7 (D7)
    * ``is_weekend``: ``dow >= weekend_cut`` (D8, 4 as in the reference)
    * ``date_day`` and ``is_month_end``: day >= 25 (D9)
    * ``is_lunch`` (11-13) / ``is_dinner`` (>= 18) from the hour (D10)
    * ``time_category`` <12:0, <15:1, <18:2, else 3 (D11)
    * ``date_month`` and ``season`` 12-2:0, 3-5:1, 6-8:2, else 3 (D12); a named
      ``month_col`` that the table lacks gives no month and season 0
    Text dates are parsed with ``fmt`` (D13, strict pattern; bad -> NULL).
    """
    t = _types(df)
    ts = parse_datetime(date_col, t[date_col], fmt)
    hour = F.col(time_col) if time_col and time_col in df.columns else F.hour(ts)
    dow = F.weekday(ts) + 1
    day = F.dayofmonth(ts)
    lacks_month = month_col is not None and month_col not in df.columns
    month = F.lit(None).cast("int") if lacks_month else F.col(month_col) if month_col else F.month(ts)
    return df.withColumns({
        "dow": dow,
        "is_weekend": F.when(dow >= weekend_cut, 1).otherwise(0),
        "date_day": day,
        "is_month_end": F.when(day >= month_end_day, 1).otherwise(0),
        "is_lunch": F.when(hour.isin(11, 12, 13), 1).otherwise(0),
        "is_dinner": F.when(hour >= 18, 1).otherwise(0),
        "time_category": F.when(hour < 12, 0).when(hour < 15, 1).when(hour < 18, 2).otherwise(3),
        "date_month": month,
        "season": F.lit(0) if lacks_month else F.when(month.isin(12, 1, 2), 0).when(month.isin(3, 4, 5), 1)
                   .when(month.isin(6, 7, 8), 2).otherwise(3),
    })

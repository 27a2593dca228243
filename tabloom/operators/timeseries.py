"""Calendar-lag features of a daily series.

The reference consumes these columns by name only; the definitions here are
ours.  They operate on a series aggregated to one row per calendar day (per
``partition_by`` series), so the rows of one series are bounded by the number
of days.  Day offsets use a RANGE frame over the epoch day, which means
"calendar days", with no need to materialise a dense calendar.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _epoch_day(c: str) -> Column:
    return F.datediff(F.to_date(F.col(c)), F.lit("1970-01-01").cast("date"))


def trailing_ma(df: DataFrame, value: str, ks: Sequence[int], day: str = "day",
                partition_by: Sequence[str] = (), prefix: str | None = None) -> DataFrame:
    """``<value>_trailing_ma_<k>`` = mean over the k previous calendar days
    (the current day excluded)."""
    prefix = prefix or value
    w = Window.partitionBy(*partition_by).orderBy(_epoch_day(day))
    return df.withColumns({f"{prefix}_trailing_ma_{k}": F.avg(value).over(w.rangeBetween(-k, -1)) for k in ks})


def lagged_ma(df: DataFrame, value: str, lag: int, k: int, day: str = "day",
              partition_by: Sequence[str] = (), prefix: str | None = None) -> DataFrame:
    """``<value>_lag<lag>_ma<k>`` = mean over days [d-lag-k+1, d-lag]."""
    prefix = prefix or value
    w = Window.partitionBy(*partition_by).orderBy(_epoch_day(day)).rangeBetween(-(lag + k - 1), -lag)
    return df.withColumn(f"{prefix}_lag{lag}_ma{k}", F.avg(value).over(w))


def _prev_join(df: DataFrame, value: str, day: str, keys: Sequence[str], prev_day: Column, name: str) -> DataFrame:
    prev = df.select(F.to_date(F.col(day)).alias("__pday"), *[F.col(k).alias(f"__pk_{k}") for k in keys],
                     F.col(value).alias(name))
    cond = F.col("__target") == F.col("__pday")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__pk_{k}"))
    j = df.withColumn("__target", prev_day).join(prev, cond, "left")
    return j.select(*[F.col(c) for c in df.columns], F.col(name))


def prev_year_same_weekday(df: DataFrame, value: str, day: str = "day", keys: Sequence[str] = (),
                           name: str | None = None) -> DataFrame:
    """The value 364 days (52 weeks, same weekday) earlier, matched on ``keys`` too.

    The series must be unique per (day, keys); the lookup is an equi-join on
    the shifted day.
    """
    name = name or f"prev_year_same_weekday_{value}"
    return _prev_join(df, value, day, keys, F.date_sub(F.to_date(F.col(day)), 364), name)


def prev_year_same_date(df: DataFrame, value: str, day: str = "day", keys: Sequence[str] = (),
                        name: str | None = None) -> DataFrame:
    """The value on the same calendar date a year earlier (Feb 29 -> Feb 28)."""
    name = name or f"prev_year_same_date_{value}"
    return _prev_join(df, value, day, keys, F.add_months(F.to_date(F.col(day)), -12), name)

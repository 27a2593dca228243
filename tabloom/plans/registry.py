"""Registry of named queries: a Spark builder and (optionally) a DuckDB twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.plans.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``sql`` is the DuckDB twin over the driver tables; ``views`` are the
    derived views it needs as CTEs.  Queries without SQL get a rows-only check.
    """
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = positive_zero(with_views(sql, *views))
        return fn
    return deco


def _split_top_comma(args: str) -> tuple[str, str | None]:
    depth, quote = 0, False
    last = None
    for i, ch in enumerate(args):
        if ch == "'":
            quote = not quote
        elif not quote:
            depth += ch == "("
            depth -= ch == ")"
            if ch == "," and depth == 0:
                last = i
    if last is None:
        return args, None
    return args[:last], args[last + 1:]


def positive_zero(sql: str) -> str:
    """Rewrite every ``round(x, d)`` of a DuckDB twin as rounding of an exact decimal.

    Two engines add doubles in different orders, so the last bits of a sum or
    average differ, and a value that is a decimal tie (``...5``, common for
    averages of 2-decimal values) would round in opposite directions.  Both
    sides therefore take the value to 8 decimals first, which removes those
    bits and changes nothing else, and round the decimal half up.  Values that
    no such decimal holds are left as they are.  Adding 0.0 turns DuckDB's -0.0
    into 0.0, as Spark returns.
    """
    out, i = [], 0
    while True:
        m = re.search(r"(?<![A-Za-z_])round\(", sql[i:])
        if not m:
            out.append(sql[i:])
            return "".join(out)
        start = i + m.start()
        j, depth = i + m.end(), 1
        while depth:
            ch = sql[j]
            depth += ch == "("
            depth -= ch == ")"
            j += 1
        out.append(sql[i:start])
        x, d = _split_top_comma(sql[i + m.end():j - 1])
        x = positive_zero(x)
        out.append(f"(coalesce(CAST(round(TRY_CAST(({x}) AS DECIMAL(38, 8)), {(d or '0').strip()}) AS DOUBLE), CAST(({x}) AS DOUBLE)) + 0.0)")
        i = j


def rnd(c, digits: int = 4) -> Column:
    """Spark side of the twins' rounding: the value to 8 decimals, then half up to ``digits``."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.coalesce(F.round(c.try_cast("decimal(38,8)"), digits).cast("double"), c)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every floating column and write dates / timestamps as ISO text.

    The DuckDB twins round the same columns and format dates with
    ``strftime``, so both engines hand over identical plain values.
    """
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(rnd(f.name, digits).alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            out.append(F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_format(F.col(f.name), "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def c(name: str) -> Column:
    return F.col(name)


def nullable_ints_as_double(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Integer output columns that can hold NULL, as doubles.

    pandas (the reference's table type) stores integers with gaps as floats;
    the DuckDB twins cast the same columns, so both engines hand over the same
    values whatever way they are compared.  ``columns`` defaults to every
    integral column.
    """
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.IntegralType) and (columns is None or f.name in columns):
            out.append(F.col(f.name).cast("double").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)

"""Reusable column expressions.

Everything here builds ``Column`` objects from built-in Spark functions, so it
stays inside whole-stage code generation.  Nothing here touches data.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = [
    "NUMERIC_TEXT", "to_number", "to_long", "nan_to_null", "inf_to_null", "is_numeric_type",
    "numeric_columns", "categorical_columns", "strptime_to_java", "WEEKDAY_JA", "WEEKDAY_EN",
    "WEEKDAY_EN_SHORT", "weekday_label", "sample_skewness", "sample_kurtosis", "null_safe_true",
    "col_or_name", "is_date_like", "date_columns", "blank_to_null", "INTEGER_TEXT",
]

# A finite decimal number as text, as accepted by a lenient numeric parse.
# Spark's cast would also accept suffixes like '1d'/'1f' and DuckDB accepts
# '1_000'; the guard makes both engines agree.
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"


def col_or_name(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_numeric_type(dt: T.DataType) -> bool:
    """Numeric in the reference's sense (pandas counts bool as numeric)."""
    return isinstance(dt, (T.NumericType, T.BooleanType))


def numeric_columns(df: DataFrame, include_bool: bool = True) -> list[str]:
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType) or (include_bool and isinstance(f.dataType, T.BooleanType)):
            out.append(f.name)
    return out


def categorical_columns(df: DataFrame) -> list[str]:
    num = set(numeric_columns(df))
    return [f.name for f in df.schema.fields if f.name not in num]


def blank_to_null(c) -> Column:
    c = col_or_name(c)
    return F.when(F.trim(c) == F.lit(""), F.lit(None)).otherwise(c)


def to_number(c, dtype: T.DataType | None = None) -> Column:
    """Lenient numeric coercion (unparseable -> NULL, NaN -> NULL).

    ``dtype`` is the source column type when known; numeric sources are cast
    directly, text goes through the numeric-text guard first.
    """
    c = col_or_name(c)
    if dtype is not None and isinstance(dtype, (T.NumericType, T.BooleanType)):
        d = c.cast("double")
    else:
        s = c.cast("string")
        d = F.when(s.rlike(NUMERIC_TEXT), F.trim(s).try_cast("double"))
    return nan_to_null(d)


def to_long(c, dtype: T.DataType | None = None) -> Column:
    """Integer coercion: integral text or integral numbers; anything else NULL."""
    c = col_or_name(c)
    if dtype is not None and isinstance(dtype, T.IntegralType):
        return c.cast("bigint")
    if dtype is not None and isinstance(dtype, (T.FractionalType,)):
        d = nan_to_null(c.cast("double"))
        return F.when(d == F.floor(d), d.cast("bigint"))
    s = c.cast("string")
    return F.when(s.rlike(INTEGER_TEXT), F.trim(s).try_cast("bigint"))


def nan_to_null(c) -> Column:
    c = col_or_name(c)
    return F.when(~F.isnan(c), c)


def inf_to_null(c) -> Column:
    c = col_or_name(c)
    return F.when(F.abs(c) != F.lit(math.inf), c)


def null_safe_true(cond: Column) -> Column:
    """TRUE only where the condition is TRUE (UNKNOWN counts as FALSE)."""
    return F.coalesce(cond, F.lit(False))


# --- dates ---------------------------------------------------------------

_STRPTIME = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss",
    "%y": "yy", "%b": "MMM", "%B": "MMMM", "%a": "E", "%A": "EEEE", "%f": "SSSSSS",
    "%I": "hh", "%p": "a", "%j": "DDD", "%%": "%",
}


def strptime_to_java(fmt: str) -> str:
    """Translate a strptime pattern (``%Y-%m-%d``) to a Spark datetime pattern.

    Literal text is quoted so letters such as the Japanese 年/月/日 or ``T``
    survive.
    """
    out, i, lit = [], 0, []

    def flush():
        if lit:
            text = "".join(lit).replace("'", "''")
            out.append(f"'{text}'" if re.search(r"[A-Za-z]", text) else text)
            lit.clear()

    while i < len(fmt):
        tok = fmt[i:i + 2]
        if tok in _STRPTIME:
            flush()
            out.append(_STRPTIME[tok])
            i += 2
        elif fmt[i] == "%":
            raise ValueError(f"unsupported strptime directive {tok!r}")
        else:
            lit.append(fmt[i])
            i += 1
    flush()
    return "".join(out)


# Weekday labels, Monday first (the reference's ordered category
# and the pandas/English names).
WEEKDAY_JA = ["月", "火", "水", "木", "金", "土", "日"]
WEEKDAY_EN = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
WEEKDAY_EN_SHORT = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def weekday_label(c, labels: list[str] = WEEKDAY_JA) -> Column:
    """Label of the weekday (Monday first), from a literal array (no locale)."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.weekday(col_or_name(c)) + 1)


_DATE_NAME = re.compile(r"date|time|datetime", re.IGNORECASE)


def is_date_like(field: T.StructField) -> bool:
    """Date column rule: a date/timestamp type, or text whose name says date/time."""
    if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return True
    return isinstance(field.dataType, T.StringType) and bool(_DATE_NAME.search(field.name))


def date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_date_like(f)]


# --- moments ------------------------------------------------------------

def sample_skewness(c) -> Column:
    """Bias-corrected skewness G1 (pandas / DuckDB ``skewness``); NULL for n < 3."""
    c = col_or_name(c)
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c) -> Column:
    """Bias-corrected excess kurtosis G2 (pandas / DuckDB ``kurtosis``); NULL for n < 4."""
    c = col_or_name(c)
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))

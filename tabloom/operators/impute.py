"""Missing-value handling (I1-I12) as fit / apply.

``fit_imputer`` computes the statistics of all columns together (means in one
aggregation; medians and modes with bounded memory on any column, see
``order.quantiles`` / ``order.modes``) and returns plain values; ``Imputer.apply`` is one projection of
``coalesce(col, literal)``.  The same fitted object fills the prediction batch
(I12), so train and serve never disagree.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.exprs import nan_to_null, numeric_columns
from tabloom.operators.order import backward_fill, forward_fill, modes, quantiles

def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def _clean(c: str, t: T.DataType) -> Column:
    return nan_to_null(F.col(c)) if isinstance(t, (T.FloatType, T.DoubleType)) else F.col(c)


@dataclass
class Imputer:
    """Fitted fill values: ``{column: value}`` plus order-based fills."""
    values: dict[str, Any] = field(default_factory=dict)
    as_double: set = field(default_factory=set)
    ffill: list = field(default_factory=list)
    bfill: list = field(default_factory=list)
    order_by: list = field(default_factory=list)
    partition_by: list = field(default_factory=list)
    drop_subset: list = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        t = _types(df)
        if self.drop_subset:
            df = df.na.drop(subset=self.drop_subset)
        out = []
        for c in df.columns:
            if c in self.values:
                base = _clean(c, t[c])
                if c in self.as_double:
                    base = base.cast("double")
                v = self.values[c]
                out.append(F.coalesce(base, F.lit(v).cast(base_type(t[c], c in self.as_double))).alias(c)
                           if v is not None else base.alias(c))
            else:
                out.append(F.col(c))
        df = df.select(*out)
        if self.ffill:
            df = forward_fill(df, self.ffill, self.order_by, self.partition_by)
        if self.bfill:
            df = backward_fill(df, self.bfill, self.order_by, self.partition_by)
        return df

    def to_df(self, spark) -> DataFrame:
        return spark.createDataFrame([(k, str(v)) for k, v in self.values.items()], "column string, value string")


def base_type(t: T.DataType, as_double: bool) -> T.DataType:
    return T.DoubleType() if as_double else t


def fit_imputer(df: DataFrame, plan: dict[str, str], constants: dict[str, Any] | None = None,
                drop_missing: Sequence[str] = (), order_by: Sequence[str] = (),
                partition_by: Sequence[str] = (), exact: bool = True, accuracy: int = 100000) -> Imputer:
    """Fit ``{column: method}``.

    Methods: ``mean``, ``median`` (interpolated), ``mode`` (ties -> smallest),
    ``constant`` (from ``constants``; numeric columns need a number), ``zero``,
    ``unknown`` (text ``'Unknown'``), ``ffill`` / ``bfill`` (need ``order_by``),
    ``drop``.  Rows with missing values in ``drop_missing`` (and in ``drop``
    columns) are removed *before* the statistics are fitted (I7).
    """
    constants = constants or {}
    t = _types(df)
    num = set(numeric_columns(df))
    drop_subset = list(drop_missing) + [c for c, m in plan.items() if m == "drop"]
    base = df.na.drop(subset=drop_subset) if drop_subset else df
    keys = []
    imp = Imputer(drop_subset=drop_subset, order_by=list(order_by), partition_by=list(partition_by))
    for c, m in plan.items():
        if m in ("mean", "median") and c not in num:
            raise ValueError(f"{m} needs a numeric column: {c}")
        if m in ("mean", "median"):
            keys.append(c)
            imp.as_double.add(c)
        elif m == "mode":
            keys.append(c)
        elif m == "constant":
            v = constants[c]
            if c in num and not isinstance(v, (int, float)):
                raise ValueError(f"numeric column {c} needs a numeric constant")
            imp.values[c] = v
        elif m == "zero":
            imp.values[c] = 0
        elif m == "unknown":
            imp.values[c] = "Unknown"
        elif m == "ffill":
            imp.ffill.append(c)
        elif m == "bfill":
            imp.bfill.append(c)
        elif m == "drop":
            pass
        else:
            raise ValueError(f"unknown method {m!r}")
    if (imp.ffill or imp.bfill) and not order_by:
        raise ValueError("ffill/bfill need order_by")
    means = [c for c in keys if plan[c] == "mean"]
    medians = [c for c in keys if plan[c] == "median"]
    mode_cols = [c for c in keys if plan[c] == "mode"]
    if means:
        row = base.agg(*[F.avg(_clean(c, t[c])).alias(f"m{i}") for i, c in enumerate(means)]).first()
        imp.values.update({c: row[f"m{i}"] for i, c in enumerate(means)})
    if medians:
        qs = quantiles(base, medians, [0.5], exact, accuracy)
        imp.values.update({c: qs[c][0] for c in medians})
    if mode_cols:
        clean = base.select(*[_clean(c, t[c]).alias(c) for c in mode_cols])
        imp.values.update(modes(clean, mode_cols))
    return imp


def auto_imputer(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> Imputer:
    """Numeric columns -> median; others -> mode, or ``'Unknown'`` if there is none."""
    cols = list(columns) if columns else list(df.columns)
    num = set(numeric_columns(df, include_bool=False))
    plan = {c: ("median" if c in num else "mode") for c in cols}
    imp = fit_imputer(df, plan, exact=exact)
    for c in cols:
        if c not in num and imp.values.get(c) is None:
            imp.values[c] = "Unknown"
    return imp


def fill_zero(df: DataFrame) -> DataFrame:
    """NULL (and NaN) -> 0 in every numeric column."""
    t = _types(df)
    num = set(numeric_columns(df, include_bool=False))
    return df.select(*[F.coalesce(_clean(c, t[c]), F.lit(0).cast(t[c])).alias(c) if c in num else F.col(c)
                       for c in df.columns])


def target_sentinel(df: DataFrame, target: str, sentinel: float = -999999.0) -> DataFrame:
    """I11 (option): missing target -> sentinel, row count kept."""
    t = _types(df)
    return df.withColumn(target, F.coalesce(_clean(target, t[target]).cast("double"), F.lit(sentinel)))


def missing_indicators(df: DataFrame, columns: Sequence[str] | None = None, suffix: str = "_is_missing") -> DataFrame:
    """``<col>_is_missing`` (0/1) for each column, added before imputation.

    Spark's trees do not route missing values on their own (the reference's
    learner did), so a model fed imputed columns keeps the information that a
    value was absent through these flags.  NaN counts as missing.
    """
    t = _types(df)
    cols = list(columns) if columns else list(df.columns)
    return df.withColumns({f"{c}{suffix}": _clean(c, t[c]).isNull().cast("int") for c in cols})

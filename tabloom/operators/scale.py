"""Numeric scaling and distribution transforms (H1-H8) as fit / apply.

All statistics of all columns are fitted in one aggregation; applying is one
projection with literals.  The quantile transform (H6) interpolates against
fitted landmarks in a vectorised pandas UDF (``numpy.interp``), the one place
where a built-in expression would be a thousand-branch search.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.exprs import nan_to_null, numeric_columns
from tabloom.operators.order import quantiles

ALIASES = {"standardize": "standard", "normalize": "minmax", "robust_scale": "robust"}
BOUNDS_THRESHOLD = 1e-7  # fixed value: edge tolerance of the uniform quantile transform


def _x(c: str) -> Column:
    return nan_to_null(F.col(c).cast("double"))


@dataclass
class Scaler:
    """Fitted transform plan: ``{column: (method, params)}``."""
    plan: dict[str, tuple[str, dict[str, Any]]] = field(default_factory=dict)

    def expr(self, c: str) -> Column:
        m, p = self.plan[c]
        x = _x(c)
        if m == "standard":
            sd = p["std"] if p["std"] not in (None, 0.0) else 1.0
            return (x - F.lit(p["mean"])) / F.lit(sd)
        if m == "minmax":
            rng = (p["max"] - p["min"]) if p["max"] is not None else None
            rng = rng if rng not in (None, 0.0) else 1.0
            return (x - F.lit(p["min"])) / F.lit(rng)
        if m == "robust":
            iqr = (p["q3"] - p["q1"]) if p["q3"] is not None else None
            iqr = iqr if iqr not in (None, 0.0) else 1.0
            return (x - F.lit(p["median"])) / F.lit(iqr)
        if m == "log":
            return F.ln(x + F.lit(p["shift"])) if p["shift"] else F.ln(x)
        if m == "sqrt":
            return F.when(x >= 0, F.sqrt(x))
        if m == "quantile":
            return _quantile_udf(p["landmarks"], p["references"])(x)
        if m == "skip":
            return F.col(c)
        raise ValueError(m)

    def apply(self, df: DataFrame) -> DataFrame:
        new = {}
        out = []
        for c in df.columns:
            if c in self.plan and self.plan[c][0] != "binarize":
                out.append(self.expr(c).alias(c))
            else:
                out.append(F.col(c))
        for c, (m, p) in self.plan.items():
            if m == "binarize":
                new[f"{c}_bin"] = F.coalesce((_x(c) > F.lit(p["threshold"])).cast("int"), F.lit(0))
        return df.select(*out, *[v.alias(k) for k, v in new.items()])


def _quantile_udf(landmarks: list[float], references: list[float]):
    q = np.asarray(landmarks, dtype="float64")
    r = np.asarray(references, dtype="float64")

    @F.pandas_udf(T.DoubleType())
    def qt(x: pd.Series) -> pd.Series:
        v = x.to_numpy(dtype="float64", na_value=np.nan)
        # average of the interpolation from both sides, so tied landmarks map
        # to the middle of their reference range
        y = 0.5 * (np.interp(v, q, r) - np.interp(-v, -q[::-1], -r[::-1]))
        y = np.where(v + BOUNDS_THRESHOLD > q[-1], 1.0, y)
        y = np.where(v - BOUNDS_THRESHOLD < q[0], 0.0, y)
        y = np.where(np.isnan(v), np.nan, y)
        return pd.Series(y)

    return qt


def fit_scaler(df: DataFrame, plan: dict[str, str | dict], exact: bool = True, n_quantiles: int = 1000,
               accuracy: int = 100000) -> Scaler:
    """H1: fit ``{column: method}`` over numeric columns in one aggregation.

    Methods: ``standard`` (population std, 0 -> 1), ``minmax`` (constant -> 0),
    ``robust`` (median / IQR, 0 -> 1), ``log`` (shift 1 - min when min <= 0),
    ``sqrt``, ``quantile`` (uniform, up to 1000 landmarks, all rows used),
    ``binarize`` (``{"method": "binarize", "threshold": t}`` -> ``<col>_bin``),
    ``skip``.  Script names standardize / normalize / robust_scale map to
    standard / minmax / robust.
    """
    num = set(numeric_columns(df))
    aggs: list[Column] = []
    slots: dict[str, dict[str, int]] = {}
    methods: dict[str, tuple[str, dict]] = {}

    def slot(c, key, expr):
        slots.setdefault(c, {})[key] = len(aggs)
        aggs.append(expr.alias(f"s{len(aggs)}"))

    for c, spec in plan.items():
        m = spec if isinstance(spec, str) else spec["method"]
        m = ALIASES.get(m, m)
        if c not in num:
            raise ValueError(f"{c} is not numeric")
        extra = {} if isinstance(spec, str) else {k: v for k, v in spec.items() if k != "method"}
        methods[c] = (m, extra)
        x = _x(c)
        if m == "standard":
            slot(c, "mean", F.avg(x))
            slot(c, "std", F.stddev_pop(x))
        elif m == "minmax":
            slot(c, "min", F.min(x))
            slot(c, "max", F.max(x))
        elif m == "robust":
            slot(c, "n", F.count(x))
        elif m == "log":
            slot(c, "min", F.min(x))
        elif m == "quantile":
            slot(c, "n", F.count(x))
    row = df.agg(*aggs).first() if aggs else None

    def get(c, k):
        return row[f"s{slots[c][k]}"]

    robust = [c for c, (m, _e) in methods.items() if m == "robust"]
    rq = quantiles(df, robust, [0.25, 0.5, 0.75], exact, accuracy) if robust else {}

    # quantile landmarks need n first (n_quantiles = min(1000, n)); those of all columns are found together
    q_refs, qrow = {}, {}
    for c, (m, extra) in methods.items():
        if m == "quantile":
            n = get(c, "n") or 0
            k = max(1, min(n_quantiles, n))
            refs = [float(r) for r in np.linspace(0, 1, k)] if k > 1 else [0.0]
            q_refs[c] = refs
    for c, q in quantiles(df, list(q_refs), q_refs, exact, accuracy).items():
        qrow[c] = q if get(c, "n") else None

    out = Scaler()
    for c, (m, extra) in methods.items():
        if m == "standard":
            out.plan[c] = (m, {"mean": get(c, "mean"), "std": get(c, "std")})
        elif m == "minmax":
            out.plan[c] = (m, {"min": get(c, "min"), "max": get(c, "max")})
        elif m == "robust":
            q = rq.get(c) or [None, None, None]
            out.plan[c] = (m, {"q1": q[0], "median": q[1], "q3": q[2]})
        elif m == "log":
            mn = get(c, "min")
            out.plan[c] = (m, {"shift": (1 - mn) if mn is not None and mn <= 0 else 0.0})
        elif m == "quantile":
            lm = qrow[c] or [0.0]
            # landmarks must be non-decreasing for interpolation
            out.plan[c] = (m, {"landmarks": list(np.maximum.accumulate(np.asarray(lm, dtype=float))),
                               "references": q_refs[c]})
        elif m in ("sqrt", "skip"):
            out.plan[c] = (m, {})
        elif m == "binarize":
            out.plan[c] = (m, {"threshold": extra["threshold"]})
        else:
            raise ValueError(f"unknown method {m!r}")
    return out


def scale(df: DataFrame, plan: dict[str, str | dict], **kw) -> DataFrame:
    """Fit and apply in one call (in-sample, as the notebook does)."""
    return fit_scaler(df, plan, **kw).apply(df)

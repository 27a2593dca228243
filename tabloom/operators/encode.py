"""Categorical encoding (E1-E7) as fit / apply.

A fit is one grouped count over all its columns (unpivoted, with map-side
partial aggregation), written once to the shared checkpoint folder.  The
fitted table of a column is applied with a join, which AQE broadcasts where it
is small and splits where a value is hot; schema and result do not depend on
the number of categories.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.order import sorted_counts, value_counts
from tabloom.session import cut_lineage

class TooManyCategories(ValueError):
    pass


def _key(c: str) -> Column:
    return F.col(c).cast("string")


@dataclass
class Lookup:
    """A fitted value table for one column: ``(__key string, __val)``."""
    column: str
    table: DataFrame
    default: Any = None


def code_table(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The code table of a short, already sorted category list."""
    return df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(keys)], "__key string, __val long")


def _apply_lookups(df: DataFrame, lookups: dict[str, Lookup], names: dict[str, str],
                   replace: set[str] = frozenset(), drop: Sequence[str] = ()) -> DataFrame:
    """Add ``names[col]`` (or replace ``col``) with the looked-up value of each column."""
    joined = df
    vals: dict[str, Column] = {}
    for i, (c, lk) in enumerate(lookups.items()):
        t = lk.table.select(F.col("__key").alias(f"__k{i}"), F.col("__val").alias(f"__v{i}"))
        joined = joined.join(t, _key(c) == F.col(f"__k{i}"), "left")
        v = F.col(f"__v{i}")
        vals[c] = v if lk.default is None else F.coalesce(v, F.lit(lk.default))
    out = []
    for c in df.columns:
        if c in drop:
            continue
        out.append(vals[c].alias(c) if c in replace else F.col(c))
    for c in lookups:
        if c not in replace:
            out.append(vals[c].alias(names[c]))
    return joined.select(*out)


# --- E2 / E3 label codes -------------------------------------------------------

@dataclass
class LabelCodes:
    lookups: dict[str, Lookup] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)
    missing: str = "last"

    def apply(self, df: DataFrame, suffix: str | None = None) -> DataFrame:
        """Replace each column by its code (or add ``<col><suffix>``).

        With ``missing="last"`` missing values get code k; values never seen
        in the fit get it too.  With ``missing="null"`` both stay NULL.
        """
        names = {c: f"{c}{suffix}" for c in self.lookups} if suffix else {}
        out = _apply_lookups(df, self.lookups, names, replace=set() if suffix else set(self.lookups))
        if self.missing == "last":
            tgt = {c: (names[c] if suffix else c) for c in self.lookups}
            out = out.withColumns({tgt[c]: F.coalesce(F.col(tgt[c]), F.lit(self.sizes[c])) for c in self.lookups})
        return out


def small_category_sets(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, list[str] | None]:
    """Sorted distinct non-null text values of each column that has at most
    ``limit`` of them; ``None`` for columns with more.

    One grouped count for any number of columns, written once; exact sizes
    decide, and only the values of columns within the limit are collected.
    """
    cols = list(dict.fromkeys(columns))
    if not cols:
        return {}
    counts = cut_lineage(value_counts(df, cols, "string").select("column", "value"))
    sizes = {r["column"]: r["count"] for r in counts.groupBy("column").count().collect()}
    few = [c for c in cols if sizes.get(c, 0) <= limit]
    out: dict[str, list[str] | None] = {c: [] if c in few else None for c in cols}
    for r in counts.where(F.col("column").isin(few)).collect():
        out[r["column"]].append(r["value"])
    return {c: sorted(v) if v is not None else None for c, v in out.items()}


def fit_label_codes(df: DataFrame, columns: Sequence[str], missing: str = "last",
                    max_categories: int | None = None) -> LabelCodes:
    """E2 (``missing="last"``: missing gets code k) / E3 (``missing="null"``).

    Codes are 0..k-1 in sorted order of the text value, as bigint whatever the
    number of categories: the row numbers of the columns' value counts in range
    partitions, found for all columns at once.  ``max_categories`` (E3 uses 50)
    refuses columns with more distinct values.
    """
    out = LabelCodes(missing=missing)
    cols = list(dict.fromkeys(columns))
    if not cols:
        return out
    counts, parts = sorted_counts(value_counts(df, cols, "string"))
    before = []
    for c in cols:
        out.sizes[c] = 0
        for r in (r for r in parts if r["column"] == c):
            before.append((c, r["__block"], out.sizes[c]))
            out.sizes[c] += r["rows"]
        if max_categories is not None and out.sizes[c] > max_categories:
            raise TooManyCategories(f"{c}: more than {max_categories} categories")
    # one row per partition and column: a proven bound
    first = F.broadcast(df.sparkSession.createDataFrame(before, "column string, __block int, __before long"))
    w = Window.partitionBy("column", "__block").orderBy("value")
    codes = cut_lineage(counts.join(first, ["column", "__block"]).select(
        "column", F.col("value").alias("__key"), (F.row_number().over(w) - 1 + F.col("__before")).cast("bigint").alias("__val")))
    for c in cols:
        out.lookups[c] = Lookup(c, codes.where(F.col("column") == c).select("__key", "__val"))
    return out


def category_codes(df: DataFrame, max_distinct: int = 50) -> DataFrame:
    """E3 as used by the feature pipeline: text columns with <= 50 values -> codes
    (missing stays NULL); other text columns are dropped (F12)."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    sets = small_category_sets(df, text, max_distinct)
    keep = [c for c in text if sets[c] is not None]
    drop = [c for c in text if sets[c] is None]
    codes = LabelCodes(missing="null")
    for c in keep:
        codes.lookups[c] = Lookup(c, code_table(df, sets[c]))
        codes.sizes[c] = len(sets[c])
    return codes.apply(df.drop(*drop))


# --- E1 one-hot -----------------------------------------------------------------

@dataclass
class OneHot:
    categories: dict[str, list[str]] = field(default_factory=dict)
    drop_first: bool = True

    def apply(self, df: DataFrame) -> DataFrame:
        new = []
        for c, cats in self.categories.items():
            use = cats[1:] if self.drop_first else cats
            for v in use:
                new.append(F.coalesce(_key(c) == F.lit(v), F.lit(False)).alias(f"{c}_{v}"))
        return df.select(*[F.col(x) for x in df.columns if x not in self.categories], *new)


MAX_DUMMIES = 1000     # dummy columns that one column may become


def fit_onehot(df: DataFrame, columns: Sequence[str], drop_first: bool = True,
               max_categories: int | None = MAX_DUMMIES) -> OneHot:
    """Dummies ``<col>_<value>`` in sorted order; first dropped; source dropped.

    Every category becomes a column of the result.  The categories are counted
    first; a column with more than ``max_categories`` is an error before any
    value is collected (:func:`onehot_sparse` takes any number).
    """
    sets = small_category_sets(df, columns, MAX_DUMMIES if max_categories is None else max_categories)
    for c in columns:
        if sets[c] is None:
            raise TooManyCategories(f"{c}: more than {max_categories} categories for one-hot; use onehot_sparse")
    return OneHot({c: sets[c] for c in columns}, drop_first)


def onehot_sparse(df: DataFrame, keys: Sequence[str], columns: Sequence[str], drop_first: bool = True,
                  codes: LabelCodes | None = None) -> DataFrame:
    """E1 of any width: ``keys``, ``column``, ``code`` of each row's dummies that are 1.

    ``code`` counts the column's sorted values from 0; with ``drop_first`` value
    0 has no dummy and the others keep their codes.  Codes come from the
    distributed code table (``codes``, or fitted on ``df``), so no value is
    collected.  Missing values, and values that the fit has not seen, have no dummy.
    """
    fitted = codes or fit_label_codes(df, columns, missing="null")
    out = LabelCodes(fitted.lookups, fitted.sizes, "null").apply(df.select(*dict.fromkeys([*keys, *columns])), suffix="__code")
    items = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__code").cast("bigint").alias("code")) for c in columns]
    long = out.select(*keys, F.explode(F.array(*items)).alias("__d")).select(*keys, "__d.column", "__d.code")
    return long.where(F.col("code") >= (1 if drop_first else 0))


# --- E4 frequency, E5 target mean --------------------------------------------

@dataclass
class MapEncoder:
    lookups: dict[str, Lookup] = field(default_factory=dict)
    suffix: str = "_freq"

    def apply(self, df: DataFrame) -> DataFrame:
        return _apply_lookups(df, self.lookups, {c: f"{c}{self.suffix}" for c in self.lookups})


def fit_frequency(df: DataFrame, columns: Sequence[str]) -> MapEncoder:
    """``<col>_freq`` = share of the value among the non-null rows; one count for all columns."""
    enc = MapEncoder(suffix="_freq")
    cols = list(dict.fromkeys(columns))
    if not cols:
        return enc
    counts = cut_lineage(value_counts(df, cols, "string"))
    total = {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.sum("n").alias("n")).collect()}
    for c in cols:
        enc.lookups[c] = Lookup(c, counts.where(F.col("column") == c).select(
            F.col("value").alias("__key"), (F.col("n") / F.lit(total.get(c, 1))).alias("__val")))
    return enc


def fit_target_mean(df: DataFrame, columns: Sequence[str], target: str) -> MapEncoder:
    """E5: ``<col>_target`` = mean of the target per category (in-sample); one aggregation for all columns."""
    enc = MapEncoder(suffix="_target")
    cols = list(dict.fromkeys(columns))
    if not cols:
        return enc
    keyed = df.select(F.col(target).cast("double").alias("__y"), *[_key(c).alias(f"c{i}") for i, c in enumerate(cols)])
    means = cut_lineage(keyed.unpivot(["__y"], [f"c{i}" for i in range(len(cols))], "__c", "__key").where(F.col("__key").isNotNull())
                        .groupBy("__c", "__key").agg(F.avg("__y").alias("__val")))
    for i, c in enumerate(cols):
        enc.lookups[c] = Lookup(c, means.where(F.col("__c") == f"c{i}").select("__key", "__val"))
    return enc


def target_mean_out_of_fold(df: DataFrame, column: str, target: str, fold_col: str) -> DataFrame:
    """E5 option: out-of-fold target mean (each row sees the other folds only).

    Sums and counts per (category, fold) are combined map-side; the row's own
    fold is subtracted from the category total.
    """
    y = F.col(target).cast("double")
    per = (df.select(_key(column).alias("__key"), F.col(fold_col).alias("__fold"), y.alias("__y"))
           .groupBy("__key", "__fold").agg(F.sum("__y").alias("__s"), F.count("__y").alias("__n")))
    tot = per.groupBy("__key").agg(F.sum("__s").alias("__ts"), F.sum("__n").alias("__tn"))
    enc = per.join(tot, "__key").select(
        "__key", "__fold", F.try_divide(F.col("__ts") - F.col("__s"), F.col("__tn") - F.col("__n")).alias("__oof"))
    j = df.join(enc, (_key(column) == F.col("__key")) & (F.col(fold_col) == F.col("__fold")), "left")
    return j.select(*[F.col(c) for c in df.columns], F.col("__oof").alias(f"{column}_target"))


# --- E6 plan / E7 profile -----------------------------------------------------

@dataclass
class EncodingPlan:
    """E6, fitted: the encoders of a plan, to apply to the training table or to a new batch."""
    encoders: list = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        for e in self.encoders:
            df = e.apply(df)
        return df


def fit_encoding(df: DataFrame, plan: dict[str, dict | str]) -> EncodingPlan:
    """``{col: {"method": onehot|label|frequency|target, "target_col": ...}}``.

    Columns of one method (and target) are fitted together.  Non-categorical
    (numeric) columns are refused, as in the reference.
    """
    num = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))}
    groups: dict[tuple, list[str]] = {}
    for c, spec in plan.items():
        if c in num:
            raise ValueError(f"{c} is not categorical")
        m = spec if isinstance(spec, str) else spec.get("method", "onehot")
        groups.setdefault((m, spec["target_col"] if m == "target" else None), []).append(c)
    # frequency and target read the column that label and one-hot replace, so they are applied first
    out = EncodingPlan()
    for m in ("frequency", "target", "label", "onehot"):
        for (method, target), cols in groups.items():
            if method == m:
                out.encoders.append(fit_frequency(df, cols) if m == "frequency" else fit_target_mean(df, cols, target) if m == "target"
                                    else fit_label_codes(df, cols) if m == "label" else fit_onehot(df, cols))
    unknown = [m for m, _ in groups if m not in ("frequency", "target", "label", "onehot")]
    if unknown:
        raise ValueError(unknown[0])
    return out


def encode(df: DataFrame, plan: dict[str, dict | str]) -> DataFrame:
    """E6 in one call: fit the plan and apply it to the same table."""
    return fit_encoding(df, plan).apply(df)


def category_profile(df: DataFrame, column: str, top_n: int = 5) -> DataFrame:
    """Unique count, missing count and the top values of a category column."""
    from tabloom.operators.profile import frequency_ranking
    miss = df.agg(F.sum(F.col(column).isNull().cast("bigint")).alias("missing"))
    return frequency_ranking(df, column, top_n).crossJoin(F.broadcast(miss))

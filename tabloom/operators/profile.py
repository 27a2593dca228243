"""Profiling, statistics, rankings, histograms and sales summaries.

Design rules: counts, sums and moments of all columns are one
code-generated aggregation (partial aggregates combined map-side, so the
shuffle carries one small row per partition); quantiles and modes go through
``order.quantiles`` / ``order.modes``, which keep memory bounded on any column;
rankings are computed only on already aggregated results; histograms bin
with an expression and aggregate, so no raw row ever leaves its partition.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.exprs import (
    nan_to_null,
    WEEKDAY_JA, numeric_columns, sample_kurtosis, sample_skewness,
)
from tabloom.operators.clean import filter_rows_by_search, valid_sales
from tabloom.operators.columns import column_counts, pair_grids
from tabloom.operators.order import quantiles, rank_small


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def _long(row: DataFrame, items: list[tuple[str, list[tuple[str, Column]]]]) -> DataFrame:
    """Turn one wide aggregate row into one row per column (a small ``explode``)."""
    structs = [F.struct(F.lit(name).alias("column"), *[c.alias(k) for k, c in fields]) for name, fields in items]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def _is_missing(df: DataFrame, c: str) -> Column:
    """NULL, or NaN in a floating column."""
    x = F.col(c)
    return x.isNull() | F.isnan(x) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else x.isNull()


def _finite(c) -> Column:
    """The value as a double; missing where it is NULL, NaN or infinite."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


# --- P1 / P8 / I1 ------------------------------------------------------------

def column_classes(df: DataFrame) -> DataFrame:
    """Per column its type, class (numeric / categorical) and missing count."""
    num = set(numeric_columns(df))
    t = _types(df)
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.sum(_is_missing(df, c).cast("bigint")).alias(f"__m{i}") for i, c in enumerate(df.columns)])
    items = [(c, [("dtype", F.lit(t[c].simpleString())),
                  ("column_class", F.lit("numeric" if c in num else "categorical")),
                  ("missing", F.coalesce(F.col(f"__m{i}"), F.lit(0))),
                  ("has_missing", F.coalesce(F.col(f"__m{i}"), F.lit(0)) > 0),
                  ("n_rows", F.col("__n"))]) for i, c in enumerate(df.columns)]
    return _long(row, items)


def missing_report(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """Missing count and percent per column (NaN counts as missing).

    ``only_missing`` keeps just the columns that have missing values, as the
    reference's listing does.
    """
    t = _types(df)
    num = set(numeric_columns(df))

    def miss(c):
        m = F.col(c).isNull()
        if isinstance(t[c], (T.FloatType, T.DoubleType)):
            m = m | F.isnan(c)
        return m

    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.sum(miss(c).cast("bigint")).alias(f"__m{i}") for i, c in enumerate(df.columns)])
    items = []
    for i, c in enumerate(df.columns):
        m = F.coalesce(F.col(f"__m{i}"), F.lit(0))
        items.append((c, [("missing", m),
                          ("missing_pct", F.when(F.col("__n") > 0, m * 100.0 / F.col("__n"))),
                          ("column_class", F.lit("numeric" if c in num else "categorical"))]))
    out = _long(row, items)
    return out.where(F.col("missing") > 0) if only_missing else out


def overview(df: DataFrame, columns: Sequence[str] | None = None, head: int = 5) -> tuple[DataFrame, DataFrame]:
    """(class summary, first ``head`` rows of the chosen columns).

    The summary has one row: rows, columns, numeric / categorical / with-missing
    column counts (one aggregation).  The head is a ``limit`` -- the preview
    itself is the feature.
    """
    cols = list(columns) if columns else list(df.columns)
    sub = df.select(*cols)
    num = set(numeric_columns(sub))
    row = sub.agg(F.count(F.lit(1)).alias("n_rows"),
                  *[F.max(_is_missing(sub, c).cast("int")).alias(f"__m{i}") for i, c in enumerate(cols)])
    summary = row.select(
        "n_rows", F.lit(len(cols)).alias("n_columns"),
        F.lit(sum(1 for c in cols if c in num)).alias("n_numeric"),
        F.lit(sum(1 for c in cols if c not in num)).alias("n_categorical"),
        sum((F.coalesce(F.col(f"__m{i}"), F.lit(0)) for i in range(len(cols))), F.lit(0)).alias("n_with_missing"))
    return summary, sub.limit(head)


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct (non-null) and non-null counts of the categorical columns."""
    num = set(numeric_columns(df))
    cols = list(columns) if columns else [c for c in df.columns if c not in num]
    if not approx:
        return column_counts(df, cols).select("column", F.col("n_distinct").alias("n_unique"), (F.col("n_rows") - F.col("nulls")).alias("n_non_null"))
    row = df.agg(*[F.approx_count_distinct(F.col(c)).alias(f"__d{i}") for i, c in enumerate(cols)],
                 *[F.count(F.col(c)).alias(f"__c{i}") for i, c in enumerate(cols)])
    return _long(row, [(c, [("n_unique", F.col(f"__d{i}")), ("n_non_null", F.col(f"__c{i}"))])
                       for i, c in enumerate(cols)])


# --- P2 / P3 / P7 / H7 ---------------------------------------------------------

def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True,
                  accuracy: int = 100000) -> DataFrame:
    """Count, mean, median, std, var (ddof 1), min, max, range, q1, q3, IQR,
    skewness and excess kurtosis (bias-corrected) of each numeric column.

    Moments of all columns in one code-generated aggregation; quartiles by
    :func:`tabloom.operators.order.quantiles` (exact by default, bounded
    memory on any column; ``exact=False`` uses ``percentile_approx``).
    """
    t = _types(df)
    cols = list(columns) if columns else numeric_columns(df, include_bool=False)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        x = F.when(~F.isnan(x), x)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                 F.var_samp(x).alias(f"var{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
                 sample_skewness(x).alias(f"sk{i}"), sample_kurtosis(x).alias(f"ku{i}")]
    del t
    qs = quantiles(df, cols, [0.25, 0.5, 0.75], exact, accuracy)
    row = df.agg(*aggs)
    items = []
    for i, c in enumerate(cols):
        q = F.array(*[F.lit(v).cast("double") for v in qs[c]])
        items.append((c, [
            ("count", F.col(f"n{i}")), ("mean", F.col(f"mean{i}")), ("median", q[1]),
            ("std", F.col(f"std{i}")), ("var", F.col(f"var{i}")), ("min", F.col(f"min{i}")),
            ("max", F.col(f"max{i}")), ("range", F.col(f"max{i}") - F.col(f"min{i}")),
            ("q1", q[0]), ("q3", q[2]), ("iqr", q[2] - q[0]),
            ("skewness", F.col(f"sk{i}")), ("kurtosis", F.col(f"ku{i}")),
        ]))
    return _long(row, items)


def pre_transform_profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """H7: min, max, mean, median, std, skewness and missing per numeric column,
    with ``nonpositive_min`` flagging columns a log transform would need to shift."""
    cols = list(columns) if columns else numeric_columns(df, include_bool=False)
    st = numeric_stats(df, cols, exact=exact)
    miss = missing_report(df.select(*cols)).select("column", "missing")
    return (st.join(miss, "column")
            .select("column", "min", "max", "mean", "median", "std", "skewness", "missing",
                    skew_label(F.col("skewness")).alias("skew"), (F.col("min") <= 0).alias("nonpositive_min")))


def skew_label(skew: Column) -> Column:
    """> 1 right-skewed, < -1 left-skewed, else near normal."""
    return F.when(skew > 1, "right").when(skew < -1, "left").otherwise("normal")


def describe_all(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Pandas ``describe(include='all')`` as one row per column.

    Numeric columns fill count/mean/std/min/q25/q50/q75/max; text columns fill
    count/unique/top/freq (top = most frequent, ties -> smallest value).
    Numeric statistics are one aggregation; the text top values are one
    grouped count over all text columns at once (stacked, combined map-side).
    """
    cols = list(columns) if columns else list(df.columns)
    num = [c for c in cols if c in set(numeric_columns(df, include_bool=False))]
    txt = [c for c in cols if c not in num]
    parts = []
    if num:
        aggs = []
        for i, c in enumerate(num):
            x = F.col(c).cast("double")
            x = F.when(~F.isnan(x), x)
            aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                     F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        qs = quantiles(df, num, [0.25, 0.5, 0.75], exact)
        row = df.agg(*aggs)
        parts.append(_long(row, [(c, [
            ("count", F.col(f"n{i}")), ("mean", F.col(f"m{i}")), ("std", F.col(f"s{i}")),
            ("min", F.col(f"lo{i}")), ("q25", F.lit(qs[c][0]).cast("double")),
            ("q50", F.lit(qs[c][1]).cast("double")), ("q75", F.lit(qs[c][2]).cast("double")),
            ("max", F.col(f"hi{i}")),
            ("unique", F.lit(None).cast("bigint")), ("top", F.lit(None).cast("string")),
            ("freq", F.lit(None).cast("bigint"))]) for i, c in enumerate(num)]))
    if txt:
        stacked = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in txt])).alias("r")) \
            .select("r.*").where(F.col("value").isNotNull())
        counts = stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        summ = counts.groupBy("column").agg(
            F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
            F.min_by(F.col("value"), F.struct(-F.col("n"), F.col("value"))).alias("top"),
            F.max("n").alias("freq"))
        allc = df.sparkSession.createDataFrame([(c,) for c in txt], "column string")
        summ = allc.join(summ, "column", "left")
        parts.append(summ.select(
            "column", F.coalesce(F.col("count"), F.lit(0)).alias("count"),
            *[F.lit(None).cast("double").alias(k) for k in ("mean", "std", "min", "q25", "q50", "q75", "max")],
            F.coalesce(F.col("unique"), F.lit(0)).alias("unique"), "top", "freq"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- P4 / P5 / P6 / P9 -------------------------------------------------------

def frequency_ranking(df: DataFrame, column: str, top_n: int = 10, include_missing: bool = False) -> DataFrame:
    """Rank, value, count, percent of the ``top_n`` most frequent values.

    Also carries ``n_unique`` and ``n_other`` (values outside the top).  Ties:
    smaller value first.  ``include_missing`` counts NULL as a value
    (package behaviour); otherwise NULLs are left out (notebook).
    """
    v = F.col(column).cast("string")
    base = df.select(v.alias("value"))
    if not include_missing:
        base = base.where(F.col("value").isNotNull())
    counts = base.groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    tot = counts.agg(F.sum("count").alias("__total"), F.count(F.lit(1)).alias("n_unique"))
    top = counts.orderBy(F.desc("count"), F.asc_nulls_last("value")).limit(top_n)
    ranked = rank_small(top, [F.desc("count"), F.asc_nulls_last("value")], "rank")
    return (ranked.crossJoin(F.broadcast(tot))  # tot is one row
            .select("rank", "value", "count",
                    (F.col("count") * 100.0 / F.col("__total")).alias("percent"),
                    "n_unique", F.greatest(F.col("n_unique") - F.lit(top_n), F.lit(0)).alias("n_other")))


def column_summary(df: DataFrame, column: str) -> DataFrame:
    """P5 header: total rows, missing count and rate, and the analysis type
    (``numeric`` / ``categorical``, or ``empty`` when every value is missing)."""
    kind = "numeric" if column in numeric_columns(df, include_bool=False) else "categorical"
    t = _types(df)[column]
    miss = F.col(column).isNull()
    if isinstance(t, (T.FloatType, T.DoubleType)):
        miss = miss | F.isnan(column)
    r = df.agg(F.count(F.lit(1)).alias("total"), F.sum(miss.cast("bigint")).alias("missing"))
    return r.select(F.lit(column).alias("column"), "total", F.coalesce("missing", F.lit(0)).alias("missing"),
                    F.when(F.col("total") > 0, F.col("missing") * 100.0 / F.col("total")).alias("missing_rate"),
                    F.when(F.coalesce(F.col("missing"), F.lit(0)) == F.col("total"), "empty")
                    .otherwise(kind).alias("analysis_type"))


def analyze_column(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """P5: numeric statistics or a frequency ranking by column class (see
    :func:`column_summary` for the total / missing / empty header)."""
    if column in numeric_columns(df, include_bool=False):
        return numeric_stats(df, [column])
    return frequency_ranking(df, column, top_n)


def search_then_analyze(df: DataFrame, search_col: str, word: str, column: str) -> DataFrame:
    """F2 then P5."""
    return analyze_column(filter_rows_by_search(df, search_col, word), column)


def chart_data(df: DataFrame, column: str, max_distinct: int = 20, bins: int = 30, top: int = 20) -> DataFrame:
    """Data of the per-column chart.

    <= 20 distinct values (missing ones not counted): counts per value; numeric
    with more: a 30-bin histogram; text with more: the top 20 values.  The
    check is exact: distinct values, of which at most 21 are looked at.
    """
    n = df.where(~_is_missing(df, column)).select(column).distinct().limit(max_distinct + 1).count()
    if n <= max_distinct:
        return (df.where(~_is_missing(df, column)).groupBy(F.col(column).cast("string").alias("value"))
                .agg(F.count(F.lit(1)).alias("count")).where(F.col("value").isNotNull()))
    if column in numeric_columns(df, include_bool=False):
        return histogram(df, column, bins)
    return frequency_ranking(df, column, top)


# --- P10 / P11 / P12 -----------------------------------------------------------

def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    width = (hi - lo) / F.lit(bins)
    return F.least(F.floor((x - lo) / width).cast("int"), F.lit(bins - 1))


def _range(df: DataFrame, column: str) -> DataFrame:
    x = _finite(column)
    r = df.agg(F.min(x).alias("__lo0"), F.max(x).alias("__hi0"))
    return r.select(
        F.when(F.col("__lo0") == F.col("__hi0"), F.col("__lo0") - 0.5).otherwise(F.col("__lo0")).alias("__lo"),
        F.when(F.col("__lo0") == F.col("__hi0"), F.col("__hi0") + 0.5).otherwise(F.col("__hi0")).alias("__hi"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """P10: equal-width bins over [min, max], last bin closed (numpy rules).

    Output: bin, lower, upper, count for all ``bins`` bins (empty bins 0).
    Missing, NaN and infinite values are left out.
    """
    spark = df.sparkSession
    rng = _range(df, column)  # one row
    binned = (df.select(_finite(column).alias("__x")).where(F.col("__x").isNotNull())
              .crossJoin(F.broadcast(rng))
              .select(_bin(F.col("__x"), F.col("__lo"), F.col("__hi"), bins).alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(rng))
    w = (F.col("__hi") - F.col("__lo")) / F.lit(bins)
    return (grid.join(binned, "bin", "left")
            .select("bin", (F.col("__lo") + F.col("bin") * w).alias("lower"),
                    (F.col("__lo") + (F.col("bin") + 1) * w).alias("upper"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Non-empty cells of the 2-D grid after dropping missing pairs."""
    pairs = df.select(_finite(x).alias("__x"), _finite(y).alias("__y")).where(F.col("__x").isNotNull() & F.col("__y").isNotNull())
    rng = pairs.agg(F.min("__x").alias("a0"), F.max("__x").alias("b0"),
                    F.min("__y").alias("c0"), F.max("__y").alias("d0")).select(
        F.when(F.col("a0") == F.col("b0"), F.col("a0") - 0.5).otherwise(F.col("a0")).alias("__xlo"),
        F.when(F.col("a0") == F.col("b0"), F.col("b0") + 0.5).otherwise(F.col("b0")).alias("__xhi"),
        F.when(F.col("c0") == F.col("d0"), F.col("c0") - 0.5).otherwise(F.col("c0")).alias("__ylo"),
        F.when(F.col("c0") == F.col("d0"), F.col("d0") + 0.5).otherwise(F.col("d0")).alias("__yhi"))
    cells = (pairs.crossJoin(F.broadcast(rng))
             .select(_bin(F.col("__x"), F.col("__xlo"), F.col("__xhi"), bins).alias("bx"),
                     _bin(F.col("__y"), F.col("__ylo"), F.col("__yhi"), bins).alias("by"))
             .groupBy("bx", "by").agg(F.count(F.lit(1)).alias("count")))
    xw = (F.col("__xhi") - F.col("__xlo")) / F.lit(bins)
    yw = (F.col("__yhi") - F.col("__ylo")) / F.lit(bins)
    return cells.crossJoin(F.broadcast(rng)).select(
        F.lit(x).alias("x_col"), F.lit(y).alias("y_col"), "bx", "by", "count",
        (F.col("__xlo") + F.col("bx") * xw).alias("x_lower"), (F.col("__xlo") + (F.col("bx") + 1) * xw).alias("x_upper"),
        (F.col("__ylo") + F.col("by") * yw).alias("y_lower"), (F.col("__ylo") + (F.col("by") + 1) * yw).alias("y_upper"))


def histogram_2d_pairs(df: DataFrame, xs: Sequence[str], ys: Sequence[str], bins: int = 20) -> DataFrame:
    """P11 over every x-by-y combination of two column lists (x = y skipped), in two scans."""
    return pair_grids(df, [(a, b) for a in xs for b in ys if a != b], bins)


def top_cells(hist2d: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most frequent non-empty cells with centres and ranges."""
    top = hist2d.where(F.col("count") > 0).orderBy(F.desc("count"), "x_col", "y_col", "bx", "by").limit(k)
    return rank_small(top, [F.desc("count"), F.col("x_col"), F.col("y_col"), F.col("bx"), F.col("by")]).select(
        "rank", "x_col", "y_col", "bx", "by", "count",
        ((F.col("x_lower") + F.col("x_upper")) / 2).alias("x_center"),
        ((F.col("y_lower") + F.col("y_upper")) / 2).alias("y_center"),
        "x_lower", "x_upper", "y_lower", "y_upper")


def scatter_data(df: DataFrame, x: str, y: str, seed: int = 42, fraction: float | None = None,
                 jitter: float = 0.3, key: str | Sequence[str] | None = None) -> DataFrame:
    """(x, y) pairs; a text axis becomes sorted codes with uniform jitter.

    Codes come from the label encoder (sorted distinct values).  ``fraction``
    samples the points (the chart's own sampling).  Jitter and sample are drawn
    from the row's ``key`` (all plain columns by default) and ``seed``, so they
    do not follow the partitioning; rows with one key are drawn alike.
    """
    from tabloom.operators.encode import fit_label_codes
    from tabloom.operators.modeling import uniform_from_key

    own = [key] if isinstance(key, str) else list(key or [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)])
    draws = {f"__u{i}": uniform_from_key(own, seed, f"jitter {c}") for i, c in enumerate((x, y))}
    base = df.withColumns(draws).withColumn("__take", uniform_from_key(own, seed, "sample"))
    if fraction is not None:
        base = base.where(F.col("__take") < fraction)
    base = base.select(*dict.fromkeys((x, y)), *draws)
    num = set(numeric_columns(df, include_bool=False))
    out = {}
    for i, c in enumerate((x, y)):
        if c in num:
            out[i] = F.col(c).cast("double")
        else:
            codes = fit_label_codes(df, [c])
            base = codes.apply(base, suffix=f"__code{i}")
            jit = (F.col(f"__u{i}") * 2 - 1) * jitter if codes.sizes[c] > 1 else F.lit(0.0)
            out[i] = F.col(f"{c}__code{i}").cast("double") + jit
    return base.select(out[0].alias("x"), out[1].alias("y"))


# --- P14-P16 sales summaries -------------------------------------------------

def _avg_spend(s: Column, c: Column) -> Column:
    return F.bround(F.try_divide(s, c), 0).cast("bigint")


def sales_totals(df: DataFrame, sales: str = "sales", customers: str = "customer_count") -> DataFrame:
    """Total sales, total customers, average spend (half-even; 0 without customers)."""
    v = valid_sales(df, sales, customers)
    r = v.agg(F.sum(sales).alias("total_sales"), F.sum(customers).alias("total_customers"))
    return r.select(
        F.coalesce(F.col("total_sales"), F.lit(0.0)).alias("total_sales"),
        F.coalesce(F.col("total_customers"), F.lit(0)).alias("total_customers"),
        F.when(F.col("total_customers") > 0, _avg_spend(F.col("total_sales"), F.col("total_customers")))
        .otherwise(F.lit(0).cast("bigint")).alias("avg_spend"))


def sales_by_weekday(df: DataFrame, dow: str = "dow", sales: str = "sales", customers: str = "customer_count",
                     labels: Sequence[str] = WEEKDAY_JA) -> DataFrame:
    """Sales, customers and average spend per weekday, ranked by sales.

    Labels outside ``labels`` are left out; weekdays without data are absent.
    """
    v = valid_sales(df, sales, customers).where(F.col(dow).isin(*labels))
    g = v.groupBy(dow).agg(F.sum(sales).alias("sales"), F.sum(customers).alias("customers"))
    g = g.withColumn("avg_spend", _avg_spend(F.col("sales"), F.col("customers")))
    return rank_small(g, [F.desc("sales"), F.col(dow)], "rank")


def sales_by_hour(df: DataFrame, time: str = "time", sales: str = "sales", customers: str = "customer_count",
                  top_n: int = 10) -> DataFrame:
    """The ``top_n`` hours by sales with rank, customers and average spend."""
    v = valid_sales(df, sales, customers).where(F.col(time).isNotNull())
    g = v.groupBy(time).agg(F.sum(sales).alias("sales"), F.sum(customers).alias("customers"))
    g = g.withColumn("avg_spend", _avg_spend(F.col("sales"), F.col("customers")))
    top = g.orderBy(F.desc("sales"), F.col(time)).limit(top_n)
    return rank_small(top, [F.desc("sales"), F.col(time)], "rank")


# --- P17 / P18 / P19 ---------------------------------------------------------

def target_profile(df: DataFrame, target: str) -> DataFrame:
    """Mean, std, min, max and missing count of the target (NaN is missing)."""
    x = nan_to_null(F.col(target).cast("double"))
    return df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
                  F.max(x).alias("max"), F.sum(x.isNull().cast("bigint")).alias("missing"))


def prediction_summary(df: DataFrame, column: str = "prediction", ddof: int = 1) -> DataFrame:
    """Count, mean, min, max, std (ddof 1 sample, ddof 0 population)."""
    x = nan_to_null(F.col(column).cast("double"))
    std = F.stddev_samp(x) if ddof == 1 else F.stddev_pop(x)
    return df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.min(x).alias("min"),
                  F.max(x).alias("max"), std.alias("std"))


def row_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before, after and removed as a one-row metrics frame."""
    b = before.agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.agg(F.count(F.lit(1)).alias("rows_after"))
    return b.crossJoin(a).withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))

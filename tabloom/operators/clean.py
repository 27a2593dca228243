"""Row and column cleaning, text replacement, arithmetic and type conversion.

Covers the filter (F*), text (T*) and arithmetic/conversion (A1-A6, A8)
operators.  All of them are narrow transformations (no shuffle) except the
duplicate removal (one aggregation with map-side partial combine) and the
unmapped-value report (a distinct + anti join).
"""

from __future__ import annotations

import logging
from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.exprs import (
    inf_to_null, nan_to_null, null_safe_true, numeric_columns, to_long, to_number,
)

log = logging.getLogger(__name__)


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


# --- F: projections, filters, predicates -----------------------------------

def _match(c: Column, word: str, regex: bool, case_sensitive: bool) -> Column:
    s = c.cast("string")
    if not case_sensitive:
        s = F.lower(s)
        word = word.lower()
    if regex:
        return s.rlike(word)
    return F.contains(s, F.lit(word))


def remove_rows_by_keyword(df: DataFrame, word: str, columns: Sequence[str] | None = None,
                           regex: bool = True, case_sensitive: bool = True) -> DataFrame:
    """drop rows whose column (or any column) contains ``word``.

    Columns are stringified; ``word`` is a (Java) regular expression unless
    ``regex=False``.  A missing cell never matches.
    """
    cols = list(columns) if columns else list(df.columns)
    hit = reduce(lambda a, b: a | b, [null_safe_true(_match(F.col(c), word, regex, case_sensitive)) for c in cols])
    return df.filter(~hit)


def filter_rows_by_search(df: DataFrame, column: str, word: str, case_sensitive: bool = False,
                          regex: bool = True) -> DataFrame:
    """keep rows whose column matches ``word`` (case-insensitive by default)."""
    return df.filter(null_safe_true(_match(F.col(column), word, regex, case_sensitive)))


def delete_rows_where(df: DataFrame, condition: str | Column) -> DataFrame:
    """Delete rows where the condition is TRUE; UNKNOWN keeps the row."""
    cond = F.expr(condition) if isinstance(condition, str) else condition
    return df.filter(~null_safe_true(cond))


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None,
                    order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """keep the first row of each duplicate group.

    Whole-row duplicates (empty ``subset``) are an aggregation.  With a subset
    the first row by ``order_by`` is chosen with ``min`` over a struct, an
    aggregate with a map-side partial step, so a key holding a large share of
    the rows is pre-reduced on every partition before the shuffle instead of
    being sorted in one task (as a ``row_number`` window would be).
    """
    if not subset:
        return df.dropDuplicates()
    subset = list(subset)
    rest = [c for c in df.columns if c not in subset]
    if not rest:
        return df.dropDuplicates(subset)
    order = [F.col(c) if isinstance(c, str) else c for c in (order_by or rest)]
    # min over a struct that starts with the ordering and ends with the row:
    # the first row by ``order_by``, ties broken by the remaining columns, so
    # the pick is deterministic whatever the partitioning.
    key = F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], *[F.col(c) for c in rest])
    picked = df.groupBy(*subset).agg(F.min(key).alias("__row"))
    return picked.select(*[F.col(c) for c in subset], *[F.col(f"__row.{c}").alias(c) for c in rest]) \
        .select(*df.columns)


def drop_columns(df: DataFrame, names: Iterable[str], missing: str = "warn") -> DataFrame:
    """drop columns; unknown names warn (notebook) or raise (package)."""
    names = list(names)
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        if missing == "error":
            raise KeyError(f"columns not found: {unknown}")
        log.warning("columns not found, skipped: %s", unknown)
    return df.drop(*[n for n in names if n in df.columns])


def keep_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """keep only the given columns (complement of F5)."""
    return df.select(*names)


def select_available(df: DataFrame, features: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """keep the listed columns that exist; return the missing names too."""
    feats = list(features)
    present = [c for c in feats if c in df.columns]
    return df.select(*present), [c for c in feats if c not in df.columns]


def validate_columns(df: DataFrame, names: Iterable[str], all_or_nothing: bool = False) -> list[str]:
    """F8: names missing from the schema (metadata only, no job).

    ``all_or_nothing`` mirrors the feature check that returns an empty list
    as soon as anything is missing: then the *usable* list is returned.
    """
    names = list(names)
    missing = [n for n in names if n not in df.columns]
    if all_or_nothing:
        return [] if missing else names
    return missing


def valid_sales(df: DataFrame, sales: str = "sales", customers: str = "customer_count") -> DataFrame:
    """numeric coercion of sales and customer count, then both > 0."""
    t = _types(df)

    def coerce(name):
        # integral columns stay integral (a count of customers stays a count)
        if isinstance(t.get(name), T.IntegralType):
            return F.col(name).cast("bigint")
        return to_number(name, t.get(name))

    out = df.withColumns({sales: coerce(sales), customers: coerce(customers)})
    return out.filter((F.col(sales) > 0) & (F.col(customers) > 0))


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    """remove rows whose target is missing (NULL or NaN)."""
    t = _types(df)[target]
    cond = F.col(target).isNotNull()
    if isinstance(t, (T.FloatType, T.DoubleType)):
        cond = cond & ~F.isnan(target)
    return df.filter(cond)


def numeric_only(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """drop non-numeric columns (except ``keep``)."""
    num = set(numeric_columns(df))
    return df.select(*[c for c in df.columns if c in num or c in keep])


def inf_to_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """+-inf (and NaN) become NULL in floating columns."""
    t = _types(df)
    cols = [c for c in (columns or df.columns) if isinstance(t[c], (T.FloatType, T.DoubleType))]
    return df.withColumns({c: nan_to_null(inf_to_null(c)) for c in cols})


# --- T: text -------------------------------------------------------------

def stringify(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns as text (NULL stays NULL; 5.0 prints as ``5.0``)."""
    cols = set(columns) if columns else set(df.columns)
    return df.select(*[F.col(c).cast("string").alias(c) if c in cols else F.col(c) for c in df.columns])


def replace_text(df: DataFrame, find: str, repl: str, columns: Sequence[str] | None = None,
                 rows: str | Column | None = None) -> DataFrame:
    """Literal replacement in the chosen columns (default all).

    Touched columns become strings (T2 stringify, NULL stays NULL).  ``rows``
    is an optional predicate restricting the rows that are changed; it
    replaces the reference's row positions, which have no meaning on a
    distributed table.
    """
    cols = list(columns) if columns else list(df.columns)
    cond = None if rows is None else (F.expr(rows) if isinstance(rows, str) else rows)
    out = {}
    for c in cols:
        s = F.col(c).cast("string")
        r = F.replace(s, F.lit(find), F.lit(repl))
        out[c] = r if cond is None else F.when(null_safe_true(cond), r).otherwise(s)
    return df.withColumns(out)


def replace_text_counts(df: DataFrame, find: str, repl: str, columns: Sequence[str] | None = None,
                        rows: str | Column | None = None) -> DataFrame:
    """T1 report: number of changed cells per column, in one aggregation."""
    cols = list(columns) if columns else list(df.columns)
    # A cell changes iff its text contains ``find`` (and its row is selected),
    # so the count needs no second copy of the table.
    cond = None if rows is None else (F.expr(rows) if isinstance(rows, str) else rows)
    aggs = []
    for c in cols:
        hit = F.contains(F.col(c).cast("string"), F.lit(find)) & F.lit(find != repl and find != "")
        if cond is not None:
            hit = hit & null_safe_true(cond)
        aggs.append(F.sum(null_safe_true(hit).cast("bigint")).alias(c))
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias("changed_cells")) for c in cols
    ])).alias("r")).select("r.*")


def map_column(df: DataFrame, ref: str, mapping_from: Sequence, mapping_to: Sequence, new: str,
               default=None, overwrite: bool = False) -> DataFrame:
    """Map the text of ``ref`` through a value table into ``new``.

    ``new`` is placed right after ``ref``.  The pairs become a small table that
    is joined by hash (:func:`map_column_join`), so a row costs one lookup
    however many there are; of repeated keys the last pair counts.  Whole
    numbers beside fractions become fractions, other mixed values text.
    """
    if len(mapping_from) != len(mapping_to):
        raise ValueError("mapping lists must have the same length")
    if new in df.columns and not overwrite:
        raise ValueError(f"column {new!r} exists; pass overwrite=True")
    pairs = {str(k): v for k, v in zip(mapping_from, mapping_to)}
    kinds = {type(v) for v in pairs.values() if v is not None} or {type(default) if default is not None else str}
    if len(kinds) > 1:
        to = float if kinds <= {int, float} else str
        pairs = {k: None if v is None else to(v) for k, v in pairs.items()}
        kinds = {to}
    kind = kinds.pop()
    value_type = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}.get(kind)
    spark = df.sparkSession
    if value_type is None:       # dates, decimals and the like: Spark finds the type
        mapping = spark.createDataFrame(list(pairs.items()), ["key", "value"])
    else:
        mapping = spark.createDataFrame(list(pairs.items()), T.StructType([T.StructField("key", T.StringType()), T.StructField("value", value_type)]))
    return map_column_join(df, ref, mapping, new, default)


def map_column_join(df: DataFrame, ref: str, mapping: DataFrame, new: str, default=None) -> DataFrame:
    """T3 for large mapping tables: a left join on the text key.

    ``mapping`` has columns (``key``, ``value``).  AQE turns it into a
    broadcast join at run time when the mapping is small, otherwise the join
    shuffles both sides.
    """
    m = mapping.select(F.col("key").cast("string").alias("__k"), F.col("value").alias("__v")) \
        .dropDuplicates(["__k"])
    j = df.join(m, F.col(ref).cast("string") == F.col("__k"), "left")
    val = F.col("__v") if default is None else F.coalesce(F.col("__v"), F.lit(default))
    cols = []
    for c in df.columns:
        if c == new:
            continue
        cols.append(F.col(c))
        if c == ref:
            cols.append(val.alias(new))
    return j.select(*cols)


def unmapped_values(df: DataFrame, ref: str, mapping_from: Sequence) -> DataFrame:
    """T4: distinct non-missing values of ``ref`` absent from the mapping."""
    spark = df.sparkSession
    keys = spark.createDataFrame([(str(k),) for k in mapping_from], "key string")
    vals = df.select(F.col(ref).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
    return vals.join(keys, vals.value == keys.key, "left_anti")


# --- A: arithmetic, conversion -------------------------------------------

def arithmetic(df: DataFrame, col1: str, col2: str, op: str, new: str) -> DataFrame:
    """A1: ``new = col1 <op> col2`` after numeric coercion; x/0 -> NULL."""
    t = _types(df)
    a, b = to_number(col1, t[col1]), to_number(col2, t[col2])
    if op == "+":
        r = a + b
    elif op == "-":
        r = a - b
    elif op == "*":
        r = a * b
    elif op == "/":
        r = F.try_divide(a, b)
    else:
        raise ValueError(f"unknown operation {op!r}")
    return df.withColumn(new, r)


def arithmetic_report(df: DataFrame, col1: str, col2: str, op: str, new: str) -> DataFrame:
    """A2: count, mean, min, max, missing of the result; zero divisors; non-numeric inputs."""
    t = _types(df)
    out = arithmetic(df, col1, col2, op, new)
    a, b = to_number(col1, t[col1]), to_number(col2, t[col2])
    return out.agg(
        F.count(new).alias("count"),
        F.avg(new).alias("mean"),
        F.min(new).alias("min"),
        F.max(new).alias("max"),
        F.sum(F.col(new).isNull().cast("bigint")).alias("missing"),
        F.sum(null_safe_true((b == 0) & F.lit(op == "/")).cast("bigint")).alias("zero_divisors"),
        F.sum((F.col(col1).isNotNull() & a.isNull()).cast("bigint")).alias("non_numeric_1"),
        F.sum((F.col(col2).isNotNull() & b.isNull()).cast("bigint")).alias("non_numeric_2"),
    )


def _convert(c: str, dtype: T.DataType, to: str, fmt: str | None) -> Column:
    if to in ("int", "integer", "Int64", "long"):
        return to_long(c, dtype)
    if to in ("float", "double", "float64"):
        return to_number(c, dtype)
    if to in ("str", "text", "string", "category"):
        return F.col(c).cast("string")
    if to in ("datetime", "timestamp"):
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.col(c).cast("timestamp")
        if fmt:
            from tabloom.functions.exprs import strptime_to_java
            pat = strptime_to_java(fmt) if "%" in fmt else fmt
            return F.try_to_timestamp(F.col(c).cast("string"), F.lit(pat))
        return F.try_to_timestamp(F.col(c).cast("string"))
    raise ValueError(f"unknown target type {to!r}")


def convert_types(df: DataFrame, plan: dict[str, str], fmt: dict[str, str] | None = None,
                  errors: str = "coerce") -> DataFrame:
    """A3: coerce columns (``{col: 'int'|'float'|'text'|'datetime'|'category'}``).

    ``errors="coerce"``: bad values become NULL.  ``errors="keep_column"``
    (the reference's integer conversion): a column with any present value
    that does not convert is left as it was; the check for all columns is one
    counting aggregation.
    """
    t = _types(df)
    fmt = fmt or {}
    conv = {c: _convert(c, t[c], to, fmt.get(c)) for c, to in plan.items()}
    if errors == "keep_column":
        bad = df.agg(*[F.sum((F.col(c).isNotNull() & e.isNull()).cast("bigint")).alias(c)
                       for c, e in conv.items()]).first()
        conv = {c: e for c, e in conv.items() if not bad[c]}
    elif errors != "coerce":
        raise ValueError(errors)
    return df.withColumns(conv) if conv else df


def conversion_errors(df: DataFrame, plan: dict[str, str], fmt: dict[str, str] | None = None) -> DataFrame:
    """A4: per column, values that were present but became NULL (one aggregation)."""
    t = _types(df)
    fmt = fmt or {}
    aggs = [F.sum((F.col(c).isNotNull() & _convert(c, t[c], to, fmt.get(c)).isNull()).cast("bigint")).alias(c)
            for c, to in plan.items()]
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(to).alias("target_type"),
                 F.coalesce(F.col(c), F.lit(0)).alias("errors"))
        for c, to in plan.items()])).alias("r")).select("r.*")


def to_numeric_features(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A5: text feature columns to doubles (blank -> NULL, then lenient parse)."""
    t = _types(df)
    cols = columns or [c for c in df.columns if isinstance(t[c], T.StringType)]
    return df.withColumns({c: to_number(c, t[c]) for c in cols})


def binarize(df: DataFrame, column: str, threshold: float, new: str | None = None) -> DataFrame:
    """``<col>_bin`` = 1 where value > threshold, else 0 (missing -> 0)."""
    t = _types(df)
    v = to_number(column, t[column])
    return df.withColumn(new or f"{column}_bin", F.coalesce((v > F.lit(threshold)).cast("int"), F.lit(0)))


def math_transform(df: DataFrame, plan: dict[str, str], suffix: str = "") -> DataFrame:
    """``sqrt`` / ``log`` of numeric columns (log of x<=0 -> NULL, sqrt(x<0) -> NULL)."""
    out = {}
    for c, how in plan.items():
        x = F.col(c).cast("double")
        if how == "sqrt":
            out[c + suffix] = F.when(x >= 0, F.sqrt(x))
        elif how == "log":
            out[c + suffix] = F.when(x > 0, F.ln(x))
        else:
            raise ValueError(how)
    return df.withColumns(out)

"""Counts of many columns in one pass: distinct values, histograms, charts and pair grids.

Each row becomes one small (column, key) struct for each column, and one
grouped count, partial before its shuffle, counts all columns together.  A
row's other columns do not travel with it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.exprs import numeric_columns

LONG = 32        # bytes of a value beyond which its digest stands for it


def value_key(df: DataFrame, c: str) -> Column:
    """The value as bytes, equal exactly for equal values; NULL stays NULL.

    -0.0 equals 0.0, and NaN itself.  Longer values are told apart by SHA-256.
    """
    t, x = df.schema[c].dataType, F.col(c)
    if isinstance(t, (T.FloatType, T.DoubleType)):
        x = (x + F.lit(0.0)).cast("string")
    elif isinstance(t, T.TimestampType):
        x = F.unix_micros(x).cast("string")
    elif isinstance(t, (T.ArrayType, T.StructType)):
        x = F.when(x.isNotNull(), F.to_json(F.struct(x)))
    elif not isinstance(t, (T.StringType, T.BinaryType)):
        x = x.cast("string")
    b = x.cast("binary")
    return F.when(F.octet_length(b) <= LONG, F.concat(F.lit(b"="), b)).when(b.isNotNull(), F.unhex(F.sha2(b, 256)))


def count_keys(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """``(c, k, n)``: how often each value of the key expression number ``c`` occurs."""
    items = [F.struct(F.lit(i).alias("c"), k.alias("k")) for i, k in enumerate(keys)]
    return df.select(F.explode(F.array(*items)).alias("r")).select("r.*").groupBy("c", "k").agg(F.count(F.lit(1)).alias("n"))


def column_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, n_rows, nulls, n_distinct`` of each column, exact, whatever its number of values."""
    spark = df.sparkSession
    names = spark.createDataFrame(list(enumerate(columns)), "c int, column string")
    if not columns:
        return names.select("column", F.lit(0).cast("bigint").alias("n_rows"), F.lit(0).cast("bigint").alias("nulls"), F.lit(0).cast("bigint").alias("n_distinct"))
    found = count_keys(df, [value_key(df, c) for c in columns]).groupBy("c").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("k").isNull(), F.col("n"))).alias("nulls"), F.count("k").alias("n_distinct"))
    # one row a column
    out = names.join(F.broadcast(found), "c", "left")
    return out.select("column", *[F.coalesce(x, F.lit(0)).cast("bigint").alias(x) for x in ("n_rows", "nulls", "n_distinct")])


# --- ranges, bins and branches -------------------------------------------------------

def finite(c: str) -> Column:
    """The value as a double; missing where it is NULL, NaN or infinite."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def spread(lo: float | None, hi: float | None) -> tuple[float, float] | None:
    """A histogram's range: a single value stands in the middle of a range of one; None without a value."""
    if lo is None:
        return None
    return (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)


def bin_of(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Number of the bin that holds ``x``, the last one closed; NULL for NULL (``least`` alone would leave the NULL out)."""
    width = (F.lit(hi) - F.lit(lo)) / F.lit(bins)
    return F.when(x.isNotNull(), F.least(F.floor((x - F.lit(lo)) / width).cast("int"), F.lit(bins - 1)))


def ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float] | None]:
    """Histogram ranges of all columns, in one aggregation."""
    if not columns:
        return {}
    aggs = [f(finite(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]
    r = df.agg(*aggs).first()
    return {c: spread(r[f"lo{i}"], r[f"hi{i}"]) for i, c in enumerate(columns)}


def few_values(df: DataFrame, columns: Sequence[str], most: int) -> tuple[dict[str, bool], dict[str, tuple[float, float] | None]]:
    """Whether each numeric column has at most ``most`` present values, and its histogram range, in one scan.

    A task reports at most ``most + 1`` values of a column.
    """
    if not columns:
        return {}, {}
    wide = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        lo: dict[int, float] = {}
        hi: dict[int, float] = {}
        for b in batches:
            for name, col in zip(b.schema.names, b.columns):
                c = int(name[1:])
                v = col.drop_null().to_numpy(zero_copy_only=False)
                v = v[~np.isnan(v)] + 0.0
                if not len(v):
                    continue
                own = held.get(c, np.zeros(0))
                if len(own) <= most:
                    held[c] = np.unique(np.concatenate([own, v]))[:most + 1]
                own = v[np.isfinite(v)]
                if len(own):
                    lo[c], hi[c] = min(lo.get(c, np.inf), float(own.min())), max(hi.get(c, -np.inf), float(own.max()))
        rows = [(c, x, lo.get(c), hi.get(c)) for c, values in held.items() for x in values.tolist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
                (pa.int32(), pa.float64(), pa.float64(), pa.float64()))], names=["c", "x", "lo", "hi"])

    rows = wide.mapInArrow(run, "c int, x double, lo double, hi double")
    found = {r.c: r for r in rows.groupBy("c", "x").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).groupBy("c").agg(
        F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}          # one row a column
    few = {c: i not in found or found[i].n <= most for i, c in enumerate(columns)}
    return few, {c: spread(found[i].lo, found[i].hi) if i in found else None for i, c in enumerate(columns)}




def chart_data_all(df: DataFrame, columns: Sequence[str] | None = None, max_distinct: int = 20, bins: int = 30, top: int = 20) -> DataFrame:
    """P9 of a whole table: the chart of every column, in two scans whatever their number.

    Rows: ``column, chart, bin, lower, upper, value, count, n_unique``.  At most
    ``max_distinct`` present values: ``counts`` of each.  A numeric column with
    more: a ``histogram`` of all ``bins`` bins.  Another one: the ``top`` values
    (most frequent first, ties by value).  ``n_unique`` counts a text column's
    values.  A column without a value has no row.
    """
    spark = df.sparkSession
    cols = list(columns) if columns else df.columns
    num = [c for c in cols if c in set(numeric_columns(df, include_bool=False))]
    few, rng = few_values(df, num, max_distinct)
    hist = {c for c in num if not few[c] and rng[c]}
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}

    def key(c: str) -> Column:
        if c in hist:
            return bin_of(finite(c), *rng[c], bins).cast("string")
        x = F.col(c)
        return (F.when(~F.isnan(x), x + F.lit(0.0)) if c in floating else x).cast("string")

    counted = count_keys(df, [key(c) for c in cols]).where("k is not null")
    own = Window.partitionBy("c")
    # ranks only the first rows of each task's share
    place = F.row_number().over(own.orderBy(F.desc("n"), "k"))
    values = [i for i, c in enumerate(cols) if c not in hist]
    named = spark.createDataFrame([(i, c) for i, c in enumerate(cols)], "c int, column string")
    shown = counted.where(F.col("c").isin(values)) if values else counted.where("false")
    unique = shown.groupBy("c").agg(F.count("*").alias("n_unique"))
    best = shown.withColumn("place", place).where(F.col("place") <= max(top, max_distinct))
    listed = (best.join(F.broadcast(unique), "c").join(F.broadcast(named), "c")
              .where((F.col("n_unique") <= max_distinct) | (F.col("place") <= top))
              .select("column", F.when(F.col("n_unique") <= max_distinct, "counts").otherwise("top").alias("chart"), F.lit(None).cast("int").alias("bin"),
                      F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"), F.col("k").alias("value"),
                      F.col("n").alias("count"), "n_unique"))
    grid = [(i, c, b, rng[c][0] + b * w, rng[c][0] + (b + 1) * w) for i, c in enumerate(cols) if c in hist
            for w in [(rng[c][1] - rng[c][0]) / bins] for b in range(bins)]
    if not grid:
        return listed
    cells = spark.createDataFrame(grid, "c int, column string, bin int, lower double, upper double")
    drawn = counted.where(F.col("c").isin([i for i, c in enumerate(cols) if c in hist])).select("c", F.col("k").cast("int").alias("bin"), "n")
    bars = cells.join(drawn, ["c", "bin"], "left").select(
        "column", F.lit("histogram").alias("chart"), "bin", "lower", "upper", F.lit(None).cast("string").alias("value"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("count"), F.lit(None).cast("bigint").alias("n_unique"))
    return bars.unionByName(listed)


def pair_grids(df: DataFrame, pairs: Sequence[tuple[str, str]], bins: int = 20) -> DataFrame:
    """P11 of many column pairs in two scans: one aggregate finds all ranges, one exploded scan counts all cells.

    A pair's range and cells come from the rows that have both values.
    """
    spark = df.sparkSession
    both = [(finite(a), finite(b)) for a, b in pairs]
    aggs = []
    for i, (x, y) in enumerate(both):
        for n, v, w in (("x", x, y), ("y", y, x)):
            own = F.when(w.isNotNull(), v)
            aggs += [F.min(own).alias(f"{n}lo{i}"), F.max(own).alias(f"{n}hi{i}")]
    r = df.agg(*aggs).first() if aggs else None
    rng = [(spread(r[f"xlo{i}"], r[f"xhi{i}"]), spread(r[f"ylo{i}"], r[f"yhi{i}"])) for i in range(len(pairs))]
    used = [i for i in range(len(pairs)) if rng[i][0]]
    schema = "c int, x_col string, y_col string, xlo double, xw double, ylo double, yw double"
    table = spark.createDataFrame([(k, *pairs[i], rng[i][0][0], (rng[i][0][1] - rng[i][0][0]) / bins, rng[i][1][0], (rng[i][1][1] - rng[i][1][0]) / bins)
                                   for k, i in enumerate(used)], schema)
    keys = [F.when(both[i][0].isNotNull() & both[i][1].isNotNull(),
                   bin_of(both[i][0], *rng[i][0], bins) * bins + bin_of(both[i][1], *rng[i][1], bins)) for i in used]
    cells = count_keys(df, keys).where("k is not null") if keys else spark.createDataFrame([], "c int, k int, n bigint")
    bx, by = F.floor(F.col("k") / bins).cast("int"), F.pmod("k", F.lit(bins)).cast("int")
    at = cells.select("c", bx.alias("bx"), by.alias("by"), F.col("n").alias("count")).join(F.broadcast(table), "c")
    return at.select("x_col", "y_col", "bx", "by", "count", (F.col("xlo") + F.col("bx") * F.col("xw")).alias("x_lower"),
                     (F.col("xlo") + (F.col("bx") + 1) * F.col("xw")).alias("x_upper"), (F.col("ylo") + F.col("by") * F.col("yw")).alias("y_lower"),
                     (F.col("ylo") + (F.col("by") + 1) * F.col("yw")).alias("y_upper"))

"""Order-dependent operators without a single-partition window.

A window with ``orderBy`` but no ``partitionBy`` makes Spark move every row to
one task.  The operators here that depend on a *global* order (forward /
backward fill, row index for positional merges, dense codes, quantiles) use
range partitions instead: ``repartitionByRange`` sorts the rows into
partitions, the partition number is written with them to the shared checkpoint
folder (so it cannot change between two uses), windows work inside the
partitions, and a table of one row per partition (and group) links them.

Ties on the ordering key are broken by the caller's ``order_by``, which should
end in a unique key; then even one very frequent leading value is split over
partitions.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.exprs import nan_to_null
from tabloom.operators.selection import select_ranks
from tabloom.session import cut_lineage


def with_blocks(df: DataFrame, order_by: Sequence[str], nblocks: int | None = None,
                name: str = "__block") -> DataFrame:
    """The rows range-partitioned by ``order_by`` with their partition's number, written once."""
    n = nblocks or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut_lineage(df.repartitionByRange(n, *[F.col(c) for c in order_by]).withColumn(name, F.spark_partition_id()))


def _present(df: DataFrame, c: str) -> Column:
    """The column with NaN as NULL."""
    return nan_to_null(F.col(c)) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else F.col(c)


def _fill(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str],
          nblocks: int | None, forward: bool) -> DataFrame:
    part = list(partition_by or [])
    order = list(order_by)
    b = with_blocks(df, part + order, nblocks)
    # backward is forward along the reversed order: a frame that ends with its partition is read again for every row
    along = (lambda c: F.col(c).asc()) if forward else (lambda c: F.col(c).desc())
    w_in = Window.partitionBy("__block", *part).orderBy(*map(along, order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    okey = F.struct(*[F.col(c) for c in order])
    # carry table: last (first) present value of every column in each block
    pick = F.max_by if forward else F.min_by
    carry = b.groupBy("__block", *part).agg(*[
        pick(_present(b, c), F.when(_present(b, c).isNotNull(), okey)).alias(f"__v_{i}") for i, c in enumerate(columns)])
    w_c = (Window.partitionBy(*part) if part else Window).orderBy(along("__block")).rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(F.col("__block").alias("__cb"), *[F.col(c).alias(f"__p_{i}") for i, c in enumerate(part)], *[
        F.last(F.col(f"__v_{i}"), ignorenulls=True).over(w_c).alias(f"__c_{i}") for i in range(len(columns))])
    if not part:
        # one row per partition: a proven bound, broadcast it
        carry = F.broadcast(carry)
    inner = b.select(*[F.col(c) for c in df.columns], "__block", *[
        F.last(_present(b, c), ignorenulls=True).over(w_in).alias(f"__f_{i}")
        for i, c in enumerate(columns)])
    # a missing partition key is a group of its own
    same = F.col("__block") == F.col("__cb")
    for i, c in enumerate(part):
        same = same & F.col(c).eqNullSafe(F.col(f"__p_{i}"))
    j = inner.join(carry, same, "left")
    out = []
    for c in df.columns:
        if c in columns:
            i = list(columns).index(c)
            out.append(F.coalesce(F.col(f"__f_{i}"), F.col(f"__c_{i}")).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def forward_fill(df: DataFrame, columns: Sequence[str], order_by: Sequence[str],
                 partition_by: Sequence[str] = (), nblocks: int | None = None) -> DataFrame:
    """I5 ffill: each NULL (or NaN) takes the last value before it in ``order_by``."""
    return _fill(df, columns, order_by, partition_by, nblocks, forward=True)


def backward_fill(df: DataFrame, columns: Sequence[str], order_by: Sequence[str],
                  partition_by: Sequence[str] = (), nblocks: int | None = None) -> DataFrame:
    """I5 bfill: each NULL (or NaN) takes the next value after it in ``order_by``."""
    return _fill(df, columns, order_by, partition_by, nblocks, forward=False)


def _indexed(df: DataFrame, order_by: Sequence[str], name: str, nblocks: int | None,
             start: int) -> tuple[DataFrame, int]:
    order = list(order_by)
    b = with_blocks(df, order, nblocks)
    counts = sorted((r[0], r[1]) for r in b.groupBy("__block").count().collect())  # one row per partition
    before, run = [], start
    for blk, cnt in counts:
        before.append((blk, run))
        run += cnt
    first = df.sparkSession.createDataFrame(before, "__block int, __before long")
    w = Window.partitionBy("__block").orderBy(*[F.col(c) for c in order])
    out = (b.join(F.broadcast(first), "__block")
           .select(*[F.col(c) for c in df.columns], (F.row_number().over(w) - 1 + F.col("__before")).cast("bigint").alias(name)))
    return out, run - start


def global_row_index(df: DataFrame, order_by: Sequence[str], name: str = "row_index",
                     nblocks: int | None = None, start: int = 0) -> DataFrame:
    """Dense 0-based (or ``start``-based) row position by ``order_by`` without a global window.

    ``row_number`` inside range partitions plus the running count of the earlier
    ones, a table of one row per partition.
    """
    return _indexed(df, order_by, name, nblocks, start)[0]


def top_k_per_group(df: DataFrame, group_by: Sequence[str], order_by: Sequence[Column], k: int,
                    rank_name: str | None = "rank", salt_buckets: int = 64,
                    tie_break: Sequence[str] | None = None) -> DataFrame:
    """Top ``k`` rows of every group by ``order_by``.

    Two stages: a salted first pass keeps the top ``k`` of each
    (group, salt) slice, so a group holding a large share of the rows is spread
    over ``salt_buckets`` tasks; the second pass ranks at most
    ``k * salt_buckets`` candidates per group.
    """
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType,))]
    tb = list(tie_break) if tie_break else hashable
    ords = list(order_by) + [F.col(c) for c in tb]
    # the salt depends on the row only (not on partitioning), so a retried
    # task puts every row in the same slice again
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in hashable]), F.lit(salt_buckets))
    s1 = (df.withColumn("__salt", salt)
          .withColumn("__r1", F.row_number().over(Window.partitionBy(*group_by, "__salt").orderBy(*ords)))
          .where(F.col("__r1") <= k).drop("__salt", "__r1"))
    r = F.row_number().over(Window.partitionBy(*group_by).orderBy(*ords))
    out = s1.withColumn("__r2", r).where(F.col("__r2") <= k)
    if rank_name:
        return out.withColumnRenamed("__r2", rank_name)
    return out.drop("__r2")


def rank_small(df: DataFrame, order_by: Sequence[Column], name: str = "rank") -> DataFrame:
    """Rank of a *small, already aggregated* table.

    Only for results whose size is bounded by the aggregation (categories,
    hours, bins); a raw table must use :func:`global_row_index`.
    """
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order_by)).cast("bigint"))


# --- value counts: the one core behind modes, categories and codes ------------------------

def value_counts(df: DataFrame, columns: Sequence[str], as_type: str) -> DataFrame:
    """``(column, value, n)`` of the columns' present values, cast to ``as_type``.

    One pass for all columns: unpivot, then a grouped count whose partial
    counts are combined before the shuffle, so a hot value is one row per task.
    """
    cols = [F.col(c).cast(as_type).alias(f"c{i}") for i, c in enumerate(columns)]
    long = df.select(*cols).unpivot([], [f"c{i}" for i in range(len(columns))], "__c", "value")
    present = F.col("value").isNotNull() & ~F.isnan("value") if as_type in ("double", "float") else F.col("value").isNotNull()
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.substring("__c", 2, 9).cast("int") + 1)
    return long.where(present).select(name.alias("column"), "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def sorted_counts(counts: DataFrame, nblocks: int | None = None) -> tuple[DataFrame, list]:
    """Value counts in range partitions of (column, value), and a summary of the partitions.

    The summary has ``(column, __block, rows, n)`` in order.  A partition holds
    a run of consecutive columns, so it has at most one row per partition and
    one per column.
    """
    b = with_blocks(counts, ["column", "value"], nblocks)
    parts = b.groupBy("column", "__block").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()
    return b, sorted(parts, key=lambda r: (r["column"], r["__block"]))


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float], nblocks: int | None = None) -> list:
    """Exact interpolated quantiles (numpy 'linear' rule) of one column."""
    return quantiles(df, [column], {column: list(probs)}, nblocks=nblocks)[column]


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float] | dict[str, Sequence[float]],
              exact: bool = True, accuracy: int = 100000, nblocks: int | None = None) -> dict[str, list]:
    """Interpolated quantiles of several numeric columns (NaN ignored), in one fit for all of them.

    ``probs`` is one list, or one for each column.  ``exact=False``: one
    ``percentile_approx`` aggregation (fixed-size sketches).  ``exact=True``:
    bracketed selection (:mod:`tabloom.operators.selection`), two or three scans
    of the columns that shuffle counts only; ``nblocks`` is the number of parts
    that a bracket is cut into.
    """
    cols = list(dict.fromkeys(columns))
    if not cols:
        return {}
    wanted = {c: list(probs[c]) if isinstance(probs, dict) else list(probs) for c in cols}
    if not exact:
        def x(c):
            v = F.col(c).cast("double")
            return F.when(~F.isnan(v), v)
        row = df.agg(*[F.percentile_approx(x(c), F.array(*[F.lit(float(p)) for p in wanted[c]]), accuracy).alias(f"q{i}")
                       for i, c in enumerate(cols)]).first()
        return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(wanted[c])) for i, c in enumerate(cols)}

    def place(p: float, n: int) -> tuple[float, int, int]:
        h = p * (n - 1)
        return h, int(h // 1), min(int(h // 1) + 1, n - 1)

    total, got = select_ranks(df, cols, lambda c, n: [r for p in wanted[c] for r in place(p, n)[1:]], nblocks)
    out: dict[str, list] = {}
    for c in cols:
        out[c] = []
        for p in wanted[c]:
            if not total[c]:
                out[c].append(None)
                continue
            h, lo, hi = place(p, total[c])
            a, b = got[c][lo], got[c][hi]
            out[c].append(a if a == b else a + (h - lo) * (b - a))
    return out


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent present value of each column; ties -> the smallest value.

    One grouped count per column type, then the best count of each column; no
    task holds the values of a column.
    """
    out: dict[str, object] = {c: None for c in columns}
    by_type: dict[str, list[str]] = {}
    for c in dict.fromkeys(columns):
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    for t, cols in by_type.items():
        best = value_counts(df, cols, t).groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))
        out.update({r["column"]: r["value"] for r in best.collect()})       # one row per column
    return out

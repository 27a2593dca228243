"""Joins, unions and group sums attached to rows.

Joins are declared and Spark chooses the strategy: AQE turns a join into a
broadcast hash join at run time when one side turns out small, and splits
skewed partitions of a sort-merge join.  Group sums are computed as an
aggregation (partial sums combined map-side, so a hot key costs one row per
partition) and joined back, instead of a window that would sort every row of
a group in one task.
"""

from __future__ import annotations

import logging
import re
from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.dates import parse_datetime
from tabloom.operators.order import global_row_index
from tabloom.session import cut_lineage

log = logging.getLogger(__name__)

_TS = (T.TimestampType, T.TimestampNTZType, T.DateType)
_DATE_NAME = re.compile(r"date|time", re.IGNORECASE)


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def _rename_overlaps(left: DataFrame, right: DataFrame, keys: set[str], suffixes: tuple[str, str]):
    overlap = (set(left.columns) & set(right.columns)) - keys
    lsel = [F.col(c).alias(c + suffixes[0]) if c in overlap else F.col(c) for c in left.columns]
    rsel = [F.col(c).alias(c + suffixes[1]) if c in overlap else F.col(c) for c in right.columns]
    return left.select(*lsel), right.select(*rsel)


def left_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str | None = None,
              suffixes: tuple[str, str] = ("_x", "_y"), null_keys_match: bool = False,
              parse_dates: bool = True) -> DataFrame:
    """J1 (and S17): left join on a (timestamp) key, possibly named differently.

    Both keys are parsed as timestamps when ``parse_dates``; overlapping
    column names get ``suffixes``; duplicate right keys multiply the left
    rows.  ``null_keys_match=True`` makes missing keys match each other (the
    pandas behaviour) via a null-safe equality.
    """
    right_on = right_on or left_on
    lt, rt = _types(left), _types(right)
    if parse_dates:
        left = left.withColumn(left_on, parse_datetime(left_on, lt[left_on]))
        right = right.withColumn(right_on, parse_datetime(right_on, rt[right_on]))
    same = left_on == right_on
    keys = {left_on} if same else set()
    # the keys are joined under names of their own: a key may also be an overlapping column
    left, right = left.withColumn("__lkey", F.col(left_on)), right.withColumn("__rkey", F.col(right_on))
    l2, r2 = _rename_overlaps(left, right, keys, suffixes)
    if same:
        r2 = r2.drop(right_on)
    cond = F.col("__lkey").eqNullSafe(F.col("__rkey")) if null_keys_match else (F.col("__lkey") == F.col("__rkey"))
    return l2.join(r2, cond, "left").drop("__lkey", "__rkey")


def _date_column(df: DataFrame) -> str | None:
    for f in df.schema.fields:
        if _DATE_NAME.search(f.name):
            return f.name
    return None


def auto_date_join(tables: dict[str, DataFrame], order_by: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Fold any number of tables with left joins on their date columns.

    Right key: first column whose name contains date/time.  Left key:
    ``date``, else ``Date_and_Time``, else the first such column.  Overlapping
    names get ``_<table>``.  If a table (or the fold so far) has no date column,
    it is placed beside the others by position (J4): rows count by
    ``order_by[table]``, or by all their columns where that names none.
    """
    order_by = order_by or {}
    names = list(tables)
    acc = tables[names[0]]
    acc_order = list(order_by.get(names[0], acc.columns))
    for n in names[1:]:
        r = tables[n]
        rk = _date_column(r)
        lk = "date" if "date" in acc.columns else ("Date_and_Time" if "Date_and_Time" in acc.columns
                                                   else _date_column(acc))
        if rk is not None and lk is not None:
            acc = left_join(acc, r, lk, rk, suffixes=("", f"_{n}"))
            continue
        name = {c: f"{c}_{n}" if c in acc.columns else c for c in r.columns}
        r = r.select(*[F.col(c).alias(name[c]) for c in r.columns])
        acc = merge_horizontal({"__left": acc, n: r}, {"__left": acc_order, n: [name[c] for c in order_by.get(n, tables[n].columns)]})
        acc, acc_order = acc.withColumnRenamed("__pos", f"__pos_{n}"), [f"__pos_{n}"]
    return acc.drop(*[c for c in acc.columns if c.startswith("__pos_")])


HOT_ROWS = 10_000     # a key with fewer rows is never split


def hot_keys(tables: Sequence[DataFrame], key: str, hot_rows: int | None = None) -> tuple[DataFrame | None, int]:
    """Keys that a fold of full joins would gather in one task, with their rows in every table: ``key, n0, n1, ...``.

    One counted pass over the keys of all tables.  A key is hot if a table, or
    the fold before a join, has more than ``hot_rows`` rows of it; by default a
    quarter of an even share of all rows for each shuffle partition, and
    HOT_ROWS at least, so there are few of them.  None if no key is.
    """
    spark = tables[0].sparkSession
    one = [t.select(F.col(key).alias("key"), *[F.lit(int(i == k)).cast("long").alias(f"n{i}") for i in range(len(tables))])
           for k, t in enumerate(tables)]
    counts = cut_lineage(reduce(DataFrame.unionByName, one).groupBy("key").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(tables))]))
    if hot_rows is None:
        total = counts.agg(F.sum(reduce(lambda a, b: a + b, [F.col(f"n{i}") for i in range(len(tables))]))).first()[0] or 0
        hot_rows = max(HOT_ROWS, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    fold, most = F.col("n0"), F.col("n0")
    for i in range(1, len(tables)):
        most = F.greatest(most, fold, f"n{i}")
        fold = joined_rows(fold, F.col(f"n{i}"))
    # at most (rows of the tables and of the fold) / hot_rows of them
    rows = counts.where(F.col("key").isNotNull() & (most > hot_rows)).collect()
    return (spark.createDataFrame(rows, counts.schema) if rows else None), hot_rows


def joined_rows(n, m):
    """Rows of a key in the full join of two tables that have ``n`` and ``m`` of it."""
    return F.when((n > 0) & (m > 0), n * m).otherwise(n + m)


def full_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None, n_left, n_right, hot_rows: int) -> DataFrame:
    """Full outer join on ``key`` (one coalesced column) whose hot and NULL keys are dealt to many tasks.

    ``hot``: a bounded table of the hot keys with the row counts ``n_left`` and
    ``n_right``.  The side with more rows of a hot key gets a salt in each row,
    the other side's rows are repeated for every salt; a copy that met no row
    is taken out again, since its row met others.  A NULL key, and a hot key
    that one side lacks, meets nothing: its rows are dealt and not repeated.
    """
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = spark.createDataFrame([], "`__k` int, `__s` int, `__big` int") if hot is None else hot.select(
        F.col("key").alias("__k"), F.greatest(F.lit(2), F.least(F.lit(16 * parts), F.ceil(F.greatest(n_left, n_right) / hot_rows))).cast("int").alias("__s"),
        F.when((n_left > 0) & (n_right > 0), F.when(n_left >= n_right, 0).otherwise(1)).otherwise(2).alias("__big"))

    def salted(df: DataFrame, side: int) -> DataFrame:
        own = [c for c in df.columns]
        hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        deal = lambda n: F.pmod(F.xxhash64(*hashable), n).cast("int")          # noqa: E731
        k = F.col(key)
        if hot is None:
            return df.select(*own, F.when(k.isNull(), deal(F.lit(parts))).otherwise(0).alias("__salt"), F.lit(False).alias(f"__copy{side}"), F.lit(True).alias(f"__in{side}"))
        # bounded: the hot keys only
        j = df.join(F.broadcast(none), k == F.col("__k"), "left")
        copies = F.coalesce(F.col("__big") == 1 - side, F.lit(False))
        salts = (F.when(copies, F.sequence(F.lit(0), F.col("__s") - 1))
                 .when(k.isNull(), F.array(deal(F.lit(parts))))
                 .when(F.col("__s").isNotNull(), F.array(deal(F.col("__s"))))
                 .otherwise(F.array(F.lit(0))))
        return j.select(*own, F.explode(salts).alias("__salt"), copies.alias(f"__copy{side}"), F.lit(True).alias(f"__in{side}"))

    out = salted(left, 0).join(salted(right, 1), [key, "__salt"], "full")
    stray = (F.col("__copy0") & F.col("__in1").isNull()) | (F.col("__copy1") & F.col("__in0").isNull())
    return out.where(~F.coalesce(stray, F.lit(False))).drop("__salt", "__copy0", "__copy1", "__in0", "__in1")


def merge_on_key(tables: dict[str, DataFrame], key: str, hot_rows: int | None = None) -> DataFrame:
    """Full outer joins on a key present in every table (one coalesced key).

    Overlapping non-key columns get ``_<table>`` on the right side.  NULL keys
    match nothing and stay as rows of their own.  Keys with many rows are
    counted first and split over tasks (:func:`full_join`); ``hot_rows`` sets
    how many are too many.
    """
    for n, t in tables.items():
        if key not in t.columns:
            raise ValueError(f"key {key!r} missing in {n!r}")
    names = list(tables)
    acc = tables[names[0]]
    if len(names) == 1:
        return acc
    hot, limit = hot_keys([tables[n] for n in names], key, hot_rows)
    rows = F.col("n0")
    for i, n in enumerate(names[1:], 1):
        r = tables[n]
        overlap = (set(acc.columns) & set(r.columns)) - {key}
        r = r.select(*[F.col(c).alias(f"{c}_{n}") if c in overlap else F.col(c) for c in r.columns])
        acc = full_join(acc, r, key, hot, rows, F.col(f"n{i}"), limit)
        rows = joined_rows(rows, F.col(f"n{i}"))
    return acc


def merge_horizontal(tables: dict[str, DataFrame], order_by: dict[str, Sequence[str]]) -> DataFrame:
    """Positional side-by-side merge; shorter tables padded with NULL.

    Row positions come from each table's ``order_by`` (block scheme, no global
    window); tables are then full-outer-joined on the position.  Duplicate
    column names are an error.
    """
    seen: set[str] = set()
    for n, t in tables.items():
        dup = seen & set(t.columns)
        if dup:
            raise ValueError(f"duplicate column names: {sorted(dup)}")
        seen |= set(t.columns)
    acc = None
    for n, t in tables.items():
        idx = global_row_index(t, order_by[n], "__pos")
        acc = idx if acc is None else acc.join(idx, "__pos", "full")
    cols = [c for n in tables for c in tables[n].columns]
    return acc.select(*cols, "__pos")


def merge_vertical(tables: dict[str, DataFrame] | Sequence[DataFrame]) -> DataFrame:
    """UNION ALL; the same column names, order and types are required."""
    dfs = list(tables.values()) if isinstance(tables, dict) else list(tables)
    first = dfs[0].schema
    for d in dfs[1:]:
        if [(f.name, f.dataType) for f in d.schema.fields] != [(f.name, f.dataType) for f in first.fields]:
            raise ValueError("vertical merge needs identical schemas")
    return reduce(lambda a, b: a.unionByName(b), dfs)


def choose_merge_strategy(infos: Sequence[dict]) -> str:
    """``none`` / ``vertical`` / ``horizontal`` / ``manual`` from metadata.

    ``infos``: ``{"columns": [...], "row_count": n}`` per table.  Vertical
    requires the same column set in every table (the reference only compared
    against the first table's size).
    """
    if len(infos) < 2:
        return "none"
    sets = [set(i["columns"]) for i in infos]
    if all(s == sets[0] for s in sets):
        return "vertical"
    if len({i["row_count"] for i in infos}) == 1:
        return "horizontal"
    return "manual"


def merge_auto(tables: dict[str, DataFrame], order_by: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """J6 joined to its merge: vertical for equal column sets, horizontal for equal row counts.

    One table comes back as it is; where the choice is ``manual``, a ValueError
    says so.  Vertical merges take the first table's column order; horizontal
    ones place rows by ``order_by``, or by all columns.
    """
    strategy = choose_merge_strategy(table_infos(tables))
    frames = list(tables.values())
    if strategy == "none":
        return frames[0]
    if strategy == "vertical":
        return merge_vertical([t.select(*frames[0].columns) for t in frames])
    if strategy == "horizontal":
        order = {n: list((order_by or {}).get(n, t.columns)) for n, t in tables.items()}
        return merge_horizontal(tables, order).drop("__pos")
    raise ValueError("the tables share neither columns nor a row count; choose a merge")


def table_infos(tables: dict[str, DataFrame]) -> list[dict]:
    """Column lists and row counts of several tables (counts in one job)."""
    counts = reduce(lambda a, b: a.unionByName(b), [
        t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("t"), "n") for name, t in tables.items()])
    n = {r["t"]: r["n"] for r in counts.collect()}
    return [{"name": k, "columns": list(t.columns), "row_count": n[k]} for k, t in tables.items()]


def group_sum_attach(df: DataFrame, date_col: str, columns: Sequence[str], grain: str = "exact",
                     suffix: str | None = None, fmt: str | None = None) -> DataFrame:
    """Attach the sum per date key to every row.

    ``grain``: ``exact`` (the parsed timestamp, J7), ``day`` or ``month``
    (``yyyy-MM``, J8).  Rows whose date does not parse get NULL; a group whose
    values are all missing sums to 0.
    """
    t = _types(df)
    ts = parse_datetime(date_col, t[date_col], fmt)
    if grain == "exact":
        key = ts
    elif grain == "day":
        key = F.to_date(ts)
    elif grain == "month":
        key = F.date_format(ts, "yyyy-MM")
    else:
        raise ValueError(grain)
    suffix = suffix or {"exact": "_daily_sum", "day": "_daily_sum", "month": "_monthly_sum"}[grain]
    keyed = df.withColumn("__gkey", key)
    sums = (keyed.where(F.col("__gkey").isNotNull()).groupBy("__gkey")
            .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"__s{i}") for i, c in enumerate(columns)]))
    j = keyed.join(sums, "__gkey", "left")
    return j.select(*[F.col(c) for c in df.columns],
                    *[F.col(f"__s{i}").alias(f"{c}{suffix}") for i, c in enumerate(columns)])

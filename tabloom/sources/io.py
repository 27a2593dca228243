"""Sources, sinks and catalog operations.

Reading and writing go through Spark's data sources (CSV, parquet, catalog
tables, JDBC when a driver jar is supplied), so scans are split into tasks,
filters and projections are pushed into them, and writes are parallel.
SQLite-specific plumbing (connections, transactions, PRAGMA) is not rebuilt;
a catalog table plays its role.
"""

from __future__ import annotations

import logging
from datetime import datetime
from functools import reduce
from typing import Any, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.exprs import INTEGER_TEXT, NUMERIC_TEXT, null_safe_true
from tabloom.operators.columns import column_counts
from tabloom.sources.csv_ranges import read_split

log = logging.getLogger(__name__)


# --- S1 / S2 / S3: CSV ingestion and typing ------------------------------------

def read_csv(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8",
             header: bool = True, headers: Sequence[str] | None = None, multiline: bool = True) -> DataFrame:
    """S1 + S2: read CSV text columns; blanks become NULL.

    Without a header the columns are named ``"0", "1", ...`` unless
    ``headers`` supplies the names, whose count must match the columns.
    Everything is read as text; :func:`infer_column_types` types it in one
    pass.  Cells may hold doubled quotes and, with ``multiline``, line breaks
    (LF, or CR LF, which they keep); large files are read by many tasks in either case
    (:mod:`tabloom.sources.csv_ranges`).  Encodings of several bytes a letter
    whose bytes look like quotes or line breaks (UTF-16, UTF-32) are read a file a task.
    """
    kind = encoding.lower().replace("-", "").replace("_", "")
    if multiline and not kind.startswith(("utf16", "utf32")):
        df = read_split(spark, path, header, delimiter, encoding)
    else:
        df = (spark.read.option("sep", delimiter).option("encoding", encoding)
              .option("header", header).option("inferSchema", False)
              .option("quote", '"').option("escape", '"').option("multiLine", multiline)
              .option("nullValue", "").option("emptyValue", None).csv(path))
    if headers is not None:
        if len(headers) != len(df.columns):
            raise ValueError(f"{len(headers)} header names for {len(df.columns)} columns")
        df = df.toDF(*headers)
    elif not header:
        df = df.toDF(*[str(i) for i in range(len(df.columns))])
    return blanks_to_null(df)


def blanks_to_null(df: DataFrame) -> DataFrame:
    """Every blank text cell becomes NULL."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            out.append(F.when(F.trim(F.col(f.name)) != "", F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def infer_column_types(df: DataFrame) -> DataFrame:
    """S3: INTEGER if every non-null value is an integer that a bigint holds, else REAL if every one
    is a number, else TEXT; an all-null column is TEXT.  One aggregation.

    Blank text counts as missing.  A numeric-text guard keeps Spark's lenient
    casts (``'1d'``) from counting as numbers.
    """
    aggs = []
    for i, c in enumerate(df.columns):
        s = F.col(c).cast("string")
        s = F.when(F.trim(s) != "", s)
        aggs += [F.count(s).alias(f"n{i}"),
                 F.sum((s.isNotNull() & ~(s.rlike(INTEGER_TEXT) & F.trim(s).try_cast("bigint").isNotNull())).cast("bigint")).alias(f"ni{i}"),
                 F.sum((s.isNotNull() & ~s.rlike(NUMERIC_TEXT)).cast("bigint")).alias(f"nr{i}")]
    row = df.agg(*aggs)
    items = []
    for i, c in enumerate(df.columns):
        t = (F.when(F.col(f"n{i}") == 0, "TEXT").when(F.col(f"ni{i}") == 0, "INTEGER")
             .when(F.col(f"nr{i}") == 0, "REAL").otherwise("TEXT"))
        items.append(F.struct(F.lit(c).alias("column"), t.alias("inferred_type")))
    return row.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def apply_inferred_types(df: DataFrame, types: DataFrame | dict[str, str]) -> DataFrame:
    """Cast the text columns to the inferred types (bad values -> NULL)."""
    if isinstance(types, DataFrame):
        types = {r["column"]: r["inferred_type"] for r in types.collect()}  # one row per column
    to = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string"}
    return df.select(*[F.col(c).cast("string").try_cast(to[types.get(c, "TEXT")]).alias(c) for c in df.columns])


def typed_csv(spark: SparkSession, path: str, **kw) -> DataFrame:
    """S1-S3 together: read, blank -> NULL, infer and cast."""
    raw = read_csv(spark, path, **kw)
    return apply_inferred_types(raw, infer_column_types(raw))


# --- S4-S11, S15-S16: catalog tables ----------------------------------------------

def create_table(spark: SparkSession, name: str, data: DataFrame | None = None,
                 schema: T.StructType | str | None = None) -> None:
    """Create the table if it does not exist (from data, or empty with a schema)."""
    if data is not None:
        data.write.mode("ignore").saveAsTable(name)
    elif not spark.catalog.tableExists(name):
        spark.catalog.createTable(name, schema=schema if isinstance(schema, T.StructType)
                                  else T._parse_datatype_string(schema))


def insert_rows(df: DataFrame, name: str) -> None:
    """Append rows (a single row is a one-row DataFrame)."""
    df.write.mode("append").insertInto(name)


def read_table(spark: SparkSession, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Read a catalog table or a parquet path; optional projection (pruned at the scan)."""
    df = spark.read.parquet(name) if "/" in name else spark.table(name)
    return df.select(*columns) if columns else df


def list_tables(spark: SparkSession, with_counts: bool = True, database: str | None = None) -> DataFrame:
    """Table names (temporary/system tables hidden) with row counts in one job."""
    tables = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]
    full = {t: f"`{database}`.`{t}`" if database else f"`{t}`" for t in tables}
    if not tables:
        return spark.createDataFrame([], "name string, rows bigint")
    if not with_counts:
        return spark.createDataFrame([(t,) for t in tables], "name string")
    parts = [spark.table(full[t]).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("name"), "rows")
             for t in tables]
    return reduce(lambda a, b: a.unionByName(b), parts)


def table_exists(spark: SparkSession, name: str) -> bool:
    """S9."""
    return spark.catalog.tableExists(name)


def table_schema(df: DataFrame) -> DataFrame:
    """Column names and types (metadata only)."""
    return df.sparkSession.createDataFrame(
        [(f.name, dtype_name(f.dataType), f.nullable) for f in df.schema.fields],
        "column string, dtype string, nullable boolean")


def table_ddl(spark: SparkSession, name: str) -> str:
    """The DDL text of a catalog table."""
    return spark.sql(f"SHOW CREATE TABLE {name}").first()[0]


def table_count(df: DataFrame) -> int:
    """S11."""
    return df.count()


def dtype_name(t: T.DataType) -> str:
    if isinstance(t, T.TimestampNTZType):
        return "timestamp"
    return t.simpleString()


def table_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column type, NULL count and distinct count, plus row/column counts.

    One pass for all columns (the reference ran two queries per column).
    ``exact=False`` counts distinct values approximately, with a sketch of
    fixed size per column.
    """
    t = {f.name: dtype_name(f.dataType) for f in df.schema.fields}
    if exact:
        own = df.sparkSession.createDataFrame([(c, t[c]) for c in df.columns], "column string, dtype string")
        return column_counts(df, df.columns).join(F.broadcast(own), "column").select(
            "column", "dtype", "nulls", "n_distinct", "n_rows", F.lit(len(df.columns)).alias("n_columns"))
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(df.columns):
        aggs += [F.sum(F.col(c).isNull().cast("bigint")).alias(f"z{i}"), F.approx_count_distinct(F.col(c)).alias(f"d{i}")]
    row = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("column"), F.lit(t[c]).alias("dtype"),
                      F.coalesce(F.col(f"z{i}"), F.lit(0)).alias("nulls"), F.col(f"d{i}").alias("n_distinct"),
                      F.col("__n").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))
             for i, c in enumerate(df.columns)]
    return row.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def update_where(df: DataFrame, assignments: dict[str, Any | Column], condition: str | Column) -> DataFrame:
    """UPDATE ... SET ... WHERE: only rows where the condition is TRUE change."""
    cond = null_safe_true(F.expr(condition) if isinstance(condition, str) else condition)
    return df.withColumns({c: F.when(cond, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c))
                           for c, v in assignments.items()})


def save_table(df: DataFrame, name: str | None = None, overwrite: bool = False, prefix: str = "merged",
               path: str | None = None) -> str:
    """Write a table; refuse if it exists unless ``overwrite``.

    Default name ``<prefix>_<YYYYmmdd_HHMMSS>``.  With ``path`` the table is
    written as parquet files there instead of the catalog.
    """
    name = name or f"{prefix}_{datetime.now():%Y%m%d_%H%M%S}"
    mode = "overwrite" if overwrite else "errorifexists"
    if path:
        df.write.mode(mode).parquet(path)
    else:
        df.write.mode(mode).saveAsTable(name)
    return name


def export_csv(tables: dict[str, DataFrame], out_dir: str, known: Sequence[str] | None = None) -> DataFrame:
    """One headed UTF-8 CSV directory per table; unknown names are skipped.

    Returns (table, rows, status); the rows are counted by the writing job itself.
    """
    spark = next(iter(tables.values())).sparkSession if tables else None
    rows = []
    for name, df in tables.items():
        if known is not None and name not in known:
            log.warning("unknown table %s skipped", name)
            rows.append((name, 0, "skipped"))
            continue
        seen = Observation()
        (df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("header", True)
         .option("encoding", "UTF-8").option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(f"{out_dir}/{name}"))
        rows.append((name, seen.get["n"], "written"))
    return spark.createDataFrame(rows, "table string, rows bigint, status string")


def run_sql(spark: SparkSession, text: str, params: Sequence[Any] | dict | None = None) -> DataFrame:
    """An SQL text with positional (``?``) or named (``:name``) parameters."""
    if params is None:
        return spark.sql(text)
    return spark.sql(text, args=list(params) if not isinstance(params, dict) else params)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int | None = None) -> DataFrame:
    """Table read from a database through JDBC (driver jar must be on the classpath).

    With a partition column the read is split into ``num_partitions`` range
    queries so it runs in parallel.
    """
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", num_partitions or 8))
    return r.load()

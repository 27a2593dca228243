"""Derived input views over the driver tables, in Spark and in DuckDB SQL.

The reference works on sales-by-hour, weather and modelling tables that are
not shipped; these views map the driver tables onto those shapes with the
same expression on both engines, so every registered query reads the given
tables (its work grows with them) and its DuckDB twin can be checked.
NULLs are injected by deterministic expressions where an operator needs
missing values; no rows are filtered out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.exprs import WEEKDAY_JA, weekday_label

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- Spark side

def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id", "event_type",
        F.col("ts").alias("date"),
        F.hour("ts").alias("time"),
        (F.col("value") * 100).alias("sales"),
        F.get_json_object("props", "$.k").cast("bigint").alias("customer_count"),
        weekday_label("ts", WEEKDAY_JA).alias("dow"),
    )


def sales_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    m = F.pmod(F.col("event_id"), F.lit(50))
    return e.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"),
        F.when(m == 0, F.lit("abc")).when(m == 1, F.lit("")).otherwise(F.col("value").cast("string")).alias("sales"),
        F.get_json_object("props", "$.k").alias("customer_count"),
        F.col("user_id").cast("string").alias("user_id"),
    )


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.to_date("o_orderdate").alias("day"))
            .agg(F.sum("o_totalprice").alias("sales"), F.count(F.lit(1)).alias("n_orders")))


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return (e.groupBy(F.to_date("ts").alias("day"), "event_type")
            .agg(F.sum("value").alias("value_sum"), F.count(F.lit(1)).alias("n_events")))


def li_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.withColumns({
        "l_quantity": F.when(F.col("l_linenumber") != 3, F.col("l_quantity")),
        "l_tax": F.when(F.pmod("l_partkey", F.lit(7)) != 0, F.col("l_tax")),
        "l_returnflag": F.when(F.pmod("l_suppkey", F.lit(5)) != 0, F.col("l_returnflag")),
    })


def gaps_of(events: DataFrame) -> DataFrame:
    """The ``events_gaps`` projection of any events frame (batch or stream)."""
    return events.withColumn("value", F.when(F.pmod("event_id", F.lit(4)) == 0, F.col("value")))


def events_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps_of(table(spark, sf_dir, "events"))


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table read as a file stream (the glob names the one file)."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")


def order_dates_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", "o_custkey", "o_totalprice",
        F.when(F.pmod("o_orderkey", F.lit(97)) == 0, F.lit("bad"))
        .otherwise(F.date_format("o_orderdate", "yyyy/MM/dd")).alias("order_date"),
    )


def key_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.withColumn("o_custkey", F.when(F.pmod("o_orderkey", F.lit(10)) != 0, F.col("o_custkey")))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("yhat"))


# ---------------------------------------------------------------- DuckDB side
# The same views as SQL common table expressions (DuckDB dialect).

_JA_ARRAY = "[" + ", ".join(f"'{w}'" for w in WEEKDAY_JA) + "]"

SQL_VIEWS = {
    "sales": f"""sales AS (
        SELECT event_id, user_id, event_type, ts AS date, CAST(hour(ts) AS INTEGER) AS time,
               value * 100 AS sales,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS customer_count,
               {_JA_ARRAY}[isodow(ts)] AS dow
        FROM events)""",
    "sales_text": """sales_text AS (
        SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date,
               CASE WHEN event_id % 50 = 0 THEN 'abc' WHEN event_id % 50 = 1 THEN ''
                    ELSE CAST(value AS VARCHAR) END AS sales,
               json_extract_string(props, '$.k') AS customer_count,
               CAST(user_id AS VARCHAR) AS user_id
        FROM events)""",
    "daily_orders": """daily_orders AS (
        SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS sales, count(*) AS n_orders
        FROM orders GROUP BY 1)""",
    "daily_events": """daily_events AS (
        SELECT CAST(ts AS DATE) AS day, event_type, sum(value) AS value_sum, count(*) AS n_events
        FROM events GROUP BY 1, 2)""",
    "li_missing": """li_missing AS (
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
               CASE WHEN l_linenumber <> 3 THEN l_quantity END AS l_quantity,
               l_extendedprice, l_discount,
               CASE WHEN l_partkey % 7 <> 0 THEN l_tax END AS l_tax,
               CASE WHEN l_suppkey % 5 <> 0 THEN l_returnflag END AS l_returnflag,
               l_linestatus, l_shipdate
        FROM lineitem)""",
    "events_gaps": """events_gaps AS (
        SELECT event_id, ts, user_id, event_type,
               CASE WHEN event_id % 4 = 0 THEN value END AS value, props
        FROM events)""",
    "order_dates_text": """order_dates_text AS (
        SELECT o_orderkey, o_custkey, o_totalprice,
               CASE WHEN o_orderkey % 97 = 0 THEN 'bad' ELSE strftime(o_orderdate, '%Y/%m/%d') END AS order_date
        FROM orders)""",
    "key_nulls": """key_nulls AS (
        SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS o_custkey,
               o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
        FROM orders)""",
    "preds": """preds AS (
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS y, l_quantity * 1000 AS yhat
        FROM lineitem)""",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named views as CTEs."""
    if not names:
        return sql
    head = "WITH " + ",\n".join(SQL_VIEWS[n] for n in names)
    body = sql.lstrip()
    if body[:4].upper() == "WITH":
        return head + ",\n" + body[4:].lstrip()
    return head + "\n" + body


# ---------------------------------------------------------------- run records
# A run table derived from events: each event is a "run" of the experiment
# named after its event type, with metrics, parameters, tags and comments
# computed from the event's columns (so the table grows with the data).

def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.concat(F.lit("exp_"), F.col("event_type")).alias("experiment"),
        F.col("event_id").cast("string").alias("run_id"),
        F.col("ts").alias("start_time"),
        F.create_map(F.lit("k"), k, F.lit("user_id"), F.col("user_id").cast("string")).alias("params"),
        F.create_map(F.lit("r2"), F.col("value") / 500.0, F.lit("rmse"), F.col("value"),
                     F.lit("mae"), F.col("value") / 2).alias("metrics"),
        F.create_map(F.lit("mlflow.user"), F.concat(F.lit("user_"), F.col("user_id").cast("string")),
                     F.lit("mlflow.source.type"), F.lit("LOCAL"),
                     F.lit("event_type"), F.col("event_type"),
                     F.lit("k_bucket"), F.floor(k.cast("int") / 10).cast("string")).alias("tags"),
        F.array(F.concat(F.lit("モデル: GBT "), F.col("event_type")),
                F.concat(F.lit("note for user "), F.col("user_id").cast("string"))).alias("comments"),
        F.col("props").alias("importance_json"),
    )


SQL_VIEWS["runs"] = """runs AS (
        SELECT 'exp_' || event_type AS experiment, CAST(event_id AS VARCHAR) AS run_id, ts AS start_time,
               value / 500.0 AS r2, value AS rmse, value / 2 AS mae, event_type, user_id,
               json_extract_string(props, '$.k') AS k, props AS importance_json,
               'モデル: GBT ' || event_type AS c1, 'note for user ' || CAST(user_id AS VARCHAR) AS c2
        FROM events)"""

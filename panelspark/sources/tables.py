"""The driver's tables as ticks and panels, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.bars import session_date, to_bars

ORDER = ["ts", "o1", "o2", "o3", "o4", "o5"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_ticks(spark: SparkSession, sf_dir: str, item: str) -> DataFrame:
    t = load(spark, sf_dir, "lineitem")
    return t.select(
        F.col(item).cast("string").alias("item_id"), F.col("l_shipdate").alias("ts"), F.try_divide("l_extendedprice", "l_quantity").alias("px"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("amt"),
        F.col("l_orderkey").alias("o1"), F.col("l_linenumber").alias("o2"), F.col("l_partkey").alias("o3"), F.col("l_extendedprice").alias("o4"), F.col("l_quantity").alias("o5"),
    )


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "events")
    return t.select(F.col("user_id").cast("string").alias("item_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("px"), F.lit(1.0).alias("qty"), F.col("value").alias("amt"), F.col("event_id").alias("o1"))


def month_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of suppliers."""
    return to_bars(lineitem_ticks(spark, sf_dir, "l_suppkey"), F.to_date(F.date_trunc("month", "ts")), ORDER)


def quarter_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly bars of parts."""
    return to_bars(lineitem_ticks(spark, sf_dir, "l_partkey"), F.to_date(F.date_trunc("quarter", "ts")), ORDER)


def day_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session-day bars of users."""
    return to_bars(event_ticks(spark, sf_dir), session_date(F.col("ts")), ["ts", "o1"])


def hour_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_bars(event_ticks(spark, sf_dir), F.date_trunc("hour", "ts"), ["ts", "o1"], name="hour")


_BARS = "arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, coalesce(sum(qty), 0) AS volume, coalesce(sum(amt), 0) AS turnover, count(*) AS obs"


def _lineitem_sql(item: str, grain: str) -> str:
    key = "row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)"
    return f"(SELECT item_id, date, {_BARS} FROM (SELECT CAST({item} AS VARCHAR) AS item_id, CAST(date_trunc('{grain}', l_shipdate) AS DATE) AS date, l_extendedprice / nullif(l_quantity, 0) AS px, l_quantity AS qty, l_extendedprice AS amt, {key} AS k FROM lineitem) GROUP BY item_id, date)"


MONTH_SQL = _lineitem_sql("l_suppkey", "month")
QUARTER_SQL = _lineitem_sql("l_partkey", "quarter")
DAY_SQL = f"(SELECT item_id, date, {_BARS} FROM (SELECT CAST(user_id AS VARCHAR) AS item_id, CAST(ts + INTERVAL 8 HOUR - INTERVAL 15 HOUR AS DATE) AS date, value AS px, 1.0 AS qty, value AS amt, row(ts, event_id) AS k FROM events) GROUP BY item_id, date)"
HOUR_SQL = f"(SELECT item_id, hour, {_BARS} FROM (SELECT CAST(user_id AS VARCHAR) AS item_id, date_trunc('hour', ts) AS hour, value AS px, 1.0 AS qty, value AS amt, row(ts, event_id) AS k FROM events) GROUP BY item_id, hour)"

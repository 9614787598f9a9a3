"""Ticks to bars, on any grain and session anchor, and checks of candles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN_HOUR, ZONE = 15, "Asia/Shanghai"


def session_date(ts: Column, zone: str = ZONE, hour: int = OPEN_HOUR) -> Column:
    """The date of the session that ts falls in: sessions begin at `hour` local time."""
    return F.to_date(F.from_utc_timestamp(ts, zone) - F.make_dt_interval(F.lit(0), F.lit(hour)))


def to_bars(ticks: DataFrame, bucket: Column, order: list[str], item: str = "item_id", name: str = "date") -> DataFrame:
    """First, greatest, least and last price, sums and count of each (item, bucket).

    `order` puts ticks of one time in a definite order. NULL prices are passed over; a sum of nothing is 0. Aggregation
    is partial before its one exchange.
    """
    key = F.when(F.col("px").isNotNull(), F.struct(*order))
    return ticks.groupBy(F.col(item).alias("item_id"), bucket.alias(name)).agg(
        F.min_by("px", key).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", key).alias("close"),
        F.coalesce(F.sum("qty"), F.lit(0.0)).alias("volume"), F.coalesce(F.sum("amt"), F.lit(0.0)).alias("turnover"), F.count("*").alias("obs"),
    )


def from_candles(candles: DataFrame) -> DataFrame:
    """Session-day bars of hourly candles (item_id, ts, o, h, l, c, v, turnover)."""
    first, last = (F.when(F.col(x).isNotNull(), F.col("ts")) for x in ("o", "c"))
    return candles.groupBy("item_id", session_date(F.col("ts")).alias("date")).agg(
        F.min_by("o", first).alias("open"), F.max("h").alias("high"), F.min("l").alias("low"), F.max_by("c", last).alias("close"),
        F.coalesce(F.sum("v"), F.lit(0.0)).alias("volume"), F.coalesce(F.sum("turnover"), F.lit(0.0)).alias("turnover"), F.count("*").alias("obs"),
    )


def faults(o: str = "open", h: str = "high", l: str = "low", c: str = "close", v: str = "volume") -> Column:  # noqa: E741
    """What is wrong with a candle, as an array of texts."""
    col = F.col
    checks = [
        (col(o).isNull() | col(h).isNull() | col(l).isNull() | col(c).isNull() | col(v).isNull(), "missing field"),
        (col(o) <= 0, "open not positive"),
        (col(c) <= 0, "close not positive"),
        (col(h) < col(l), "high below low"),
        (col(v) < 0, "negative volume"),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in checks]))


def window_filter(panel: DataFrame, start: str | None, end: str | None, history_days: int = 0, date: str = "date") -> DataFrame:
    """Sessions from start (less some days of history) to end, both kept: a plain date range that reaches the scan."""
    if start:
        panel = panel.where(F.col(date) >= F.date_sub(F.to_date(F.lit(start)), history_days))
    return panel.where(F.col(date) <= F.to_date(F.lit(end))) if end else panel


def weak_dates(panel: DataFrame, least: int = 20) -> DataFrame:
    """Rows of dates with at least so many items."""
    from pyspark.sql import Window

    return panel.withColumn("_n", F.count("item_id").over(Window.partitionBy("date"))).where(F.col("_n") >= least).drop("_n")

"""Keyed merges of bars, progress and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIOD_MS = {"1H": 3_600_000, "1D": 86_400_000}


def open_from(now_ms: int, period: str, offset_ms: int = 0) -> int:
    """Where the period that is still open begins. offset_ms moves the grid (sessions that do not begin at midnight UTC)."""
    if period not in PERIOD_MS:
        raise ValueError(f"period must be one of {sorted(PERIOD_MS)}")
    p = PERIOD_MS[period]
    return (now_ms - offset_ms) // p * p + offset_ms


def _tagged(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))


def upsert_closed(old: DataFrame, new: DataFrame, keys: list[str], t: str, open_ms: int, order: str | None = None) -> DataFrame:
    """New rows replace old ones of the same keys, but rows of the open period (t at or after open_ms) are not written.

    Within a side the row with the greatest `order` counts (the last one, if order is its position). One exchange; the
    aggregation is partial, so a key with many versions is reduced before it moves.
    """
    own = [c for c in old.columns if c not in keys]
    both = _tagged(old, new.where((F.col(t) < open_ms) & F.col(t).isNotNull()))
    rank = F.struct("_new", *([order] if order else []))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*own), rank).alias("_v")).select(*[k for k in old.columns if k in keys], "_v.*").select(*old.columns)


def upsert_stats(old: DataFrame, new: DataFrame, keys: list[str], t: str, open_ms: int) -> DataFrame:
    """One row: skipped (in the open period), added, updated, preserved (rows that were there)."""
    o = old.select(*keys).distinct().withColumn("_old", F.lit(1))
    n = new.where(F.col(t).isNotNull()).select(*keys, (F.col(t) >= open_ms).alias("_open")).groupBy(*keys).agg(F.count("*").alias("_rows"), F.max(F.col("_open").cast("int")).alias("_open"))
    j = o.join(n, keys, "full_outer")
    closed = F.col("_rows").isNotNull() & (F.col("_open") == 0)

    def total(cond: Column, value: Column | None = None) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.lit(1) if value is None else value)), F.lit(0)).cast("long")

    return j.agg(total(F.col("_open") == 1, F.col("_rows")).alias("skipped"), total(closed & F.col("_old").isNull()).alias("added"), total(closed & F.col("_old").isNotNull()).alias("updated"), total(F.col("_old").isNotNull()).alias("preserved"))


def upsert_larger(old: DataFrame, new: DataFrame, keys: list[str], size: str) -> DataFrame:
    """A new row replaces an old one only if its `size` is larger; ties and NULL sizes keep what was there."""
    own = [c for c in old.columns if c not in keys]
    rank = F.struct(F.coalesce(F.col(size), F.lit(float("-inf"))), -F.col("_new"))
    return _tagged(old, new).groupBy(*keys).agg(F.max_by(F.struct(*own), rank).alias("_v")).select(*[k for k in old.columns if k in keys], "_v.*").select(*old.columns)


def progress_view(journal: DataFrame, key: str = "local_id") -> DataFrame:
    """The last state of each key of an append-only journal (day, key, status, at), of its latest day alone: a new day begins anew."""
    last = journal.agg(F.max("day").alias("day"))
    today = journal.join(F.broadcast(last), "day", "left_semi")
    return today.groupBy("day", key).agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))


def coverage(planned: DataFrame, crawled: DataFrame, key: str) -> DataFrame:
    """One row: how many of the planned keys are there."""
    p, c = planned.select(key).distinct(), crawled.select(key).distinct().withColumn("_in", F.lit(1))
    return p.join(c, key, "left").agg(F.count("*").alias("planned"), F.count("_in").alias("crawled")).withColumn("coverage", F.try_divide("crawled", "planned"))


def already_done(items: DataFrame, files: DataFrame, key: str, least_bytes: int = 100 * 1024) -> DataFrame:
    """Items that still lack a file of `least_bytes`. files: (key, length), as binaryFile's metadata gives them."""
    return items.join(files.where(F.col("length") >= least_bytes).select(key), key, "left_anti")

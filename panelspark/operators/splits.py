"""Splits of the date axis. A table of dates is small; rows are reached by a semi-join on the date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.plans.expr import DATE


def dates_of(panel: DataFrame) -> DataFrame:
    """(date, i, n): distinct dates with their place; a row for each date of the panel's calendar."""
    d = panel.select(DATE).distinct()
    return d.withColumn("i", (F.row_number().over(Window.orderBy(DATE)) - 1).cast("long")).withColumn("n", F.count("*").over(Window.partitionBy()))


def chronological(panel: DataFrame, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """(date, role): train, val, test in order of time, each with a date at least; needs three dates."""
    d = dates_of(panel)
    n = F.col("n")
    train_end = F.greatest(F.lit(1), F.floor(n * train))
    val_end = F.greatest(train_end + 1, F.floor(n * (train + val)))
    val_end = F.when(val_end >= n, n - 1).otherwise(val_end)
    train_end = F.when(train_end >= val_end, val_end - 1).otherwise(train_end)
    d = d.withColumn("a", train_end).withColumn("b", val_end).where((F.col("a") > 0) & (F.col("b") > F.col("a")))
    return d.select(DATE, F.when(F.col("i") < F.col("a"), "train").when(F.col("i") < F.col("b"), "val").otherwise("test").alias("role"))


def purged_kfold(panel: DataFrame, k: int = 5, horizon: int = 8, embargo: int = 2) -> DataFrame:
    """(fold, date, role): K runs of successive dates are test in turn; train is without dates whose label window
    [t, t + horizon] meets [first test date, last test date + horizon + embargo] (role purged). The first n mod k folds
    hold a date more. Fewer than 3 k dates give no fold."""
    d = dates_of(panel).where(F.col("n") >= 3 * k)
    size, more = F.floor(F.col("n") / k), F.col("n") % k
    fold = F.when(F.col("i") < more * (size + 1), F.floor(F.col("i") / (size + 1))).otherwise(more + F.floor((F.col("i") - more * (size + 1)) / size))
    d = d.withColumn("fold", fold.cast("int"))
    tests = d.groupBy("fold").agg(F.min(DATE).alias("first"), F.max(DATE).alias("last"))
    each = d.select(DATE, F.col("fold").alias("own")).crossJoin(F.broadcast(tests))  # dates by k folds
    hit = (F.date_add(DATE, horizon) >= F.col("first")) & (F.col(DATE) <= F.date_add("last", horizon + embargo))
    return each.select("fold", DATE, F.when(F.col("own") == F.col("fold"), "test").when(hit, "purged").otherwise("train").alias("role"))


def validation_tail(folds: DataFrame, share: float = 0.1) -> DataFrame:
    """The last part of each fold's training dates becomes role val: what is left of int(n * (1 - share))."""
    w = Window.partitionBy("fold", "role")
    r = folds.withColumn("_r", F.row_number().over(w.orderBy(DATE))).withColumn("_n", F.count("*").over(w))
    return r.select("fold", DATE, F.when((F.col("role") == "train") & (F.col("_r") > F.floor(F.col("_n") * (1 - share))), "val").otherwise(F.col("role")).alias("role"))


def walk_forward(panel: DataFrame, train: int = 120, test: int = 20, step: int = 20) -> DataFrame:
    """(fold, date, role) of expanding windows: all before the test dates is train; folds count from 1."""
    d = dates_of(panel)
    folds = d.select("n").distinct().where(F.col("n") >= train + test).select(F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - train - test) / step).cast("int"))).alias("f"))
    start = F.lit(train) + F.col("f") * step
    each = d.crossJoin(F.broadcast(folds)).where(F.col("i") < start + test)
    return each.select((F.col("f") + 1).alias("fold"), DATE, F.when(F.col("i") < start, "train").otherwise("test").alias("role"))


def leaks(folds: DataFrame, horizon: int, one: str = "train", other: str = "test") -> DataFrame:
    """(fold, n): dates of one role whose label window meets a label window of the other. Dates by dates, within a fold."""
    a = folds.where(F.col("role") == one).select("fold", F.col(DATE).alias("a"))
    b = folds.where(F.col("role") == other).groupBy("fold").agg(F.array_sort(F.collect_list(DATE)).alias("bs"))
    met = a.join(b, "fold").where(F.exists("bs", lambda x: (F.date_add("a", horizon) >= x) & (F.col("a") <= F.date_add(x, horizon))))
    return met.groupBy("fold").agg(F.count("*").alias("n"))


def rows_of(panel: DataFrame, folds: DataFrame, fold: int, role: str) -> DataFrame:
    return panel.join(F.broadcast(folds.where((F.col("fold") == fold) & (F.col("role") == role)).select(DATE)), DATE, "left_semi")

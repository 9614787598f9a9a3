"""Expectations on tables: each is one row (check, passed, observed), so a suite is a union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame, name: str, passed: Column, observed: Column) -> DataFrame:
    return df.agg(F.lit(name).alias("check"), passed.alias("passed"), observed.cast("long").alias("observed"))


def unique(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """Observed: how many keys stand on more than one row. NULL keys do not count."""
    d = df.dropna(subset=list(columns)).groupBy(*columns).count().where("count > 1")
    return _row(d, name, F.count("*") == 0, F.count("*"))


def not_null(df: DataFrame, name: str, column: str) -> DataFrame:
    n = F.coalesce(F.sum(F.col(column).isNull().cast("long")), F.lit(0))
    return _row(df, name, n == 0, n)


def between(df: DataFrame, name: str, column: str, low: float, high: float) -> DataFrame:
    n = F.coalesce(F.sum((~F.col(column).between(low, high)).cast("long")), F.lit(0))
    return _row(df, name, n == 0, n)


def subset(df: DataFrame, name: str, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """Observed: distinct values that the other table lacks."""
    d = df.select(F.col(column).alias("_v")).where("_v IS NOT NULL").distinct().join(other.select(F.col(other_column).alias("_v")), "_v", "left_anti")
    return _row(d, name, F.count("*") == 0, F.count("*"))


def disjoint(df: DataFrame, name: str, column: str, other: DataFrame, other_column: str) -> DataFrame:
    d = df.select(F.col(column).alias("_v")).where("_v IS NOT NULL").distinct().join(other.select(F.col(other_column).alias("_v")), "_v", "left_semi")
    return _row(d, name, F.count("*") == 0, F.count("*"))


def count_between(df: DataFrame, name: str, low: int, high: int) -> DataFrame:
    return _row(df, name, F.count("*").between(low, high), F.count("*"))


def filled(df: DataFrame, name: str, low_id: int, high_id: int, id_col: str, least_share: float = 0.4) -> DataFrame:
    """A segment of ids is used at least to a share."""
    n = F.sum(F.col(id_col).between(low_id, high_id).cast("long"))
    return _row(df, name, n >= least_share * (high_id - low_id + 1), n)


def no_match(df: DataFrame, name: str, column: str, pattern: str) -> DataFrame:
    """Observed: rows whose text still holds what should be gone."""
    n = F.coalesce(F.sum(F.col(column).rlike(pattern).cast("long")), F.lit(0))
    return _row(df, name, n == 0, n)


def share_matching(df: DataFrame, name: str, column: str, pattern: str, least: float) -> DataFrame:
    n = F.coalesce(F.sum(F.col(column).rlike(pattern).cast("long")), F.lit(0))
    return _row(df, name, n >= least * F.count("*"), n)


def suite(checks: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)


def duplicates(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")

"""Every registered query with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.functions.base_factors import FACTORS
from panelspark.operators.evaluation import rank_ic
from panelspark.plans.planner import Plan
from panelspark.registry import cross, data, factors, live, validation
from panelspark.sources import tables

REGISTRIES = [factors, cross, validation, data, live]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank IC of momentum by quarter: scan, bars, windows along items, ranks across dates, two aggregations."""
    p = Plan({"momentum_5": FACTORS["momentum_5"], "target_8d": FACTORS["target_8d"]}).apply(tables.quarter_panel(spark, sf_dir))
    return rank_ic(p, ["momentum_5"], "target_8d")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for registry in REGISTRIES for name, query in registry.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for registry in REGISTRIES for name, text in registry.oracle_sql().items()}

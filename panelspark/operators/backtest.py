"""Overlapping-tranche portfolio simulation.

Each day of the calendar a tranche of the best N items may be bought and held for some days. Picks and tranche returns
are windows and joins over the panel; only the portfolio itself, a row per day, is a fold: aggregate() over the sorted
days with cash and open tranches as its state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.plans.expr import DATE, ITEM


@dataclass(frozen=True)
class Config:
    initial: float = 1.0
    commission: float = 0.015
    holding: int = 8
    top_n: int = 6
    build_up: int = 8
    least_rows: int = 20

    def __post_init__(self) -> None:
        if self.initial <= 0 or not 0 <= self.commission < 1 or min(self.holding, self.top_n, self.build_up) < 1:
            raise ValueError("initial, holding, top_n and build_up must be positive, commission in [0, 1)")


def coverage(panel: DataFrame, start: str, end: str, history: int = 90) -> DataFrame:
    """One row: does the panel span the days that a run from start to end needs?"""
    r = panel.agg(F.min(DATE).alias("first"), F.max(DATE).alias("last"))
    return r.withColumn("covered", (F.col("first") <= F.date_sub(F.to_date(F.lit(start)), history)) & (F.col("last") >= F.to_date(F.lit(end))))


def picks(scored: DataFrame, n: int, score: str = "score", least: int = 0) -> DataFrame:
    """The n best rows of each date with `least` rows or more; ties go by item."""
    w = Window.partitionBy(DATE)
    p = scored.withColumn("_n", F.count("*").over(w)).where((F.col("_n") >= least) & (F.col("_n") >= n))
    return p.withColumn("place", F.row_number().over(w.orderBy(F.desc(score), ITEM))).where(F.col("place") <= n).drop("_n")


def tranche_returns(picked: DataFrame, target: str, commission: float) -> DataFrame:
    """(date, ret): mean realized return of a date's picks less commission; nothing realized counts as 0."""
    return picked.groupBy(DATE).agg((F.coalesce(F.avg(target), F.lit(0.0)) - commission).alias("ret"))


def calendar(start: str, end: str, df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias(DATE))


OPEN = "array<struct<due:date,amount:double,ret:double>>"


def equity_curve(tranches: DataFrame, days: DataFrame, config: Config, by: list[str] | None = None) -> DataFrame:
    """(by..., date, value) for each day of `days` (by..., date): tranches without a return on a day are not bought.

    A day pays back what matures, then buys: for build_up days a fixed part of the initial capital, afterwards all
    cash. Open tranches count at cost; those open after the last day are settled at their return, on that day.
    """
    by = by or []
    d = days.join(tranches, [*by, DATE], "left").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(DATE).alias("day"), "ret"))).alias("days"))
    zero = F.struct(F.lit(config.initial).alias("cash"), F.array().cast(OPEN).alias("open"), F.lit(0).alias("i"), F.array().cast("array<struct<day:date,value:double>>").alias("out"))

    def paid(open_: Column) -> Column:
        return F.aggregate(open_, F.lit(0.0), lambda s, x: s + x["amount"] * (1 + x["ret"]))

    def at_cost(open_: Column) -> Column:
        return F.aggregate(open_, F.lit(0.0), lambda s, x: s + x["amount"])

    def step(s: Column, x: Column) -> Column:
        due = F.filter(s["open"], lambda t: t["due"] == x["day"])
        held = F.filter(s["open"], lambda t: t["due"] != x["day"])
        cash = s["cash"] + paid(due)
        stake = F.when(s["i"] < config.build_up, F.lit(config.initial / config.build_up)).otherwise(cash)
        buys = x["ret"].isNotNull() & (stake > 0)
        new = F.struct(F.date_add(x["day"], config.holding).alias("due"), stake.alias("amount"), x["ret"].alias("ret"))
        cash_after = F.when(buys, cash - stake).otherwise(cash)
        open_after = F.when(buys, F.concat(held, F.array(new))).otherwise(held).cast(OPEN)
        value = cash_after + at_cost(open_after)
        return F.struct(cash_after.alias("cash"), open_after.alias("open"), (s["i"] + 1).alias("i"), F.concat(s["out"], F.array(F.struct(x["day"].alias("day"), value.alias("value")))).alias("out"))

    def finish(s: Column) -> Column:
        last = F.element_at(s["out"], -1)
        settled = F.struct(last["day"].alias("day"), (s["cash"] + paid(s["open"])).alias("value"))
        return F.when(F.size(s["out"]) > 0, F.concat(F.slice(s["out"], 1, F.size(s["out"]) - 1), F.array(settled))).otherwise(s["out"])

    return d.select(*by, F.explode(F.aggregate("days", zero, step, finish)).alias("p")).select(*by, F.col("p.day").alias(DATE), F.col("p.value").alias("value"))


def performance(curve: DataFrame, initial: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """Total and annualized return, volatility of daily returns (population, times root 365), Sharpe, deepest drawdown."""
    by = by or []
    w = Window.partitionBy(*by).orderBy(DATE)
    c = curve.withColumn("r", F.try_divide("value", F.lag("value").over(w)) - 1).withColumn("peak", F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = c.groupBy(*by).agg(F.count("*").alias("n_days"), F.max_by("value", DATE).alias("final"), F.stddev_pop("r").alias("sd"), F.max(F.try_divide(F.col("peak") - F.col("value"), F.col("peak"))).alias("max_drawdown"))
    annual = F.pow(F.col("final") / initial, F.lit(365.0) / F.col("n_days")) - 1
    s = s.withColumn("total_return", F.col("final") / initial - 1).withColumn("annual_return", annual).withColumn("volatility", F.col("sd") * F.sqrt(F.lit(365.0)))
    return s.withColumn("sharpe", F.when(F.col("volatility") > 0, F.col("annual_return") / F.col("volatility")).otherwise(0.0)).drop("sd")


def benchmarks(panel: DataFrame, days: DataFrame, sizes: list[int], target: str, config: Config) -> DataFrame:
    """The same run with hindsight: the N best realized returns of each date, for each N, as curves side by side."""
    known = panel.where(F.col(target).isNotNull())
    tranches = None
    for n in sizes:
        t = tranche_returns(picks(known, n, target), target, config.commission).withColumn("n", F.lit(n))
        tranches = t if tranches is None else tranches.unionByName(t)
    grid = days.crossJoin(days.sparkSession.createDataFrame([(n,) for n in sizes], "n int"))  # days by a few sizes
    return equity_curve(tranches, grid, config, ["n"])

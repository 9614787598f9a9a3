"""Queries for splits, statistics and backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import backtest, cross, splits, stats
from panelspark.sources import tables
from panelspark.sources.tables import DAY_SQL, MONTH_SQL

_dates = f"SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM {MONTH_SQL})"


def chrono(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.chronological(tables.month_panel(spark, sf_dir))


CHRONO_SQL = f"""
WITH d AS ({_dates}), e AS (SELECT *, greatest(1, floor(n * 0.8)) AS a0, greatest(greatest(1, floor(n * 0.8)) + 1, floor(n * (0.8::DOUBLE + 0.1::DOUBLE))) AS b0 FROM d),
f AS (SELECT *, CASE WHEN b0 >= n THEN n - 1 ELSE b0 END AS b FROM e), g AS (SELECT *, CASE WHEN a0 >= b THEN b - 1 ELSE a0 END AS a FROM f)
SELECT date, CASE WHEN i < a THEN 'train' WHEN i < b THEN 'val' ELSE 'test' END AS role FROM g WHERE a > 0 AND b > a"""


def kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.purged_kfold(tables.month_panel(spark, sf_dir), 5, 40, 5)


KFOLD_SQL = f"""
WITH d AS ({_dates}),
f AS (SELECT *, CAST(CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE (n % 5) + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS own FROM d WHERE n >= 15),
t AS (SELECT own AS fold, min(date) AS first, max(date) AS last FROM f GROUP BY own)
SELECT fold, date, CASE WHEN own = fold THEN 'test' WHEN date + 40 >= first AND date <= last + 45 THEN 'purged' ELSE 'train' END AS role FROM f, t"""


def validation_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.validation_tail(kfold(spark, sf_dir), 0.2).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("date").alias("first"))


TAIL_SQL = f"""
WITH k AS ({KFOLD_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY fold, role ORDER BY date) AS r, count(*) OVER (PARTITION BY fold, role) AS m FROM k),
v AS (SELECT fold, date, CASE WHEN role = 'train' AND r > floor(m * (1 - 0.2::DOUBLE)) THEN 'val' ELSE role END AS role FROM r)
SELECT fold, role, count(*) AS n, min(date) AS first FROM v GROUP BY fold, role"""


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.walk_forward(tables.month_panel(spark, sf_dir), 40, 10, 10)


WALK_SQL = f"WITH d AS ({_dates}), f AS (SELECT unnest(range(0, (max(n) - 50) // 10 + 1)) AS f FROM d) SELECT CAST(f + 1 AS INTEGER) AS fold, date, CASE WHEN i < 40 + f * 10 THEN 'train' ELSE 'test' END AS role FROM d, f WHERE i < 50 + f * 10"


def leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.leaks(walk(spark, sf_dir), 65)


LEAK_SQL = f"WITH w AS ({WALK_SQL}) SELECT fold, count(*) AS n FROM w a WHERE role = 'train' AND EXISTS (SELECT 1 FROM w b WHERE b.fold = a.fold AND b.role = 'test' AND a.date + 65 >= b.date AND a.date <= b.date + 65) GROUP BY fold"


def fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.month_panel(spark, sf_dir)
    return splits.rows_of(p, splits.purged_kfold(p, 5, 40, 5), 2, "test").groupBy("date").agg(F.count("*").alias("n"))


FOLD_ROWS_SQL = f"SELECT date, count(*) AS n FROM {MONTH_SQL} WHERE date IN (SELECT date FROM ({KFOLD_SQL}) WHERE fold = 2 AND role = 'test') GROUP BY date"


def deflated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials: monthly returns of each nation's suppliers, mean over deviation."""
    p = cross.forward_return(tables.month_panel(spark, sf_dir), 1)
    nation = tables.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("item_id"), "s_nationkey")
    trials = p.join(nation, "item_id").groupBy("s_nationkey").agg(F.try_divide(F.avg("target_1d"), F.stddev_samp("target_1d")).alias("value"))
    return stats.deflated_sharpe(trials).select("n_trials", *[F.round(c, 6).alias(c) for c in ("sigma", "e_max", "observed", "dsr")], "verdict")


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are the returns of odd months' top tranche above those of the even ones? A row per year."""
    p = cross.forward_return(tables.month_panel(spark, sf_dir), 1)
    y = p.groupBy(F.year("date").alias("y")).agg(F.avg(F.when(F.month("date") % 2 == 1, F.col("target_1d"))).alias("a"), F.avg(F.when(F.month("date") % 2 == 0, F.col("target_1d"))).alias("b"))
    return stats.paired_tests(y.orderBy("y"), "a", "b").select("n", *[F.round(c, 6).alias(c) for c in ("mean_diff", "std_diff", "t", "p_t", "w", "p_w", "cohens_d", "win_rate")], "verdict")


# Backtests on the daily panel: score by the bar's range position, three days' return.
CONFIG = backtest.Config(holding=3, top_n=5, build_up=3)
START, END = "2024-01-02", "2024-01-29"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cross.forward_return(tables.day_panel(spark, sf_dir), 3)
    return p.withColumn("score", F.round(F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")), 9)).where("score IS NOT NULL")


_scored = f"(SELECT * FROM (SELECT *, lead(close, 3) OVER (PARTITION BY item_id ORDER BY date) / nullif(close, 0) - 1 AS target, round((close - low) / nullif(high - low, 0), 9) AS score FROM {DAY_SQL}) WHERE score IS NOT NULL)"


def _rets(n: int, least: int, score: str, where: str = "TRUE") -> str:
    return f"(SELECT date, coalesce(avg(target), 0) - 0.015 AS ret FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY {score} DESC, item_id) AS r FROM {_scored} WHERE {where}) WHERE n >= {least} AND n >= {n} AND r <= {n} GROUP BY date)"


def _curve_sql(rets: str) -> str:
    return f"""
WITH RECURSIVE days AS (SELECT CAST(unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY)) AS DATE) AS date),
r AS (SELECT d.date, ret, row_number() OVER (ORDER BY d.date) - 1 AS i FROM days d LEFT JOIN {rets} t ON t.date = d.date),
s AS (
  SELECT CAST(-1 AS BIGINT) AS i, CAST(NULL AS DATE) AS date, CAST(1.0 AS DOUBLE) AS cash, CAST([] AS STRUCT(due DATE, amount DOUBLE, ret DOUBLE)[]) AS open
  UNION ALL
  SELECT i, date, CASE WHEN buys THEN cash - stake ELSE cash END, CASE WHEN buys THEN list_append(held, {{'due': date + 3, 'amount': stake, 'ret': ret}}) ELSE held END FROM (
    SELECT *, CASE WHEN i < 3 THEN CAST(1.0 AS DOUBLE) / 3 ELSE cash END AS stake, ret IS NOT NULL AND CASE WHEN i < 3 THEN CAST(1.0 AS DOUBLE) / 3 ELSE cash END > 0 AS buys FROM (
      SELECT r.i, r.date, r.ret, s.cash + coalesce(list_sum(list_transform(list_filter(s.open, lambda t: t.due = r.date), lambda t: t.amount * (1 + t.ret))), 0) AS cash, list_filter(s.open, lambda t: t.due <> r.date) AS held
      FROM s JOIN r ON r.i = s.i + 1)))
SELECT date, round(CASE WHEN i = (SELECT max(i) FROM r) THEN cash + coalesce(list_sum(list_transform(open, lambda t: t.amount * (1 + t.ret))), 0) ELSE cash + coalesce(list_sum(list_transform(open, lambda t: t.amount)), 0) END, 8) AS value FROM s WHERE i >= 0"""


def top_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.picks(scored(spark, sf_dir), 5, least=20).select("date", "item_id", "place")


PICKS_SQL = f"SELECT date, item_id, CAST(r AS INTEGER) AS place FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY score DESC, item_id) AS r FROM {_scored}) WHERE n >= 20 AND r <= 5"


def tranches(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = backtest.tranche_returns(backtest.picks(scored(spark, sf_dir), 5, least=20), "target_3d", 0.015)
    return t.select("date", F.round("ret", 7).alias("ret"))


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = backtest.tranche_returns(backtest.picks(scored(spark, sf_dir), 5, least=20), "target_3d", CONFIG.commission)
    return backtest.equity_curve(t, backtest.calendar(START, END, t), CONFIG)


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve(spark, sf_dir).withColumn("value", F.round("value", 8))


EQUITY_SQL = _curve_sql(_rets(5, 20, "score"))


def perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backtest.performance(curve(spark, sf_dir))
    return out.select("n_days", *[F.round(c, 6).alias(c) for c in ("final", "total_return", "annual_return", "volatility", "sharpe", "max_drawdown")])


PERF_SQL = f"""
WITH c AS ({EQUITY_SQL}), w AS (SELECT *, value / lag(value) OVER (ORDER BY date) - 1 AS r, max(value) OVER (ORDER BY date) AS peak FROM c),
s AS (SELECT count(*) AS n_days, arg_max(value, date) AS final, stddev_pop(r) * sqrt(365.0) AS volatility, max((peak - value) / peak) AS max_drawdown FROM w)
SELECT n_days, round(final, 6) AS final, round(final - 1, 6) AS total_return, round(power(final, 365.0 / n_days) - 1, 6) AS annual_return, round(volatility, 6) AS volatility, round(CASE WHEN volatility > 0 THEN (power(final, 365.0 / n_days) - 1) / volatility ELSE 0 END, 6) AS sharpe, round(max_drawdown, 6) AS max_drawdown FROM s"""


SIZES = [60, 120, 180, 220]


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scored(spark, sf_dir)
    return backtest.benchmarks(p, backtest.calendar(START, END, p), SIZES, "target_3d", CONFIG).select("n", "date", F.round("value", 8).alias("value"))


BENCH_SQL = " UNION ALL ".join(f"SELECT {n} AS n, * FROM ({_curve_sql(_rets(n, 0, 'target', 'target IS NOT NULL'))})" for n in SIZES)


def cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.coverage(tables.month_panel(spark, sf_dir), "1996-01-01", "2001-01-01")


COVER_SQL = f"SELECT min(date) AS first, max(date) AS last, min(date) <= DATE '1996-01-01' - 90 AND max(date) >= DATE '2001-01-01' AS covered FROM {MONTH_SQL}"


def queries() -> dict:
    return {
        "chrono_split": chrono, "purged_kfold": kfold, "validation_tail": validation_tail, "walk_forward": walk, "leak_check": leak, "fold_rows": fold_rows, "deflated_sharpe": deflated, "paired_tests": paired,
        "topn_pick": top_picks, "tranche_return": tranches, "equity_curve": equity, "perf_summary": perf, "benchmark_curve": bench, "backtest_coverage": cover,
    }


def oracle_sql() -> dict:
    return {
        "chrono_split": CHRONO_SQL, "purged_kfold": KFOLD_SQL, "validation_tail": TAIL_SQL, "walk_forward": WALK_SQL, "leak_check": LEAK_SQL, "fold_rows": FOLD_ROWS_SQL,
        "topn_pick": PICKS_SQL, "tranche_return": f"SELECT date, round(ret, 7) AS ret FROM {_rets(5, 20, 'score')}", "equity_curve": EQUITY_SQL, "perf_summary": PERF_SQL, "benchmark_curve": BENCH_SQL, "backtest_coverage": COVER_SQL,
    }

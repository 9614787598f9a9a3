"""Queries for bars, base factors and alphas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.alphas import ALPHAS
from panelspark.functions.base_factors import FACTORS
from panelspark.operators.bars import faults
from panelspark.plans.planner import Plan
from panelspark.sources import tables

FAMILIES = {
    "returns": ["log_return_1", "intraday_return"],
    "momentum": ["momentum_5", "momentum_20", "momentum_40", "momentum_60"],
    "risk_adj_mom": ["risk_adj_mom_20"],
    "return_shape": ["return_skew_20", "return_kurt_20"],
    "downside_vol": ["downside_vol_20"],
    "donchian": ["donchian_pos_20"],
    "true_range": ["true_range_pct_1"],
    "realized_vol": ["realized_vol_10", "realized_vol_20"],
    "parkinson_vol": ["parkinson_vol_10"],
    "vol_ratio": ["vol_ratio_5_20", "vol_change_20"],
    "log_zscores": ["log_volume_zscore_20", "log_amount_zscore_20"],
    "corr_price_vol": ["corr_price_vol_20"],
    "ma_ratio": ["volume_ma_ratio_5_20", "amount_ma_ratio_5_20"],
    "amihud": ["amihud_illiquidity_20"],
    "mfi": ["mfi_14"],
    "obv_slope": ["obv_slope_20"],
    "vwap_gap": ["vwap_close_gap"],
    "rsi": ["rsi_14"],
    "stoch_k": ["stoch_k_14"],
    "bollinger": ["bollinger_z_20"],
    "ema_gap": ["ema_gap_12_26"],
    "ma_gap": ["price_ma_gap_20", "trend_slope_ma20"],
    "adx": ["adx_14"],
    "candle_shape": ["body_ratio", "upper_shadow_ratio", "lower_shadow_ratio", "clv_1"],
    "cmf": ["cmf_20"],
    "bull_ratio": ["bull_ratio_5"],
    "covariates": ["log_price_ma", "log_volume_ma"],
    "target": ["target_8d"],
}
NO_TWIN = {"adx"}  # its inner series has gaps; tests hold it against pandas
DIGITS = 6
# What is exact on both sides, or fixed at ten digits already, must not be rounded at a half again.
EXACT = {"alpha012": 9, "alpha046": 9, "alpha049": 9, "alpha051": 9, "alpha002": 10, "alpha003": 10, "alpha006": 10, "alpha026": 10, "alpha044": 10, "alpha055": 10, "corr_price_vol_20": 10}


def _query(outputs: dict, panel=tables.month_panel):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = Plan(outputs).apply(panel(spark, sf_dir))
        return out.select("item_id", "date", *[F.round(n, EXACT.get(n, DIGITS)).alias(n) for n in outputs])

    return run


def _twin(outputs: dict, source: str = tables.MONTH_SQL) -> str:
    return f"SELECT item_id, date, {', '.join(f'round({n}, {EXACT.get(n, DIGITS)}) AS {n}' for n in outputs)} FROM ({Plan(outputs).sql(source)})"


def _bars(panel, name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rounded = [F.round(x, 9).alias(x) for x in ("open", "high", "low", "close", "volume")]
        return panel(spark, sf_dir).select("item_id", name, *rounded, F.round("turnover", 2).alias("turnover"), "obs")

    return run


def _bars_sql(source: str, name: str) -> str:
    return f"SELECT item_id, {name}, {', '.join(f'round({x}, 9) AS {x}' for x in ('open', 'high', 'low', 'close', 'volume'))}, round(turnover, 2) AS turnover, obs FROM {source}"


def bar_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.day_panel(spark, sf_dir).withColumn("low", F.when(F.col("obs") % 5 == 0, F.col("high") + 1).otherwise(F.col("low")))
    return bars.withColumn("fault", F.explode(faults())).groupBy("fault").agg(F.count("*").alias("n"))


BAR_VALIDITY_SQL = f"""
WITH b AS (SELECT *, CASE WHEN obs % 5 = 0 THEN high + 1 ELSE low END AS low2 FROM {tables.DAY_SQL}),
f AS (
  SELECT CASE WHEN open IS NULL OR high IS NULL OR low2 IS NULL OR close IS NULL OR volume IS NULL THEN 'missing field' END AS fault FROM b
  UNION ALL SELECT CASE WHEN open <= 0 THEN 'open not positive' END FROM b
  UNION ALL SELECT CASE WHEN close <= 0 THEN 'close not positive' END FROM b
  UNION ALL SELECT CASE WHEN high < low2 THEN 'high below low' END FROM b
  UNION ALL SELECT CASE WHEN volume < 0 THEN 'negative volume' END FROM b)
SELECT fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY fault"""


def queries() -> dict:
    out = {"bars_month": _bars(tables.month_panel, "date"), "bars_quarter": _bars(tables.quarter_panel, "date"), "bars_session_day": _bars(tables.day_panel, "date"), "bars_hour": _bars(tables.hour_panel, "hour"), "bar_validity": bar_validity}
    out |= {f"factor_{k}": _query({n: FACTORS[n] for n in names}) for k, names in FAMILIES.items()}
    return out | {k: _query({k: e}) for k, e in ALPHAS.items()}


def oracle_sql() -> dict:
    out = {"bars_month": _bars_sql(tables.MONTH_SQL, "date"), "bars_quarter": _bars_sql(tables.QUARTER_SQL, "date"), "bars_session_day": _bars_sql(tables.DAY_SQL, "date"), "bars_hour": _bars_sql(tables.HOUR_SQL, "hour"), "bar_validity": BAR_VALIDITY_SQL}
    out |= {f"factor_{k}": _twin({n: FACTORS[n] for n in names}) for k, names in FAMILIES.items() if k not in NO_TWIN}
    return out | {k: _twin({k: e}) for k, e in ALPHAS.items()}

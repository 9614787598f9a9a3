"""Factors of one item's bar history: returns, momentum, volatility, volume, oscillators, candle shapes.

FACTORS maps a name to the expression over the bar columns open, high, low, close, volume, turnover.
"""

from __future__ import annotations

import math

from panelspark.plans.expr import EPS, E, absolute, add, bottom, clip, col, cumsum, delta, div, ewm, fill, given, lag, lead, ln, lit, nonzero, rcorr, roll, sign, sqrt, sub, top, when

o, h, l, c, v, a = (col(n) for n in ("open", "high", "low", "close", "volume", "turnover"))  # noqa: E741
lc = ln(clip(c, low=EPS))
r1 = delta(lc)
vwap = when(v > 0, div(a, v), c)
span = (h - l) + EPS


def realized(n: int, least: int) -> E:
    return sqrt(roll("sum", r1 * r1, n, least))


def log_zscore(x: E) -> E:
    y = ln(clip(x, low=EPS))
    return (y - roll("avg", y, 20, 5)) / nonzero(roll("std0", y, 20, 5))


def true_range() -> E:
    before = lag(c)
    return top(h - l, absolute(h - before), absolute(l - before))


def money_flow() -> E:
    price = (h + l + c) / 3
    step = delta(price)
    up = roll("sum", when(step > 0, price * v, lit(0.0)), 14)
    down = roll("sum", when(step < 0, price * v, lit(0.0)), 14)
    return 100 - 100 / (1 + up / when(down > 0, down, given(down, lit(EPS))))


def rsi(n: int = 14) -> E:
    step = delta(c)
    gain = ewm(clip(step, low=0.0), 1 / n, n)
    loss = ewm(clip(-step, low=0.0), 1 / n, n)
    return 100 - 100 / (1 + gain / nonzero(loss, 0.0))


def ema(x: E, n: int) -> E:
    return ewm(x, 2 / (n + 1))


def adx(n: int = 14) -> E:
    up, down = delta(h), -delta(l)
    plus = when(up > down, when(up > 0, up, lit(0.0)), lit(0.0))
    minus = when(down > up, when(down > 0, down, lit(0.0)), lit(0.0))
    atr = nonzero(ewm(true_range(), 1 / n, n), 0.0)
    di_plus, di_minus = 100 * ewm(plus, 1 / n, n) / atr, 100 * ewm(minus, 1 / n, n) / atr
    return ewm(100 * absolute(di_plus - di_minus) / nonzero(di_plus + di_minus, 0.0), 1 / n, n)


def cmf(n: int = 20) -> E:
    where = given(h - l, when(nonzero(h - l, 0.0) * 0 + 1 > 0, ((c - l) - (h - c)) / (h - l), lit(0.0)))
    flow, volume = roll("sum", where * v, n), roll("sum", v, n)
    return given(flow, given(volume, fill(flow / volume, 0.0)))


def stoch(n: int = 14, least: int = 5) -> E:
    low = roll("min", l, n, least)
    return (c - low) / (roll("max", h, n, least) - low)


_rv5, _rv10, _rv20 = realized(5, 3), realized(10, 5), realized(20, 8)
_ma20, _low20, _high20 = roll("avg", c, 20, 5), roll("min", c, 20, 5), roll("max", c, 20, 5)
_trend = roll("avg", c, 20, 20)
_down = clip(r1, high=0.0)
_obv = cumsum(fill(sign(delta(c)), 0.0) * v)
_ema26 = ema(c, 26)

FACTORS: dict[str, E] = {
    "log_return_1": r1,
    "intraday_return": ln(clip(c, low=EPS)) - ln(clip(o, low=EPS)),
    **{f"momentum_{k}": delta(lc, k) for k in (5, 20, 40, 60)},
    "risk_adj_mom_20": delta(lc, 20) / nonzero(roll("std0", r1, 20, 5)),
    "return_skew_20": roll("skew", r1, 20),
    "return_kurt_20": roll("kurt", r1, 20),
    "downside_vol_20": sqrt(roll("avg", _down * _down, 20)),
    "donchian_pos_20": (c - _low20) / nonzero(_high20 - _low20),
    "true_range_pct_1": true_range() / lag(c),
    "realized_vol_10": _rv10,
    "realized_vol_20": _rv20,
    "parkinson_vol_10": sqrt(roll("avg", ln(h / l) * ln(h / l), 10, 5) / (4 * math.log(2))),
    "vol_ratio_5_20": _rv5 / nonzero(_rv20),
    "vol_change_20": (_rv20 - lag(_rv20)) / nonzero(lag(_rv20)),
    "log_volume_zscore_20": log_zscore(v),
    "log_amount_zscore_20": log_zscore(a),
    "corr_price_vol_20": rcorr(r1, delta(ln(clip(v, low=EPS))), 20, 20, None),
    "volume_ma_ratio_5_20": roll("avg", v, 5, 1) / nonzero(roll("avg", v, 20, 5)),
    "amount_ma_ratio_5_20": roll("avg", a, 5, 1) / nonzero(roll("avg", a, 20, 5)),
    "amihud_illiquidity_20": roll("avg", absolute(r1) / a, 20, 5),
    "mfi_14": money_flow(),
    "obv_slope_20": delta(_obv, 20) / 20,
    "vwap_close_gap": (c - vwap) / vwap,
    "rsi_14": rsi(),
    "stoch_k_14": stoch(),
    "bollinger_z_20": (c - _ma20) / nonzero(roll("std0", c, 20, 5)),
    "ema_gap_12_26": (ema(c, 12) - _ema26) / _ema26,
    "price_ma_gap_20": (c - _ma20) / _ma20,
    "trend_slope_ma20": (_ma20 - lag(_ma20, 5)) / (5 * lag(_ma20, 5)),
    "adx_14": adx(),
    "body_ratio": absolute(c - o) / span,
    "upper_shadow_ratio": (h - top(o, c)) / span,
    "lower_shadow_ratio": (bottom(o, c) - l) / span,
    "clv_1": ((c - l) - (h - c)) / span,
    "cmf_20": cmf(),
    "bull_ratio_5": roll("avg", given(c - o, when(c > o, lit(1.0), lit(0.0))), 5),
    "log_price_ma": ln(add(1.0, clip(roll("avg", c, 3, 1), low=0.0))),
    "log_volume_ma": ln(add(1.0, clip(roll("avg", v, 3, 1), low=0.0))),
    "target_8d": sub(div(lead(c, 8), c), 1.0),
}

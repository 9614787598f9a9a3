"""Formulaic alphas: trees that alternate between an item's past and a date's cross-section.

ALPHAS maps a name to its expression over the bar columns; select(names) takes some, in any case of letters.
"""

from __future__ import annotations

from panelspark.functions.base_factors import a, c, h, l, o, v, vwap
from panelspark.plans.expr import E, absolute, csrank, delta, div, fill, given, lag, ln, lit, nonzero, rcorr, rcov, roll, rounded, scale, sign, since_max, sqrt, tsrank, when

ret = c / lag(c) - 1
adv20 = roll("avg", a, 20)
slope = (lag(c, 20) - lag(c, 10)) / 10 - (lag(c, 10) - c) / 10
reach = roll("max", h, 12) - roll("min", l, 12)


def R(x: E) -> E:
    return csrank(x)


def total(x: E, n: int) -> E:
    return roll("sum", x, n)


def mean(x: E, n: int) -> E:
    return roll("avg", x, n)


def pair_of_sums(x: E, n: int, m: int) -> E:
    """rcorr(total(x, n), total(x, m), 2): two points correlate by the signs of their changes, which for sums are x - lag(x, n) and x - lag(x, m), free of the sums' noise."""
    there = [y for k in (n, m) for y in (total(x, k), lag(total(x, k)))]
    out = sign(delta(x, n)) * sign(delta(x, m))
    for y in there:
        out = given(y, out)
    return out


def steady(x: E) -> E:
    """For ranks of sums and averages: their last bits are noise."""
    return rounded(x, 10)


_p = total(o, 5) * total(ret, 5)
_gap = vwap - c
_range5 = (h - l) / mean(c, 5)
_n, _d = R(lag(_range5, 2)) * R(R(v)), vwap - c
_trend = -delta(c)


def alpha_083() -> E:
    """A zero gap between vwap and close would divide the range by zero: the quotient is then 0 for a positive range."""
    ratio = _range5 / nonzero(_d, 0.0)
    return given(_d, given(_range5, when(absolute(_d) > 0, _n / ratio, when(_range5 > 0, given(_n, lit(0.0)), lit(None)))))


ALPHAS: dict[str, E] = {
    "alpha002": -rcorr(R(steady(delta(ln(v), 2))), R((c - o) / o), 6),
    "alpha003": -rcorr(R(o), R(v), 10),
    "alpha004": -tsrank(R(l), 9),
    "alpha005": R(steady(o - mean(vwap, 10))) * -absolute(R(steady(c - vwap))),
    "alpha006": -rcorr(o, v, 10),
    "alpha008": -R(steady(_p - lag(_p, 10))),
    "alpha011": (R(steady(roll("max", _gap, 3))) + R(steady(roll("min", _gap, 3)))) * R(delta(v, 3)),
    "alpha012": sign(delta(v)) * _trend,
    "alpha013": -R(rcov(R(c), R(v), 5)),
    "alpha014": -R(steady(delta(ret, 3))) * rcorr(o, v, 10),
    "alpha015": -total(R(rcorr(R(h), R(v), 3)), 3),
    "alpha016": -R(rcov(R(h), R(v), 5)),
    "alpha017": -R(tsrank(c, 10)) * R(delta(delta(c))) * R(tsrank(steady(v / adv20), 5)),
    "alpha018": -R(steady(roll("std1", absolute(c - o), 5) + (c - o) + rcorr(c, o, 10))),
    "alpha020": -R(o - lag(h)) * R(o - lag(c)) * R(o - lag(l)),
    "alpha022": -delta(rcorr(h, v, 5), 5) * R(steady(roll("std1", c, 20))),
    "alpha023": when(mean(h, 20) < h, fill(-delta(h, 2), 0.0), lit(0.0)),
    "alpha025": R(steady(-ret * adv20 * vwap * (h - c))),
    "alpha026": -roll("max", rcorr(tsrank(v, 5), tsrank(h, 5), 5), 3),
    "alpha030": (1 - R(sign(delta(c)) + sign(lag(delta(c))) + sign(lag(delta(c), 2)))) * total(v, 5) / total(v, 20),
    "alpha033": R(steady(-(1 - o / c))),
    "alpha034": R(steady((1 - R(steady(roll("std1", ret, 2) / roll("std1", ret, 5)))) + (1 - R(delta(c))))),
    "alpha038": -R(tsrank(c, 10)) * R(c / o),
    "alpha040": -R(steady(roll("std1", h, 10))) * rcorr(h, v, 10),
    "alpha041": sqrt(h * l) - vwap,
    "alpha042": R(steady(vwap - c)) / nonzero(R(steady(vwap + c))),
    "alpha043": tsrank(steady(v / adv20), 20) * tsrank(-delta(c, 7), 8),
    "alpha044": -rcorr(h, R(v), 5),
    "alpha045": -R(steady(total(lag(c, 5), 20) / 20)) * rcorr(c, v, 2) * R(pair_of_sums(c, 5, 20)),
    "alpha046": when(slope > 0.25, lit(-1.0), when(slope < 0, lit(1.0), _trend)),
    "alpha047": R(div(1.0, c)) * v / adv20 * (h * R(h - c) / mean(h, 5)) - R(steady(delta(vwap, 5))),
    "alpha049": when(slope < -0.1, lit(1.0), _trend),
    "alpha050": -roll("max", R(rcorr(R(v), R(steady(vwap)), 5)), 5),
    "alpha051": when(slope < -0.05, lit(1.0), _trend),
    "alpha053": -delta(((c - l) - (h - c)) / (c - l), 9),
    "alpha054": -((l - c) * o * o * o * o * o) / ((l - h) * c * c * c * c * c),
    "alpha055": -rcorr(R(steady((c - roll("min", l, 12)) / reach)), R(v), 6),
    "alpha060": scale(R(since_max(c, 10))) - 2 * scale(R(steady(((c - l) - (h - c)) / (h - l) * v))),
    "alpha083": alpha_083(),
    "alpha101": (c - o) / ((h - l) + 0.001),
}


def select(names: list[str] | None = None) -> dict[str, E]:
    if names is None:
        return dict(ALPHAS)
    wanted = {n.lower() for n in names}
    return {k: e for k, e in ALPHAS.items() if k in wanted}




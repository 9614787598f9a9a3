"""The factors that rank highest in use, against plain loops over lists from their published definitions."""

import datetime as dt
import math
import random
import statistics
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from panelspark.functions.alphas import ALPHAS
from panelspark.functions.base_factors import FACTORS
from panelspark.plans.planner import Plan

ITEMS, DAYS = 25, 75


@pytest.fixture(scope="module")
def bars():
    """bars[item][day]: open, high, low, close, volume, or None where the item has no bar."""
    r = np.random.default_rng(11)
    out = []
    for _ in range(ITEMS):
        level, own = 50.0, []
        for _ in range(DAYS):
            level *= math.exp(0.03 * r.normal())
            o, c = level * math.exp(0.01 * r.normal()), level
            own.append((o, max(o, c) * 1.02, min(o, c) * 0.97, c, float(r.integers(1, 30))) if r.random() > 0.03 else None)
        out.append(own)
    return out


@pytest.fixture(scope="module")
def computed(spark, bars):
    rows = [(f"i{i:02d}", dt.date(2024, 1, 1) + dt.timedelta(days=d), *b, b[3] * b[4]) for i, own in enumerate(bars) for d, b in enumerate(own) if b]
    df = spark.createDataFrame(rows, "item_id string, date date, open double, high double, low double, close double, volume double, turnover double")
    names = ["trend_slope_ma20", "rsi_14", "bollinger_z_20", "momentum_20"]
    out = Plan({n: FACTORS[n] for n in names} | {n: ALPHAS[n] for n in ("alpha040", "alpha044", "alpha101")}).apply(df)
    return {(int(r.item_id[1:]), (r.date - dt.date(2024, 1, 1)).days): r.asDict() for r in out.collect()}


def series(bars, k):
    """Each item's values of one field and the days they are of."""
    return [([b[k] for b in own if b], [d for d, b in enumerate(own) if b]) for own in bars]


def same(computed, name, want, digits=8):
    seen = 0
    for key, row in computed.items():
        w = want.get(key)
        assert (row[name] is None) == (w is None), (name, key, row[name], w)
        if w is not None:
            assert abs(row[name] - w) < 10**-digits, (name, key, row[name], w)
            seen += 1
    assert seen > ITEMS * 10


def share_of_rank(by_day):
    """(day -> item -> value) to (item, day) -> place among the day's values, 0 lowest to 1."""
    out = {}
    for day, values in by_day.items():
        for item, v in values.items():
            below, equal = sum(x < v for x in values.values()), sum(x == v for x in values.values())
            out[item, day] = 0.5 if len(values) == 1 else (below + (equal - 1) / 2) / (len(values) - 1)
    return out


def correlation(x, y):
    if len(set(x)) == 1 or len(set(y)) == 1:
        return 0.0
    return statistics.correlation(x, y)


def test_trend_slope(bars, computed):
    want = {}
    for i, (close, days) in enumerate(series(bars, 3)):
        mean = [statistics.fmean(close[max(0, k - 19) : k + 1]) for k in range(len(close))]  # five values are enough
        for k in range(9, len(close)):
            want[i, days[k]] = (mean[k] - mean[k - 5]) / (5 * mean[k - 5])
    same(computed, "trend_slope_ma20", want)


def test_volatility_of_highs_and_their_correlation_with_volume(bars, computed):
    by_day, both = {}, {}
    for i, ((high, days), (volume, _)) in enumerate(zip(series(bars, 1), series(bars, 4))):
        for k in range(9, len(high)):
            by_day.setdefault(days[k], {})[i] = statistics.stdev(high[k - 9 : k + 1])
            both[i, days[k]] = correlation(high[k - 9 : k + 1], volume[k - 9 : k + 1])
    place = share_of_rank(by_day)
    same(computed, "alpha040", {k: -place[k] * both[k] for k in both}, 6)


def test_correlation_of_highs_with_the_rank_of_volume(bars, computed):
    volume = {}
    for i, (v, days) in enumerate(series(bars, 4)):
        for x, d in zip(v, days):
            volume.setdefault(d, {})[i] = x
    place, want = share_of_rank(volume), {}
    for i, (high, days) in enumerate(series(bars, 1)):
        for k in range(4, len(high)):
            want[i, days[k]] = -correlation(high[k - 4 : k + 1], [place[i, d] for d in days[k - 4 : k + 1]])
    same(computed, "alpha044", want, 6)


def test_strength_of_gains(bars, computed):
    want = {}
    for i, (close, days) in enumerate(series(bars, 3)):
        gain = loss = None
        for k in range(1, len(close)):
            up, down = max(close[k] - close[k - 1], 0.0), max(close[k - 1] - close[k], 0.0)
            gain, loss = (up, down) if gain is None else (gain + (up - gain) / 14, loss + (down - loss) / 14)
            if k >= 14:
                want[i, days[k]] = 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
    same(computed, "rsi_14", want)


def test_momentum_bands_and_bodies(bars, computed):
    momentum, band, body = {}, {}, {}
    for i, ((o, days), (h, _), (low, _), (close, _)) in enumerate(zip(*(series(bars, k) for k in range(4)))):
        for k, day in enumerate(days):
            body[i, day] = (close[k] - o[k]) / ((h[k] - low[k]) + 0.001)
            if k >= 20:
                momentum[i, day] = math.log(close[k]) - math.log(close[k - 20])
            if k >= 4:
                own = close[max(0, k - 19) : k + 1]
                band[i, day] = (close[k] - statistics.fmean(own)) / statistics.pstdev(own)
    same(computed, "momentum_20", momentum)
    same(computed, "bollinger_z_20", band, 6)
    same(computed, "alpha101", body)


def test_alpha045_ranks_no_noise_of_sums(spark):
    """Prices that come back after five days leave their sums as they were: fractions say so, sums of doubles do not."""
    r = random.Random(4)
    rows = []
    for i in range(12):
        cycle = [(r.randint(90_000, 210_000), r.randint(1, 50)) for _ in range(5)]
        for d in range(40):
            cents, n = cycle[d % 5] if i % 3 or d < 30 else (r.randint(90_000, 210_000), r.randint(1, 50))
            rows.append((i, d, Fraction(cents, 100 * n), cents / 100 / n, float(r.randint(1, 9))))
    exact = {(i, d): (c, v) for i, d, c, _, v in rows}
    sign = lambda x: (x > 0) - (x < 0)

    def summed(i, d, n):
        return sum(exact[i, d - k][0] for k in range(n))

    want = {}
    for d in range(24, 40):
        mean = share_of_rank({d: {i: summed(i, d - 5, 20) for i in range(12)}})
        pair = share_of_rank({d: {i: sign(summed(i, d, 5) - summed(i, d - 1, 5)) * sign(summed(i, d, 20) - summed(i, d - 1, 20)) for i in range(12)}})
        for i in range(12):
            (c, v), (c0, v0) = exact[i, d], exact[i, d - 1]
            want[i, d] = -mean[i, d] * sign(c - c0) * sign(v - v0) * pair[i, d]
    start = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(f"{i}", start + dt.timedelta(d), c, v) for i, d, _, c, v in rows], "item_id string, date date, close double, volume double")
    plan = Plan({"alpha045": ALPHAS["alpha045"]})
    mine = {(int(x.item_id), (x.date - start).days): x.alpha045 for x in plan.apply(df).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE bars (item_id VARCHAR, date DATE, close DOUBLE, volume DOUBLE)")
    con.executemany("INSERT INTO bars VALUES (?, ?, ?, ?)", [(f"{i}", start + dt.timedelta(d), c, v) for i, d, _, c, v in rows])
    theirs = {(int(i), (d - start).days): x for i, d, x in con.execute(f"SELECT item_id, date, alpha045 FROM ({plan.sql('bars')})").fetchall()}
    for got in (mine, theirs):
        assert {k for k, x in got.items() if x is not None} == set(want)
        assert all(abs(got[k] - w) < 1e-9 for k, w in want.items())

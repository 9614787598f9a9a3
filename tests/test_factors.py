"""Rolling, recursive and cross-sectional semantics against pandas and hand-made frames."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelspark.functions.alphas import ALPHAS, select
from panelspark.functions.base_factors import FACTORS, adx
from panelspark.operators import cross
from panelspark.plans.expr import absolute, col, csrank, cumsum, ewm, lag, rcorr, rcov, roll, scale, since_max, tsrank
from panelspark.plans.planner import Plan


def panel(n_items=3, n_days=70, seed=0, gaps=0.1):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n_items):
        c = 100 * np.exp(np.cumsum(r.normal(0, 0.02, n_days)))
        for d in range(n_days):
            o, x = c[d] * (1 + r.normal(0, 0.01)), c[d]
            rows.append((str(i), dt.date(2024, 1, 1) + dt.timedelta(d), o, max(o, x) * 1.01, min(o, x) * 0.99, x, float(r.integers(1, 1000)), float(r.integers(1, 100000)), None if r.random() < gaps else float(r.normal())))
    return pd.DataFrame(rows, columns=["item_id", "date", "open", "high", "low", "close", "volume", "turnover", "x"])


@pytest.fixture(scope="module")
def frame(spark):
    p = panel()
    df = spark.createDataFrame(p)
    return p, df.withColumn("x", F.nanvl("x", F.lit(None).cast("double"))).cache()


def run(df, outputs):
    return Plan(outputs).apply(df).toPandas().sort_values(["item_id", "date"]).reset_index(drop=True)


def same(a, b, tol=1e-9):
    np.testing.assert_allclose(a.to_numpy(dtype=float), b.to_numpy(dtype=float), rtol=tol, atol=tol, equal_nan=True)


def by_item(p, f):
    return p.groupby("item_id", group_keys=False).apply(f, include_groups=False).reset_index(drop=True)


@pytest.mark.parametrize("kind, fn", [("avg", "mean"), ("sum", "sum"), ("min", "min"), ("max", "max"), ("std1", "std"), ("skew", "skew"), ("kurt", "kurt")])
def test_rolling(frame, kind, fn):
    p, df = frame
    got = run(df, {"r": roll(kind, col("x"), 10, 6)})
    same(got.r, by_item(p, lambda g: getattr(g.x.rolling(10, min_periods=6), fn)()), 1e-7)


def test_rolling_population_spread_and_prefix_sum(frame):
    p, df = frame
    got = run(df, {"s": roll("std0", col("close"), 10, 4), "c": cumsum(col("volume"))})
    same(got.s, by_item(p, lambda g: g.close.rolling(10, min_periods=4).std(ddof=0)), 1e-7)
    same(got.c, by_item(p, lambda g: g.volume.cumsum()))


@pytest.mark.parametrize("alpha, least", [(1 / 14, 14), (2 / 13, 0), (0.5, 1)])
def test_recursive_mean_with_gaps(frame, alpha, least):
    p, df = frame
    got = run(df, {"r": ewm(col("x"), alpha, least)})
    same(got.r, by_item(p, lambda g: g.x.ewm(alpha=alpha, adjust=False, min_periods=least).mean()), 1e-12)


@pytest.mark.parametrize("alpha", [1e-6, 1 / 14, 0.5, 0.97, 1.0])
def test_recursive_mean_of_long_and_sparse_series(spark, alpha):
    """Against the recursion over the whole prefix: thousands of rows, gaps of hundreds, values of very different size, all missing."""
    r = np.random.default_rng(7)
    n = 3_000
    day = [dt.date(2000, 1, 1) + dt.timedelta(days=k) for k in range(n)]
    x = {"dense": r.normal(size=n), "sparse": np.where(r.random(n) < 0.02, r.normal(size=n) * 1e6, np.nan), "late": np.where(np.arange(n) < 2_500, np.nan, 1.0), "none": np.full(n, np.nan), "sizes": 10.0 ** r.integers(-12, 12, n)}
    p = pd.DataFrame([(k, d, v) for k, vs in x.items() for d, v in zip(day, vs)], columns=["item_id", "date", "x"])
    df = spark.createDataFrame([(k, d, None if np.isnan(v) else float(v)) for k, d, v in p.itertuples(index=False)], "item_id string, date date, x double")
    plan = Plan({"r": ewm(col("x"), alpha, 14)})
    got = plan.apply(df).toPandas().sort_values(["item_id", "date"])
    want = p.sort_values(["item_id", "date"]).groupby("item_id").x.transform(lambda g: g.ewm(alpha=alpha, adjust=False, min_periods=14).mean())
    np.testing.assert_allclose(got.r.to_numpy(float), want.to_numpy(float), rtol=1e-9)
    text = plan.apply(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.exchanges == 1 and text.count("Exchange hashpartitioning") == 1 and "collect_list" not in text


def test_correlations_in_pairs(frame):
    p, df = frame
    got = run(df, {"c": rcorr(col("x"), col("close"), 12, 8), "v": rcov(col("x"), col("close"), 12), "flat": rcorr(col("x") * 0, col("close"), 5, 3)})
    same(got.c, by_item(p, lambda g: g.x.rolling(12, min_periods=8).corr(g.close.where(g.x.notna()))), 1e-7)
    same(got.v, by_item(p, lambda g: g.x.rolling(12, min_periods=12).cov(g.close.where(g.x.notna()))), 1e-7)
    assert set(got.flat.dropna()) == {0.0}


def test_ranks_in_time_and_distance_to_the_greatest(frame):
    p, df = frame
    got = run(df, {"t": tsrank(col("volume"), 7), "m": since_max(col("volume"), 7), "g": tsrank(col("x"), 7)})
    rank = lambda w: (pd.Series(w).rank().iloc[-1] - 1) / (len(w) - 1)
    same(got.t, by_item(p, lambda g: g.volume.rolling(7).apply(rank, raw=True)))
    same(got.g, by_item(p, lambda g: g.x.rolling(7).apply(rank, raw=True)))
    same(got.m, by_item(p, lambda g: g.volume.rolling(7).apply(lambda w: len(w) - 1 - int(np.argmax(w)), raw=True)))


def smoothed(values, n):
    """Wilder's running mean, one value after the other; nothing until n values have come."""
    out, mean, seen = [], None, 0
    for value in values:
        if value is not None:
            seen += 1
            mean = value if mean is None else mean + (value - mean) / n
        out.append(mean if seen >= n else None)
    return out


def directional_index(bars, n=14):
    """Wilder's definition, bar by bar: the larger of today's two moves outside yesterday's range counts, if it is outside at all."""
    rises, falls, ranges, last = [], [], [], None
    for bar in bars:
        rise, fall, reach = 0.0, 0.0, bar.high - bar.low
        if last is not None:
            over, under = bar.high - last.high, last.low - bar.low
            rise, fall = (over if over > max(under, 0.0) else 0.0), (under if under > max(over, 0.0) else 0.0)
            reach = max(bar.high, last.close) - min(bar.low, last.close)
        rises.append(rise), falls.append(fall), ranges.append(reach)
        last = bar
    strength = []
    for rise, fall, reach in zip(*(smoothed(x, n) for x in (rises, falls, ranges))):
        strength.append(None if not reach or rise + fall == 0 else 100 * abs(rise - fall) / (rise + fall))
    return smoothed(strength, n)


def test_directional_index(frame):
    p, df = frame
    want = [v for _, g in p.groupby("item_id") for v in directional_index(list(g.sort_values("date").itertuples()))]
    same(run(df, {"r": adx()}).r, pd.Series([np.nan if v is None else v for v in want]), 1e-9)


def test_roles_name_the_features(frame):
    from panelspark.operators import roles

    df = roles.with_roles(frame[1], key=["item_id", "date"], feature=["close", "volume"], target=["x"])
    assert roles.columns(df.withColumn("label", F.col("x"))) == ["close", "volume"] and roles.columns(df, "key") == ["item_id", "date"]
    with pytest.raises(ValueError):
        roles.with_roles(df, feature=["nowhere"])


def test_every_factor_and_alpha_has_values(spark):
    df = spark.createDataFrame(panel(25, 90, 3, 0)).cache()
    got = run(df, {**FACTORS, **ALPHAS})
    empty = [c for c in got.columns if got[c].notna().sum() == 0]
    assert not empty and not np.isinf(got.drop(columns=["item_id", "date"]).to_numpy(dtype=float)).any()
    assert set(select(["ALPHA101", "alpha003"])) == {"alpha101", "alpha003"} and len(ALPHAS) == 40


def test_flat_and_zero_input_gives_null_not_errors(spark):
    p = panel(2, 40, 1, 0)
    for c in ("open", "high", "low", "close", "volume", "turnover"):
        p[c] = 0.0 if c in ("volume", "turnover") else 5.0
    run(spark.createDataFrame(p), {**FACTORS, **ALPHAS})
    p["close"] = p["open"] = p["high"] = p["low"] = 0.0
    run(spark.createDataFrame(p), {**FACTORS, **ALPHAS})


def test_planner_batches_levels(frame):
    _, df = frame
    whole = Plan({**FACTORS, **ALPHAS})
    axes = [a for a, _ in whole.levels]
    assert whole.exchanges == sum(x != y for x, y in zip(axes, [None, *axes])) <= 6
    text = Plan({k: ALPHAS[k] for k in ("alpha006", "alpha012", "alpha041", "alpha101")}).apply(df)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Python" not in text
    shared = Plan({"a": roll("avg", col("close"), 5) + 1, "b": roll("avg", col("close"), 5) * 2})
    assert len(shared.windows) == 1


@settings(max_examples=20, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=15))
def test_cross_sectional_rank(spark, xs):
    df = spark.createDataFrame([(str(i), dt.date(2024, 1, 1), None if x is None else float(x)) for i, x in enumerate(xs)], "item_id string, date date, x double")
    got = {r.item_id: (r.r, r.s) for r in Plan({"r": csrank(col("x")), "s": scale(col("x"))}).apply(df).collect()}
    s = pd.Series(xs, dtype=float)
    n = s.notna().sum()
    want = (s.rank() - 1) / (n - 1) if n > 1 else s * 0 + 0.5
    total = s.abs().sum()
    for i, w in enumerate(want):
        assert (got[str(i)][0] is None) == bool(np.isnan(w)) and (np.isnan(w) or abs(got[str(i)][0] - w) < 1e-12 and 0 <= w <= 1)
        assert np.isnan(w) or abs(got[str(i)][1] - (s[i] / total if total else 0)) < 1e-12


def test_neutralized_residuals_are_orthogonal(spark):
    r = np.random.default_rng(1)
    rows = [(str(i), dt.date(2024, 1, 1 + d), float(r.normal()), float(r.normal()), float(r.normal())) for d in range(3) for i in range(40 if d else 3)]
    df = spark.createDataFrame(rows, "item_id string, date date, f double, log_price_ma double, log_volume_ma double")
    got = cross.ols_neutralize(df, ["f"]).toPandas()
    for d, g in got.groupby("date"):
        if len(g) <= 3:
            assert g.f_n.isna().all()
            continue
        x = np.column_stack([np.ones(len(g)), g.log_price_ma, g.log_volume_ma])
        res = g.f - x @ np.linalg.lstsq(x, g.f, rcond=None)[0]
        np.testing.assert_allclose(g.f_n, (res - res.mean()) / res.std(ddof=0), atol=1e-10)
        assert abs(g.f_n @ g.log_price_ma) < 1e-9 and abs(g.f_n.std(ddof=0) - 1) < 1e-12
    same_x = df.withColumn("log_volume_ma", df.log_price_ma * 2)
    assert cross.ols_neutralize(same_x, ["f"]).where("f_n IS NULL").count() == 3


def test_winsorize_takes_the_median(spark):
    df = spark.createDataFrame([(str(i), dt.date(2024, 1, 1), x) for i, x in enumerate([1.0, 2.0, 3.0, 4.0, 100.0, None])], "item_id string, date date, f double")
    assert [r.f for r in cross.mad_winsorize(df, ["f"]).orderBy("item_id").collect()] == [1.0, 2.0, 3.0, 4.0, 3.0, None]


def test_labels(spark):
    assert lag(absolute(col("x"))).key == "lag(abs(x), 1)"
    df = spark.createDataFrame([(0.005,), (0.02,), (-0.5,), (None,)], "t double")
    assert [r[0] for r in df.select(cross.updown(df.t)).collect()] == [1.0, 2.0, 0.0, 1.0]
    p = spark.createDataFrame([(x,) for x in (0.1, 0.4, 0.69, 0.7, 0.9, 0.97, 1.0, None)], "p double")
    assert [r[0] for r in p.select(cross.bucketize(p.p)).collect()] == [0.0, 1.0, 1.0, 3.0, 7.0, 10.0, 10.0, None]

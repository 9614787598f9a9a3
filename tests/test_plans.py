"""Ranges of dates below the windows, factors of users, as-of joins."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions.alphas import ALPHAS
from panelspark.functions.base_factors import FACTORS
from panelspark.operators import asof
from panelspark.operators.ranking import RankModel
from panelspark.operators.trees import Tree
from panelspark.plans.expr import col, csrank, ewm, lag, lead, roll
from panelspark.plans.planner import Plan
from panelspark.plans.registry import Registry


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    """Items of which some miss many dates, as a table with dates in its statistics."""
    r = np.random.default_rng(1)
    rows = []
    for i in range(12):
        level = 100.0
        for d in range(300):
            if i % 3 == 0 and r.random() < 0.7:
                continue
            level *= 1 + 0.02 * r.normal()
            o, c = level * (1 + 0.01 * r.normal()), level
            rows.append((f"i{i:02d}", dt.date(2023, 1, 1) + dt.timedelta(days=d), o, max(o, c) * 1.01, min(o, c) * 0.99, c, float(r.integers(1, 50)), float(r.integers(100, 900))))
    path = f"file://{tmp_path_factory.mktemp('panel')}/p"
    spark.createDataFrame(rows, "item_id string, date date, open double, high double, low double, close double, volume double, turnover double").write.parquet(path)
    return spark.read.parquet(path)


def values(df):
    return {(r.item_id, r.date): tuple(None if v is None else round(v, 9) for v in r[2:]) for r in df.collect()}


def test_rows_that_trees_reach():
    c = col("close")
    assert Plan({"a": roll("avg", c, 5)}).reach() == [(4, 0)]
    assert Plan({"a": roll("avg", lag(c, 3), 5) + lead(c, 2)}).reach() == [(7, 2)]
    assert Plan({"a": lag(csrank(roll("avg", c, 5)), 2), "b": lag(c, 9)}).reach() == [(9, 0), (4, 0)]
    assert Plan({"a": ewm(c, 0.5), "b": c}).unbounded() == ["a"] and Plan({"b": c}).reach() == [(0, 0)]
    whole = {n for n, e in FACTORS.items() if Plan({n: e}).unbounded()}
    assert whole == {"rsi_14", "ema_gap_12_26", "adx_14", "obv_slope_20"}


def test_range_of_dates_equals_the_whole_plan(spark, panel):
    outputs = {n: FACTORS[n] for n in ("momentum_20", "return_skew_20", "bollinger_z_20", "target_8d")} | {n: ALPHAS[n] for n in ("alpha002", "alpha015")}
    plan = Plan(outputs)
    start, end = "2023-07-01", "2023-07-20"
    got = plan.between(panel, start, end)
    want = plan.apply(panel).where(F.col("date").between(start, end))
    assert values(got) == values(want) and got.count() > 100
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date," in text.replace("IsNotNull(date),GreaterThanOrEqual", "IsNotNull(date), GreaterThanOrEqual") and "LessThanOrEqual(date,2023-07-20)" not in text
    open_end = Plan({"m": FACTORS["momentum_5"]})
    assert values(open_end.between(panel, start, None, ["item_id", "date"])) == values(open_end.apply(panel).where(F.col("date") >= start))
    assert values(open_end.between(panel, "2022-01-01", "2023-01-09")) == values(open_end.apply(panel).where(F.col("date") <= "2023-01-09"))
    assert open_end.between(panel, "2030-01-01", None).count() == 0
    with pytest.raises(ValueError, match="rsi_14"):
        Plan({"rsi_14": FACTORS["rsi_14"], "m": FACTORS["momentum_5"]}).between(panel, start, end)


def test_factors_of_users(spark, panel):
    mine = Registry({**FACTORS, **ALPHAS})

    @mine.factor("calm", deps=["momentum_20", "realized_vol_20"], window=4)
    def calm(momentum, vol):
        return roll("avg", momentum / vol, 5, 1)

    @mine.factor("calmer", deps=["calm", "close"])
    def calmer(calm, close):
        return calm * 2 + close * 0

    @mine.vectorised("tanh_momentum", deps=["momentum_20"])
    def tanh_momentum(x):
        return np.tanh(x)

    @mine.vectorised("spread", deps=["close", "open"], window=3)
    def spread(c, o):
        return float((c - o).max())

    plan = mine.plan(["calmer", "momentum_20", "tanh_momentum", "spread"])
    assert plan.exchanges == mine.plan(["momentum_20"]).exchanges == 1
    text = plan.apply(panel)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    got = plan.apply(panel).toPandas().sort_values(["item_id", "date"]).reset_index(drop=True)
    base = Plan({"m": FACTORS["momentum_20"], "v": FACTORS["realized_vol_20"], "s": col("close") - col("open")}).apply(panel).toPandas().sort_values(["item_id", "date"]).reset_index(drop=True)
    by = base.groupby("item_id")
    np.testing.assert_allclose(got.calmer, 2 * by.apply(lambda g: (g.m / g.v.replace(0, np.nan)).rolling(5, 1).mean(), include_groups=False).to_numpy(), atol=1e-9)
    np.testing.assert_allclose(got.tanh_momentum, np.tanh(base.m))
    np.testing.assert_allclose(got.spread, by.s.rolling(3, 1).max().to_numpy())
    assert set(mine.names()) >= {"calm", "rsi_14"}


def test_registry_refuses(spark):
    mine = Registry(FACTORS)
    mine.factor("a", deps=["b"])(lambda b: b + 1)
    mine.factor("b", deps=["c"])(lambda c: c * 2)
    mine.factor("c", deps=["a"])(lambda a: a)
    with pytest.raises(ValueError, match="a -> b -> c -> a"):
        mine.plan(["a"])
    mine.factor("d", deps=["nowhere"])(lambda x: x)
    with pytest.raises(ValueError, match="nowhere.*needed by d"):
        mine.tree("d")
    with pytest.raises(ValueError, match="there already"):
        mine.factor("rsi_14", deps=["close"])(lambda c: c)
    mine.factor("far", deps=["momentum_60"], window=3)(lambda m: lag(m, 4))
    with pytest.raises(ValueError, match="window of 3"):
        mine.tree("far")
    mine.factor("near", deps=["momentum_60"], window=4)(lambda m: lag(m, 4))
    assert Plan({"near": mine.tree("near")}).reach() == [(64, 0)]


def test_asof_join_against_pandas(spark):
    r = np.random.default_rng(2)
    start = dt.datetime(2024, 1, 1)
    left = pd.DataFrame({"k": r.choice(["hot", "hot", "a", "b", "c"], 400), "t": start + pd.to_timedelta(r.integers(0, 90 * 24, 400), "h"), "n": range(400)}).sort_values("t")
    right = pd.DataFrame({"k": r.choice(["hot", "hot", "a", "b"], 150), "seen": start + pd.to_timedelta(r.choice(90 * 24, 150, replace=False), "h"), "v": r.normal(size=150)}).sort_values("seen")
    plain = lambda p: [tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in x) for x in p.itertuples(index=False, name=None)]
    a = spark.createDataFrame([*plain(left), (None, start, 900), ("a", None, 901)], "k string, t timestamp, n int")
    b = spark.createDataFrame([*plain(right), (None, start, 1.0), ("a", None, 2.0)], "k string, seen timestamp, v double")
    for within, stretch in ((None, 5 * 86_400), (3 * 86_400.0, 86_400), (None, 1e9)):
        got = {x.n: (x.seen, x.v) for x in asof.asof_join(a, b, ["k"], "t", "seen", ["v"], within, stretch).collect()}
        joined = pd.merge_asof(left, right, left_on="t", right_on="seen", by="k", tolerance=None if within is None else pd.Timedelta(seconds=within))
        want = {x.n: (None, None) if pd.isna(x.seen) else (x.seen.to_pydatetime(), x.v) for x in joined.itertuples()}
        assert got == want | {900: (None, None), 901: (None, None)}
    assert asof.asof_join(a.limit(0), b, ["k"], "t", "seen", ["v"]).count() == 0 and asof.asof_join(a, b.limit(0), ["k"], "t", "seen", ["v"]).where("v IS NULL").count() == 402
    ties = spark.createDataFrame([("a", start, 1.0), ("a", start, 3.0), ("a", start, 2.0)], "k string, seen timestamp, v double")
    assert asof.asof_join(a.where("n = 900").withColumn("k", F.lit("a")), ties, ["k"], "t", "seen", ["v"]).first().v == 3.0
    with pytest.raises(ValueError, match="both sides"):
        asof.asof_join(a, b.withColumnRenamed("v", "n"), ["k"], "t", "seen", ["n"])


def stump(low, high):
    t = Tree()
    t.leaf(0.0, 2.0)
    t.split(0, 0, 0.5, (low, 1.0), (high, 1.0))
    return t


def test_scores_by_the_model_of_the_day(spark):
    rows = [(f"i{k:02d}", dt.date(2024, 1, d), k / 30, None if k == 3 and d == 5 else 1.0 - k / 30) for k in range(30) for d in (2, 5, 9)]
    df = spark.createDataFrame(rows, "item_id string, date date, x double, y double")
    models = [("2024-01-08", RankModel([stump(5.0, 7.0)], ["y"])), ("2024-01-04", RankModel([stump(1.0, 2.0), stump(10.0, 20.0)], ["x"]))]
    got = {(r.item_id, r.date.day): (r.valid_from, r.score) for r in asof.scored_asof(df, models).collect()}
    want = {(i, d.day): ("2024-01-04", 11.0 if x <= 0.5 else 22.0) if d.day == 5 else ("2024-01-08", 5.0 if y <= 0.5 else 7.0) for i, d, x, y in rows if d.day > 2}
    assert got == want
    batch = asof.batch_scores(df.where("date <> '2024-01-09' OR item_id < 'i19'"), models).collect()
    high = sum(k / 30 > 0.5 for k in range(30))
    assert {r.date.day for r in batch} == {5} and len(batch) == 30 and abs(max(r.rank_pct for r in batch) - (30 - (high - 1) / 2) / 30) < 1e-12
    live = asof.live_scores(df, models, "2024-01-07", names=spark.createDataFrame([("i29", "last")], "item_id string, name string")).collect()
    by = {r.item_id: r for r in live}
    assert len(live) == 30 and by["i03"].as_of == dt.date(2024, 1, 2) and by["i04"].as_of == dt.date(2024, 1, 5)  # i03 lacked y on the fifth
    assert live[0].score == 22.0 and by["i29"].name == "last" and by["i04"].name == "i04" and {r.valid_from for r in live} == {"2024-01-04"}
    assert {r.item_id for r in asof.live_scores(df, models, "2024-01-07", days=3).collect()} == {f"i{k:02d}" for k in range(30) if k != 3}
    with pytest.raises(ValueError):
        asof.scored_asof(df, [])

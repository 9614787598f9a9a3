"""Splits, statistics, backtests, merges, mapping, sources, models: small frames with known answers."""

import datetime as dt
import json
import math

import numpy as np
import pytest

from panelspark.operators import backtest, mapping, merge, models, quality, splits, stats
from panelspark.operators.bars import faults, from_candles
from panelspark.sources import files, paged

DAY = dt.date(2024, 1, 1)


def days(spark, n):
    return spark.createDataFrame([("a", DAY + dt.timedelta(i)) for i in range(n)], "item_id string, date date")


def test_purged_folds_leave_no_overlap(spark):
    f = splits.purged_kfold(days(spark, 53), 5, 8, 2)
    rows = f.collect()
    for k in range(5):
        test = [r.date for r in rows if r.fold == k and r.role == "test"]
        assert len(test) == (11 if k < 3 else 10)
        for r in rows:
            if r.fold == k and r.role == "train":
                assert r.date + dt.timedelta(8) < min(test) or r.date > max(test) + dt.timedelta(10)
    assert splits.leaks(f, 8).count() == 0 and splits.purged_kfold(days(spark, 14), 5).count() == 0
    assert splits.validation_tail(f, 0.2).where("role = 'val'").count() > 0


def test_chronological_split_edges(spark):
    for n in (3, 4, 10, 101):
        got = {r.role: r.n for r in splits.chronological(days(spark, n)).groupBy("role").count().withColumnRenamed("count", "n").collect()}
        assert sum(got.values()) == n and min(got[r] for r in ("train", "val", "test")) >= 1
    assert splits.chronological(days(spark, 2)).count() == 0
    w = splits.walk_forward(days(spark, 100), 60, 20, 10).groupBy("fold", "role").count().collect()
    assert {(r.fold, r.role): r["count"] for r in w} == {(1, "train"): 60, (1, "test"): 20, (2, "train"): 70, (2, "test"): 20, (3, "train"): 80, (3, "test"): 20}


def test_published_constants(spark):
    assert abs(stats.t_p_value(spark, 7.99, 4) - 0.00133) < 5e-6
    assert abs(stats.expected_maximum(spark, 0.0236, 9) - 0.0359) < 5e-5
    d = [0.0627, -0.0152, 0.0357, -0.0138, 0.0349]
    r = stats.paired_tests(spark.createDataFrame([(0.0, x) for x in d], "a double, b double"), "a", "b").first()
    assert abs(r.t - 1.366) < 2e-3 and abs(r.p_t - 0.2437) < 1e-3 and (r.w, r.p_w) == (3.0, 0.3125) and r.win_rate == 0.6 and r.verdict == "slightly better"
    dsr = stats.deflated_sharpe(spark.createDataFrame([(x,) for x in (0.010, 0.042, 0.059, 0.044, 0.039, 0.041, 0.059, 0.085, 0.010)], "value double"), observed=0.059).first()
    assert abs(dsr.sigma - 0.0236) < 1e-4 and abs(dsr.e_max - 0.0359) < 1e-4 and dsr.verdict == "real"
    assert stats.deflated_sharpe(spark.createDataFrame([(1.0,)], "value double")).first().verdict == "insufficient data"


def fold_by_hand(rets, config):
    cash, open_, out = config.initial, [], []
    for i, r in enumerate(rets):
        cash += sum(a * (1 + x) for due, a, x in open_ if due == i)
        open_ = [t for t in open_ if t[0] != i]
        stake = config.initial / config.build_up if i < config.build_up else cash
        if r is not None and stake > 0:
            cash -= stake
            open_.append((i + config.holding, stake, r))
        out.append(cash + sum(a for _, a, _ in open_))
    out[-1] = cash + sum(a * (1 + x) for _, a, x in open_)
    return out


def test_equity_curve(spark):
    c = backtest.Config(holding=3, top_n=1, build_up=3)
    rets = [0.1, None, -0.2, 0.05, 0.0, None, 0.3, -0.1, 0.02, 0.4]
    t = spark.createDataFrame([(DAY + dt.timedelta(i), r) for i, r in enumerate(rets) if r is not None], "date date, ret double")
    got = [r.value for r in backtest.equity_curve(t, days(spark, len(rets)).select("date"), c).orderBy("date").collect()]
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, fold_by_hand(rets, c)))
    flat = t.withColumn("ret", t.ret * 0)
    assert all(abs(r.value - 1) < 1e-12 for r in backtest.equity_curve(flat, days(spark, 10).select("date"), c).collect())
    for wrong in ({"initial": 0}, {"commission": 1.0}, {"holding": 0}):
        with pytest.raises(ValueError):
            backtest.Config(**wrong)


def test_performance(spark):
    v = [1.0, 1.1, 0.99, 1.2]
    r = backtest.performance(spark.createDataFrame([(DAY + dt.timedelta(i), x) for i, x in enumerate(v)], "date date, value double")).first()
    d = [v[i] / v[i - 1] - 1 for i in range(1, 4)]
    sd = math.sqrt(sum((x - sum(d) / 3) ** 2 for x in d) / 3)
    assert abs(r.total_return - 0.2) < 1e-12 and abs(r.volatility - sd * math.sqrt(365)) < 1e-9 and abs(r.max_drawdown - 0.1) < 1e-12


def test_session_bars(spark):
    t = lambda h, m, s=0, d=2: dt.datetime(2024, 1, d, h, m, s)
    rows = [("a", t(6, 59, 59), 1.0, 3.0, 1.0, 2.0, 5.0, 1.0), ("a", t(7, 0), None, 9.0, 4.0, 5.0, None, None), ("a", t(8, 0), 6.0, 7.0, 2.0, None, None, None)]
    df = spark.createDataFrame(rows, "item_id string, ts timestamp, o double, h double, l double, c double, v double, turnover double")
    got = {r.date.day: r for r in from_candles(df).collect()}
    assert got[1].close == 2.0 and got[1].volume == 5.0
    assert (got[2].open, got[2].high, got[2].low, got[2].close, got[2].volume, got[2].obs) == (6.0, 9.0, 2.0, 5.0, 0.0, 2)
    bad = spark.createDataFrame([(1.0, 2.0, 3.0, -1.0, -2.0), (1.0, 2.0, 1.0, 1.0, None)], "open double, high double, low double, close double, volume double")
    assert [r.f for r in bad.select(faults().alias("f")).collect()] == [["close not positive", "high below low", "negative volume"], ["missing field"]]


def test_merges(spark):
    old = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 5.0)], "item_id string, t long, v double")
    new = spark.createDataFrame([("a", 2, 4.0), ("a", 3, 7.0), ("a", 9, 1.0), ("b", 2, 5.0)], "item_id string, t long, v double")
    got = sorted(map(tuple, merge.upsert_closed(old, new, ["item_id", "t"], "t", 9).collect()))
    assert got == [("a", 1, 1.0), ("a", 2, 4.0), ("a", 3, 7.0), ("b", 2, 5.0)]
    assert sorted(map(tuple, merge.upsert_closed(spark.createDataFrame(got, old.schema), new, ["item_id", "t"], "t", 9).collect())) == got
    assert tuple(merge.upsert_stats(old, new, ["item_id", "t"], "t", 9).first()) == (1, 2, 1, 2)
    assert sorted(map(tuple, merge.upsert_larger(old, new, ["item_id", "t"], "v").collect())) == [("a", 1, 1.0), ("a", 2, 5.0), ("a", 3, 7.0), ("a", 9, 1.0), ("b", 2, 5.0)]
    assert merge.open_from(7_300_000, "1H") == 7_200_000 and merge.open_from(90_000_000, "1D", 25_200_000) == 25_200_000
    with pytest.raises(ValueError):
        merge.open_from(0, "1W")
    items, sizes = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 200_000), ("b", 5)], "k string, length long")
    assert [r.k for r in merge.already_done(items, sizes, "k").collect()] == ["b"]


def test_ids_do_not_collide_on_a_second_run(spark):
    starts = spark.createDataFrame([("x", 100)], "seg string, start long")
    one = mapping.assign_ids(spark.createDataFrame([("x", "b"), ("x", "a")], "seg string, name string"), ["seg"], ["name"], starts)
    two = mapping.assign_ids(spark.createDataFrame([("x", "A")], "seg string, name string"), ["seg"], ["name"], starts, one.select("seg", "id"))
    assert sorted((r.name, r.id) for r in one.union(two).collect()) == [("A", 102), ("a", 100), ("b", 101)]


def lines_of(spark, text):
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "pos int, line string")


def test_text_blocks(spark):
    t = lines_of(spark, "//a\n1: x\n//mine\n2: y")
    block = spark.createDataFrame([(0, "//new"), (1, "9: z")], "pos int, line string")
    assert [r.line for r in mapping.insert_before(t, block, "//mine").collect()] == ["//a", "1: x", "//new", "9: z", "//mine", "2: y"]
    assert [r.line for r in mapping.insert_before(t, block, "//none").collect()][-2:] == ["//new", "9: z"]
    body = spark.createDataFrame([(0, "7: q")], "pos int, line string")
    assert [r.line for r in mapping.replace_section(t, "//a", body).collect()] == ["//a", "7: q", "//mine", "2: y"]
    assert [r.line for r in mapping.replace_section(t, "//mine", body).collect()] == ["//a", "1: x", "//mine", "7: q"]


def test_sections_strict_and_loose(spark):
    t = lines_of(spark, "0：lost\n//one\n1：first\n//total: 5\n2: second name\n\n3 third\n//\n4: x\n1: again")
    strict = {r.item_id: r.section for r in files.sections(t).collect()}
    loose = {r.item_id: r.section for r in files.sections(t, strict=False).collect()}
    assert strict == {"2": "one", "3": "one", "4": "UNKNOWN", "1": "UNKNOWN"}
    assert loose == {"1": "UNKNOWN", "2": "total: 5", "4": "UNKNOWN"}
    assert {r.item_id: r.name for r in files.id_names(t).collect()} == {"0": "lost", "1": "again", "2": "second name", "3": "third", "4": "x"}


def test_candle_files(spark, tmp_path):
    (tmp_path / "7.json").write_text(json.dumps([{"t": 1704067200000, "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 3, "turnover": 4}, {"t": "bad", "o": 1, "h": 1, "l": 1, "c": 1}]))
    (tmp_path / "8.json").write_text("[]")
    rows = files.candle_json(spark, str(tmp_path)).collect()
    assert [(r.item_id, r.o, r.c, r.turnover) for r in rows] == [("7", 1.0, 1.5, 4.0)] and rows[0].ts == dt.datetime(2024, 1, 1)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "9.json").write_text(json.dumps([{"t": 1, "o": 1}]))
    with pytest.raises(ValueError):
        files.candle_json(spark, str(tmp_path / "sub"))


def test_raw_rows(spark):
    raw = spark.createDataFrame([("a", [["1", "2", "3", "4", "1", "", "9"], ["1", "2"], ["x", "1", "1", "1", "1", "1", "1"], [None, "1", "1", "1", "1", "1", "1"]])], "item_id string, data array<array<string>>")
    assert sorted(map(tuple, files.normalise_arrays(raw).collect())) == [("a", 0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), ("a", 1000, 2.0, 4.0, 1.0, 3.0, 0.0, 9.0)]


def test_factor_specs(spark, tmp_path):
    a, b, c = tmp_path / "a.csv", tmp_path / "b.md", tmp_path / "c.csv"
    a.write_text("factor,lag,mean\nx,3,0.1\ny,bad,0.2\nz,0,1\n")
    b.write_text("# note\n1 x 5\n2 y z\n| 3 | w | 2 |\n")
    c.write_text("factor,lag\n")
    assert files.factor_spec(spark, str(a)) == [("x", 3), ("z", 0)] and files.factor_spec(spark, str(b)) == [("x", 5), ("w", 2)]
    with pytest.raises(ValueError):
        files.factor_spec(spark, str(c))


def test_paged_source(spark, tmp_path):
    (tmp_path / "5.json").write_text(json.dumps([[i, 1, 2, 3, 1, 1, 1] for i in range(1, 24)]))
    spark.dataSource.register(paged.PagedCandles)
    df = spark.read.format("paged_candles").option("items", "5,6").option("folder", str(tmp_path)).option("limit", "10").load()
    got = files.normalise_arrays(df)
    assert df.count() == 3 and got.count() == 23
    p = paged.RatePolicy()
    assert p.react(107) == ("wait", 60) and p.react(108) == ("wait", 120) and [p.react(106)[0] for _ in range(3)] == ["wait", "wait", "stop"] and p.react(1) == ("stop", 0)
    same = lambda item, t, n: {"success": True, "data": [[5]]}
    assert len(list(paged.pages(same, "x"))) == 1


def test_quality_suite(spark):
    df = spark.createDataFrame([(1, "a"), (1, None)], "k int, s string")
    got = {r.check: (r.passed, r.observed) for r in quality.suite([quality.unique(df, "u", "k"), quality.not_null(df, "n", "s"), quality.between(df, "b", "k", 0, 2)]).collect()}
    assert got == {"u": (False, 1), "n": (False, 1), "b": (True, 0)}


def test_ranking_model(spark):
    rows = [(str(i), DAY + dt.timedelta(d), float((i * 7 + d) % 20), float(i % 3), ((i * 7 + d) % 20) / 20, float((i * 7 + d) % 20 > 14)) for d in range(24) for i in range(20)]
    p = spark.createDataFrame(rows, "item_id string, date date, good double, noise double, pct double, label double")
    f = ["good", "noise"]
    model, tried = models.grid_search(p.where("date < '2024-01-15'"), p.where("date >= '2024-01-15'"), f, "label", "pct", [models.Params(trees=2, depth=2), models.Params(trees=3, depth=3)])
    assert len(tried) == 2 and models.evaluate(models.predict(model, p, f), "pct").first().spearman > 0.6
    assert models.gain_importance([model], f)[0][0] == "good"
    assert models.sample_rows(p, ["item_id", "date"], 7).count() == 7 and models.rank_groups(p).where("usable").count() == 24
    with pytest.raises(ValueError):
        models.grid_search(p, p, f, "label", "pct", [])


def test_registered_models_keep_the_operators_parameters(monkeypatch):
    from panelspark.operators import models
    from panelspark.registry import live

    class Seen(Exception):
        pass

    def stop(*args):
        raise Seen(next(a for a in args if isinstance(a, models.Params)))

    monkeypatch.setattr(live, "dataset", lambda spark, sf_dir: None)
    monkeypatch.setattr(models, "fit", stop)
    monkeypatch.setattr(models, "purged_cv", stop)
    for query in (live.perm_importance, live.purged_cv):
        try:
            query(None, "")
        except Seen as seen:
            assert seen.args[0] == models.Params()
        else:
            raise AssertionError("no model was fitted")


def test_means_of_late_events_are_in_order(spark, tmp_path):
    """Events in three files, out of order by less than the watermark allows; the last ones wait for later events."""
    from panelspark.streaming import bars

    r = np.random.default_rng(3)
    start = dt.datetime(2024, 1, 1)
    events = [(k, "ab"[k % 2], start + dt.timedelta(minutes=10 * k), None if k == 8 else float(r.normal())) for k in range(60)]
    held = events[:]
    for a in range(0, 60, 5):  # within fifty minutes
        part = held[a : a + 5]
        r.shuffle(part)
        held[a : a + 5] = part
    for i, part in enumerate((held[:22], held[22:41], held[41:])):
        spark.createDataFrame(part, "event_id long, item_id string, ts timestamp, px double").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("event_id long, item_id string, ts timestamp, px double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = {x.event_id: x["mean"] for x in bars.drain(bars.ordered_mean(stream, 0.3, "3 hours"), f"file://{tmp_path}", conf=bars.ROCKS).collect()}
    want, mean = {}, {}
    for k, item, ts, x in events:
        if x is not None:
            mean[item] = x if item not in mean else mean[item] + 0.3 * (x - mean[item])
        want[k] = mean[item]
    last = events[-1][2] - dt.timedelta(hours=3)
    due = {k: want[k] for k, _, ts, _ in events if ts <= last}
    assert got.keys() == due.keys() and all(abs(got[k] - v) < 1e-12 for k, v in due.items())
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != bars.ROCKS["spark.sql.streaming.stateStore.providerClass"]


def test_waiting_events_are_one_value_a_batch():
    """What waits is packed: one value of the state for each batch, whatever its rows; rows without a price wait too."""
    import pandas as pd

    from panelspark.streaming import bars

    class State(list):
        def get(self):
            return iter(self)

        def appendValue(self, v):
            self.append(v)

        def appendList(self, vs):
            self.extend(vs)

        def put(self, vs):
            self[:] = vs

    class Value:
        held = None

        def get(self):
            return self.held

        def exists(self):
            return self.held is not None

        def update(self, v):
            self.held = v

    class Handle:
        def __init__(self):
            self.timers, self.waiting = set(), State()

        def getListState(self, *_):
            return self.waiting

        def getValueState(self, *_):
            return Value()

        def listTimers(self):
            return iter(sorted(self.timers))

        def registerTimer(self, t):
            self.timers.add(t)

        def deleteTimer(self, t):
            self.timers.discard(t)

    class Now:
        def getCurrentWatermarkInMs(self):
            return 1_704_067_205_500

    handle, op = Handle(), bars.OrderedMean(0.5)
    op.init(handle)
    at = [pd.Timestamp("2024-01-01") + pd.Timedelta(s, "s") for s in (3, 1, 9, 5, 2)]
    list(op.handleInputRows(("a",), iter([pd.DataFrame({"ts": at, "event_id": [1, 2, 3, 4, 5], "px": [4.0, 2.0, 8.0, np.nan, 4.0]})]), Now()))
    assert len(handle.waiting) == 1 and handle.timers == {1_704_067_201_000}
    handle.timers.clear()
    out = pd.concat(op.handleExpiredTimer(("a",), Now(), None))
    assert out["event_id"].tolist() == [2, 5, 1, 4] and out["mean"].tolist() == [2.0, 3.0, 3.5, 3.5]
    assert len(handle.waiting) == 1 and handle.timers == {1_704_067_209_000}

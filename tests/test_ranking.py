"""The ranking booster against a plain one over loops; attributions against all subsets of features."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import explain, models, ranking, trees
from panelspark.operators.ranking import RankParams


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return f"file://{tmp_path_factory.mktemp('ranking')}"


def panel(spark, dates=24, items=30, seed=0, level=0.0):
    """x drives the order within a date; m moves whole dates up and down; z is noise."""
    r = np.random.default_rng(seed)
    rows = []
    for d in range(dates):
        shift = r.normal()
        x, z = r.normal(size=items), r.normal(size=items)
        y = x + 0.5 * x * (z > 0) + 0.3 * r.normal(size=items)
        pct = (np.argsort(np.argsort(y)) + 1) / items
        label = np.clip(np.floor(pct * 4), 0, 3) if not level else np.round(level + level * np.sin(5 * shift)) + (y > 0) + (y > 1)
        rows += [(f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}", f"i{k:03d}", float(x[k]), float(shift + 0.01 * r.normal()), float(z[k]), float(label[k]), float(pct[k])) for k in range(items)]
    return spark.createDataFrame(rows, "date string, item_id string, x double, m double, z double, label double, pct double").withColumn("date", F.to_date("date"))


def plain_gradients(score, label, top):
    """Every pair once, by the definition."""
    n = len(score)
    order = sorted(range(n), key=lambda i: -score[i])
    rank = {i: k for k, i in enumerate(order)}
    gain = [2.0**y - 1 for y in label]
    ideal = sum(v / math.log2(k + 2) for k, v in enumerate(sorted(gain, reverse=True)))
    g, h = [0.0] * n, [0.0] * n
    for i, j in itertools.combinations(range(n), 2):
        if label[i] == label[j] or min(rank[i], rank[j]) >= top or not ideal:
            continue
        hi, lo = (i, j) if label[i] > label[j] else (j, i)
        p = 1 / (1 + math.exp(score[hi] - score[lo]))
        weight = abs((gain[i] - gain[j]) * (1 / math.log2(rank[i] + 2) - 1 / math.log2(rank[j] + 2))) / ideal
        g[hi] -= p * weight
        g[lo] += p * weight
        h[hi] += p * (1 - p) * weight
        h[lo] += p * (1 - p) * weight
    return g, h


def plain_booster(rows, features, cuts, params):
    """Boosting as nested functions: each split tried on each node's rows, one after the other."""
    by_date = {}
    for k, r in enumerate(rows):
        by_date.setdefault(r["date"], []).append(k)
    score, out = [0.0] * len(rows), []

    def tree(own, g, h, depth):
        gs, hs = sum(g[k] for k in own), sum(h[k] for k in own)
        best = None
        for f, name in enumerate(features):
            for cut in cuts[f]:
                left = [k for k in own if rows[k][name] <= cut]
                gl, hl = sum(g[k] for k in left), sum(h[k] for k in left)
                if hl < params.least or hs - hl < params.least:
                    continue
                gain = gl * gl / (hl + params.l2) + (gs - gl) ** 2 / (hs - hl + params.l2) - gs * gs / (hs + params.l2)
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, f, cut)
        if not depth or best is None:
            value = -params.rate * gs / (hs + params.l2)
            return lambda r: value
        _, f, cut = best
        a = tree([k for k in own if rows[k][features[f]] <= cut], g, h, depth - 1)
        b = tree([k for k in own if rows[k][features[f]] > cut], g, h, depth - 1)
        return lambda r: a(r) if r[features[f]] <= cut else b(r)

    for _ in range(params.trees):
        g, h = [0.0] * len(rows), [0.0] * len(rows)
        for own in by_date.values():
            for k, a, b in zip(own, *plain_gradients([score[k] for k in own], [rows[k]["label"] for k in own], params.top)):
                g[k], h[k] = a, b
        grown = tree(list(range(len(rows))), g, h, params.depth)
        out.append(grown)
        score = [s + grown(r) for s, r in zip(score, rows)]
    return score


@pytest.mark.parametrize("top", [3, 100])
def test_gradients(top):
    r = np.random.default_rng(top)
    for n in (1, 2, 9, 40):
        score, label = np.round(r.normal(size=n), 1), r.integers(0, 4, n).astype(float)
        g, h = ranking.lambdas(score, label, top)
        want = plain_gradients(list(score), list(label), top)
        np.testing.assert_allclose([g, h], want, atol=1e-12)
        assert abs(g.sum()) < 1e-9
    assert not ranking.lambdas(np.zeros(4), np.zeros(4), 32)[0].any()


def test_booster_against_a_plain_one(spark, folder):
    df = panel(spark, 6, 12)
    params = RankParams(trees=10, depth=2, rate=0.3, bins=8, subsample=1.0, columns=1.0, top=5)
    features = ["x", "m", "z"]
    model = ranking.fit_ranker(df.repartition(5), features, "label", params, folder)
    rows = [r.asDict() for r in df.orderBy("date", "item_id").collect()]
    cuts = [list(c) for c in ranking.edges(df, features, params.bins)]
    want = plain_booster(rows, features, cuts, params)
    got = [r.score for r in model.predict(df).orderBy("date", "item_id").collect()]
    np.testing.assert_allclose(got, want, atol=1e-5)
    again = ranking.fit_ranker(df.repartition(2), features, "label", params, folder)
    assert again.trees == model.trees


def test_ranks_better_than_a_pointwise_model(spark, folder):
    """Labels that move with the date: squares of errors go to the date's level, which no ranking within dates needs."""
    train, test = panel(spark, 60, 30, 1, 3.0), panel(spark, 30, 30, 2, 3.0)
    features = ["m", "x", "z"]
    ranker = ranking.fit_ranker(train, features, "label", RankParams(trees=6, depth=2, rate=0.3, bins=32), folder)
    point = models.fit(train, features, "label", models.Params(trees=6, depth=2, rate=0.3))
    a = ranking.mean_ndcg(ranker.predict(test), "score", "label").agg(F.avg("ndcg")).first()[0]
    b = ranking.mean_ndcg(models.predict(point, test, features), "score", "label").agg(F.avg("ndcg")).first()[0]
    assert a > b + 0.01 and a > 0.9, (a, b)


def test_stops_on_top_accuracy_and_odd_rows(spark, folder):
    df = panel(spark, 12, 15, 4)
    odd = df.unionByName(df.limit(3).withColumn("x", F.lit(None).cast("double"))).unionByName(df.limit(1).withColumn("date", F.to_date(F.lit("2025-01-01"))))
    params = RankParams(trees=12, depth=2, bins=16, patience=3, share=0.2, best=0.2)
    model = ranking.fit_ranker(odd, ["x", "z"], "label", params, folder, val=panel(spark, 8, 15, 5), truth="pct")
    seen = [h for h in model.history]
    assert len(model.trees) == seen.index(max(seen)) + 1 and len(seen) <= max(len(model.trees) + params.patience, 1)
    assert model.predict(odd).count() == df.count() + 1
    nothing = ranking.fit_ranker(df.limit(0), ["x", "z"], "label", params, folder)
    assert nothing.predict(df).agg(F.min("score"), F.max("score")).first() == (0.0, 0.0)


def test_share_of_leaders(spark, monkeypatch):
    r = np.random.default_rng(0)
    rows = [(float(s), float(t)) for s, t in zip(np.round(r.normal(size=900), 1), r.random(900))]
    df = spark.createDataFrame([*rows, (None, 1.0), (2.0, None)], "s double, t double")
    k = 90
    top = sorted((s for s, _ in rows), reverse=True)
    cut = top[k - 1]
    over, at = [t >= 0.9 for s, t in rows if s > cut], [t >= 0.9 for s, t in rows if s == cut]
    want = (sum(over) + sum(at) * (k - len(over)) / len(at)) / k
    assert abs(ranking.top_share(df, "s", "t", 0.1, 0.1) - want) < 1e-12
    monkeypatch.setattr(ranking, "FEW", 5)
    monkeypatch.setattr(ranking, "CUT", 4)
    assert abs(ranking.top_share(df, "s", "t", 0.1, 0.1) - want) < 1e-12
    assert ranking.top_share(df.limit(0), "s", "t", 0.1, 0.1) is None


def subset_value(tree, x, known):
    """The tree's value with only some features known: others follow both ways by cover."""

    def down(node):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        a, b = tree.left[node], tree.right[node]
        if f in known:
            return down(a if x[f] <= tree.threshold[node] else b)
        return (tree.cover[a] * down(a) + tree.cover[b] * down(b)) / tree.cover[node]

    return down(0)


def enumerated(grown, x):
    """Shapley values by all subsets."""
    d = len(x)
    value = {s: sum(subset_value(t, x, set(s)) for t in grown) for n in range(d + 1) for s in itertools.combinations(range(d), n)}
    out = []
    for j in range(d):
        others = [k for k in range(d) if k != j]
        out.append(sum(math.factorial(n) * math.factorial(d - 1 - n) / math.factorial(d) * (value[tuple(sorted((*s, j)))] - value[s]) for n in range(d) for s in itertools.combinations(others, n)))
    return value[()], out


def test_attributions_equal_all_subsets(spark, folder):
    df = panel(spark, 10, 20, 3).withColumn("w", F.col("x") * F.col("z"))
    features = ["x", "m", "z", "w"]
    ranker = ranking.fit_ranker(df, features, "label", RankParams(trees=4, depth=4, bins=16, rate=0.3), folder).trees
    boosted = models.fit(df, features, "label", models.Params(trees=4, depth=4))
    gbt = trees.from_boosted(spark, boosted, folder)
    some = df.where("date <= '2024-01-02'").withColumn("clash", F.lit(1))
    for grown in (ranker, gbt):
        rows = explain.explained(grown, some, features).collect()
        assert len(rows) == 40
        for r in rows:
            base, want = enumerated(grown, [r[f] for f in features])
            got = [r[f"shap_{f}"] for f in features]
            np.testing.assert_allclose(got, want, atol=1e-10)
            assert abs(r.base_value - base) < 1e-10 and abs(r.base_value + sum(got) - r.prediction) < 1e-10
    scores = {(r.date, r.item_id): r.score for r in models.predict(boosted, some, features).collect()}
    assert all(abs(r.prediction - scores[r.date, r.item_id]) < 1e-9 for r in explain.explained(gbt, some, features).collect())


def test_summary_ranks_features(spark, folder):
    df = panel(spark, 10, 20, 6)
    features = ["z", "m", "x"]
    model = ranking.fit_ranker(df, features, "label", RankParams(trees=4, depth=3, bins=16), folder)
    details = explain.explained(model.trees, df, features)
    got = explain.summary(details, features).orderBy("rank").collect()
    own = details.toPandas()
    assert got[0].feature == "x" and [r["rank"] for r in got] == [1, 2, 3]
    for r in got:
        v = own[f"shap_{r.feature}"]
        np.testing.assert_allclose([r.mean_abs_shap, r.mean_shap, r.std_shap], [v.abs().mean(), v.mean(), v.std(ddof=0)], atol=1e-12)
    assert explain.summary(details.limit(0), features).count() == 3
    stump = trees.Tree()
    stump.leaf(0.5, 1.0)
    assert explain.explained([stump], df, features).select("base_value", "prediction", "shap_x").first() == (0.5, 0.5, 0.0)


def test_gradients_are_formed_once_a_tree(spark, folder):
    """What a level reads are a date's sampled gradients, in units; no level forms them again."""
    p = panel(spark, dates=4, items=12)
    params = ranking.RankParams(bins=8, top=3)
    rows = ranking.packed(p, ["x", "z"], "label", ranking.edges(p, ["x", "z"], 8), folder)
    kept = {r.date: r for r in rows.collect()}
    seen = ranking._gradients(rows, [], 2, 5, params).collect()
    assert len(seen) == len(kept)
    want = set()
    for date, r in kept.items():
        keep = ranking._sample(date, len(r.label), 5, params)
        g, h = ranking.lambdas(np.array(r.score), np.array(r.label), params.top)
        held = np.frombuffer(r.bins, np.uint8).reshape(2, -1)[:, keep]
        want.add((held.tobytes(), np.rint(g[keep] * ranking.UNIT).astype("<i8").tobytes(), np.rint(h[keep] * ranking.UNIT).astype("<i8").tobytes()))
    assert {(bytes(r.bins), bytes(r.g), bytes(r.h)) for r in seen} == want


def test_patterns_of_a_path_are_worked_out_once(monkeypatch):
    tree = trees.Tree()
    left, right = tree.split(tree.leaf(0.0, 10.0), 0, 0.5, (0.0, 4.0), (2.0, 6.0))
    tree.split(left, 1, 0.2, (-1.0, 1.0), (3.0, 3.0))
    ways = [explain.paths(tree)]
    x = np.random.default_rng(2).random((50, 2))
    want = explain.attributions(ways, x)
    calls = []
    whole = explain.pattern_values
    monkeypatch.setattr(explain, "pattern_values", lambda *a: calls.append(1) or whole(*a))
    assert (explain.attributions(ways, x) == want).all() and not calls
    for leaf in ways[0]:  # as paths of many features do
        leaf.table = None
    assert np.allclose(explain.attributions(ways, x), want) and calls


def test_models_read_a_stored_panel(spark):
    """The windows of the panel run once, not for each split, tree and figure."""
    from panelspark.registry import live

    plan = live.dataset(spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    stored = []
    p = live.dataset(spark, "/root/testdata/sf0.01")
    models.purged_cv(p, live.FEATURES, "label", "pct", models.Params(trees=1, depth=1), 2, 150, 30, keep=lambda df: stored.append(df) or df)
    assert len(stored) == 2 and all(set(df.columns) == {"item_id", "date", "score", "pct"} for df in stored)


def test_importance_stores_its_scores(spark):
    """Ranks of the score and of the truth read what was scored once."""
    p, stored = panel(spark, dates=4, items=12), []

    def keep(df):
        stored.append(df)
        return df

    model = models.fit(p, ["x", "z"], "label", models.Params(trees=1, depth=1))
    got = models.permutation_importance(model, p, ["x", "z"], "pct", keep=keep)
    assert len(stored) == 1 and set(stored[0].columns) == {"_f", "score", "pct"}
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in models.permutation_importance(model, p, ["x", "z"], "pct").collect()]

"""Learning to rank: boosted trees on lambda gradients of NDCG within each date.

The panel is packed once, a row a date: items in order, relevance, and features as quantile bins. A tree forms the gradients of each date from its
scores once and keeps them with the bins. One pass over those grows one level: a task walks its dates through the tree so far and adds the gradients up by
(node, feature, bin); Spark adds the tasks' sums, runs them along the bins and picks the best split of each node, so that what reaches the
driver is a row a node. Gradients are whole multiples of 2 ** -24, so sums, splits and models do not depend on how dates are dealt. Scores are written back
every REFRESH trees; in between a pass adds the newer trees itself.

Pairs. In a date's order by score, each of the `top` first items meets every item below it of another label: top * n pairs, one item at a time, in O(n) memory. A pair
weighs the change of NDCG that exchanging its two would make (gain 2 ** label - 1, discount 1 / log2(rank + 1), over the ideal of the whole date).

Boosting stops once `patience` trees have not raised the share of true leaders (percentile >= 1 - best) among the validation rows
scored highest (`share` of them, pooled over dates; rows of equal score at the cut count by their mean), and the trees up to the best are kept.
A date's cross-section is one row, and must fit a task. Rows that lack a feature or the label are left out; dates of one item have no pairs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.trees import Tree, scored
from panelspark.plans.expr import DATE, ITEM

UNIT, REFRESH, CUT, FEW = 1 << 24, 8, 1_024, 10_000


@dataclass(frozen=True)
class RankParams:
    trees: int = 20
    depth: int = 4
    rate: float = 0.1
    bins: int = 64
    l2: float = 1.0
    least: float = 1e-3  # of second derivatives on either side of a split
    subsample: float = 0.8  # of the rows, for each tree
    columns: float = 0.8  # of the features, for each tree
    top: int = 32
    share: float = 0.1
    best: float = 0.1
    patience: int = 10
    seed: int = 42


@dataclass
class RankModel:
    trees: list[Tree]
    features: list[str]
    history: list[float | None] = field(default_factory=list)  # the validation figure after each tree

    def predict(self, panel: DataFrame, name: str = "score") -> DataFrame:
        return scored(self.trees, panel, self.features, name)


def lambdas(score: np.ndarray, label: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of one date's rows."""
    n = len(score)
    g, h = np.zeros(n), np.zeros(n)
    gain = np.exp2(label) - 1
    discount = 1 / np.log2(np.arange(n) + 2)
    ideal = float((np.sort(gain)[::-1] * discount).sum())
    if ideal <= 0:
        return g, h
    order = np.argsort(-score, kind="stable")
    s, l, w = score[order], label[order], gain[order]
    for i in range(min(top, n - 1)):
        sign = np.sign(l[i] - l[i + 1 :])
        change = np.abs(w[i] - w[i + 1 :]) * (discount[i] - discount[i + 1 :]) / ideal
        wrong = 1 / (1 + np.exp(np.clip(sign * (s[i] - s[i + 1 :]), -500, 500)))
        first, second = sign * wrong * change, wrong * (1 - wrong) * change
        g[order[i]] -= first.sum()
        h[order[i]] += second.sum()
        g[order[i + 1 :]] += first
        h[order[i + 1 :]] += second
    return g, h


def edges(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Upper bounds of all bins but the last, at quantiles; fewer where values repeat."""
    share = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(f"`{f}`").cast("double"), share, 10_000).alias(f"_{i}") for i, f in enumerate(features)]).first()
    return [np.unique(np.array(found[i] or [], float)) for i in range(len(features))]


def packed(rows: DataFrame, features: list[str], label: str, cuts: list[np.ndarray], folder: str) -> DataFrame:
    """(date, label, bins, score): a row a date, items in order; bins are bytes, feature after feature."""
    cells = [F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)]
    each = rows.select(F.col(DATE).cast("string").alias("date"), F.col(ITEM).alias("item"), F.col(label).cast("double").alias("label"), *cells)

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in table.column_names[1:]], null_placement="at_start"))
        values = [c.to_numpy() for c in table.columns[2:]]
        held = np.array([np.searchsorted(cut, v) for cut, v in zip(cuts, values[1:])], np.uint8)
        one = [table.column(0)[0].as_py(), values[0], held.tobytes(), np.zeros(len(values[0]))]
        types = [pa.string(), pa.list_(pa.float64()), pa.binary(), pa.list_(pa.float64())]
        return pa.table([pa.array([v], t) for v, t in zip(one, types)], ["date", "label", "bins", "score"])

    return _written(each.groupBy("date").applyInArrow(run, "date string, label array<double>, bins binary, score array<double>"), folder)


def _written(df: DataFrame, folder: str) -> DataFrame:
    path = f"{folder.rstrip('/')}/ranking-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dates(batches: Iterator[pa.RecordBatch], newer: list[Tree], width: int) -> Iterator[tuple]:
    """(date, label, bins as a matrix of doubles by row, score with the newer trees) of each row."""
    for batch in batches:
        for at in range(batch.num_rows):
            label = batch.column(1)[at].values.to_numpy(zero_copy_only=False)
            held = np.frombuffer(batch.column(2)[at].as_py(), np.uint8).reshape(width, -1).T
            score = batch.column(3)[at].values.to_numpy(zero_copy_only=False).copy()
            for tree in newer:
                score += tree.predict(held)
            yield batch.column(0)[at].as_py(), label, held, score


def _sample(date: str, n: int, tree: int, params: RankParams) -> np.ndarray:
    if params.subsample >= 1:
        return np.ones(n, bool)
    return np.random.default_rng([params.seed, tree, *date.encode()]).random(n) < params.subsample


def _gradients(rows: DataFrame, newer: list[Tree], width: int, number: int, params: RankParams) -> DataFrame:
    """(bins, g, h) of the rows that tree `number` sees, a row a date; g and h are longs, in units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for date, label, held, score in _dates(batches, newer, width):
            keep = _sample(date, len(label), number, params)
            g, h = (np.rint(d[keep] * UNIT).astype("<i8").tobytes() for d in lambdas(score, label, params.top))
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in (held[keep].T.tobytes(), g, h)], ["bins", "g", "h"])

    return rows.mapInArrow(run, "bins binary, g binary, h binary")


def _level(rows: DataFrame, grown: Tree, open_: list[int], chosen: list[int], width: int, params: RankParams) -> dict[int, tuple]:
    """The best split of each open node: node -> (gain, feature, bin, g left, h left, g, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, place = params.bins, {node: k for k, node in enumerate(open_)}
        total = np.zeros((2, len(open_), len(chosen), bins))
        for batch in batches:
            for one in range(batch.num_rows):
                held, g, h = (np.frombuffer(c[one].as_py(), t) for c, t in zip(batch.columns, (np.uint8, "<i8", "<i8")))
                held = held.reshape(width, -1).T
                node = np.array([place.get(k, -1) for k in range(len(grown.feature))])[grown.reached(held)]
                keep = node >= 0
                node, g, h = node[keep], g[keep].astype(float), h[keep].astype(float)
                for k, f in enumerate(chosen):
                    at = node * bins + held[keep, f]
                    total[0, :, k] += np.bincount(at, g, len(open_) * bins).reshape(-1, bins)
                    total[1, :, k] += np.bincount(at, h, len(open_) * bins).reshape(-1, bins)
        n, k, b = np.nonzero(total[1] + np.abs(total[0]))
        ids = [np.array(open_, np.int64)[n], np.array(chosen, np.int64)[k], b, total[0][n, k, b].astype(np.int64), total[1][n, k, b].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ids], ["node", "feature", "bin", "g", "h"])

    # A task's cells are added up already; dealt by (node, feature), sums and running sums need no further exchange.
    cells = rows.mapInArrow(run, "node long, feature long, bin long, g long, h long").repartition("node", "feature").groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    each = Window.partitionBy("node", "feature")
    along = each.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.select("node", "feature", "bin", F.sum("g").over(along).alias("gl"), F.sum("h").over(along).alias("hl"), F.sum("g").over(each).alias("g"), F.sum("h").over(each).alias("h"))
    part = lambda g, h: (g / UNIT) * (g / UNIT) / (h / UNIT + params.l2)
    gl, hl, g, h = (F.col(c) for c in ("gl", "hl", "g", "h"))
    gain = part(gl, hl) + part(g - gl, h - hl) - part(g, h)
    fits = (hl >= params.least * UNIT) & (h - hl >= params.least * UNIT)
    cells = cells.withColumn("gain", F.when(fits & (gain > 1e-12), gain))
    best = cells.groupBy("node").agg(F.max_by(F.struct("gain", "feature", "bin", "gl", "hl"), F.struct("gain", -F.col("feature"), -F.col("bin"))).alias("best"), F.max("g").alias("g"), F.max("h").alias("h"))
    # All features of a node add up to the same; max only names it.
    return {r.node: (r.best.gain if r.best else None, *((r.best.feature, r.best.bin, r.best.gl, r.best.hl) if r.best else (None,) * 4), r.g, r.h) for r in best.collect()}


def grow(rows: DataFrame, newer: list[Tree], width: int, number: int, params: RankParams) -> Tree:
    """One tree over bins; thresholds are bin numbers."""
    order = np.random.default_rng([params.seed, number]).permutation(width)
    chosen = sorted(order[: max(1, round(width * params.columns))].tolist())
    tree = Tree()
    open_ = [tree.leaf(0.0, 0.0)]

    def value(g: int, h: int) -> tuple[float, float]:
        return -params.rate * (g / UNIT) / (h / UNIT + params.l2), h / UNIT

    drawn = _gradients(rows, newer, width, number, params).persist()
    for _ in range(params.depth):
        if not open_:
            break
        found, following = _level(drawn, tree, open_, chosen, width, params), []
        for node in open_:
            if node not in found:
                continue
            gain, feature, bin_, gl, hl, g, h = found[node]
            tree.value[node], tree.cover[node] = value(g, h)
            if gain is not None:
                following += tree.split(node, feature, bin_, value(gl, hl), value(g - gl, h - hl))
        open_ = following
    drawn.unpersist()
    return tree


def _in_values(tree: Tree, cuts: list[np.ndarray]) -> Tree:
    """The tree over bins as one over the features themselves."""
    threshold = [float(cuts[f][int(t)]) if f >= 0 else 0.0 for f, t in zip(tree.feature, tree.threshold)]
    return Tree(list(tree.feature), threshold, list(tree.left), list(tree.right), list(tree.value), list(tree.cover))


def top_share(df: DataFrame, score: str, truth: str, share: float, best: float, n: int | None = None) -> float | None:
    """Of the max(1, floor(n * share)) rows scored highest, how many have truth >= 1 - best; NULLs of either are left out.

    The score at the cut is found by histograms of CUT bins, each inside the last one's bin, until FEW rows are left in it. n: the number of rows, if it is known and none has a NULL.
    """
    rows = df.select(F.col(score).alias("s"), (F.col(truth) >= 1 - best).cast("long").alias("hit")).where("s IS NOT NULL AND hit IS NOT NULL")
    lo, hi = float("-inf"), float("inf")
    if n is None or n > FEW:
        n, lo, hi = rows.agg(F.count("*"), F.min("s"), F.max("s")).first()
    if not n:
        return None
    k = max(1, int(n * share))
    above_n = above_hits = 0
    inside = n
    while inside > FEW and lo < hi:
        width = (hi - lo) / CUT
        bin_ = F.least(F.floor((F.col("s") - lo) / width), F.lit(CUT - 1)).alias("b")
        found = sorted(rows.where(F.col("s").between(lo, hi)).groupBy(bin_).agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.min("s").alias("lo"), F.max("s").alias("hi")).collect(), key=lambda r: -r.b)
        for r in found:
            if above_n + r.n >= k:
                inside, lo, hi = r.n, r.lo, r.hi
                break
            above_n, above_hits = above_n + r.n, above_hits + r.hits
    for r in sorted(rows.where(F.col("s").between(lo, hi)).groupBy("s").agg(F.count("*").alias("n"), F.sum("hit").alias("hits")).collect(), key=lambda r: -r.s):
        taken = min(r.n, k - above_n)
        above_hits += r.hits * taken / r.n
        above_n += taken
        if above_n >= k:
            break
    return above_hits / k


def fit_ranker(train: DataFrame, features: list[str], label: str, params: RankParams, folder: str, val: DataFrame | None = None, truth: str | None = None) -> RankModel:
    """val and its percentile column `truth` stop the boosting; `folder` is shared by the cluster and holds what passes write."""
    if not 2 <= params.bins <= 256:
        raise ValueError("bins must be in 2..256")
    rows = train.dropna(subset=[*features, label])
    cuts = edges(rows, features, params.bins)
    panel = packed(rows, features, label, cuts, folder)
    trees: list[Tree] = []
    newer: list[Tree] = []
    model = RankModel([], features)
    best: tuple[float, int] | None = None
    held, size = None, 0
    if val is not None:
        held = _written(val.dropna(subset=[*features, truth]).select(F.col(truth).alias("_truth"), F.lit(0.0).alias("_base"), *features), folder)
        size = held.count()
    for number in range(params.trees):
        grown = grow(panel, newer, len(features), number, params)
        trees.append(_in_values(grown, cuts))
        newer.append(grown)
        if held is not None:
            recent = scored(trees[-1:], held, features, "_add").withColumn("_base", F.col("_base") + F.col("_add")).drop("_add").persist()
            figure = top_share(recent, "_base", "_truth", params.share, params.best, size)
            if number:
                held.unpersist()
            held = recent
            model.history.append(figure)
            if figure is not None and (best is None or figure > best[0]):
                best = (figure, number)
            if best is not None and number - best[1] >= params.patience:
                break
        if len(newer) == REFRESH and number + 1 < params.trees:
            panel = _written(_refreshed(panel, newer, len(features)), folder)
            if held is not None:  # the lineage ends here
                recent = _written(held, folder)
                held.unpersist()
                held = recent
            newer = []
    if held is not None:
        held.unpersist()
    model.trees = trees if best is None else trees[: best[1] + 1]
    return model


def _refreshed(panel: DataFrame, newer: list[Tree], width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for date, label, held, score in _dates(batches, newer, width):
            yield pa.RecordBatch.from_arrays([pa.array([date]), pa.array([label]), pa.array([held.T.tobytes()], pa.binary()), pa.array([score])], ["date", "label", "bins", "score"])

    return panel.mapInArrow(run, "date string, label array<double>, bins binary, score array<double>")


def mean_ndcg(scored_panel: DataFrame, score: str, label: str) -> DataFrame:
    """(date, ndcg) over each whole date, gains 2 ** label - 1; dates without gain have none. Ties go by item."""
    w = Window.partitionBy(DATE)
    p = scored_panel.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("_gain", F.pow(F.lit(2.0), F.col(label)) - 1)
    p = p.withColumn("_r", F.row_number().over(w.orderBy(F.desc(score), ITEM))).withColumn("_i", F.row_number().over(w.orderBy(F.desc("_gain"))))
    sums = p.groupBy(DATE).agg(F.sum(F.col("_gain") / F.log2(F.col("_r") + 1)).alias("_d"), F.sum(F.col("_gain") / F.log2(F.col("_i") + 1)).alias("_m"))
    return sums.select(DATE, F.try_divide("_d", "_m").alias("ndcg"))

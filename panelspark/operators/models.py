"""Pointwise models on MLlib: gradient-boosted trees over relevance labels, validation runs, importance, inference.

Learning to rank is in ranking.py, attributions of either kind of trees in explain.py. Rows with a NULL feature are dropped before fitting.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import evaluation, splits
from panelspark.operators.cross import X, average_rank
from panelspark.plans.expr import DATE, ITEM


@dataclass(frozen=True)
class Params:
    trees: int = 20
    depth: int = 4
    rate: float = 0.1
    subsample: float = 0.8
    columns: str = "0.8"
    seed: int = 42


def assemble(panel: DataFrame, features: list[str]) -> DataFrame:
    whole = panel.dropna(subset=features)
    return VectorAssembler(inputCols=features, outputCol="features").transform(whole)


def rank_groups(panel: DataFrame, least: int = 2) -> DataFrame:
    """(date, n): group sizes for learning to rank; smaller groups cannot be ranked and are an error to their users."""
    return panel.groupBy(DATE).agg(F.count("*").alias("n")).withColumn("usable", F.col("n") >= least)


def fit(train: DataFrame, features: list[str], label: str, params: Params, val: DataFrame | None = None) -> GBTRegressionModel:
    """With validation rows, boosting stops once they no longer gain."""
    rows = assemble(train.where(F.col(label).isNotNull()), features).withColumn("_val", F.lit(False))
    gbt = GBTRegressor(featuresCol="features", labelCol=label, maxIter=params.trees, maxDepth=params.depth, stepSize=params.rate, subsamplingRate=params.subsample, featureSubsetStrategy=params.columns, seed=params.seed)
    if val is not None:
        rows = rows.unionByName(assemble(val.where(F.col(label).isNotNull()), features).withColumn("_val", F.lit(True)))
        gbt = gbt.setValidationIndicatorCol("_val")
    return gbt.fit(rows)


def predict(model: GBTRegressionModel, panel: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(assemble(panel, features)).withColumnRenamed("prediction", "score").drop("features")


def evaluate(scored: DataFrame, target_pct: str, share: float = 0.1) -> DataFrame:
    """One row: pooled Spearman, mean precision at the top and the bottom of each date."""
    s = evaluation.spearman(scored, "score", target_pct).select("spearman", "n")
    top = evaluation.precision_at(scored, "score", target_pct, share, [DATE]).agg(F.avg("precision").alias("precision_top"))
    low = evaluation.precision_at(scored, "score", target_pct, share, [DATE], top=False).agg(F.avg("precision").alias("precision_bottom"))
    return s.crossJoin(top).crossJoin(low)  # a row each


def grid_search(train: DataFrame, val: DataFrame, features: list[str], label: str, pct: str, grid: list[Params]) -> tuple[GBTRegressionModel, list[tuple[Params, float | None]]]:
    """The model whose validation precision at the top is best; runs without a figure do not count."""
    if not grid:
        raise ValueError("the grid is empty")
    best, tried = None, []
    for params in grid:
        model = fit(train, features, label, params, val)
        p = evaluate(predict(model, val, features), pct).first().precision_top
        tried.append((params, p))
        if p is not None and (best is None or p > best[1]):
            best = (model, p)
    if best is None:
        raise ValueError("no run gave a figure")
    return best[0], tried


def purged_cv(panel: DataFrame, features: list[str], label: str, pct: str, params: Params, k: int = 3, horizon: int = 8, embargo: int = 2, val_share: float = 0.1, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(fold, spearman, precision_top, ...) of a model for each purged fold. keep: may store what a fold scored, which its figures read several times."""
    folds = splits.validation_tail(splits.purged_kfold(panel, k, horizon, embargo), val_share)
    return _per_fold(panel, folds, list(range(k)), features, label, pct, params, keep)


def walk_forward(panel: DataFrame, features: list[str], label: str, pct: str, params: Params, train: int, test: int, step: int) -> DataFrame:
    folds = splits.walk_forward(panel, train, test, step)
    return _per_fold(panel, folds, [r.fold for r in folds.select("fold").distinct().orderBy("fold").collect()], features, label, pct, params)


def _per_fold(panel: DataFrame, folds: DataFrame, ids: list[int], features: list[str], label: str, pct: str, params: Params, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    out, folds = None, folds.persist()  # dates by folds
    for f in ids:
        train, val, test = (splits.rows_of(panel, folds, f, role) for role in ("train", "val", "test"))
        model = fit(train, features, label, params, None if val.isEmpty() else val)
        row = evaluate(keep(predict(model, test, features).select(DATE, ITEM, "score", pct)), pct).withColumn("fold", F.lit(f))
        out = row if out is None else out.unionByName(row)
    return out


def seeds(panel: DataFrame, features: list[str], label: str, pct: str, params: Params, values: list[int], k: int = 3) -> DataFrame:
    from dataclasses import replace

    out = None
    for s in values:
        row = purged_cv(panel, features, label, pct, replace(params, seed=s), k).agg(F.avg("spearman").alias("spearman")).withColumn("seed", F.lit(s))
        out = row if out is None else out.unionByName(row)
    return out


def gain_importance(models: list[GBTRegressionModel], features: list[str]) -> list[tuple[str, float]]:
    """Mean over models; a feature that a model does not use counts as 0."""
    total = [0.0] * len(features)
    for m in models:
        for i, x in enumerate(m.featureImportances.toArray()):
            total[i] += float(x)
    return sorted(((f, t / len(models)) for f, t in zip(features, total)), key=lambda p: -p[1])


def permutation_importance(model: GBTRegressionModel, panel: DataFrame, features: list[str], pct: str, seed: int = 1, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(feature, drop): what the pooled Spearman loses when a feature's values are dealt anew within each date.

    The panel and its copies, one with each feature dealt anew, are stacked, scored in one pass and ranked side by side. keep: may store the scores, which
    the ranks read several times.
    """
    from pyspark.sql import Window

    day = Window.partitionBy(DATE)
    places = [F.row_number().over(day.orderBy(F.xxhash64(F.lit(seed), F.col(ITEM), F.lit(f)), ITEM)) for f in features]
    whole = panel.dropna(subset=[*features, pct]).select(DATE, ITEM, pct, *features)
    placed = whole.withColumns({"_b": F.row_number().over(day.orderBy(ITEM)), **{f"_a{i}": p for i, p in enumerate(places)}})
    dealt = placed.select(DATE, F.explode(F.array(*[F.struct(F.lit(f).alias("_f"), F.col(f"_a{i}").alias("_b"), F.col(f).cast("double").alias("_new")) for i, f in enumerate(features)])).alias("_x")).select(DATE, "_x.*")
    stacked = placed.select(DATE, "_b", pct, *features).join(dealt, [DATE, "_b"])
    copies = stacked.select("_f", pct, *[F.when(F.col("_f") == f, F.col("_new")).otherwise(F.col(f)).alias(f) for f in features])
    both = copies.unionByName(whole.select(F.lit("").alias("_f"), pct, *features))
    found = {r["_f"]: r.spearman for r in evaluation.spearman(keep(predict(model, both, features).select("_f", "score", pct)), "score", pct, ("_f",)).collect()}  # a row a feature
    return panel.sparkSession.createDataFrame([(f, None if found.get(f) is None or found.get("") is None else float(found[""] - found[f])) for f in features], "feature string, drop double")


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows, the same every time: those of the least hashes."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def inference_table(scored: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Scores of a date with percentile ranks and names, best first."""
    n = F.count("score").over(X())
    out = scored.withColumn("rank_pct", average_rank("score") / n)
    if names is not None:
        out = out.join(names, ITEM, "left").withColumn("name", F.coalesce("name", ITEM))
    return out.orderBy(DATE, F.desc("score"), ITEM)


def missing_features(panel: DataFrame, features: list[str]) -> DataFrame:
    """(item_id, date, missing): which features keep a row out of inference."""
    gone = F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in features]), lambda x: x.isNotNull())
    return panel.select(ITEM, DATE, gone.alias("missing")).where(F.size("missing") > 0)

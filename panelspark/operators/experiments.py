"""Experiments over purged folds: sensitivity to settings, to the seed, and what luck alone would give.

An experiment is a table with a row for each model trained; summaries and tests are taken from that table. What trains is a function
(train, val, settings) -> function from rows to rows with a score, so any model of the package fits; ranker() makes one for the NDCG booster.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import evaluation, splits, stats
from panelspark.operators.ranking import RankParams, fit_ranker

Trainer = Callable[[DataFrame, DataFrame, "Setting"], Callable[[DataFrame], DataFrame]]


@dataclass(frozen=True)
class Setting:
    """val_share: of the training dates, the last ones; patience: trees without gain; rate: learning rate."""

    name: str
    val_share: float = 0.1
    patience: int = 80
    rate: float = 0.018
    seed: int = 42


# The settings compared, and the seeds.
SETTINGS = (Setting("A", 0.10, 80, 0.018), Setting("B", 0.20, 80, 0.018), Setting("C", 0.20, 200, 0.018), Setting("D", 0.20, 200, 0.010))
SEEDS = (42, 0, 7, 13, 2024)


def ranker(features: list[str], label: str, truth: str, folder: str, params: RankParams | None = None) -> Trainer:
    base = params or RankParams(trees=1_000)

    def train(rows: DataFrame, val: DataFrame, setting: Setting) -> Callable[[DataFrame], DataFrame]:
        own = replace(base, patience=setting.patience, rate=setting.rate, seed=setting.seed)
        return fit_ranker(rows, features, label, own, folder, None if val.isEmpty() else val, truth).predict

    return train


def folded(panel: DataFrame, train: Trainer, setting: Setting, truth: str, k: int = 5, horizon: int = 8, embargo: int = 2) -> DataFrame:
    """(setting, seed, fold, n, spearman, leaks): a model for each purged fold, scored on its test dates.

    leaks: validation dates whose labels reach into the test dates; purging leaves none, and the table shows it.
    """
    folds = splits.validation_tail(splits.purged_kfold(panel, k, horizon, embargo), setting.val_share)
    # The leak check reads training roles: here of the validation dates.
    held = folds.where(F.col("role").isin("val", "test")).withColumn("role", F.when(F.col("role") == "val", "train").otherwise("test"))
    leaks = {r.fold: r.n for r in splits.leaks(held, horizon).collect()}  # a row a fold
    out = None
    for fold in range(k):
        own = {role: splits.rows_of(panel, folds, fold, role) for role in ("train", "val", "test")}
        scored = train(own["train"], own["val"], setting)(own["test"])
        row = evaluation.spearman(scored, "score", truth).select(
            F.lit(setting.name).alias("setting"), F.lit(setting.seed).alias("seed"), F.lit(fold).alias("fold"), "n", "spearman", F.lit(int(leaks.get(fold, 0))).alias("leaks")
        )
        row = row.sparkSession.createDataFrame(row.collect(), row.schema)  # one row; a model is trained once
        out = row if out is None else out.unionByName(row)
    return out


def sensitivity(panel: DataFrame, train: Trainer, truth: str, settings: tuple[Setting, ...] = SETTINGS, **folds) -> DataFrame:
    """folded() of each setting, one below the other."""
    out = None
    for s in settings:
        own = folded(panel, train, s, truth, **folds)
        out = own if out is None else out.unionByName(own)
    return out


def by_setting(results: DataFrame) -> DataFrame:
    """(setting, mean, std, least, most, positive, leaks), std of the folds with ddof 1."""
    x = F.col("spearman")
    return results.groupBy("setting").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("least"), F.max(x).alias("most"), F.count_if(x > 0).alias("positive"), F.sum("leaks").alias("leaks"))


def seeded(panel: DataFrame, few: Trainer, many: Trainer, truth: str, setting: Setting, seeds: tuple[int, ...] = SEEDS, **folds) -> DataFrame:
    """(seed, few, many, diff): mean Spearman over the folds of two models, for each seed."""
    out = None
    for seed in seeds:
        own = None
        for name, train in (("few", few), ("many", many)):
            row = folded(panel, train, replace(setting, name=name, seed=seed), truth, **folds)
            own = row if own is None else own.unionByName(row)
        out = own if out is None else out.unionByName(own)
    wide = out.groupBy("seed").pivot("setting", ["few", "many"]).agg(F.avg("spearman"))
    return wide.withColumn("diff", F.col("few") - F.col("many"))


def seed_verdict(seeds: DataFrame) -> DataFrame:
    """The paired tests over seeds, with a verdict: stable (p below 0.05, wins in 80 % or more), leaning (60 % or more), or unstable."""
    t = stats.paired_tests(seeds, "many", "few")
    verdict = F.when((F.col("p_t") < 0.05) & (F.col("win_rate") >= 0.8), "stable").when(F.col("win_rate") >= 0.6, "leaning").otherwise("unstable")
    return t.withColumn("verdict", verdict)


def grid_luck(reports: DataFrame, split: str = "test") -> DataFrame:
    """The deflated figure of each grid report (sources.files.json_reports): the chosen run against the best of as many runs without skill.

    A report has metrics.{split}.spearman of the chosen run and grid_results[].metrics.{split}.spearman of all; ones without results give "insufficient data".
    """
    out = None
    for r in reports.select("report", F.col(f"metrics.{split}.spearman").cast("double").alias("chosen"), F.transform("grid_results", lambda g: g["metrics"][split]["spearman"].cast("double")).alias("runs")).collect():  # a row a report
        trials = reports.sparkSession.createDataFrame([(x,) for x in r.runs or []], "value double")
        row = stats.deflated_sharpe(trials, observed=r.chosen).withColumn("report", F.lit(r.report))
        out = row if out is None else out.unionByName(row)
    return out


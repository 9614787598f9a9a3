"""How good factors are: rank correlations, quantile returns, stability, redundancy, top-k precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.cross import average_rank
from panelspark.plans.expr import DATE, ITEM


def unpivot(panel: DataFrame, factors: list[str], keep: list[str]) -> DataFrame:
    return panel.unpivot(keep, factors, "factor", "value")


def correlation(x: str, y: str) -> Column:
    """Pearson of a group; NULL without spread on either side."""
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    return F.when(~flat, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def rank_ic(panel: DataFrame, factors: list[str], target: str, least: int = 20, again: bool = False) -> DataFrame:
    """(date, factor, ic): correlation of ranks within each date with `least` pairs or more.

    The target is ranked over all its values of the date and then masked to the factor's; again=True ranks both on the
    common rows, which is Spearman proper.
    """
    p = panel.where(F.col(target).isNotNull())
    if not again:
        p = p.withColumn("_ry", average_rank(target))
    long = unpivot(p, factors, [ITEM, DATE, target, *([] if again else ["_ry"])]).where(F.col("value").isNotNull())
    w = Window.partitionBy(DATE, "factor")
    long = long.withColumn("_rx", average_rank("value", w))
    if again:
        long = long.withColumn("_ry", average_rank(target, w))
    return long.groupBy(DATE, "factor").agg(F.count("*").alias("n"), correlation("_rx", "_ry").alias("ic")).where((F.col("n") >= least) & F.col("ic").isNotNull()).select(DATE, "factor", "ic")


def ic_summary(ics: DataFrame) -> DataFrame:
    return ics.groupBy("factor").agg(F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.count("ic").alias("count"))


def ic_stats(ics: DataFrame) -> DataFrame:
    """Mean, spread, ICIR, t and share of positive dates; p comes from stats.t_p_value on these few rows."""
    s = ics.groupBy("factor").agg(F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.count("ic").alias("n"), F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)).alias("positive")).where("n >= 5")
    icir = F.try_divide("mean", "std")
    return s.withColumn("icir", icir).withColumn("t", icir * F.sqrt("n"))


def quantile_bucket(x: str, n: int = 5) -> Column:
    """0-based bucket by the date's linear quantiles, right edges inside, equal edges dropped: how many inner edges lie below."""
    edges = F.array_distinct(F.percentile(x, F.array(*[F.lit(i / n) for i in range(n + 1)])).over(Window.partitionBy(DATE)))
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.when(F.col(x).isNotNull() & (F.size(edges) >= 3), F.size(F.filter(inner, lambda e: e < F.col(x))))


def quantile_returns(panel: DataFrame, factor: str, target: str, n: int = 5) -> DataFrame:
    """(bucket, mean_return, n_dates): mean over dates of each bucket's mean target; dates of 2 n rows or more."""
    p = panel.where(F.col(factor).isNotNull() & F.col(target).isNotNull())
    p = p.withColumn("bucket", quantile_bucket(factor, n)).withColumn("_n", F.count("*").over(Window.partitionBy(DATE)))
    daily = p.where((F.col("_n") >= 2 * n) & F.col("bucket").isNotNull()).groupBy(DATE, "bucket").agg(F.avg(target).alias("r"))
    return daily.groupBy("bucket").agg(F.avg("r").alias("mean_return"), F.count("*").alias("n_dates"))


def icir_summary(stats: DataFrame) -> DataFrame:
    """Mean, sample deviation, least, most and median ICIR of the factors, and how many have one."""
    return stats.agg(F.avg("icir").alias("mean"), F.stddev_samp("icir").alias("std"), F.min("icir").alias("least"), F.max("icir").alias("most"), F.median("icir").alias("median"), F.count("icir").alias("n"))


def top_factors(summary: DataFrame, k: int = 10, value: str = "mean") -> DataFrame:
    """The k factors of the largest mean IC by size; ties by name."""
    return summary.where(F.col(value).isNotNull()).orderBy(F.abs(value).desc(), "factor").limit(k)


def nulls_by_item(panel: DataFrame, factors: list[str]) -> DataFrame:
    """(item, factor, missing, total, rate) over all dates."""
    long = unpivot(panel, factors, [ITEM, DATE])
    out = long.groupBy(ITEM, "factor").agg(F.count_if(F.col("value").isNull()).alias("missing"), F.count("*").alias("total"))
    return out.withColumn("rate", F.col("missing") / F.col("total"))


def autocorr(panel: DataFrame, factor: str, least: int = 15) -> DataFrame:
    """Lag-1 autocorrelation of each item's values, averaged over items of enough of them."""
    w = Window.partitionBy(ITEM).orderBy(DATE)
    p = panel.where(F.col(factor).isNotNull()).select(ITEM, F.col(factor).alias("x"), F.lag(factor).over(w).alias("y"))
    # The first value has no partner: it counts as an observation, not as a pair.
    pair = p.withColumn("x1", F.when(F.col("y").isNotNull(), F.col("x")))
    each = pair.groupBy(ITEM).agg(F.count("*").alias("n"), correlation("x1", "y").alias("ac")).where(F.col("n") >= least)
    return each.agg(F.avg("ac").alias("autocorr"), F.count("ac").alias("n_items"))


def composite_score(stats: DataFrame) -> DataFrame:
    """|ICIR| + half the monotony + 0.3 where the factor is stable (autocorrelation above 0.3)."""
    bonus = F.when(F.col("autocorr") > 0.3, 0.3 * F.col("autocorr")).otherwise(0.0)
    return stats.withColumn("score", F.abs("icir") + 0.5 * F.abs("mono") + bonus)


def factor_correlations(panel: DataFrame, factors: list[str], least: int = 100) -> DataFrame:
    """(a, b, corr, n) of all pairs of factors in one aggregation over the panel."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    aggs = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        corr = F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
        aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), corr.alias("corr"), F.count(x).alias("n")))
    return panel.agg(F.array(*aggs).alias("all")).select(F.explode("all").alias("p")).select("p.*").where(F.col("n") >= least)


def redundancy_filter(ranked: list[str], correlations: DataFrame, most: float = 0.7) -> list[str]:
    """Walk factors in order of merit; keep one if no kept one correlates by `most` or more. The matrix has a row per pair of factors."""
    high = {frozenset((r.a, r.b)) for r in correlations.where(F.abs("corr") >= most).select("a", "b").collect()}
    kept: list[str] = []
    for f in ranked:
        if all(frozenset((f, k)) not in high for k in kept):
            kept.append(f)
    return kept


def pooled_rank(df: DataFrame, x: str, name: str, parts: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """Average rank over all rows (of each group of `by`), without one task for all: counts per value, ranged by value, with prefix sums of ranges."""
    counts = df.groupBy(*by, F.col(x).alias("_v")).agg(F.count("*").alias("_c")).repartitionByRange(parts, *by, "_v").withColumn("_part", F.spark_partition_id())
    counts = counts.persist()
    w = Window.partitionBy(*by).orderBy("_part") if by else Window.orderBy("_part")
    before = counts.groupBy(*by, "_part").agg(F.sum("_c").alias("_s")).select(*by, "_part", F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # a row for each part
    w = Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("_in", F.coalesce(F.sum("_c").over(w), F.lit(0))).join(F.broadcast(before), [*by, "_part"])
    ranks = ranks.select(*[F.col(b).alias(f"_by_{b}") for b in by], "_v", (F.col("_base") + F.col("_in") + (F.col("_c") + 1) / 2).alias(name))
    same = df[x] == ranks["_v"]
    for b in by:
        same = same & (df[b] == ranks[f"_by_{b}"])
    return df.join(ranks, same).drop("_v", *[f"_by_{b}" for b in by])


def spearman(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., spearman, n) over all rows, or over those of each group."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = pooled_rank(pooled_rank(both, x, "_rx", by=by), y, "_ry", by=by)
    figures = [correlation("_rx", "_ry").alias("spearman"), F.count("*").alias("n")]
    return ranked.groupBy(*by).agg(*figures) if by else ranked.agg(*figures)


def precision_at(df: DataFrame, score: str, label: str, share: float, by: list[str], top: bool = True, best: float = 0.9) -> DataFrame:
    """Of the max(1, floor(n * share)) rows of each group with the highest (or lowest) score, how many are really so."""
    if not 0 < share <= 0.5:
        raise ValueError("share must be in (0, 0.5]")
    w = Window.partitionBy(*by)
    order = w.orderBy(F.desc(score) if top else F.asc(score), ITEM)
    picked = df.withColumn("_k", F.greatest(F.lit(1), F.floor(F.count("*").over(w) * share))).withColumn("_r", F.row_number().over(order)).where("_r <= _k")
    hit = F.col(label) >= best if top else F.col(label) <= 1 - best
    return picked.groupBy(*by).agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("precision"), F.count("*").alias("k"))


def ndcg(df: DataFrame, score: str, gain: str, k: int = 10) -> DataFrame:
    """(date, ndcg) with gains as they are and the logarithmic discount."""
    w = Window.partitionBy(DATE)
    p = df.where(F.col(score).isNotNull() & F.col(gain).isNotNull())
    p = p.withColumn("_r", F.row_number().over(w.orderBy(F.desc(score), ITEM))).withColumn("_i", F.row_number().over(w.orderBy(F.desc(gain), ITEM)))

    def dcg(r: str) -> Column:
        return F.sum(F.when(F.col(r) <= k, F.col(gain) / F.log2(F.col(r) + 1)).otherwise(0.0))

    return p.groupBy(DATE).agg(dcg("_r").alias("dcg"), dcg("_i").alias("ideal")).select(DATE, F.try_divide("dcg", "ideal").alias("ndcg"))


def null_profile(panel: DataFrame, factors: list[str]) -> DataFrame:
    """(date, factor, missing, total, rate, items): which items lack a factor on a date."""
    long = unpivot(panel, factors, [ITEM, DATE])
    gone = F.col("value").isNull()
    return long.groupBy(DATE, "factor").agg(F.sum(gone.cast("long")).alias("missing"), F.count("*").alias("total"), F.array_sort(F.collect_list(F.when(gone, F.col(ITEM)))).alias("items")).withColumn("rate", F.col("missing") / F.col("total"))

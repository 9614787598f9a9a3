"""Queries for streams and models."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.base_factors import FACTORS
from panelspark.operators import asof, cross, explain, models, ranking, splits, trees
from panelspark.plans.planner import Plan
from panelspark.sources import tables
from panelspark.streaming import bars

_bases: dict[str, str] = {}


def base(spark: SparkSession) -> str:
    """The folder the cluster shares; a temporary one only where it names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = _bases.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="streams-"))
    return found.rstrip("/")


def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.drain(bars.session_bars(bars.event_stream(spark, sf_dir)), base(spark)).withColumn("opened", F.date_format("opened", "yyyy-MM-dd HH:mm"))


STREAM_BARS_SQL = """
WITH t AS (SELECT CAST(user_id AS VARCHAR) AS item_id, ts, value AS px, row(ts, event_id) AS k, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2000-01-01 07:00:00') AS o FROM events)
SELECT item_id, strftime(o, '%Y-%m-%d %H:%M') AS opened, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, count(*) AS obs FROM t
WHERE o + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events) GROUP BY item_id, o"""


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events twice over: each comes through once."""
    s = bars.event_stream(spark, sf_dir)
    out = bars.drain(bars.deduplicated(s.unionByName(bars.event_stream(spark, sf_dir)), ["event_id"]), base(spark))
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


STREAM_DEDUPE_SQL = "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type"


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bars.event_stream(spark, sf_dir).select("item_id", "event_type", F.col("px").alias("v"), "event_id")
    return bars.drain_into(s, base(spark), ["item_id", "event_type"], "v").select("item_id", "event_type", "v")


STREAM_UPSERT_SQL = "SELECT CAST(user_id AS VARCHAR) AS item_id, event_type, max(value) AS v FROM events GROUP BY 1, 2"


def stream_ewm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.drain(bars.running_mean(bars.event_stream(spark, sf_dir), 0.1), base(spark)).withColumn("mean", F.round("mean", 8))


STREAM_EWM_SQL = "SELECT CAST(user_id AS VARCHAR) AS item_id, event_id, round(list_reduce(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda y, x: y + 0.1::DOUBLE * (x - y)), 8) AS mean FROM events"


def stream_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mean for events that may come late: each one once no earlier one can come."""
    out = bars.drain(bars.ordered_mean(bars.event_stream(spark, sf_dir), 0.1), base(spark), conf=bars.ROCKS)
    return out.withColumn("mean", F.round("mean", 8))


STREAM_ORDERED_SQL = f"SELECT item_id, event_id, mean FROM ({STREAM_EWM_SQL}) JOIN (SELECT event_id, ts FROM events) USING (event_id) WHERE epoch_ms(ts) <= (SELECT max(epoch_ms(ts)) - 3600000 FROM events)"


def stream_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bars.drain(bars.activity(bars.event_stream(spark, sf_dir)), base(spark))
    return out.select("item_id", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), "n")


STREAM_ACTIVITY_SQL = """
WITH t AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM t),
a AS (SELECT CAST(user_id AS VARCHAR) AS item_id, min(ts) AS f, max(ts) AS l, count(*) AS n FROM s GROUP BY user_id, g)
SELECT item_id, strftime(f, '%Y-%m-%d %H:%M:%S') AS first, n FROM a WHERE l + INTERVAL 12 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)"""

FEATURES = ["momentum_5", "bollinger_z_20", "volume_ma_ratio_5_20"]


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, percentile of the five-month return, relevance label."""
    p = Plan({f: FACTORS[f] for f in FEATURES}).apply(tables.month_panel(spark, sf_dir), ["item_id", "date", "close"])
    p = cross.forward_return(p, 5).withColumn("pct", cross.rank_pct("target_5d")).withColumn("label", cross.bucketize(F.col("pct")))
    return _stored(spark, p.dropna(subset=[*FEATURES, "pct"]).select("item_id", "date", *FEATURES, "pct", "label"), "dataset")


def _stored(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: splits, trees and figures read it many times."""
    path = f"{base(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(panel: DataFrame) -> dict[str, DataFrame]:
    roles = splits.chronological(panel).persist()  # a row a date
    return {r: panel.join(F.broadcast(roles.where(F.col("role") == r).select("date")), "date", "left_semi") for r in ("train", "val", "test")}


def gbt_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = parts(dataset(spark, sf_dir))
    model = models.fit(part["train"], FEATURES, "label", models.Params(), part["val"])
    return models.inference_table(models.predict(model, part["test"], FEATURES)).select("item_id", "date", F.round("score", 6).alias("score"), F.round("rank_pct", 6).alias("rank_pct"), F.round("pct", 6).alias("actual_pct"))


def ranker(spark: SparkSession, part: dict[str, DataFrame]) -> ranking.RankModel:
    return ranking.fit_ranker(part["train"], FEATURES, "label", ranking.RankParams(), base(spark), part["val"], "pct")


def rank_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the test dates by a model trained on NDCG, stopped on the validation dates' top accuracy."""
    part = parts(dataset(spark, sf_dir))
    table = models.inference_table(ranker(spark, part).predict(part["test"]))
    return table.select("item_id", "date", F.round("score", 6).alias("score"), F.round("rank_pct", 6).alias("rank_pct"), F.round("pct", 6).alias("actual_pct"))


def asof_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date after the first model, scored at once by the model valid then; a model knows labels that were over half a year before its first day."""
    p = dataset(spark, sf_dir).select("item_id", "date", *FEATURES, "label")
    days = [r.date for r in p.select("date").distinct().orderBy("date").collect()]  # a row a month
    valid = []
    for share in (0.5, 0.75):
        if days:
            first = days[int(len(days) * share)]
            known = p.where(F.col("date") < F.add_months(F.lit(first), -6))
            if not known.isEmpty():
                grown = trees.from_boosted(spark, models.fit(known, FEATURES, "label", models.Params()), base(spark))
                valid.append((str(first), ranking.RankModel(grown, FEATURES)))
    if not valid:
        return spark.createDataFrame([], "item_id string, date date, valid_from string, score double, rank_pct double")
    return asof.batch_scores(p.drop("label"), valid).select("item_id", "date", "valid_from", F.round("score", 6).alias("score"), F.round("rank_pct", 6).alias("rank_pct"))


def shap_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions of every row of the panel under the ranking model."""
    p = dataset(spark, sf_dir)
    details = explain.explained(ranker(spark, parts(p)).trees, p, FEATURES)
    return details.select("item_id", "date", *[F.round(c, 8).alias(c) for c in ("prediction", "base_value", *(f"shap_{f}" for f in FEATURES))])


def shap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dataset(spark, sf_dir)
    out = explain.summary(explain.explained(ranker(spark, parts(p)).trees, p, FEATURES), FEATURES)
    return out.select("rank", "feature", *[F.round(c, 8).alias(c) for c in ("mean_abs_shap", "mean_shap", "std_shap")])


def perm_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dataset(spark, sf_dir)
    model = models.fit(p, FEATURES, "label", models.Params())
    return models.permutation_importance(model, p, FEATURES, "pct", keep=lambda df: _stored(spark, df, "copies")).withColumn("drop", F.round("drop", 6))


def purged_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.purged_cv(dataset(spark, sf_dir), FEATURES, "label", "pct", models.Params(), 3, 150, 30, 0.1, lambda df: _stored(spark, df, "fold"))
    return out.select("fold", "n", *[F.round(c, 6).alias(c) for c in ("spearman", "precision_top", "precision_bottom")])


def row_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.sample_rows(tables.load(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 100)


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Plan({f: FACTORS[f] for f in FEATURES}).apply(tables.month_panel(spark, sf_dir))
    return models.missing_features(p, FEATURES).select("item_id", "date", F.array_join("missing", ",").alias("missing"))


def _missing_sql() -> str:
    from panelspark.registry.cross import panel_sql

    return f"SELECT item_id, date, m AS missing FROM (SELECT item_id, date, concat_ws(',', {', '.join(f'CASE WHEN {f} IS NULL THEN {chr(39)}{f}{chr(39)} END' for f in FEATURES)}) AS m FROM {panel_sql(FEATURES)}) WHERE m <> ''"


def queries() -> dict:
    return {"stream_bars": stream_bars, "stream_dedupe": stream_dedupe, "stream_upsert": stream_upsert, "stream_ewm": stream_ewm, "stream_ordered": stream_ordered, "stream_activity": stream_activity, "gbt_rank": gbt_rank, "rank_ndcg": rank_ndcg, "asof_scores": asof_scores, "shap_details": shap_details, "shap_summary": shap_summary, "perm_importance": perm_importance, "model_purged_cv": purged_cv, "row_sample": row_sample, "missing_features": missing}


def oracle_sql() -> dict:
    return {"stream_bars": STREAM_BARS_SQL, "stream_dedupe": STREAM_DEDUPE_SQL, "stream_upsert": STREAM_UPSERT_SQL, "stream_ewm": STREAM_EWM_SQL, "stream_ordered": STREAM_ORDERED_SQL, "stream_activity": STREAM_ACTIVITY_SQL, "missing_features": _missing_sql()}

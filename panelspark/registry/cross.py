"""Queries for cross-sectional preparation, labels and factor evaluation, on the monthly panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.base_factors import FACTORS
from panelspark.operators import cross, evaluation
from panelspark.operators.asof import asof_join
from panelspark.operators.bars import weak_dates
from panelspark.plans.expr import col, csrank, lag, roll, scale, since_max, tsrank
from panelspark.plans.planner import Plan
from panelspark.plans.registry import Registry
from panelspark.sources import tables
from panelspark.sources.tables import MONTH_SQL

SOME = ["momentum_5", "bollinger_z_20", "volume_ma_ratio_5_20"]
COVARIATES = ["log_price_ma", "log_volume_ma"]


def panel_with(spark: SparkSession, sf_dir: str, names: list[str], extra: dict | None = None) -> DataFrame:
    outputs = {n: FACTORS[n] for n in names} | (extra or {})
    return Plan(outputs).apply(tables.month_panel(spark, sf_dir), ["item_id", "date", "close", "volume"])


def panel_sql(names: list[str], extra: dict | None = None) -> str:
    outputs = {n: FACTORS[n] for n in names} | (extra or {})
    return f"({Plan(outputs).sql(MONTH_SQL, ['item_id', 'date', 'close', 'volume'])})"


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


PRIMITIVES = {
    "cs_rank": {"r": csrank(col("close"))},
    "ts_rank": {"r": tsrank(col("close"), 9)},
    "argmax_dist": {"r": since_max(col("close"), 10)},
    "scale_abs": {"r": scale(col("close") - lag(col("close")))},
    "rolling_minmax": {"lo": roll("min", col("low"), 14, 5), "hi": roll("max", col("high"), 14, 5)},
}


def _primitive(outputs: dict):
    return lambda spark, sf_dir: rounded(Plan(outputs).apply(tables.month_panel(spark, sf_dir)), list(outputs))


def _primitive_sql(outputs: dict) -> str:
    return f"SELECT item_id, date, {', '.join(f'round({n}, 6) AS {n}' for n in outputs)} FROM ({Plan(outputs).sql(MONTH_SQL)})"


def mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cross.mad_winsorize(panel_with(spark, sf_dir, SOME), SOME).select("item_id", "date", *SOME), SOME)


_mad = ", ".join(f"round(CASE WHEN d_{f} > 0 AND abs({f} - m_{f}) > 3.0 * 1.4826 * d_{f} THEN m_{f} ELSE {f} END, 6) AS {f}" for f in SOME)
MAD_SQL = f"""
WITH p AS (SELECT * FROM {panel_sql(SOME)}),
m AS (SELECT *, {', '.join(f'median({f}) OVER (PARTITION BY date) AS m_{f}' for f in SOME)} FROM p),
d AS (SELECT *, {', '.join(f'median(abs({f} - m_{f})) OVER (PARTITION BY date) AS d_{f}' for f in SOME)} FROM m)
SELECT item_id, date, {_mad} FROM d"""


def neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cross.ols_neutralize(panel_with(spark, sf_dir, [SOME[0], *COVARIATES]), [SOME[0]])
    return out.select("item_id", "date", F.round(f"{SOME[0]}_n", 5).alias("z"))


_X = "OVER (PARTITION BY date)"
NEUTRAL_SQL = f"""
WITH p AS (SELECT item_id, date, {SOME[0]} AS y0, log_price_ma AS a0, log_volume_ma AS b0 FROM {panel_sql([SOME[0], *COVARIATES])}),
q AS (SELECT *, CASE WHEN y0 IS NOT NULL AND a0 IS NOT NULL AND b0 IS NOT NULL THEN 1 END AS w FROM p),
r AS (SELECT item_id, date, y0 * w AS y, a0 * w AS a, b0 * w AS b FROM q),
c AS (SELECT *, count(y) {_X} AS n, avg(y) {_X} AS my, avg(a) {_X} AS ma, avg(b) {_X} AS mb, covar_pop(a, a) {_X} AS saa, covar_pop(b, b) {_X} AS sbb, covar_pop(a, b) {_X} AS sab, covar_pop(a, y) {_X} AS say, covar_pop(b, y) {_X} AS sby FROM r),
e AS (SELECT *, CASE WHEN n > 3 THEN (y - my) - (sbb * say - sab * sby) / nullif(saa * sbb - sab * sab, 0) * (a - ma) - (saa * sby - sab * say) / nullif(saa * sbb - sab * sab, 0) * (b - mb) END AS res FROM c)
SELECT item_id, date, round(CASE WHEN stddev_pop(res) {_X} > 1e-12 THEN (res - avg(res) {_X}) / stddev_pop(res) {_X} ELSE res - avg(res) {_X} END, 5) AS z FROM e"""


def z(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel_with(spark, sf_dir, COVARIATES)
    return p.select("item_id", "date", *[F.round(cross.zscore(F.col(c)), 6).alias(c) for c in COVARIATES])


Z_SQL = f"SELECT item_id, date, {', '.join(f'round(CASE WHEN stddev_pop({c}) {_X} > 1e-12 THEN ({c} - avg({c}) {_X}) / stddev_pop({c}) {_X} ELSE {c} - avg({c}) {_X} END, 6) AS {c}' for c in COVARIATES)} FROM {panel_sql(COVARIATES)}"


def demean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' returns less the mean of their nation on the date; the small dimension is joined by broadcast if it is small."""
    nation = tables.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("item_id"), F.col("s_nationkey").cast("string").alias("industry"))
    p = cross.forward_return(tables.month_panel(spark, sf_dir), 1).join(nation, "item_id", "left").withColumn("industry", F.coalesce("industry", F.lit("UNKNOWN")))
    return cross.demean_by(p, "target_1d", ["date", "industry"], "excess").select("item_id", "date", "industry", F.round("excess", 6).alias("excess"))


DEMEAN_SQL = f"""
WITH p AS (SELECT item_id, date, lead(close, 1) OVER (PARTITION BY item_id ORDER BY date) / nullif(close, 0) - 1 AS r FROM {MONTH_SQL}),
j AS (SELECT p.*, coalesce(CAST(s_nationkey AS VARCHAR), 'UNKNOWN') AS industry FROM p LEFT JOIN supplier ON CAST(s_suppkey AS VARCHAR) = item_id)
SELECT item_id, date, industry, round(r - avg(r) OVER (PARTITION BY date, industry), 6) AS excess FROM j"""


def weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_dates(tables.month_panel(spark, sf_dir), 98).groupBy("date").agg(F.count("*").alias("n"))


WEAK_SQL = f"SELECT date, count(*) AS n FROM {MONTH_SQL} GROUP BY date HAVING count(*) >= 98"


def lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cross.lag_fan_out(panel_with(spark, sf_dir, ["log_return_1"]), [("log_return_1", k) for k in cross.LAGS])
    names = [f"log_return_1_lag{k}" for k in cross.LAGS]
    return rounded(out.select("item_id", "date", *names), names)


LAGS_SQL = f"SELECT item_id, date, {', '.join(f'round(lag(log_return_1, {k}) OVER (PARTITION BY item_id ORDER BY date), 6) AS log_return_1_lag{k}' for k in cross.LAGS)} FROM {panel_sql(['log_return_1'])}"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cross.forward_return(tables.month_panel(spark, sf_dir), 5)
    p = p.withColumn("pct", cross.rank_pct("target_5d"))
    return p.select("item_id", "date", F.round("target_5d", 6).alias("target_5d"), cross.updown(F.col("target_5d")).alias("updown"), F.round("pct", 6).alias("pct"), cross.bucketize(F.col("pct")).alias("label"))


LABELS_SQL = f"""
WITH p AS (SELECT item_id, date, lead(close, 5) OVER (PARTITION BY item_id ORDER BY date) / nullif(close, 0) - 1 AS t FROM {MONTH_SQL}),
r AS (SELECT *, count(t) {_X} AS n, rank() OVER (PARTITION BY date ORDER BY t ASC NULLS LAST) + (count(*) OVER (PARTITION BY date ORDER BY t ASC NULLS LAST RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0 AS k FROM p),
s AS (SELECT *, CASE WHEN t IS NOT NULL AND n >= 20 THEN k / n END AS pct FROM r)
SELECT item_id, date, round(t, 6) AS target_5d, CASE WHEN t > 0.01 THEN 2.0 WHEN t < -0.01 THEN 0.0 ELSE 1.0 END::DOUBLE AS updown, round(pct, 6) AS pct,
  CASE WHEN pct IS NULL THEN NULL WHEN pct < 0.4 THEN 0.0 WHEN pct < 0.7 THEN 1.0 WHEN pct < 0.9 THEN 3.0 WHEN pct < 0.97 THEN 7.0 ELSE 10.0 END::DOUBLE AS label FROM s"""


def calendar_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross.calendar_return(tables.day_panel(spark, sf_dir), 3).select("item_id", "date", F.round("target_3cd", 6).alias("target_3cd"))


CALENDAR_SQL = f"WITH p AS (SELECT * FROM {tables.DAY_SQL}) SELECT a.item_id, a.date, round(b.close / nullif(a.close, 0) - 1, 6) AS target_3cd FROM p a LEFT JOIN p b ON a.item_id = b.item_id AND b.date = a.date + 3"

IC_FACTORS = ["momentum_5", "bollinger_z_20"]


def _ic_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_with(spark, sf_dir, [*IC_FACTORS, "target_8d"])


def _rank_sql(x: str, by: str) -> str:
    order = f"PARTITION BY {by} ORDER BY {x}"
    return f"(rank() OVER ({order}) + (count(*) OVER ({order} RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0)"


def _ics_sql(again: bool) -> str:
    ry = "ry" if not again else _rank_sql("target_8d", "date, factor")
    return f"""(SELECT date, factor, count(*) AS n, corr(rx, ry2) AS ic FROM (
  SELECT date, factor, {_rank_sql('value', 'date, factor')} AS rx, {ry} AS ry2 FROM (
    SELECT * FROM ({' UNION ALL '.join(f"SELECT date, '{f}' AS factor, {f} AS value, target_8d, ry FROM (SELECT *, {_rank_sql('target_8d', 'date')} AS ry FROM {panel_sql([*IC_FACTORS, 'target_8d'])} WHERE target_8d IS NOT NULL)" for f in IC_FACTORS)}) WHERE value IS NOT NULL))
GROUP BY date, factor HAVING count(*) >= 20)"""


def _ic(again: bool):
    return lambda spark, sf_dir: evaluation.rank_ic(_ic_panel(spark, sf_dir), IC_FACTORS, "target_8d", again=again).withColumn("ic", F.round("ic", 7))


def ic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.ic_stats(evaluation.rank_ic(_ic_panel(spark, sf_dir), IC_FACTORS, "target_8d"))
    return rounded(out, ["mean", "std", "positive", "icir", "t"])


IC_STATS_SQL = f"SELECT factor, round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS std, count(ic) AS n, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive, round(avg(ic) / stddev_samp(ic), 6) AS icir, round(avg(ic) / stddev_samp(ic) * sqrt(count(ic)), 6) AS t FROM {_ics_sql(False)} GROUP BY factor HAVING count(ic) >= 5"


def ic_by_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean IC of one factor at each lag, as a matrix with a column per lag."""
    p = cross.lag_fan_out(_ic_panel(spark, sf_dir), [("momentum_5", k) for k in cross.LAGS])
    long = evaluation.ic_summary(evaluation.rank_ic(p, [f"momentum_5_lag{k}" for k in cross.LAGS], "target_8d"))
    long = long.select(F.regexp_extract("factor", "^(.*)_lag\\d+$", 1).alias("factor"), F.regexp_extract("factor", "_lag(\\d+)$", 1).cast("int").alias("lag"), "mean")
    return long.groupBy("factor").pivot("lag", list(cross.LAGS)).agg(F.first("mean")).select("factor", *[F.round(F.col(f"`{k}`"), 6).alias(f"lag_{k}") for k in cross.LAGS])


_lagged = f"(SELECT *, {', '.join(f'lag(momentum_5, {k}) OVER (PARTITION BY item_id ORDER BY date) AS l{k}' for k in cross.LAGS)} FROM {panel_sql([*IC_FACTORS, 'target_8d'])})"
_by_lag = " UNION ALL ".join(
    f"SELECT {k} AS lag, avg(ic) AS mean FROM (SELECT date, corr(rx, ry) AS ic FROM (SELECT date, {_rank_sql(f'l{k}', 'date')} AS rx, ry FROM (SELECT *, {_rank_sql('target_8d', 'date')} AS ry FROM {_lagged} WHERE target_8d IS NOT NULL) WHERE l{k} IS NOT NULL) GROUP BY date HAVING count(*) >= 20)" for k in cross.LAGS
)
IC_BY_LAG_SQL = f"SELECT 'momentum_5' AS factor, {', '.join(f'round(max(CASE WHEN lag = {k} THEN mean END), 6) AS lag_{k}' for k in cross.LAGS)} FROM ({_by_lag}) HAVING count(mean) > 0"  # no date with enough rows: no row


def top_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten factors of the largest mean IC by size, unlagged."""
    summary = evaluation.ic_summary(evaluation.rank_ic(_ic_panel(spark, sf_dir), IC_FACTORS, "target_8d"))
    return rounded(evaluation.top_factors(summary.select("factor", "mean", F.col("count").alias("n"))), ["mean"])


TOP_FACTORS_SQL = f"SELECT factor, round(avg(ic), 6) AS mean, count(ic) AS n FROM {_ics_sql(False)} GROUP BY factor HAVING count(ic) > 0 ORDER BY abs(avg(ic)) DESC, factor LIMIT 10"

BETWEEN = ["momentum_5", "return_skew_20", "bollinger_z_20", "donchian_pos_20"]


def factor_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two years of factors; bars before them are read as far back as the windows look."""
    out = Plan({n: FACTORS[n] for n in BETWEEN} | {"r": csrank(lag(csrank(col("close")), 2))}).between(tables.month_panel(spark, sf_dir), "1998-01-01", "1999-12-31")
    return rounded(out, [*BETWEEN, "r"])


BETWEEN_SQL = f"SELECT item_id, date, {', '.join(f'round({n}, 6) AS {n}' for n in [*BETWEEN, 'r'])} FROM ({Plan({n: FACTORS[n] for n in BETWEEN} | {'r': csrank(lag(csrank(col('close')), 2))}).sql(MONTH_SQL)}) WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'"


def _registry() -> Registry:
    mine = Registry(FACTORS)
    mine.factor("calm_momentum", deps=["momentum_20", "realized_vol_20"], window=4)(lambda m, v: roll("avg", m / v, 5, 1))
    mine.factor("calm_rank", deps=["calm_momentum"])(csrank)
    return mine


def user_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors of a user's own beside a built-in one, in one plan."""
    names = ["calm_momentum", "calm_rank", "momentum_20"]
    return rounded(_registry().plan(names).apply(tables.month_panel(spark, sf_dir)), names)


USER_FACTOR_SQL = f"SELECT item_id, date, {', '.join(f'round({n}, 6) AS {n}' for n in ('calm_momentum', 'calm_rank', 'momentum_20'))} FROM ({_registry().plan(['calm_momentum', 'calm_rank', 'momentum_20']).sql(MONTH_SQL)})"


def asof_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's supplier as last known when it was shipped: the last complete row of features of a month that was over."""
    known = panel_with(spark, sf_dir, SOME).dropna(subset=SOME).select("item_id", F.add_months("date", 1).alias("known"), *SOME)
    lines = tables.load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("item_id"), "l_orderkey", "l_linenumber", "l_shipdate")
    out = asof_join(lines, known, ["item_id"], "l_shipdate", "known", SOME)
    return rounded(out.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")), SOME)


ASOF_SQL = f"""
WITH k AS (SELECT item_id, CAST(date + INTERVAL 1 MONTH AS DATE) AS known, {', '.join(SOME)} FROM {panel_sql(SOME)} WHERE {' AND '.join(f'{f} IS NOT NULL' for f in SOME)}),
l AS (SELECT CAST(l_suppkey AS VARCHAR) AS item_id, l_orderkey, l_linenumber, l_shipdate FROM lineitem)
SELECT l.item_id, l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate, known, {', '.join(f'round({f}, 6) AS {f}' for f in SOME)} FROM l ASOF LEFT JOIN k ON l.item_id = k.item_id AND l.l_shipdate >= k.known"""


def icir_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = evaluation.ic_stats(evaluation.rank_ic(_ic_panel(spark, sf_dir), IC_FACTORS, "target_8d"))
    return rounded(evaluation.icir_summary(stats), ["mean", "std", "least", "most", "median"])


ICIR_SQL = f"SELECT round(avg(icir), 6) AS mean, round(stddev_samp(icir), 6) AS std, round(min(icir), 6) AS least, round(max(icir), 6) AS most, round(median(icir), 6) AS median, count(icir) AS n FROM (SELECT avg(ic) / stddev_samp(ic) AS icir FROM {_ics_sql(False)} GROUP BY factor HAVING count(ic) >= 5)"


def nulls_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.nulls_by_item(_ic_panel(spark, sf_dir), IC_FACTORS), ["rate"])


NULLS_BY_ITEM_SQL = " UNION ALL ".join(f"SELECT item_id, '{f}' AS factor, count(*) - count({f}) AS missing, count(*) AS total, round((count(*) - count({f})) / count(*), 6) AS rate FROM {panel_sql([*IC_FACTORS, 'target_8d'])} GROUP BY item_id" for f in IC_FACTORS)


def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.quantile_returns(_ic_panel(spark, sf_dir), "momentum_5", "target_8d").withColumn("mean_return", F.round("mean_return", 6))


QUANTILES_SQL = f"""
WITH p AS (SELECT * FROM {panel_sql([*IC_FACTORS, 'target_8d'])} WHERE momentum_5 IS NOT NULL AND target_8d IS NOT NULL),
e AS (SELECT date, count(*) AS n, list_sort(list_distinct(quantile_cont(momentum_5, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS edges FROM p GROUP BY date),
b AS (SELECT p.date, target_8d, len(list_filter(edges[2:len(edges) - 1], lambda x: x < momentum_5)) AS bucket FROM p JOIN e USING (date) WHERE n >= 10 AND len(edges) >= 3)
SELECT CAST(bucket AS INTEGER) AS bucket, round(avg(r), 6) AS mean_return, count(*) AS n_dates FROM (SELECT date, bucket, avg(target_8d) AS r FROM b GROUP BY date, bucket) GROUP BY bucket"""


def autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.autocorr(_ic_panel(spark, sf_dir), "bollinger_z_20").withColumn("autocorr", F.round("autocorr", 6))


AUTOCORR_SQL = f"""
WITH p AS (SELECT item_id, bollinger_z_20 AS x, lag(bollinger_z_20) OVER (PARTITION BY item_id ORDER BY date) AS y FROM {panel_sql([*IC_FACTORS, 'target_8d'])} WHERE bollinger_z_20 IS NOT NULL)
SELECT round(avg(ac), 6) AS autocorr, count(ac) AS n_items FROM (SELECT item_id, corr(x, y) AS ac FROM p GROUP BY item_id HAVING count(*) >= 15)"""


def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite score of each factor, from its IC, quantile and stability figures."""
    p = _ic_panel(spark, sf_dir)
    stats = evaluation.ic_stats(evaluation.rank_ic(p, IC_FACTORS, "target_8d"))
    rest = None
    for f in IC_FACTORS:
        q = evaluation.quantile_returns(p, f, "target_8d").agg(F.corr("bucket", "mean_return").alias("mono"))
        one = q.crossJoin(evaluation.autocorr(p, f)).select(F.lit(f).alias("factor"), "mono", "autocorr")  # a row each
        rest = one if rest is None else rest.unionByName(one)
    return evaluation.composite_score(stats.join(rest, "factor")).select("factor", F.round("score", 5).alias("score"))


def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.factor_correlations(panel_with(spark, sf_dir, SOME), SOME).withColumn("corr", F.round("corr", 6))


CORRELATIONS_SQL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n FROM {panel_sql(SOME)}" for i, a in enumerate(SOME) for b in SOME[i + 1 :])


def redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["momentum_5", "bollinger_z_20", "stoch_k_14", "price_ma_gap_20", "volume_ma_ratio_5_20"]
    kept = evaluation.redundancy_filter(names, evaluation.factor_correlations(panel_with(spark, sf_dir, names), names))
    return spark.createDataFrame([(i, f) for i, f in enumerate(kept)], "place int, factor string")


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.spearman(_ic_panel(spark, sf_dir), "bollinger_z_20", "target_8d").withColumn("spearman", F.round("spearman", 7))


SPEARMAN_SQL = f"""
WITH p AS (SELECT bollinger_z_20 AS x, target_8d AS y FROM {panel_sql([*IC_FACTORS, 'target_8d'])} WHERE bollinger_z_20 IS NOT NULL AND target_8d IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (ORDER BY x RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (ORDER BY y RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0 AS ry FROM p)
SELECT round(corr(rx, ry), 7) AS spearman, count(*) AS n FROM r"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _ic_panel(spark, sf_dir).withColumn("pct", cross.rank_pct("target_8d")).where("pct IS NOT NULL AND bollinger_z_20 IS NOT NULL")
    return p.withColumn("gain", cross.bucketize(F.col("pct"))).withColumn("s", F.round("bollinger_z_20", 6))


def precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.precision_at(_scored(spark, sf_dir), "s", "pct", 0.1, ["date"])
    return out.select("date", F.round("precision", 6).alias("precision"), "k")


_scored_sql = f"""(SELECT *, CASE WHEN pct < 0.4 THEN 0.0 WHEN pct < 0.7 THEN 1.0 WHEN pct < 0.9 THEN 3.0 WHEN pct < 0.97 THEN 7.0 ELSE 10.0 END AS gain, round(bollinger_z_20, 6) AS s FROM (
  SELECT *, CASE WHEN target_8d IS NOT NULL AND count(target_8d) {_X} >= 20 THEN (rank() OVER (PARTITION BY date ORDER BY target_8d ASC NULLS LAST) + (count(*) OVER (PARTITION BY date ORDER BY target_8d ASC NULLS LAST RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0) / count(target_8d) {_X} END AS pct FROM {panel_sql([*IC_FACTORS, 'target_8d'])}) WHERE pct IS NOT NULL AND bollinger_z_20 IS NOT NULL)"""
PRECISION_SQL = f"""
WITH p AS (SELECT *, greatest(1, floor(count(*) {_X} * 0.1)) AS k, row_number() OVER (PARTITION BY date ORDER BY s DESC, item_id) AS r FROM {_scored_sql})
SELECT date, round(avg(CASE WHEN pct >= 0.9 THEN 1.0 ELSE 0.0 END), 6) AS precision, count(*) AS k FROM p WHERE r <= k GROUP BY date"""


def ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.ndcg(_scored(spark, sf_dir), "s", "gain").withColumn("ndcg", F.round("ndcg", 6))


NDCG_SQL = f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY s DESC, item_id) AS r, row_number() OVER (PARTITION BY date ORDER BY gain DESC, item_id) AS i FROM {_scored_sql})
SELECT date, round(sum(CASE WHEN r <= 10 THEN gain / log2(r + 1) ELSE 0 END) / nullif(sum(CASE WHEN i <= 10 THEN gain / log2(i + 1) ELSE 0 END), 0), 6) AS ndcg FROM p GROUP BY date"""


def nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.null_profile(panel_with(spark, sf_dir, ["momentum_5", "momentum_20"]), ["momentum_5", "momentum_20"])
    return out.select("date", "factor", "missing", "total", F.round("rate", 6).alias("rate"), F.array_join("items", ",").alias("items"))


NULLS_SQL = f"""
WITH p AS (SELECT * FROM {panel_sql(['momentum_5', 'momentum_20'])}),
u AS (SELECT date, item_id, 'momentum_5' AS factor, momentum_5 AS v FROM p UNION ALL SELECT date, item_id, 'momentum_20', momentum_20 FROM p)
SELECT date, factor, CAST(count(*) - count(v) AS BIGINT) AS missing, count(*) AS total, round((count(*) - count(v)) / count(*), 6) AS rate, coalesce(string_agg(CASE WHEN v IS NULL THEN item_id END, ',' ORDER BY item_id), '') AS items FROM u GROUP BY date, factor"""


def queries() -> dict:
    out = {k: _primitive(v) for k, v in PRIMITIVES.items()}
    return out | {
        "mad_winsorize": mad, "ols_neutralize": neutral, "zscore_date": z, "industry_demean": demean, "weak_dates": weak, "lag_fan_out": lags, "labels": labels, "calendar_target": calendar_target,
        "rank_ic": _ic(False), "rank_ic_again": _ic(True), "ic_stats": ic_stats, "ic_by_lag": ic_by_lag, "icir_summary": icir_summary, "nulls_by_item": nulls_by_item, "quantile_returns": quantiles, "autocorr1": autocorr, "factor_score": score, "factor_correlations": correlations,
        "redundancy_filter": redundancy, "spearman_pooled": spearman, "precision_top": precision, "ndcg": ndcg, "null_profile": nulls,
        "top_factors": top_factors, "factor_between": factor_between, "user_factor": user_factor, "asof_features": asof_features,
    }


def oracle_sql() -> dict:
    out = {k: _primitive_sql(v) for k, v in PRIMITIVES.items()}
    ic = {k: f"SELECT date, factor, round(ic, 7) AS ic FROM {_ics_sql(again)} WHERE ic IS NOT NULL" for k, again in (("rank_ic", False), ("rank_ic_again", True))}
    return out | ic | {
        "mad_winsorize": MAD_SQL, "ols_neutralize": NEUTRAL_SQL, "zscore_date": Z_SQL, "industry_demean": DEMEAN_SQL, "weak_dates": WEAK_SQL, "lag_fan_out": LAGS_SQL, "labels": LABELS_SQL, "calendar_target": CALENDAR_SQL,
        "ic_stats": IC_STATS_SQL, "ic_by_lag": IC_BY_LAG_SQL, "icir_summary": ICIR_SQL, "nulls_by_item": NULLS_BY_ITEM_SQL, "quantile_returns": QUANTILES_SQL, "autocorr1": AUTOCORR_SQL, "factor_correlations": CORRELATIONS_SQL, "spearman_pooled": SPEARMAN_SQL, "precision_top": PRECISION_SQL, "ndcg": NDCG_SQL, "null_profile": NULLS_SQL,
        "top_factors": TOP_FACTORS_SQL, "factor_between": BETWEEN_SQL, "user_factor": USER_FACTOR_SQL, "asof_features": ASOF_SQL,
    }

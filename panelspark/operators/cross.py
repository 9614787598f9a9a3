"""Cross-sectional preparation: winsorize, neutralize, standardize, demean, lag fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.plans.expr import DATE, EPS, ITEM

LAGS = [0, 1, 2, 3, 4, 5, 7, 10, 15]


def X():  # noqa: N802
    """The items of a date."""
    return Window.partitionBy(DATE)


def T():  # noqa: N802
    """An item's dates in order."""
    return Window.partitionBy(ITEM).orderBy(DATE)


def mad_winsorize(panel: DataFrame, factors: list[str], times: float = 3.0) -> DataFrame:
    """Values further than times * 1.4826 * MAD from the date's median become that median; a MAD of 0 leaves all."""
    out = panel.withColumns({f"_m_{f}": F.median(f).over(X()) for f in factors})
    out = out.withColumns({f"_d_{f}": F.median(F.abs(F.col(f) - F.col(f"_m_{f}"))).over(X()) for f in factors})
    far = {f: (F.col(f"_d_{f}") > 0) & (F.abs(F.col(f) - F.col(f"_m_{f}")) > times * 1.4826 * F.col(f"_d_{f}")) for f in factors}
    out = out.withColumns({f: F.when(far[f], F.col(f"_m_{f}")).otherwise(F.col(f)) for f in factors})
    return out.drop(*[f"_{k}_{f}" for k in "md" for f in factors])


def neutralized(y: Column, a: Column, b: Column) -> Column:
    """Residual of y on 1, a, b over the date's complete rows, as a z-score; NULL for three rows or fewer.

    Two covariates need no solver: the coefficients are ratios of covariances. Where a and b are collinear b is left
    out, where a does not vary either, y is demeaned. A residual without spread is left at 0.
    """
    whole = y.isNotNull() & a.isNotNull() & b.isNotNull()
    y, a, b = (F.when(whole, v) for v in (y, a, b))

    def cov(p: Column, q: Column) -> Column:
        return F.covar_pop(p, q).over(X())

    saa, sbb, sab, say, sby = cov(a, a), cov(b, b), cov(a, b), cov(a, y), cov(b, y)
    det = saa * sbb - sab * sab
    full = det > 1e-12 * saa * sbb
    one = saa > EPS
    slope_a = F.when(full, (sbb * say - sab * sby) / F.nullif(det, F.lit(0.0))).when(one, F.try_divide(say, saa)).otherwise(0.0)
    slope_b = F.when(full, (saa * sby - sab * say) / F.nullif(det, F.lit(0.0))).when(~one & (sbb > EPS), F.try_divide(sby, sbb)).otherwise(0.0)
    residual = (y - F.avg(y).over(X())) - slope_a * (a - F.avg(a).over(X())) - slope_b * (b - F.avg(b).over(X()))
    return F.when(F.count(y).over(X()) > 3, residual)


def zscore(x: Column) -> Column:
    """Over the date, population spread; a date without spread is demeaned."""
    spread = F.stddev_pop(x).over(X())
    return F.when(spread > EPS, (x - F.avg(x).over(X())) / spread).otherwise(x - F.avg(x).over(X()))


def ols_neutralize(panel: DataFrame, factors: list[str], covariates: tuple[str, str] = ("log_price_ma", "log_volume_ma"), suffix: str = "_n") -> DataFrame:
    out = panel.withColumns({f"_r_{f}": neutralized(F.col(f), F.col(covariates[0]), F.col(covariates[1])) for f in factors})
    out = out.withColumns({f"{f}{suffix}": zscore(F.col(f"_r_{f}")) for f in factors})
    return out.drop(*[f"_r_{f}" for f in factors])


def demean_by(panel: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    return panel.withColumn(name, F.col(value) - F.avg(value).over(Window.partitionBy(*by)))


def lag_fan_out(panel: DataFrame, pairs: list[tuple[str, int]] | None = None, factors: list[str] | None = None, lags: list[int] | None = None) -> DataFrame:
    """{factor}_lag{k} for each pair, or each factor and lag; one window holds them all. Before any filter by date."""
    pairs = pairs if pairs is not None else [(f, k) for f in factors or [] for k in (LAGS if lags is None else lags)]
    return panel.withColumns({f"{f}_lag{k}": F.lag(f, k).over(T()) for f, k in pairs})


# Labels.


def forward_return(panel: DataFrame, horizon: int, close: str = "close") -> DataFrame:
    return panel.withColumn(f"target_{horizon}d", F.try_divide(F.lead(close, horizon).over(T()), F.col(close)) - 1)


def calendar_return(panel: DataFrame, days: int, close: str = "close") -> DataFrame:
    """The return to the bar exactly so many days on: an equi-join on the shifted date."""
    later = panel.select(F.col(ITEM), F.date_sub(DATE, days).alias(DATE), F.col(close).alias("_later"))
    return panel.join(later, [ITEM, DATE], "left").withColumn(f"target_{days}cd", F.try_divide("_later", close) - 1).drop("_later")


def updown(target: Column, band: float = 0.01) -> Column:
    """2 above the band, 0 below it, 1 between (and for NULL)."""
    return F.when(target > band, 2.0).when(target < -band, 0.0).otherwise(1.0)


def average_rank(x: str | Column, window=None) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    window = X() if window is None else window
    order = window.orderBy(x.asc_nulls_last())
    peers = order.rangeBetween(Window.currentRow, Window.currentRow)
    return F.when(x.isNotNull(), F.rank().over(order) + (F.count(F.lit(1)).over(peers) - 1) / 2)


def rank_pct(x: str, least: int = 20) -> Column:
    n = F.count(x).over(X())
    return F.when(n >= least, average_rank(x) / n)


def bucketize(p: Column, edges=(0.4, 0.7, 0.9, 0.97), labels=(0.0, 1.0, 3.0, 7.0, 10.0)) -> Column:
    out = F.when(p.isNull(), F.lit(None).cast("double"))
    for edge, label in zip(edges, labels):
        out = out.when(p < edge, label)
    return out.otherwise(labels[-1])

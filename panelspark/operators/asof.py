"""As-of joins and scoring: what was last known of an item, and which model was valid, at a time.

The join cuts each item's times into stretches. The last row of each stretch is an aggregate, small beside the history; a window over those
tells what each stretch begins with, and only within a stretch are rows ordered against each other. So an item with a third of all rows is dealt over
its stretches, no window holds a whole history, and both sides move once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.cross import X, average_rank
from panelspark.operators.ranking import RankModel
from panelspark.operators.trees import matrix
from panelspark.plans.expr import DATE, ITEM

STRETCH = 90 * 86_400  # seconds


def seconds(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp")) / 1_000_000


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], within: float | None = None, stretch: float = STRETCH) -> DataFrame:
    """left with `values` and `right_time` (both under their names) of the last right row of its keys at or before its time; NULL where there is none.

    within: only rows at most so many seconds older count. Of right rows of one time the greatest by (values) counts. Rows of left whose key or time is NULL find
    nothing; right ones are passed over. Columns of left come first, all of them; names must not clash.
    """
    clash = ({*values, right_time} & set(left.columns)) - set(by)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    cell = lambda t: F.floor(seconds(F.col(t)) / stretch).cast("long")
    held = F.struct(F.col(right_time).alias("t"), *[F.col(v) for v in values])
    known = right.where(F.col(right_time).isNotNull()).select(*by, cell(right_time).alias("_cell"), held.alias("_held"))
    # The last row of each stretch, and what came before it: a row a stretch of an item.
    ends = known.groupBy(*by, "_cell").agg(F.max("_held").alias("_end"))
    asked = left.select(*by, cell(left_time).alias("_cell")).where(F.col("_cell").isNotNull()).distinct()
    cells = asked.withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType)).unionByName(ends).groupBy(*by, "_cell").agg(F.max("_end").alias("_end"))
    before = cells.withColumn("_carry", F.max("_end").over(Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))).where(F.col("_carry").isNotNull())
    carried = before.select(*by, "_cell", F.lit(0).alias("_kind"), F.col("_carry").alias("_held"))
    rows = left.select(*by, cell(left_time).alias("_cell"), F.lit(1).alias("_kind"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"))
    both = rows.unionByName(known.withColumn("_kind", F.lit(0)), allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    at = F.when(F.col("_kind") == 1, F.col(f"_row.{left_time}").cast("timestamp")).otherwise(F.col("_held.t").cast("timestamp"))
    order = Window.partitionBy(*by, "_cell").orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    joined = both.withColumn("_last", F.max("_held").over(order)).where("_kind = 1")
    fits = F.col("_cell").isNotNull()
    for b in by:
        fits = fits & F.col(b).isNotNull()
    if within is not None:
        fits = fits & (seconds(F.col(f"_row.{left_time}")) - seconds(F.col("_last.t")) <= within)
    return joined.select("_row.*", F.when(fits, F.col("_last.t")).alias(right_time), *[F.when(fits, F.col(f"_last.{v}")).alias(v) for v in values])


def last_complete(panel: DataFrame, features: list[str], date: str, days: int | None = None) -> DataFrame:
    """(item_id, date, features): each item's last row with every feature, at or before `date` and at most `days` older.

    Partial aggregates under a plain range of dates: no window, and the range reaches the scan.
    """
    rows = panel.where(F.col(DATE) <= F.lit(date).cast("date"))
    if days is not None:
        rows = rows.where(F.col(DATE) >= F.date_sub(F.lit(date).cast("date"), days))
    best = rows.dropna(subset=features).groupBy(ITEM).agg(F.max(F.struct(DATE, *features)).alias("_b"))
    return best.select(ITEM, *[F.col(f"_b.{c}") for c in (DATE, *features)])


def scored_asof(panel: DataFrame, models: list[tuple[str, RankModel]], name: str = "score") -> DataFrame:
    """panel with `valid_from` and a score by the model valid at each row's date: the one of the latest first day at or before it.

    One pass over the panel for all models and dates. Rows before the first model, or that lack a feature of it, are left out.
    """
    if not models:
        raise ValueError("no model")
    models = sorted(models, key=lambda m: m[0])
    features = sorted({f for _, m in models for f in m.features})
    days = np.array([m[0] for m in models], "datetime64[D]").astype(np.int64)
    made = [F.col(f"`{f}`").cast("double").alias(f"_f{i}") for i, f in enumerate(features)]
    rows = panel.where(F.col(DATE) >= F.lit(models[0][0]).cast("date")).withColumn("_day", F.unix_date(F.col(DATE).cast("date")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.num_columns - len(features) - 1
            x = matrix(batch, kept + 1, len(features))
            which = np.searchsorted(days, batch.column(kept).to_numpy(), "right") - 1
            total, whole = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for k in np.unique(which):
                own = [features.index(f) for f in models[k][1].features]
                at = np.flatnonzero((which == k) & ~np.isnan(x[:, own]).any(1))
                for tree in models[k][1].trees:
                    total[at] += tree.predict(x[np.ix_(at, own)])
                whole[at] = True
            valid = pa.array([models[k][0] for k in which], pa.string())
            out = pa.RecordBatch.from_arrays([*batch.columns[:kept], valid, pa.array(total)], [*batch.schema.names[:kept], "valid_from", name])
            yield out.filter(pa.array(whole))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in panel.schema.fields)
    return rows.select(*[F.col(f"`{c}`") for c in panel.columns], "_day", *made).mapInArrow(run, f"{schema}, valid_from string, `{name}` double")


def live_scores(panel: DataFrame, models: list[tuple[str, RankModel]], date: str, days: int | None = None, names: DataFrame | None = None) -> DataFrame:
    """The cross-section of `date`: every item by its last complete row, scored by the model valid on `date`, ranked; best first.

    as_of is the date of an item's row. Scores rank among the items of the day (average ranks, as shares).
    """
    features = sorted({f for _, m in models for f in m.features})
    rows = last_complete(panel, features, date, days).withColumnRenamed(DATE, "as_of").withColumn(DATE, F.lit(date).cast("date"))
    out = scored_asof(rows, models).withColumn("rank_pct", average_rank("score") / F.count("score").over(X()))
    if names is not None:
        out = out.join(names, ITEM, "left").withColumn("name", F.coalesce("name", ITEM))
    return out.drop(*features).orderBy(F.desc("score"), ITEM)


def batch_scores(panel: DataFrame, models: list[tuple[str, RankModel]], least: int = 20) -> DataFrame:
    """(item_id, date, valid_from, score, rank_pct) for every date of the panel at once; dates of fewer than `least` scored items are left out."""
    out = scored_asof(panel, models).withColumn("_n", F.count("score").over(X())).where(F.col("_n") >= least)
    return out.select(ITEM, DATE, "valid_from", "score", (average_rank("score") / F.col("_n")).alias("rank_pct"))

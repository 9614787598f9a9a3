"""Entities and their ids: expansion to variants, id assignment, lookups by several keys, conditional updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expand_tiers(items: DataFrame, tier: str, counts: dict[str, int], variants: list[str], default: int = 2) -> DataFrame:
    """A row for each variant an item of its tier has: the first so many of `variants`; unknown tiers have `default`."""
    n = F.lit(default)
    for name, k in counts.items():
        n = F.when(F.col(tier) == name, k).otherwise(n)
    return items.withColumn("variant", F.explode(F.slice(F.array(*[F.lit(v) for v in variants]), F.lit(1), n)))


def priority_sort(df: DataFrame, column: str, order: list[str], *then: str) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return df.withColumn("_p", F.when(place == 0, len(order) + 1).otherwise(place)).orderBy("_p", *then).drop("_p")


def assign_ids(new: DataFrame, segment: list[str], order: list[Column | str], starts: DataFrame, known: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """Consecutive ids within each segment, from its start or after the greatest id it has already.

    starts: (segment..., start). known: (segment..., id) of what was assigned before; a re-run cannot collide with it.
    """
    first = starts
    if known is not None:
        used = known.groupBy(*segment).agg(F.max(F.col(id_col).cast("long")).alias("_used"))
        first = starts.join(used, segment, "left").withColumn("start", F.greatest("start", F.coalesce(F.col("_used") + 1, F.lit(0)))).drop("_used")
    w = Window.partitionBy(*segment).orderBy(*order)
    return new.withColumn("_n", F.row_number().over(w)).join(first, segment).withColumn(id_col, (F.col("start") + F.col("_n") - 1).cast("long")).drop("_n", "start")


def skip_known(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return new.join(known.select(key), key, "left_anti")


def new_groups(items: DataFrame, base: str, variant: str, local: DataFrame) -> DataFrame:
    """(base, variants) of bases none of whose rows is in `local` (base): what is new as a whole."""
    return items.groupBy(base).agg(F.array_sort(F.collect_set(variant)).alias("variants")).join(local.select(base), base, "left_anti")


def nest(rows: DataFrame, by: list[str], variant: list[str], name: str = "variants") -> DataFrame:
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*variant))).alias(name))


def two_hop(first: DataFrame, second: DataFrame, via: str) -> DataFrame:
    return first.join(second, via)


def fill_when_empty(df: DataFrame, updates: DataFrame, key: str, column: str, new: str, empty: tuple[str, ...] = ("", "null")) -> DataFrame:
    """column takes the update's value where it is NULL or one of `empty`."""
    j = df.join(updates.select(key, F.col(new).alias("_new")), key, "left")
    return j.withColumn(column, F.coalesce(F.when(F.col(column).isin(*empty), None).otherwise(F.col(column)), F.col("_new"))).drop("_new")


def enrich(cache: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Full outer merge: rows that the cache lacks come in; columns that are NULL in the cache are filled."""
    rest = [c for c in cache.columns if c != key]
    a = cache.select(key, *[F.col(c).alias(f"_a_{c}") for c in rest])
    b = rows.select(key, *[F.col(c).alias(f"_b_{c}") for c in rest])
    return a.join(b, key, "full_outer").select(key, *[F.coalesce(f"_a_{c}", f"_b_{c}").alias(c) for c in rest])


def without(mapped: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Mapped entries whose partner is missing: gaps."""
    return mapped.join(other.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def match_any(targets: DataFrame, rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows that equal the target in any of the column pairs, once each: a union of equi-joins, not a join on OR."""
    found = None
    for mine, theirs in pairs:
        one = targets.join(rows, targets[mine] == rows[theirs])
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def parse_variant(name: Column) -> Column:
    """What stands in the last round brackets."""
    return F.nullif(F.regexp_extract(name, r"\(([^()]*)\)\s*$", 1), F.lit(""))


def strip_variant(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s*\([^()]*\)\s*$", ""))


def insert_before(lines: DataFrame, block: DataFrame, marker: str) -> DataFrame:
    """Lines (pos, line) with a block's lines put before the first that begins with marker, or at the end."""
    at = lines.where(F.col("line").startswith(marker)).agg(F.min("pos").alias("_at"))
    end = lines.agg(F.max("pos").alias("_end"))
    spot = at.crossJoin(end).select(F.coalesce(F.col("_at") - 1, "_end", F.lit(-1)).alias("_at"))  # one row
    placed = block.crossJoin(spot).select(F.struct(F.col("_at").cast("long").alias("a"), (F.col("pos") + 1).cast("long").alias("b")).alias("_k"), "line")
    return lines.select(F.struct(F.col("pos").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("_k"), "line").unionByName(placed).orderBy("_k").select("line")


def replace_section(lines: DataFrame, header: str, block: DataFrame) -> DataFrame:
    """Lines (pos, line) whose section (from its header line to the next header) gives way to the block's."""
    w = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # one small file
    s = lines.withColumn("_head", F.last(F.when(F.col("line").startswith("//"), F.col("line")), True).over(w))
    kept = s.where(~F.col("_head").eqNullSafe(header) | (F.col("line") == header)).select("pos", "line")
    at = kept.where(F.col("line") == header).agg(F.min("pos").alias("_at"))
    placed = block.crossJoin(at).select(F.struct(F.col("_at").cast("long").alias("a"), (F.col("pos") + 1).cast("long").alias("b")).alias("_k"), "line")
    return kept.select(F.struct(F.col("pos").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("_k"), "line").unionByName(placed).orderBy("_k").select("line")


def mark(df: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    return df.join(ids.select(key).distinct().withColumn("_m", F.lit(True)), key, "left").withColumn(flag, F.coalesce("_m", F.lit(False))).drop("_m")


def cut_by_limit(items: DataFrame, variants: str, name: str, limit_col: str, most: float) -> DataFrame:
    """Variants called `name` of items whose limit does not pass `most`."""
    return items.where(F.col(limit_col) <= most).withColumn("v", F.explode(variants)).where(F.col("v") == name).drop(variants)


def catalog_report(items: DataFrame, by: list[str], variant: str, present: str) -> DataFrame:
    """A line of text for each group: its name, how many variants, how many are there, which."""
    g = items.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(present).cast("int")).alias("there"), F.array_join(F.array_sort(F.collect_set(variant)), ", ").alias("names"))
    return g.select(*by, F.format_string("- %s: %d of %d (%s)", F.concat_ws(" / ", *by), "there", "n", "names").alias("line"))

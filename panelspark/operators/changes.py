"""Change sets: what a plan would do to a table, as rows to look at, and the table it leads to.

A plan is a table of wanted rows. Against the current one each of its values is an insert (the key is new), a fill (nothing was there), a replace (another value was, and the
column may change), a conflict (another value was, and it stays), or nothing. Both the report and the new table come from one full join by key, so what
is printed in a dry run is what is applied; applied to its own result a plan changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.sources.versions import Version, VersionedTable

INSERT, FILL, REPLACE, CONFLICT, SKIP = "insert", "fill", "replace", "conflict", "skip"


class ChangeSet:
    """plan against current, by `key`.

    replace: columns whose values the plan may change; all others are only filled. unique: further columns whose value names a row: a new key whose value is there already under
    another key is skipped. guard: rows that are there are filled only while this column is empty (together, as what a first visit fills in). empty: texts that count as nothing.
    Of plan rows of one key, or of one unique value, the least (by unique value, then all columns) counts. A plan row without a key is passed over. Columns that
    only the plan has are passed over; ones that it lacks stay as they are (NULL in inserts).
    """

    def __init__(self, current: DataFrame, plan: DataFrame, key: str, replace: tuple[str, ...] = (), unique: tuple[str, ...] = (), guard: str | None = None, empty: tuple[str, ...] = ("",)) -> None:
        self.current, self.key, self.replace, self.guard, self.empty = current, key, replace, guard, empty
        self.columns = [c for c in current.columns if c != key and c in plan.columns]
        wanted = plan.where(F.col(key).isNotNull()).select(key, *self.columns)
        wanted = _first(wanted, [key], [*unique, *self.columns])
        known = current.select(key).distinct().withColumn("_there", F.lit(True))
        wanted = wanted.join(known, key, "left").withColumn("_skip", F.lit(None).cast("string"))
        for u in unique:
            held = current.where(F.col(u).isNotNull()).groupBy(F.col(u).alias("_u")).agg(F.lit(True).alias("_held"))
            new = F.col("_there").isNull() & F.col("_skip").isNull() & F.col(u).isNotNull()
            own = Window.partitionBy(new, u).orderBy(key)  # a value is a row or two
            wanted = wanted.join(held, F.col(u) == F.col("_u"), "left").withColumn("_r", F.when(new, F.row_number().over(own)))
            wanted = wanted.withColumn("_skip", F.when(new & (F.col("_held").isNotNull() | (F.col("_r") > 1)), F.lit(u)).otherwise(F.col("_skip"))).drop("_u", "_held", "_r")
        wanted = wanted.select(F.col(key), F.struct("_skip", *self.columns).alias("_new"))
        self.both = current.select(F.col(key), F.struct(*current.columns).alias("_old")).join(wanted, key, "full_outer")

    def _gone(self, c: Column) -> Column:
        return c.isNull() | c.cast("string").isin(*self.empty) if self.empty else c.isNull()

    def _what(self, column: str) -> Column:
        """The change of one column; NULL for none."""
        old, new = F.col(f"_old.{column}"), F.col(f"_new.{column}")
        fillable = F.lit(True) if self.guard is None else self._gone(F.col(f"_old.{self.guard}"))
        other = F.lit(REPLACE) if column in self.replace else F.lit(CONFLICT)
        there = F.when(self._gone(new) | old.eqNullSafe(new), None).when(self._gone(old) & fillable, F.lit(FILL)).when(self._gone(old), None).otherwise(other)
        inserted = F.when(F.col("_new._skip").isNotNull(), F.when(F.col("_new._skip") == column, F.lit(SKIP))).when(new.isNotNull(), F.lit(INSERT))
        return F.when(F.col("_new").isNull(), None).when(F.col("_old").isNull(), inserted).otherwise(there)

    def changes(self) -> DataFrame:
        """(key, column, change, before, after), values as texts."""
        each = [F.struct(F.lit(c).alias("column"), self._what(c).alias("change"), F.col(f"_old.{c}").cast("string").alias("before"), F.col(f"_new.{c}").cast("string").alias("after")) for c in self.columns]
        return self.both.select(F.col(self.key), F.explode(F.array(*each)).alias("_c")).select(self.key, "_c.*").where("change IS NOT NULL")

    def counts(self) -> DataFrame:
        """(column, change, n)."""
        return self.changes().groupBy("column", "change").agg(F.count("*").alias("n"))

    def applied(self) -> DataFrame:
        kept = self.both.where(F.col("_old").isNotNull() | F.col("_new._skip").isNull())

        def value(column: str) -> Column:
            if column == self.key:
                return F.col(self.key)
            if column not in self.columns:
                return F.col(f"_old.{column}")
            return F.when(self._what(column).isin(INSERT, FILL, REPLACE), F.col(f"_new.{column}")).otherwise(F.col(f"_old.{column}"))

        return kept.select(*[value(c).alias(c) for c in self.current.columns])


def _first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the least by these columns."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min(F.struct(*dict.fromkeys(order), *[c for c in rest if c not in order])).alias("_b"))
    return best.select(*key, *[F.col(f"_b.{c}") for c in rest])


def replaced_section(current: DataFrame, plan: DataFrame, key: str, section: Column) -> tuple[DataFrame, DataFrame]:
    """(changes, new table) where rows of a section give way to the plan's as a whole: of equal keys the plan's count, those it lacks go (change "delete")."""
    inside, outside = current.where(F.coalesce(section, F.lit(False))), current.where(~F.coalesce(section, F.lit(False)))
    inner = ChangeSet(inside, plan, key, replace=tuple(inside.columns))
    keys = plan.where(F.col(key).isNotNull()).select(key).distinct()
    names = [c for c in current.columns if c != key]
    gone = inside.join(keys, key, "left_anti")
    gone = gone.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit("delete").alias("change"), F.col(c).cast("string").alias("before"), F.lit(None).cast("string").alias("after")) for c in names])).alias("_c")).select(key, "_c.*").where("before IS NOT NULL")
    return inner.changes().unionByName(gone), outside.join(keys, key, "left_anti").unionByName(inner.applied().join(keys, key, "left_semi"))


def incremental(plan: DataFrame, names: DataFrame, market: DataFrame, cache: DataFrame) -> dict[str, ChangeSet]:
    """New entities into three tables: names (local_id, name), market (local_id, market_name), cache (market_name, ...).

    plan: (local_id, market_name, name, and columns of cache). Ids that are there, and names of the market that are there under another id, are skipped in all three.
    """
    taken = market.select("local_id").unionByName(names.select("local_id")).distinct()
    fresh = plan.join(taken, "local_id", "left_anti")
    fresh = fresh.join(cache.select("market_name").where("market_name IS NOT NULL").distinct(), "market_name", "left_anti")
    fresh = _first(fresh.where("market_name IS NOT NULL"), ["market_name"], ["local_id"])
    return {
        "names": ChangeSet(names, fresh, "local_id"),
        "market": ChangeSet(market, fresh, "local_id", unique=("market_name",)),
        "cache": ChangeSet(cache, fresh.drop("name"), "market_name"),
    }


def agents(plan: DataFrame, market: DataFrame, cache: DataFrame, guard: str = "name_zh") -> dict[str, ChangeSet]:
    """A section's entities: missing ids into market, missing entries into cache, and known entries filled while they lack their translated name."""
    return {"market": ChangeSet(market, plan, "local_id"), "cache": ChangeSet(cache, plan, "market_name", guard=guard)}


def renamed(names: DataFrame, translated: DataFrame, first: int) -> ChangeSet:
    """names (local_id, name) of ids from `first` on, as wear, weapon and pattern of `translated` (local_id, wear, weapon, pattern); those without a pattern stay."""
    new = translated.where((F.col("local_id") >= first) & (F.coalesce("pattern", F.lit("")) != ""))
    new = new.join(names.select("local_id"), "local_id", "left_semi")
    return ChangeSet(names, new.select("local_id", F.concat(F.coalesce("wear", F.lit("")), F.coalesce("weapon", F.lit("")), F.col("pattern")).alias("name")), "local_id", replace=("name",))


def commit(sets: dict[str, ChangeSet], tables: dict[str, VersionedTable], dry_run: bool = False, show: Callable[[str, DataFrame], None] | None = None) -> dict[str, Version]:
    """Shows each set's counts and, unless in a dry run, writes each table as its next version. Sets that change nothing write nothing."""
    out: dict[str, Version] = {}
    for name, changes in sets.items():
        counts = changes.counts()
        if show is not None:
            show(name, counts)
        if not dry_run and not counts.where(F.col("change").isin(INSERT, FILL, REPLACE)).isEmpty():
            before = tables[name].latest()
            out[name] = tables[name].replace(changes.applied(), after=before.number if before else 0, note="change set")
    return out

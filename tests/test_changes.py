"""Change sets: reported, applied, and applied twice."""

import pytest
from pyspark.sql import functions as F

from panelspark.operators import changes
from panelspark.operators.changes import ChangeSet
from panelspark.sources.versions import Conflict, VersionedTable


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_kinds_of_change(spark):
    current = spark.createDataFrame([(1, "one", "", 5), (2, "two", "x", None), (3, None, "y", 7), (4, "four", None, None)], "id long, name string, tag string, n int")
    plan = spark.createDataFrame([(1, "ONE", "a", 5), (2, "two", "b", 6), (9, "nine", None, 1), (9, "nine", "z", 1), (10, "two", "q", 2), (11, "new", "q", 3), (12, "new", "q", 4), (None, "none", "q", 3)], "id long, name string, tag string, n int")
    own = ChangeSet(current, plan.withColumn("other", F.lit(1)), "id", replace=("tag",), unique=("name",))
    assert rows(own.changes()) == sorted([
        (1, "name", "conflict", "one", "ONE"), (1, "tag", "fill", "", "a"), (2, "tag", "replace", "x", "b"), (2, "n", "fill", None, "6"),
        (9, "name", "insert", None, "nine"), (9, "n", "insert", None, "1"), (10, "name", "skip", None, "two"), (11, "name", "insert", None, "new"), (11, "tag", "insert", None, "q"), (11, "n", "insert", None, "3"), (12, "name", "skip", None, "new"),
    ], key=repr)
    got = own.applied()
    assert rows(got) == sorted([(1, "one", "a", 5), (2, "two", "b", 6), (3, None, "y", 7), (4, "four", None, None), (9, "nine", None, 1), (11, "new", "q", 3)], key=repr)
    again = ChangeSet(got, plan, "id", replace=("tag",), unique=("name",))
    assert {r.change for r in again.changes().collect()} == {"conflict", "skip"} and rows(again.applied()) == rows(got)
    assert ChangeSet(current, plan.limit(0), "id").changes().count() == 0 and rows(ChangeSet(current.limit(0), plan.limit(0), "id").applied()) == []
    guarded = ChangeSet(current, plan, "id", guard="tag")
    assert {(r.id, r.column) for r in guarded.changes().where("change = 'fill'").collect()} == {(1, "tag")}  # row 2 has a tag


@pytest.fixture()
def three(spark):
    names = spark.createDataFrame([(21918, "ak red"), (11431, "ava")], "local_id long, name string")
    market = spark.createDataFrame([(21918, "AK | Red (New)"), (11431, "Ava")], "local_id long, market_name string")
    cache = spark.createDataFrame([("AK | Red (New)", "rare", None), ("Ava", None, "")], "market_name string, rarity string, name_zh string")
    return {"names": names, "market": market, "cache": cache}


def test_incremental_chain_with_dry_run(spark, three, tmp_path):
    plan = spark.createDataFrame(
        [(30000, "P9 | Sky (New)", "p9 sky", "mil", "zh1"), (30001, "P9 | Sky (Worn)", "p9 sky worn", "mil", None), (21918, "Other", "taken id", "x", None), (30002, "Ava", "known name", "x", None), (30003, "P9 | Sky (New)", "twice", "x", None)],
        "local_id long, market_name string, name string, rarity string, name_zh string",
    )
    tables = {k: VersionedTable(spark, f"file://{tmp_path}/{k}") for k in three}
    for k, t in tables.items():
        t.replace(three[k])
    seen = {}

    def run(dry_run):
        own = changes.incremental(plan, *(tables[k].read() for k in ("names", "market", "cache")))
        return changes.commit(own, tables, dry_run, lambda name, counts: seen.__setitem__(name, {(r.column, r.change): r.n for r in counts.collect()}))

    assert run(True) == {} and all(t.latest().number == 1 for t in tables.values())
    assert seen == {"names": {("name", "insert"): 2}, "market": {("market_name", "insert"): 2}, "cache": {("rarity", "insert"): 2, ("name_zh", "insert"): 1}}
    assert {k: v.number for k, v in run(False).items()} == {"names": 2, "market": 2, "cache": 2}
    assert rows(tables["names"].read()) == [(11431, "ava"), (21918, "ak red"), (30000, "p9 sky"), (30001, "p9 sky worn")]
    assert rows(tables["market"].read().where("local_id >= 30000")) == [(30000, "P9 | Sky (New)"), (30001, "P9 | Sky (Worn)")]
    assert run(False) == {} and seen["names"] == {}  # applied twice is applied once

    stale = changes.renamed(tables["names"].read(), spark.createDataFrame([(21918, "new ", "ak ", "red print")], "local_id long, wear string, weapon string, pattern string"), 21918)
    tables["names"].latest = lambda: None  # a writer that has seen nothing yet
    with pytest.raises(Conflict):
        VersionedTable(spark, tables["names"].path).replace(stale.applied(), after=1)


def test_section_and_agents(spark, three):
    plan = spark.createDataFrame([(11431, "Ava", "Ava zh", "elite"), (11500, "Bo", "Bo zh", "elite")], "local_id long, market_name string, name_zh string, rarity string")
    own = changes.agents(plan, three["market"], three["cache"])
    assert rows(own["market"].applied()) == [(11431, "Ava"), (11500, "Bo"), (21918, "AK | Red (New)")]
    assert rows(own["cache"].applied()) == [("AK | Red (New)", "rare", None), ("Ava", "elite", "Ava zh"), ("Bo", "elite", "Bo zh")]
    names = three["names"].unionByName(spark.createDataFrame([(11432, "old")], "local_id long, name string"))
    done, after = changes.replaced_section(names, plan.select("local_id", F.col("name_zh").alias("name")), "local_id", F.col("local_id") < 20000)
    assert rows(after) == [(11431, "Ava zh"), (11500, "Bo zh"), (21918, "ak red")]
    assert rows(done) == sorted([(11431, "name", "replace", "ava", "Ava zh"), (11432, "name", "delete", "old", None), (11500, "name", "insert", None, "Bo zh")], key=repr)
    more, same = changes.replaced_section(after, plan.select("local_id", F.col("name_zh").alias("name")), "local_id", F.col("local_id") < 20000)
    assert more.count() == 0 and rows(same) == rows(after)


def test_renames_only_what_is_translated(spark, three):
    zh = spark.createDataFrame([(21918, "崭新", "ak", "红线"), (11431, "a", "b", "c"), (40000, "a", "b", "c"), (21919, "a", "b", "")], "local_id long, wear string, weapon string, pattern string")
    own = changes.renamed(three["names"], zh, 21918)
    assert rows(own.changes()) == [(21918, "name", "replace", "ak red", "崭新ak红线")]
    assert rows(own.applied()) == [(11431, "ava"), (21918, "崭新ak红线")] and changes.renamed(own.applied(), zh, 21918).changes().count() == 0

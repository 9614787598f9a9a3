"""Queries for merges, mapping, data quality and text sources, on the driver's dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import mapping, merge, quality
from panelspark.operators.changes import ChangeSet
from panelspark.sources import files, tables
from panelspark.sources.tables import HOUR_SQL, load

# Merges: two overlapping slices of hourly bars as what is stored and what is new.
_NOW = 1706054400000 + 37 * 60_000  # 2024-01-24 00:37 UTC
_OPEN = merge.open_from(_NOW, "1H")


def _slices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bars = tables.hour_panel(spark, sf_dir).select("item_id", F.unix_millis("hour").alias("t"), "close", "volume")
    old = bars.where("hour(timestamp_millis(t)) % 2 = 0 OR t < 1705363200000")
    new = bars.where("t >= 1705622400000").withColumn("close", F.col("close") + 1).withColumn("volume", F.col("volume") + F.pmod(F.col("t") / 3_600_000, F.lit(3)) - 1)
    return old, new


_SLICES_SQL = f"""
b AS (SELECT item_id, epoch_ms(hour) AS t, close, volume FROM {HOUR_SQL}),
o AS (SELECT * FROM b WHERE (t // 3600000) % 24 % 2 = 0 OR t < 1705363200000),
n AS (SELECT item_id, t, close + 1 AS close, volume + (t // 3600000) % 3 - 1 AS volume FROM b WHERE t >= 1705622400000)"""


def upsert_skip_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _slices(spark, sf_dir)
    return merge.upsert_closed(old, new, ["item_id", "t"], "t", _OPEN).withColumns({c: F.round(c, 9) for c in ("close", "volume")})


UPSERT_SQL = f"WITH {_SLICES_SQL}, c AS (SELECT * FROM n WHERE t < {_OPEN}) SELECT item_id, t, round(close, 9) AS close, round(volume, 9) AS volume FROM (SELECT * FROM c UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.item_id = o.item_id AND c.t = o.t))"


def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.upsert_stats(*_slices(spark, sf_dir), ["item_id", "t"], "t", _OPEN)


COUNTS_SQL = f"WITH {_SLICES_SQL} SELECT (SELECT count(*) FROM n WHERE t >= {_OPEN}) AS skipped, (SELECT count(*) FROM n WHERE t < {_OPEN} AND NOT EXISTS (SELECT 1 FROM o WHERE o.item_id = n.item_id AND o.t = n.t)) AS added, (SELECT count(*) FROM n WHERE t < {_OPEN} AND EXISTS (SELECT 1 FROM o WHERE o.item_id = n.item_id AND o.t = n.t)) AS updated, (SELECT count(*) FROM o) AS preserved"


def upsert_max_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _slices(spark, sf_dir)
    return merge.upsert_larger(old, new, ["item_id", "t"], "volume").withColumns({c: F.round(c, 9) for c in ("close", "volume")})


MAX_VOLUME_SQL = f"WITH {_SLICES_SQL} SELECT coalesce(o.item_id, n.item_id) AS item_id, coalesce(o.t, n.t) AS t, round(CASE WHEN o.t IS NULL OR n.volume > o.volume THEN n.close ELSE o.close END, 9) AS close, round(CASE WHEN o.t IS NULL OR n.volume > o.volume THEN n.volume ELSE o.volume END, 9) AS volume FROM o FULL JOIN n ON o.item_id = n.item_id AND o.t = n.t"


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return merge.coverage(planned, load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), "k").withColumn("coverage", F.round("coverage", 9))


COVERAGE_SQL = "SELECT count(*) AS planned, count(o) AS crawled, round(count(o) / count(*), 9) AS coverage FROM (SELECT DISTINCT c_custkey AS k FROM customer) LEFT JOIN (SELECT DISTINCT o_custkey AS k, 1 AS o FROM orders WHERE o_orderstatus = 'F') USING (k)"


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = load(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("user_id").cast("string").alias("local_id"), F.col("event_type").alias("status"), F.struct("ts", "event_id").alias("at"))
    return merge.progress_view(j).select("day", "local_id", "status")


PROGRESS_SQL = "SELECT CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS local_id, arg_max(event_type, row(ts, event_id)) AS status FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) GROUP BY 1, 2"

# Mapping: parts as items, their type as tier, brands as weapons.
TIERS = {"PROMO": 3, "STANDARD": 2, "ECONOMY": 1}
VARIANTS = ["Factory New", "Minimal Wear", "Field-Tested"]


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", F.split("p_type", " ")[0].alias("tier"))


_ITEMS = "(SELECT p_partkey, p_name, p_brand, p_size, string_split(p_type, ' ')[1] AS tier FROM part)"
_EXPANDED = f"(SELECT *, unnest(['Factory New', 'Minimal Wear', 'Field-Tested'][1:CASE tier WHEN 'PROMO' THEN 3 WHEN 'STANDARD' THEN 2 WHEN 'ECONOMY' THEN 1 ELSE 2 END]) AS variant FROM {_ITEMS})"


def _expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.expand_tiers(_items(spark, sf_dir), "tier", TIERS, VARIANTS)


def tier_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir).select("p_partkey", "tier", "variant", F.concat("p_name", F.lit(" ("), "variant", F.lit(")")).alias("market_name"))


TIER_SQL = f"SELECT p_partkey, tier, variant, p_name || ' (' || variant || ')' AS market_name FROM {_EXPANDED}"


def id_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _expanded(spark, sf_dir)
    starts = items.select("tier").distinct().select("tier", (F.length("tier") * 100_000).cast("long").alias("start"))
    known = starts.where("tier = 'PROMO'").select("tier", (F.col("start") + 41).alias("id"))
    return mapping.assign_ids(items, ["tier"], ["p_brand", "p_partkey", "variant"], starts, known).select("p_partkey", "variant", "tier", "id")


ID_SQL = f"SELECT p_partkey, variant, tier, CAST(length(tier) * 100000 + CASE WHEN tier = 'PROMO' THEN 42 ELSE 0 END + row_number() OVER (PARTITION BY tier ORDER BY p_brand, p_partkey, variant) - 1 AS BIGINT) AS id FROM {_EXPANDED}"


def anti_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = _items(spark, sf_dir).where("p_partkey < 12").select("p_brand")
    return mapping.new_groups(_expanded(spark, sf_dir), "p_brand", "variant", local).select("p_brand", F.array_join("variants", ",").alias("variants"))


NEW_SQL = f"SELECT p_brand, string_agg(DISTINCT variant, ',' ORDER BY variant) AS variants FROM {_EXPANDED} WHERE p_brand NOT IN (SELECT p_brand FROM {_ITEMS} WHERE p_partkey < 12) GROUP BY p_brand"


def name_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with nation and region: two hops; empty or missing names give way to the key."""
    s, n, r = (load(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    s = s.select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"), F.when(F.col("s_suppkey") % 3 == 0, "null").otherwise(F.col("s_name")).alias("s_name"))
    s = mapping.fill_when_empty(s, load(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("id-"), "s_suppkey").alias("alt")), "s_suppkey", "s_name", "alt")
    return mapping.two_hop(mapping.two_hop(s, n, "n_nationkey"), r.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select("s_suppkey", "s_name", "n_name", "r_name")


NAME_SQL = "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'id-' || s_suppkey ELSE s_name END AS s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def nest_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mapping.nest(_expanded(spark, sf_dir), ["p_partkey"], ["variant", "tier"])
    return out.select("p_partkey", F.size("variants").cast("long").alias("n"), F.array_join(F.transform("variants", lambda v: v["variant"]), "|").alias("names"))


NEST_SQL = f"SELECT p_partkey, count(*) AS n, string_agg(variant, '|' ORDER BY variant) AS names FROM {_EXPANDED} GROUP BY p_partkey"


def parse_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tier_expand(spark, sf_dir)
    return t.select("p_partkey", mapping.parse_variant(F.col("market_name")).alias("variant"), mapping.strip_variant(F.col("market_name")).alias("base"))


PARSE_SQL = f"SELECT p_partkey, variant, p_name AS base FROM {_EXPANDED}"


def match_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("a"), F.col("n_name").alias("b"))
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("x"), F.substring("c_name", -1, 1).alias("y"))
    return mapping.match_any(t, rows, [("a", "x"), ("a", "y")]).select("c_custkey", "a")


MATCH_SQL = "SELECT DISTINCT c_custkey, CAST(n_nationkey AS VARCHAR) AS a FROM nation, customer WHERE CAST(n_nationkey AS VARCHAR) = CAST(c_nationkey AS VARCHAR) OR CAST(n_nationkey AS VARCHAR) = right(c_name, 1)"


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    o = load(spark, sf_dir, "orders").select(F.when(F.col("o_totalprice") > 100_000, F.col("o_custkey")).alias("c_custkey"))
    return mapping.mark(c, mapping.without(c, o, "c_custkey"), "c_custkey", "no_orders").groupBy("c_mktsegment", "no_orders").agg(F.count("*").alias("n"))


GAPS_SQL = "SELECT c_mktsegment, c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) AS no_orders, count(*) AS n FROM customer GROUP BY 1, 2"


def enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"), F.col("s_acctbal").alias("bal"))
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    return mapping.enrich(s, c, "k")


ENRICH_SQL = "SELECT coalesce(s.k, c.k) AS k, coalesce(s.name, c.name) AS name, coalesce(s.bal, c.bal) AS bal FROM (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS name, s_acctbal AS bal FROM supplier) s FULL JOIN (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer) c ON s.k = c.k"


def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _expanded(spark, sf_dir).cube("tier", "variant").agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands"))
    return out


DISTRIBUTION_SQL = f"SELECT tier, variant, count(*) AS n, count(DISTINCT p_brand) AS brands FROM {_EXPANDED} GROUP BY CUBE (tier, variant)"


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _expanded(spark, sf_dir).withColumn("there", F.col("p_size") > 10)
    return mapping.catalog_report(e, ["tier"], "variant", "there")


REPORT_SQL = f"SELECT tier, '- ' || tier || ': ' || count(*) FILTER (p_size > 10) || ' of ' || count(*) || ' (' || string_agg(DISTINCT variant, ', ' ORDER BY variant) || ')' AS line FROM {_EXPANDED} GROUP BY tier"


def limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = _expanded(spark, sf_dir).groupBy("p_partkey", "p_size").agg(F.collect_list("variant").alias("vs"))
    return mapping.cut_by_limit(nested, "vs", "Field-Tested", "p_size", 25).select("p_partkey", "p_size")


LIMITED_SQL = f"SELECT p_partkey, p_size FROM {_EXPANDED} WHERE variant = 'Field-Tested' AND p_size <= 25"

# Quality.


def dq_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li, p = (load(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "part"))
    return quality.suite([
        quality.unique(c, "customer key is unique", "c_custkey"),
        quality.unique(li, "line is unique", "l_orderkey", "l_linenumber"),
        quality.not_null(c, "customer has a name", "c_name"),
        quality.between(li, "discount within 0 and 0.1", "l_discount", 0.0, 0.1),
        quality.between(p, "size within 5 and 45", "p_size", 5, 45),
        quality.subset(o, "orders have customers", "o_custkey", c, "c_custkey"),
        quality.subset(c, "customers have orders", "c_custkey", o, "o_custkey"),
        quality.disjoint(p, "parts are not suppliers", "p_partkey", load(spark, sf_dir, "supplier"), "s_suppkey"),
        quality.count_between(c, "as many customers as planned", 100, 2000),
        quality.filled(p, "ids are used", 1, 3000, "p_partkey"),
        quality.no_match(c, "no name in brackets", "c_name", r"\("),
        quality.share_matching(c, "most names hold a digit", "c_name", r"\d", 0.9),
    ])


DQ_SQL = r"""
SELECT 'customer key is unique' AS "check", n = 0 AS passed, n AS observed FROM (SELECT count(*) AS n FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'line is unique', n = 0, n FROM (SELECT count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
UNION ALL SELECT 'customer has a name', n = 0, n FROM (SELECT count(*) FILTER (c_name IS NULL) AS n FROM customer)
UNION ALL SELECT 'discount within 0 and 0.1', n = 0, n FROM (SELECT count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.1::DOUBLE) AS n FROM lineitem)
UNION ALL SELECT 'size within 5 and 45', n = 0, n FROM (SELECT count(*) FILTER (NOT p_size BETWEEN 5 AND 45) AS n FROM part)
UNION ALL SELECT 'orders have customers', n = 0, n FROM (SELECT count(DISTINCT o_custkey) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'customers have orders', n = 0, n FROM (SELECT count(DISTINCT c_custkey) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))
UNION ALL SELECT 'parts are not suppliers', n = 0, n FROM (SELECT count(DISTINCT p_partkey) AS n FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier))
UNION ALL SELECT 'as many customers as planned', n BETWEEN 100 AND 2000, n FROM (SELECT count(*) AS n FROM customer)
UNION ALL SELECT 'ids are used', n >= 1200, n FROM (SELECT count(*) FILTER (p_partkey BETWEEN 1 AND 3000) AS n FROM part)
UNION ALL SELECT 'no name in brackets', n = 0, n FROM (SELECT count(*) FILTER (regexp_matches(c_name, '\(')) AS n FROM customer)
UNION ALL SELECT 'most names hold a digit', n >= 0.9 * m, n FROM (SELECT count(*) FILTER (regexp_matches(c_name, '\d')) AS n, count(*) AS m FROM customer)"""


def dup_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber").groupBy("n").agg(F.count("*").alias("keys"))


DUP_SQL = "SELECT n, count(*) AS keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) GROUP BY n"

# Change sets: customers as a plan for the table of suppliers. Nations may change, balances are filled where they are missing, names stay.


def _change_set(spark: SparkSession, sf_dir: str) -> ChangeSet:
    def shaped(name: str, p: str, key: str) -> DataFrame:
        t = load(spark, sf_dir, name)
        return t.select(F.col(key).alias("id"), F.col(f"{p}_name").alias("name"), F.col(f"{p}_nationkey").alias("nation"), F.when(F.col(f"{p}_acctbal") >= 0, F.col(f"{p}_acctbal")).alias("balance"))

    return ChangeSet(shaped("supplier", "s", "s_suppkey"), shaped("customer", "c", "c_custkey"), "id", replace=("nation",))


_CHANGE_TABLES = "a AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS balance FROM supplier), b AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer)"


def change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _change_set(spark, sf_dir).changes().withColumnRenamed("column", "field")


CHANGES_SQL = f"WITH {_CHANGE_TABLES} " + " UNION ALL ".join(
    f"SELECT b.id, '{c}' AS field, CASE WHEN a.id IS NULL THEN 'insert' WHEN a.{c} IS NULL THEN 'fill' ELSE '{'replace' if c == 'nation' else 'conflict'}' END AS change, CAST(a.{c} AS VARCHAR) AS before, CAST(b.{c} AS VARCHAR) AS after FROM b LEFT JOIN a ON a.id = b.id WHERE b.{c} IS NOT NULL AND a.{c} IS DISTINCT FROM b.{c}"
    for c in ("name", "nation", "balance")
)


def change_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _change_set(spark, sf_dir).applied()


APPLIED_SQL = f"WITH {_CHANGE_TABLES} SELECT coalesce(a.id, b.id) AS id, coalesce(a.name, b.name) AS name, coalesce(b.nation, a.nation) AS nation, coalesce(a.balance, b.balance) AS balance FROM a FULL JOIN b ON a.id = b.id"


# Sets and ordering.


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    b = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"union": a.unionByName(b), "except": a.subtract(b), "intersect": a.intersect(b), "except_all": a.exceptAll(b)}
    return quality.suite([d.groupBy("k").agg(F.count("*").alias("n")).withColumn("op", F.lit(o)) for o, d in parts.items()])


SETS_SQL = """
WITH a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT s_nationkey AS k FROM supplier)
SELECT 'union' AS op, k, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY k
UNION ALL SELECT 'except', k, count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY k
UNION ALL SELECT 'intersect', k, count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY k
UNION ALL SELECT 'except_all', k, count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY k"""


def top_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mapping.priority_sort(_items(spark, sf_dir), "tier", ["PROMO", "STANDARD", "ECONOMY"], "p_size", "p_partkey")
    return p.limit(25).select("p_partkey", "tier", "p_size")


TOP_SQL = f"SELECT p_partkey, tier, p_size FROM {_ITEMS} ORDER BY CASE tier WHEN 'PROMO' THEN 1 WHEN 'STANDARD' THEN 2 WHEN 'ECONOMY' THEN 3 ELSE 4 END, p_size, p_partkey LIMIT 25"

# Text sources: a sectioned text is built from the dimensions and read by the parser.


def section_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    heads = r.select((F.col("r_regionkey") * 1000).alias("pos"), F.concat(F.lit("//"), "r_name").alias("line"))
    notes = r.select((F.col("r_regionkey") * 1000 + 1).alias("pos"), F.lit("// total: some").alias("line"))
    rows = n.select((F.col("n_regionkey") * 1000 + 2 + F.col("n_nationkey")).alias("pos"), F.concat(F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, "：").otherwise(": "), "n_name").alias("line"))
    text = heads.unionByName(notes).unionByName(rows)
    return files.sections(text).join(files.id_names(text), "item_id")


SECTION_SQL = "SELECT CAST(n_nationkey AS VARCHAR) AS item_id, r_name AS section, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey"


def raw_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars packed as rows of texts, as an endpoint replies, and unpacked again; every seventh row is cut short."""
    b = tables.hour_panel(spark, sf_dir).withColumn("s", F.unix_seconds("hour"))
    row = F.array(*[F.col(c).cast("string") for c in ("s", "open", "close", "high", "low", "volume", "turnover")])
    packed = b.select("item_id", F.when(F.col("s") / 3600 % 7 == 0, F.slice(row, 1, 5)).otherwise(row).alias("r")).groupBy("item_id").agg(F.collect_list("r").alias("data"))
    out = files.normalise_arrays(packed)
    return out.select("item_id", "t", *[F.round(c, 9).alias(c) for c in ("o", "h", "l", "c", "v")])


RAW_SQL = f"SELECT item_id, epoch_ms(hour) AS t, round(open, 9) AS o, round(high, 9) AS h, round(low, 9) AS l, round(close, 9) AS c, round(volume, 9) AS v FROM {HOUR_SQL} WHERE (epoch_ms(hour) // 3600000) % 7 <> 0"


def catalog_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(
        F.col("c_name").alias("marketHashName"),
        F.array(F.struct(F.lit("A").alias("name"), F.concat(F.lit("a"), "c_custkey").alias("itemId")), F.struct(F.lit("C5").alias("name"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("c"), "c_custkey")).alias("itemId"))).alias("platformList"),
        F.when(F.col("c_custkey") % 8 == 0, "").otherwise(F.concat(F.lit("s"), "c_custkey")).alias("steamdt_typeVal"),
    )
    return files.resolve_catalog(c, "C5")


RESOLVE_SQL = "SELECT CASE WHEN c_custkey % 4 <> 0 THEN 'c' || c_custkey ELSE 's' || c_custkey END AS type_val, c_name AS market_name FROM customer WHERE c_custkey % 8 <> 0"

_ALL = {
    "upsert_skip_open": (upsert_skip_open, UPSERT_SQL), "upsert_stats": (upsert_counts, COUNTS_SQL), "upsert_max_volume": (upsert_max_volume, MAX_VOLUME_SQL), "coverage": (coverage, COVERAGE_SQL), "progress_view": (progress, PROGRESS_SQL),
    "tier_expand": (tier_expand, TIER_SQL), "id_assign": (id_assign, ID_SQL), "anti_new_items": (anti_new, NEW_SQL), "name_enrich": (name_enrich, NAME_SQL), "nest_variants": (nest_variants, NEST_SQL), "parse_names": (parse_names, PARSE_SQL),
    "match_any_key": (match_any, MATCH_SQL), "gap_marking": (gaps, GAPS_SQL), "outer_enrich": (enrich, ENRICH_SQL), "distribution_cube": (distribution, DISTRIBUTION_SQL), "catalog_report": (report, REPORT_SQL), "limited_variants": (limited, LIMITED_SQL),
    "change_report": (change_report, CHANGES_SQL), "change_applied": (change_applied, APPLIED_SQL), "dq_suite": (dq_suite, DQ_SQL), "dup_profile": (dup_profile, DUP_SQL), "set_operations": (set_operations, SETS_SQL), "top_sorted": (top_sorted, TOP_SQL), "section_parse": (section_parse, SECTION_SQL), "raw_candles": (raw_candles, RAW_SQL), "catalog_resolve": (catalog_resolve, RESOLVE_SQL),
}


def queries() -> dict:
    return {k: q for k, (q, _) in _ALL.items()}


def oracle_sql() -> dict:
    return {k: s for k, (_, s) in _ALL.items() if s}

"""File sources: candle JSON, raw candle arrays, factor specs, sectioned text, nested catalogs; and small report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.sources.versions import Version, VersionedTable

# Field names of candle files and catalogs.
CANDLE = T.StructType([T.StructField(n, T.StringType()) for n in ("t", "o", "c", "h", "l", "v", "turnover")])
CATALOG = "marketHashName string, name string, shortName string, platformList array<struct<name:string,itemId:string>>, rarity string, category string, steamdt_typeVal string"


def finite(x: Column) -> Column:
    """NaN and infinities are NULL."""
    d = x.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def candle_json(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, ts, o, h, l, c, v, turnover): one file per item, named by it, holding an array of candles.

    A time that is no number drops its row; an empty file has none. Files without the columns t, o, h, l or c altogether
    raise ValueError.
    """
    raw = spark.read.schema(CANDLE).option("multiLine", True).json(path).withColumn("item_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1))
    seen = raw.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in ("t", "o", "h", "l", "c")]).first()
    gone = [c for c in ("t", "o", "h", "l", "c") if seen.n and not seen[c]]
    if gone:
        raise ValueError(f"candles lack the columns {gone}")
    ms = F.col("t").try_cast("double").cast("long")
    return raw.where(F.col("t").try_cast("double").isNotNull()).select("item_id", F.timestamp_millis(ms).alias("ts"), *[finite(F.col(c)).alias(c) for c in ("o", "h", "l", "c", "v", "turnover")])


def normalise_arrays(raw: DataFrame, column: str = "data", keep: tuple[str, ...] = ("item_id",), in_seconds: bool = True) -> DataFrame:
    """Rows [t, o, c, h, l, v, turnover] of an array<array<string>> column as candles, t in milliseconds.

    Rows of fewer than seven fields, or with a field that is no number, are dropped; empty ones count as 0.
    """
    each = raw.select(*keep, F.explode(column).alias("r")).where(F.size("r") >= 7)
    part = [F.when(F.coalesce(F.col("r")[i], F.lit("")) == "", F.lit(0.0)).otherwise(F.col("r")[i].try_cast("double")) for i in range(7)]
    out = each.select(*keep, (part[0] * (1000 if in_seconds else 1)).cast("long").alias("t"), *[part[i].alias(n) for i, n in ((1, "o"), (3, "h"), (4, "l"), (2, "c"), (5, "v"), (6, "turnover"))])
    return out.dropna(subset=["t", "o", "h", "l", "c", "v", "turnover"])


def factor_spec(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(factor, lag) pairs, in the order of the file: CSV with these columns, or lines "number factor lag". Other lines are skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))  # one small file
    rows = [r.line.strip() for r in lines.orderBy("pos").collect()]
    rows = [r for r in rows if r and not r.startswith("#")]
    out: list[tuple[str, int]] = []
    head = rows[0].lower().split(",") if rows else []
    if "factor" in head and "lag" in head:
        cells, f, k = [r.split(",") for r in rows[1:]], head.index("factor"), head.index("lag")
    else:
        cells, f, k = [r.strip("|").replace("|", " ").split() for r in rows], 1, 2
    for c in cells:
        if len(c) > max(f, k) and c[f].strip() and c[k].strip().lstrip("-").isdigit():
            out.append((c[f].strip(), int(c[k])))
    if not out:
        raise ValueError("no factor and lag in the file")
    return out


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of one small file."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))


def _entry(line: Column) -> tuple[Column, Column]:
    """An id and its name, with a full-width or plain colon or white space between."""
    wide, plain = F.instr(line, "：") > 0, F.instr(line, ":") > 0
    cut = F.when(wide, F.split(line, "：", 2)).when(plain, F.split(line, ":", 2)).otherwise(F.split(line, r"\s+", 2))
    return F.trim(cut[0]), F.trim(F.try_element_at(cut, F.lit(2)))


def sections(lines: DataFrame, strict: bool = True) -> DataFrame:
    """(item_id, section) of sectioned text: "//name" begins a section, a blank line ends it in the loose reading only.

    strict keeps only lines that begin with a digit as entries and headers that hold no colon as sections, and carries a
    section over blank lines; loose takes every "//" line as a header. A later line of one id wins.
    """
    line = F.trim("line")
    t = lines.withColumn("line", line)
    header = F.col("line").startswith("//")
    if strict:
        header = header & ~F.col("line").rlike("[:：]")
    name = F.nullif(F.trim(F.substring("line", 3, 1_000_000)), F.lit(""))
    w = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # one small file
    event = F.when(header, F.struct(F.coalesce(name, F.lit("UNKNOWN")).alias("s")))
    if not strict:
        event = event.when(F.col("line") == "", F.struct(F.lit(None).cast("string").alias("s")))
    t = t.withColumn("section", F.last(event, True).over(w)["s"])
    entry = ~F.col("line").startswith("//") & (F.col("line") != "")
    if strict:
        entry = entry & F.col("line").rlike(r"^\d")
    item, _ = _entry(F.col("line"))
    t = t.where(entry & F.col("section").isNotNull()).select("pos", item.alias("item_id"), "section").where("item_id <> ''")
    return t.groupBy("item_id").agg(F.max_by("section", "pos").alias("section"))


def id_names(lines: DataFrame) -> DataFrame:
    """(item_id, name); comments and lines without a separator are dropped; a later line wins."""
    item, name = _entry(F.trim("line"))
    t = lines.where(~F.trim("line").startswith("//")).select("pos", item.alias("item_id"), name.alias("name")).where("item_id <> '' AND name IS NOT NULL AND name <> ''")
    return t.groupBy("item_id").agg(F.max_by("name", "pos").alias("name"))


def resolve_catalog(catalog: DataFrame, platform: str) -> DataFrame:
    """(type_val, market_name): the id on the preferred platform, else the item's own; of equal ids the last item counts."""
    preferred = F.filter("platformList", lambda p: (p["name"] == platform) & (F.coalesce(p["itemId"], F.lit("")) != ""))
    own = F.nullif(F.col("steamdt_typeVal"), F.lit(""))
    t = catalog.withColumn("_pos", F.monotonically_increasing_id()).where(F.coalesce("marketHashName", F.lit("")) != "")
    t = t.select(F.coalesce(F.try_element_at(preferred, F.lit(1))["itemId"], own).alias("type_val"), F.col("marketHashName").alias("market_name"), "_pos").where("type_val IS NOT NULL")
    return t.groupBy("type_val").agg(F.max_by("market_name", "_pos").alias("market_name"))


def csv_report(df: DataFrame, path: str) -> None:
    """A report as one CSV file with a header; for small tables. What was there goes first: see dataset_sink for whole replacement."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def json_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def json_reports(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Report files that hold a JSON object or array each, with the file's name as `report`; give the schema of known ones."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", True).json(path).withColumn("report", F.col("_metadata.file_name"))


def dataset_sink(df: DataFrame, path: str, by: list[str] | None = None) -> Version:
    """Parquet, partitioned by columns if asked, as the next version of the table at path: all of it or none (sources/versions.py reads it)."""
    return VersionedTable(df.sparkSession, path).replace(df, by)

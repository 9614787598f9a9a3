"""Mixing sources to target weights by Sainte-Lague apportionment.

Sizes are words: runs of what is not ASCII white space. Sources, by code point with null last, weigh 3, 1, 2 in turn
and share 150 % of all sizes; no target passes twice its source's size, and what is cut is shared again by weight.

Each source's documents are dealt by hash into shards of about SHARD words (more, as the root of a very large source), and each shard, in seeded order, is one
stream of words cut into blocks of BLOCK words. The quota of a source is its target in blocks. Its shards get theirs
by highest quotients (Sainte-Lague: words over 1, 3, 5, ...): the level that as many of them reach as there are seats is found by
halving, and quotients at that level are ranked, so no queue runs over all blocks. A quota of q blocks in a shard of n takes every block q div n times and the first q mod n in
seeded order once more, so a document is never taken more than twice, and reruns agree.

Null texts have size 0; sources of size 0 have target 0. Ties stand by hash, then id. Rows that repeat an id are dealt
together and count each. Nothing but aggregates of a source or a shard is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import keyed, store, unused

BLOCK, SHARD, SEED, TOTAL, CAP, HALVINGS = 64, 250_000, "mix-1", 1.5, 2, 80
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words, counted as the places where one begins."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(by_source: DataFrame) -> DataFrame:
    """source, source_size -> weight and target: the level where capped shares use up the whole."""
    ordered = Window.orderBy(F.col("source").isNull(), "source")  # Spark compares strings as UTF-8 bytes: code points
    w = by_source.withColumn("nth", F.row_number().over(ordered)).withColumn("weight", F.element_at(F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0)), ((F.col("nth") - 1) % 3 + 1).cast("int")))
    # A source is full at level CAP * size / weight. By that order: what the full ones take and the weight of the rest.
    w = w.withColumn("full_at", F.lit(float(CAP)) * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("full_at", "nth").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("full_at", "nth").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    w = w.withColumn("whole", F.lit(TOTAL) * F.sum("source_size").over(whole))
    w = w.withColumn("level", (F.col("whole") - F.coalesce(F.sum(F.lit(float(CAP)) * F.col("source_size")).over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    level = F.min_by("level", F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "nth"))).over(whole)  # the first that holds
    w = w.withColumn("the_level", level)
    target = F.when(F.col("the_level").isNull() | (F.col("full_at") <= F.col("the_level")), F.lit(float(CAP)) * F.col("source_size")).otherwise(F.col("weight") * F.col("the_level"))
    return w.select("source", "source_size", "nth", "weight", target.alias("target"))


def sainte_lague(df: DataFrame, party: list[str], votes: str, seats: str, most: str, tie: str) -> DataFrame:
    """Seats for each row: the `seats` highest of votes / 1, 3, 5, ... among the rows of one party, at most `most` each.

    A row has floor((votes / x + 1) / 2) quotients of x or more. The level where the party's rows have `seats` of them is found
    by halving; quotients above it are won, and the seats still open go to each row's next ones in order. A party's rows (shards
    of a source: as many as the root of its size) are gathered for that.
    """
    own = F.collect_list(F.struct(F.col(votes).cast("double").alias("v"), F.col(most).cast("long").alias("m")))
    by = df.groupBy(*party).agg(own.alias("_own"), F.max(votes).cast("double").alias("_top"), F.max(seats).cast("long").alias("_seats"))

    def halved(s: Column, _: Column) -> Column:
        level = F.sqrt(s["lo"] * s["hi"])
        won = F.aggregate("_own", F.lit(0).cast("long"), lambda n, x: n + F.least(x["m"], F.floor((x["v"] / level + 1) / 2)))
        return F.transform(F.array(won), lambda n: F.struct(F.when(n > F.col("_seats"), level).otherwise(s["lo"]).alias("lo"), F.when(n > F.col("_seats"), s["hi"]).otherwise(level).alias("hi")))[0]

    level = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(F.lit(1e-9).alias("lo"), (F.col("_top") + 1).alias("hi")), halved)
    by = by.select(*party, "_seats", (level["hi"] * (1 + 1e-12)).alias("_level"))
    p = Window.partitionBy(*party)
    out = df.join(by, party).withColumn("_base", F.least(F.col(most), F.floor((F.col(votes) / F.col("_level") + 1) / 2)).cast("long"))
    out = out.withColumn("_open", F.col("_seats") - F.sum("_base").over(p))
    tries = out.withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1)))).where(F.col("_base") + F.col("_k") < F.col(most))
    tries = tries.withColumn("_q", F.round(F.col(votes) / (2 * (F.col("_base") + F.col("_k")) + 1), 9))
    won = tries.withColumn("_at", F.row_number().over(p.orderBy(F.desc("_q"), tie, "_k"))).where(F.col("_at") <= F.col("_open"))
    won = won.groupBy(*party, tie).agg(F.count("*").alias("_won"))
    out = out.join(won, [*party, tie], "left").withColumn("quota", (F.col("_base") + F.coalesce("_won", F.lit(0))).cast("long"))
    return out.select(*df.columns, "quota")


def seeded(*parts: Column) -> Column:
    return F.md5(F.concat_ws("/", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))


def plan(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row for each document: its place in its shard and what its source is due, the chosen blocks of each shard)."""
    spark = df.sparkSession
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("of_text"))
    rows = store(spark, rows, "mix-sizes")
    due = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    due = due.withColumn("n_shards", F.ceil(F.try_divide(F.col("source_size"), F.greatest(F.lit(float(SHARD)), 50 * F.sqrt("source_size")))).cast("long")).withColumn("n_shards", F.greatest(F.lit(1), "n_shards"))
    due = store(spark, due, "mix-sources")
    placed = rows.join(due, rows.source.eqNullSafe(due.source), "left").drop(due.source)
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), "n_shards"))
    order = Window.partitionBy("nth", "shard").orderBy(seeded(F.col("doc_id")), "doc_id", "of_text", "size")
    placed = placed.withColumn("stop", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("stop") - F.col("size"))
    placed = placed.withColumn("row", F.row_number().over(order))
    placed = store(spark, placed, "mix-places")
    shards = placed.groupBy("nth", "shard").agg(F.sum("size").alias("words"), F.first("target").alias("target")).where("words > 0")
    shards = shards.withColumn("blocks", F.ceil(F.col("words") / BLOCK)).withColumn("most", F.col("blocks") * CAP)
    shards = shards.withColumn("seats", F.least(F.round(F.col("target") / BLOCK), F.sum("most").over(Window.partitionBy("nth"))).cast("long"))
    quotas = sainte_lague(shards, ["nth"], "words", "seats", "most", "shard")
    quotas = store(spark, quotas, "mix-quotas")
    blocks = quotas.repartition(-(-quotas.count() // 64) or 1, "nth", "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    seat = F.row_number().over(Window.partitionBy("nth", "shard").orderBy(seeded(F.col("nth"), F.col("shard"), F.col("block")), "block"))
    blocks = blocks.withColumn("times", (F.floor(F.col("quota") / F.col("blocks")) + F.when(seat <= F.col("quota") % F.col("blocks"), 1).otherwise(0)).cast("long"))
    return placed, blocks.select("nth", "shard", "block", "times")


def pieces(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each document's parts by block: first and past-the-last word within the document, and how often they are taken."""
    inside = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("stop") - 1) / BLOCK))))
    # Spark reckons blocks as small as the shards that they come from and would send all of them to all machines.
    cut = inside.join(blocks.hint("merge"), ["nth", "shard", "block"])
    return cut.select("nth", "shard", "row", (F.greatest(F.col("start"), F.col("block") * BLOCK) - F.col("start")).alias("first"), (F.least(F.col("stop"), (F.col("block") + 1) * BLOCK) - F.col("start")).alias("past"), "times")


def mix(df: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for each document."""
    placed, blocks = plan(df)
    took = pieces(placed, blocks).groupBy("nth", "shard", "row").agg(F.sum((F.col("past") - F.col("first")) * F.col("times")).alias("took"))
    out = placed.join(took, ["nth", "shard", "row"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("took", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(df: DataFrame) -> DataFrame:
    """df's rows as the mix takes them: one row per pass, whose text is the words taken in it, as they stood.

    A pass that takes every word keeps the text as it is; neighbouring blocks keep what stands between them, others are
    joined by a line break. Documents without words have nothing to take and go. Rows that repeat a doc_id and its text count once in
    the mix and are taken alike; different texts of no doc_id or of one are documents each.
    """
    key, took = unused(df, "_key"), unused(df, "_pass")
    own = keyed(df, key)
    placed, blocks = plan(own.select(F.col(key).alias("doc_id"), "source", "text").dropDuplicates(["doc_id"]))
    cut = pieces(placed, blocks).where("times > 0").join(placed.select("nth", "shard", "row", F.col("doc_id").alias("id"), "size"), ["nth", "shard", "row"])
    passes = cut.withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    spans = passes.groupBy("id", "size", "pass").agg(F.sort_array(F.collect_list(F.struct("first", "past"))).alias("spans"))
    spans = spans.withColumn("all", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x.past - x["first"]) == F.col("size")).groupBy("id").agg(F.collect_list(F.struct("pass", "all", "spans")).alias(took))
    spans = store(df.sparkSession, spans, "mix-spans").withColumnRenamed("id", key)
    out = own.join(spans, key).withColumn(took, F.explode(took))
    own_pass = F.col(took)
    whole = F.when(own_pass["all"], F.col("text"))
    # Words with what follows each, up to the next word; a span is a slice of them.
    words = F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    glued = F.aggregate(own_pass["spans"], F.array().cast("array<struct<first:bigint,past:bigint>>"), lambda got, x: F.when((F.size(got) > 0) & (F.element_at(got, -1)["past"] == x["first"]), F.concat(F.slice(got, 1, F.size(got) - 1), F.array(F.struct(F.element_at(got, -1)["first"].alias("first"), x["past"].alias("past"))))).otherwise(F.concat(got, F.array(F.struct(x["first"].alias("first"), x["past"].alias("past"))))))
    part = F.array_join(F.transform(glued, lambda x: F.array_join(F.slice(words, (x["first"] + 1).cast("int"), (x["past"] - x["first"]).cast("int")), "")), "\n")
    return out.withColumn("text", F.coalesce(whole, F.rtrim(part))).select(*[F.col(f"`{c}`") for c in df.columns])

"""From groups of candidates to connected classes, by DataFrame operations alone.

Candidates come as (grp, id): members of one group may be alike. Groups of the same members, as a family of copies makes one in most of its bands, are
one group. All pairs of a group are never written out. Each member is
first compared with one leader: of its groups' most popular members (those that meet the most others), the most popular one that
it is near. Verified pairs give components. What is still apart is taken group by group: of the members outside
their group's largest component a few are elected, the most popular of each of some hashed classes, and compared with the group's members
in other components; then components grow, groups of one component are done, and so on until no group has a member left
outside its main component (the largest after the first comparison, and what it grows to) that was not a leader. Rounds pass on the members outside alone, which get fewer. So two members of one group stay apart only if every pair between their components there was
compared: the components equal those of all candidate pairs. A round compares about ROUND leaders with each
member at most and writes the near ones alone; a member leads in one round only, and pairs that were verified are known, so each is verified once. Pairs that pass the cheap test but lie in different components must all be verified: a group whose members are nearly, but not, alike costs
as many verifications as it has such pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from panelspark.llm.common import release, store

BROADCAST_ROWS = 200_000  # rows of one or two longs: a few MB
ROUND, SALT, FEW = 1_000, 1_000, 20_000


def sized(df: DataFrame, n: int) -> DataFrame:
    """df of n rows, for joins. At most FEW rows (of numbers) are one part: what follows needs no exchange. More than BROADCAST_ROWS are
    never sent whole through the driver, however few bytes their file has: ids are packed many times denser there than in memory."""
    return df.coalesce(1) if n <= FEW else df.hint("merge") if n > BROADCAST_ROWS else df


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """df in the shared folder, sized; its number of rows, which are counted as they are written."""
    seen = Observation()
    out = store(df.sparkSession, df.observe(seen, F.count(F.lit(1)).alias("n")), tag)
    n = seen.get["n"]
    return sized(out, n), n


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of (a, b): root is the least id it is connected with. Alternating star steps.

    Every round is written to the shared folder; only two counts reach the driver.
    """
    e, n = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    seen = None
    while n:  # ends: each step moves ends to lesser ids
        # Large star: all larger neighbours of a node go to the least of its neighbours and itself.
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        up = e.join(least.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        both = up.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e, n = stored(both, "stars")
        now = (n, e.agg(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()[0])
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def fetch(pairs: DataFrame, rows: DataFrame, side: str, names: dict[str, str]) -> DataFrame:
    """pairs with columns of rows (by id) for one side.

    The ids go to the scan of rows where they are few. What a popular id is paired with is dealt over copies of its row, one for each SALT pairs.
    """
    need, n = stored(pairs.groupBy(F.col(side).alias("id")).agg(F.ceil(F.count("*") / SALT).cast("int").alias("_copies")), "wanted")
    some = rows.select("id", *names)
    if n <= BROADCAST_ROWS:
        need = F.broadcast(need)
    there = some.join(need, "id").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).select(F.col("id").alias(side), "_salt", *[F.col(k).alias(v) for k, v in names.items()])
    salted = pairs.join(need.select(F.col("id").alias(side), "_copies"), side).withColumn("_salt", F.pmod(F.xxhash64("a", "b"), F.col("_copies")).cast("int")).drop("_copies")
    return salted.join(there, [side, "_salt"]).drop("_salt")


def _elected(members: DataFrame, by: list, payload: list[str], prefix: str) -> DataFrame:
    """The most popular member of each part `by`, with its payload; ties go to the least id."""
    best = members.groupBy(*by).agg(F.max_by(F.struct("id", "pop", *payload), F.struct("pop", -F.col("id"))).alias("_best"))
    return best.select("grp", *[F.col(f"_best.{c}").alias(f"{prefix}{c}") for c in ("id", "pop", *payload)])


def _distinct(members: DataFrame) -> DataFrame:
    """(grp, n): the groups of two members or more, one of those that have the same members (told by their number and some 128 bits of hashes)."""
    own = F.xxhash64("id")
    parts = {"n": F.count("*"), "high": F.sum(F.shiftrightunsigned(own, 32)), "low": F.sum(own.bitwiseAND(F.lit(0xFFFFFFFF))), "other": F.bit_xor(F.xxhash64(F.lit(1), "id"))}
    each = members.groupBy("grp").agg(*[v.alias(k) for k, v in parts.items()]).where("n > 1")
    return each.groupBy(*parts).agg(F.min("grp").alias("grp")).select("grp", "n")


def _groups(members: DataFrame, who: str) -> DataFrame:
    """(who, groups): the groups that an id is in; as many as it has keys."""
    return members.groupBy(who).agg(F.collect_set("grp").alias(who.removesuffix("id") + "groups"))


def _rooted(rows: DataFrame, roots: DataFrame, who: str, name: str = "root") -> DataFrame:
    """rows and, as `name`, the root of `who`: itself where it is linked to nothing."""
    own = roots.select(F.col("id").alias(who), F.col("root").alias(name))
    return rows.join(own, who, "left").withColumn(name, F.coalesce(name, who))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots when further links (a, b) join components: what is done over is the components linked now."""
    ends = links
    for side in ("a", "b"):
        ends = ends.join(roots.select(F.col("id").alias(side), F.col("root").alias(f"_{side}")), side, "left").withColumn(side, F.coalesce(f"_{side}", side)).drop(f"_{side}")
    now = components(ends).select(F.col("id").alias("root"), F.col("root").alias("_root"))
    both = roots.unionByName(now.select(F.col("root").alias("id"), "root")).distinct()
    return stored(both.join(now, "root", "left").select("id", F.coalesce("_root", "root").alias("root")).distinct(), "roots")[0]


def linked(members: DataFrame, verify: Callable[[DataFrame], DataFrame], sketches: Callable[[DataFrame], DataFrame] | None = None, near: Callable[[str, str], Column] | None = None, enough: int = 20_000) -> DataFrame:
    """(id, root) of every id that is linked to another. members: (grp, id); verify: pairs (a, b) -> those alike.

    sketches and near, if given: a function from the ids that meet others at all to (id, some columns), and a condition on the
    prefixes of two members' such columns that every pair alike meets; it is part of the joins, so pairs that fail it are never
    written. A round may write `enough` rows in any case.
    """
    sizes, _ = stored(_distinct(members), "groups")
    shared, _ = stored(members.join(sizes, "grp"), "shared")
    popular, payload = shared.groupBy("id").agg(F.sum("n").alias("pop")), []
    if sketches is not None:
        popular, _ = stored(popular, "popular")
        known = sketches(popular.select("id"))
        payload = [c for c in known.columns if c != "id"]
        popular = popular.join(known, "id")
    members, n = stored(shared.select("grp", "id").join(popular, "id").select("grp", "id", "pop", *payload), "members")

    def close(a: str, b: str) -> Column:
        return near(a, b) if near else F.lit(True)

    tried: list[tuple[DataFrame, int]] = []

    def checked(pairs: DataFrame) -> tuple[DataFrame, int]:
        own = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tried:  # one join, however many rounds there were
            before = reduce(DataFrame.unionByName, [p for p, _ in tried])
            own = own.join(sized(before, sum(n for _, n in tried)), ["a", "b"], "left_anti")
        own, some = stored(own, "pairs")
        if some:
            tried.append((own, some))
        return stored(verify(own).select("a", "b").distinct(), "links") if some else (own, 0)

    heads = _elected(members, ["grp"], payload, "a_")
    met = members.join(heads, "grp").where(F.col("id") != F.col("a_id")).where(close("a_", ""))
    first = met.groupBy(F.col("id").alias("b")).agg(F.max_by("a_id", F.struct("a_pop", -F.col("a_id"))).alias("a")).select("a", "b")
    roots = components(checked(first)[0])
    release(roots.sparkSession)
    # A group's main component is the one that holds its largest after the first step: who is in it stays in it, so members outside only get fewer.
    rooted = _rooted(members, roots, "id")
    counts = rooted.groupBy("grp", "root").agg(F.count("*").alias("k")).groupBy("grp").agg(F.max_by("root", F.struct("k", -F.col("root"))).alias("main"), F.count("*").alias("m"), F.sum("k").alias("size")).where("m > 1")
    rooted = rooted.join(counts.select("grp", "main", "size"), "grp")
    rooted, rest = stored(rooted.join(_groups(rooted, "id"), "id"), "rooted")
    apart, left = stored(rooted.where("root <> main").drop("groups"), "apart")
    turn = 0
    while left:
        leaders = max(1, min(4 ** (turn + 1), max(enough, ROUND * n) // rest))
        chosen, _ = stored(_elected(apart, ["grp", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(leaders)).alias("_class")], [], "").select("id").distinct(), "chosen")
        lead = apart.join(chosen, "id", "left_semi")  # in all its groups at once
        lead = lead.select("grp", *[F.col(c).alias(f"a_{c}") for c in ("id", "root", *payload)])
        lead, _ = stored(lead.join(_groups(lead, "a_id"), "a_id"), "leaders")
        # A pair that shares several groups is met in the least of them alone.
        once = F.col("grp") == F.array_min(F.array_intersect("groups", "a_groups"))
        new = rooted.join(lead, "grp").where((F.col("root") != F.col("a_root")) & close("a_", "") & once).select(F.col("a_id").alias("a"), F.col("id").alias("b"))
        if turn:  # what rounds have linked since
            new = _rooted(_rooted(new, roots, "a", "_ra"), roots, "b", "_rb").where("_ra <> _rb")
        found, some = checked(new)
        if some:
            roots = _merged(roots, found)
        apart = apart.join(chosen, "id", "left_anti")
        if some:
            now = _rooted(_rooted(apart.drop("root"), roots, "id"), roots, "main", "_main")
            apart = now.where("root <> _main").drop("main").withColumnRenamed("_main", "main").select(*apart.columns)
        apart, left = stored(apart, "apart")
        # Groups with no such member are done; their rows go when half of all rows can, so that all rounds together write no more than twice the rows.
        open_rows = apart.select("grp", "size").distinct().agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        if left and 2 * open_rows <= rest:
            rooted, rest = stored(rooted.join(apart.select("grp").distinct(), "grp", "left_semi"), "rooted")
        release(apart.sparkSession)  # what a round shuffled and broadcast is stored by now
        turn += 1
    return roots

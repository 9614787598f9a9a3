"""Near-duplicate vectors: all pairs of cosine 0.95 or more, by tiles of int8 products with a rigorous error bound.

Equal vectors are one node with a count. Nodes are dealt into blocks of about BLOCK; each pair of blocks is one group, compared in tiles. A unit
vector u is s * q + e with q of int8: then u.v = s t q.r + e.(t r) + u.f, so a product of int8 tells the cosine to within
|e| |t r| + |f|, both of which are known for each vector. A pair below the threshold by more than that is no link, one above it by more is one,
and only what lies between is computed again in double precision. The int8 products run as single-precision matrix products,
which are exact: sums of up to 1,040 terms of 127 ** 2 stay under 2 ** 24, longer vectors are added up piece by piece.

No pair leaves its group: a group gives each node's number of links, and the edges of a spanning forest of its links (at most one a node),
from which components grow. So copies in thousands cost their products and nothing else. All blocks meet all blocks: the work is quadratic in the number of
different vectors, as the method is; on vectors without structure no exact bound on 18 degrees excludes anything in 64 dimensions.

Defined cases. Vectors that are null, zero, empty, or hold null or non-finite components link with nothing; nor do vectors of different length. Every row is a vector:
rows of equal vector (and id) are linked with each other and each counts. component_id is the least id of the component, null only where none
has an id; kept is whether that is the row's own id (two nulls agree). Other columns are not carried. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import store
from panelspark.llm.linking import components

THRESHOLD, BLOCK, TILE, EXACT_TERMS, SLACK, CHUNK = 0.95, 8_192, 1_024, 1_040, 1e-9, 65_536


class Quantised:
    """Unit vectors in double, their int8 codes (held as single precision for the product), and what bounds the error."""

    def __init__(self, vectors: np.ndarray):
        x = vectors / np.abs(vectors).max(1, keepdims=True)
        self.unit = x / np.sqrt((x * x).sum(1, keepdims=True))
        self.scale = np.abs(self.unit).max(1) / 127
        codes = np.rint(self.unit / self.scale[:, None]).astype(np.int8)
        held = codes * self.scale[:, None]
        self.codes = codes.astype(np.float32)
        self.rest = np.sqrt(((self.unit - held) ** 2).sum(1))
        self.norm = np.sqrt((held * held).sum(1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes, in double where the sums could pass 2 ** 24."""
    if a.shape[1] <= EXACT_TERMS:
        return a @ b.T
    return sum(((a[:, k : k + EXACT_TERMS] @ b[:, k : k + EXACT_TERMS].T).astype(np.float64) for k in range(0, a.shape[1], EXACT_TERMS)))


def tile_links(q: Quantised, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix: whether rows a and b (indices) have a cosine of at least threshold."""
    raw = products(q.codes[a], q.codes[b])
    # At most this much above the bound is possible in a row: one comparison finds rows with anything to look at.
    loosest = (threshold - SLACK - q.rest[a] * q.norm[b].max() - q.rest[b].max()) / (q.scale[a] * q.scale[b].max())
    links = np.zeros(raw.shape, bool)
    rows = np.flatnonzero(raw.max(1) >= np.where(loosest > 0, loosest, -np.inf))
    if not len(rows):
        return links
    some = a[rows]
    near = raw[rows] * q.scale[some][:, None] * q.scale[b][None, :]
    bound = q.rest[some][:, None] * q.norm[b][None, :] + q.rest[b][None, :] + SLACK
    sure = near - bound >= threshold
    i, j = np.nonzero((near + bound >= threshold) & ~sure)
    for k in range(0, len(i), CHUNK):
        x, y = i[k : k + CHUNK], j[k : k + CHUNK]
        sure[x, y] = np.einsum("nd,nd->n", q.unit[some[x]], q.unit[b[y]]) >= threshold
    links[rows] = sure
    return links


def _root(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return up
        parent = up


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def block_links(vectors: np.ndarray, weight: np.ndarray, side: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(weight linked, representative) of each row: pairs of a row of side 0 with one of side 1; within one side where there is no other."""
    q, n = Quantised(vectors), len(vectors)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    own = not len(right)
    found, parent = np.zeros(n, np.int64), np.arange(n)
    for x in range(0, len(left), TILE):
        a = left[x : x + TILE]
        for y in range(x if own else 0, len(left if own else right), TILE):
            b = (left if own else right)[y : y + TILE]
            links = tile_links(q, a, b, threshold)
            if own and x == y:
                np.fill_diagonal(links, False)
            if not links.any():
                continue
            found[a] += links @ weight[b]
            if not (own and x == y):
                found[b] += links.T @ weight[a]
            while True:  # each turn joins every component of the tile with another one that it is linked with
                parent = _root(parent)
                open_ = links & (parent[a][:, None] != parent[b][None, :])
                rows = np.flatnonzero(open_.any(1))
                if not len(rows):
                    break
                for i, j in zip(a[rows], b[open_[rows].argmax(1)]):
                    u, v = _find(parent, i), _find(parent, j)
                    parent[max(u, v)] = min(u, v)
    return found, _root(parent)


def _compare(threshold: float) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        node, weight, side = (group.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("node", "m", "side"))
        vectors = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(node), -1)
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        if i != j and (side.min() == 1 or side.max() == 0):  # one block of the two is empty
            links, root = np.zeros(len(node), np.int64), np.arange(len(node))
        else:
            links, root = block_links(vectors, weight, side, threshold)
        keep = np.flatnonzero(links)
        return pa.table({"node": node[keep], "links": links[keep], "root": node[root[keep]]})

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    spark = vectors.sparkSession
    x = F.col("embedding")
    finite = F.forall(x, lambda c: F.coalesce((c > float("-inf")) & (c < float("inf")), F.lit(False)))
    sound = F.coalesce(finite & F.exists(x, lambda c: c != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(sound, x).alias("v"))
    alike = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"))
    nodes = store(spark, alike.withColumn("node", F.monotonically_increasing_id()), "vectors")
    blocks = max(1, -(-nodes.count() // BLOCK))
    home = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    dealt = nodes.select("node", "m", "v", home.alias("h")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("node", "m", "v", F.size("v").alias("d"), F.least("h", "o").alias("i"), F.greatest("h", "o").alias("j"), F.when(F.col("h") > F.col("o"), 1).otherwise(0).alias("side"))
    found = dealt.groupBy("d", "i", "j").applyInArrow(_compare(threshold), "node long, links long, root long")
    found = store(spark, found, "tiles")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    member = nodes.select("node", "least", "m").join(links, "node", "left").join(roots.select(F.col("id").alias("node"), "root"), "node", "left")
    member = store(spark, member.select("node", "least", "m", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), "members")
    named = member.where("links > 0").groupBy("root").agg(F.min("least").alias("component"))
    each = nodes.select("node", "v").join(member.join(named, "root", "left"), "node")
    each = each.select("v", (F.col("links") + F.col("m") - 1).alias("links"), F.coalesce("component", "least").alias("component"))
    met, lone = rows.where("v IS NOT NULL").join(each, "v"), rows.where("v IS NULL")
    out = met.select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    out = out.unionByName(lone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def near_vectors_sql() -> str:
    """DuckDB's version for the table `embeddings`: all pairs, for small tables."""
    return """WITH RECURSIVE unit AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
        degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
        FROM embeddings LEFT JOIN least ON vec_id = least.a LEFT JOIN degree ON vec_id = degree.a"""

"""Product codes against a plain k-means in Python integers; the SQL version runs with the other oracles."""

import hashlib
import math
import random

import numpy as np
import pyarrow.parquet as pq
from llm_helpers import DATA

from panelspark.llm.codes import by_variance, compressed, nearest


def plain(rows, dims):
    """rows: (vec_id, vector, label)."""
    kept = []
    for i, v, label in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [max(-(2**24), min(2**24, math.floor(4096 * x))) for x in v]
        kept.append((i, whole + [0] * (dims - len(whole)), label))
    width = dims // 8
    first = {}
    for i, v, _ in kept:
        first[i] = min(first.get(i, v), v)
    ids = sorted(first, key=lambda i: (i is None, i or 0))[:16]
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(8)]
    books = [[cut(first[i])[p] for i in ids] for p in range(8)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), k) for k, y in enumerate(book))

    for _ in range(6):
        new = []
        for p in range(8):
            groups = {}
            for _, v, _ in kept:
                x = cut(v)[p]
                groups.setdefault(best(x, books[p])[1], []).append(x)
            new.append([[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else y for k, y in enumerate(books[p])])
        books = new
    found = [(i, [best(cut(v)[p], books[p]) for p in range(8)], label) for i, v, label in kept]
    digest = hashlib.sha256(",".join(str(x) for book in books for y in book for x in y).encode()).hexdigest()
    by_label = {}
    for _, b, label in found:
        by_label[label] = by_label.get(label, 0) + sum(d for d, _ in b)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    return sorted(((i, "".join(f"{k:02x}" for _, k in b), sum(d for d, _ in b), by_label[label], digest) for i, b, label in found), key=key)


def collected(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_whole_table(spark):
    rows = pq.read_table(f"{DATA}/sf0.001/embeddings.parquet").to_pylist()
    want = plain([(r["vec_id"], r["embedding"], r["label"]) for r in rows], 64)
    assert collected(compressed(spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet"))) == want


def test_partial_distances_and_ties():
    r = np.random.default_rng(1)
    block, book = r.integers(-3, 4, (500, 5)), r.integers(-3, 4, (16, 5))
    found, best = nearest(block, book, by_variance(book))
    full = ((block[:, None, :] - book[None]) ** 2).sum(2)
    assert (found == full.argmin(1)).all() and (best == full.min(1)).all()


def test_odd_vectors(spark):
    r = random.Random(2)
    v = lambda n: [r.uniform(-1, 1) for _ in range(n)]
    rows = [(i, v(9), i % 3) for i in range(40, 0, -1)] + [(None, v(9), None), (None, v(9), None), (3, v(9), 1), (3, v(9), 1)]
    rows += [(50, None, 1), (51, [], None), (52, [1.0, None], 1), (53, [float("nan")] * 9, 1), (54, [float("inf")] * 9, 2), (55, [0.5], 2), (56, [1e30] * 9, 2), (57, [-0.0] * 9, 0)]
    rows += [rows[0]] * 5
    schema = "vec_id long, embedding array<double>, label int, code string, error int, v string"
    df = spark.createDataFrame([(*x, "clash", 1, "clash") for x in rows], schema)
    assert collected(compressed(df)) == plain(rows, 16)
    assert compressed(df.limit(0)).count() == 0 and compressed(df.where("vec_id = 50")).count() == 0
    few = [x for x in rows if x[0] in (1, 2, 3)]
    assert collected(compressed(df.where("vec_id <= 3"))) == plain(few, 16)

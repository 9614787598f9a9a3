"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes ends a piece wherever it is one less than a multiple of the block size; each
piece gives one of 64 characters from its own hash. A fingerprint is "size:signature:signature at twice the size", the
size being the smallest (3 times a power of two) whose signature has at most 64 characters. Two fingerprints are
compared where they share a size: likeness is 1 less the insertions and deletions that turn one signature into the
other, over their joint length, and 0 unless they share four characters in a row (or all, where one is shorter).

Null is the empty text; an empty text has the fingerprint "3::", which is like another one of its kind only.
Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import documents, mix

WINDOW, LEAST, MOST, GRAM = 7, 3, 64, 4
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n at least."""
    while len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            m = len(_powers[k])
            _powers[k] = np.concatenate([_powers[k], _powers[k] * np.uint64(pow(base, m, 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


def rolling(b: np.ndarray) -> np.ndarray:
    """At each byte: the sum of the last seven, their sum by age, and a shifted xor, together in 32 bits."""
    n = len(b)
    pad = np.concatenate([np.zeros(WINDOW - 1, np.uint32), b.astype(np.uint32)])
    total, aged, shifted = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for age in range(WINDOW):
        x = pad[WINDOW - 1 - age : WINDOW - 1 - age + n]
        total += x
        aged += x * np.uint32(WINDOW - age)
        shifted ^= x << np.uint32(5 * age) if 5 * age < 32 else np.uint32(0)
    return total + aged + shifted


def fingerprint(raw: bytes) -> str:
    n = len(raw)
    if not n:
        return f"{LEAST}::"
    b = np.frombuffer(raw, np.uint8)
    r = rolling(b)
    # All sizes are LEAST * 2**k, so the ends at one size are among the ends at the size below.
    ends = np.flatnonzero(r % np.uint32(LEAST) == LEAST - 1)
    size = LEAST
    while len(ends) >= MOST:
        size *= 2
        ends = ends[r[ends] % np.uint32(size) == size - 1]
    up, down = powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n])])

    def signature(ends: np.ndarray) -> str:
        stops = ends + 1
        if not len(stops) or stops[-1] < n:
            stops = np.append(stops, n)
        starts = np.concatenate([[0], stops[:-1]])
        codes = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64)) >> np.uint64(58)
        return "".join([LETTERS[i] for i in codes.tolist()])

    double = ends[r[ends] % np.uint32(size * 2) == size * 2 - 1]
    return f"{size}:{signature(ends)}:{signature(double)}"


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def likeness(one: str, other: str) -> float:
    if one == other:
        return 1.0
    (sa, *a), (sb, *b) = one.split(":"), other.split(":")
    mine = {int(sa): a[0], 2 * int(sa): a[1]}
    theirs = {int(sb): b[0], 2 * int(sb): b[1]}
    best = 0.0
    for size in mine.keys() & theirs.keys():
        x, y = mine[size], theirs[size]
        k = min(GRAM, len(x), len(y))
        if not k:
            continue
        grams = {x[i : i + k] for i in range(len(x) - k + 1)}
        if any(y[i : i + k] in grams for i in range(len(y) - k + 1)):
            best = max(best, 2 * common_length(x, y) / (len(x) + len(y)))
    return best


def with_next(df: DataFrame, rows_each: int = 4_000) -> DataFrame:
    """Documents dealt into ranges of descending doc_id; the row that follows a range comes to its end with `extra`.

    Only ids (a bounded number of quantiles) go to the driver; texts move once. Null ids stand last; rows of one id
    stand in the order of their texts.
    """
    docs = documents(df).withColumn("rank_id", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))
    n = docs.count()
    parts = max(1, min(10_000, -(-n // rows_each)))
    cuts = sorted(set(docs.approxQuantile("rank_id", [i / parts for i in range(1, parts)], min(0.01, 0.2 / parts)))) if parts > 1 else []
    docs = docs.withColumn("part", _part(cuts))
    first = docs.groupBy("part").agg(F.max(F.struct("rank_id")).getField("rank_id").alias("rank_id"))
    heads = sorted(((r.part, r.rank_id) for r in first.collect()), reverse=True)  # one row for each part
    if not heads:
        return docs.withColumn("extra", F.lit(False))
    after = [(heads[i][0], heads[(i + 1) % len(heads)][1]) for i in range(len(heads))]
    spark = df.sparkSession
    follow = spark.createDataFrame([(int(i), int(p)) for p, i in after], "rank_id long, part int")
    head_ids = docs.join(F.broadcast(follow.withColumnRenamed("part", "to_part")), "rank_id")  # a row or two for each part
    least = head_ids.groupBy("to_part", "rank_id").agg(F.min(F.struct(F.col("text").isNotNull(), "text")).alias("t"), F.first("doc_id", ignorenulls=False).alias("doc_id"))
    extra = least.select("doc_id", F.col("t.text").alias("text"), "rank_id", F.col("to_part").alias("part"), F.lit(True).alias("extra"))
    return docs.withColumn("extra", F.lit(False)).unionByName(extra)


def _part(cuts: list[float]):
    """How many cuts are at or below rank_id, by halves."""

    def halves(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("rank_id") >= F.lit(int(cuts[mid])), halves(mid + 1, hi)).otherwise(halves(lo, mid))

    return halves(0, len(cuts))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_texts(df: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited form, and how near they and the next document's are.

    Edited: the last half of the code points (rounded down) gives way to as many from the start of the next document
    in descending doc_id, or all it has; after the last comes the first. A lone document is its own next one.
    """
    dealt = with_next(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)
            out.clear()
            return batch

        for batch in batches:
            for doc_id, text, part, extra in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3))):
                text = text or ""
                print_ = fingerprint(text.encode())
                if held and held[3] == part:
                    mine, own, own_id, _ = held
                    half = len(mine) // 2
                    raw = (mine[: len(mine) - half] + text[:half]).encode()
                    changed = fingerprint(raw)
                    out.append((own_id, len(mine), hashlib.sha256(raw).hexdigest(), own, changed, likeness(own, changed), likeness(own, print_)))
                    if len(out) >= 2000:
                        yield flush()
                held = None if extra else (text, print_, doc_id, part)
        yield flush()

    order = [F.col("part").asc(), F.col("extra").asc(), F.col("rank_id").desc(), F.col("text").asc_nulls_first()]
    placed = dealt.repartition(F.col("part")).sortWithinPartitions(*order)
    return placed.select("doc_id", "text", "part", "extra").mapInArrow(run, SCHEMA)

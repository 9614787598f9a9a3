"""Near-duplicate documents by ProbMinHash.

A document is its shingles of five words, weighted by how often they occur. Each shingle is a Poisson process whose rate is
its weight: arrivals come at sums of exponential waiting times, each at one of REGISTERS registers, which keep their
earliest arrival. A shingle stops as soon as its next arrival is later than every register's, so most need one or two.
Two documents agree in a register with the probability Jaccard similarity of their weights. ROWS registers make a band; a pair
that shares one of BANDS bands is a candidate (at 0.8, all but 1 in 10,000; at 0.82, 2 in 100,000) if a bit of each of SKETCHED further
registers, made for those that share a band with another text, agrees about as often as at 0.8 or more. Each candidate is verified by the exact similarity.

Documents of equal words are one class from the start, so copies cost nothing more; those without words (null, empty)
are such a class. Links are 0.8 or more; classes are their connected components, named by their least doc_id.
Rows that repeat a doc_id share its row's class. Texts of under five words are one shingle. A null doc_id comes back with
its class, but never names one unless all its rows are null.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import arrow_map, documents, keyed, mix, store, unused
from panelspark.llm.linking import fetch, linked
from panelspark.llm.words import counted, shingles, word_hashes

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 39, 7
REGISTERS = BANDS * ROWS
SKETCHED, FAR = 2048, 267
SKETCH = tuple(f"sketch_{i}" for i in range(SKETCHED // 64))


def signatures(hashes: np.ndarray, owner: np.ndarray, weights: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """An n x registers array of the shingle whose arrival came first in each register (0 where there is none)."""
    when = np.full((n, registers), np.inf)
    who = np.zeros((n, registers), np.uint64)
    flat, flat_who = when.reshape(-1), who.reshape(-1)
    h, o, w, t = hashes, owner, weights.astype(np.float64), np.zeros(len(hashes))
    step = 0
    while len(h):
        step += 1
        draw = mix(h + np.uint64((step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        t = t - np.log(((draw >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / w
        slot = o * registers + (mix(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(flat, slot, t)
        first = flat[slot] == t
        flat_who[slot[first]] = h[first]
        owners = np.unique(o)
        latest = np.full(n, -np.inf)
        latest[owners] = when[owners].max(axis=1)
        go = t < latest[o]
        h, o, w, t = h[go], o[go], w[go], t[go]
    return who


def banded(df: DataFrame) -> DataFrame:
    """(doc_id, whole_1, whole_2, bands); bands empty where there are no words."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, counts = word_hashes(batch.column(1).to_pylist())
            n = batch.num_rows
            h, o, w = counted(*shingles(words, counts, SHINGLE))
            who = signatures(h, o, w, n)
            keys = np.zeros((n, BANDS), np.uint64)
            for row in range(ROWS):
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + who[:, row::ROWS] + np.arange(BANDS, dtype=np.uint64))
            begin, end = np.cumsum(counts) - counts, np.cumsum(counts)
            at = np.arange(len(words), dtype=np.uint64) - np.repeat(begin, counts).astype(np.uint64)
            whole = []
            for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words ^ mix((at + np.uint64(1)) * np.uint64(salt))))])
                whole.append(pa.array((run[end] - run[begin]).view(np.int64), pa.int64()))
            some = counts > 0
            offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].reshape(-1).view(np.int64)))
            return pa.RecordBatch.from_arrays([batch.column(0), *whole, bands], names=["doc_id", "whole_1", "whole_2", "bands"])

        return each

    return arrow_map(documents(df), make, "doc_id long, whole_1 long, whole_2 long, bands array<long>")


def probability_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Sum over shared d of 1 / sum over e of max(a[e] / a[d], b[e] / b[d]); 1 for two empty sets."""
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    if wa[-1] == wb[-1] == 1 and wa.max() == wb.max() == 1:  # sets
        both = len(np.intersect1d(ha, hb, assume_unique=True))
        return both / (len(ha) + len(hb) - both)
    keys = np.union1d(ha, hb)
    a, b = np.zeros(len(keys)), np.zeros(len(keys))
    a[np.searchsorted(keys, ha)], b[np.searchsorted(keys, hb)] = wa, wb
    ratio = np.divide(a, b, out=np.full(len(keys), np.inf), where=b > 0)
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    below = np.searchsorted(ratio, ratio, side="left")  # a[e] / a[d] is the larger one where e's ratio is no less than d's
    sum_b, sum_a = np.concatenate([[0.0], np.cumsum(b)]), np.concatenate([[0.0], np.cumsum(a)])
    both = (a > 0) & (b > 0)
    return float(np.sum(1.0 / ((sum_a[-1] - sum_a[below[both]]) / a[both] + sum_b[below[both]] / b[both])))


def similar(pairs: DataFrame) -> DataFrame:
    """(a, b) of those rows of (a, b, ta, tb) whose texts are alike."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            own, at, which = np.unique(ids, return_index=True, return_inverse=True)  # a popular text is cut once
            there = [batch.column(2), batch.column(3)]
            n = batch.num_rows
            words, counts = word_hashes([there[i // n][i % n].as_py() for i in at.tolist()])
            h, o, w = counted(*shingles(words, counts, SHINGLE))
            cut = np.searchsorted(o, np.arange(len(own) + 1))
            sets = [(h[x:y], w[x:y]) for x, y in zip(cut, cut[1:])]
            kept = pa.array([probability_jaccard(*sets[x], *sets[y]) >= SIMILARITY - 1e-12 for x, y in zip(which[:n].tolist(), which[n:].tolist())], pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

        return each

    return arrow_map(pairs.select("a", "b", "ta", "tb"), make, "a long, b long", "tb", 2_000_000)


def sketched(texts: DataFrame) -> DataFrame:
    """(id, sketch columns) of (id, text): a bit of each of SKETCHED registers."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, counts = word_hashes(batch.column(1).to_pylist())
            who = signatures(*counted(*shingles(words, counts, SHINGLE)), batch.num_rows, SKETCHED)
            bits = np.packbits((mix(who) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view("<i8")
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(x), pa.int64()) for x in bits.T)], names=["id", *SKETCH])

        return each

    return arrow_map(texts.select("id", "text"), make, "id long" + "".join(f", {c} long" for c in SKETCH), most=2_000_000)


def near_duplicates(df: DataFrame) -> DataFrame:
    """doc_id, class_id, copy_of (the least doc_id of equal words) for each document."""
    spark = df.sparkSession
    docs = documents(df)
    marked = store(spark, banded(df), "signatures")
    equal = marked.groupBy("whole_1", "whole_2").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    equal = store(spark, equal, "distinct")
    members = equal.where("id IS NOT NULL").select("id", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("grp"), "id")
    whole = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")

    def verify(pairs: DataFrame) -> DataFrame:
        return similar(fetch(fetch(pairs, whole, "a", {"text": "ta"}), whole, "b", {"text": "tb"})).distinct()

    def close(a: str, b: str) -> Column:
        """A register's bits differ with 0.1 at 0.8: more than FAR of SKETCHED do five times in a million, less often than no band is shared."""
        return reduce(add, [F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in SKETCH]) <= FAR

    def sketches(ids: DataFrame) -> DataFrame:
        return sketched(whole.join(ids, "id", "left_semi").dropDuplicates(["id"]))

    roots = linked(members, verify, sketches, close)
    named = equal.select("whole_1", "whole_2", "id").join(roots, "id", "left").select("whole_1", "whole_2", F.col("id").alias("copy_of"), F.coalesce("root", "id").alias("class_id"))
    return marked.select("doc_id", "whole_1", "whole_2").join(named, ["whole_1", "whole_2"], "left").select("doc_id", "class_id", "copy_of")


def classified(df: DataFrame) -> DataFrame:
    """near_duplicates for any ids: rows of no id, and the texts of an id that has several, are documents each (common.keyed).

    A class is named by its least id; one that holds only such documents by the number that keyed gives the least of them, above all ids. So is copy_of.
    """
    key = unused(df, "_key")
    own = keyed(df.select("doc_id", "text"), key)
    named = near_duplicates(own.select(F.col(key).alias("doc_id"), "text"))
    odd = own.where(F.col("doc_id").isNull() | (F.col("doc_id") != F.col(key))).select(F.col(key).alias("_k"), F.col("doc_id").cast("long").alias("_own"), F.lit(True).alias("_odd")).distinct()
    out = named.join(odd, F.col("doc_id") == F.col("_k"), "left")
    return out.select(F.when(F.col("_odd"), F.col("_own")).otherwise(F.col("doc_id")).alias("doc_id"), "class_id", "copy_of")


def keep_first(df: DataFrame) -> DataFrame:
    """The document of each class that names it, once; columns as they were. Different texts of no id or of one id are documents each."""
    key = unused(df, "_key")
    own = keyed(df, key)
    named = near_duplicates(own.select(F.col(key).alias("doc_id"), "text")).where("doc_id = class_id").select(F.col("doc_id").alias(key)).distinct()
    return own.join(named, key, "left_semi").dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in df.columns])

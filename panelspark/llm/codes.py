"""Product codes of integer vectors: sixteen entries for each of eight parts, trained and assigned in whole numbers.

A component x becomes floor(4096 * x); so every sum, mean and distance is exact and a result does not depend on how rows are
dealt over tasks. A round is one pass: each task assigns its rows and hands on sums by (part, entry, position), which Spark adds up;
what reaches the driver is one codebook, 16 entries of a vector's length, whatever the number of rows.

The nearest entry is found by partial-distance search. Dimensions come in descending variance of the codebook; the entry that is nearest in
the first of them is measured in full and gives the distance to beat. For each other entry a mask drops rows, dimension by
dimension, once their accumulated distance strictly exceeds their best complete one, so equal distances still reach the tie-break
(the lower index).

Defined cases. Null vectors and those with null or non-finite components are left out. Integers are held within +-2 ** 24 (components beyond
+-4096), so that distances fit a long. All vectors get the length of the longest, made a multiple of eight, by zeros at
their ends (an empty vector is all zeros). The seeds are the 16 smallest distinct ids, null after all others; an id with several vectors gives its least. With
fewer ids there are fewer entries. Repeated rows and ids count as rows each. Other columns are not carried. Nothing kept: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import store

PARTS, ENTRIES, ROUNDS, SCALE, LIMIT, BATCH = 8, 16, 6, 4096, 1 << 24, 4_096


def nearest(block: np.ndarray, book: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, distance) of the nearest entry of book for each row of block, both of int64; ties go to the lower index."""
    n, lead = len(block), order[0]
    cols, entries = np.ascontiguousarray(block.T), book.T
    found = np.abs(cols[lead][:, None] - entries[lead][None, :]).argmin(1)
    best = ((block - book[found]) ** 2).sum(1)
    for k in range(len(book)):
        rows = np.flatnonzero(found != k)
        partial = np.zeros(len(rows), np.int64)
        for d in order:
            if not len(rows):
                break
            partial += (cols[d][rows] - entries[d][k]) ** 2
            alive = partial <= best[rows]
            if not alive.all():
                rows, partial = rows[alive], partial[alive]
        better = (partial < best[rows]) | (k < found[rows])
        rows, partial = rows[better], partial[better]
        found[rows], best[rows] = k, partial
    assert len(found) == n
    return found, best


def by_variance(book: np.ndarray) -> np.ndarray:
    """Dimensions of a codebook, the most varied first; ties in order."""
    return np.argsort(-book.astype(np.float64).var(0), kind="stable")


def assign(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (rows by parts) and total distance of each row. books: parts by entries by width."""
    width = books.shape[2]
    codes, error = np.empty((len(block), len(books)), np.int64), np.zeros(len(block), np.int64)
    for p, book in enumerate(books):
        codes[:, p], distance = nearest(block[:, p * width : (p + 1) * width], book, by_variance(book))
        error += distance
    return codes, error


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims)[None, :] < lengths[:, None]] = flat
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, BATCH):
            yield batch.slice(a, BATCH)


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v array<int> of the rows kept."""
    x = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & F.forall(x, lambda c: F.coalesce((c > float("-inf")) & (c < float("inf")), F.lit(False)))
    whole = F.transform(x, lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(float(-LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    return vectors.where(sound).select("vec_id", "label", whole.alias("v"))


def seeds(rows: DataFrame, dims: int) -> np.ndarray:
    """The first codebooks: parts by entries by width."""
    ids = [r.vec_id for r in rows.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(ENTRIES).collect()]
    some = F.col("vec_id").isin([i for i in ids if i is not None])
    own = rows.where(some | F.col("vec_id").isNull() if None in ids else some).groupBy("vec_id").agg(F.min("v").alias("v")).collect()
    own = {r.vec_id: r.v for r in own}
    first = np.array([list(own[i]) + [0] * (dims - len(own[i])) for i in ids], np.int64)
    return np.ascontiguousarray(first.reshape(len(ids), PARTS, dims // PARTS).transpose(1, 0, 2))


def retrained(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all rows; entries that no part chose stay as they are."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in _batches(batches):
            block = _matrix(batch.column(0), parts * width)
            codes, _ = assign(block, books)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], block[:, p * width : (p + 1) * width])
                count[p] += np.bincount(codes[:, p], minlength=entries)
        p, k = np.nonzero(count)
        flat = pa.array(total[p, k].ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(p), pa.array(k), pa.array(count[p, k]), pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * width, pa.int32()), flat)], ["part", "entry", "n", "sums"]
        )

    found = rows.select("v").mapInArrow(sums, "part long, entry long, n long, sums array<long>")
    added = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(width)])
    out = books.copy()
    for r in added.collect():  # at most 8 x 16 rows
        out[r.part, r.entry] = np.array(r[3:], np.int64) // r.n
    return out


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each vector kept."""
    rows = store(vectors.sparkSession, integers(vectors), "integers")
    longest = rows.select(F.max(F.size("v"))).first()[0]
    dims = max(PARTS, -(-(longest or 0) // PARTS) * PARTS)
    books = seeds(rows, dims) if longest is not None else np.zeros((PARTS, 0, dims // PARTS), np.int64)
    for _ in range(ROUNDS if longest is not None else 0):
        books = retrained(rows, books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{k:02x}" for k in range(ENTRIES)])
        for batch in _batches(batches):
            codes, error = assign(_matrix(batch.column(2), dims), books)
            text = digits[codes]
            joined = text[:, 0]
            for p in range(1, PARTS):
                joined = np.char.add(joined, text[:, p])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(joined.tolist(), pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    coded = rows.select("vec_id", "label", "v").mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def compressed_sql() -> str:
    """DuckDB's version for the table `embeddings` of vectors of one length (a multiple of eight), by plain search over all entries."""
    steps = [
        """kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "dims AS (SELECT max(len(v)) // 8 AS w FROM kept)",
        "cells AS (SELECT vec_id, p, w, list_slice(v, p * w + 1, (p + 1) * w) AS x FROM kept, dims, range(8) AS parts(p))",
        "first16 AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT 16)",
        "book0 AS (SELECT p, k, x AS y FROM cells JOIN first16 USING (vec_id))",
    ]
    for r in range(ROUNDS + 1):
        steps.append(
            f"""near{r} AS (SELECT vec_id, p, any_value(x) AS x, min(struct_pack(d := d, k := k)) AS best FROM (
            SELECT vec_id, c.p, c.x, b.k, CAST(list_sum(list_transform(list_zip(c.x, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM cells c JOIN book{r} b ON c.p = b.p) GROUP BY vec_id, p)"""
        )
        if r < ROUNDS:
            steps.append(
                f"""book{r + 1} AS (SELECT b.p, b.k, coalesce(m.y, b.y) AS y FROM book{r} b LEFT JOIN (
                SELECT p, k, list(CAST(floor_div AS BIGINT) ORDER BY i) AS y FROM (
                SELECT p, best.k AS k, i, CAST(CASE WHEN sum(x[i]) >= 0 THEN sum(x[i]) // count(*) ELSE -((-sum(x[i]) + count(*) - 1) // count(*)) END AS BIGINT) AS floor_div
                FROM near{r}, dims, range(1, w + 1) AS pos(i) GROUP BY p, best.k, i) GROUP BY p, k) m ON b.p = m.p AND b.k = m.k)"""
            )
    steps += [
        f"digest AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, k)) AS s FROM book{ROUNDS})",
        f"coded AS (SELECT vec_id, string_agg('0' || printf('%x', best.k), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id)",
    ]
    return "WITH " + ",\n".join(steps) + " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest"

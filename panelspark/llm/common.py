"""Shared pieces: tables, the shared folder, Arrow batches, vectorised hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir); a temporary one only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app = spark.sparkContext.applicationId
        found = _fallback.setdefault(app, "file://" + tempfile.mkdtemp(prefix="shared-"))
    return found.rstrip("/")


def local_path(spark: SparkSession, path: str) -> str | None:
    """What a machine's own file system calls a path of Spark's, with or without a scheme; None if only Spark reaches it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def store(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage of df: write it as Parquet to the shared folder and read it again."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of what is stored by now; it does so when the driver's JVM collects garbage."""
    spark.sparkContext._jvm.System.gc()


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """doc_id and text first; nothing that an extra column could clash with."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it differ from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keyed(df: DataFrame, key: str = "_key") -> DataFrame:
    """df with `key`, a long that tells its documents apart: rows of equal doc_id and text have the same, others differ.

    It is the doc_id, but for rows of no id and for the further texts of an id that has several. Those get a 64-bit hash of both,
    above all ids where ids leave room (below 2 ** 62), so that they come last.
    """
    spark = df.sparkSession
    own, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    digest = F.xxhash64(text, text.isNull())
    each = df.select(own.alias("_d"), digest.alias("_h")).where("_d IS NOT NULL").groupBy("_d").agg(F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
    several = store(spark, each.where("_lo <> _hi").select("_d", "_lo"), "several")
    n, top = several.count(), df.select(F.max(own)).first()[0]
    other = F.xxhash64(own, text, own.isNull(), text.isNull())
    if top is None or top < 1 << 62:
        other = other.bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    if not n:
        return df.withColumn(key, F.when(own.isNull(), other).otherwise(own))
    d, lo = unused(df, "_d"), unused(df, "_lo")
    several = several.select(F.col("_d").alias(d), F.col("_lo").alias(lo))
    out = df.join(F.broadcast(several) if n <= 200_000 else several.hint("merge"), own == F.col(d), "left")
    return out.withColumn(key, F.when(own.isNull() | (digest != F.col(lo)), other).otherwise(own)).drop(d, lo)


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000, rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `most` bytes of `column` and at most about `rows` rows (one at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.fromiter((len(v) if v is not None else 0 for v in batch.column(column).cast(pa.binary()).to_pylist()), np.int64, batch.num_rows)
        part = np.cumsum(sizes + 1 + most // rows) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


MIX_1, MIX_2, BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


def window_hash(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k successive symbols (len(symbols) - k + 1 of them), by doubling a polynomial."""
    cur, length = symbols.astype(np.uint64) + np.uint64(1), 1
    out, done, left = None, 0, k
    while left:
        if left & 1:
            if out is None:
                out, done = cur, length
            else:
                n = max(0, len(cur) - done)
                out = out[:n] * np.uint64(pow(BASE, length, 1 << 64)) + cur[done : done + n]
                done += length
        left >>= 1
        if left:
            n = max(0, len(cur) - length)
            cur = cur[:n] * np.uint64(pow(BASE, length, 1 << 64)) + cur[length:]
            length *= 2
    return mix(out[: max(0, len(symbols) - k + 1)])


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w successive values."""
    out, length = values, 1
    while length * 2 <= w:
        n = max(0, len(out) - length)
        out = np.minimum(out[:n], out[length : length + n])
        length *= 2
    n = max(0, len(values) - w + 1)
    return np.minimum(out[:n], out[w - length : w - length + n])


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    starts = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(starts, counts)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, column: str = "text", most: int = 4_000_000) -> DataFrame:
    """mapInArrow over slices of bounded bytes; make() runs once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for part in slices(batches, column, most):
            yield each(part)

    return df.mapInArrow(run, schema)

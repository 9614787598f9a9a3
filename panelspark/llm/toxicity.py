"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are lower-cased words and their beginnings of 4 to 8 letters, as insults are inflected; each is known by a 64-bit hash.
All terms of the labelled examples count (the examples are a hashed sample of at most about MAX_EXAMPLES, so fitting costs the
same at any size). Examples and documents are TF-IDF vectors of length 1; a term's weight grows with the surety that it
marks toxic examples (a G-test beyond SURE, odds up to LIFT times as high), and none is left out.
The examples' index has a posting list for each term, and the largest weights of frequent terms in blocks of BLOCK examples;
these bound a query's cosines, and what reaches the K-th best cosine is scored in full: exact, ties of the K-th included.
Votes weigh by the cosine's square, lean on the share of toxic examples, and are
calibrated by isotonic regression over each example's votes without itself. The neighbours are the evidence.

Null and empty texts, and texts without any known term, have the share of toxic ones among such examples as their score.
With no labelled example at all, every score is 0. Rows that repeat a doc_id are scored each.
"""

from __future__ import annotations

import math
import os
import re
import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import arrow_map, documents, local_path, shared_dir, store

MAX_EXAMPLES, K, BLOCK, LEAN = 12_000, 15, 64, 0.25
SURE, LIFT, BOOST, RARE, TOGETHER, SLACK = 16.0, 4.0, 15.0, 10, 64, 1e-5
WORD, PLAIN = regex.compile(r"[^\W\d_]+"), re.compile("[a-z]+")  # the same for lower-cased ASCII
STEMS = (4, 5, 6, 7, 8)
KEPT, PIECE = 300_000, 1 << 20


def forms(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


class Terms(dict):
    """word -> what its forms are in `known` (sorted 64-bit hashes): their places, or with none given their hashes; starts anew at a bound."""

    def __init__(self, known: np.ndarray | None = None) -> None:
        super().__init__()
        self.known = known

    def learn(self, words: list[str]) -> None:
        """Have all of these words."""
        if len(self) + len(words) > KEPT:
            self.clear()
        each = [forms(w) for w in words]
        h = np.frombuffer(b"".join([blake2b(f.encode(), digest_size=8).digest() for own in each for f in own]), "<i8")
        ends = np.cumsum([len(own) for own in each])
        if self.known is not None:
            order = np.argsort(h)  # places of nearby hashes are near
            at = np.empty(len(h), np.int64)
            at[order] = np.searchsorted(self.known, h[order])
            at[at == len(self.known)] = 0
            there = self.known[at] == h if len(self.known) else np.zeros(len(h), bool)
            h, ends = at[there], np.concatenate([[0], np.cumsum(there)])[ends]
        self.update(zip(words, np.split(h, ends[:-1])))

    def counts(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms in ascending order, how often each) of each text."""
        words = [Counter((PLAIN if (x or "").isascii() else WORD).findall((x or "").lower())) for x in texts]
        out = []
        for own in words:
            if new := [w for w in own if w not in self]:
                self.learn(new if len(self) + len(new) <= KEPT else list(own))
            found = [self[w] for w in own]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            t = np.concatenate(found) if found else np.zeros(0, np.int64)
            n = np.repeat(np.fromiter(own.values(), np.int64, len(found)), sizes)
            order = np.argsort(t)
            t, n = t[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else t
            out.append((t[first], np.add.reduceat(n, first) if len(t) else n))
        return out


def pieces(n: int, most: int = 1 << 18) -> list[slice]:
    return [slice(a, min(n, a + most)) for a in range(0, n, most)]


def counted(terms: np.ndarray, n_terms: int) -> np.ndarray:
    """How often each of n_terms is there."""
    out = np.zeros(n_terms, np.int64)
    for own in pieces(len(terms), max(1 << 18, n_terms)):
        out += np.bincount(terms[own], minlength=n_terms)
    return out


def runs(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All places of the lists from first to last (none is empty), one after the other."""
    at = np.ones(int((last - first).sum()), np.int64)
    if len(at):
        at[0] = first[0]
        at[np.cumsum(last - first)[:-1]] = first[1:] - last[:-1] + 1
    return np.cumsum(at, out=at)


class Index:
    """Block-max inverted index over unit vectors of examples 0..n-1, and the vectors themselves."""

    ARRAYS = ("begin", "terms", "values", "list_begin", "ids", "weights", "row_of", "bounds", "often")

    def __init__(self, vectors: list[dict[int, float]], n_terms: int) -> None:
        begin = np.cumsum([0, *map(len, vectors)])
        terms = np.array([t for v in vectors for t in v], np.int32)
        self.build(begin, terms, np.array([x for v in vectors for x in v.values()]), n_terms)

    @classmethod
    def of(cls, begin: np.ndarray, terms: np.ndarray, values: np.ndarray, n_terms: int) -> Index:
        self = cls.__new__(cls)
        self.build(begin, terms, values, n_terms)
        return self

    @classmethod
    def load(cls, read: Callable[[str], np.ndarray]) -> Index:
        self = cls.__new__(cls)
        for name in cls.ARRAYS:
            setattr(self, name, read(name))
        self.ready()
        return self

    def build(self, begin: np.ndarray, terms: np.ndarray, values: np.ndarray, n_terms: int) -> None:
        self.begin, self.terms, self.values = begin, terms, values
        n, df = len(begin) - 1, counted(terms, n_terms)
        frequent = np.flatnonzero(df * RARE > n)
        self.row_of = np.full(n_terms, -1, np.int32)
        self.row_of[frequent] = np.arange(len(frequent))
        self.often = np.zeros((len(frequent), -(-n // BLOCK) * BLOCK), np.float32)  # whole blocks
        self.list_begin = np.concatenate([[0], np.cumsum(np.where(self.row_of < 0, df, 0))]).astype(np.int32)
        self.ids, self.weights = np.empty(self.list_begin[-1], np.int32), np.empty(self.list_begin[-1], values.dtype)
        after = self.list_begin[:-1].copy()
        for i in range(n):  # one example at a time: nothing as long as all postings is held beside the lists themselves
            own = slice(begin[i], begin[i + 1])
            t, x = terms[own], values[own]
            row = self.row_of[t]
            self.often[row[row >= 0], i] = x[row >= 0]
            t, x = t[row < 0], x[row < 0]
            self.ids[after[t]], self.weights[after[t]] = i, x
            after[t] += 1
        self.bounds = self.often.reshape(len(frequent), -(-n // BLOCK), BLOCK).max(axis=2) if len(frequent) else np.zeros((0, -(-n // BLOCK)), np.float32)
        self.ready()

    def ready(self) -> None:
        self.n = len(self.begin) - 1
        self.n_blocks = -(-self.n // BLOCK)
        self.dense = np.zeros(len(self.list_begin) - 1)

    def nearest(self, query: dict[int, float], k: int, without: int = -1) -> list[tuple[int, float]]:
        """(example, cosine) of the k best, and of all that tie with the last, by falling cosine."""
        return self.nearest_all([(np.array(list(query), np.int64), np.array(list(query.values()), float))], k, [without])[0]

    def nearest_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[list[tuple[int, float]]]:
        """`nearest` of some queries (terms, weights).

        Postings of a query's rarer terms are summed; the block maxima of the others bound what they can add. No weight is
        below 0, so what is summed is itself a lower bound, and the k-th largest of the blocks' largest sums is one of the K-th best
        cosine: blocks that cannot reach it are left. Where few examples can reach it, these are scored in full; the queries
        left take the product with all examples' weights of frequent terms. That is in single precision and only says who
        may be among the best (SLACK is far above its error): cosines and ties are those of the full vectors.
        """
        if not self.n:
            return [[] for _ in queries]
        without = without or [-1] * len(queries)
        q = np.zeros((len(queries), len(self.often)), np.float32)
        part = np.zeros((len(queries), self.n_blocks, BLOCK), np.float32)
        flat = part.reshape(len(queries), -1)
        for i, (t, x) in enumerate(queries):
            row = self.row_of[t]
            q[i, row[row >= 0]] = x[row >= 0]
            first, last = self.list_begin[t], self.list_begin[t + 1]
            rare = last > first
            first, last = first[rare], last[rare]
            at = runs(first, last)
            weights = self.weights.take(at, mode="clip")
            weights *= np.repeat(x[rare].astype(weights.dtype), last - first)
            flat[i] = np.bincount(self.ids.take(at, mode="clip"), weights, flat.shape[1])
            flat[i, without[i]] *= without[i] < 0
        bound = q @ self.bounds
        highest = part.max(axis=2)
        some: list[np.ndarray | None] = []
        for i in range(len(queries)):
            least = self.kth(highest[i], k)
            blocks = np.flatnonzero((highest[i] + bound[i] >= least - SLACK) & (highest[i] + bound[i] > 0))
            rows = None
            if len(blocks) * 4 <= self.n_blocks:
                upper = part[i, blocks] + bound[i, blocks, None]
                at, inside = np.nonzero((upper > 0) & (upper >= least - SLACK))
                rows = blocks[at] * BLOCK + inside
                rows = rows[rows < self.n]
            some.append(rows if rows is not None and len(rows) <= 4 * k else None)
        left = [i for i, rows in enumerate(some) if rows is None]
        if left:
            flat[left] += q[left] @ self.often
            highest = part[left].max(axis=2)
            for i, most in zip(left, highest):
                own = flat[i]
                if without[i] >= 0:
                    own[without[i]] = 0.0
                    most[without[i] // BLOCK] = part[i, without[i] // BLOCK].max()
                rows = np.flatnonzero((own > 0) & (own >= self.kth(most, k) - SLACK))
                some[i] = rows[own[rows] >= self.kth(own[rows], k) - SLACK]
        out = []
        for (t, x), rows, own in zip(queries, some, without):
            rows = rows[rows != own]
            scores = self.full(rows, t, x)
            rows, scores = rows[scores > 0], scores[scores > 0]
            if len(scores) > k:
                good = scores >= np.partition(scores, -k)[-k] - 1e-12
                rows, scores = rows[good], scores[good]
            out.append(sorted(zip(rows.tolist(), scores.tolist()), key=lambda p: (-p[1], p[0])))
        return out

    @staticmethod
    def kth(values: np.ndarray, k: int) -> float:
        """The k-th largest, 0 if there are fewer."""
        return float(np.partition(values, -k)[-k]) if len(values) >= k else 0.0

    def full(self, rows: np.ndarray, t: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The cosines of some examples with a query."""
        if not len(rows) or not len(t):
            return np.zeros(len(rows))
        self.dense[t] = x
        first, last = self.begin[rows], self.begin[rows + 1]
        at = runs(first, last)
        got = np.add.reduceat(self.dense.take(self.terms.take(at)) * self.values.take(at), np.cumsum(last - first) - (last - first))
        self.dense[t] = 0.0
        return got


def weights(n: np.ndarray, toxic: np.ndarray, size: int, bad: int) -> np.ndarray:
    """A term's weight beside its count: inverse document frequency, times more the surer it marks toxic examples."""
    idf = np.log((size + 1) / (n + 1)) + 1
    if not 0 < bad < size:
        return idf
    rate = bad / size
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(toxic > 0, toxic * np.log(toxic / (n * rate)), 0.0) + np.where(n > toxic, (n - toxic) * np.log((n - toxic) / (n * (1 - rate))), 0.0))
    lift = toxic * (size - bad) / np.maximum(1e-9, (n - toxic) * bad)
    return idf * (1 + BOOST * (np.maximum(0.0, g - SURE) / SURE) ** 0.5 * np.clip(np.log(np.maximum(lift, 1e-9)) / np.log(LIFT), 0.0, 1.0))


class Model:
    """known: sorted hashes of all terms; weight: of each; index over the examples that have a term; ids, labels of these."""

    def __init__(self, known: np.ndarray, weight: np.ndarray, index: Index, ids: np.ndarray, labels: np.ndarray, share: float, bare: float) -> None:
        self.known, self.weight, self.index, self.ids, self.labels, self.share, self.bare = known, weight, index, ids, labels, share, bare
        self.xs = self.ys = np.zeros(0)

    def vector(self, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = (1 + np.log(n)) * self.weight[t]
        return t, v / math.sqrt(np.dot(v, v)) if len(v) else v

    def vote(self, near: list[tuple[int, float]]) -> float:
        w = np.array([s * s for _, s in near])
        y = self.labels[[i for i, _ in near]] if near else np.zeros(0)
        return float((np.dot(w, y) + LEAN * self.share) / (w.sum() + LEAN))

    def save(self, folder: str) -> dict:
        """Write the arrays; a task that is tried again writes the same."""
        os.makedirs(folder, exist_ok=True)
        for name, array in [*((f, getattr(self, f)) for f in ("known", "weight", "ids", "labels")), *((f"index-{a}", getattr(self.index, a)) for a in Index.ARRAYS)]:
            np.save(os.path.join(folder, f"{name}.npy"), array)
        return {"share": self.share, "bare": self.bare, "n": self.index.n}

    def example_votes(self, rows: list[int]) -> list[float]:
        """The votes of some examples, each without itself."""
        own = [slice(self.index.begin[i], self.index.begin[i + 1]) for i in rows]
        return [self.vote(near) for near in self.index.nearest_all([(self.index.terms[o].astype(np.int64), self.index.values[o].astype(float)) for o in own], K, rows)]

    def scores(self, terms: Terms, texts: list[str | None]) -> list[tuple[float, list[int]]]:
        """(calibrated score, doc_ids of the five nearest examples) of each text."""
        out = []
        for a in range(0, len(texts), TOGETHER):
            for near in self.index.nearest_all([self.vector(*x) for x in terms.counts(texts[a : a + TOGETHER])], K):
                got = float(np.interp(self.vote(near), self.xs, self.ys)) if len(self.xs) and near else self.vote(near) if near else self.bare
                out.append((got, [int(self.ids[i]) for i, _ in near[:5]]))
        return out


def learnt(batches: Iterable[pa.RecordBatch]) -> Model:
    """The model, not calibrated yet, of (doc_id, y, terms, n). What is made of all postings is made part by part."""
    rows = sorted((row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("y", "doc_id", "terms", "n")))), key=lambda row: row[:2])
    ids, y = np.array([row[1] for row in rows], np.int64), np.array([row[0] for row in rows], float)
    sizes = np.array([len(row[3]) // 4 for row in rows], np.int64)
    counts = np.frombuffer(b"".join([row[3] for row in rows]), "<i4")
    hashes = np.frombuffer(b"".join([row[2] for row in rows]), np.int64)
    del rows
    share = float(y.mean()) if len(y) else 0.0
    known = np.unique(hashes)
    terms = np.empty(len(hashes), np.int32)
    for own in pieces(len(hashes)):
        terms[own] = np.searchsorted(known, hashes[own])
    del hashes
    toxic = counted(terms[int(sizes[y == 0].sum()) :], len(known)).astype(float)  # those come last
    weight = weights(counted(terms, len(known)).astype(float), toxic, len(y), int(y.sum()))
    values = np.empty(len(terms), np.float32)
    for own in pieces(len(terms)):
        values[own] = (1 + np.log(counts[own])) * weight[terms[own]]
    del counts
    some = np.flatnonzero(sizes)
    begin = np.concatenate([[0], np.cumsum(sizes[some])])
    for a, b in zip(begin.tolist(), begin[1:].tolist()):
        values[a:b] = values[a:b] / np.sqrt(np.add.reduceat(values[a:b].astype(float) ** 2, [0]))
    bare = y[sizes == 0]
    return Model(known, weight, Index.of(begin, terms, values, len(known)), ids[some], y[some], share, float((bare.sum() + share) / (len(bare) + 1)) if len(y) else 0.0)


PIECES = "name string, piece binary, share double, bare double, n long"


def in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files of the learnt model, one after the other, in pieces of PIECE bytes."""
    if first := next(batches, None):
        with tempfile.TemporaryDirectory() as own:
            numbers = learnt(chain([first], batches)).save(own)
            for path in sorted(Path(own).iterdir()):
                with path.open("rb") as f:
                    while piece := f.read(PIECE):
                        yield pa.RecordBatch.from_pylist([{"name": path.name, "piece": piece} | numbers])


def unpacked(folder: str) -> str:
    """A folder beside `folder` with the files whose pieces it holds; the first worker of a machine to have them all puts it there."""
    out = f"{folder}-files"
    if os.path.isdir(folder) and not os.path.isdir(out):
        own = tempfile.mkdtemp(dir=os.path.dirname(folder))
        for path in sorted(Path(folder).glob("*.parquet")):
            for batch in pq.ParquetFile(path).iter_batches(16, columns=["name", "piece"]):
                for name, piece in zip(*(c.to_pylist() for c in batch.columns)):
                    with open(os.path.join(own, name), "ab") as f:
                        f.write(piece)
        try:
            os.rename(own, out)
        except OSError:  # another worker was first
            shutil.rmtree(own)
    return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; one extra example of each label keeps scores off 0 and 1."""
    pools: list[list[float]] = []  # sum of x, sum of y, size
    for a, b in sorted(zip(x.tolist(), y.tolist())):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.1) / (p[2] + 0.2) for p in pools])


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(df: DataFrame, labels: DataFrame, most: int = MAX_EXAMPLES) -> Shared:
    """Learn from labelled rows that are not held out; `most` bounds the examples (in expectation)."""
    spark = df.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y")).where(~held_out())
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    examples = documents(df).join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")  # at most about `most` rows of two numbers
    examples = store(spark, examples, "examples")

    def make():
        terms = Terms()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = terms.counts(batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([t.tobytes() for t, _ in got], pa.binary()), pa.array([n.astype("<i4").tobytes() for _, n in got], pa.binary())], names=["doc_id", "y", "terms", "n"])

        return each

    rows = store(spark, arrow_map(examples, make, "doc_id long, y int, terms binary, n binary"), "terms")  # bounded by `most`
    tag = f"toxicity-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{tag}"
    folder = local_path(spark, path)
    if folder:  # a folder that workers can map: one task builds the model there

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if first := next(batches, None):
                yield pa.RecordBatch.from_pylist([learnt(chain([first], batches)).save(folder)])

        found = rows.coalesce(1).mapInArrow(build, "share double, bare double, n long").first()
    else:  # Spark writes the model's files there, cut in pieces, and each executor gets them once
        rows.coalesce(1).mapInArrow(in_pieces, PIECES).write.parquet(path)
        found = spark.read.schema(PIECES).parquet(path).select("share", "bare", "n").first()
        if found:
            spark.sparkContext.addFile(path, recursive=True)
    share, bare, n = found if found else (0.0, 0.0, 0)
    small = Shared(folder, tag, share, bare, n)
    if n:

        def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = small.open()
            for batch in batches:
                at = batch.column(0).to_pylist()
                for a in range(0, len(at), TOGETHER):
                    part = at[a : a + TOGETHER]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(own.labels[part], pa.float64()), pa.array(own.example_votes(part), pa.float64())], names=["id", "y", "vote"])

        got = spark.range(n).mapInArrow(votes, "id long, y double, vote double").toArrow().sort_by("id")
        small.xs, small.ys = isotonic(got.column("vote").to_numpy(), got.column("y").to_numpy())
    return small


class Shared:
    """What a task needs to open the model; its arrays are in files that the workers of a machine map together."""

    def __init__(self, folder: str | None, tag: str, share: float, bare: float, n: int = 0) -> None:
        self.folder, self.tag, self.share, self.bare, self.n = folder, tag, share, bare, n
        self.xs = self.ys = np.zeros(0)

    def open(self) -> Model:
        if not self.n:  # no example at all
            return Model(np.zeros(0, np.int64), np.zeros(0), Index([], 0), np.zeros(0, np.int64), np.zeros(0), self.share, self.bare)

        folder = self.folder or unpacked(SparkFiles.get(self.tag))
        if not os.path.exists(folder):
            raise RuntimeError(f"the model's folder {folder} is not seen from this machine: spark.checkpoint.dir must be shared by all")

        def read(name: str) -> np.ndarray:
            return np.load(os.path.join(folder, f"{name}.npy"), mmap_mode="r").view(np.ndarray)

        model = Model(*map(read, ("known", "weight")), Index.load(lambda a: read(f"index-{a}")), *map(read, ("ids", "labels")), self.share, self.bare)
        model.xs, model.ys = self.xs, self.ys
        return model


def score_texts(df: DataFrame, model: Shared) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for every whole text."""

    def make():
        own = model.open()
        terms = Terms(own.known)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = own.scores(terms, batch.column(1).to_pylist())
            scores = np.clip([s for s, _ in got], 0.0, 1.0)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32)), pa.array([e for _, e in got], pa.list_(pa.int64()))], names=["doc_id", "held_out", "score", "predicted", "evidence"])

        return each

    return arrow_map(documents(df).withColumn("held_out", held_out()), make, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")


def toxic_filter(df: DataFrame, model: Shared) -> DataFrame:
    """The rows that are not predicted toxic, columns as they were."""
    schema = df.schema
    names = df.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.open()
        terms = Terms(own.known)
        for batch in batches:
            yield batch.filter(pa.array([s < 0.5 for s, _ in own.scores(terms, batch.column(at).to_pylist())], pa.bool_()))

    return df.mapInArrow(run, schema)

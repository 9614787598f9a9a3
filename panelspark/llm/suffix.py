"""Exact substring dedup by suffix arrays: remove every byte covered by LENGTH bytes that also start in an earlier document.

Candidates. Each window of LENGTH bytes has an anchor: the place of the least hash among its SEED-byte strings, so equal
windows have equal anchors at equal places. Documents are dealt into chunks by id. A chunk sends the distinct keys of its
anchors to buckets; a bucket tells which keys are in two documents or more. Windows of other anchors are in one document
only, and are done.

Order. For each shared key a chunk sends its distinct contexts (the bytes of the successive windows that have this anchor)
with the least document. A bucket lays the different contexts of one key side by side as one text and builds
its suffix array by linear grouping (gsaca.py). Windows with equal bytes stand together there, so a class is a run whose
neighbours agree in LENGTH bytes; its least document decides for all its windows. Bits for each context go back to its chunk.

Keys in more than HOT documents would make long texts (a line that a third of all documents hold, each followed by something
else): their windows go by a 64-bit hash of all their bytes instead, which spreads them over all buckets. Nothing is dropped.

Null is the empty text. Null ids come after all others. Rows that repeat an id do not remove each other's bytes.
A chunk's texts are read in blocks, so a document of any length has bounded arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import documents, mix, ranges, sliding_min, window_hash
from panelspark.llm.gsaca import suffix_arrays

LENGTH, SEED = 50, 20
SPAN = LENGTH - SEED + 1
BLOCK, CHUNK, BUCKET_KEYS, HOT = 1 << 20, 3_000_000, 400_000, 128
LAST = np.iinfo(np.int64).max
LOW = np.uint64((1 << 22) - 1)


class Chunk:
    """The texts of some documents, end to end, with the anchors of their windows."""

    def __init__(self, ids: list[int | None], raws: list[bytes], buckets: int) -> None:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, raws[i]))
        self.ids = [ids[i] for i in order]
        self.doc = np.array([LAST if i is None else i for i in self.ids], np.int64)
        self.raws = [raws[i] for i in order]
        self.sizes = np.array([len(r) for r in self.raws], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.bytes = np.frombuffer(b"".join(self.raws) or b"\0", np.uint8)
        lo, hi, at, key, row = [], [], [], [], []
        n = int(self.ends[-1]) if len(self.ends) else 0
        for a in range(0, max(0, n - LENGTH + 1), BLOCK):
            part = self.bytes[a : min(n, a + BLOCK + LENGTH - 1)]
            h = window_hash(part, SEED)
            least = sliding_min((h & ~LOW) | np.arange(len(h), dtype=np.uint64), SPAN)
            where = (least & LOW).astype(np.int64)
            doc = np.searchsorted(self.ends, np.arange(a, a + len(where)), side="right")
            whole = np.arange(a, a + len(where)) + LENGTH <= self.ends[doc]
            new = np.ones(len(where), bool)
            new[1:] = (where[1:] != where[:-1]) | (whole[1:] != whole[:-1]) | (doc[1:] != doc[:-1])
            begin = np.flatnonzero(new)
            stop = np.append(begin[1:], len(where)) - 1
            good = whole[begin]
            begin, stop = begin[good], stop[good]
            lo.append(begin + a), hi.append(stop + a), at.append(where[begin] + a), row.append(doc[begin])
            full = mix(h[where[begin]] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            key.append((full % np.uint64(buckets)) << np.uint64(32) | full >> np.uint64(32))
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.lo, self.hi, self.at, self.row, self.key = join(lo, np.int64), join(hi, np.int64), join(at, np.int64), join(row, np.int64), join(key, np.uint64)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, ascending, and in how many documents each is (255 at most)."""
        order = np.lexsort((self.doc[self.row], self.key))
        k, d = self.key[order], self.doc[self.row][order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        fresh = new.copy()
        fresh[1:] |= d[1:] != d[:-1]
        at = np.flatnonzero(new)
        return k[at], np.minimum(255, np.add.reduceat(fresh.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)).astype(np.uint8)

    def select(self, shared: np.ndarray, hot: np.ndarray) -> None:
        """Keep the occurrences of shared keys; find the distinct contexts of those that are not hot, and hot windows."""
        keys, _ = self.keys()
        found = np.searchsorted(keys, self.key)
        keep = np.flatnonzero(shared[found]) if len(keys) else np.zeros(0, np.int64)
        is_hot = hot[found[keep]] if len(keys) else np.zeros(0, bool)
        cold = keep[~is_hot]
        self.c_lo, self.c_hi, self.c_row = self.lo[cold], self.hi[cold], self.row[cold]
        inside = window_hashes(self.bytes, np.concatenate([self.c_lo, self.c_hi]))
        first, last = inside[: len(cold)], inside[len(cold) :]
        full = mix(mix(mix(first) + last) ^ self.key[cold] ^ ((self.c_hi - self.c_lo).astype(np.uint64) << np.uint64(8) | (self.at[cold] - self.c_lo).astype(np.uint64)))
        self.contexts, self.context_of, self.context_doc = _distinct(self.key[cold], full, self.doc[self.c_row])
        self.context_key, self.context_hash, self.context_at = self.key[cold][self.contexts], full[self.contexts], self.contexts
        warm = keep[is_hot]
        width = self.hi[warm] - self.lo[warm] + 1
        self.w_at = np.repeat(self.lo[warm], width) + ranges(width)
        self.w_row = np.repeat(self.row[warm], width)
        h = window_hashes(self.bytes, self.w_at)
        self.windows, self.window_of, self.window_doc = _distinct(np.zeros(len(h), np.uint64), h, self.doc[self.w_row])
        self.window_hash = h[self.windows]


def _distinct(major: np.ndarray, minor: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row of each distinct (major, minor) in ascending order, the distinct one of each row, its least doc)."""
    order = np.lexsort((doc, minor, major))
    new = np.ones(len(order), bool)
    new[1:] = (major[order[1:]] != major[order[:-1]]) | (minor[order[1:]] != minor[order[:-1]])
    at = np.flatnonzero(new)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[at], which, doc[order[at]]


def window_hashes(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the LENGTH bytes at each place, block by block."""
    out = np.zeros(len(at), np.uint64)
    if not len(at):
        return out
    order = np.argsort(at, kind="stable")
    sorted_at = at[order]
    for a in range(int(sorted_at[0]) // BLOCK * BLOCK, int(sorted_at[-1]) + 1, BLOCK):
        i, j = np.searchsorted(sorted_at, [a, a + BLOCK])
        if j > i:
            out[order[i:j]] = window_hash(b[a : a + BLOCK + LENGTH - 1], LENGTH)[sorted_at[i:j] - a]
    return out


def spans(b: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    return b[np.repeat(lo, n) + ranges(n)]


def _chunk(table: pa.Table, buckets: int) -> Chunk:
    return Chunk(table.column("doc_id").to_pylist(), [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()], buckets)


def _rows(columns: list[list], kinds: list[pa.DataType], names: list[str]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _parts(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of runs of equal buckets."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
        if z > a:
            yield int(bucket[a]), a, z


SENT = ([pa.int64(), pa.int64(), pa.int32(), pa.binary()], ["bucket", "chunk", "kind", "blob"])
SENT_SCHEMA = "bucket long, chunk long, kind int, blob binary"


def send_keys(buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, docs = _chunk(table, buckets).keys()
        low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
        out = [[], [], [], []]
        for bucket, a, z in _parts((keys >> np.uint64(32)).astype(np.int64)):
            for column, value in zip(out, (bucket, key[0].as_py(), 0, low[a:z].tobytes() + docs[a:z].tobytes())):
                column.append(value)
        return _rows(out, *SENT)

    return run


def answer_keys(most: int):
    """For each chunk's keys two bits: in two documents or more; in more than `most`."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        blobs = table.column("blob").to_pylist()
        n = np.array([len(b) // 5 for b in blobs], np.int64)
        keys = np.concatenate([np.frombuffer(b, "<u4", m) for b, m in zip(blobs, n)])
        docs = np.concatenate([np.frombuffer(b, np.uint8, m, 4 * m) for b, m in zip(blobs, n)])
        distinct, which = np.unique(keys, return_inverse=True)
        total = np.bincount(which, weights=docs, minlength=len(distinct))
        shared, hot = (total > 1)[which], (total > most)[which]
        out, at = [], 0
        for m in n:
            out.append(np.packbits(shared[at : at + m]).tobytes() + np.packbits(hot[at : at + m]).tobytes())
            at += m
        some = np.flatnonzero(np.add.reduceat(shared.astype(np.int64), np.cumsum(n) - n)).tolist()
        pick = lambda c: [c[i] for i in some]
        return _rows([[key[0].as_py()] * len(some), pick(table.column("chunk").to_pylist()), [0] * len(some), pick(out)], *SENT)

    return run


def chosen(chunk: Chunk, replies: pa.Table) -> None:
    keys, _ = chunk.keys()
    shared, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    bucket = (keys >> np.uint64(32)).astype(np.int64)
    for b, blob in zip(replies.column("bucket").to_pylist(), replies.column("blob").to_pylist()):
        a, z = np.searchsorted(bucket, [b, b + 1])
        bits = np.frombuffer(blob, np.uint8)
        half = len(bits) // 2
        shared[a:z] = np.unpackbits(bits[:half], count=z - a).astype(bool)
        hot[a:z] = np.unpackbits(bits[half:], count=z - a).astype(bool)
    chunk.select(shared, hot)


def send_contexts(buckets: int):
    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if table.num_rows and replies.num_rows:
            c = _chunk(table, buckets)
            chosen(c, replies)
            lo, n = c.c_lo[c.context_at], c.c_hi[c.context_at] - c.c_lo[c.context_at] + LENGTH
            for bucket, a, z in _parts((c.context_key >> np.uint64(32)).astype(np.int64)):
                blob = b"".join([np.uint32(z - a).tobytes(), (c.context_key[a:z] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), c.context_hash[a:z].tobytes(), c.context_doc[a:z].tobytes(), n[a:z].astype(np.uint8).tobytes(), spans(c.bytes, lo[a:z], n[a:z]).tobytes()])
                for column, value in zip(out, (bucket, key[0].as_py(), 0, blob)):
                    column.append(value)
            dealt = (c.window_hash % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(dealt, kind="stable")
            for bucket, a, z in _parts(dealt[order]):
                for column, value in zip(out, (bucket, key[0].as_py(), 1, c.window_hash[order[a:z]].tobytes() + c.window_doc[order[a:z]].tobytes())):
                    column.append(value)
        return _rows(out, *SENT)

    return run


def window_classes(texts: np.ndarray, begin: np.ndarray, n: np.ndarray, cluster: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For the windows of each context, context after context: the least doc of a context of its cluster that holds it.

    Contexts (texts[begin : begin + n]) come cluster by cluster; those of one cluster share a lane.
    """
    windows = n - LENGTH + 1
    offset = np.cumsum(windows) - windows
    out = np.repeat(doc, windows)
    cuts = np.flatnonzero(np.diff(cluster, prepend=-1))
    members = np.diff(np.append(cuts, len(cluster)))
    several = np.flatnonzero(members > 1)
    if not len(several):
        return out
    size = np.add.reduceat(n + 1, cuts)[several]
    several = several[np.argsort(size, kind="stable")]
    size = np.sort(size, kind="stable")
    part = np.cumsum(size) // 1_000_000
    for p in np.unique(part):
        own = several[part == p]
        ctx = np.repeat(cuts[own], members[own]) + ranges(members[own])
        lengths = n[ctx] + 1
        flat = np.zeros(int(lengths.sum()), np.int64)
        start = np.cumsum(lengths) - lengths
        inner = np.repeat(start, n[ctx]) + ranges(n[ctx])
        flat[inner] = spans(texts, begin[ctx], n[ctx]).astype(np.int64) + 2
        flat[start + n[ctx]] = 1
        lane_end = np.cumsum(members[own]) - 1
        flat[start[lane_end] + n[ctx][lane_end]] = 0  # the last context of a lane ends it
        lane_start = start[np.cumsum(members[own]) - members[own]]
        lane_size = np.diff(np.append(lane_start, len(flat)))
        sa = suffix_arrays(flat, lane_start, lane_size)
        # Windows alone, in suffix order: where neighbours of one lane agree in LENGTH bytes, one class goes on.
        w_start = np.repeat(start, windows[ctx]) + ranges(windows[ctx])
        which = np.full(len(flat), -1, np.int64)
        which[w_start] = np.arange(len(w_start))
        ordered = sa[which[sa] >= 0]
        lane = np.repeat(np.arange(len(lane_start)), lane_size)
        word = np.zeros(len(flat) + 8, np.uint64)
        padded = np.append(flat, np.zeros(15, np.int64)).astype(np.uint64)
        for k in range(7):
            word = word * np.uint64(258) + padded[k : k + len(word)]  # seven symbols: 258**7 fits
        a, b = ordered[:-1], ordered[1:]
        same = lane[a] == lane[b]
        for k in [*range(0, LENGTH - 6, 7), LENGTH - 7]:
            same[same] = word[a[same] + k] == word[b[same] + k]
        head = np.append(True, ~same)
        at = np.flatnonzero(head)
        number = which[ordered]
        w_doc = np.repeat(doc[ctx], windows[ctx])
        least = np.minimum.reduceat(w_doc[number], at)
        best = np.empty(len(number), np.int64)
        best[number] = np.repeat(least, np.diff(np.append(at, len(head))))
        out[np.repeat(offset[ctx], windows[ctx]) + ranges(windows[ctx])] = best
    return out


def answer_contexts(key: tuple, table: pa.Table) -> pa.Table:
    """A bit for each window of each chunk's contexts: is it in an earlier document than the chunk's least one?"""
    bucket, kind = key[0].as_py(), key[1].as_py()
    blobs = table.column("blob").to_pylist()
    out = []
    if kind == 1:
        n = [len(b) // 16 for b in blobs]
        h = np.concatenate([np.frombuffer(b, np.uint64, m) for b, m in zip(blobs, n)])
        d = np.concatenate([np.frombuffer(b, np.int64, m, 8 * m) for b, m in zip(blobs, n)])
        _, which = np.unique(h, return_inverse=True)
        least = np.full(which.max() + 1, LAST)
        np.minimum.at(least, which, d)
        bits, at = least[which] < d, 0
        for m in n:
            out.append(np.packbits(bits[at : at + m]).tobytes())
            at += m
    else:
        keys, hashes, docs, lengths, texts = [], [], [], [], []
        for b in blobs:
            m = int(np.frombuffer(b, "<u4", 1)[0])
            keys.append(np.frombuffer(b, "<u4", m, 4))
            hashes.append(np.frombuffer(b, np.uint64, m, 4 + 4 * m))
            docs.append(np.frombuffer(b, np.int64, m, 4 + 12 * m))
            lengths.append(np.frombuffer(b, np.uint8, m, 4 + 20 * m).astype(np.int64))
            texts.append(np.frombuffer(b, np.uint8, -1, 4 + 21 * m))
        sizes = [len(k) for k in keys]
        keys, hashes, docs, lengths, texts = (np.concatenate(x) for x in (keys, hashes, docs, lengths, texts))
        begin = np.cumsum(lengths) - lengths
        rows, which, least = _distinct(keys.astype(np.uint64), hashes, docs)
        found = window_classes(texts, begin[rows], lengths[rows], keys[rows].astype(np.int64), least)
        windows = lengths[rows] - LENGTH + 1
        offset = np.cumsum(windows) - windows
        mine = lengths - LENGTH + 1
        earlier = found[np.repeat(offset[which], mine) + ranges(mine)] < np.repeat(docs, mine)
        weight = np.uint32(1) << ranges(mine).astype(np.uint32)
        masks = np.add.reduceat(np.where(earlier, weight, np.uint32(0)).astype(np.uint64), np.cumsum(mine) - mine).astype("<u4")
        at = 0
        for m in sizes:
            out.append(masks[at : at + m].tobytes())
            at += m
    some = [i for i, b in enumerate(out) if any(b)]
    pick = lambda c: [c[i] for i in some]
    return _rows([[bucket] * len(some), pick(table.column("chunk").to_pylist()), [kind + 1] * len(some), pick(out)], *SENT)


def covered(c: Chunk, replies: pa.Table) -> np.ndarray:
    """Of each byte of the chunk: is it removed?"""
    kinds = replies.column("kind").to_pylist() if replies.num_rows else []
    first = replies.filter(pa.array([k == 0 for k in kinds], pa.bool_())) if kinds else replies
    chosen(c, first)
    masks = np.zeros(len(c.contexts), np.uint64)
    bits = np.zeros(len(c.windows), bool)
    context_bucket = (c.context_key >> np.uint64(32)).astype(np.int64)
    dealt = (c.window_hash % np.uint64(c.buckets)).astype(np.int64)
    order = np.argsort(dealt, kind="stable")
    for b, kind, blob in zip(replies.column("bucket").to_pylist(), kinds, replies.column("blob").to_pylist()):
        if kind == 1:
            a, z = np.searchsorted(context_bucket, [b, b + 1])
            masks[a:z] = np.frombuffer(blob, "<u4")
        elif kind == 2:
            a, z = np.searchsorted(dealt[order], [b, b + 1])
            bits[order[a:z]] = np.unpackbits(np.frombuffer(blob, np.uint8), count=z - a).astype(bool)
    width = c.c_hi - c.c_lo + 1
    at = np.repeat(c.c_lo, width) + ranges(width)
    later = np.repeat(c.doc[c.c_row] > c.context_doc[c.context_of], width)
    told = (np.repeat(masks[c.context_of], width) >> ranges(width).astype(np.uint64) & np.uint64(1)).astype(bool)
    starts = np.concatenate([at[later | told], c.w_at[(c.doc[c.w_row] > c.window_doc[c.window_of]) | bits[c.window_of]]])
    edge = np.zeros(len(c.bytes) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def finish(buckets: int):
    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        c = _chunk(table, buckets)
        c.buckets = buckets
        gone = covered(c, replies)
        out = []
        for doc_id, end, size in zip(c.ids, c.ends.tolist(), c.sizes.tolist()):
            mine = gone[end - size : end]
            n = int(mine.sum())
            kept = c.bytes[end - size : end][~mine].tobytes() if size else b""
            out.append((doc_id, size, n, int(np.count_nonzero(np.diff(mine.astype(np.int8), prepend=0) == 1)), hashlib.sha256(kept).hexdigest(), kept))
        return _rows([list(x) for x in zip(*out)] if out else [[]] * 6, [pa.int64()] * 4 + [pa.string(), pa.binary()], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def dedup_substrings(df: DataFrame, chunk_bytes: int = CHUNK, bucket_keys: int = BUCKET_KEYS, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) for each document."""
    docs = documents(df)
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(1, -(-total // chunk_bytes))
    buckets = max(8, -(-2 * total // (SPAN + 1) // bucket_keys))
    # A row that repeats an id goes with it; null ids are dealt by their text.
    docs = docs.withColumn("chunk", F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)) + F.when(F.col("doc_id").isNull(), F.xxhash64("text") % 1000000).otherwise(F.lit(0)), F.lit(chunks)))
    by_chunk = docs.groupBy("chunk")
    keys = by_chunk.applyInArrow(send_keys(buckets), SENT_SCHEMA)
    shared = keys.groupBy("bucket").applyInArrow(answer_keys(hot), SENT_SCHEMA)
    contexts = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(send_contexts(buckets), SENT_SCHEMA)
    told = contexts.groupBy("bucket", "kind").applyInArrow(answer_contexts, SENT_SCHEMA)
    replies = shared.unionByName(told)
    return by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(finish(buckets), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

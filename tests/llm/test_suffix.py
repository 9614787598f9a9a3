import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import DATA, SCHEMA, prose, row

from panelspark.llm import suffix
from panelspark.llm.gsaca import suffix_arrays


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=40), min_size=1, max_size=8))
def test_suffix_arrays_of_many_texts(texts):
    flat = np.array([x for t in texts for x in [*t, 0]], np.int64)
    lengths = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(lengths) - lengths
    sa = suffix_arrays(flat, starts, lengths)
    for t, a, n in zip(texts, starts, lengths):
        own = [*t, 0]
        assert (sa[a : a + n] - a).tolist() == sorted(range(n), key=lambda i: own[i:])


def brute(rows):
    first = {}
    for d, t in rows:
        b, k = (t or "").encode(), 1 << 62 if d is None else d
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], 1 << 63), k)
    out = []
    for d, t in rows:
        b, k = (t or "").encode(), 1 << 62 if d is None else d
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < k:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, gone) if not y)
        runs = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out.append((d is None, d or 0, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def same(spark, rows, **more):
    df = spark.createDataFrame([row(d, t) for d, t in rows], SCHEMA)
    got = suffix.dedup_substrings(df, 100_000, 20_000, **more).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)
    return got


def test_equals_brute_force(spark):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{DATA}/sf0.001/documents.parquet")
    same(spark, list(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist())))


def test_odd_documents(spark, odd_rows, empty):
    rows = [(d, t) for d, t, *_ in odd_rows] + [(50, "ab" * 4000), (51, "ba" * 3000), (52, "x" * 49), (53, "x" * 50), (54, prose(5, 30) + prose(1, 60)[:55])]
    got = same(spark, rows)
    assert sum(r.n_removed for r in got) > 20_000 and suffix.dedup_substrings(empty).count() == 0


def test_a_line_in_every_document(spark):
    """A key in more documents than HOT goes by its windows; the answer is the same."""
    line = prose(7, 14)
    rows = [(i, prose(100 + i, 15) + line + prose(300 + i, 15)) for i in range(60)]
    assert {tuple(r) for r in same(spark, rows)} == {tuple(r) for r in same(spark, rows, hot=5)}

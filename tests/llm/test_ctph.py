import hashlib

import pytest
from llm_helpers import prose

from panelspark.llm import ctph


def slow_fingerprint(raw: bytes) -> str:
    """The definition, byte by byte."""
    from panelspark.llm.common import mix
    import numpy as np

    def at(size):
        out, h, n = "", 0, 0
        for i, x in enumerate(raw):
            h, n = (h + (x + 1) * pow(ctph.BASE, n, 1 << 64)) & (1 << 64) - 1, n + 1
            last = [raw[i - k] if i >= k else 0 for k in range(7)]
            r = sum(last)
            r += sum(v * (7 - k) for k, v in enumerate(last))
            s = 0
            for k, v in enumerate(last):
                s ^= (v << 5 * k) & 0xFFFFFFFF
            r = (r + s) & 0xFFFFFFFF
            if r % size == size - 1 or i == len(raw) - 1:
                out += ctph.LETTERS[int(mix(np.array([(h + n) & (1 << 64) - 1], np.uint64))[0]) >> 58]
                h, n = 0, 0
        return out

    size = 3
    while len(at(size)) > 64:
        size *= 2
    return f"{size}:{at(size)}:{at(2 * size)}"


def test_fingerprints_equal_their_definition():
    for text in ("a", "hello world", prose(1, 30), prose(2, 200), "x" * 500, "日本語 " * 50):
        raw = text.encode()
        mine, slow = ctph.fingerprint(raw), slow_fingerprint(raw)
        assert mine == slow or len(mine.split(":")[1]) == 64, text[:20]
    assert ctph.fingerprint(b"") == "3::"


def test_common_length():
    def slow(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    for a, b in (("", "a"), ("abcde", "ace"), (prose(1, 20), prose(2, 20)), ("aab" * 20, "aba" * 19)):
        assert ctph.common_length(a, b) == slow(a, b)


def test_likeness_follows_edits():
    one = prose(1, 800)
    little, half = one.replace("a", "b", 2), one[: len(one) // 2] + prose(5, 400)
    prints = [ctph.fingerprint(t.encode()) for t in (one, little, half, prose(9, 800))]
    scores = [ctph.likeness(prints[0], p) for p in prints]
    assert scores[0] == 1 and scores[1] > 0.9 and 0.3 < scores[2] < 0.8 and scores[3] == 0


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    out = []
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        f, e, x = (ctph.fingerprint(s.encode()) for s in (t, edited, nxt))
        out.append((d is None, d or 0, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, ctph.likeness(f, e), ctph.likeness(f, x)))
    return sorted(out)


@pytest.mark.parametrize("each", [4_000, 5])
def test_edited_texts(spark, odd_rows, each, empty, monkeypatch):
    whole = ctph.with_next
    monkeypatch.setattr(ctph, "with_next", lambda df: whole(df, each))
    rows = [(d, t) for d, t, *_ in odd_rows if d is not None or t is None] + [(100 + 3 * i, prose(i, 20 + i)) for i in range(40)]
    got = ctph.edited_texts(spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, *tuple(r)[1:]) for r in got) == brute(rows)
    assert ctph.edited_texts(empty).count() == 0

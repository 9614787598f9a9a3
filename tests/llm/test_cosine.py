"""Links of near vectors against all cosines in double precision."""

import math

import numpy as np
import pytest

from panelspark.llm import cosine
from panelspark.llm.cosine import near_vectors


def plain(rows, threshold=0.95):
    n = len(rows)
    unit = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) if ok else None
        unit.append(None if x is None else x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()))
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i], links[j] = links[i] + 1, links[j] + 1
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], links[i], least.get(find(i)), rows[i][0] == least.get(find(i))) for i in range(n)), key=lambda x: (x[0] is None, x[0] or 0, x[1:3]))


def collected(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1:3]))


@pytest.fixture(scope="module")
def rows():
    """Chains, hot copies, cosines on both sides of the threshold, odd vectors."""
    r = np.random.default_rng(4)
    out = [(i, r.normal(size=16).tolist()) for i in range(60)]
    base = r.normal(size=16)
    out += [(100 + i, (base + r.normal(size=16) * 0.22).tolist()) for i in range(120)]
    chain = [np.cos(a) * np.eye(16)[0] + np.sin(a) * np.eye(16)[1] for a in np.arange(25) * 0.3]
    out += [(300 - i, (v * 10.0**i).tolist()) for i, v in enumerate(chain)]
    out += [(400 + i, base.tolist()) for i in range(40)] + [(401, base.tolist())] * 3
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0] * 15, [2.0] * 15, [1e-300] * 16, [1e300] * 16]
    return out + [(500 + i, v) for i, v in enumerate(odd)] + [(None, [3.0] * 15), (None, (-base).tolist()), (None, None), (7, out[3][1])]


def frame(spark, rows):
    return spark.createDataFrame([(*x, i % 3, "clash", 1) for i, x in enumerate(rows)], "vec_id long, embedding array<double>, label int, node string, m int")


def test_all_pairs(spark, rows):
    assert collected(near_vectors(frame(spark, rows))) == plain(rows)
    assert near_vectors(frame(spark, rows).limit(0)).count() == 0


def test_many_small_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(cosine, "BLOCK", 40)
    assert collected(near_vectors(frame(spark, rows))) == plain(rows)


def test_tiles_and_bound(monkeypatch):
    """Cosines within the bound of the threshold are decided as in double precision, in long vectors too."""
    monkeypatch.setattr(cosine, "TILE", 37)
    r = np.random.default_rng(0)
    for d in (3, 64, 1_500):
        base = r.normal(size=d)
        x = base + r.normal(size=(200, d)) * 0.33 * np.sqrt((base**2).mean())
        x[:50] = r.normal(size=(50, d))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        cos = unit @ unit.T
        threshold = float(np.median(cos[60:, 60:]))
        want = cos >= threshold
        np.fill_diagonal(want, False)
        links, root = cosine.block_links(x, np.ones(200, np.int64), np.zeros(200, np.int64), threshold)
        assert (links == want.sum(1)).all()
        assert all((root[i] == root[j]) for i, j in zip(*np.nonzero(want)))
        side = (np.arange(200) % 2).astype(np.int64)
        links, _ = cosine.block_links(x, np.ones(200, np.int64), side, threshold)
        assert (links == (want & (side[:, None] != side[None, :])).sum(1)).all()

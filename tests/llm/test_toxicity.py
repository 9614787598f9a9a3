import zlib

import numpy as np
import pytest
from llm_helpers import DATA, SCHEMA

from panelspark.llm import toxicity as tox
from panelspark.llm.common import table


def test_index_is_exact():
    r = np.random.default_rng(3)
    vectors = []
    for _ in range(500):
        v = {int(t): float(x) for t, x in zip(r.choice(30, r.integers(1, 6), replace=False), r.random(6) + 0.1)}
        size = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: x / size for t, x in v.items()})
    vectors += vectors[:100]  # ties
    index = tox.Index(vectors, 30)
    for q in vectors[::17]:
        want = np.array([sum(x * v.get(t, 0.0) for t, x in q.items()) for v in vectors])
        got = index.nearest(q, 15)
        least = np.sort(want)[-15]
        assert {i for i, _ in got} >= set(np.flatnonzero(want > least + 1e-9).tolist()) and len(got) >= 15
        assert all(abs(want[i] - s) < 1e-9 and want[i] >= least - 1e-9 for i, s in got)
        assert {i for i, _ in got} == set(np.flatnonzero((want >= least - 1e-12) & (want > 0)).tolist())


def test_few_examples_are_scored_in_full(monkeypatch):
    """Queries like no example in particular: the best are found exactly, and hardly more than those are scored in full."""
    r = np.random.default_rng(5)
    n, n_terms, k = 4_000, 3_000, 15
    share = np.concatenate([np.full(2, 0.3), np.full(n_terms - 2, 0.02)])
    there = r.random((n, n_terms)) < share
    dense = there * (r.random((n, n_terms)) + 0.5)
    dense /= np.sqrt((dense**2).sum(axis=1))[:, None]
    row, col = np.nonzero(dense)
    index = tox.Index.of(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), col.astype(np.int32), dense[row, col], n_terms)
    own, scored = index.full, []
    monkeypatch.setattr(index, "full", lambda rows, t, x: scored.append(len(rows)) or own(rows, t, x))
    asked = list(range(0, n, 50))
    for without in ([-1] * len(asked), asked):
        scored.clear()
        got = index.nearest_all([(np.flatnonzero(dense[i]), dense[i][dense[i] > 0]) for i in asked], k, without)
        for i, w, near in zip(asked, without, got):
            want = dense @ dense[i]
            if w >= 0:
                want[w] = 0
            assert {e for e, _ in near} == set(np.flatnonzero(want >= np.sort(want)[-k] - 1e-12).tolist()) and all(abs(want[e] - s) < 1e-9 for e, s in near)
        assert sum(scored) <= 4 * k * len(asked), sum(scored) / len(asked)


def test_words_are_counted_alike_in_any_batch():
    texts = [None, "", "Nasty NASTY nastily", "ça déjà vu_3 x9y", "日本 語 nasty", "..", "a b " * 50]
    bare = tox.Terms()
    want = [bare.counts([t])[0] for t in texts]
    known = np.unique(np.concatenate([t for t, _ in want]))[::2]
    for terms in (tox.Terms(), tox.Terms(known)):
        for (t, n), (wt, wn) in zip(terms.counts(texts), want):
            keep = np.isin(wt, known) if terms.known is not None else np.ones(len(wt), bool)
            assert (terms.known[t] if terms.known is not None else t).tolist() == wt[keep].tolist() and n.tolist() == wn[keep].tolist()
    assert dict(zip(*map(np.ndarray.tolist, want[2])))[int(np.frombuffer(tox.blake2b(b"nast*", digest_size=8).digest(), "<i8")[0])] == 3


def test_isotonic_rises():
    x, y = tox.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0, 1, 0, 1, 1.0]))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and 0 < y[0] and y[-1] < 1


def test_held_out_accuracy(spark):
    docs, labels = table(spark, f"{DATA}/sf0.1", "documents"), table(spark, f"{DATA}/sf0.1", "labels")
    got = tox.score_texts(docs, tox.fit(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got.predicted == got.toxic).mean()) > 0.97 and got.predicted[got.toxic == 1].mean() > 0.9
    rank = got.score.rank().to_numpy()
    pos = (got.toxic == 1).to_numpy()
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.97


def test_odd_documents(spark, odd, odd_rows, empty):
    labels = table(spark, f"{DATA}/sf0.001", "labels")
    model = tox.fit(table(spark, f"{DATA}/sf0.001", "documents"), labels)
    got = tox.score_texts(odd, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert tox.score_texts(empty, model).count() == 0
    kept = tox.toxic_filter(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted == 0 for r in got)
    none = tox.fit(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in tox.score_texts(odd, none).collect()} == {0.0}


def test_labels_of_held_out_rows_do_not_count(spark):
    rows = [(i, f"word{i % 7} plain text" + (" nasty" if i % 2 else ""), "en", "s", 1, "", "", "", 1) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    wrong = spark.createDataFrame([(i, 1, (i + (zlib.crc32(str(i).encode()) % 5 == 0)) % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    one, other = (tox.score_texts(df, tox.fit(df, y)).orderBy("doc_id").collect() for y in (labels, wrong))
    assert one == other and all(r.predicted == r.doc_id % 2 for r in one)


def test_texts_without_a_telling_word_have_neighbours(spark):
    """Every example is in the index and every text with a known term is searched, whether or not a term marks toxic ones."""
    rows = [(i, f"alpha{'abcdefghij'[i % 10] * 3} common filler" + (" nasty" if i % 2 else ""), "en", "s", 1, "", "", "", 1) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    model = tox.fit(spark.createDataFrame(rows, SCHEMA), labels)
    asked = [(1000, "alphaccc filler", "en", "s", 1, "", "", "", 1), (1001, "common", "en", "s", 1, "", "", "", 1), (1002, "unheard", "en", "s", 1, "", "", "", 1)]
    got = {r.doc_id: r for r in tox.score_texts(spark.createDataFrame(asked, SCHEMA), model).collect()}
    assert len(got[1000].evidence) == len(got[1001].evidence) == 5 and not got[1002].evidence
    assert all(e % 10 == 2 for e in got[1000].evidence)


def test_a_model_that_is_not_seen_is_an_error():
    lost = tox.Shared("/nowhere/at/all", "tag", 0.5, 0.5, 3)
    with pytest.raises(RuntimeError, match="not seen"):
        lost.open()
    assert tox.Shared(None, "tag", 0.5, 0.5, 0).open() is not None


def test_the_model_is_built_in_little_memory():
    """Beside the postings and the index, no arrays of the length of all postings are held together."""
    import tracemalloc

    r = np.random.default_rng(7)
    n, size = 1_500, 600
    batches = []
    for a in range(0, n, 100):
        terms = [np.sort(r.choice(200_000, size, replace=False).astype(np.int64)) for _ in range(100)]
        batches.append(tox.pa.RecordBatch.from_arrays([tox.pa.array(range(a, a + 100), tox.pa.int64()), tox.pa.array([i % 2 for i in range(100)], tox.pa.int32()), tox.pa.array([t.tobytes() for t in terms], tox.pa.binary()), tox.pa.array([np.ones(size, "<i4").tobytes()] * 100, tox.pa.binary())], names=["doc_id", "y", "terms", "n"]))
    tracemalloc.start()
    try:
        model = tox.learnt(iter(batches))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.index.ids) == n * size and peak < 40 * n * size, peak / (n * size)
    t, x = model.index.terms[:size], model.index.values[:size]
    assert model.labels[0] == 0 and abs(float((x.astype(float) ** 2).sum()) - 1) < 1e-5 and all(0 in model.index.ids[model.index.list_begin[i] : model.index.list_begin[i + 1]] for i in t[:5])


CLUSTER = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from panelspark.llm import common, toxicity as tox
folders = {folders!r}
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "700m").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.hadoop.fs.viewfs.mounttable.store.link./shared", "file://" + folders[0]).getOrCreate()
docs = spark.createDataFrame([(i, f"word{{'abcdefg'[i % 7]}} plain text" + (" nasty" if i % 2 else "")) for i in range(200)], "doc_id long, text string")
labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
for folder in folders:
    common.shared_dir = tox.shared_dir = lambda spark: folder
    got = tox.score_texts(docs, tox.fit(docs, labels)).collect()
    assert len(got) == 200 and all(r.predicted == r.doc_id % 2 for r in got), folder
    print(sorted((r.doc_id, r.score) for r in got))
"""


def test_the_model_reaches_executors_by_any_shared_folder(tmp_path):
    """On a cluster: folders without a scheme, with file:, and of a store that only Spark reads."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    repo = str(Path(__file__).resolve().parents[2])
    script = CLUSTER.format(repo=repo, folders=[str(tmp_path), f"file://{tmp_path}", "viewfs://store/shared"])
    done = subprocess.run([sys.executable, "-c", script], env=os.environ | {"PYTHONPATH": repo}, cwd=tmp_path, capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-2000:]
    scores = [line for line in done.stdout.splitlines() if line.startswith("[(")]
    assert len(scores) == 3 and len(set(scores)) == 1

import hashlib

import numpy as np
import pytest
from llm_helpers import DATA, SCHEMA, prose, row

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near-dedup", "mixing", "bpe"]


def test_each_stage_acts_on_what_is_left(spark, tmp_path):
    from tokenizers import Tokenizer

    from panelspark.llm.queries import bpe_path

    sf = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at[-1], sf).write.parquet(f"{tmp_path}/{i}")
        at.append(spark.read.parquet(f"{tmp_path}/{i}"))
    start, clean, lines, distinct, mixed, coded = (x.toPandas() for x in at)
    for x in (clean, lines, distinct, mixed):
        assert list(x.columns) == list(start.columns)
    assert 0 < len(clean) < len(start) and set(clean.doc_id) <= set(start.doc_id)
    assert len(lines) == len(clean) and lines.n_chars.sum() < clean.n_chars.sum() and (lines.n_chars == lines.text.str.len()).all()
    assert len(distinct) < len(lines) and distinct.doc_id.is_unique
    words = lambda x: x.text.str.split().str.len().sum()
    assert abs(words(mixed) - 1.5 * words(distinct)) < 0.02 * words(distinct) and mixed.groupby("doc_id").size().max() <= 2
    ref = Tokenizer.from_file(bpe_path())
    want = sorted((d, hashlib.sha256(np.array(ref.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for d, t in zip(mixed.doc_id, mixed.text))
    assert sorted(zip(coded.doc_id, coded.ids_sha256)) == want


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, f"{DATA}/sf0.001")
    assert out.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_texts_of_no_id_or_of_one_id_are_documents_each(spark):
    same = prose(5, 30)
    rows = [row(1, same + "\n" + prose(6, 30)), row(None, prose(7, 60) + "\n" + same), row(None, prose(8, 60) + "\n" + prose(9, 30)), row(None, prose(8, 60) + "\n" + prose(9, 30)), row(2, prose(10, 60)), row(2, prose(11, 60) + "\n" + prose(12, 40))]
    docs = spark.createDataFrame(rows, SCHEMA)
    lines = corpus_pipeline.dedup_lines(spark, docs, "")
    want = [r[1] for r in rows]
    want[1] = prose(7, 60)
    assert sorted(r.text for r in lines.collect()) == sorted(want)
    kept = corpus_pipeline.dedup_documents(spark, docs, "")
    assert kept.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted({(str(r[0]), r[1]) for r in rows})

"""The queries of these operators over the driver's tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import table


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.media import stored_texts

    return stored_texts(table(spark, sf_dir, "documents"))


def op2_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.probminhash import classified

    return classified(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), bpe_path())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.toxicity import fit, score_texts

    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, fit(docs, table(spark, sf_dir, "labels")))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.lines import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.ctph import edited_texts

    return edited_texts(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.suffix import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.codes import compressed

    return compressed(table(spark, sf_dir, "embeddings"))


def op12_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.cosine import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.repair import repair

    return repair(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media, op2_probminhash, op3_bpe, op4_toxicity, op5_licenses, op6_passages, op7_lines, op8_ctph, op9_mixing, op10_suffix, op11_codes, op12_cosine, op13_repair)}


def oracle_sql() -> dict[str, str]:
    from panelspark.llm.codes import compressed_sql
    from panelspark.llm.cosine import near_vectors_sql

    return {"op11_codes": compressed_sql(), "op12_cosine": near_vectors_sql()}

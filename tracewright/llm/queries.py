"""One thin query for each operator, with production parameters over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, language_model, media, packing, quality, simhash, token_counts, token_records, url_filter
from .common import crc32_mod, held_out, materialise, table


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file, the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = docs.where(crc32_mod("doc_id", 4) != 2)
    found = language_id.identify(docs, language_id.fit(learned))
    return found.select("doc_id", F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score", "accepted")


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.token_records(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_digests(table(spark, sf_dir, "documents"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"), fold=5, out=1)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), 4096)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = materialise(quality.describe(table(spark, sf_dir, "documents")), "statistics")
    model = quality.fit(described, table(spark, sf_dir, "labels"), fold=5, out=0)
    found = quality.score(described, model, threshold=0.3)
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), length=2048, end_id=0)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(table(spark, sf_dir, "documents"), limit=3)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_token_records, op3_media, op4_language_model, op5_decontamination, op6_token_counts, op7_quality, op8_packing, op9_simhash, op10_url_filter)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": decontaminate.oracle(), "op10_url_filter": url_filter.oracle()}

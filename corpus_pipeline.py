"""A corpus pipeline: language ID, quality, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import decontaminate, language_id, packing, quality, simhash
from tracewright.llm.common import materialise, table
from tracewright.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null, empty or letterless texts, ties, and narrow margins.

    Each row is judged by its whole text, so rows that repeat stay or go alike; null ids, languages and sources don't matter (rows without a
    language aren't learned from). Without any labelled language, and so for an empty table, nothing stays.
    """
    return language_id.keep_identified(docs, language_id.fit(docs))


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for bad go (a score under 0.3); it learns from the labels of this stage's documents.

    Each row is judged by its own text, null as empty; rows that repeat stay or go alike. Null ids and null labels teach nothing; without
    labels every score is 0.5 and all stay. An empty table stays empty.
    """
    described = materialise(quality.describe(docs), "statistics")
    return quality.keep_good(docs, quality.fit(described, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: that of the smallest id, and of rows that repeat it the one whose text sorts first.

    Rows of one id, or of none, whose texts aren't linked all stay; a group without any id keeps the row whose text sorts first. Null,
    empty and wordless texts have fingerprint zero and are one group with all within three bits of it. An empty table stays empty.
    """
    return simhash.keep_first(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go: 0.8 or more of its shingles of five words.

    Each row is judged by its own text, whatever its id; rows that repeat stay or go alike. Null and wordless texts and items match nothing;
    an item of under five words matches only a document of the same words. Empty tables, of documents or of items, take nothing away.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces in sequences of 2048 tokens: a row for each piece.

    A null text is empty and has its end token only; each row that repeats is packed; ids may be null or repeated. An empty table gives no piece.
    """
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality", judge_quality),
    ("simhash", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("packing", pack),
]

#: Learned models and tokenizers can't be written in SQL; tests hold each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

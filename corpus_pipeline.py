"""The corpus pipeline: language ID, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir); run() writes what it returns as Parquet to the
shared folder and reads it again as the next stage's docs. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from xsdframe.llm import langid, packing, quality, simhash
from xsdframe.llm.common import discard_path, materialise, scratch, table
from xsdframe.llm.queries import vocabulary

#: Least share of a text's n-grams that one language must explain. Clean texts of a learned
#: language have over one half.
LEAST_SHARE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the learned languages, go."""
    return langid.accepted(docs, langid.fit(docs), LEAST_SHARE)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the classifier's threshold go."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id."""
    return simhash.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality", quality_classifier),
    ("near_dedup", near_dedup),
    ("packing", pack),
]

#: DuckDB can express none of the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as made:  # what a stage wrote on the way goes, its result stays
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept = made.pop()
        if before:
            discard_path(spark, before)
        before = kept
    return docs

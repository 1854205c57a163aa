"""Corpus pipeline: from the documents table to shards, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents. Documents that the quality classifier rejects go; one document of each group of
near-duplicates stays; documents that hold a benchmark item go; sources are mixed to their target weights, so documents may
repeat or drop out; the last stage adds size, text_crc32, law, shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import decontamination, mixing, quality, sharding, simhash
from lexiloom.llm.shared import DOCUMENT_COLUMNS, documents, written

SHARDS = 24


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier predicts as good, repeated rows as often as they come.

    Null and empty texts are points like others; null doc_ids aren't learned from. An empty table stays empty; other columns go.
    """
    rated = quality.score(docs.select(*DOCUMENT_COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rated.filter("predicted = 1").select(*DOCUMENT_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least doc_id (null last), then the least text hash; of wholly equal rows one.

    Null texts, empty ones and others without words are one group. An empty table stays empty; other columns go.
    """
    return simhash.one_of_each(docs.select(*DOCUMENT_COLUMNS), **simhash.SIMILAR)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item, repeated rows as often as they come.

    Null and empty texts hold none, so they stay, as do null doc_ids. An empty table stays empty; other columns go.
    """
    return decontamination.decontaminate(docs.select(*DOCUMENT_COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as its source's target takes it. A null source is a source like others.

    Documents without words, null texts among them, stay once; repeated rows are ordinary rows. An empty table stays empty; other columns go.
    """
    return mixing.mixed_rows(docs.select(*DOCUMENT_COLUMNS))


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot, equal texts in one shard; null texts are alike, and apart from empty ones.

    Null doc_ids and repeated rows are ordinary rows. An empty table gives an empty result; other columns go.
    """
    return sharding.shard(docs.select(*DOCUMENT_COLUMNS), SHARDS)


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("source mixing", mix_sources),
    ("sharding", into_shards),
]

#: The classifier, the fingerprints and the packing have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

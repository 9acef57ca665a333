"""A corpus pipeline: each stage works on all that the one before it kept.

Raw documents become packed training sequences: texts unlike those labelled good
go, then texts in no known language, then all but one of each group of near
copies; sources are mixed to equal shares of characters, and what is left is
packed into sequences of 1024 ids.  All stages but the last return the columns
of ``documents``, under whatever further names they come.  Null and empty texts
are judged like any other; repeated rows are each their own until the third
stage; an empty table stays empty in all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tonewatch.llm import language_id, mixing, packing, quality_classifier, simhash
from tonewatch.session import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling towards those labelled good and not toxic."""
    return quality_classifier.keep_drawn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models, learned from ``docs``, recognise."""
    return language_id.keep_accepted(docs, language_id.fit(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: shingles of 4 words, at most 4 differing bits."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that each source has the same share of the characters, in random order."""
    return mixing.mix_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_known_languages),
    ("SimHash near-dedup", keep_one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Tokenizers and language models have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, "stage")
    return docs

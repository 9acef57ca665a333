"""The registered queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard
from . import conversation_repair, filter_audit, fingerprints, html_text, language_id, mixing, ngram_join, packing, quality_classifier, quality_rules, similar_texts, simhash, suffix_tree, token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op2_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 1024 ids."""
    packed = packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


@query("op4_token_files")
def token_files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token files and read them back."""
    manifest = token_files.write_token_files(
        documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1
    )
    read = token_files.read_token_files(manifest)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op3_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op6_quality_rules", quality_rules.quality_sql())
def rules_on_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document."""
    return quality_rules.quality(documents(spark, sf_dir))


@query("op9_poisson_mixing", mixing.mixing_sql("doc_id, text, lang, source, n_chars"))
def poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, repeated so that every source has the same share of the characters."""
    return mixing.mix(documents(spark, sf_dir))


@query("op8_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash fingerprints of every document and of its edited text, and its class of similar texts."""
    docs = documents(spark, sf_dir)
    rows, classes = similar_texts.classes_of_texts(docs)
    discard(rows)
    return fingerprints.fingerprint_changes(docs).join(classes, "text_key").drop("text_key")


@query("op5_importance_resampling")
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log weight and verdict of every document."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.resample(documents(spark, sf_dir), labels)


@query("op10_language_id")
def language_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = documents(spark, sf_dir)
    found = language_id.identify(docs, language_id.fit(docs))
    return found.withColumn("held_out", language_id.held_out(F.col("doc_id")))


@query("op7_suffix_tree_scores")
def suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, learned from those that are not held out."""
    return suffix_tree.score(documents(spark, sf_dir))


@query("op13_filter_audit", filter_audit.audit_sql())
def filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes per language, in all of their orders."""
    return filter_audit.audit_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op12_conversation_repair")
def conversations_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired rows of every conversation, after its damage."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.repair_report(conversation_repair.damage(conversations))


@query("op11_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's set of 5-grams and the component of documents alike by 0.8."""
    return ngram_join.similar_documents(documents(spark, sf_dir))

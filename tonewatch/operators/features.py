"""Bag-of-words features as relations and as vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel, HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ENGLISH_STOP_WORDS, HASHING_FEATURES
from ..session import materialize
from .lookup import BROADCAST_BYTES, data_bytes, lookup_join
from .running import running_totals

#: So many terms that share the last count are sorted by one task.
SORTED_TIES = 50_000


def tokenize(df: DataFrame, input_col: str = "Text", output_col: str = "words") -> DataFrame:
    """Lower-case and split on single whitespace characters, as the ML tokenizer does.

    Like there, no empty words end the list, and blank text has no words at all.
    Built-in functions keep the words in Spark's own format; the ML stage would
    turn every word into a Java string and back.
    """
    lowered = F.lower(F.col(input_col))
    body = F.regexp_replace(lowered, r"\s+$", "")
    blank = (body == "") & (F.col(input_col) != "")
    words = F.when(blank, F.array().cast("array<string>")).otherwise(F.split(body, r"\s", -1))
    return df.withColumn(output_col, words)


def stopwords_remover(
    df: DataFrame,
    input_col: str = "words",
    output_col: str = "filtered_words",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """Drop stop words from word lists, whatever their case."""
    stops = sorted({word.lower() for word in stop_words})
    return df.withColumn(output_col, F.filter(input_col, lambda word: ~F.lower(word).isin(stops)))


def feature_tokens(df: DataFrame, text_col: str = "Text") -> DataFrame:
    return stopwords_remover(tokenize(df, text_col))


def count_vectorizer_vocab(docs: DataFrame, words_col: str = "filtered_words", size: int = 2**18) -> DataFrame:
    """The ``size`` most frequent terms; ties go to the smaller term.

    Counts combine before the shuffle, so a term that fills a third of all
    texts arrives as one row per partition.
    """
    terms = docs.select(F.explode(words_col).alias("term")).groupBy("term")
    return top_terms(terms.agg(F.count(F.lit(1)).alias("count")), size)


def top_terms(counts: DataFrame, size: int, sorted_ties: int = SORTED_TIES) -> DataFrame:
    """The ``size`` largest of ``(term, count)`` rows, in no particular order.

    How many terms share each count shows where the vocabulary ends; of the
    terms that share the last count the smallest are taken, up to a term that is
    found by counting prefixes.  No task sees more than ``sorted_ties`` terms,
    however many share a count.
    """
    counts = materialize(counts, "term_counts")
    shared = counts.groupBy((-F.col("count")).cast("double").alias("order")).agg(F.count(F.lit(1)).alias("n"))
    ahead = running_totals(materialize(shared, "terms_per_count"), "order", ["n"])
    found = ahead.filter(F.col("before_n") < size).agg(F.max_by(F.struct("order", "before_n", "n"), "order")).first()[0]
    if found is None:
        return counts
    last, wanted = int(-found["order"]), size - found["before_n"]
    ties = counts.filter(F.col("count") == last).select("term")
    if found["n"] <= wanted:
        return counts.filter(F.col("count") >= last)
    within = F.col("term") <= _smallest_cut(ties, wanted, found["n"], sorted_ties)
    return counts.filter((F.col("count") > last) | ((F.col("count") == last) & within))


def _smallest_cut(terms: DataFrame, wanted: int, number: int, sorted_terms: int) -> str:
    """The ``wanted``-th smallest of ``number`` distinct terms.

    Counts by first character show in which group it lies; that group is cut by
    its next character, until it is small enough to be sorted.
    """
    prefix = ""
    while number > sorted_terms:
        start = F.substring("term", 1, len(prefix) + 1)
        groups = terms.filter(F.startswith("term", F.lit(prefix))).groupBy(start.alias("start")).count()
        for row in sorted(groups.collect()):  # a row per character of the alphabet
            if wanted <= row["count"]:
                break
            wanted -= row["count"]
        if row["start"] == prefix:
            return prefix
        prefix, number = row["start"], row["count"]
    rest = terms.filter(F.startswith("term", F.lit(prefix))).orderBy("term").limit(wanted)
    return rest.agg(F.max("term")).first()[0]


def vectorizer_from_vocab(vocab: DataFrame, input_col: str = "filtered_words", output_col: str = "features") -> CountVectorizerModel:
    """Vector form of the vocabulary; the model keeps its terms, at most ``vocabSize``, on the driver."""
    rows = vocab.orderBy(F.desc("count"), F.asc("term")).collect()
    return CountVectorizerModel.from_vocabulary([r["term"] for r in rows], inputCol=input_col, outputCol=output_col)


def term_frequencies(
    docs: DataFrame, vocab: DataFrame, key: str = "doc_id", words_col: str = "filtered_words"
) -> DataFrame:
    """Occurrences of each vocabulary term per document; ``vocab`` should be a written table.

    Where the vocabulary is small enough to be sent, other words are dropped before
    anything is shuffled.
    """
    words, terms = docs.select(key, F.explode(words_col).alias("term")), vocab.select("term")
    small = data_bytes(terms) <= BROADCAST_BYTES
    if small:
        words = words.join(F.broadcast(terms), "term", "left_semi")
    counted = words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")).select("term", key, "tf")
    return counted if small else lookup_join(counted, terms, "term", "inner")


def hashing_tf(
    docs: DataFrame,
    words_col: str = "filtered_words",
    output_col: str = "RawFeatures",
    num_features: int = HASHING_FEATURES,
) -> DataFrame:
    return HashingTF(inputCol=words_col, outputCol=output_col, numFeatures=num_features).transform(docs)


def sparse_slots(vector_col: str) -> Column:
    """Size, indices and values of a sparse vector column, without the zeros a dense array would hold."""
    kind = f"{vector_col} struct<type: int, size: int, indices: array<int>, values: array<double>>"
    return F.from_json(F.to_json(F.struct(vector_col)), kind)[vector_col]


def idf_weights(docs: DataFrame, words_col: str = "filtered_words", vocab: DataFrame | None = None) -> DataFrame:
    """Documents per term and ``ln((m + 1) / (df + 1))``, of the terms of ``vocab`` if it is given.

    Words are made distinct within their row, so no distinct count is needed.
    Each document adds one null term, whose count is ``m``, and the counts are
    written: the texts are read once for both.
    """
    marked = F.array_append(F.array_distinct(words_col), F.lit(None).cast("string"))
    per_term = docs.select(F.explode(marked).alias("term")).groupBy("term")
    counted = materialize(per_term.agg(F.count(F.lit(1)).alias("df")), "document_frequencies")
    documents = counted.filter(F.col("term").isNull()).select("df").scalar()
    terms = counted.filter(F.col("term").isNotNull())
    if vocab is not None:
        terms = lookup_join(terms, vocab.select("term"), "term", "inner")
    return terms.withColumn("idf", F.ln((documents + 1) / (F.col("df") + 1)))


def tfidf_weights(term_counts: DataFrame, idf: DataFrame) -> DataFrame:
    """Weight of each term in each document."""
    weighted = lookup_join(term_counts, idf.select("term", "idf"), "term", "inner")
    return weighted.withColumn("tfidf", F.col("tf") * F.col("idf"))

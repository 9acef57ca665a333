import math

import pytest
from pyspark.ml.feature import IDF, CountVectorizer, StopWordsRemover, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tonewatch.catalog import fixtures as fx
from tonewatch.constants import ENGLISH_STOP_WORDS
from tonewatch.operators import annotate, features
from tonewatch.operators.lookup import lookup_join
from tonewatch.session import materialize


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return fx.document_tokens(spark, sf_dir).select("doc_id", "filtered_words").cache()


def test_words_equal_the_ml_stages(spark):
    texts = ["The cat  sat\ton", " lead", "trail \n ", "", "   ", "İK Don't THE", "a\x0bb\xa0c", "one"]
    rows = spark.createDataFrame([(t,) for t in texts], "Text string")
    stops = list(ENGLISH_STOP_WORDS)
    expected = StopWordsRemover(inputCol="words", outputCol="kept", stopWords=stops).transform(
        Tokenizer(inputCol="Text", outputCol="words").transform(rows)
    )
    ours = features.stopwords_remover(features.tokenize(rows), output_col="kept")
    assert ours.select("words", "kept").collect() == expected.select("words", "kept").collect()


def test_vocabulary_and_counts_equal_the_ml_vectorizer(docs):
    vocab = features.count_vectorizer_vocab(docs, size=50).cache()
    fitted = CountVectorizer(inputCol="filtered_words", outputCol="f", vocabSize=50).fit(docs)
    ours = {r["term"]: r["count"] for r in vocab.collect()}
    assert len(set(fitted.vocabulary) - set(ours)) <= 1  # equal counts at the cut may differ
    vectors = features.vectorizer_from_vocab(vocab).transform(docs)
    total = {r["doc_id"]: sum(r["a"]) for r in vectors.select("doc_id", vector_to_array("features").alias("a")).collect()}
    relational = features.term_frequencies(docs, vocab).groupBy("doc_id").agg(F.sum("tf").alias("n"))
    for r in relational.collect():
        assert r["n"] == total[r["doc_id"]]


@pytest.mark.parametrize("size", [1, 40, 5000])
def test_vocabulary_found_by_its_last_count_is_the_same(docs, size):
    counts = docs.select(F.explode("filtered_words").alias("term")).groupBy("term").count().cache()
    expected = sorted(counts.collect(), key=lambda r: (-r["count"], r["term"]))[:size]
    for sorted_ties in (50_000, 3):
        found = features.top_terms(counts, size, sorted_ties).collect()
        assert sorted(found, key=lambda r: (-r["count"], r["term"])) == expected


def test_idf_equals_the_ml_estimator(docs):
    weights = {r["term"]: r["idf"] for r in features.idf_weights(docs).collect()}
    counted = CountVectorizer(inputCol="filtered_words", outputCol="tf").fit(docs)
    model = IDF(inputCol="tf", outputCol="w").fit(counted.transform(docs))
    for term, idf in list(zip(counted.vocabulary, model.idf.toArray()))[::50]:
        assert weights[term] == pytest.approx(idf, abs=1e-12)


def test_lemmas_keep_order_and_unknown_words(spark):
    docs = spark.createDataFrame([(1, ["cats", "ran", "cats"]), (2, []), (3, ["ran"])], "doc_id int, words array<string>")
    table = spark.createDataFrame([("cats", "cat")], "form string, lemma string")
    got = {r["doc_id"]: r["lemmas"] for r in annotate.lemmatize(docs, table).collect()}
    assert got == {1: ["cat", "ran", "cat"], 2: [], 3: ["ran"]}


def test_token_vectors_and_pooling(spark):
    tokens = spark.createDataFrame([(1, "a"), (1, "b"), (1, "zz"), (2, "a")], "doc_id int, term string")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "term string, vector array<float>")
    embedded = annotate.token_embeddings(tokens, vectors)
    assert {(r["term"], r["known"], tuple(r["vector"])) for r in embedded.collect()} == {
        ("a", True, (1.0, 2.0)), ("b", True, (3.0, 4.0)), ("zz", False, (0.0, 0.0))
    }
    known = embedded.filter("known")
    average = {r["doc_id"]: r["embedding"] for r in annotate.sentence_embedding(known).collect()}
    total = {r["doc_id"]: r["embedding"] for r in annotate.sentence_embedding(known, strategy="SUM").collect()}
    assert average == {1: [2.0, 3.0], 2: [1.0, 2.0]}
    assert total == {1: [4.0, 6.0], 2: [1.0, 2.0]}


@pytest.mark.parametrize("strategy", ["AVERAGE", "SUM"])
def test_counted_tokens_pool_like_single_ones(spark, strategy):
    single = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [4.0, 0.0]), (2, [3.0, 3.0])], "doc_id int, vector array<double>")
    counted = single.groupBy("doc_id", "vector").agg(F.count("*").alias("n"))
    pooled = [
        {r["doc_id"]: r["embedding"] for r in annotate.sentence_embedding(df, strategy=strategy, times_col=times).collect()}
        for df, times in ((single, None), (counted, "n"))
    ]
    assert pooled[0].keys() == pooled[1].keys()
    assert all(pooled[0][k] == pytest.approx(pooled[1][k]) for k in pooled[0])


def test_weights_need_no_shuffle_of_counts_by_term(spark, monkeypatch):
    rows = [(i, ["a", "b", "b", f"w{i}"] if i else ["a", "c"]) for i in range(40)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, filtered_words array<string>"), "docs")
    vocab = materialize(features.count_vectorizer_vocab(docs, size=2), "vocab")
    monkeypatch.setattr(features.lookup_join, "__defaults__", ("left", 600, 1_000_000, False))  # all terms are too many to send
    monkeypatch.setattr(features, "BROADCAST_BYTES", 600)
    weights = features.tfidf_weights(features.term_frequencies(docs, vocab), features.idf_weights(docs, vocab=vocab))
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    found = {(r["doc_id"], r["term"]): (r["tf"], round(r["tfidf"], 9)) for r in weights.collect()}
    idf = {"a": math.log(41 / 41), "b": math.log(41 / 40)}
    expected = {(i, t): (n, round(n * idf[t], 9)) for i in range(40) for t, n in (("a", 1), ("b", 2)) if t == "a" or i}
    assert found == expected
    every = {r["term"] for r in features.idf_weights(docs).collect()}
    assert len(every) == 42
    monkeypatch.setattr(features, "BROADCAST_BYTES", 0)
    again = features.term_frequencies(docs, vocab).collect()
    assert {(r["doc_id"], r["term"]): r["tf"] for r in again} == {k: n for k, (n, _) in expected.items()}


def test_a_large_lookup_evaluates_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = spark.sparkContext.parallelize([(i, i % 7 if i % 5 else None) for i in range(100)], 2)
    counted = spark.createDataFrame(rows.map(lambda r: (seen.add(1), r)[1]), "id long, k long")
    table = materialize(spark.range(6).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x")), "table")
    found = lookup_join(counted, table, "k", max_broadcast_bytes=0, rows_per_task=5)
    expected = {(i, k, k * 10 if k is not None and k < 6 else None) for i in range(100) for k in [i % 7 if i % 5 else None]}
    assert {(r["id"], r["k"], r["x"]) for r in found.collect()} == expected
    assert seen.value == 100

"""Tables the registered queries start from: derived by Spark from the given ones, never stored.

Each has its SQL twin in ``fixtures_sql``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket, unit_hash
from ..functions.labels import encode_label
from ..functions.text import whitespace_tokens
from ..operators.cleaning import clean_text_column, filter_nonempty_length
from ..operators.features import feature_tokens
from ..operators.quality import evaluate
from ..operators.splits import fold_of
from ..sources.tables import read_table

# (trial, seed, hit rate): two equal trials, and one that never hits.
CV_TRIALS = ((1, 11, 0.5), (2, 12, 0.65), (3, 12, 0.65), (4, 13, 0.0))

# Endings appended to texts so that every cleaning step has something to do.
NOISE = (
    "Hi🙂 http://a.b/c🙂d e",
    "@Bob #Tag9 don't <UNK> <unk> 12",
    "a\x0bb\tc d ☕ÀB",
    "x.com/y site.comfort www.z.org youtu.be/q",
    "#été fin",
    "中文 abc 한글",
    "ht🙂tp://joined.example/x the end",
)

SUFFIXES = ("ing", "ed", "es", "s")


def table(spark: SparkSession, sf_dir: str, name: str, spread_by: str | None = None) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", spread_by)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, for work on their texts."""
    return table(spark, sf_dir, "documents", spread_by="doc_id")


def labeled_text(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    documents = table(spark, sf_dir, "documents") if documents is None else documents
    marks = table(spark, sf_dir, "labels")
    name = (
        F.when(F.col("toxic") == 1, "Negative").when(F.col("quality") == 1, "Positive").otherwise("Neutral")
    )
    return documents.join(marks, "doc_id").select(
        "doc_id", F.col("source").alias("Product"), name.alias("Label"), F.col("text").alias("Text"), "lang", "n_chars"
    )


def labeled_text_dirty(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    u_label, u_text = unit_hash(1, F.col("doc_id")), unit_hash(2, F.col("doc_id"))
    return labeled_text(spark, sf_dir, documents).withColumns({
        "Label": F.when(u_label < 0.05, "Irrelevant").when(u_label < 0.08, "Other")
        .when(u_label < 0.10, "").otherwise(F.col("Label")),
        "Text": F.when(u_text < 0.03, F.lit(None).cast("string")).when(u_text < 0.05, "   ")
        .otherwise(F.col("Text")),
    })


def noisy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; most of them end in one of the ``NOISE`` strings."""
    pick = F.floor(unit_hash(9, F.col("doc_id")) * (len(NOISE) + 1))
    ending = F.lit("")
    for i, noise in enumerate(NOISE):
        ending = F.when(pick == i, F.lit(noise)).otherwise(ending)
    documents = texts(spark, sf_dir)
    return documents.select("doc_id", F.concat("text", F.lit(" "), ending).alias("Text"))


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = texts(spark, sf_dir).select("doc_id", F.col("text").alias("Text"))
    return filter_nonempty_length(clean_text_column(documents))


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_tokens(clean_documents(spark, sf_dir))


def clean_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labeled_text(spark, sf_dir, texts(spark, sf_dir)).select("doc_id", "lang", "Label", "Text")
    rows = rows.withColumn("Label", encode_label(F.col("Label")))
    return filter_nonempty_length(clean_text_column(rows))


def wrong_above(seed: int, rate: float, label: Column) -> Column:
    return F.when(unit_hash(seed, F.col("doc_id")) < rate, label).otherwise((label + 1) % 3)


def predictions(spark: SparkSession, sf_dir: str, seed: int = 3, rate: float = 0.8) -> DataFrame:
    label = encode_label(F.col("Label"))
    rows = labeled_text(spark, sf_dir).withColumn("label", label)
    u = unit_hash(6, F.col("doc_id"))
    return rows.select(
        "doc_id", "Product", "lang", "n_chars", F.col("Text").alias("text"), "label",
        wrong_above(seed, rate, F.col("label")).alias("prediction"),
        (F.lit(0.34) + F.lit(0.66) * u).alias("confidence"),
    )


def predictions_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir, seed=4, rate=0.65)


def even_batches(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two random halves: nothing has drifted."""
    first = unit_hash(5, F.col("doc_id")) < 0.5
    return df.filter(first), df.filter(~first)


def shifted_batches(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """English rows against all others, whose confidence is squared down."""
    lower = df.withColumn("confidence", F.col("confidence") * F.col("confidence"))
    return df.filter("lang = 'en'"), lower.filter("lang <> 'en'")


def event_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    half = events.agg(F.count(F.lit(1)) / 2).scalar()
    return events.filter(F.col("event_id") < half), events.filter(F.col("event_id") >= half)


def cv_trials(spark: SparkSession, sf_dir: str, folds: int = 3) -> DataFrame:
    """Quality per trial and fold of simulated classifiers on the labelled rows."""
    rows = predictions(spark, sf_dir).select("doc_id", "label")
    rows = rows.withColumn("fold", fold_of(F.col("doc_id"), folds))
    guesses = F.array(*[
        F.struct(F.lit(trial).alias("trial"), wrong_above(seed, rate, F.col("label")).alias("prediction"))
        for trial, seed, rate in CV_TRIALS
    ])
    return evaluate(rows.select("fold", "label", F.inline(guesses)), by=["trial", "fold"])


def _score(seed: int) -> Column:
    return F.concat(F.lit("0."), F.lpad(F.floor(unit_hash(seed, F.col("doc_id")) * 10000).cast("string"), 4, "0"))


def annotation_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One printed annotation per document, in thirteen well- and ill-formed variants."""
    a, b, c = _score(21), _score(22), _score(23)
    pick = F.floor(unit_hash(20, F.col("doc_id")) * 13)
    forms = (
        F.concat(F.lit("[Row(annotatorType='category', result='1', metadata={'0': '"), a, F.lit("', '1': '"), b,
                 F.lit("', 'sentence': '7', '2': '"), c, F.lit("'}, embeddings=[])]")),
        F.lit(""),
        F.lit(None).cast("string"),
        F.lit("no meta"),
        F.lit("metadata={'sentence': '0'}"),
        F.concat(F.lit("metadata={'0': '"), a, F.lit("', '1': '"), b, F.lit("'")),
        F.concat(F.lit("metadata={'0': '"), a, F.lit("'} metadata={'0': '0.99'}")),
        F.concat(F.lit("metadata={'0': "), a, F.lit(", '1': "), b, F.lit("}")),
        F.concat(F.lit("metadata={'0': 'abc', '1': '"), b, F.lit("'}")),
        F.concat(F.lit('metadata={"0": "'), c, F.lit('"}')),
        F.concat(F.lit("metadata= {'0': '"), a, F.lit("'}")),
        F.concat(F.lit("metadata={'0': '"), a, F.lit("', 'more': {'1': '0.99'}, '2': '"), b, F.lit("'}")),
        F.concat(F.lit("metadata={'0': '"), a, F.lit("d', '1': '"), c, F.lit("'}")),
    )
    text = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        text = F.when(pick == i, form).otherwise(text)
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("category"))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows with real nested annotations and embeddings."""
    scores = F.create_map(
        F.lit("0"), _score(21), F.lit("1"), _score(22), F.lit("2"), _score(23), F.lit("sentence"), F.lit("0")
    )
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    none = F.array().cast("array<float>")

    def annotation(kind: str, result: Column, embedding: Column) -> Column:
        return F.array(F.struct(
            F.lit(kind).alias("annotatorType"),
            F.lit(0).alias("begin"),
            (F.length("text") - 1).alias("end"),
            result.alias("result"),
            scores.alias("metadata"),
            embedding.alias("embeddings"),
        ))

    rows = predictions(spark, sf_dir).join(vectors, "doc_id", "left")
    return rows.select(
        "doc_id", "text", F.col("label").cast("double").alias("label"), F.col("prediction").cast("double").alias("prediction"),
        annotation("sentence_embeddings", F.col("text"), F.coalesce("embedding", none)).alias("sentence_embeddings"),
        annotation("category", F.col("prediction").cast("string"), none).alias("category"),
    )


def lemma_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(form, lemma)``: words of the benchmark texts with a common English ending cut off."""
    words = clean_text_column(table(spark, sf_dir, "benchmark").withColumnRenamed("text", "Text"))
    forms = words.select(F.explode(whitespace_tokens(F.col("Text"))).alias("form")).distinct()
    lemma = F.lit(None).cast("string")
    for suffix in reversed(SUFFIXES):
        stem = F.col("form").substr(F.lit(1), F.length("form") - len(suffix))
        ends = F.col("form").endswith(suffix) & (F.length("form") >= len(suffix) + 3)
        lemma = F.when(ends, stem).otherwise(lemma)
    return forms.withColumn("lemma", lemma).filter(F.col("lemma").isNotNull())


def hashed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token rows ``(doc_id, pos, bucket)``; the bucket is the term's row in the vector table.

    One bucket in nine points past the end of the table, to have unknown tokens.
    """
    vectors = table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1))).scalar()
    slots = vectors + F.floor(vectors / 8)
    words = clean_documents(spark, sf_dir).select("doc_id", F.posexplode(whitespace_tokens(F.col("Text"))).alias("pos", "term"))
    return words.select("doc_id", "pos", hash_bucket(F.col("term"), slots).alias("bucket"))


def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("bucket"), F.col("embedding").alias("vector"))


def model_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version per event: the user is the model, the event type its stage, the value its accuracy."""
    events = table(spark, sf_dir, "events")
    kind, value = F.col("event_type"), F.col("value")
    return events.select(
        F.concat(F.lit("model_"), F.col("user_id").cast("string")).alias("name"),
        F.col("event_id").alias("version"),
        F.when(kind == "purchase", "Production").when(kind == "view", "Staging").when(kind == "click", "Archived").alias("stage"),
        F.md5(F.col("event_id").cast("string")).alias("run_id"),
        F.col("ts").alias("last_updated_timestamp"),
        F.when(kind != "error", value / (value + 2)).alias("accuracy"),
        F.create_map(F.lit("kind"), kind).alias("tags"),
    )


def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model name per customer; most of them have no version."""
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("model_"), F.col("c_custkey").cast("string")).alias("name"))


def object_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version per event of the object ``u<user>/<event type>.csv``; low values delete it."""
    events = table(spark, sf_dir, "events")
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"), F.lit(".csv"))
    last = events.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))
    flagged = events.select("event_id", key.alias("key"), "value").join(
        last.select("event_id", F.lit(True).alias("is_latest")), "event_id", "left"
    )
    return flagged.select(
        F.lit("data").alias("bucket"), "key",
        F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("version_id"),
        F.coalesce("is_latest", F.lit(False)).alias("is_latest"),
        (F.col("value") < 5).alias("is_delete_marker"),
    )


def object_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A requested path per customer, under supported and unsupported schemes."""
    custkey = F.col("c_custkey")
    u = unit_hash(31, custkey)
    scheme = F.when(u < 0.3, "s3").when(u < 0.6, "s3a").when(u < 0.8, "s3n").otherwise("https")
    ending = F.when(u < 0.5, "click.csv").when(u < 0.9, "view.csv").otherwise("view.csv.bak")
    path = F.concat(scheme, F.lit("://data/u"), custkey.cast("string"), F.lit("/"), ending)
    return table(spark, sf_dir, "customer").select("c_custkey", path.alias("path"))

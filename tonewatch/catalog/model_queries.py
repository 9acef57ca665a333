"""Training, tuning and scoring on the labelled texts.  Model fits have no SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import (
    GRID_NUM_FEATURES,
    GRID_REG_PARAM,
    GRID_VOCAB_SIZE,
    NETWORK_EPOCHS,
    SMOKE_SAMPLES,
    SPLIT_SEED,
    TRAIN_RATIO,
)
from ..functions.text import whitespace_tokens
from ..operators import annotate, network, quality, splits
from ..plans import halving, scoring, training
from ..session import materialize, scratch_path
from . import fixtures as fx
from . import fixtures_sql as sql
from .registry import query

CLASSES = 3
FOLDS = 5

CLEAN = "WITH " + sql.LABELED + ", clean AS (SELECT * FROM (" + sql.clean_select(
    "labeled", "body", "doc_id") + ") WHERE length(text) > 0), " + (
    f"validate AS (SELECT * FROM clean WHERE {sql.u(SPLIT_SEED)} >= {TRAIN_RATIO})"
)


def _train_validate(spark, d):
    clean = materialize(fx.clean_labeled(spark, d).select("doc_id", "Label", "Text"), "clean")
    return splits.split_train_validate(clean, "doc_id")


def _quality(model, validate, label="Label"):
    scored = model.transform(validate).select(F.col(label).alias("label"), F.col("prediction").cast("int"))
    return quality.evaluate(scored)


@query("train_logreg_count")
def train_logreg_count(spark, d):
    train, validate = _train_validate(spark, d)
    return _quality(training.train_logreg(train, use_hashing=False), validate)


@query("train_logreg_tfidf")
def train_logreg_tfidf(spark, d):
    train, validate = _train_validate(spark, d)
    return _quality(training.train_logreg(train, use_hashing=True), validate)


@query("score_batch", CLEAN + """
SELECT md5(text) AS text_md5, 3::INT AS classes, true AS is_most_likely FROM (SELECT text FROM validate UNION ALL SELECT * FROM (VALUES """
       + ", ".join(f"({sql.quoted(t)})" for t, _ in SMOKE_SAMPLES) + "))")
def score_batch(spark, d):
    train, validate = _train_validate(spark, d)
    model = training.train_logreg(train, use_hashing=True)
    batch = validate.select("Text").unionByName(scoring.smoke_samples(spark).select("Text"))
    scored = scoring.score_batch(model, batch)
    most = F.array_max("probabilities")
    fits = (F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p) - 1) < 1e-9) & (F.col("confidence") == most)
    return scored.select(
        F.md5("Text").alias("text_md5"), F.size("probabilities").alias("classes"),
        (fits & (F.get("probabilities", F.col("prediction")) == most)).alias("is_most_likely"),
    )


@query("model_roundtrip", CLEAN + """
SELECT count(*) AS "rows", 0::BIGINT AS different FROM validate""")
def model_roundtrip(spark, d):
    train, validate = _train_validate(spark, d)
    model = training.train_logreg(train, use_hashing=True)
    path = scratch_path(spark, "model")
    training.save_model(model, path)
    before, after = (
        scoring.score_batch(m, validate).select("doc_id", "prediction") for m in (model, training.load_model(path))
    )
    return before.join(after.withColumnRenamed("prediction", "loaded"), "doc_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("prediction") != F.col("loaded")).alias("different"),
    )


@query("score_and_gate", "WITH " + sql.DIRTY + ", cleaned AS (SELECT * FROM (" + sql.clean_select(
    "(SELECT * FROM dirty WHERE name <> 'Irrelevant')", "body", "doc_id") + """) WHERE length(text) > 0)
SELECT count(*) AS scored, count(*) AS predictions, count(*) AS snapshot, true AS gate_fits FROM cleaned""")
def score_and_gate(spark, d):
    train, _ = _train_validate(spark, d)
    model = training.train_logreg(train, use_hashing=True)
    raw = fx.labeled_text_dirty(spark, d).select("doc_id", "Label", "Text")
    predictions, snapshots = scratch_path(spark, "predictions"), scratch_path(spark, "snapshots")
    result = scoring.score_and_gate(model, raw, predictions, snapshots, batch_id="b1")
    written = [spark.read.parquet(p).count() for p in (predictions, snapshots)]
    return result.select(
        "scored", F.lit(written[0]).cast("long").alias("predictions"), F.lit(written[1]).cast("long").alias("snapshot"),
        (F.col("test_pass") == (F.col("accuracy") > 0.8)).alias("gate_fits"),
    )


class KnownScores:
    """A fit that learns nothing: it is right on the rows whose hash is small, so its figures are known."""

    def fit(self, rows):
        return self

    def transform(self, rows):
        return rows.withColumn("prediction", fx.wrong_above(31, 0.7, F.col("Label")))


@query("kfold_cross_validate", CLEAN + ", known AS (SELECT floor(" + sql.u(SPLIT_SEED) + f""" * {FOLDS})::INT AS fold, label,
  CASE WHEN {sql.u(31)} < 0.7 THEN label ELSE (label + 1) % 3 END AS prediction
  FROM (SELECT c.doc_id, {sql.ENCODE} AS label FROM clean c JOIN labeled USING (doc_id))),
""" + sql.evaluation("known", by="fold") + """
SELECT fold, (SELECT count(*) FROM known k WHERE k.fold = ev.fold) AS scored, round(accuracy, 9) AS accuracy, round("precision", 9) AS "precision",
  round(recall, 9) AS recall, round(f1, 9) AS f1 FROM ev""")
def kfold_cross_validate(spark, d):
    """Rows that fitted models scored, and the figures of known scores on the same way."""
    folds = training.tokenized_folds(fx.clean_labeled(spark, d), "doc_id", k=FOLDS)
    estimator = training.Pipeline(stages=training.learned_stages(True))
    fitted = training.k_fold_cross_validate(folds, estimator, k=FOLDS).select("fold", "scored")
    known = training.k_fold_cross_validate(folds, KnownScores(), k=FOLDS).drop("scored")
    figures = [F.round(m, 9).alias(m) for m in quality.METRICS]
    return fitted.join(known, "fold").select("fold", "scored", *figures)


@query("kfold_model_figures")
def kfold_model_figures(spark, d):
    """Quality of the fitted models, fold by fold."""
    folds = training.tokenized_folds(fx.clean_labeled(spark, d), "doc_id", k=FOLDS)
    return training.k_fold_cross_validate(folds, training.Pipeline(stages=training.learned_stages(True)), k=FOLDS)


def _grid_sql(size_name, sizes):
    points = [(r, n) for r in GRID_REG_PARAM for n in sizes]
    return [", ".join(sorted((f"regParam={r}", f"{size_name}={n}"))) for r, n in points]


@query("grid_search_cv", CLEAN + "SELECT grid, params, (SELECT count(*) FROM clean) AS scored, true AS figures_in_range FROM (VALUES " + ", ".join(
    f"('{grid}', '{params}')"
    for grid, points in (("hashing", _grid_sql("numFeatures", GRID_NUM_FEATURES)), ("counts", _grid_sql("vocabSize", GRID_VOCAB_SIZE)))
    for params in points
) + ") AS t(grid, params)")
def grid_search_cv(spark, d):
    """Points of both grids with the rows their models scored and whether their mean F1 is one."""
    return _grids(spark, d).select("grid", "params", "scored", F.col("f1").between(0, 1).alias("figures_in_range"))


@query("grid_search_figures")
def grid_search_figures(spark, d):
    """Mean F1 over the folds of every point of both grids."""
    return _grids(spark, d)


def _grids(spark, d):
    folds = training.tokenized_folds(fx.clean_labeled(spark, d), "doc_id", k=3)
    hashing, counts = (
        training.grid_trials(training.grid_search(folds, use_hashing=hashing), folds)
        .withColumn("grid", F.lit("hashing" if hashing else "counts"))
        for hashing in (True, False)
    )
    return hashing.unionByName(counts)


def _sentence_vectors(spark, d):
    """``(doc_id, embedding, label)`` of the labelled texts, written, with the width of the vectors."""
    rows = materialize(fx.clean_labeled(spark, d).select("doc_id", "Label", "Text"), "clean")
    words = rows.select("doc_id", F.posexplode(whitespace_tokens(F.col("Text"))).alias("pos", "term"))
    vectors = fx.vector_table(spark, d)
    slots = vectors.agg(F.count(F.lit(1))).scalar()
    tokens = words.select("doc_id", fx.hash_bucket(F.col("term"), slots).alias("bucket"), F.lit(1).alias("n"))
    pooled = annotate.sentence_embedding(annotate.token_embeddings(tokens, vectors, on="bucket", pooled_by="doc_id", times_col="n"), times_col="n")
    labelled = pooled.join(rows.select("doc_id", F.col("Label").alias("label")), "doc_id")
    return materialize(labelled, "sentence_vectors"), vectors.select(F.size("vector").alias("dim")).first()["dim"]


@query("train_nn_classifier")
def train_nn_classifier(spark, d):
    labelled, dim = _sentence_vectors(spark, d)
    train, validate = splits.split_train_validate(labelled, "doc_id")
    model = training.train_nn_classifier(train, CLASSES, dim)
    features = validate.withColumn("features", training.array_to_vector(F.col("embedding")))
    return _quality(model, features, "label")


def _trained_network(spark, d):
    labelled, dim = _sentence_vectors(spark, d)
    train, validate = splits.split_train_validate(labelled, "doc_id")
    steps = network.dealt(train, "doc_id", "embedding", "label")
    state, log = network.train(steps, network.initial([dim, *network.HIDDEN, CLASSES]))
    return log, network.predict(validate, state, "embedding")


@query("train_network", CLEAN + f"""
SELECT epoch, (SELECT count(*) FROM clean WHERE {sql.u(SPLIT_SEED)} < {TRAIN_RATIO}) AS "rows", (SELECT count(*) FROM validate) AS scored,
  true AS chances_add_up FROM (SELECT unnest(range(1, {NETWORK_EPOCHS} + 1))::INT AS epoch)""")
def train_network(spark, d):
    """Rows that each epoch's gradients came from, and rows the network scored, as its tasks counted them."""
    log, scored = _trained_network(spark, d)
    one = F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p)
    fits = (F.abs(one - 1) < 1e-9) & (F.get("probabilities", F.col("prediction")) == F.array_max("probabilities"))
    counts = scored.agg(F.count("prediction").alias("scored"), F.every(fits).alias("fits"))
    return log.select("epoch", "rows", counts.select("scored").scalar().alias("scored"), counts.select("fits").scalar().alias("chances_add_up"))


@query("train_network_quality")
def train_network_quality(spark, d):
    """Quality of the network on the validation rows."""
    return quality.evaluate(_trained_network(spark, d)[1].select("label", "prediction"))


def _network_grid(spark, d):
    labelled, dim = _sentence_vectors(spark, d)
    train, validate = splits.split_train_validate(labelled, "doc_id")
    return halving.network_grid(train, validate, [dim, *network.HIDDEN, CLASSES], "doc_id", "embedding")


@query("network_grid", CLEAN + """
SELECT rung, trials, epochs, trials * (SELECT count(*) FROM validate) AS scored, 1::BIGINT AS kept FROM (VALUES (1, 2::BIGINT, 2), (2, 1::BIGINT, 5)) AS t(rung, trials, epochs)""")
def network_grid(spark, d):
    """Rungs of the search: trials, epochs they have had, rows they were scored on, trials that went on."""
    return _network_grid(spark, d).groupBy("rung").agg(
        F.count("*").alias("trials"), F.max("epochs").alias("epochs"), F.sum("scored").alias("scored"),
        F.count_if("kept").alias("kept"),
    )


@query("network_grid_figures")
def network_grid_figures(spark, d):
    """The trial table with its quality figures."""
    return _network_grid(spark, d).drop("state")

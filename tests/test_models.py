import pytest
from pyspark.ml.feature import HashingTF
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Observation
from pyspark.ml import Transformer
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tonewatch.catalog import fixtures as fx
from tonewatch.constants import SMOKE_SAMPLES
from tonewatch.functions.confidence import max_confidence_text
from tonewatch.operators.cleaning import clean_text_column
from tonewatch.operators import drift, splits
from tonewatch.plans import reports, scoring, training
from tonewatch.session import materialize, scratch_path


@pytest.fixture(scope="module")
def clean(spark):
    rows = fx.clean_labeled(spark, "/root/testdata/sf0.01").select("doc_id", "Label", "Text")
    return materialize(rows, "clean")


def test_trained_model_beats_the_majority_class(spark):
    quality = driver.queries()["train_logreg_count"](spark, "/root/testdata/sf0.01").first()
    assert quality["f1"] > 0.698


def test_saved_model_predicts_the_same(spark):
    row = driver.queries()["model_roundtrip"](spark, "/root/testdata/sf0.01").first()
    assert row["rows"] > 0 and row["different"] == 0


def test_scored_batch_has_probabilities(spark, clean):
    model = training.train_logreg(clean, use_hashing=True, num_features=500)
    rows = scoring.score_batch(model, scoring.smoke_samples(spark)).collect()
    assert len(rows) == len(SMOKE_SAMPLES)
    for r in rows:
        assert sum(r["probabilities"]) == pytest.approx(1)
        assert r["confidence"] == max(r["probabilities"])
        assert r["probabilities"].index(r["confidence"]) == r["prediction"]
        assert r["sentiment"] == ["Negative", "Positive", "Neutral"][r["prediction"]]


def test_folds_are_scored_by_models_that_never_saw_them(spark, clean):
    folds = training.tokenized_folds(clean, "doc_id", k=2)
    estimator = training.Pipeline(stages=training.learned_stages(True, num_features=200))
    rows = training.k_fold_cross_validate(folds, estimator, k=2).collect()
    assert sorted(r["fold"] for r in rows) == [0, 1]
    assert all(0 < r["accuracy"] <= 1 for r in rows)


def test_text_drift_is_seen_where_there_is_some(spark):
    rows = {r["batches"]: r["value"] for r in driver.queries()["text_content_drift"](spark, "/root/testdata/sf0.01").collect()}
    assert rows["shifted"] > 0.9
    assert 0.35 < rows["even"] < 0.65


def test_texts_of_two_comparisons_are_hashed_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(drift, "HashingTF", lambda **names: made.append(names) or HashingTF(**names))
    assert driver.queries()["text_content_drift"](spark, "/root/testdata/sf0.001").count() == 2
    assert len(made) == 1


def test_drift_by_vectors_is_that_by_texts(spark):
    text = F.when(F.col("id") % 9 > 0, F.concat_ws(" ", F.lit("the"), F.col("id") % 5, F.col("id") % 7 + F.col("id") % 2))
    rows = materialize(spark.range(300).select(
        F.col("id").alias("doc_id"), text.alias("text"), (F.col("id") % 2).alias("words")
    ), "rows")
    hashed = drift.text_vectors(rows.unionByName(rows))
    assert hashed.columns == ["doc_id", "words", "text_vector"]
    assert hashed.count() == 2 * rows.filter("text IS NOT NULL").count()
    sides = [[df.filter(f"words = {i}") for i in (0, 1)] for df in (rows.unionByName(rows), hashed)]
    by_text = drift.text_content_drift(*sides[0]).first().asDict()
    by_vector = drift.text_content_drift(*sides[1], vector_col="text_vector").first().asDict()
    assert 0.5 < by_text["value"] and by_vector == pytest.approx(by_text)


def test_models_of_two_classes_score_after_an_observation(spark):
    seen = Observation("seen")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    word = F.when(F.col("id") % 2 == 0, "good").otherwise("bad")
    rows = materialize(spark.range(200).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("one"), word).alias("Text"), (F.col("id") % 2).cast("int").alias("Label")
    ), "two")
    found = drift.text_content_drift(rows.filter("Label = 0"), rows.filter("Label = 1"), "Text").first()
    assert found["value"] == 1 and found["drifted"]
    scored = scoring.score_batch(training.train_logreg(rows, use_hashing=True, num_features=50), rows)
    assert scored.filter("prediction = Label").count() == 200
    folds = training.tokenized_folds(rows, "doc_id", k=2)
    estimator = training.Pipeline(stages=training.learned_stages(True, num_features=50))
    assert {r["f1"] for r in training.k_fold_cross_validate(folds, estimator, k=2).collect()} == {1.0}


def test_expressions_run_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("Hello @me World", "metadata={'0': '0.5'}")], "Text string, category string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = clean_text_column(stream).withColumn("confidence", max_confidence_text(F.col("category")))
    query = out.writeStream.format("memory").queryName("cleaned").option(
        "checkpointLocation", str(tmp_path / "cp")
    ).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [tuple(r) for r in spark.sql("select Text, confidence from cleaned").collect()] == [("hello world", 0.5)]


@pytest.fixture(scope="module")
def planted(spark):
    """Three classes that differ by one word in five; the classes are of one size."""
    signal = F.element_at(F.array(*map(F.lit, ("awful", "great", "plain"))), F.col("Label") + 1)
    noise = F.concat_ws(" ", *[F.concat(F.lit("w"), (F.xxhash64("doc_id", F.lit(i)) % 40).cast("string")) for i in range(4)])
    rows = spark.range(360).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("Label"))
    return materialize(rows.withColumn("Text", F.concat_ws(" ", noise, signal)), "planted")


@pytest.mark.parametrize("use_hashing", [True, False])
def test_classifiers_find_a_planted_signal(spark, planted, use_hashing):
    train, validate = splits.split_train_validate(planted, "doc_id")
    model = training.train_logreg(train, use_hashing=use_hashing)
    scored = scoring.score_batch(model, validate)
    assert scored.filter("prediction = Label").count() > 0.95 * validate.count()


def test_grid_search_prefers_what_finds_the_signal(spark, planted):
    folds = training.tokenized_folds(planted, "doc_id", k=2)
    search = training.grid_search(folds, True, k=2, num_features=(2, 5000), reg_params=(0.01,))
    scores = {r["params"]: r["f1"] for r in training.grid_trials(search, folds).collect()}
    assert len(scores) == 2 and scores["numFeatures=5000, regParam=0.01"] > 0.95 > scores["numFeatures=2, regParam=0.01"]


def test_grid_search_scores_as_cross_validation_does(spark, planted):
    folds = training.tokenized_folds(planted, "doc_id", k=2)
    stages = training.learned_stages(True, num_features=20)
    grid = ParamGridBuilder().addGrid(stages[-1].regParam, [0.0, 0.5]).addGrid(stages[0].numFeatures, [5, 20]).build()
    plain = CrossValidator(
        estimator=training.Pipeline(stages=stages), estimatorParamMaps=grid, numFolds=2, foldCol="fold",
        evaluator=training.MulticlassClassificationEvaluator(labelCol="Label", metricName="f1"),
    ).fit(folds)
    search = training.grid_search(folds, True, k=2, num_features=(5, 20), reg_params=(0.0, 0.5))
    expected = {tuple(sorted((p.name, v) for p, v in point.items())): f1 for point, f1 in zip(grid, plain.avgMetrics, strict=True)}
    found = {tuple(sorted(point.items())): f1 for point, f1 in zip(search.points, search.f1, strict=True)}
    assert set(found) == set(expected) and all(found[p] == pytest.approx(expected[p], abs=0.02) for p in found)
    assert search.scored == [360] * 4
    assert search.best.stages[-1].getRegParam() == search.points[search.f1.index(max(search.f1))]["regParam"]


def test_grid_search_vectorizes_once_for_all_regularizations(spark, planted, monkeypatch):
    folds, written = training.tokenized_folds(planted, "doc_id", k=2), []
    monkeypatch.setattr(training, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    search = training.grid_search(folds, False, k=2, vocab_sizes=(50,), reg_params=(0.0, 0.1, 0.5))
    assert written.count("grid_vectors") == 2 and written.count("grid_scores") == 6 and len(search.points) == 3


def test_grid_search_writes_hashed_words_once_for_all_folds(spark, planted, monkeypatch):
    folds, written = training.tokenized_folds(planted, "doc_id", k=2), []
    monkeypatch.setattr(training, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    search = training.grid_search(folds, True, k=2, num_features=(20, 30), reg_params=(0.1,))
    assert written.count("grid_vectors") == 2 and search.scored == [360, 360]


def test_grid_search_query_tells_whether_figures_are_in_range(spark, monkeypatch):
    from tonewatch.catalog import model_queries

    trials = spark.createDataFrame([("a", "p", 3, 0.5), ("a", "q", 3, 1.5), ("a", "r", 3, -0.1)], "grid string, params string, scored long, f1 double")
    monkeypatch.setattr(model_queries, "_grids", lambda spark, d: trials)
    rows = driver.queries()["grid_search_cv"](spark, "").collect()
    assert {r["params"]: r["figures_in_range"] for r in rows} == {"p": True, "q": False, "r": False}


def test_network_finds_a_planted_signal(spark, planted):
    vector = F.array(*[F.when(F.col("Label") == i, 1.0).otherwise(0.0) + F.rand(i) / 5 for i in range(3)])
    rows = materialize(planted.select("doc_id", F.col("Label").alias("label"), vector.alias("embedding")), "vectors")
    train, validate = splits.split_train_validate(rows, "doc_id")
    model = training.train_nn_classifier(train, 3, 3)
    scored = model.transform(validate.withColumn("features", training.array_to_vector(F.col("embedding"))))
    assert scored.filter("prediction = label").count() > 0.95 * validate.count()


def test_gate_judges_scored_rows_and_writes_them(spark, planted):
    model = training.train_logreg(planted, use_hashing=True)
    names = F.element_at(F.array(*map(F.lit, ("Negative", "Positive", "Neutral"))), F.col("Label") + 1)
    extra = spark.createDataFrame([(1000, "Irrelevant", "w1 great"), (1001, None, "w2 great"), (1002, "Neutral", " ")], "doc_id long, Label string, Text string")
    raw = planted.select("doc_id", names.alias("Label"), "Text").unionByName(extra)
    paths = [scratch_path(spark, n) for n in ("predictions", "snapshot")]
    row = scoring.score_and_gate(model, raw, *paths, batch_id="b").first()
    assert row["scored"] == 361 and row["accuracy"] > 0.95 and row["test_pass"]
    assert [spark.read.parquet(p).count() for p in paths] == [361, 361]
    assert scoring.score_and_gate(model, raw, *paths, batch_id="b", gate=1.0).first()["test_pass"] is False


def test_data_drift_report_fails_where_batches_differ(spark, sf_dir):
    tests = reports.data_drift_report(*fx.shifted_batches(fx.predictions(spark, sf_dir)), categorical=["prediction", "lang"])
    status = {r["test"]: r["status"] for r in tests.collect()}
    assert status["drift:lang"] == status["drift:text"] == status["dataset_drift"] == "FAIL"
    assert set(status) == {"drift:lang", "drift:text", "drift:prediction", "drift:confidence", "dataset_drift"}


def test_stages_that_learn_nothing_run_once_for_all_folds(spark):
    calls = []

    class Words(Transformer):
        def _transform(self, rows):
            calls.append(1)
            return rows.withColumn("filtered_words", F.split("Text", " "))

    rows = [(i, f"good w{i % 5}" if i % 2 else f"bad w{i % 7}", i % 2, i % 3) for i in range(60)]
    folds = spark.createDataFrame(rows, "doc_id long, Text string, Label int, fold int")
    learned = training.learned_stages(True, num_features=64)
    found = training.k_fold_cross_validate(folds, training.Pipeline(stages=[Words(), *learned]), k=3).orderBy("fold").collect()
    assert len(calls) == 1 and [(r["fold"], r["scored"], r["accuracy"]) for r in found] == [(i, 20, 1.0) for i in range(3)]
    again = training.k_fold_cross_validate(Words().transform(folds), training.Pipeline(stages=learned), k=3)
    assert again.orderBy("fold").collect() == found

import random

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from tonewatch.operators import checks, quality


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    # A third of all rows in one cell, and a class that is predicted but never labelled.
    rows = [(1.0, 1.0)] * 200 + [(float(rng.choice([0, 1, 2])), float(rng.choice([0, 1, 2, 3]))) for _ in range(400)]
    return spark.createDataFrame(rows, "label double, prediction double").repartition(5)


def test_metrics_equal_the_ml_evaluator(scored):
    ours = quality.evaluate(scored).first()
    for ours_name, theirs in (("accuracy", "accuracy"), ("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1", "f1")):
        evaluator = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName=theirs)
        assert ours[ours_name] == pytest.approx(evaluator.evaluate(scored), abs=1e-9)
    assert ours["accuracy"] == pytest.approx(ours["recall"], abs=1e-12)


def test_groups_are_scored_on_their_own(scored):
    both = scored.withColumn("g", F.lit("a")).unionByName(scored.withColumn("prediction", F.col("label")).withColumn("g", F.lit("b")))
    got = {r["g"]: r for r in quality.evaluate(both, by=["g"]).collect()}
    assert got["b"]["f1"] == 1.0
    assert got["a"]["f1"] == pytest.approx(quality.evaluate(scored).first()["f1"])


def test_label_distribution_sums_to_hundred(scored):
    rows = quality.label_distribution(scored, "label").collect()
    assert [r["label"] for r in rows] == sorted(r["label"] for r in rows)
    assert sum(r["percentage"] for r in rows) == pytest.approx(100)


def test_best_trial_is_the_first_of_equals_and_never_a_zero(spark):
    trials = spark.createDataFrame(
        [(1, 0.2), (1, 0.4), (2, 0.5), (2, 0.1), (3, 0.3), (3, 0.3)], "trial int, f1 double"
    ).select("trial", *[F.col("f1").alias(m) for m in quality.METRICS])
    assert quality.best_params(trials).first()["trial"] == 1
    assert quality.best_params(trials.withColumns({m: F.lit(0.0) for m in quality.METRICS})).count() == 0


def test_challenger_must_be_strictly_better(spark):
    rows = spark.createDataFrame([(0, 0, 0), (1, 1, 1), (2, 0, 0)], "label int, old int, new int")
    assert quality.champion_challenger(rows, "old", "new").first()["decision"] == "keep"
    better = rows.withColumn("new", F.col("label"))
    assert quality.champion_challenger(better, "old", "new").first()["decision"] == "promote"


def test_quality_gate_allows_ten_percent(spark):
    def batch(right):
        return spark.createDataFrame([(i % 2, i % 2 if i < right else 1 - i % 2) for i in range(100)], "label int, prediction int")

    status = {r["test"]: r["status"] for r in checks.model_quality_tests(batch(100), batch(90)).collect()}
    assert status["accuracy"] == "SUCCESS"
    assert checks.model_quality_tests(batch(100), batch(89)).filter("status = 'FAIL'").count() == 4


def test_failures_are_numbered_and_joined(spark):
    tests = spark.createDataFrame(
        [("r", "b", "FAIL", "low b"), ("r", "a", "FAIL", "low a"), ("r", "c", "SUCCESS", "fine"), ("s", "a", "SUCCESS", "fine")],
        "report string, test string, status string, description string",
    )
    block = checks.failure_block(tests).collect()
    assert [tuple(r) for r in block] == [("r", 2, "1. a  FAILED\nDescription: low a\n2. b  FAILED\nDescription: low b\n")]
    signal = {r["report"]: r for r in checks.retrain_signal(tests, F.lit("model_drift")).collect()}
    assert (signal["r"]["notify"], signal["r"]["request"]) == (True, "train")
    assert (signal["s"]["notify"], signal["s"]["request"]) == (False, None)
    quiet = {r["report"]: r["request"] for r in checks.retrain_signal(tests, F.lit("data_drift")).collect()}
    assert quiet == {"r": None, "s": None}


def test_accuracy_gate_is_strict(spark):
    rows = spark.createDataFrame([("0.8",), ("0.81",), (None,), ("n/a",)], "accuracy string")
    assert [r["test_pass"] for r in checks.pass_gate(rows).collect()] == [False, True, None, None]

"""Every registered query: its plan stays within Spark, and its rows equal the reference SQL."""

import re

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tonewatch.catalog import ORACLES, QUERIES
from tonewatch.catalog import fixtures as fx
from tonewatch.operators.cleaning import clean_text_column, preprocess

FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin", "collect_limit")


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_reference_sql(spark, con, sf_dir, name):
    df = driver.queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in FORBIDDEN if node in plan]
    assert differences(df, con, driver.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0


def test_names_are_registered_in_both_or_rows_only():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(QUERIES) - set(ORACLES) == {
        "train_logreg_count", "train_logreg_tfidf", "train_nn_classifier", "text_content_drift",
        # Figures of fitted models, beside queries with the exact parts.
        "data_drift_report_fitted", "grid_search_figures", "kfold_model_figures", "learned_sentence_embedding",
        "network_grid_figures", "train_network_quality",
    }


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_on_cleaned_text_runs_no_pattern_twice(spark, sf_dir):
    documents = fx.table(spark, sf_dir, "documents").withColumnRenamed("text", "Text")
    cleaned = plan_of(clean_text_column(documents)).count("regexp_replace")
    filtered = plan_of(clean_text_column(documents).filter("Text like 'a%'")).count("regexp_replace")
    assert cleaned == filtered == 5


@pytest.mark.parametrize("name", ["lemmatize", "token_embeddings"])
def test_words_meet_again_where_their_document_lies(spark, sf_dir, name):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    exchanges = []
    for size in (before, "20k"):  # one partition, or many
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        exchanges.append(plan_of(QUERIES[name](spark, sf_dir)).count("Exchange hashpartitioning(doc_id"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert exchanges[0] == exchanges[1] <= 2


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    raw = fx.table(spark, sf_dir, "documents").select(
        F.col("source").alias("Product"), F.col("lang").alias("Label"), F.col("text").alias("Text")
    )
    plan = plan_of(preprocess(raw))
    pushed = re.search(r"PushedFilters: (.*?), ReadSchema", plan).group(1)
    assert "IsNotNull(text)" in pushed and "In(lang, [" in pushed
    assert "ReadSchema: struct<text:string,lang:string>" in plan


def test_predictions_without_text_do_not_read_it(spark, sf_dir):
    plan = plan_of(driver.queries()["evaluate_all"](spark, sf_dir))
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert schemas == {"doc_id:bigint", "doc_id:bigint,quality:int,toxic:int"}


def test_total_reuses_the_counts(spark, sf_dir):
    df = driver.queries()["label_distribution"](spark, sf_dir)
    df.collect()
    assert "ReusedExchange" in plan_of(df)

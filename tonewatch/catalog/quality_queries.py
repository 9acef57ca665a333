"""Counts, distributions, classification quality, splits and the dataset profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import ALERT_TYPES
from ..operators import profile, quality, running, splits
from ..plans import reports
from . import fixtures as fx
from . import fixtures_sql as sql
from .dataset_queries import CODED, _coded, preprocess
from .registry import query

WITH = "WITH "


def _rounded(df, *columns):
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


@query("row_count", WITH + sql.PREPROCESSED + """
SELECT 'raw' AS stage, count(*) AS "rows" FROM dirty UNION ALL SELECT 'clean', count(*) FROM preprocessed""")
def row_count(spark, d):
    stages = {"raw": fx.labeled_text_dirty(spark, d), "clean": preprocess(spark, d)}
    counts = [df.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("rows")) for name, df in stages.items()]
    return counts[0].unionByName(counts[1])


DISTRIBUTION = WITH + sql.PREPROCESSED + """
SELECT label, count(*) AS "count", round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percentage
FROM preprocessed GROUP BY label ORDER BY label"""


@query("label_distribution", DISTRIBUTION)
def label_distribution(spark, d):
    return _rounded(quality.label_distribution(preprocess(spark, d), "label"), "percentage")


@query("order_by_label", CODED + " SELECT label, lang, count(*) AS n FROM coded GROUP BY ALL ORDER BY label, lang")
def order_by_label(spark, d):
    counts = _coded(spark, d).groupBy(F.col("Label").alias("label"), "lang").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy("label", "lang")


@query("split_distributions", WITH + sql.PREDICTIONS + f""", splits AS (
  SELECT label, CASE WHEN {sql.u(42)} < 0.8 THEN 'train' ELSE 'validate' END AS split FROM predictions),
tagged AS (SELECT * FROM splits UNION ALL SELECT label, 'dataset' FROM splits)
SELECT split, label, count(*) AS "count",
  round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS percentage
FROM tagged GROUP BY split, label""")
def split_distributions(spark, d):
    rows = fx.predictions(spark, d).select("label", splits.split_name(F.col("doc_id")).alias("split"))
    return _rounded(quality.split_distributions(rows, "split", "label"), "percentage")


@query("confusion_matrix", WITH + sql.PREDICTIONS + """
SELECT label, count(*) FILTER (prediction = 0) AS p0, count(*) FILTER (prediction = 1) AS p1,
  count(*) FILTER (prediction = 2) AS p2, count(*) FILTER (prediction = 3) AS p3
FROM predictions GROUP BY label""")
def confusion_matrix(spark, d):
    return quality.confusion_matrix(fx.predictions(spark, d), classes=(0, 1, 2, 3))


EVALUATED = WITH + sql.PREDICTIONS + ", " + sql.evaluation("predictions")


def _single_metric(name):
    def run(spark, d):
        return _rounded(quality.evaluate(fx.predictions(spark, d)).select(name), name)

    return run


for _key, _metric in (
    ("eval_accuracy", "accuracy"), ("eval_weighted_precision", "precision"),
    ("eval_weighted_recall", "recall"), ("eval_f1", "f1"),
):
    query(_key, EVALUATED + f" SELECT round({_metric}, 6) AS {_metric} FROM ev")(_single_metric(_metric))


@query("evaluate_all", EVALUATED + """
SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ev""")
def evaluate_all(spark, d):
    return _rounded(quality.evaluate(fx.predictions(spark, d)), *quality.METRICS)


@query("per_class_report", EVALUATED + """
SELECT class::VARCHAR AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM ev_cls
UNION ALL SELECT 'macro avg', round(macro_precision, 6), round(macro_recall, 6), round(macro_f1, 6), (SELECT sum(support)::BIGINT FROM ev_cls) FROM ev
UNION ALL SELECT 'weighted avg', round(precision, 6), round(recall, 6), round(f1, 6), (SELECT sum(support)::BIGINT FROM ev_cls) FROM ev""")
def per_class_report(spark, d):
    return _rounded(quality.per_class_report(fx.predictions(spark, d)), "precision", "recall", "f1")


@query("cv_metrics_mean", WITH + sql.CV + """
SELECT trial, round(avg(accuracy), 6) AS accuracy, round(avg(precision), 6) AS precision,
  round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM trials GROUP BY trial""")
def cv_metrics_mean(spark, d):
    return _rounded(quality.cv_metrics_mean(fx.cv_trials(spark, d)), *quality.METRICS)


@query("cv_metrics_max", WITH + sql.CV + """
SELECT trial, round(max(accuracy), 6) AS accuracy, round(max(precision), 6) AS precision,
  round(max(recall), 6) AS recall, round(max(f1), 6) AS f1 FROM trials GROUP BY trial""")
def cv_metrics_max(spark, d):
    return _rounded(quality.cv_metrics_max(fx.cv_trials(spark, d)), *quality.METRICS)


@query("best_params", WITH + sql.CV + """
, means AS (SELECT trial, avg(f1) AS f1 FROM trials GROUP BY trial)
SELECT trial, round(f1, 6) AS f1 FROM means WHERE f1 > 0 ORDER BY round(f1, 12) DESC, trial LIMIT 1""")
def best_params(spark, d):
    return _rounded(quality.best_params(fx.cv_trials(spark, d)), "f1")


@query("split_train_validate", f"""
SELECT doc_id, CASE WHEN {sql.u(42)} < 0.8 THEN 'train' ELSE 'validate' END AS split FROM documents""")
def split_train_validate(spark, d):
    train, validate = splits.split_train_validate(fx.table(spark, d, "documents").select("doc_id"), "doc_id")
    return train.withColumn("split", F.lit("train")).unionByName(validate.withColumn("split", F.lit("validate")))


@query("fold_assignment", f"SELECT doc_id, floor({sql.u(42)} * 5)::INT AS fold FROM documents")
def fold_assignment(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", splits.fold_of(F.col("doc_id"), 5).alias("fold"))


@query("fold_union", f"""
SELECT doc_id, fold FROM (SELECT doc_id, floor({sql.u(42)} * 3)::INT AS fold FROM documents) WHERE fold <> 0""")
def fold_union(spark, d):
    folds = splits.k_fold_split(fx.table(spark, d, "documents").select("doc_id"), "doc_id", k=3)
    return splits.fold_union(folds, held_out=0)


@query("missing_value_count", CODED + " SELECT count(*) FILTER (label IS NULL) AS missing FROM coded")
def missing_value_count(spark, d):
    return profile.missing_value_count(_coded(spark, d), "Label")


@query("text_length_descriptor", "SELECT doc_id, length(text)::INT AS length FROM documents")
def text_length_descriptor(spark, d):
    rows = profile.text_length(fx.table(spark, d, "documents"), output_col="length")
    return rows.select("doc_id", "length")


@query("min_value", "SELECT min(length(text))::INT AS min_value FROM documents")
def min_value(spark, d):
    return profile.min_value(profile.text_length(fx.table(spark, d, "documents")))


def _profile_sql(column, kind, key, number, shown):
    """One column's row of the profile; ``quantile_cont`` interpolates like the Spark side."""
    value = number if number else "NULL::DOUBLE"
    return f"""SELECT '{column}' AS "column", '{kind}' AS kind, count(*) AS row_count,
  count(*) FILTER ({key} IS NULL) AS missing, count(DISTINCT {key}) AS distinct_values,
  (SELECT {shown} FROM base WHERE {key} IS NOT NULL GROUP BY {key} ORDER BY count(*) DESC, {key} LIMIT 1) AS most_common,
  (SELECT count(*) FROM base WHERE {key} IS NOT NULL GROUP BY {key} ORDER BY count(*) DESC, {key} LIMIT 1) AS most_common_count,
  round(min({value}), 4) AS min, round(max({value}), 4) AS max, round(avg({value}), 4) AS mean, round(stddev_samp({value}), 4) AS std,
  round(quantile_cont({value}, 0.25), 4) AS q25, round(quantile_cont({value}, 0.5), 4) AS q50, round(quantile_cont({value}, 0.75), 4) AS q75
FROM base"""


@query("dataset_summary", CODED + ", base AS (SELECT body, label, length(body) AS len FROM coded) " + " UNION ALL ".join([
    _profile_sql("text", "text", "md5(body)", None, "min(body)"),
    _profile_sql("label", "categorical", "label::VARCHAR", None, "label::VARCHAR"),
    _profile_sql("Length", "numeric", "len::VARCHAR", "len::DOUBLE", "len::VARCHAR"),
]))
def dataset_summary(spark, d):
    rows = _coded(spark, d).select(F.col("Label").alias("label"), F.col("Text").alias("text"))
    summary = profile.dataset_summary(profile.text_length(rows))
    figures = ("min", "max", "mean", "std", "q25", "q50", "q75")
    return summary.withColumns({c: F.round(c, 4) for c in figures})


@query("exact_quantiles", """
SELECT round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
  round(quantile_cont(value, 0.75), 6) AS q75 FROM events""")
def exact_quantiles(spark, d):
    return _rounded(
        running.exact_quantiles(fx.table(spark, d, "events"), F.col("value"), (0.25, 0.5, 0.75)), "q25", "q50", "q75"
    )


@query("dataset_summary_report", CODED + f""", facts AS (
  SELECT count(*) FILTER (label IS NULL)::DOUBLE AS missing, min(length(body))::DOUBLE AS shortest,
    count(*) AS n, count(DISTINCT label) AS labels, count(DISTINCT body) AS texts, count(DISTINCT length(body)) AS lengths
  FROM coded WHERE label IS DISTINCT FROM 3),
tests AS (SELECT 'dataset_summary' AS report, 'missing_labels' AS test, missing <= 0 AS ok,
  'missing_labels is ' || round(missing, 4)::DECIMAL(18, 4)::VARCHAR || ', limit 0.0000' AS description FROM facts
UNION ALL SELECT 'dataset_summary', 'min_length', shortest >= 1, 'min_length is ' || round(shortest, 4)::DECIMAL(18, 4)::VARCHAR || ', limit 1.0000' FROM facts),
lines AS (SELECT row_number() OVER (ORDER BY test) AS no, * FROM tests WHERE NOT ok)
SELECT 'dataset_summary' AS report, 2::BIGINT AS num_tests, (SELECT count(*) FROM lines) AS num_fail,
  coalesce((SELECT string_agg(no || '. ' || test || '  FAILED' || chr(10) || 'Description: ' || description || chr(10), '' ORDER BY no) FROM lines), '') AS fail_info,
  (SELECT count(*) FROM lines) > 0 AS notify, NULL::VARCHAR AS request,
  (SELECT count(*) FROM lines) AS alerts, coalesce((SELECT string_agg(test || ': ' || description, ' | ' ORDER BY no) FROM lines), '') AS alert_lines,
  CASE WHEN (SELECT count(*) FROM lines) > 0 THEN '""" + ALERT_TYPES["dataset_summary"] + """' END AS alert_type,
  [n, n, n] AS rows_profiled, [lengths, labels, texts] AS distinct_values FROM facts""")
def dataset_summary_report(spark, d):
    rows = _coded(spark, d).select("Label", "Text")
    profiled = reports.dataset_summary_profile(rows).groupBy().agg(
        F.array_sort(F.collect_list(F.struct("column", "row_count", "distinct_values"))).alias("p")
    )
    shown = profiled.select(
        F.lit("dataset_summary").alias("report"), F.col("p.row_count").alias("rows_profiled"), F.col("p.distinct_values").alias("distinct_values")
    )
    found = reports.outcome(reports.dataset_summary_report(rows))
    found = found.withColumns({
        "alert_lines": F.array_join(F.transform("alerts", lambda x: F.concat(x["name"], F.lit(": "), x["description"])), " | "),
        "alerts": F.size("alerts").cast("long"),
    })
    both = found.unionByName(shown, allowMissingColumns=True)
    return both.groupBy("report").agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns if c != "report"])

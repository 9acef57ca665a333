"""Drift, quality gates, alerts and model selection."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..constants import DRIFT_CONFIDENCE
from ..operators import checks, drift, quality, registry, running, sketches
from ..plans import reports
from ..session import materialize
from . import fixtures as fx
from . import fixtures_sql as sql
from .dataset_queries import TESTS_BY_PRODUCT, _tests_by_product
from .registry import query

WITH = "WITH "
BATCHES = sql.PREDICTIONS + f""",
even_ref AS (SELECT * FROM predictions WHERE {sql.u(5)} < 0.5), even_cur AS (SELECT * FROM predictions WHERE {sql.u(5)} >= 0.5),
shift_ref AS (SELECT * FROM predictions WHERE lang = 'en'),
shift_cur AS (SELECT * REPLACE (confidence * confidence AS confidence) FROM predictions WHERE lang <> 'en')"""


def _psi_rows(*parts):
    return " UNION ALL ".join(
        f"SELECT '{column}' AS \"column\", round(psi, 6) AS value, 0.1::DOUBLE AS threshold, psi >= 0.1 AS drifted FROM {name}"
        for column, name in parts
    )


def _rounded(df):
    return df.withColumn("value", F.round("value", 6))


@query("psi_categorical", WITH + ", ".join([
    BATCHES,
    sql.psi("even_ref", "even_cur", "prediction", "p1", True),
    sql.psi("shift_ref", "shift_cur", "prediction", "p2", True),
    sql.psi("shift_ref", "shift_cur", "lang", "p3", True),
]) + " SELECT 'even' AS batches, * FROM (" + _psi_rows(("prediction", "p1")) + ") UNION ALL SELECT 'shifted', * FROM ("
    + _psi_rows(("prediction", "p2"), ("lang", "p3")) + ")")
def psi_categorical(spark, d):
    rows = fx.predictions(spark, d)
    even = drift.psi_categorical(*fx.even_batches(rows), "prediction")
    shifted = drift.psi_table(*fx.shifted_batches(rows), categorical=["prediction", "lang"])
    return _rounded(
        even.withColumn("batches", F.lit("even")).unionByName(shifted.withColumn("batches", F.lit("shifted")))
    )


@query("psi_numeric", WITH + ", ".join([
    BATCHES,
    "events_ref AS (SELECT * FROM events WHERE event_id < (SELECT count(*) / 2 FROM events))",
    "events_cur AS (SELECT * FROM events WHERE event_id >= (SELECT count(*) / 2 FROM events))",
    sql.psi("events_ref", "events_cur", "value", "p1", False),
    sql.psi("shift_ref", "shift_cur", "confidence", "p2", False),
    sql.psi("shift_ref", "shift_cur", "n_chars", "p3", False),
    sql.psi("shift_ref", "shift_cur", "label", "p4", True),
]) + " " + _psi_rows(("value", "p1"), ("confidence", "p2"), ("n_chars", "p3"), ("label", "p4")))
def psi_numeric(spark, d):
    events = drift.psi_numeric(*fx.event_batches(spark, d), "value")
    shifted = drift.psi_table(
        *fx.shifted_batches(fx.predictions(spark, d)), numeric=["confidence", "n_chars", "label"]
    )
    return _rounded(events.unionByName(shifted))


@query("roc_auc", f"""
WITH scores AS (SELECT floor({sql.u(14)} * 500 + (value > 20)::INT * 100) AS score, (event_type = 'purchase' OR value > 50)::INT AS label FROM (
  SELECT event_id AS doc_id, value, event_type FROM events)),
ranked AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scores)
SELECT count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives,
  round((sum(r::DOUBLE) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
    / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0))::DOUBLE, 6) AS auc
FROM ranked""")
def roc_auc(spark, d):
    events = fx.table(spark, d, "events")
    score = F.floor(fx.unit_hash(14, F.col("event_id")) * 500 + (F.col("value") > 20).cast("int") * 100)
    positive = (F.col("event_type") == "purchase") | (F.col("value") > 50)
    scores = events.select(score.cast("double").alias("score"), positive.cast("int").alias("label"))
    return running.roc_auc(scores).withColumn("auc", F.round("auc", 6))


@query("text_content_drift")
def text_content_drift(spark, d):
    documents = drift.text_vectors(fx.texts(spark, d))  # all texts are in both comparisons
    even = drift.text_content_drift(*fx.even_batches(documents), vector_col="text_vector")
    english, others = documents.filter("lang = 'en'"), documents.filter("lang <> 'en'")
    shifted = drift.text_content_drift(english, others, vector_col="text_vector")
    return even.withColumn("batches", F.lit("even")).unionByName(shifted.withColumn("batches", F.lit("shifted")))


def _interval_sql(scores, name="found"):
    """CTE with DeLong's interval of a CTE of ``(score, label)``, placement by placement."""
    z = NormalDist().inv_cdf(0.5 + DRIFT_CONFIDENCE / 2)
    return f"""{name}_counts AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM {scores} GROUP BY score),
{name}_sums AS (SELECT *, sum(pos) OVER w - pos AS before_pos, sum(neg) OVER w - neg AS before_neg, sum(pos) OVER () AS m, sum(neg) OVER () AS n
  FROM {name}_counts WINDOW w AS (ORDER BY score)),
{name}_placed AS (SELECT label, CASE WHEN label = 1 THEN (before_neg + neg / 2.0::DOUBLE) / n ELSE (m - before_pos - pos / 2.0::DOUBLE) / m END AS v
  FROM {scores} JOIN {name}_sums USING (score)),
{name} AS (SELECT count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, avg(v) FILTER (label = 1) AS auc,
    {z!r} * sqrt(var_samp(v) FILTER (label = 1) / count(*) FILTER (label = 1) + var_samp(v) FILTER (label = 0) / count(*) FILTER (label = 0)) AS reach
  FROM {name}_placed)"""


SCORE_BATCHES = ", ".join([f"""scores_{name} AS (
  SELECT floor({sql.u(14)} * 500 + {shift})::DOUBLE AS score, ({label})::INT AS label FROM (SELECT event_id AS doc_id, * FROM events))"""
    for name, shift, label in (("even", "0", sql.u(16) + " < 0.4"), ("near", f"({sql.u(16)} < 0.4)::INT * 5", sql.u(16) + " < 0.4"),
                               ("shifted", "(value > 20)::INT * 100", "event_type = 'purchase' OR value > 50"))])


@query("text_drift_interval", "WITH " + SCORE_BATCHES + ", " + ", ".join(
    _interval_sql(f"scores_{b}", b) for b in ("even", "near", "shifted")) + " " + " UNION ALL ".join(
    f"""SELECT '{b}' AS batches, 'text' AS "column", round(auc, 6) AS value, 0.5::DOUBLE AS threshold, auc - reach > 0.5 AS drifted,
  round(greatest(auc - reach, 0), 6) AS low, round(least(auc + reach, 1), 6) AS high FROM {b}""" for b in ("even", "near", "shifted")))
def text_drift_interval(spark, d):
    """The verdict on stored scores of like, slightly shifted and shifted batches."""
    events, u = fx.table(spark, d, "events"), fx.unit_hash(14, F.col("event_id"))
    current = (fx.unit_hash(16, F.col("event_id")) < 0.4).cast("int")
    bought = ((F.col("event_type") == "purchase") | (F.col("value") > 50)).cast("int")
    found = None
    for name, shift, label in (("even", F.lit(0), current), ("near", current * 5, current), ("shifted", (F.col("value") > 20).cast("int") * 100, bought)):
        scores = events.select(F.floor(u * 500 + shift).cast("double").alias("score"), label.alias("label"))
        rows = _rounded(drift.drift_of_scores(scores)).withColumn("batches", F.lit(name))
        rows = rows.withColumns({c: F.round(c, 6) for c in ("low", "high")})
        found = rows if found is None else found.unionByName(rows)
    return found


@query("drifted_terms", WITH + sql.DOC_WORDS + """,
sides AS (SELECT term, lang = 'en' AS ref FROM words JOIN documents USING (doc_id)),
counts AS (SELECT term, count(*) FILTER (ref) AS reference, count(*) FILTER (NOT ref) AS "current" FROM sides GROUP BY term),
sizes AS (SELECT sum(reference)::DOUBLE AS r, sum("current")::DOUBLE AS c FROM counts),
odds AS (SELECT term, reference, "current", 0.01 * (reference + "current") AS w, r, c FROM counts, sizes),
found AS (SELECT term, reference, "current",
  ln(("current" + w) / (c + 0.01 * (r + c) - "current" - w)) - ln((reference + w) / (r + 0.01 * (r + c) - reference - w)) AS log_odds,
  sqrt(1 / ("current" + w) + 1 / (reference + w)) AS spread FROM odds)
SELECT term, reference, "current", round(log_odds, 6) AS log_odds, round(log_odds / spread, 6) AS z FROM found WHERE abs(log_odds / spread) >= 1.96""")
def drifted_terms(spark, d):
    """Terms that tell the other languages' documents from the English ones."""
    docs = fx.document_tokens(spark, d).join(fx.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    found = drift.drifted_terms(docs.filter("lang = 'en'"), docs.filter("lang <> 'en'"), "filtered_words", least_z=1.96)
    return found.withColumns({c: F.round(c, 6) for c in ("log_odds", "z")})


SHIFTED = ", ".join([
    BATCHES,
    sql.psi("shift_ref", "shift_cur", "prediction", "p1", True),
    sql.psi("shift_ref", "shift_cur", "lang", "p2", True),
    sql.psi("shift_ref", "shift_cur", "confidence", "p3", False),
    "cols AS (" + _psi_rows(("prediction", "p1"), ("lang", "p2"), ("confidence", "p3")) + ")",
])


def _shifted_columns(spark, d):
    return drift.psi_table(
        *fx.shifted_batches(fx.predictions(spark, d)), categorical=["prediction", "lang"], numeric=["confidence"]
    )


@query("dataset_drift_share", WITH + SHIFTED + """
SELECT count(*) AS "columns", count(*) FILTER (drifted) AS drifted_columns, round(avg(drifted::INT), 6) AS share,
  avg(drifted::INT) >= 0.5 AS dataset_drift FROM cols""")
def dataset_drift_share(spark, d):
    return drift.dataset_drift_share(_shifted_columns(spark, d)).withColumn("share", F.round("share", 6))


@query("drift_tests", WITH + SHIFTED + """
SELECT 'data_drift' AS report, 'drift:' || "column" AS test, CASE WHEN drifted THEN 'FAIL' ELSE 'SUCCESS' END AS status, value, threshold,
  'Drift of ' || "column" || ' is ' || round(value, 4)::DECIMAL(18, 4)::VARCHAR || ', threshold 0.1000' AS description FROM cols""")
def drift_tests(spark, d):
    return checks.drift_tests(_rounded(_shifted_columns(spark, d)))


QUALITY = WITH + ", ".join([
    sql.PREDICTIONS,
    sql.evaluation("predictions", name="old"), sql.evaluation("predictions_new", name="cur"),
    """pairs AS (SELECT 'accuracy' AS test, cur.accuracy AS value, old.accuracy * 0.9 AS threshold FROM old, cur
  UNION ALL SELECT 'precision', cur.macro_precision, old.macro_precision * 0.9 FROM old, cur
  UNION ALL SELECT 'recall', cur.macro_recall, old.macro_recall * 0.9 FROM old, cur
  UNION ALL SELECT 'f1', cur.macro_f1, old.macro_f1 * 0.9 FROM old, cur)""",
]) + """
SELECT 'model_drift' AS report, test, CASE WHEN round(value, 9) >= round(threshold, 9) THEN 'SUCCESS' ELSE 'FAIL' END AS status,
  round(value, 6) AS value, round(threshold, 6) AS threshold FROM pairs"""


def _quality_columns(tests):
    return tests.select("report", "test", "status", F.round("value", 6).alias("value"), F.round("threshold", 6).alias("threshold"))


@query("model_quality_tests", QUALITY)
def model_quality_tests(spark, d):
    return _quality_columns(checks.model_quality_tests(fx.predictions(spark, d), fx.predictions_new(spark, d)))


@query("failed_tests", TESTS_BY_PRODUCT + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY test) AS no FROM tests WHERE status = 'FAIL'),
lines AS (SELECT *, no || '. ' || test || '  FAILED' || chr(10) || 'Description: ' || description || chr(10) AS line FROM numbered)
SELECT report, count(*) AS num_fail, string_agg(line, '' ORDER BY no) AS fail_info FROM lines GROUP BY report""")
def failed_tests(spark, d):
    return checks.failure_block(_tests_by_product(spark, d))


@query("alert_documents", TESTS_BY_PRODUCT + """
SELECT 'Model Drift Detected' AS type, test AS test_case, description, status FROM tests WHERE status = 'FAIL'""")
def alert_documents(spark, d):
    return checks.alert_documents(_tests_by_product(spark, d), checks.alert_type_of(F.lit("model_drift")))


@query("retrain_signal", TESTS_BY_PRODUCT + """,
kinds AS (SELECT *, CASE length(report) % 3 WHEN 0 THEN 'data_drift' WHEN 1 THEN 'model_drift' ELSE 'dataset_summary' END AS kind FROM tests)
SELECT report, count(*) FILTER (status = 'FAIL') AS num_fail, count(*) FILTER (status = 'FAIL') > 0 AS notify,
  CASE WHEN count(*) FILTER (status = 'FAIL') > 0 AND kind = 'model_drift' THEN 'train' END AS request
FROM kinds GROUP BY report, kind""")
def retrain_signal(spark, d):
    kind = F.get(
        F.array(F.lit("data_drift"), F.lit("model_drift"), F.lit("dataset_summary")), F.length("report") % 3
    )
    return checks.retrain_signal(_tests_by_product(spark, d), kind=kind)


@query("latest_model_version", WITH + sql.VERSIONS + """,
names AS (SELECT DISTINCT 'model_' || c_custkey AS name FROM customer),
ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY last_updated_timestamp DESC, version DESC) AS rn FROM versions)
SELECT n.name, version, stage, run_id, round(accuracy, 6) AS accuracy FROM names n LEFT JOIN ranked r ON n.name = r.name AND rn = 1""")
def latest_model_version(spark, d):
    latest = registry.latest_model_version(fx.model_versions(spark, d), fx.model_names(spark, d))
    return latest.select("name", "version", "stage", "run_id", F.round("accuracy", 6).alias("accuracy"))


@query("model_version_by_stage", WITH + sql.VERSIONS + """
SELECT name, version, run_id FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY version DESC) AS rn FROM versions WHERE stage = 'Production') WHERE rn = 1""")
def model_version_by_stage(spark, d):
    return registry.model_version_by_stage(fx.model_versions(spark, d)).select("name", "version", "run_id")


@query("test_pass_gate", WITH + sql.VERSIONS + " SELECT name, version, accuracy > 0.8 AS test_pass FROM versions")
def test_pass_gate(spark, d):
    return checks.pass_gate(fx.model_versions(spark, d)).select("name", "version", "test_pass")


BOTH_MODELS = ", ".join([
    sql.PREDICTIONS,
    sql.evaluation("predictions", name="old"), sql.evaluation("predictions_new", name="cur"),
])


@query("champion_challenger", WITH + BOTH_MODELS + """
SELECT round(cur.accuracy, 6) AS new_accuracy, round(cur.precision, 6) AS new_precision, round(cur.recall, 6) AS new_recall, round(cur.f1, 6) AS new_f1,
  round(old.accuracy, 6) AS production_accuracy, round(old.precision, 6) AS production_precision,
  round(old.recall, 6) AS production_recall, round(old.f1, 6) AS production_f1,
  CASE WHEN cur.accuracy > old.accuracy THEN 'promote' ELSE 'keep' END AS decision FROM old, cur""")
def champion_challenger(spark, d):
    rows = fx.predictions(spark, d).withColumn(
        "challenger", fx.wrong_above(4, 0.65, F.col("label"))
    )
    result = quality.champion_challenger(rows, "prediction", "challenger")
    figures = [c for c in result.columns if c != "decision"]
    return result.withColumns({c: F.round(c, 6) for c in figures})


def _cv_runs(spark, d):
    return quality.cv_metrics_max(fx.cv_trials(spark, d))


@query("run_log", WITH + sql.CV + """,
best AS (SELECT trial, max(accuracy) AS accuracy, max(f1) AS f1 FROM trials GROUP BY trial)
SELECT trial::VARCHAR AS run_id, '2024-01-0' || trial || '_00-00-00' AS run_name, 'CountVectorizer' AS vectorizer, '3' AS folds,
  round(accuracy, 4)::DECIMAL(18, 4)::VARCHAR AS accuracy, round(f1, 4)::DECIMAL(18, 4)::VARCHAR AS f1,
  'reference' AS dataset, CASE WHEN accuracy > 0.6 THEN 'True' END AS test_pass, CASE WHEN accuracy > 0.6 THEN 6 ELSE 5 END::BIGINT AS entries FROM best""")
def run_log(spark, d):
    started = F.timestamp_add("DAY", F.col("trial") - 1, F.lit("2024-01-01").cast("timestamp"))
    log = registry.run_log(
        _cv_runs(spark, d), "trial", started,
        params={"vectorizer": F.lit("CountVectorizer"), "folds": F.lit(3)},
        metrics={"accuracy": checks.shown(F.col("accuracy")), "f1": checks.shown(F.col("f1"))},
        tags={"dataset": F.lit("reference"), "test_pass": F.when(F.col("accuracy") > 0.6, F.lit("True"))},
    )
    entries = log.groupBy("run_id").agg(F.count("*").alias("entries"))
    return registry.run_table(log, ["vectorizer", "folds", "accuracy", "f1", "dataset", "test_pass"]).join(entries, "run_id")


@query("promote_version", WITH + sql.VERSIONS + """,
newest AS (SELECT *, substr(name, 7)::BIGINT AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY last_updated_timestamp DESC, version DESC) AS rn FROM versions) WHERE rn = 1),
promoted AS (SELECT c.*, 'model_' || (c.n % 20) AS destination,
    row_number() OVER (PARTITION BY c.n % 20 ORDER BY c.name, c.version) AS place
  FROM newest c JOIN newest o ON o.name = 'model_' || (c.n % 20) WHERE c.n >= 20 AND c.accuracy > o.accuracy),
copies AS (SELECT destination AS name, (SELECT max(version) FROM versions v WHERE v.name = destination) + place AS version,
  'Production' AS stage, run_id, kind, 'True' AS production FROM promoted)
SELECT v.name, v.version, v.stage, v.run_id, v.kind, CASE WHEN p.name IS NOT NULL THEN 'True' END AS production
FROM versions v LEFT JOIN promoted p ON v.name = p.name AND v.version = p.version UNION ALL SELECT * FROM copies""")
def promote_version(spark, d):
    """Models below number 20 are in production; the newest version of any other challenges one of them."""
    versions = fx.model_versions(spark, d)
    number = F.substring("name", 7, 20).cast("long")
    newest = registry.latest_model_version(versions)
    challengers = newest.filter(number >= 20).select(
        "name", F.col("version").alias("source_version"), F.col("accuracy").alias("new"),
        F.concat(F.lit("model_"), (number % 20).cast("string")).alias("destination"),
    )
    champions = newest.select(F.col("name").alias("destination"), F.col("accuracy").alias("old"))
    decisions = challengers.join(champions, "destination").select(
        "name", "source_version", "destination",
        F.when(F.col("new") > F.col("old"), "promote").otherwise("keep").alias("decision"),
    )
    promoted = registry.promote_version(versions, decisions, F.lit("2024-02-01 00:00:00"))
    return promoted.select(
        "name", "version", "stage", "run_id", F.col("tags")["kind"].alias("kind"), F.col("tags")["Production"].alias("production")
    )


def _outcome_sql(alert):
    """What follows from a CTE ``tests``."""
    return f""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY test) AS no FROM tests WHERE status = 'FAIL'),
lines AS (SELECT *, no || '. ' || test || '  FAILED' || chr(10) || 'Description: ' || description || chr(10) AS line FROM numbered),
blocks AS (SELECT report, count(*) AS num_fail, string_agg(line, '' ORDER BY no) AS fail_info FROM lines GROUP BY report)
SELECT t.report, count(*) AS num_tests, coalesce(any_value(num_fail), 0)::BIGINT AS num_fail, coalesce(any_value(fail_info), '') AS fail_info,
  coalesce(any_value(num_fail), 0) > 0 AS notify,
  CASE WHEN any_value(num_fail) > 0 AND t.report = 'model_drift' THEN 'train' END AS request,
  coalesce(any_value(num_fail), 0)::BIGINT AS alerts, CASE WHEN any_value(num_fail) > 0 THEN '{alert}' END AS alert_type
FROM tests t LEFT JOIN blocks b ON t.report = b.report GROUP BY t.report"""


def _outcome(tests):
    """What follows from a report, with its alerts counted."""
    return reports.outcome(tests).withColumn("alerts", F.size("alerts").cast("long"))


@query("model_drift_report", QUALITY.split("SELECT 'model_drift' AS report")[0].rstrip() + """,
tests AS (SELECT 'model_drift' AS report, test, CASE WHEN round(value, 9) >= round(threshold, 9) THEN 'SUCCESS' ELSE 'FAIL' END AS status,
  test || ' is ' || round(value, 4)::DECIMAL(18, 4)::VARCHAR || ', expected at least ' || round(threshold, 4)::DECIMAL(18, 4)::VARCHAR AS description
  FROM pairs)""" + _outcome_sql("Model Drift Detected"))
def model_drift_report(spark, d):
    reference, current = (
        df.withColumns({c: F.col(c).cast("double").cast("string") for c in ("label", "prediction")})
        for df in (fx.predictions(spark, d), fx.predictions_new(spark, d))
    )
    return _outcome(reports.model_drift_report(reference, current))


DATA_DRIFT = WITH + sql.LABELED + ", " + sql.ANNOTATIONS + f""",
parsed AS (SELECT doc_id, coalesce(CASE pick WHEN 0 THEN greatest(a, b, c) WHEN 6 THEN a WHEN 7 THEN greatest(a, b)
  WHEN 8 THEN b WHEN 9 THEN c WHEN 10 THEN a WHEN 11 THEN greatest(a, b) WHEN 12 THEN c END::DOUBLE, 0.0) AS confidence FROM annotations),
snapshots AS (SELECT doc_id, lang, CASE WHEN {sql.u(3)} < 0.8 THEN label ELSE (label + 1) % 3 END AS prediction, confidence, NULL::VARCHAR AS unused
  FROM (SELECT doc_id, lang, {sql.ENCODE} AS label FROM labeled) l JOIN parsed p USING (doc_id)),
snap_ref AS (SELECT * FROM snapshots WHERE lang = 'en'), snap_cur AS (SELECT * FROM snapshots WHERE lang <> 'en'),
""" + ", ".join([
    sql.psi("snap_ref", "snap_cur", "prediction", "p1", True),
    sql.psi("snap_ref", "snap_cur", "lang", "p2", True),
    sql.psi("snap_ref", "snap_cur", "confidence", "p3", False),
]) + f""",
text_scores AS (SELECT floor({sql.u(15)} * 500 + (lang <> 'en')::INT * 60)::DOUBLE AS score, (lang <> 'en')::INT AS label FROM snapshots),
{_interval_sql("text_scores", "textual")},
cols AS (SELECT 'prediction' AS "column", psi AS value, psi >= 0.1 AS drifted, '0.1000' AS threshold FROM p1 UNION ALL SELECT 'lang', psi, psi >= 0.1, '0.1000' FROM p2
  UNION ALL SELECT 'confidence', psi, psi >= 0.1, '0.1000' FROM p3 UNION ALL SELECT 'unused', NULL, true, '0.1000'
  UNION ALL SELECT 'text', auc, auc - reach > 0.5, '0.5000' FROM textual),
tests AS (SELECT 'data_drift' AS report, 'drift:' || "column" AS test, CASE WHEN drifted THEN 'FAIL' ELSE 'SUCCESS' END AS status,
    'Drift of ' || "column" || ' is ' || coalesce(round(value, 4)::DECIMAL(18, 4)::VARCHAR, 'unknown, it has no values on one side') || ', threshold ' || threshold AS description
  FROM cols
  UNION ALL SELECT 'data_drift', 'dataset_drift', CASE WHEN avg(drifted::INT) >= 0.5 THEN 'FAIL' ELSE 'SUCCESS' END,
    'Share of drifted columns is ' || round(avg(drifted::INT), 4)::DECIMAL(18, 4)::VARCHAR FROM cols)"""


def _snapshot_batches(spark, d):
    scored = fx.predictions(spark, d).drop("confidence").join(fx.annotation_strings(spark, d), "doc_id")
    scored = scored.withColumn("unused", F.lit(None).cast("string"))
    return scored.filter("lang = 'en'"), scored.filter("lang <> 'en'")


@query("data_drift_report", DATA_DRIFT + _outcome_sql("Data Drift Detected"))
def data_drift_report(spark, d):
    """From printed annotations and stored scores of the texts to what is asked for; one column has no values."""
    reference, current = _snapshot_batches(spark, d)
    current_row = (F.col("lang") != "en").cast("int")
    score = F.floor(fx.unit_hash(15, F.col("doc_id")) * 500 + current_row * 60).cast("double")
    text_scores = reference.unionByName(current).select(score.alias("score"), current_row.alias("label"))
    return _outcome(reports.data_drift_report(
        reference, current, categorical=["prediction", "lang", "unused"], text_scores=text_scores, annotation_col="category"
    ))


@query("data_drift_report_fitted")
def data_drift_report_fitted(spark, d):
    """The test rows of the report whose text column is judged by a classifier fitted on the way."""
    reference, current = _snapshot_batches(spark, d)
    return reports.data_drift_report(
        reference, current, categorical=["prediction", "lang", "unused"], annotation_col="category"
    )


@query("profile_of_states", f"""
WITH batches AS (SELECT floor({sql.u(17)} * 4) AS batch, value, event_type FROM (SELECT event_id AS doc_id, value, event_type FROM events)),
rows_of AS (SELECT 'value' AS "column", count(*) AS row_count, count(*) FILTER (value IS NULL) AS missing, min(value) AS min, max(value) AS max,
    avg(value) AS mean, stddev_samp(value) AS std FROM batches
  UNION ALL SELECT 'event_type', count(*), count(*) FILTER (event_type IS NULL), NULL, NULL, NULL, NULL FROM batches)
SELECT "column", (SELECT count(DISTINCT batch) FROM batches) AS batches, row_count, missing, min, max, round(mean, 6) AS mean, round(std, 6) AS std,
  true AS distinct_within, true AS median_within FROM rows_of""")
def profile_of_states(spark, d):
    """The events' profile merged from a stored state per batch, its sketches held against exact figures."""
    events = fx.table(spark, d, "events")
    batch = F.floor(fx.unit_hash(17, F.col("event_id")) * 4)
    states = materialize(sketches.batch_states(events, batch, categorical=["event_type"], numeric=["value"]), "batch_states")
    found = sketches.profile(sketches.merged(states))
    value, kinds = F.col("value").cast("double"), F.countDistinct("event_type")
    median = found.filter("q50 IS NOT NULL").select("q50").scalar()
    exact = events.agg(
        F.countDistinct("value").alias("value"), kinds.alias("event_type"), F.count("value").alias("n"),
        F.count_if(value < median).alias("below"), F.count_if(value <= median).alias("upto"),
    )
    distinct = F.when(F.col("column") == "value", exact.select("value").scalar()).otherwise(exact.select("event_type").scalar())
    half, n = exact.select("n").scalar() / 2, exact.select("n").scalar()
    error = F.lit(sketches.RANK_ERROR) * n + 1
    return found.select(
        "column", states.agg(F.countDistinct("batch")).scalar().alias("batches"), "row_count", "missing", "min", "max",
        F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"),
        (F.abs(F.col("distinct_values") / distinct - 1) <= F.col("distinct_error")).alias("distinct_within"),
        (F.col("q50").isNull() | (exact.select("below").scalar() <= half + error) & (exact.select("upto").scalar() >= half - error)).alias("median_within"),
    )

"""Sources, sinks, projections, filters and text cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import SMOKE_SAMPLES
from ..functions import labels, text
from ..operators import checks, cleaning, observed, splits
from ..operators.drift import psi_table as drift_table
from ..plans import reports
from ..plans.scoring import smoke_samples
from ..schemas import RAW_COMMENTS
from ..session import materialize, scratch_path
from ..sources import committed, csv_tables, objects, row_numbers, writers
from . import fixtures as fx
from . import fixtures_sql as sql
from .registry import query

RAW = ["Product", "Label", "Text"]
WITH = "WITH "


# ------------------------------------------------------------------ sources and sinks

@query("scan_csv", WITH + sql.LABELED + " SELECT product, name AS label, body AS text FROM labeled")
def scan_csv(spark, d):
    path = scratch_path(spark, "csv")
    csv_tables.write_csv(fx.labeled_text(spark, d).select(*RAW), path)
    return csv_tables.read_csv(spark, path, RAW_COMMENTS, multi_line=True).toDF("product", "label", "text")


@query("scan_csv_headerless", WITH + sql.DIRTY + """
SELECT product, name AS label, md5(body) AS text_md5 FROM dirty""")
def scan_csv_headerless(spark, d):
    path = scratch_path(spark, "csv")
    csv_tables.write_csv(fx.labeled_text_dirty(spark, d).select(*RAW), path, header=False)
    rows = csv_tables.read_csv_headerless(spark, path, RAW, multi_line=True)
    return rows.select(
        F.col("Product").alias("product"),
        F.col("Label").alias("label"),
        F.md5("Text").alias("text_md5"),
    )


@query("inline_rows", WITH + sql.LABELED + f"""
SELECT 'sample' AS origin, label, text FROM (VALUES {", ".join(f"({sql.quoted(t)}, {n})" for t, n in SMOKE_SAMPLES)}) s(text, label)
UNION ALL SELECT 'dataset', {sql.ENCODE}, body FROM labeled""")
def inline_rows(spark, d):
    samples = smoke_samples(spark).withColumn("origin", F.lit("sample"))
    rows = fx.labeled_text(spark, d).select("Text", labels.encode_label(F.col("Label")).alias("Label"))
    both = samples.unionByName(rows.withColumn("origin", F.lit("dataset")))
    return both.select("origin", F.col("Label").alias("label"), F.col("Text").alias("text"))


@query("sink_dataset", WITH + sql.PREPROCESSED + " SELECT doc_id, label, text FROM preprocessed")
def sink_dataset(spark, d):
    path = scratch_path(spark, "dataset")
    writers.write_dataset(preprocess(spark, d), path)
    return spark.read.parquet(path)


@query("sink_splits", WITH + sql.LABELED + f"""
SELECT doc_id, name AS label, CASE WHEN {sql.u(42)} < 0.8 THEN 'train' ELSE 'validate' END AS split FROM labeled""")
def sink_splits(spark, d):
    path = scratch_path(spark, "splits")
    rows = fx.labeled_text(spark, d).select("doc_id", F.col("Label").alias("label"))
    writers.write_splits(rows.withColumn("split", splits.split_name(F.col("doc_id"))), path)
    return spark.read.schema("doc_id long, label string, split string").parquet(path)


@query("sink_predictions", WITH + sql.PREDICTIONS + """
SELECT body AS text, label::DOUBLE AS label, prediction::DOUBLE AS prediction FROM predictions""")
def sink_predictions(spark, d):
    path = scratch_path(spark, "predictions")
    scored = fx.predictions(spark, d)
    writers.write_predictions(scored.withColumns({c: F.col(c).cast("double") for c in ("label", "prediction")}), path)
    return spark.read.parquet(path)


@query("sink_drift_snapshot", WITH + sql.PREDICTIONS + f"""
SELECT p.doc_id, p.prediction::DOUBLE AS prediction, p.prediction::VARCHAR AS result,
  ({sql.score(22).replace('doc_id', 'p.doc_id')}) AS score_1, coalesce(len(e.embedding), 0)::INT AS dim,
  round(e.embedding[1]::DOUBLE, 6) AS first_value, length(p.body)::INT - 1 AS last_char
FROM predictions p LEFT JOIN embeddings e ON p.doc_id = e.vec_id""")
def sink_drift_snapshot(spark, d):
    path = scratch_path(spark, "snapshot")
    writers.write_drift_snapshot(fx.snapshot(spark, d), path, batch_id="current")
    category = F.get("category", F.lit(0))
    sentence = F.get("sentence_embeddings", F.lit(0))
    return spark.read.parquet(path).filter("batch_id = 'current'").select(
        "doc_id", "prediction",
        category["result"].alias("result"),
        category["metadata"]["1"].alias("score_1"),
        F.size(sentence["embeddings"]).alias("dim"),
        F.round(F.get(sentence["embeddings"], F.lit(0)).cast("double"), 6).alias("first_value"),
        sentence["end"].alias("last_char"),
    )


@query("sink_report", WITH + ", ".join([
    sql.PREDICTIONS,
    sql.evaluation("predictions", name="old"), sql.evaluation("predictions_new", name="cur"),
    f"shift_ref AS (SELECT * FROM predictions WHERE lang = 'en'), shift_cur AS (SELECT * FROM predictions WHERE lang <> 'en')",
    sql.psi("shift_ref", "shift_cur", "lang", "p_lang", True),
    f"summary AS (SELECT count(*) FILTER (name = '')::DOUBLE AS missing, min(length(body))::DOUBLE AS shortest FROM labeled)",
]) + """
SELECT 'model_drift' AS report, test, CASE WHEN round(value, 9) >= round(threshold, 9) THEN 'SUCCESS' ELSE 'FAIL' END AS status,
  round(value, 6) AS value, '2024-01-01T00:00:00' AS timestamp
FROM (SELECT 'accuracy' AS test, cur.accuracy AS value, old.accuracy * 0.9 AS threshold FROM old, cur
  UNION ALL SELECT 'precision', cur.macro_precision, old.macro_precision * 0.9 FROM old, cur
  UNION ALL SELECT 'recall', cur.macro_recall, old.macro_recall * 0.9 FROM old, cur
  UNION ALL SELECT 'f1', cur.macro_f1, old.macro_f1 * 0.9 FROM old, cur)
UNION ALL SELECT 'dataset_summary', 'missing_labels', CASE WHEN missing <= 0 THEN 'SUCCESS' ELSE 'FAIL' END, missing, '2024-01-01T00:00:00' FROM summary
UNION ALL SELECT 'dataset_summary', 'min_length', CASE WHEN shortest >= 1 THEN 'SUCCESS' ELSE 'FAIL' END, shortest, '2024-01-01T00:00:00' FROM summary
UNION ALL SELECT 'data_drift', 'drift:lang', CASE WHEN psi >= 0.1 THEN 'FAIL' ELSE 'SUCCESS' END, round(psi, 6), '2024-01-01T00:00:00' FROM p_lang""")
def sink_report(spark, d):
    path = scratch_path(spark, "reports")
    when = F.lit("2024-01-01T00:00:00")
    drift = checks.model_quality_tests(fx.predictions(spark, d), fx.predictions_new(spark, d))
    coded = fx.predictions(spark, d).select("label", "text")
    columns = drift_table(*fx.shifted_batches(fx.predictions(spark, d)), categorical=["lang"])
    kinds = (drift, reports.dataset_summary_report(coded), checks.drift_tests(columns))
    for run, tests in enumerate([*kinds, kinds[0]]):  # the last run is repeated
        writers.append_report(tests, path, when, f"r{run % len(kinds)}")
    body = F.from_json("value", "test string, status string, value double, timestamp string")
    stored = spark.read.schema("value string, run_id string, report string").text(path)
    return stored.select("report", body.alias("t")).select(
        "report", "t.test", "t.status", F.round("t.value", 6).alias("value"), "t.timestamp"
    )


def _tests_by_product(spark, d):
    return checks.model_quality_tests(
        fx.predictions(spark, d), fx.predictions_new(spark, d), by=["Product"], report=F.col("Product")
    )


SHOWN = "round({0}, 4)::DECIMAL(18, 4)::VARCHAR"

TESTS_BY_PRODUCT = WITH + ", ".join([
    sql.PREDICTIONS,
    sql.evaluation("predictions", "product", "old"), sql.evaluation("predictions_new", "product", "cur"),
    """pairs AS (
  SELECT product, 'accuracy' AS test, cur.accuracy AS value, old.accuracy * 0.9 AS threshold FROM old JOIN cur USING (product)
  UNION ALL SELECT product, 'precision', cur.macro_precision, old.macro_precision * 0.9 FROM old JOIN cur USING (product)
  UNION ALL SELECT product, 'recall', cur.macro_recall, old.macro_recall * 0.9 FROM old JOIN cur USING (product)
  UNION ALL SELECT product, 'f1', cur.macro_f1, old.macro_f1 * 0.9 FROM old JOIN cur USING (product))""",
    f"""tests AS (
  SELECT product AS report, test, value, threshold,
    CASE WHEN round(value, 9) >= round(threshold, 9) THEN 'SUCCESS' ELSE 'FAIL' END AS status,
    test || ' is ' || {SHOWN.format('value')} || ', expected at least ' || {SHOWN.format('threshold')} AS description
  FROM pairs)""",
])


@query("sink_alert_log", TESTS_BY_PRODUCT + """
SELECT '2024-01-01T00:00:00' AS timestamp, 'Model Drift Detected' AS alert_type, 'Sent' AS status,
  'ops@example.org' AS recipient, test AS name, description FROM tests WHERE status = 'FAIL'""")
def sink_alert_log(spark, d):
    path = scratch_path(spark, "alerts")
    rows = checks.alerts(
        _tests_by_product(spark, d), checks.alert_type_of(F.lit("model_drift")), "ops@example.org",
        F.lit("2024-01-01T00:00:00"),
    )
    for _ in range(2):
        writers.append_alert_log(rows, path, "r1")
    entry = F.from_json(
        "value",
        "timestamp string, alert_type string, status string, "
        "details struct<recipient: string, name: string, description: string>",
    )
    return spark.read.text(path).select(entry.alias("e")).select(
        "e.timestamp", "e.alert_type", "e.status", "e.details.*"
    )


LATEST_OBJECTS = """latest AS (
  SELECT key, coalesce(min(version_id) FILTER (NOT is_delete_marker), min(version_id)) AS version_id
  FROM objects WHERE is_latest GROUP BY key)"""


@query("object_latest_version", WITH + sql.OBJECTS + ", " + LATEST_OBJECTS + """
SELECT c_custkey, scheme || '://data/' || r.key AS path,
  CASE WHEN scheme <> 'https' THEN coalesce(version_id, 'N/A') END AS version_id
FROM requests r LEFT JOIN latest USING (key)""")
def object_latest_version(spark, d):
    return objects.object_latest_version(fx.object_versions(spark, d), fx.object_requests(spark, d))


@query("dataset_manifest", WITH + sql.OBJECTS + ", " + LATEST_OBJECTS + f""",
rows AS (SELECT event_id, 'u' || user_id || '/' || event_type || '.csv' AS key, {sql.u(42, 'event_id')} < 0.8 AS train FROM events)
SELECT 's3a://data/' || key AS path, version_id, count(*) AS total, count(*) FILTER (train) AS train,
  count(*) FILTER (NOT train) AS validate
FROM rows LEFT JOIN latest USING (key) GROUP BY key, version_id""")
def dataset_manifest(spark, d):
    events = fx.table(spark, d, "events")
    path = F.concat(
        F.lit("s3a://data/u"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"), F.lit(".csv")
    )
    rows = events.select(path.alias("path"), splits.split_name(F.col("event_id")).alias("split"))
    return objects.dataset_manifest(rows, fx.object_versions(spark, d))


# ------------------------------------------------------------------ projections and filters

@query("rename_columns", WITH + sql.LABELED + " SELECT product, name AS label, md5(body) AS text_md5 FROM labeled")
def rename_columns(spark, d):
    raw = fx.labeled_text(spark, d).select(*RAW).toDF("_c0", "_c1", "_c2")
    return cleaning.rename_columns(raw).select(
        F.col("Product").alias("product"), F.col("Label").alias("label"), F.md5("Text").alias("text_md5")
    )


@query("drop_header_row", WITH + sql.DIRTY + " SELECT product, name AS label, md5(body) AS text_md5 FROM dirty")
def drop_header_row(spark, d):
    header = spark.createDataFrame([tuple(RAW)], RAW_COMMENTS)
    raw = header.unionByName(fx.labeled_text_dirty(spark, d).select(*RAW))
    return cleaning.drop_header_row(raw).select(
        F.col("Product").alias("product"), F.col("Label").alias("label"), F.md5("Text").alias("text_md5")
    )


@query("file_row_numbers", """
SELECT doc_id, row_number() OVER () - 1 AS ordinal, row_number() OVER () > 1 AS stays FROM documents""")
def file_row_numbers(spark, d):
    """Places of the documents in their file, and whether they stay when its first row goes."""
    scan = fx.table(spark, d, "documents")
    rest = row_numbers.drop_first_row(scan).select("doc_id", F.lit(True).alias("stays"))
    found = row_numbers.numbered(scan).select("doc_id", "ordinal").join(rest, "doc_id", "left")
    return found.withColumn("stays", F.coalesce("stays", F.lit(False)))


@query("observed_counts", WITH + sql.DIRTY + f""",
counts AS (SELECT count(*) AS a, count(*) FILTER (body IS NOT NULL) AS b, count(*) FILTER (trim(body) <> '' AND trim(name) <> '') AS c,
  count(*) FILTER (trim(body) <> '' AND name IN ('Negative', 'Positive', 'Neutral', 'Irrelevant')) AS d FROM dirty),
kept AS (SELECT count(*) AS e FROM ({sql.clean_select("(SELECT doc_id, body FROM dirty WHERE trim(body) <> '' AND name IN ('Negative', 'Positive', 'Neutral', 'Irrelevant'))", "body", "doc_id")}) WHERE length(text) > 0)
SELECT unnest([0, 1, 2, 3, 4])::INT AS place, unnest(['input', 'drop_null_text', 'filter_not_blank', 'filter_known_label', 'clean_text']) AS stage,
  unnest([a, b, c, d, e]) AS "rows", unnest([0, a - b, b - c, c - d, d - e]) AS dropped FROM counts, kept""")
def observed_counts(spark, d):
    """Rows that entered and left each stage of preprocessing, counted by the one execution that wrote its result."""
    clean, counts = observed.counted_stages(fx.labeled_text_dirty(spark, d).select(*RAW))
    materialize(clean, "observed")
    return counts()


@query("sink_committed_runs", WITH + sql.DIRTY + """
SELECT 'first' AS run_id, doc_id, name AS label FROM dirty WHERE doc_id % 3 = 1 UNION ALL
SELECT 'second', doc_id, name FROM dirty WHERE doc_id % 3 = 2""")
def sink_committed_runs(spark, d):
    """Two committed runs, the first of them repeated after it ended half-way, and one that never was committed."""
    path = scratch_path(spark, "runs")
    rows = fx.labeled_text_dirty(spark, d).select("doc_id", F.col("Label").alias("label"))
    runs = {name: rows.filter(F.col("doc_id") % 3 == i).select(F.lit(name).alias("run_id"), "*") for i, name in enumerate(("lost", "first", "second"))}
    committed.write_run(runs["first"].limit(5), path, "first")
    committed.write_run(runs["lost"], path, "lost")
    for name in ("first", "second"):
        committed.append_run(runs[name], path, name)
    return committed.read_runs(spark, path, runs["first"].schema)


def _brief(df):
    return df.select("doc_id", F.col("Label").alias("label"))


@query("drop_null_text", WITH + sql.DIRTY + " SELECT doc_id, name AS label FROM dirty WHERE body IS NOT NULL")
def drop_null_text(spark, d):
    return _brief(cleaning.drop_null_text(fx.labeled_text_dirty(spark, d)))


@query("filter_not_blank", WITH + sql.DIRTY + """
SELECT doc_id, name AS label FROM dirty WHERE trim(body) <> '' AND trim(name) <> ''""")
def filter_not_blank(spark, d):
    return _brief(cleaning.filter_not_blank(fx.labeled_text_dirty(spark, d)))


@query("filter_nonempty_length", WITH + sql.DIRTY + """
SELECT doc_id, name AS label FROM dirty WHERE length(body) > 0""")
def filter_nonempty_length(spark, d):
    return _brief(cleaning.filter_nonempty_length(fx.labeled_text_dirty(spark, d)))


def _coded(spark, d):
    return fx.labeled_text_dirty(spark, d).withColumn("Label", labels.encode_label(F.col("Label")))


CODED = WITH + sql.DIRTY + f", coded AS (SELECT *, {sql.ENCODE} AS label FROM dirty)"


@query("filter_known_label", CODED + " SELECT doc_id, label FROM coded WHERE label IS NOT NULL")
def filter_known_label(spark, d):
    return _brief(cleaning.filter_known_label(_coded(spark, d)))


@query("exclude_class", CODED + " SELECT doc_id, label FROM coded WHERE label <> 3")
def exclude_class(spark, d):
    return _brief(cleaning.exclude_class(_coded(spark, d), "Label"))


@query("drop_column", WITH + sql.LABELED + " SELECT doc_id, lang, n_chars, name AS label, body AS text FROM labeled")
def drop_column(spark, d):
    return fx.labeled_text(spark, d).drop("Product").withColumnsRenamed({"Label": "label", "Text": "text"})


@query("project_cast", CODED + " SELECT doc_id, body AS text, label::VARCHAR AS label FROM coded")
def project_cast(spark, d):
    return _coded(spark, d).selectExpr("doc_id", "cast(Text as string) as text", "cast(Label as string) as label")


@query("cast_label_chain", f"""
SELECT doc_id, trunc(try_cast(raw AS DOUBLE))::INT AS label FROM (
  SELECT doc_id, CASE floor({sql.u(8)} * 6) WHEN 0 THEN n_chars::VARCHAR WHEN 1 THEN n_chars || '.75'
    WHEN 2 THEN '-' || n_chars || '.5' WHEN 3 THEN 'x' || n_chars WHEN 4 THEN '' END AS raw FROM documents)""")
def cast_label_chain(spark, d):
    documents = fx.table(spark, d, "documents")
    pick = F.floor(fx.unit_hash(8, F.col("doc_id")) * 6)
    size = F.col("n_chars").cast("string")
    raw = (
        F.when(pick == 0, size).when(pick == 1, F.concat(size, F.lit(".75")))
        .when(pick == 2, F.concat(F.lit("-"), size, F.lit(".5")))
        .when(pick == 3, F.concat(F.lit("x"), size)).when(pick == 4, "")
    )
    return documents.select("doc_id", labels.cast_label(raw).alias("label"))


@query("project_subset", WITH + sql.PREDICTIONS + " SELECT body AS text, label, prediction FROM predictions")
def project_subset(spark, d):
    return fx.predictions(spark, d).select("text", "label", "prediction")


@query("encode_label", CODED + " SELECT doc_id, name, label AS code FROM coded")
def encode_label(spark, d):
    return fx.labeled_text_dirty(spark, d).select(
        "doc_id", F.col("Label").alias("name"), labels.encode_label(F.col("Label")).alias("code")
    )


@query("decode_label", CODED + """
SELECT doc_id, CASE label WHEN 0 THEN 'Negative' WHEN 1 THEN 'Positive' WHEN 2 THEN 'Neutral'
  WHEN 3 THEN 'Irrelevant' ELSE 'Unknown' END AS sentiment FROM coded""")
def decode_label(spark, d):
    return _coded(spark, d).select("doc_id", labels.decode_label(F.col("Label")).alias("sentiment"))


@query("unwrap_prediction", WITH + sql.PREDICTIONS + f"""
SELECT doc_id, CASE WHEN {sql.u(7)} >= 0.1 THEN prediction::DOUBLE END AS prediction FROM predictions""")
def unwrap_prediction(spark, d):
    finished = F.when(
        fx.unit_hash(7, F.col("doc_id")) < 0.1, F.array().cast("array<string>")
    ).otherwise(F.array(F.col("prediction").cast("string")))
    rows = fx.predictions(spark, d).select("doc_id", finished.alias("prediction"))
    return rows.withColumn("prediction", labels.unwrap_prediction(F.col("prediction")))


@query("preview_rows", WITH + sql.LABELED + " SELECT doc_id, name AS label, body AS text FROM labeled ORDER BY doc_id LIMIT 20")
def preview_rows(spark, d):
    rows = fx.labeled_text(spark, d).select("doc_id", F.col("Label").alias("label"), F.col("Text").alias("text"))
    return rows.orderBy("doc_id").limit(20)


# ------------------------------------------------------------------ text cleaning

def _text_query(expression):
    return WITH + sql.NOISY + f" SELECT doc_id, {expression} AS text FROM noisy"


@query("strip_emoji", _text_query(sql.strip_emoji("body")))
def strip_emoji(spark, d):
    return fx.noisy_documents(spark, d).select("doc_id", text.strip_emoji(F.col("Text")).alias("text"))


@query("strip_urls_mentions", _text_query(sql.strip_urls_mentions("body")))
def strip_urls_mentions(spark, d):
    rows = fx.noisy_documents(spark, d).withColumnRenamed("Text", "text")
    for step in (text.strip_urls, text.strip_mentions, text.strip_unknown_token):
        rows = rows.withColumn("text", step(F.col("text")))
    return rows


@query("normalize_alpha", _text_query(sql.normalize_alpha("body")))
def normalize_alpha(spark, d):
    return fx.noisy_documents(spark, d).select("doc_id", text.normalize_alpha(F.col("Text")).alias("text"))


@query("remove_stopwords", f"""
SELECT doc_id, {sql.drop_stop_words('_t')} AS text FROM (SELECT doc_id, {sql.normalize_alpha('text')} AS _t FROM documents)""")
def remove_stopwords(spark, d):
    rows = fx.texts(spark, d).select("doc_id", text.normalize_alpha(F.col("text")).alias("text"))
    return rows.withColumn("text", text.drop_stop_words(F.col("text")))


@query("clean_text", WITH + sql.NOISY + " " + sql.clean_select("noisy", "body", "doc_id"))
def clean_text(spark, d):
    return cleaning.clean_text_column(fx.noisy_documents(spark, d)).withColumnRenamed("Text", "text")


@query("clean_text_light", WITH + sql.NOISY + f""", light AS (
  SELECT doc_id, {sql.normalize_alpha(sql.strip_links('body'))} AS text FROM noisy)
SELECT doc_id, text, trim(text) AS trimmed FROM light""")
def clean_text_light(spark, d):
    rows = fx.noisy_documents(spark, d).select("doc_id", text.clean_text_light(F.col("Text")).alias("text"))
    return rows.withColumn("trimmed", F.trim("text"))


@query("preprocess", WITH + sql.PREPROCESSED + " SELECT doc_id, label, text FROM preprocessed")
def preprocess(spark, d):
    raw = fx.labeled_text_dirty(spark, d, fx.texts(spark, d)).select("doc_id", *RAW)
    return cleaning.preprocess(raw).select("doc_id", F.col("Label").alias("label"), F.col("Text").alias("text"))

"""The three monitoring reports.  Each returns test rows; ``outcome`` says what follows from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DRIFT_SHARE, EXCLUDED_CLASS, PSI_THRESHOLD, QUALITY_TOLERANCE, TEXT_DRIFT_THRESHOLD
from ..functions.confidence import max_confidence_text
from ..functions.labels import cast_label
from ..operators.checks import (
    alert_type_of,
    drift_tests,
    failure_line,
    follow_up,
    model_quality_tests,
    shown,
    status_of,
)
from ..operators.drift import dataset_drift_share, drift_of_scores, psi_table, text_content_drift
from ..operators.profile import dataset_summary, summary_tests, text_length
from ..session import materialize


def data_drift_report(
    reference: DataFrame,
    current: DataFrame,
    categorical: Sequence[str] = ("prediction",),
    numeric: Sequence[str] = ("confidence",),
    text_col: str | None = "text",
    key_col: str = "doc_id",
    threshold: float = PSI_THRESHOLD,
    text_threshold: float = TEXT_DRIFT_THRESHOLD,
    drift_share: float = DRIFT_SHARE,
    annotation_col: str | None = None,
    text_scores: DataFrame | None = None,
) -> DataFrame:
    """One test per column and one for the share of drifted columns.

    With ``annotation_col`` the ``confidence`` comes from that printed annotation.
    The text column's test tells the batches apart by a classifier fitted on the
    way, or by ``text_scores(score, label)`` that one has stored.
    """
    if annotation_col is not None:
        reference, current = (
            df.withColumn("confidence", max_confidence_text(F.col(annotation_col))) for df in (reference, current)
        )
    columns = psi_table(reference, current, categorical, numeric, threshold)
    if text_scores is not None:
        found = drift_of_scores(text_scores, text_col or "text", text_threshold)
        columns = columns.unionByName(found.select(*columns.columns))
    elif text_col is not None:
        found = text_content_drift(reference, current, text_col, key_col, text_threshold)
        columns = columns.unionByName(found.select(*columns.columns))
    columns = materialize(columns, "drifted_columns")
    share = dataset_drift_share(columns, drift_share).select(
        F.lit("data_drift").alias("report"),
        F.lit("dataset_drift").alias("test"),
        status_of(~F.col("dataset_drift")).alias("status"),
        F.col("share").alias("value"),
        F.lit(float(drift_share)).alias("threshold"),
        F.concat(F.lit("Share of drifted columns is "), shown(F.col("share"))).alias("description"),
    )
    return drift_tests(columns).unionByName(share)


def model_drift_report(
    reference: DataFrame, current: DataFrame, tolerance: float = QUALITY_TOLERANCE, average: str = "macro"
) -> DataFrame:
    """Quality tests after both batches' labels and predictions were cast to class codes."""
    def as_codes(df: DataFrame) -> DataFrame:
        return df.withColumns({c: cast_label(F.col(c).cast("string")) for c in ("label", "prediction")})

    return model_quality_tests(as_codes(reference), as_codes(current), tolerance, average)


def _summary_rows(clean: DataFrame) -> DataFrame:
    rows = clean.withColumnsRenamed({"Label": "label", "Text": "text"})
    rows = rows.withColumn("label", cast_label(F.col("label").cast("string")))
    return rows.filter(~F.col("label").eqNullSafe(EXCLUDED_CLASS))


def dataset_summary_report(clean: DataFrame) -> DataFrame:
    """Tests of a ``(Label, Text)`` dataset without the excluded class; missing labels stay, to be seen."""
    return summary_tests(_summary_rows(clean))


def dataset_summary_profile(clean: DataFrame) -> DataFrame:
    """The profile that goes with ``dataset_summary_report``: a row per column of the same rows."""
    rows = materialize(_summary_rows(clean).select("label", "text"), "summary_rows")
    return dataset_summary(text_length(rows))


def outcome(tests: DataFrame) -> DataFrame:
    """One row per report: its tests, failures with their text block, alerts, and the request that follows.

    ``alerts`` holds what the alert log gets for each failure, in the order of
    the block.  One aggregate: a report has a fixed number of tests, one per
    check, so the lists are that short.
    """
    failed = F.col("status") == "FAIL"
    failures = F.array_sort(F.collect_list(F.when(failed, F.struct(F.col("test").alias("name"), "description"))))
    rows = tests.groupBy("report").agg(
        F.count(F.lit(1)).alias("num_tests"), F.count_if(failed).alias("num_fail"), failures.alias("alerts")
    )
    lines = F.transform("alerts", lambda x, i: failure_line(i + 1, x["name"], x["description"]))
    notify, request = follow_up(F.col("num_fail"), F.col("report"))
    return rows.select(
        "report", "num_tests", "num_fail", F.array_join(lines, "").alias("fail_info"),
        notify.alias("notify"), request.alias("request"), "alerts",
        F.when(notify, alert_type_of(F.col("report"))).alias("alert_type"),
    )

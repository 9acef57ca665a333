"""Test rows, and what is done about the failed ones: text blocks, alerts, notifications, retraining.

A test row is ``(report, test, status, value, threshold, description)``.  A
report holds one row per check, a number fixed by the code that made it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ACCURACY_GATE, ALERT_TYPES, QUALITY_TOLERANCE
from .quality import METRICS, evaluate

def status_of(passed: Column) -> Column:
    return F.when(passed, F.lit("SUCCESS")).otherwise(F.lit("FAIL"))


def shown(value: Column) -> Column:
    """Number with four decimals, for descriptions."""
    return F.round(value, 4).cast("decimal(18,4)").cast("string")


def drift_tests(columns: DataFrame, report: str = "data_drift") -> DataFrame:
    """One test per monitored column: it fails when the column has drifted."""
    return columns.select(
        F.lit(report).alias("report"),
        F.concat(F.lit("drift:"), F.col("column")).alias("test"),
        status_of(~F.col("drifted")).alias("status"),
        "value",
        "threshold",
        F.concat(
            F.lit("Drift of "), F.col("column"), F.lit(" is "),
            F.coalesce(shown(F.col("value")), F.lit("unknown, it has no values on one side")),
            F.lit(", threshold "), shown(F.col("threshold")),
        ).alias("description"),
    )


def model_quality_tests(
    reference: DataFrame,
    current: DataFrame,
    tolerance: float = QUALITY_TOLERANCE,
    average: str = "macro",
    by: Sequence[str] = (),
    report: Column | None = None,
) -> DataFrame:
    """Accuracy, precision, recall and F1 of current rows may fall at most ``tolerance`` below the reference.

    Both batches are counted in one pass and told apart by a flag.
    """
    columns = [*by, "label", "prediction"]
    sides = reference.select(F.lit("ref").alias("side"), *columns).unionByName(
        current.select(F.lit("cur").alias("side"), *columns)
    )
    scores = evaluate(sides, by=[*by, "side"], average=average)
    pairs = scores.groupBy(*by).agg(*[
        F.max(F.when(F.col("side") == side, F.col(m))).alias(f"{side}_{m}")
        for m in METRICS
        for side in ("ref", "cur")
    ])
    long = pairs.select(*by, F.inline(F.array(*[
        F.struct(
            F.lit(m).alias("test"),
            F.col(f"cur_{m}").alias("value"),
            (F.col(f"ref_{m}") * (1 - tolerance)).alias("threshold"),
        )
        for m in METRICS
    ])))
    # Rounded, so that a value exactly on the limit does not fail by its last bit.
    passed = F.round("value", 9) >= F.round("threshold", 9)
    return long.select(
        (F.lit("model_drift") if report is None else report).alias("report"),
        "test",
        status_of(passed).alias("status"),
        "value",
        "threshold",
        F.concat(
            F.col("test"), F.lit(" is "), shown(F.col("value")), F.lit(", expected at least "),
            shown(F.col("threshold")),
        ).alias("description"),
    )


def failure_line(number: Column, test: Column, description: Column) -> Column:
    """Two lines of text on a failed test."""
    return F.concat(
        number.cast("string"), F.lit(". "), test, F.lit("  FAILED\nDescription: "), description, F.lit("\n")
    )


def failed_tests(tests: DataFrame) -> DataFrame:
    """Failed tests, numbered within their report, each with its two lines of text."""
    order = Window.partitionBy("report").orderBy("test")
    numbered = tests.filter(F.col("status") == "FAIL").withColumn("no", F.row_number().over(order))
    return numbered.withColumn("line", failure_line(F.col("no"), F.col("test"), F.col("description")))


def failure_block(tests: DataFrame) -> DataFrame:
    """Per report: number of failed tests and their text block in order."""
    lines = F.array_sort(F.collect_list(F.struct("no", "line")))
    return failed_tests(tests).groupBy("report").agg(
        F.count(F.lit(1)).alias("num_fail"),
        F.array_join(F.transform(lines, lambda item: item["line"]), "").alias("fail_info"),
    )


def alerts(tests: DataFrame, alert_type: Column, recipient: str, timestamp: Column) -> DataFrame:
    """One alert per failed test, in the nested form of the alert log."""
    return tests.filter(F.col("status") == "FAIL").select(
        timestamp.alias("timestamp"),
        alert_type.alias("alert_type"),
        F.lit("Sent").alias("status"),
        F.struct(
            F.lit(recipient).alias("recipient"), F.col("test").alias("name"), F.col("description")
        ).alias("details"),
    )


def alert_documents(tests: DataFrame, alert_type: Column) -> DataFrame:
    """One flat document per failed test, for the alert table."""
    return tests.filter(F.col("status") == "FAIL").select(
        alert_type.alias("type"), F.col("test").alias("test_case"), "description", "status"
    )


def alert_type_of(kind: Column) -> Column:
    name = F.lit(None).cast("string")
    for key, value in ALERT_TYPES.items():
        name = F.when(kind == key, F.lit(value)).otherwise(name)
    return name


def follow_up(num_fail: Column, kind: Column) -> tuple[Column, Column]:
    """Whether to notify, and the retrain request of a drifted model."""
    failed = num_fail > 0
    return failed, F.when(failed & (kind == "model_drift"), F.lit("train"))


def retrain_signal(tests: DataFrame, kind: Column | None = None) -> DataFrame:
    """Per report: failed tests, whether to notify, and the retrain request of a drifted model."""
    kind = F.col("report") if kind is None else kind
    counted = tests.withColumn("kind", kind).groupBy("report", "kind").agg(
        F.count_if(F.col("status") == "FAIL").alias("num_fail")
    )
    notify, request = follow_up(F.col("num_fail"), F.col("kind"))
    return counted.select("report", "num_fail", notify.alias("notify"), request.alias("request"))


def pass_gate(rows: DataFrame, accuracy: str = "accuracy", threshold: float = ACCURACY_GATE) -> DataFrame:
    """Tag ``test_pass``: accuracy strictly above the gate; no number, no tag."""
    return rows.withColumn("test_pass", F.col(accuracy).try_cast("double") > threshold)

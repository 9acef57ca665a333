"""Sinks for datasets, splits, predictions, snapshots, reports and alerts.

All of them write from the executors, in as many files as there are tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_dataset(df: DataFrame, path: str) -> int:
    """Write the dataset and return its row count.

    The count comes from the written files' footers, so nothing is computed
    twice.  An observation would save that look too, but on this Spark version it
    stays with the session and makes later model closures unserializable.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).count()


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """All splits in one pass, one folder each."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def write_predictions(df: DataFrame, path: str, columns: Sequence[str] = ("text", "label", "prediction")) -> None:
    df.select(*columns).write.mode("overwrite").parquet(path)


def write_drift_snapshot(df: DataFrame, path: str, batch_id: str | None = None) -> None:
    """Predictions with their embeddings and annotations, nested types intact.

    With ``batch_id`` the snapshot replaces that batch's folder only.
    """
    df.write.mode("overwrite").parquet(path if batch_id is None else f"{path}/batch_id={batch_id}")


def append_report(tests: DataFrame, path: str, timestamp: Column, run_id: str) -> None:
    """Add a run's test rows as JSON documents, in one folder per run and report type.

    A run that is repeated replaces what it wrote before.
    """
    body = F.to_json(F.struct(*[c for c in tests.columns if c != "report"], timestamp.alias("timestamp")))
    rows = tests.select("report", body.alias("value"))
    rows.write.mode("overwrite").partitionBy("report").text(f"{path}/run_id={run_id}")


def append_alert_log(alerts: DataFrame, path: str, run_id: str) -> None:
    """Add a run's alerts as JSON lines; a run that is repeated replaces its own."""
    lines = alerts.select(F.to_json(F.struct(*alerts.columns)).alias("value"))
    lines.write.mode("overwrite").text(f"{path}/run_id={run_id}")

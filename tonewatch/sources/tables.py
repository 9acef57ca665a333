"""Parquet tables, dealt by a key where the caller asks for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, spread_by: str | None = None) -> DataFrame:
    """A table as it lies, or dealt by the hash of ``spread_by``, whatever its size.

    The caller names a key, unique or nearly so, where rows are taken apart and
    brought together by it again: rows that stay on their key's partition need no
    other shuffle, and a single small file no longer is one task's work.
    """
    df = spark.read.parquet(path)
    return df if spread_by is None else df.repartition(spread_by)

"""Keep an expensive column from being computed again for a filter on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pinned(df: DataFrame, column: str) -> DataFrame:
    """The same rows, with ``column`` fixed as a value.

    The optimizer moves a filter below the projection that defines its column
    and copies the definition into it.  For a chain of patterns the copy costs as
    much as the chain, and several times that where a step names its input more
    than once.  A generator of exactly one row per row is where such moves end.
    """
    names = df.columns
    value = F.explode(F.array(F.col(column))).alias("_pinned")
    rows = df.select("*", value).drop(column).withColumnRenamed("_pinned", column)
    return rows.select(*names)

"""Places of rows in their files, without a window over all rows.

A scan reads a file in splits; within one, rows come in order.  Splits are
counted, and the counts of those before raise the numbers of a split's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_FILE, _SPLIT, _ID = "_file", "_split", "_id"


def numbered(scan: DataFrame, output_col: str = "ordinal") -> DataFrame:
    """``scan``, a DataFrame as its reader gives it, with the number of each row in its file, from 0.

    The scan runs once and is written.  Only a row per split meets a window, one
    for each file; its rows then take their split's number by a join.
    """
    placed = scan.select(
        "*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_SPLIT),
        F.monotonically_increasing_id().alias(_ID),
    )
    placed = materialize(placed, "placed_rows")
    splits = placed.groupBy(_FILE, _SPLIT).agg(F.min(_ID).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(_FILE).orderBy(_SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    found = placed.join(splits, [_FILE, _SPLIT])
    return found.withColumn(output_col, F.col(_ID) - F.col("_first") + F.col("_before")).select(*scan.columns, output_col)


def drop_first_row(scan: DataFrame) -> DataFrame:
    """All rows but the first of each file, whatever it holds."""
    return numbered(scan, "_ordinal").filter("_ordinal > 0").drop("_ordinal")

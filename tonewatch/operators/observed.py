"""Row counts taken on the way: each stage of a plan is counted by the execution that runs it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import cleaning
from ..functions import labels

Stage = tuple[str, Callable[[DataFrame], DataFrame]]

#: The stages of ``cleaning.preprocess``.
PREPROCESSING: tuple[Stage, ...] = (
    ("drop_null_text", lambda df: cleaning.drop_null_text(cleaning.rename_columns(df))),
    ("filter_not_blank", lambda df: cleaning.filter_not_blank(df).drop("Product")),
    ("filter_known_label", lambda df: df.filter(F.col("Label").isin(list(labels.LABEL_CODES))).withColumn(
        "Label", labels.encode_label(F.col("Label")))),
    ("clean_text", lambda df: cleaning.filter_nonempty_length(cleaning.clean_text_column(df))),
)


def counted_stages(df: DataFrame, stages: Sequence[Stage] = PREPROCESSING) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """``df`` after all stages, and what gives ``(place, stage, rows, dropped)`` once that has been run.

    The rows that enter and leave each stage are counted where they pass, so an
    action on the result is the only execution.  A count waits for that action.
    Rows that a task read again after it was lost are counted again, which only
    the counts show.
    """
    seen = [Observation(f"stage-{i}") for i in range(len(stages) + 1)]
    spark = df.sparkSession
    df = df.observe(seen[0], F.count(F.lit(1)).alias("rows"))
    for (_, stage), own in zip(stages, seen[1:], strict=True):
        df = stage(df).observe(own, F.count(F.lit(1)).alias("rows"))

    def counts() -> DataFrame:
        rows = [x.get["rows"] for x in seen]
        named = [("input", rows[0], 0)] + [(name, n, before - n) for (name, _), n, before in zip(stages, rows[1:], rows, strict=False)]
        return spark.createDataFrame([(i, *x) for i, x in enumerate(named)], "place int, stage string, rows long, dropped long")

    return df, counts

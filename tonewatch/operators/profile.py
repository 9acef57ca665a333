"""Dataset profile: missing values, ranges, distinct values, quantiles, most common values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .checks import shown, status_of
from .running import exact_quantiles


def missing_value_count(df: DataFrame, column: str = "label") -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNull()).alias("missing"))


def text_length(df: DataFrame, text_col: str = "text", output_col: str = "Length") -> DataFrame:
    return df.withColumn(output_col, F.length(F.col(text_col)))


def min_value(df: DataFrame, column: str = "Length") -> DataFrame:
    return df.agg(F.min(column).alias("min_value"))


def dataset_summary(
    df: DataFrame,
    text: Sequence[str] = ("text",),
    categorical: Sequence[str] = ("label",),
    numeric: Sequence[str] = ("Length",),
) -> DataFrame:
    """One row per column; the numeric figures are null for text and categories.

    The table is read once into counts per distinct value, where a text is
    represented by its digest.  Everything else is worked out from the counts.
    """
    kinds = {**{c: "text" for c in text}, **{c: "categorical" for c in categorical}, **{c: "numeric" for c in numeric}}

    def entry(name: str, kind: str):
        value = F.col(name)
        return F.struct(
            F.lit(name).alias("column"),
            F.lit(kind).alias("kind"),
            (F.md5(value) if kind == "text" else value.cast("string")).alias("key"),
            (value.cast("double") if kind == "numeric" else F.lit(None).cast("double")).alias("number"),
        )

    counts = materialize(
        df.select(F.inline(F.array(*[entry(n, k) for n, k in kinds.items()])))
        .groupBy("column", "kind", "key", "number")
        .agg(F.count(F.lit(1)).alias("n")),
        "summary_counts",
    )
    present = F.col("key").isNotNull()
    base = counts.groupBy("column", "kind").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("missing"),
        F.count_if(present).alias("distinct_values"),
        F.min_by(
            F.struct("key", "n"), F.when(present, F.struct(-F.col("n"), F.col("key")))
        ).alias("top"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
        F.try_divide(
            F.sum(F.col("number") * F.col("n")), F.sum(F.when(F.col("number").isNotNull(), F.col("n")))
        ).alias("mean"),
    )
    # ``base`` has one row per column of the table.
    spread = counts.join(F.broadcast(base.select("column", "mean")), "column").groupBy("column").agg(
        F.sqrt(F.try_divide(
            F.sum(F.pow(F.col("number") - F.col("mean"), 2) * F.col("n")),
            F.sum(F.when(F.col("number").isNotNull(), F.col("n"))) - 1,
        )).alias("std")
    )
    summary = base.join(spread, "column", "left")
    quantiles = {q: F.lit(None).cast("double") for q in ("q25", "q50", "q75")}
    for name in numeric:
        own = counts.filter(F.col("column") == name)
        row = exact_quantiles(own, F.col("number"), (0.25, 0.5, 0.75), weight="n")
        found = row.select(F.struct(*quantiles)).scalar()
        quantiles = {
            q: F.when(F.col("column") == name, found[q]).otherwise(value) for q, value in quantiles.items()
        }
    most_common = F.col("top.key")
    for name in text:
        digest = summary.filter(F.col("column") == name).select("top.key").scalar()
        full = df.filter(F.md5(F.col(name)) == digest).agg(F.min(name).alias("text")).scalar()
        most_common = F.when(F.col("column") == name, full).otherwise(most_common)
    return summary.select(
        "column", "kind", "row_count", "missing", "distinct_values",
        most_common.alias("most_common"),
        F.col("top.n").alias("most_common_count"),
        "min", "max", "mean", "std",
        *[value.alias(q) for q, value in quantiles.items()],
    )


def summary_tests(
    df: DataFrame, label_col: str = "label", text_col: str = "text", report: str = "dataset_summary"
) -> DataFrame:
    """No label may be missing, and no text may be empty."""
    facts = df.agg(
        F.count_if(F.col(label_col).isNull()).cast("double").alias("missing"),
        F.min(F.length(F.col(text_col))).cast("double").alias("shortest"),
    )
    rows = facts.select(F.inline(F.array(
        F.struct(
            F.lit("missing_labels").alias("test"), F.col("missing").alias("value"),
            F.lit(0.0).alias("threshold"), (F.col("missing") <= 0).alias("passed"),
        ),
        F.struct(
            F.lit("min_length").alias("test"), F.col("shortest").alias("value"),
            F.lit(1.0).alias("threshold"), (F.col("shortest") >= 1).alias("passed"),
        ),
    )))
    return rows.select(
        F.lit(report).alias("report"),
        "test",
        status_of(F.coalesce("passed", F.lit(True))).alias("status"),
        "value",
        "threshold",
        F.concat(F.col("test"), F.lit(" is "), shown(F.col("value")), F.lit(", limit "), shown(F.col("threshold"))).alias("description"),
    )

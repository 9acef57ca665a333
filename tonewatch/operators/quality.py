"""Class distributions and classification quality.

Everything is rolled up from counts per ``(label, prediction)``.  That is one
shuffle of a handful of rows per partition, whatever the table's size and
however unevenly the classes are filled; all metrics then come from the counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("accuracy", "precision", "recall", "f1")


def label_distribution(df: DataFrame, label_col: str = "Label") -> DataFrame:
    """Rows and percent of the total per label, in label order."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("percentage", F.col("count") / total * 100).orderBy(label_col)


def split_distributions(df: DataFrame, split_col: str = "split", label_col: str = "Label") -> DataFrame:
    """:func:`label_distribution` of the whole dataset and of each split, from one pass."""
    counts = df.groupBy(split_col, label_col).agg(F.count(F.lit(1)).alias("count"))
    tagged = counts.select(
        F.explode(F.array(F.lit("dataset"), F.col(split_col))).alias(split_col), label_col, "count"
    )
    per_label = tagged.groupBy(split_col, label_col).agg(F.sum("count").alias("count"))
    totals = tagged.groupBy(split_col).agg(F.sum("count").alias("total"))
    return per_label.join(totals, split_col).select(
        split_col, label_col, "count", (F.col("count") / F.col("total") * 100).alias("percentage")
    )


def confusion_counts(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    return df.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(
    df: DataFrame, classes: Sequence[int], label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row per label, one column ``p<class>`` per predicted class."""
    cells = [
        F.count_if(F.col(prediction) == value).alias(f"p{value}") for value in classes
    ]
    return df.groupBy(F.col(label).alias("label")).agg(*cells)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def per_class(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Support, precision, recall and F1 of every class that was labelled or predicted.

    Each count adds to its label's support and to its prediction's total, so
    two entries per cell replace a self-join of the confusion table.
    """
    hit = F.col("label").eqNullSafe(F.col("prediction"))
    entries = confusion.select(
        *by,
        F.inline(F.array(
            F.struct(
                F.col("label").alias("class"),
                F.col("n").alias("support"),
                F.lit(0).cast("long").alias("predicted"),
                F.when(hit, F.col("n")).otherwise(0).alias("tp"),
            ),
            F.struct(
                F.col("prediction").alias("class"),
                F.lit(0).cast("long").alias("support"),
                F.col("n").alias("predicted"),
                F.lit(0).cast("long").alias("tp"),
            ),
        )),
    )
    totals = entries.groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp")
    )
    scored = totals.withColumns({
        "precision": _ratio(F.col("tp"), F.col("predicted")),
        "recall": _ratio(F.col("tp"), F.col("support")),
    })
    doubled = 2 * F.col("precision") * F.col("recall")
    return scored.withColumn("f1", _ratio(doubled, F.col("precision") + F.col("recall")))


def overall(classes: DataFrame, by: Sequence[str] = (), average: str = "weighted") -> DataFrame:
    """Accuracy and averaged precision, recall and F1 from :func:`per_class` rows.

    ``weighted`` weighs a class by its support, ``macro`` counts all alike.
    """
    if average == "weighted":
        def mean(name: str) -> Column:
            return F.sum(F.col(name) * F.col("support")) / F.sum("support")
    elif average == "macro":
        def mean(name: str) -> Column:
            return F.avg(name)
    else:
        raise ValueError(f"unknown average {average!r}")
    return classes.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        mean("precision").alias("precision"),
        mean("recall").alias("recall"),
        mean("f1").alias("f1"),
    )


def evaluate(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    by: Sequence[str] = (),
    average: str = "weighted",
) -> DataFrame:
    """The four quality figures of scored rows, per group of ``by``, in one pass."""
    return overall(per_class(confusion_counts(df, label, prediction, by), by), by, average)


def per_class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row per class, then the macro and the weighted average."""
    classes = per_class(confusion_counts(df, label, prediction))
    columns = ("precision", "recall", "f1", "support")
    averages = [
        classes.agg(
            F.lit(f"{kind} avg").alias("class"),
            *[weigh(F.col(c)).alias(c) for c in columns[:3]],
            F.sum("support").alias("support"),
        )
        for kind, weigh in (
            ("macro", F.avg),
            ("weighted", lambda c: F.sum(c * F.col("support")) / F.sum("support")),
        )
    ]
    rows = classes.select(F.col("class").cast("string").alias("class"), *columns)
    return rows.unionByName(averages[0]).unionByName(averages[1])


def cv_metrics_mean(trials: DataFrame, run: str = "trial") -> DataFrame:
    return trials.groupBy(run).agg(*[F.avg(m).alias(m) for m in METRICS])


def cv_metrics_max(trials: DataFrame, run: str = "trial") -> DataFrame:
    """Best value of each metric over the folds, every metric on its own."""
    return trials.groupBy(run).agg(*[F.max(m).alias(m) for m in METRICS])


def best_params(trials: DataFrame, run: str = "trial") -> DataFrame:
    """The trial with the highest mean F1 above zero; the first one wins a tie.

    Means are compared to 12 digits, so the order of summation decides nothing.
    """
    means = cv_metrics_mean(trials, run).filter(F.col("f1") > 0)
    best = means.agg(
        F.max_by(F.struct(run, "f1"), F.struct(F.round("f1", 12), -F.col(run))).alias("best")
    )
    return best.filter(F.col("best").isNotNull()).select("best.*")


def champion_challenger(
    df: DataFrame, champion: str, challenger: str, label: str = "label"
) -> DataFrame:
    """Both models' quality on the same rows, and whether the challenger is strictly better."""
    long = df.select(
        F.col(label).alias("label"),
        F.inline(F.array(
            F.struct(F.lit("production").alias("model"), F.col(champion).alias("prediction")),
            F.struct(F.lit("new").alias("model"), F.col(challenger).alias("prediction")),
        )),
    )
    scores = evaluate(long, by=["model"])
    wide = scores.agg(*[
        F.max(F.when(F.col("model") == model, F.col(m))).alias(f"{model}_{m}")
        for model in ("new", "production")
        for m in METRICS
    ])
    better = F.col("new_accuracy") > F.col("production_accuracy")
    return wide.withColumn("decision", F.when(better, F.lit("promote")).otherwise(F.lit("keep")))

"""Running totals over a whole ordered table, and what follows from them: ranks, quantiles, AUC with its interval.

An ordered window without a partition would send every row to one task.  Here
equal values are counted first, so a frequent value is one row; the rest is cut
at quantiles of a bounded sample into ranges of similar size.  Each range is summed on
its own and raised by the total of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

ROWS_PER_RANGE = 1_000_000
MIN_RANGES, MAX_RANGES = 64, 20_000
#: Rows drawn to find where ranges end; the totals are exact wherever that is.
SAMPLED_PER_RANGE = 40


def _cut_points(values: DataFrame, order_col: str) -> list[float]:
    """Ascending values, at most ``MAX_RANGES - 1``, that cut the rows into similar shares."""
    rows = values.count()
    ranges = min(max(rows // ROWS_PER_RANGE, MIN_RANGES), MAX_RANGES)
    share = min(1.0, SAMPLED_PER_RANGE * ranges / max(rows, 1))
    sample = values.select(order_col).sample(share, seed=1).toArrow()[order_col].to_pylist()
    sample = sorted(x for x in sample if x is not None)
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)} if sample else set())


def running_totals(values: DataFrame, order_col: str, weight_cols: Sequence[str]) -> DataFrame:
    """Add ``before_<w>``: the sum of ``w`` over all rows with a smaller ``order_col``.

    ``order_col`` must be a double without nulls or NaN and unique.  The input is
    read three times, so it should be a written table.
    """
    cuts = _cut_points(values, order_col)
    splits = [float("-inf"), *(cuts or [0.0]), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol=order_col, outputCol="_range").transform(values)
    within = Window.partitionBy("_range").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, so at most ``MAX_RANGES`` rows: small enough for one task and for a broadcast.
    totals = ranged.groupBy("_range").agg(*[F.sum(w).alias(f"_{w}") for w in weight_cols])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range", *[F.coalesce(F.sum(f"_{w}").over(earlier), F.lit(0)).alias(f"_{w}") for w in weight_cols]
    )
    inside = ranged.withColumns(
        {f"before_{w}": F.coalesce(F.sum(w).over(within), F.lit(0)) for w in weight_cols}
    )
    joined = inside.join(F.broadcast(offsets), "_range")
    return joined.withColumns(
        {f"before_{w}": F.col(f"before_{w}") + F.col(f"_{w}") for w in weight_cols}
    ).drop("_range", *[f"_{w}" for w in weight_cols])


def value_counts(df: DataFrame, value: Column, weight: str | None = None) -> DataFrame:
    """How often each value occurs; nulls and NaN are no values."""
    times = F.lit(1).cast("long") if weight is None else F.col(weight)
    rows = df.select(value.cast("double").alias("value"), times.alias("n"))
    counts = rows.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return counts.groupBy("value").agg(F.sum("n").alias("n"))


def exact_quantiles(
    df: DataFrame, value: Column, probabilities: Sequence[float], weight: str | None = None
) -> DataFrame:
    """Quantiles with linear interpolation between neighbours: one row, columns ``q<percent>``."""
    counts = materialize(value_counts(df, value, weight), "value_counts")
    ranked = running_totals(counts, "value", ["n"])
    last = counts.agg(F.sum("n") - 1).scalar()

    def at(position: Column) -> Column:
        covered = (F.col("before_n") <= position) & (position < F.col("before_n") + F.col("n"))
        return F.max(F.when(covered, F.col("value")))

    columns = []
    for p in probabilities:
        place = last * F.lit(float(p))
        low, high = at(F.floor(place)), at(F.ceil(place))
        columns.append((low + (high - low) * F.max(place - F.floor(place))).alias(f"q{round(p * 100)}"))
    return ranked.agg(*columns)


def _score_counts(scores: DataFrame, score: str, label: str) -> DataFrame:
    positive = F.col(label) == 1
    counts = (
        scores.groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    )
    return materialize(counts, "score_counts")


def roc_auc(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Exact area under the ROC curve of 0/1 labels; ties count half."""
    ranked = running_totals(_score_counts(scores, score, label), "score", ["neg"])
    wins = F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)
    return ranked.agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.try_divide(F.sum(wins), F.sum("pos") * F.sum("neg")).alias("auc"),
    )


def auc_interval(scores: DataFrame, score: str = "score", label: str = "label", confidence: float = 0.99) -> DataFrame:
    """``positives, negatives, auc, std, low, high``: the AUC and its two-sided interval by DeLong's variance.

    A positive's placement is the share of negatives below it, a negative's the
    share of positives above it, ties half; both follow from the running totals
    over equal scores.  The variance is that of the mean placements.  Null with
    fewer than two rows on a side; rows without score or label are left out.
    """
    known = scores.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    counts = _score_counts(known, score, label)
    sizes = counts.agg(F.sum("pos").alias("m"), F.sum("neg").alias("n"))
    m, n = sizes.select("m").scalar(), sizes.select("n").scalar()
    ranked = running_totals(counts, "score", ["neg", "pos"])
    of_positive = F.try_divide(F.col("before_neg") + F.col("neg") / 2, n)
    of_negative = F.try_divide(m - F.col("before_pos") - F.col("pos") / 2, m)
    placed = ranked.select("pos", "neg", of_positive.alias("p"), of_negative.alias("q"))

    def variance(times: str, value: str, size: Column) -> Column:
        # Around a half, where placements of like batches lie, so that little is lost in the difference.
        first, second = F.sum(F.col(times) * (F.col(value) - 0.5)), F.sum(F.col(times) * (F.col(value) - 0.5) ** 2)
        return F.try_divide(F.greatest(second - F.try_divide(first * first, size), F.lit(0.0)), size - 1)

    figures = placed.agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        F.try_divide(F.sum(F.col("pos") * F.col("p")), F.sum("pos")).alias("auc"),
        F.sqrt(
            F.try_divide(variance("pos", "p", F.sum("pos")), F.sum("pos"))
            + F.try_divide(variance("neg", "q", F.sum("neg")), F.sum("neg"))
        ).alias("std"),
    )
    reach = F.lit(NormalDist().inv_cdf(0.5 + confidence / 2)) * F.col("std")
    known = F.col("std").isNotNull()
    return figures.withColumns({
        "low": F.when(known, F.greatest(F.col("auc") - reach, F.lit(0.0))),
        "high": F.when(known, F.least(F.col("auc") + reach, F.lit(1.0))),
    })

"""Profiles that are merged instead of computed again: a stored state per batch and column.

A state has the exact counts, sums and ranges of its rows, and three sketches of
bounded size: distinct values, quantiles, and the most frequent values.  States
of any batches merge into the state of all their rows, in any order, so a
profile of a year of batches reads a few kilobytes a batch and column.  What the
sketches may be off by comes with the figures; ``profile.dataset_summary`` is
the exact form.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import PSI_ZERO_SHARE

#: Sizes of the sketches: 2 to this power cells, items of a quantile sketch, values that are tracked.
HLL_POWER, KLL_ITEMS, TRACKED = 14, 800, 4096
#: Three standard errors of the number of distinct values, and the error of a rank that holds 99 times in 100.
DISTINCT_ERROR = 3 * 1.04 / math.sqrt(1 << HLL_POWER)
RANK_ERROR = 2.296 / KLL_ITEMS**0.9723
#: The share of all rows that the count of a frequent value may be off by.
COUNT_ERROR = 3.5 / (1 << math.ceil(math.log2(TRACKED / 0.75)))

_EXACT = ("rows", "missing", "numbers", "total", "squares", "low", "high")


def batch_states(
    df: DataFrame, batch: Column, text: Sequence[str] = (), categorical: Sequence[str] = (), numeric: Sequence[str] = ()
) -> DataFrame:
    """A state per batch and column: ``batch, column, kind``, exact figures, ``values``, ``quantiles``, ``frequent``.

    One pass, in which tasks combine what they have first.  A text is told apart
    by its digest; NaN and infinities count as missing; an empty table gives no states.
    """
    kinds = {**dict.fromkeys(text, "text"), **dict.fromkeys(categorical, "categorical"), **dict.fromkeys(numeric, "numeric")}

    def entry(name: str, kind: str) -> Column:
        value, number = F.col(name), F.lit(None).cast("double")
        if kind == "numeric":
            number = F.when(F.abs(value.cast("double")) < float("inf"), value.cast("double"))
            key = number.cast("string")
        else:
            key = F.md5(value.cast("string")) if kind == "text" else value.cast("string")
        return F.struct(F.lit(name).alias("column"), F.lit(kind).alias("kind"), key.alias("key"), number.alias("number"))

    rows = df.select(batch.cast("string").alias("batch"), F.inline(F.array(*[entry(n, k) for n, k in kinds.items()])))
    number = F.col("number")
    return rows.groupBy("batch", "column", "kind").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("key").isNull()).alias("missing"), F.count(number).alias("numbers"),
        F.coalesce(F.sum(number), F.lit(0.0)).alias("total"), F.coalesce(F.sum(number * number), F.lit(0.0)).alias("squares"),
        F.min(number).alias("low"), F.max(number).alias("high"),
        F.hll_sketch_agg("key", HLL_POWER).alias("values"),
        F.kll_sketch_agg_double(number, F.lit(KLL_ITEMS)).alias("quantiles"),
        F.expr(f"approx_top_k_accumulate(key, {TRACKED})").alias("frequent"),
    )


def merged(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One state per column and group of ``by``, of all rows that the states were made of."""
    return states.groupBy(*by, "column", "kind").agg(
        *[F.sum(c).alias(c) for c in _EXACT[:5]], F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_union_agg("values").alias("values"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent"),
    )


def profile(states: DataFrame, probabilities: Sequence[float] = (0.25, 0.5, 0.75), top: int = 5) -> DataFrame:
    """What states say of their rows: exact figures, then sketched ones with what they may be off by.

    ``distinct_values`` within a share of ``distinct_error``; ``q..``, values whose
    rank is within ``rank_error`` of the one asked for; ``frequent``, the ``top``
    values whose counts are at most ``count_error`` rows off.  Null where a column
    has no numbers.
    """
    known = F.col("numbers") > 0
    mean = F.try_divide(F.col("total"), F.col("numbers"))
    variance = F.try_divide(F.col("squares") - F.col("numbers") * mean * mean, F.col("numbers") - 1)
    quantiles = [
        F.when(known, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p)))).alias(f"q{round(p * 100)}") for p in probabilities
    ]
    others = [c for c in states.columns if c not in (*_EXACT, "values", "quantiles", "frequent")]
    return states.select(
        *others, F.col("rows").alias("row_count"), "missing", F.col("low").alias("min"), F.col("high").alias("max"),
        mean.alias("mean"), F.when(variance.isNotNull(), F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("std"),
        F.hll_sketch_estimate("values").alias("distinct_values"), F.lit(DISTINCT_ERROR).alias("distinct_error"),
        *quantiles, F.when(known, F.lit(RANK_ERROR)).alias("rank_error"),
        F.expr(f"approx_top_k_estimate(frequent, {top})").alias("frequent"),
        F.ceil(F.col("rows") * COUNT_ERROR).alias("count_error"),
    )


def psi_numeric(reference: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """PSI of a numeric column between two merged states, over equal-width bins of their common range.

    ``value`` is off by what ``rank_error`` allows each share; no row without numbers on a side.
    """
    def side(states: DataFrame, name: str) -> DataFrame:
        own = states.filter((F.col("column") == column) & (F.col("numbers") > 0))
        return own.select("column", *[F.col(c).alias(f"{name}_{c}") for c in ("low", "high", "quantiles")])

    both = side(reference, "r").join(side(current, "c"), "column")
    ends = both.select(F.least("r_low", "c_low"), F.greatest("r_high", "c_high")).first()  # a rank is asked for at constants only
    low, high = ends or (0.0, 0.0)
    edges = [low + (high - low) * i / bins for i in range(1, bins)]

    def shares(sketch: str) -> list[Column]:
        ranks = [F.lit(0.0), *[F.kll_sketch_get_rank_double(F.col(sketch), F.lit(float(x))) for x in edges], F.lit(1.0)]
        return [F.greatest(b - a, F.lit(PSI_ZERO_SHARE)) for a, b in zip(ranks, ranks[1:], strict=False)]

    parts = [(r - c) * F.log(r / c) for r, c in zip(shares("r_quantiles"), shares("c_quantiles"), strict=True)]
    return both.select("column", sum(parts, F.lit(0.0)).alias("value"), F.lit(RANK_ERROR).alias("rank_error"))

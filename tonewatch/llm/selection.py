"""The k-th largest value of a column, without a sort of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BINS = 4096
#: So few values are sorted by one task.
_SORTED = 20_000


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """Exactly the ``k``-th largest of a double column without null or NaN; None if there are fewer.

    Counts in equal bins show in which bin it lies; that bin is cut again, until
    few values are left or all of them are equal.
    """
    values = df.select(F.col(column).alias("x"))
    low, high, number = values.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if not 1 <= k <= number:
        return None
    while number > _SORTED and low < high:
        width = (high - low) / _BINS
        place = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(width)), F.lit(_BINS - 1))
        within = values.filter(F.col("x").between(low, high))
        bins = within.groupBy(place.alias("bin")).agg(F.count("*"), F.min("x"), F.max("x")).collect()
        for _, n, least, most in sorted(bins, reverse=True):  # at most ``_BINS`` rows
            if k <= n:
                low, high, number = least, most, n
                break
            k -= n
    if low == high:
        return low
    rest = values.filter(F.col("x").between(low, high)).orderBy(F.desc("x")).limit(k)
    return rest.agg(F.min("x")).first()[0]

"""Distribution drift between a reference batch and a current batch."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    DRIFT_CONFIDENCE,
    DRIFT_SHARE,
    MAX_DISCRETE_VALUES,
    PSI_THRESHOLD,
    PSI_ZERO_SHARE,
    TEXT_DRIFT_THRESHOLD,
)
from ..functions.hashing import unit_hash
from ..session import materialize, without_session
from .features import feature_tokens
from .running import auc_interval

_HASH_BITS = 32768


def _both_sides(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    return (
        reference.select(F.lit(True).alias("_ref"), *columns)
        .unionByName(current.select(F.lit(False).alias("_ref"), *columns))
    )


def _finite(name: str) -> Column:
    """The column as a number; NaN and infinities count as missing."""
    value = F.col(name).cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def _numeric_stats(sides: DataFrame, columns: Sequence[str], max_discrete: int) -> dict:
    """Range, size and a lower bound of the reference's distinct values: one row for all columns.

    The bound counts the hash slots that were hit.  Different slots hold
    different values, so more than 20 slots prove more than 20 values without
    shuffling the values themselves.
    """
    aggregates = []
    for name in columns:
        value = _finite(name)
        slot = F.when(F.col("_ref"), F.pmod(F.xxhash64(value), F.lit(_HASH_BITS)))
        aggregates += [
            F.min(value).alias(f"lo_{name}"),
            F.max(value).alias(f"hi_{name}"),
            F.count(value).alias(f"n_{name}"),
            F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(slot))).alias(f"slots_{name}"),
        ]
    stats = sides.agg(*aggregates).first().asDict()
    for name in columns:
        stats[f"distinct_{name}"] = stats[f"slots_{name}"]
    unsure = [name for name in columns if stats[f"slots_{name}"] <= max_discrete]
    if unsure:  # few slots may hold many values: one more pass for all such columns
        exact = [F.count_distinct(_finite(name)).alias(f"distinct_{name}") for name in unsure]
        stats.update(sides.filter("_ref").agg(*exact).first().asDict())
    return stats


def _numeric_key(name: str, stats: dict, max_discrete: int) -> tuple[Column, int | None]:
    """Bin number as the key, or the value itself where the reference has few values."""
    value = _finite(name)
    if not stats[f"n_{name}"]:
        return F.lit(None).cast("string"), None
    if stats[f"distinct_{name}"] <= max_discrete:
        return value.cast("string"), None
    low, high = stats[f"lo_{name}"], stats[f"hi_{name}"]
    bins = math.ceil(math.log2(stats[f"n_{name}"]) + 1)
    width = (high - low) / bins
    number = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    # ``least`` skips nulls, so a missing value must be kept out of the last bin.
    return F.when(value.isNotNull(), number).cast("string"), bins


def _zero_fill(smallest: Column) -> Column:
    return F.when(smallest <= PSI_ZERO_SHARE, smallest / 1e6).otherwise(F.lit(PSI_ZERO_SHARE))


def psi_table(
    reference: DataFrame,
    current: DataFrame,
    categorical: Sequence[str] = (),
    numeric: Sequence[str] = (),
    threshold: float = PSI_THRESHOLD,
    max_discrete: int = MAX_DISCRETE_VALUES,
) -> DataFrame:
    """Population stability index of each column: ``(column, value, threshold, drifted)``.

    All columns are counted in one pass over the two batches, and only counts
    per bin or category are shuffled.  A column without values on one side has a
    null value and counts as drifted.  A numeric column whose reference has at
    most ``max_discrete`` distinct values is taken by value, any other in bins.
    """
    numeric = list(numeric)
    sides = _both_sides(reference, current, [*categorical, *numeric])
    stats = _numeric_stats(sides, numeric, max_discrete) if numeric else {}
    keys: dict[str, tuple[Column, int | None]] = {
        name: (F.col(name).cast("string"), None) for name in categorical
    }
    keys.update({name: _numeric_key(name, stats, max_discrete) for name in numeric})

    entries = F.array(*[
        F.struct(F.lit(name).alias("column"), key.alias("key")) for name, (key, _) in keys.items()
    ])
    cells = (
        sides.select("_ref", F.inline(entries))
        .filter(F.col("key").isNotNull())
        .groupBy("column", "key")
        .agg(F.count_if(F.col("_ref")).alias("ref"), F.count_if(~F.col("_ref")).alias("cur"))
    )
    # One row per monitored column, a number fixed by the call.
    totals = cells.groupBy("column").agg(
        F.sum("ref").alias("ref_total"),
        F.sum("cur").alias("cur_total"),
        F.min(F.when(F.col("ref") > 0, F.col("ref"))).alias("ref_min"),
        F.min(F.when(F.col("cur") > 0, F.col("cur"))).alias("cur_min"),
        F.count(F.lit(1)).alias("seen"),
    )
    totals = totals.select(
        "column", "ref_total", "cur_total", "seen",
        _zero_fill(F.col("ref_min") / F.col("ref_total")).alias("ref_fill"),
        _zero_fill(F.col("cur_min") / F.col("cur_total")).alias("cur_fill"),
    )
    shares = cells.join(F.broadcast(totals), "column").withColumns({
        "r": F.when(F.col("ref") == 0, F.col("ref_fill")).otherwise(F.col("ref") / F.col("ref_total")),
        "c": F.when(F.col("cur") == 0, F.col("cur_fill")).otherwise(F.col("cur") / F.col("cur_total")),
    })

    def term(r: str, c: str) -> Column:
        return (F.col(r) - F.col(c)) * F.ln(F.col(r) / F.col(c))

    bin_count = F.lit(None).cast("int")
    for name, (_, bins) in keys.items():
        if bins is not None:
            bin_count = F.when(F.col("column") == name, F.lit(bins)).otherwise(bin_count)
    summed = shares.groupBy("column").agg(
        F.sum(term("r", "c")).alias("seen_part"),
        # Bins that are empty on both sides still differ by their two fill values.
        F.max(term("ref_fill", "cur_fill")).alias("empty_term"),
        F.max("seen").alias("seen"),
    )
    empty_bins = F.coalesce(bin_count - F.col("seen"), F.lit(0))
    monitored = sides.sparkSession.createDataFrame([(name,) for name in keys], "column string")
    return monitored.join(summed, "column", "left").select(
        "column",
        (F.col("seen_part") + empty_bins * F.col("empty_term")).alias("value"),
        F.lit(float(threshold)).alias("threshold"),
    ).withColumn("drifted", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(True)))


def psi_categorical(reference: DataFrame, current: DataFrame, column: str, threshold: float = PSI_THRESHOLD) -> DataFrame:
    return psi_table(reference, current, categorical=[column], threshold=threshold)


def psi_numeric(reference: DataFrame, current: DataFrame, column: str, threshold: float = PSI_THRESHOLD) -> DataFrame:
    return psi_table(reference, current, numeric=[column], threshold=threshold)


def text_vectors(
    docs: DataFrame, text_col: str = "text", vector_col: str = "text_vector", num_features: int = 2**14
) -> DataFrame:
    """``docs`` with hashed word counts in place of the text, written once for any number of comparisons.

    Rows without a text are left out, as in every comparison of texts.
    """
    others = F.struct(*docs.drop(text_col).columns).alias("_others")  # which may be named like those of the words
    texts = docs.select(others, F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())
    kept = feature_tokens(texts, "_text")
    hashed = HashingTF(inputCol="filtered_words", outputCol=vector_col, numFeatures=num_features).transform(kept)
    return materialize(hashed.select("_others.*", vector_col), "text_vectors")


def domain_scores(
    reference: DataFrame,
    current: DataFrame,
    text_col: str,
    key_col: str,
    num_features: int = 2**14,
    seed: int = 7,
    vector_col: str | None = None,
) -> DataFrame:
    """Held-out ``(score, label)`` rows of a classifier that tells current from reference texts.

    With ``vector_col`` both batches are rows of ``text_vectors``, whose texts are not hashed again.
    """
    column = text_col if vector_col is None else vector_col
    both = (
        reference.select(F.col(key_col).alias("key"), F.col(column).alias("content"), F.lit(0.0).alias("label"))
        .unionByName(
            current.select(F.col(key_col).alias("key"), F.col(column).alias("content"), F.lit(1.0).alias("label"))
        )
    )
    if vector_col is None:
        vectors = text_vectors(both, "content", "counts", num_features)
    else:
        vectors = both.withColumnRenamed("content", "counts").filter(F.col("counts").isNotNull())
    in_train = unit_hash(seed, F.col("key")) < 0.5
    model = Pipeline(stages=[
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label", maxIter=20, regParam=0.01),
    ]).fit(vectors.filter(in_train))
    model = without_session(vectors.sparkSession, model)
    scored = model.transform(vectors.filter(~in_train))
    return scored.select(vector_to_array("probability")[1].alias("score"), F.col("label").cast("int").alias("label"))


def drift_of_scores(
    scores: DataFrame, column: str = "text", threshold: float = TEXT_DRIFT_THRESHOLD, confidence: float = DRIFT_CONFIDENCE
) -> DataFrame:
    """Drift by the AUC of ``scores(score, label)`` that tell current rows (1) from reference rows.

    The column has drifted when the whole interval lies above the threshold, so
    that chance alone fires once in ``2 / (1 - confidence)`` batches at 0.5.  With
    fewer than two rows on a side there is no interval and no verdict but null.
    """
    found = auc_interval(scores, confidence=confidence)
    return found.select(
        F.lit(column).alias("column"), F.col("auc").alias("value"), F.lit(float(threshold)).alias("threshold"),
        (F.col("low") > threshold).alias("drifted"), "low", "high",
    )


def text_content_drift(
    reference: DataFrame,
    current: DataFrame,
    text_col: str = "text",
    key_col: str = "doc_id",
    threshold: float = TEXT_DRIFT_THRESHOLD,
    confidence: float = DRIFT_CONFIDENCE,
    vector_col: str | None = None,
) -> DataFrame:
    """Drift of a text column: the domain classifier's AUC on held-out rows, with DeLong's interval.

    0.5 means that the batches cannot be told apart.  Where a text is in several
    comparisons, ``text_vectors`` spares hashing it for each; ``vector_col`` is its column.
    """
    scores = domain_scores(reference, current, text_col, key_col, vector_col=vector_col)
    return drift_of_scores(scores, text_col, threshold, confidence)


def drifted_terms(
    reference: DataFrame, current: DataFrame, words_col: str = "words", prior: float = 0.01, least_z: float = 0.0
) -> DataFrame:
    """What drifted in a text column: ``(term, reference, current, log_odds, z)`` of each term.

    The log odds of a term in the current batch over those in the reference, both
    pulled towards the term's share in the two together by a Dirichlet prior that
    weighs ``prior`` times what the two hold, so that a rare term needs
    more to stand out.  ``z`` is in standard deviations; positive terms are more
    frequent now.  Terms with ``abs(z) < least_z`` are left out.  Terms are counted
    in one pass that combines first; empty batches and null words give no terms.
    """
    sides = reference.select(F.lit(0).alias("side"), words_col).unionByName(current.select(F.lit(1).alias("side"), words_col))
    terms = sides.select("side", F.explode(words_col).alias("term")).filter("term IS NOT NULL")
    counts = materialize(terms.groupBy("term").agg(
        F.count_if(F.col("side") == 0).alias("reference"), F.count_if(F.col("side") == 1).alias("current")
    ), "term_counts")
    sizes = counts.agg(F.sum("reference").alias("r"), F.sum("current").alias("c"))
    r, c = sizes.select("r").scalar(), sizes.select("c").scalar()
    weight = prior * (F.col("reference") + F.col("current"))

    def log_odds(own: Column, size: Column) -> Column:
        # Null for the only term there is, whose odds say nothing.
        return F.log(F.try_divide(own + weight, size + prior * (r + c) - own - weight))

    odds = log_odds(F.col("current"), c) - log_odds(F.col("reference"), r)
    spread = F.sqrt(1 / (F.col("current") + weight) + 1 / (F.col("reference") + weight))
    found = counts.withColumn("log_odds", F.coalesce(odds, F.lit(0.0))).withColumn("z", F.col("log_odds") / spread)
    return found.filter(F.abs("z") >= least_z)


def dataset_drift_share(columns: DataFrame, drift_share: float = DRIFT_SHARE) -> DataFrame:
    """Share of drifted columns and the verdict on the dataset."""
    return columns.agg(
        F.count(F.lit(1)).alias("columns"),
        F.count_if(F.col("drifted")).alias("drifted_columns"),
        F.avg(F.col("drifted").cast("int")).alias("share"),
    ).withColumn("dataset_drift", F.col("share") >= drift_share)

"""Mix sources to target weights by Poisson replication; built-in expressions only.

A document of a source that is to be repeated at rate ``r`` occurs a
Poisson(``r``) number of times.  The number is the quantile of a uniform number
that a hash of the seed, the id and the text gives, so each document is settled
on its own: no counters, no state, and the same result however often a task is
run.  A rate above ``DRAW_RATE`` is the sum of several draws, which keeps the
tables of the distribution short.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.pinning import pinned
from ..session import materialize
from .common import require

DRAW_RATE = 16.0
#: A Poisson number of mean 16 is above this less than once in 10**20 draws.
MOST_PER_DRAW = 80
SEED = "mix"

ADDED = ("copy", "copies", "rate", "shuffle_key")


def _uniform(digest: Column) -> Column:
    """Uniform number in [0, 1) from the first 52 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _cumulative(rate: Column) -> Column:
    """Poisson probabilities of at most 0, 1, ... ``MOST_PER_DRAW``."""
    none = F.exp(-rate)
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(MOST_PER_DRAW)),
        F.struct(none.alias("p"), F.array(none).alias("c")),
        lambda acc, k: F.struct(
            (acc["p"] * rate / k).alias("p"),
            F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * rate / k)).alias("c"),
        ),
    )
    return grown["c"]


def rates(docs: DataFrame, targets: Mapping[str, float] | None, source_col: str, text_col: str) -> DataFrame:
    """``(source, rate)``: how often each source's documents are to occur on average.

    The expected size in characters of the mixture is that of ``docs``; a
    source's share of it is its target weight over the sum of the weights of the
    sources there are.  A source without characters keeps rate 1.
    """
    length = F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("__source")).agg(F.sum(length).alias("__size"))
    if targets is None:
        weighted = sizes.withColumn("__weight", F.lit(1))
    else:
        weights = docs.sparkSession.createDataFrame(list(targets.items()), "__name string, __weight double")
        weighted = sizes.join(weights, F.col("__source").eqNullSafe(F.col("__name")), "left").fillna(0.0, ["__weight"])
    weighted = materialize(weighted, "source_sizes")  # a row per source
    total, weights = weighted.agg(F.coalesce(F.sum("__size"), F.lit(0)), F.sum("__weight")).first()
    rate = F.lit(total) * F.col("__weight") / (F.lit(weights) * F.col("__size"))
    return weighted.select("__source", F.when(F.col("__size") > 0, rate).otherwise(1.0).alias("__rate"))


def mix(
    docs: DataFrame, targets: Mapping[str, float] | None = None, seed: str = SEED, id_col: str = "doc_id",
    source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """Each row of ``docs`` as often as its source's target rate asks for, in a random order.

    Adds ``copy`` (from 1), ``copies``, ``rate`` and ``shuffle_key``: partitions
    are dealt by the hash of the key and sorted by it.  ``targets`` gives weights
    by source; a source it does not name has none and goes; without ``targets``
    all sources weigh the same.  A null source is a source of its own (weight
    under the name ``None``); null texts count as empty; rows that are alike in
    id and text are repeated alike; an empty table stays empty.  Columns of
    ``docs`` named like added ones are replaced.
    """
    require(docs, [id_col, source_col, text_col])
    kept = [c for c in docs.columns if c not in ADDED]
    if any(c.startswith("__") for c in docs.columns):  # names of steps on the way
        plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
        named = dict(zip(docs.columns, plain.columns, strict=True))
        mixed = mix(plain, targets, seed, named[id_col], named[source_col], named[text_col])
        return mixed.select(*[F.col(named[c]).alias(c) for c in kept], *ADDED)
    tables = rates(docs, targets, source_col, text_col).withColumns({
        "__draws": F.ceil(F.col("__rate") / DRAW_RATE),
    })
    tables = tables.withColumn("__cdf", _cumulative(F.col("__rate") / F.greatest("__draws", F.lit(1))))
    rated = docs.select(*kept).join(tables, F.col(source_col).cast("string").eqNullSafe(F.col("__source")))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), name, F.lit("|"), text).cast("binary"))
    drawn = rated.withColumn("__digest", digest)
    uniforms = F.transform(
        F.sequence(F.lit(1), F.greatest(F.col("__draws").cast("int"), F.lit(1))),
        lambda j: _uniform(F.md5(F.concat(F.col("__digest"), F.lit("/"), j.cast("string")).cast("binary"))),
    )
    copies = F.aggregate(
        uniforms, F.lit(0), lambda n, u: n + F.size(F.filter("__cdf", lambda c: c <= u))
    )
    counted = pinned(drawn.withColumn("copies", copies), "copies").filter("copies > 0")
    copied = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    key = F.md5(F.concat(F.col("__digest"), F.lit("#"), F.col("copy").cast("string")).cast("binary"))
    keyed = copied.withColumn("shuffle_key", F.conv(F.substring(key, 1, 15), 16, 10).cast("long"))
    mixed = keyed.select(*kept, "copy", "copies", F.col("__rate").alias("rate"), "shuffle_key")
    return mixed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mix_rows(docs: DataFrame, targets: Mapping[str, float] | None = None, **names) -> DataFrame:
    """``mix`` with the columns of ``docs`` alone, whatever they are called."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    named = dict(zip(docs.columns, plain.columns, strict=True))
    columns = {k: named[names.get(k, v)] for k, v in (("id_col", "doc_id"), ("source_col", "source"), ("text_col", "text"))}
    return mix(plain, targets, names.get("seed", SEED), **columns).select(*plain.columns).toDF(*docs.columns)


def mixing_sql(columns: str, seed: str = SEED) -> str:
    """DuckDB's statement of ``mix`` without targets over ``documents``."""
    return f"""
WITH sizes AS (
  SELECT source, sum(coalesce(length(text), 0))::BIGINT AS size FROM documents GROUP BY source
), rated AS (
  SELECT source, CASE WHEN size > 0 THEN (sum(size) OVER ())::BIGINT * 1 / ((count(*) OVER ()) * size) ELSE 1.0 END AS rate
  FROM sizes
), draws AS (
  SELECT source, rate, ceil(rate / {DRAW_RATE})::INT AS draws FROM rated
), steps AS (
  SELECT source, rate, draws, rate / greatest(draws, 1) AS mean, unnest(range(0, {MOST_PER_DRAW + 1})) AS k FROM draws
), terms AS (
  SELECT source, rate, draws, k,
         exp(-mean) * coalesce(product(mean / k) FILTER (k > 0)
           OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING), 1) AS p
  FROM steps
), cumulative AS (
  SELECT source, any_value(rate) AS rate, any_value(draws) AS draws, list(c ORDER BY k) AS cdf
  FROM (SELECT *, sum(p) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM terms)
  GROUP BY source
), digests AS (
  SELECT d.*, rate, draws, cdf,
         md5('{seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS digest
  FROM documents d JOIN cumulative s ON d.source IS NOT DISTINCT FROM s.source
), uniforms AS (
  SELECT *, list_transform(range(1, greatest(draws, 1) + 1),
    lambda j: ('0x' || substr(md5(digest || '/' || j::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE) AS us
  FROM digests
), counted AS (
  SELECT *, list_sum(list_transform(us, lambda u: len(list_filter(cdf, lambda c: c <= u))))::INT AS copies FROM uniforms
), copied AS (
  SELECT *, unnest(range(1, copies + 1))::INT AS copy FROM counted WHERE copies > 0
)
SELECT {columns}, copy, copies, rate,
       ('0x' || substr(md5(digest || '#' || copy::VARCHAR), 1, 15))::BIGINT AS shuffle_key
FROM copied"""

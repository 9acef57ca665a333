"""What each of several filters removes in every order they may be applied in, by sorted posting lists.

A document's failing filters are settled where its text lies.  Rows are then
dealt by ranges of ids; a task keeps, per part, the sorted list of failing ids
of each filter over a bounded stretch of its range, and merges these lists.  What
a filter removes depends only on which filters came before it, not on their
order, so 16 differences per filter answer all 120 orders of five.  The sizes are
summed over stretches; no list leaves its task.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import Batches, arrow_map, partitions_for, require

FILTERS = "ABCDE"
#: The characters of filters C and D, and the bounds of A, B and C.
UPPER = string.ascii_uppercase.encode()
SYMBOLS = b"#$%&*|"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
UPPER_PERCENT = 10

GOOD, TOXIC = 1, 2
MARKS = (GOOD, TOXIC)
#: Rows whose lists a task holds at once, and rows dealt to one task.
_STRETCH = 1 << 18
_ROWS_PER_TASK = 1_000_000

_FLAGS = "doc_id long, part string, text_key binary, failed int"
_SUMS = "part string, before int, filter int, kept long, removed long, good_lost long, toxic_lost long"


def _failed(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    raw = text.encode()
    words = raw.split()  # bytes are parted at ASCII white space only
    upper = len(raw) - len(raw.translate(None, UPPER))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * upper > UPPER_PERCENT * len(text)) << 2
        | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3
    )


def _flags(batches: Batches) -> Batches:
    for batch in batches:
        texts = batch["text"].to_pylist()
        keys = [hashlib.blake2b(x.encode(), digest_size=16).digest() for x in texts]
        failed = pa.array([_failed(x) for x in texts], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["part"], pa.array(keys, pa.binary()), failed], ["doc_id", "part", "text_key", "failed"]
        )


def failing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(doc_id, part, failed)`` of every row; bit ``i`` of ``failed`` is the filter ``FILTERS[i]``.

    Fewer than 100 words; under 80 % distinct words; over 10 % ``A-Z``; a symbol
    of ``#$%&*|``; a text that a smaller id has too, anywhere in the table.  Null
    texts are empty, a null part is the empty string.  A row without id neither
    is such a repeat nor makes one of another; rows of one id never repeat each
    other.  Other columns of ``docs`` are not read.
    """
    require(docs, [id_col, text_col, part_col])
    nothing = F.lit("")
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), nothing).alias("part"),
        F.coalesce(F.col(text_col).cast("string"), nothing).alias("text"),
    )
    flags = materialize(arrow_map(texts, _flags, _FLAGS), "filter_flags")
    # The first of each text, found by an aggregate that combines first, then met again by its own id:
    # no task sees all copies of a text.
    first = flags.groupBy("text_key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    found = flags.join(first, ["doc_id", "text_key"], "left")
    repeat = F.col("first").isNull() & F.col("doc_id").isNotNull()
    bit = 1 << FILTERS.index("E")
    return found.select("doc_id", "part", F.when(repeat, F.col("failed") + bit).otherwise(F.col("failed")).alias("failed"))


def without(ids: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Sorted ``ids`` that sorted ``others`` lack; the shorter list gallops through the longer."""
    if not len(ids) or not len(others):
        return ids
    if len(ids) <= len(others):
        at = np.minimum(np.searchsorted(others, ids), len(others) - 1)
        return ids[others[at] != ids]
    at = np.minimum(np.searchsorted(ids, others), len(ids) - 1)
    stays = np.ones(len(ids), bool)
    stays[at[ids[at] == others]] = False
    return ids[stays]


def merged(lists: Sequence[np.ndarray]) -> np.ndarray:
    """Sorted union of sorted lists; each gallops through what the longer ones have given."""
    found, *rest = sorted(lists, key=len, reverse=True)
    for other in rest:
        new = without(other, found)
        if len(new):
            found = np.insert(found, np.searchsorted(found, new), new)
    return found


def _stretch_sums(failed: np.ndarray, marks: np.ndarray, number: int) -> np.ndarray:
    """Per set of earlier filters and filter: rows kept, removed, and removed with each mark."""
    lists = [np.flatnonzero(failed >> i & 1) for i in range(number)]
    marked = [np.flatnonzero(marks & m) for m in MARKS]
    sums = np.zeros((1 << number, number, 2 + len(MARKS)), np.int64)
    for before in range(1 << number):
        gone = merged([np.empty(0, np.int64), *[x for i, x in enumerate(lists) if before >> i & 1]])
        for i, own in enumerate(lists):
            if before >> i & 1:
                continue
            removed = without(own, gone)
            lost = [len(removed) - len(without(removed, x)) for x in marked]
            sums[before, i] = [len(failed) - len(gone) - len(removed), len(removed), *lost]
    return sums


def _sums(number: int):
    pairs = [(s, i) for s in range(1 << number) for i in range(number) if not s >> i & 1]

    def run(batches: Batches) -> Batches:
        held: dict[str, list] = {}
        size = 0

        def settled() -> Iterator[pa.RecordBatch]:
            for part, rows in held.items():
                failed, marks = (np.concatenate(x) for x in zip(*rows, strict=True))
                sums = _stretch_sums(failed, marks, number)
                columns = zip(*[(part, s, i, *sums[s, i].tolist()) for s, i in pairs], strict=True)
                kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _SUMS.split(", ")]
                )

        for batch in batches:
            parts = batch["part"].dictionary_encode()
            of, failed, marks = (np.asarray(x) for x in (parts.indices, batch["failed"], batch["marks"]))
            for k, part in enumerate(parts.dictionary.to_pylist()):
                own = of == k
                held.setdefault(part, []).append((failed[own], marks[own]))
            size += len(batch)
            if size >= _STRETCH:
                yield from settled()
                held, size = {}, 0
        yield from settled()

    return run


def audit(failed: DataFrame, names: str = FILTERS) -> DataFrame:
    """What each filter does in each order: a row per part, order of ``names`` and step.

    ``failed(doc_id, part, failed, marks)`` holds a row per document: bits of the
    filters it fails, and ``GOOD`` and ``TOXIC`` where it is marked so.  Columns
    ``part, filter_order, step, filter``; ``kept`` after the step, ``removed`` in
    it, ``redundant`` (failing, removed earlier), ``unique_fails`` (failing this
    filter only), ``good_lost, toxic_lost`` and ``shapley``, what the filter
    removes summed over all orders.  Parts are those of the rows; no rows, no parts.
    Rows may repeat: each counts.
    """
    require(failed, ["doc_id", "part", "failed", "marks"])
    spark, number = failed.sparkSession, len(names)
    failed = materialize(failed.select("doc_id", "part", "failed", "marks"), "failing_ids")
    ranges = partitions_for(spark, failed.count(), _ROWS_PER_TASK)
    dealt = failed.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id").select("part", "failed", "marks")
    keys, values = ["part", "before", "filter"], ["kept", "removed", "good_lost", "toxic_lost"]
    sums = arrow_map(dealt, _sums(number), _SUMS).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in values])
    sums = materialize(sums, "filter_sums")
    weights = [factorial(s.bit_count()) * factorial(number - 1 - s.bit_count()) for s in range(1 << number) if s.bit_count() < number]
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.col("before"))
    alone = F.get(F.array(*[F.lit((1 << number) - 1 - (1 << i)) for i in range(number)]), F.col("filter"))
    totals = sums.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("before") == alone, F.col("removed"))).alias("unique_fails"),
        F.sum(weight * F.col("removed")).cast("long").alias("shapley"),
    )
    steps = [
        ("".join(names[i] for i in order), k + 1, names[order[k]], sum(1 << i for i in order[:k]), order[k])
        for order in permutations(range(number))
        for k in range(number)
    ]
    steps = spark.createDataFrame(steps, "filter_order string, step int, name string, before int, filter int")
    both = sums.join(totals, ["part", "filter"]).join(F.broadcast(steps), ["before", "filter"])
    return both.select(
        "part", "filter_order", "step", F.col("name").alias("filter"), "kept", "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` of the five filters of ``failing`` per language; ``labels(doc_id, quality, toxic)`` gives the marks.

    A document has a mark if any of its labels says so; labels of other ids, or
    without one, change nothing.
    """
    require(labels, ["doc_id", "quality", "toxic"])
    mark = F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(mark.alias("marks"))
    found = failing(docs).join(marks, "doc_id", "left")
    return audit(found.withColumn("marks", F.coalesce("marks", F.lit(0))))


def audit_sql() -> str:
    """The audit in DuckDB's SQL, each order followed document by document."""
    return """
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
), firsts AS (SELECT t, min(doc_id) AS least FROM texts GROUP BY t
), flags AS (
    SELECT row_number() OVER () AS r, part, doc_id,
           {'A': len(w) < 100,
            'B': 100 * len(list_distinct(w)) < 80 * len(w),
            'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
            'D': regexp_matches(t, '[#$%&*|]'),
            'E': coalesce(doc_id > least, false)} AS f
    FROM texts JOIN firsts USING (t)
), marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (SELECT o, s, substr(o, s, 1) AS l FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)
), fails AS (
    SELECT r, part, doc_id, l,
           CASE l WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END AS failed
    FROM flags, letters
), followed AS (
    SELECT x.part, x.r, x.doc_id, o, s, s.l, x.failed,
           coalesce(bool_or(x.failed) OVER (PARTITION BY x.r, o ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone,
           sum(x.failed::INT) OVER (PARTITION BY x.r, o) AS failures
    FROM fails x JOIN steps s ON x.l = s.l
), counted AS (
    SELECT part, o, s, l,
           count(*) FILTER (NOT gone AND NOT failed) AS kept,
           count(*) FILTER (NOT gone AND failed) AS removed,
           count(*) FILTER (gone AND failed) AS redundant,
           count(*) FILTER (failed AND failures = 1) AS unique_fails,
           count(*) FILTER (NOT gone AND failed AND good) AS good_lost,
           count(*) FILTER (NOT gone AND failed AND toxic) AS toxic_lost
    FROM followed LEFT JOIN marks USING (doc_id) GROUP BY part, o, s, l
)
SELECT part, o AS filter_order, s AS step, l AS filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, l)::BIGINT AS shapley
FROM counted
"""

"""Importance resampling towards a target: how much likelier a text is under the target's model than under the raw one.

Both models are bags of hashed n-grams (words and pairs of words).  The raw
model counts all documents; the target model counts a bounded sample of rows
labelled as good.  A text's log weight is the sum of the log ratios of its
n-grams.  Gumbel noise on the log weights makes the ``k`` largest keys a sample
without replacement in which likelier texts come first; the ``k``-th largest key
is found by counting, not by sorting.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import Batches, arrow_map, require
from .selection import kth_largest
from .words import windows, word_hashes

#: Each kind of n-gram has two to this power of slots.
SLOT_BITS = 17
SLOTS = 1 << SLOT_BITS
#: Added to the counts of both models, so that rare n-grams say little.
SMOOTHING = 8.0
#: The most labelled documents that the target model and the cut are learned from.
SAMPLE = 20_000
#: Of them, one in so many is kept from the model to find the cut.
HELD_BACK = 3
#: Share of held-back good documents whose weight is above the cut.
GOOD_KEPT = 0.995
#: Noise per unit of log weight: 1 samples in proportion to the weights, less lets them decide more.
TEMPERATURE = 0.1
SEED = 7


#: Words, and runs of marks between them; letters beyond ASCII are bytes above 127.
_WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")


class Model(NamedTuple):
    ratios: np.ndarray  # log ratio of each slot, words first, then pairs
    fitted: list[int]
    held_back: list[int]


def _slots(text: bytes | None) -> np.ndarray:
    words = word_hashes(_WORDS.findall(text or b""))
    shift = np.uint64(64 - SLOT_BITS)
    single = (windows(words, 1) >> shift).astype(np.int64)
    return np.concatenate([single, (windows(words, 2) >> shift).astype(np.int64) + SLOTS])


def good_sample(labels: DataFrame, size: int = SAMPLE, seed: int = SEED) -> list[int]:
    """Ids labelled good and not toxic, at most ``size``: those with the least hashes."""
    require(labels, ["doc_id", "quality", "toxic"])
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    rows = good.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(size).collect()
    return [r["doc_id"] for r in rows]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    require(docs, [id_col, text_col])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def fit(docs: DataFrame, good: Sequence[int], id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Count the n-grams of all ``docs``, and of those with the ids ``good``, into a model."""
    fitted = [x for i, x in enumerate(good) if i % HELD_BACK]
    held_back = [x for i, x in enumerate(good) if not i % HELD_BACK]
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(fitted))  # at most the sample

    def count(batches: Batches) -> Batches:
        raw, target = np.zeros(2 * SLOTS, np.int64), np.zeros(2 * SLOTS, np.int64)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = _slots(text)
                np.add.at(raw, found, 1)
                if doc_id in wanted.value:
                    np.add.at(target, found, 1)
        used = np.flatnonzero(raw)
        columns = [pa.array(used), pa.array(raw[used]), pa.array(target[used])]
        yield pa.RecordBatch.from_arrays(columns, ["slot", "raw", "target"])

    counted = arrow_map(_texts(docs, id_col, text_col), count, "slot long, raw long, target long")
    # One row per slot, so at most ``2 * SLOTS`` reach the driver.
    totals = counted.groupBy("slot").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(2 * SLOTS), np.zeros(2 * SLOTS)
    raw[totals["slot"].to_numpy()] = totals["raw"].to_numpy()
    target[totals["slot"].to_numpy()] = totals["target"].to_numpy()
    ratios = np.zeros(2 * SLOTS)
    for kind in (slice(0, SLOTS), slice(SLOTS, None)):
        expected = raw[kind] * target[kind].sum() / max(raw[kind].sum(), 1.0)
        ratios[kind] = np.log((target[kind] + SMOOTHING) / (expected + SMOOTHING))
    return Model(ratios, fitted, held_back)


def _keys(ids: Iterable[int | None], texts: Iterable[bytes | None], ratios: np.ndarray, temperature: float, seed: int):
    """Log weights, and keys with noise that depends on the id and the text only."""
    weights, noise = [], []
    for doc_id, text in zip(ids, texts, strict=True):
        weights.append(float(np.sum(ratios[_slots(text)])))
        draw = xxhash.xxh64_intdigest(f"{doc_id}|".encode() + (text or b""), seed)
        noise.append(-np.log(-np.log(((draw >> 12) + 0.5) / (1 << 52))))
    weights = np.array(weights)
    return weights, weights + temperature * np.array(noise)


def weigh(
    docs: DataFrame, model: Model, temperature: float = TEMPERATURE, seed: int = SEED, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, log_weight, key)`` of each row; a text without words weighs as much as in either model: 0."""
    ratios = docs.sparkSession.sparkContext.broadcast(model.ratios)  # a fixed number of slots: 2 MB

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = _keys(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), ratios.value, temperature, seed)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *map(pa.array, found)], ["doc_id", "log_weight", "key"]
            )

    return arrow_map(_texts(docs, id_col, text_col), run, "doc_id long, log_weight double, key double")


def cut(weighed: DataFrame, model: Model, good_kept: float = GOOD_KEPT) -> float:
    """The least key of the sample: as many rows are drawn as weigh no less than ``good_kept`` of the held-back ones.

    Without labelled rows nothing can be told apart, and all rows are kept.
    """
    spark = weighed.sparkSession
    if not model.held_back:
        return float("-inf")
    ids = spark.createDataFrame([(x,) for x in model.held_back], "doc_id long")
    known = weighed.join(F.broadcast(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"])  # at most the sample
    weights = sorted(r["log_weight"] for r in known.select("log_weight").collect())
    if not weights:
        return float("-inf")
    least = float(np.quantile(weights, 1 - good_kept))
    number = weighed.filter(F.col("log_weight") >= least).count()
    found = kth_largest(weighed, "key", number)
    return float("-inf") if found is None else found


def resample(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, temperature: float = TEMPERATURE, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, log_weight, key, kept`` of each row of ``docs``.

    Null and empty texts have log weight 0; repeated rows are drawn or left
    together, as are rows whose key equals the least one drawn; an empty table
    gives no rows.  Other columns of ``docs`` are not read.
    """
    model = fit(docs, good_sample(labels, sample, seed), id_col, text_col)
    weighed = materialize(weigh(docs, model, temperature, seed, id_col, text_col), "log_weights")
    return weighed.withColumn("kept", F.col("key") >= F.lit(cut(weighed, model)))


def keep_drawn(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, temperature: float = TEMPERATURE, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that ``resample`` keeps, with all their columns.

    Keys depend on the row alone, so they are computed again where the texts
    lie, which spares a join of whole texts.
    """
    model = fit(docs, good_sample(labels, sample, seed), id_col, text_col)
    weighed = materialize(weigh(docs, model, temperature, seed, id_col, text_col), "log_weights")
    least = cut(weighed, model)
    ratios = docs.sparkSession.sparkContext.broadcast(model.ratios)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = batch[text_col].cast(pa.binary()).to_pylist()
            _, keys = _keys(batch[id_col].to_pylist(), texts, ratios.value, temperature, seed)
            yield batch.filter(pa.array(keys >= least))

    return arrow_map(docs, run, docs.schema)

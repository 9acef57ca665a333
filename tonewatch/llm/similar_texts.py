"""Classes of similar texts: MinHash bands propose groups, the Jaccard similarity of their shingles decides.

Texts with the same set of shingles are one.  Sets that share a band of their
signature, by chains, form a group; bands meet in Spark as blocks of 16 bytes a
band and set.  A group's texts are brought together in compressed form, their
shingles made anew, and every two sets of a group that are not connected yet are
held against each other in one task, behind a bound that loses no pair
(``similar_groups``).  No link that a band shows is lost, and the pairs of a
group never leave a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import Batches, arrow_map, partitions_for, require
from .components import components
from .fingerprints import PERMUTATIONS, SHINGLE_WORDS, signatures
from .similar_groups import BLOCK, BLOCKS, blocks_of, groups_of, id_of, key_of, links_in_groups, shingles
from .words import mixed

THRESHOLD = 0.8
#: Slots of a band: two sets of similarity 0.8 share none of the 16 bands once in 4,000 times.
BAND_SLOTS = 4
_SETS_PER_TASK = 50_000
_SENT_AT_ONCE = 1_000_000

_SETS = "doc_id long, text_key binary, set_key binary, set_id long, n int, bands binary"


def _sets(size: int):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            sets = [shingles(x, size) for x in batch["text"].to_pylist()]
            keys = [key_of(x) for x in sets]
            grouped = signatures(sets).reshape(len(sets), PERMUTATIONS // BAND_SLOTS, BAND_SLOTS)
            bands = np.zeros(grouped.shape[:2], np.uint64)
            for k in range(BAND_SLOTS):
                bands = mixed(bands + grouped[:, :, k])
            bands = mixed(bands + np.arange(bands.shape[1], dtype=np.uint64))
            columns = [
                batch["doc_id"], batch["text_key"], pa.array(keys, pa.binary()),
                pa.array(np.array([id_of(k) for k in keys], np.uint64).view(np.int64)),
                pa.array([len(x) for x in sets], pa.int32()), pa.array([x.tobytes() for x in bands], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SETS.split(", ")])

    return run


def _band_blocks(blocks: int):
    width = PERMUTATIONS // BAND_SLOTS

    def run(batches: Batches) -> Batches:
        bands, sets, waiting = [], [], 0
        for batch in batches:
            ids, at = np.unique(batch["set_id"].to_numpy().view(np.uint64), return_index=True)
            own = np.frombuffer(b"".join(batch["bands"].to_pylist()), np.uint64).reshape(-1, width)[at]
            bands.append(own.ravel())
            sets.append(np.repeat(ids, width))
            waiting += own.size
            if waiting >= _SENT_AT_ONCE:
                yield from blocks_of(np.concatenate(bands), [np.concatenate(bands), np.concatenate(sets)], blocks)
                bands, sets, waiting = [], [], 0
        if bands:
            yield from blocks_of(np.concatenate(bands), [np.concatenate(bands), np.concatenate(sets)], blocks)

    return run


def similar_classes(
    docs: DataFrame, threshold: float = THRESHOLD, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, class_id)`` of each row: the least ``doc_id`` that chains of similar texts reach.

    Texts with fewer words than a shingle are one shingle; null and empty texts
    are alike; rows without id lend none; repeated rows come back as often as
    they were; an empty table gives no rows.  Other columns of ``docs`` are not
    read.  ``threshold`` counts to a hundredth.
    """
    rows, classes = classes_of_texts(docs, threshold, shingle_words, id_col, text_col)
    return rows.join(classes, "text_key").select("doc_id", "class_id")


def text_key(text: Column) -> Column:
    """What tells texts apart; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def classes_of_texts(
    docs: DataFrame, threshold: float = THRESHOLD, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text_key)`` of each row, and ``(text_key, class_id, class_rows)`` of each text, both written.

    Classes are those of ``similar_classes``, with the same result for missing
    and empty values; ``class_rows`` rows are in a class.
    """
    require(docs, [id_col, text_col])
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = texts.withColumn("text_key", text_key(F.col("text")))
    rows = materialize(arrow_map(keyed, _sets(shingle_words), _SETS), "text_sets")
    sets = rows.groupBy("set_key", "set_id").agg(
        F.min("doc_id").alias("least_id"), F.count("*").alias("rows"), F.max("n").alias("n")
    )
    sets = materialize(sets, "distinct_sets")
    blocks = partitions_for(spark, sets.count(), _SETS_PER_TASK) * BLOCKS
    sent = arrow_map(rows.filter("n > 0").select("set_id", "bands"), _band_blocks(blocks), BLOCK)
    found = groups_of(sent, blocks).join(sets.select("set_id", "n", "least_id"), "set_id")
    found = materialize(found, "sets_with_bands")
    links = links_in_groups(texts, found, round(100 * threshold), shingle_words)
    named = sets.select("set_key", "set_id", "least_id", "rows").join(components(links), F.col("set_id") == F.col("node"), "left")
    named = materialize(named.select("set_key", "least_id", "rows", F.coalesce("root", "set_id").alias("root")), "similar_roots")
    classes = named.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("rows").alias("class_rows"))
    labels = named.join(classes, "root").select("set_key", "class_id", "class_rows")
    classes = rows.select("text_key", "set_key").distinct().join(labels, "set_key").drop("set_key")
    return rows.select("doc_id", "text_key"), materialize(classes, "classes_of_texts")

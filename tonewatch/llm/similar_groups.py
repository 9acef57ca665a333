"""Sets that share a hash, the groups this makes of them, and their links by Jaccard within each group.

A hash of a set is an n-gram, or a band of its signature.  Tasks send blocks of
arrays, 16 bytes for a hash and its set, instead of rows.  Groups are dealt to
cells of a bounded number of n-grams; a larger group is cut into blocks by the
sizes of its sets, and every pair of blocks whose sizes allow a link is a cell.
A cell's task holds its sets in a tree over their counts (``count_tree``) and
returns links that connect sets which were not connected yet, so no pairs of a
group leave their task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from math import ceil, log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import Batches, arrow_map, partitions_for
from .components import components
from .count_tree import spanning_links
from .fingerprints import shingle_hashes
from .key_filter import key_filter
from .words import text_words

#: N-grams of a cell's block.
CELL_SHINGLES = 4_000_000
#: Sets a task remembers, so as not to send their copies.
SEEN = 500_000
_CELL_BYTES_PER_TASK = 8 << 20
BLOCKS = 4
#: Sizes up to a step apart are of one class, which takes the low bits of a hash that is sent with it.
SIZE_STEP, SIZE_BITS = 1.02, 10
_SIZES = np.uint64((1 << SIZE_BITS) - 1)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of a text; fewer words are one n-gram, none are none."""
    return np.unique(shingle_hashes(text_words([(text or "").encode()])[0], size))


def key_of(own: np.ndarray) -> bytes:
    return hashlib.md5(own.tobytes()).digest()


def id_of(key: bytes) -> int:
    return int.from_bytes(key[:8], "little")


def size_gap(percent: int) -> int:
    """How many classes of sizes sets may be apart that are ``percent`` alike."""
    return ceil(log(100 / min(max(percent, 1), 100)) / log(SIZE_STEP)) + 1


def with_size(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hashes with the class of their set's size as their low bits."""
    return hashes & ~_SIZES | np.uint64(log(size) / log(SIZE_STEP))


def least_size(hashes: np.ndarray) -> np.ndarray:
    """A size that no set sent with these hashes is smaller than."""
    return np.floor(SIZE_STEP ** (hashes & _SIZES).astype(np.float64) * (1 - 1e-9)).astype(np.int64)


def blocks_of(deal: np.ndarray, columns: Sequence[np.ndarray], blocks: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(block, bytes of each column)`` of what ``deal`` sends to each block."""
    block = (deal >> np.uint64(20)) % np.uint64(blocks)
    order = np.argsort(block, kind="stable")
    block = block[order]
    cuts = np.flatnonzero(np.diff(block)) + 1
    starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(block)]
    if len(block):
        parts = [[x[i:j].tobytes() for i, j in zip(starts, ends, strict=True)] for x in (c[order] for c in columns)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(block[starts].astype(np.int32)), *[pa.array(p, pa.binary()) for p in parts]], ["block", "one", "two"]
        )


BLOCK = "block int, one binary, two binary"


def gathered(batches: Batches) -> tuple[np.ndarray, np.ndarray]:
    one, two = [], []
    for batch in batches:
        one += [np.frombuffer(x.as_buffer(), np.uint64) for x in batch["one"]]
        two += [np.frombuffer(x.as_buffer(), np.uint64) for x in batch["two"]]
    return np.concatenate([np.empty(0, np.uint64), *one]), np.concatenate([np.empty(0, np.uint64), *two])


def shared(blocks: int, gap: int | None = None, leaders: bool = True):
    """For each hash of several sets: each of these with the least of them, or else with the hash.

    With a ``gap``, hashes are those of ``with_size``, and only sets whose sizes
    lie nearer each other, by chains, count as having one in common.
    """

    def run(batches: Batches) -> Batches:
        tokens, sets = gathered(batches)
        order = np.lexsort((sets, tokens))
        tokens, sets = tokens[order], sets[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (sets[1:] != sets[:-1])
        tokens, sets = tokens[new], sets[new]
        first = np.ones(len(tokens), bool)
        first[1:] = tokens[1:] != tokens[:-1]
        if gap is not None:
            apart = tokens[1:] - tokens[:-1] > np.uint64(gap)
            first[1:] = apart | ((tokens[1:] ^ tokens[:-1]) > _SIZES)
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(tokens)))
        several = np.repeat(sizes > 1, sizes)
        if leaders:
            least = np.minimum.reduceat(sets, starts) if len(starts) else sets
            tokens = np.repeat(least, sizes)
        yield from blocks_of(sets[several], [sets[several], tokens[several]], blocks)

    return run


def hits(batches: Batches) -> Batches:
    """``(set_id, hits, leaders)``: how many of a set's first n-grams others have, and their leaders."""
    sets, leaders = gathered(batches)
    order = np.lexsort((leaders, sets))
    sets, leaders = sets[order], leaders[order]
    first = np.ones(len(sets), bool)
    first[1:] = sets[1:] != sets[:-1]
    starts = np.flatnonzero(first)
    hits = np.diff(np.append(starts, len(sets)))
    new = first.copy()
    new[1:] |= leaders[1:] != leaders[:-1]
    counts = np.add.reduceat(new.astype(np.int64), starts) if len(starts) else np.empty(0, np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(sets[starts].view(np.int64)), pa.array(hits.astype(np.int64)),
            pa.ListArray.from_arrays(offsets, pa.array(leaders[new].view(np.int64))),
        ],
        ["set_id", "hits", "leaders"],
    )


def _packed(text: str) -> bytes:
    """A set is sent as its compressed text, a third of what its hashes take."""
    return zstandard.compress(text.encode(), 1)


def _unpacked(packed: bytes, size: int) -> np.ndarray:
    return shingles(zstandard.decompress(packed).decode(), size)


def _shipped(size: int, wanted):
    """Sets of the documents that pass the filter, once in each task."""

    def run(batches: Batches) -> Batches:
        seen: set[int] = set()
        for batch in batches:
            doc_ids = batch["doc_id"]
            passing = wanted.value.passes(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
            passing |= doc_ids.is_null().to_numpy(zero_copy_only=False)
            ids, found = [], []
            for at in np.flatnonzero(passing).tolist():
                own = shingles(text := batch["text"][at].as_py(), size)
                set_id = id_of(key_of(own))
                if not len(own) or set_id in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(set_id)
                ids.append(set_id)
                found.append(_packed(text))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(found, pa.binary())], ["set_id", "packed"]
                )

    return run


def _linked(percent: int, size: int):
    """``(a, b)`` links that connect the sets of each cell; rows come sorted by cell and set."""

    def run(batches: Batches) -> Batches:
        cell, held = None, ({}, {})

        def settled() -> Iterator[pa.RecordBatch]:
            (one, two), apart = map(list, held), cell is not None and cell[1] != cell[2]
            sets, others = list(held[0].values()), list(held[1].values()) if apart else None
            found = [(one[i], (two if apart else one)[j]) for i, j in spanning_links(sets, percent, others)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("root", "low", "high", "own", "set_id", "packed")]
            for root, low, high, own, set_id, packed in zip(*columns, strict=True):
                if (root, low, high) != cell:
                    yield from settled()
                    cell, held = (root, low, high), ({}, {})
                if set_id not in held[own != low]:
                    held[own != low][set_id] = _unpacked(packed, size)
        yield from settled()

    return run


def groups_of(sent: DataFrame, blocks: int, gap: int | None = None) -> DataFrame:
    """``(set_id, hits, leaders)`` of the sets that share hashes sent as ``BLOCK`` rows: how many, and with whom."""
    found = arrow_map(sent.repartition(blocks // BLOCKS, "block"), shared(blocks, gap), BLOCK)
    return arrow_map(found.repartition(blocks // BLOCKS, "block"), hits, "set_id long, hits long, leaders array<long>")


def _placed(grouped: DataFrame, percent: int) -> DataFrame:
    """``grouped(root, n, ...)`` in groups of several sets, with ``own``, ``first`` and ``last``.

    A group lies in the order of its classes of sizes and is cut into blocks of at
    most about ``CELL_SHINGLES`` n-grams; ``own`` is a set's block, and blocks from
    ``first`` to ``last`` have all that is near enough in size.  A group has a
    bounded number of classes; the sets of one are dealt over the blocks it reaches.
    """
    kind = F.floor(F.log("n") / F.log(F.lit(SIZE_STEP))).cast("int")
    grouped = grouped.withColumn("kind", kind)
    sizes = grouped.groupBy("root", "kind").agg(F.sum("n").alias("weight"), F.count("*").alias("members"))
    whole, gap = Window.partitionBy("root"), size_gap(percent)
    upto = Window.partitionBy("root").orderBy("kind")

    def until(kinds: int):
        return F.coalesce(F.sum("weight").over(upto.rangeBetween(Window.unboundedPreceding, kinds)), F.lit(0))

    sizes = sizes.select(
        "root", "kind", "weight", F.sum("members").over(whole).alias("members"), F.sum("weight").over(whole).alias("total"),
        until(-1).alias("before"), until(-gap - 1).alias("near"), until(gap).alias("far"),
    ).filter("members > 1")
    cuts = F.ceil(F.col("total") / CELL_SHINGLES)

    def block(place):
        return F.least(F.floor(place * cuts / F.col("total")), cuts - 1).cast("int")

    drawn = F.pmod(F.xxhash64("set_id"), F.lit(1 << 20)) / float(1 << 20)
    return grouped.join(sizes, ["root", "kind"]).select(
        "set_id", "n", "least_id", "root", block(F.col("before") + drawn * F.col("weight")).alias("own"),
        block(F.col("near")).alias("first"), block(F.col("far")).alias("last"),
    )


def links_in_groups(texts: DataFrame, found: DataFrame, percent: int, size: int) -> DataFrame:
    """``(a, b)``: links that connect all sets of ``size``-grams alike enough within each group.

    ``found(set_id, n, least_id, leaders)`` are sets with the sets they share a
    hash with; chains of these are a group.  ``texts(doc_id, text)`` has the
    documents; a set is sent from those with the ids ``least_id``, or none.
    """
    spark = texts.sparkSession
    roots = components(found.select(F.col("set_id").alias("a"), F.explode("leaders").alias("b")))
    grouped = found.select("set_id", "n", "least_id").join(roots, F.col("set_id") == F.col("node"), "left")
    grouped = grouped.select("set_id", "n", "least_id", F.coalesce("root", "set_id").alias("root"))
    members = materialize(_placed(grouped, percent), "similar_groups")
    wanted = spark.sparkContext.broadcast(key_filter(members.select(F.col("least_id").alias("key")).filter("key IS NOT NULL")))
    sent = arrow_map(texts, _shipped(size, wanted), "set_id long, packed binary")
    pair = F.explode(F.sequence("first", "last")).alias("other")
    cells = sent.join(members.select("set_id", "root", "own", "first", "last"), "set_id").select("root", "own", "set_id", "packed", pair)
    cells = cells.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other")
    where = ["root", "low", "high"]
    weight = members.agg(F.sum(F.col("n").cast("long") * (F.col("last") - F.col("first") + 1))).first()[0]
    dealt = cells.repartition(partitions_for(spark, 8 * (weight or 0), _CELL_BYTES_PER_TASK), *where)
    dealt = dealt.sortWithinPartitions(*where, "set_id").select(*where, "own", "set_id", "packed")
    return arrow_map(dealt, _linked(percent, size), "a long, b long")

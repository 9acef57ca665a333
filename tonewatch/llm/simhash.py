"""SimHash near-duplicates: fingerprints of 64 bits, linked through BK-trees.

Two fingerprints that differ in at most ``r`` bits agree on at least two of
``r + 2`` blocks of bits, so every link lies within a shard of fingerprints that
agree on one pair of blocks.  A shard's tree files each fingerprint under its
Hamming distance to the parent; a search follows only edges within the radius of
its own distance.  A shard of more than ``SHARD_ROWS`` fingerprints is cut into
blocks, and the tree of each block is sent to the blocks that search it, so what
a task holds is bounded.  Equal fingerprints are one, however many texts share
it.  Links found in a shard leave it as one link per fingerprint to the least
one it is connected with there, so their number is that of the fingerprints.
"""

from __future__ import annotations

from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialize
from .common import Batches, arrow_map, free_names, require
from .components import components

BITS = 64
SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4
#: Fingerprints of a shard that one tree holds.
SHARD_ROWS = 4096
#: Rows of whole shards that are searched together, and pairs that are looked at together.
_ROWS_AT_ONCE = 1 << 16
_PAIRS_AT_ONCE = 1 << 21
_SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """Bits set in more than half of the hashes of the text's shingles; no words: zero."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and the ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    number = len(words) - words_per_shingle + 1
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for low in range(0, number, _SHINGLES_AT_ONCE):
        high = min(low + _SHINGLES_AT_ONCE, number)
        first = starts[low:high].tolist()
        after = (ends[low + words_per_shingle - 1 : high + words_per_shingle - 1] - 1).tolist()
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(first, after, strict=True)], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > number, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, fingerprint)`` of each row; the fingerprint as a signed long.  Null text: no words."""
    require(docs, [id_col, text_col])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [fingerprint(x, words_per_shingle) for x in batch["text"].to_pylist()]
            values = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], values], ["doc_id", "fingerprint"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return arrow_map(texts, run, "doc_id long, fingerprint long")


def block_masks(max_bits: int) -> list[int]:
    """Masks of all pairs out of ``max_bits + 2`` blocks, as signed longs."""
    blocks = max_bits + 2
    bounds = [BITS * i // blocks for i in range(blocks + 1)]
    single = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in pairwise(bounds)]
    return [int(np.uint64(a | b).view(np.int64)) for a, b in combinations(single, 2)]


class Forest:
    """BK-trees of many groups at once; ``points`` sorted by ``group``, distinct within a group."""

    def __init__(self, points: np.ndarray, group: np.ndarray) -> None:
        self.points = points
        first = np.concatenate([[True], group[1:] != group[:-1]])
        roots = np.flatnonzero(first)
        self.root_of = dict(zip(group[roots].tolist(), roots.tolist(), strict=True))
        at = np.repeat(roots, np.diff(np.append(roots, len(points))))
        waiting = np.flatnonzero(~first)
        slots, children = [], []
        while waiting.size:  # a level of all trees: the first to reach a free place takes it, the others go on below it
            slot = self._slot(at[waiting], np.bitwise_count(points[waiting] ^ points[at[waiting]]))
            taken, owner, of = np.unique(slot, return_index=True, return_inverse=True)
            child = waiting[owner]
            slots.append(taken)
            children.append(child)
            at[waiting] = child[of]
            rest = np.ones(waiting.size, bool)
            rest[owner] = False
            waiting = waiting[rest]
        slots = np.concatenate([np.empty(0, np.int64), *slots])
        order = np.argsort(slots)
        self.slots = slots[order]
        self.children = np.concatenate([np.empty(0, np.int64), *children])[order]

    @staticmethod
    def _slot(node: np.ndarray, distance: np.ndarray) -> np.ndarray:
        return node.astype(np.int64) * (BITS + 1) + distance

    def search(self, wanted: np.ndarray, start: np.ndarray, radius: int):
        """Yield ``(index of wanted, index of point)`` of all pairs within ``radius``, from the given roots."""
        who, node = np.arange(len(wanted)), start
        while who.size:
            distance = np.bitwise_count(wanted[who] ^ self.points[node]).astype(np.int64)
            hit = distance <= radius
            if hit.any():
                yield who[hit], node[hit]
            low = np.searchsorted(self.slots, self._slot(node, np.maximum(distance - radius, 0)), "left")
            high = np.searchsorted(self.slots, self._slot(node, np.minimum(distance + radius, BITS)), "right")
            number = high - low
            who = np.repeat(who, number)
            within = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
            node = self.children[np.repeat(low, number) + within]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked places the least label either has, until no link joins two labels."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(label, np.maximum(la, lb), low)
        while True:  # labels are places: follow them to their ends
            further = label[label]
            if (further == label).all():
                break
            label[:] = further


def _search_groups(points: np.ndarray, group: np.ndarray, tree: np.ndarray, radius: int) -> np.ndarray:
    """Label of each place: a place it is linked with, the same for all that are connected in a group.

    Rows that are not of the tree search it; without such rows those of the tree do.
    """
    forest = Forest(points[tree], group[tree])
    place = np.flatnonzero(tree)
    sizes = np.bincount(group[tree], minlength=group[-1] + 1)
    has_others = np.bincount(group[~tree], minlength=group[-1] + 1) > 0
    asks = np.flatnonzero(~tree | ~has_others[group])
    asks = asks[sizes[group[asks]] > 0]
    label = np.arange(len(points))
    chunk = np.cumsum(sizes[group[asks]]) // _PAIRS_AT_ONCE
    for own in np.split(asks, np.flatnonzero(np.diff(chunk)) + 1):
        if own.size:
            start = np.array([forest.root_of[g] for g in group[own].tolist()], dtype=np.int64)
            for who, node in forest.search(points[own], start, radius):
                _merge(label, own[who], place[node])
    return label


_SHARD = ("mask", "value", "i", "j")


def _links(radius: int):
    def settle(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(columns["fingerprint"])
        change = np.zeros(n, bool)
        for c in _SHARD:
            change[1:] |= columns[c][1:] != columns[c][:-1]
        points = columns["fingerprint"].view(np.uint64)
        label = _search_groups(points, np.cumsum(change), columns["tree"], radius)
        linked = np.flatnonzero(label != np.arange(n))
        pairs = [pa.array(columns["fingerprint"][x]) for x in (linked, label[linked])]
        return pa.RecordBatch.from_arrays(pairs, ["a", "b"])

    def run(batches: Batches) -> Batches:
        names = [*_SHARD, "fingerprint", "tree"]
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            new = {c: batch[c].to_numpy(zero_copy_only=False) for c in names}
            held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in names}
            if len(held["tree"]) >= _ROWS_AT_ONCE:  # all but the last shard are whole
                last = np.logical_and.reduce([held[c] == held[c][-1] for c in _SHARD])
                cut = int(np.argmax(last))
                if cut:
                    yield settle({c: held[c][:cut] for c in names})
                    held = {c: held[c][cut:] for c in names}
        if held is not None and len(held["tree"]):
            yield settle(held)

    return run


def links(distinct: DataFrame, max_bits: int = MAX_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints of ``distinct`` within ``max_bits`` of each other.

    ``distinct(fingerprint)`` has no value twice.  Fingerprints connected by the
    links are those connected through pairs within ``max_bits``; not every such
    pair is a row.
    """
    masks = F.explode(F.array(*[F.lit(m) for m in block_masks(max_bits)])).alias("mask")
    keyed = distinct.select("fingerprint", masks).withColumn("value", F.col("fingerprint").bitwiseAND(F.col("mask")))
    shards = keyed.groupBy("mask", "value").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / shard_rows).cast("int")
    block = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    sent = keyed.join(shards, ["mask", "value"]).withColumn("blocks", blocks).withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = sent.select("mask", "value", "fingerprint", "block", other).select(
        "mask", "value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "fingerprint", (F.col("block") <= F.col("other")).alias("tree"),
    )
    dealt = pairs.repartition(*_SHARD).sortWithinPartitions(*_SHARD)
    return arrow_map(dealt, _links(max_bits), "a long, b long")


def component_roots(distinct: DataFrame, max_bits: int = MAX_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``distinct(fingerprint, ...)`` with ``root``, the same for all fingerprints connected within ``max_bits``."""
    roots = components(links(distinct.select("fingerprint"), max_bits, shard_rows))
    rooted = distinct.join(roots, F.col("fingerprint") == F.col("node"), "left")
    return rooted.select(*distinct.columns, F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(
    docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, id_col: str = "doc_id",
    text_col: str = "text", shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    ``fingerprint`` is a signed long (``hex_digits`` shows its bits);
    ``component_id`` is the least ``doc_id`` that chains of fingerprints within
    ``max_bits`` reach, the row's own included.  Null and empty texts have
    fingerprint zero and are linked like any other; rows without ``doc_id`` link
    but lend no id; repeated rows come back as often as they were.  Other
    columns of ``docs`` are not read.
    """
    marked = materialize(fingerprints(docs, words_per_shingle, id_col, text_col), "fingerprints")
    least = F.min("doc_id").alias("least_id")
    distinct = materialize(marked.groupBy("fingerprint").agg(least), "distinct_fingerprints")
    rooted = component_roots(distinct, max_bits, shard_rows)
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = materialize(rooted.join(named, "root").select("fingerprint", "component_id"), "component_labels")
    return marked.join(labels, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(
    docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, id_col: str = "doc_id",
    text_col: str = "text", shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row of each component of ``near_duplicates``, with all columns of ``docs``.

    It is the row with the least ``doc_id``; among rows with the same id any one
    of them, and a row without id only where no other has one.  Columns of
    ``docs`` may have any names; an empty table stays empty.
    """
    require(docs, [id_col, text_col])
    row_col, mark_col = free_names(docs, "__row", "__fingerprint")
    schema = StructType(list(docs.schema.fields)).add(row_col, "long").add(mark_col, "long")

    def run(batches: Batches) -> Batches:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch[text_col].cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(x, words_per_shingle) for x in texts], dtype=np.uint64).view(np.int64)
            added = [pa.array(np.arange(row, row + batch.num_rows)), pa.array(found)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, row_col, mark_col])
            row += batch.num_rows

    marked = materialize(arrow_map(docs, run, schema), "marked_documents")
    rows = marked.select(
        F.col(mark_col).alias("fingerprint"), F.col(row_col).alias("row"), F.col(id_col).alias("id")
    )
    distinct = materialize(rows.select("fingerprint").distinct(), "distinct_fingerprints")
    rooted = materialize(component_roots(distinct, max_bits, shard_rows), "component_labels")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    first = rows.join(rooted, "fingerprint").groupBy("root").agg(F.min_by("row", order).alias(row_col))
    return marked.join(first.select(row_col), row_col, "left_semi").select(*docs.columns)


def hex_digits(fingerprint: Column) -> Column:
    """The 16 lowercase hexadecimal digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))

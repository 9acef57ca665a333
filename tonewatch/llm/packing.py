"""Best-fit packing of documents into sequences, planned over a histogram of lengths.

Documents are encoded and only the longer ones cut.  The plan needs no more than
how many pieces there are of each length, so it is made on the driver from at
most ``capacity`` numbers, whatever the corpus holds: best-fit decreasing, with
all sequences that have the same room left handled as one run.  A run says which
ranks of a length go to which sequences; each piece finds its place by its rank
within its length.  Ranks come from counts per (length, bucket), so a length
that a third of all pieces share is ranked by many tasks.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import Batches, arrow_map, require
from .encoding import encoder, id_kind

CAPACITY = 1024
#: Buckets dealt to pieces as they are cut; the plan uses as many of them as it needs.
BUCKETS = 1 << 20
#: At ``CAPACITY`` ids a piece, 16 MB.
PIECES_PER_BUCKET = 4000
_BATCH_BYTES = 1 << 23
#: Batches of widened ids go back to Spark in parts of about so much.
_WIDE_BYTES = 1 << 21

PACKED = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
PIECES = "doc_id long, piece int, start long, length int, ids binary, bucket int"


class Run(NamedTuple):
    """Pieces of one length, by rank: ``per_sequence`` of them go to each sequence from ``sequence`` on."""

    first_rank: int
    per_sequence: int
    sequence: int
    offset: int


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> dict[int, list[Run]]:
    """Best-fit decreasing over ``length -> pieces``; runs of each length in order of rank.

    A piece goes to the sequence with the least room that holds it.  That
    sequence, with still less room now, is also the best one for the next piece
    of this length as long as it fits, so a whole run is settled at a time.
    """
    runs: dict[int, list[Run]] = {}
    open_by_room: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, sequences)
    rooms: list[int] = []
    sequences = 0

    def put_back(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in open_by_room:
                insort(rooms, room)
            open_by_room.setdefault(room, []).append((first, number))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1 to {capacity}")
        left, rank = counts[length], 0
        own = runs.setdefault(length, [])
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room], rooms[at]
            else:
                room, first, number = capacity, sequences, -(-left // (capacity // length))
                sequences += number
            per = room // length
            full = min(number, left // per)
            if full:
                own.append(Run(rank, per, first, capacity - room))
                put_back(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            first, number = first + full, number - full
            if number and left:  # fewer than fill one sequence
                own.append(Run(rank, left, first, capacity - room))
                put_back(room - left * length, first, 1)
                rank, left, first, number = rank + left, 0, first + 1, number - 1
            put_back(room, first, number)
    return runs


def _cut(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Batches) -> Batches:
        encode, kind = encoder(tokenizer).encode, id_kind(tokenizer)
        end = np.array([end_id], dtype=kind).tobytes()
        width = len(end)
        dealt = TaskContext.get().partitionId() * 7919
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            names = ["doc_id", "piece", "start", "length", "ids", "bucket"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32()]
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for part in batches:
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"], strict=True):
                ids = np.frombuffer(encode([text.as_py()])[0], dtype="<u4").astype(kind).tobytes() + end
                n = len(ids) // width
                start, number = 0, 0
                length = n if n <= capacity else n % capacity or capacity
                while start < n:
                    own = ids[start * width : (start + length) * width]
                    rows.append((doc_id, number, start, length, own, dealt % BUCKETS))
                    dealt, size = dealt + 1, size + len(own)
                    start, number, length = start + length, number + 1, capacity
                    if size > _BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()

    return run


def pieces_of(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 2, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode each text, append ``end_id``, cut what is longer than ``capacity``: columns ``PIECES``.

    All pieces of a cut document but its first are ``capacity`` long.  ``ids``
    has the width that the vocabulary needs (``id_kind``).
    """
    require(docs, [id_col, text_col])
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(texts, _cut(tokenizer, capacity, end_id), PIECES)


def _widen(kind: str):
    def run(batches: Batches) -> Batches:
        times = 4 // np.dtype(kind).itemsize
        for batch in batches:
            if not batch.num_rows:
                continue
            at, ids = batch.schema.get_field_index("ids"), batch["ids"]
            _, places, values = ids.buffers()
            places = np.frombuffer(places, np.int32)[ids.offset : ids.offset + len(ids) + 1]
            # All ids of the batch at once; none is null.
            wide = np.frombuffer(values, np.uint8)[places[0] : places[-1]].view(kind).astype("<u4")
            places = ((places - places[0]) * times).astype(np.int32)
            wide = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(places), pa.py_buffer(wide)])
            batch = batch.set_column(at, "ids", wide)
            # In parts, since whoever reads a batch holds all of it.
            ends = np.searchsorted(places, np.arange(_WIDE_BYTES, int(places[-1]) + _WIDE_BYTES, _WIDE_BYTES))
            ends = [*np.unique(np.minimum(ends, len(ids))).tolist(), len(ids)]
            first = 0
            for end in ends:
                if end > first:
                    yield batch.slice(first, end - first)
                    first = end

    return run


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 2, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents and their places: ``doc_id, piece, start, length, ids, sequence_id, offset``.

    ``ids`` holds unsigned little-endian 32-bit ids; ``offset`` is the piece's
    place in its sequence, where pieces lie without gaps from 0 on.  Null and
    empty texts are one piece with the end id; rows that repeat, or have no id,
    are documents of their own; an empty table packs into no sequence.  Other
    columns of ``docs`` are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    pieces = materialize(pieces_of(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    total = pieces.count()
    buckets = min(max(math.ceil(total / PIECES_PER_BUCKET), 1), BUCKETS)
    pieces = pieces.withColumn("bucket", F.col("bucket") % buckets)
    counts = materialize(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "piece_counts")
    # At most ``capacity`` rows reach the driver and are sent back to all tasks.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.createDataFrame(
        [(length, [tuple(r) for r in own]) for length, own in plan(histogram, capacity).items()],
        "length int, runs array<struct<first_rank: long, per_sequence: long, sequence: long, offset: long>>",
    )
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start")
    ranked = pieces.withColumn("place", F.row_number().over(within) - 1).join(bases, ["length", "bucket"])
    placed = ranked.join(F.broadcast(runs), "length").withColumn("rank", F.col("base") + F.col("place"))
    run = F.element_at(F.filter("runs", lambda r: r["first_rank"] <= F.col("rank")), -1)
    placed = placed.withColumn("run", run).withColumn("nth", F.col("rank") - F.col("run.first_rank"))
    in_sequence = F.col("nth") % F.col("run.per_sequence")
    settled = placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids",
        (F.col("run.sequence") + F.floor(F.col("nth") / F.col("run.per_sequence"))).alias("sequence_id"),
        (F.col("run.offset") + in_sequence * F.col("length")).alias("offset"),
    )
    return arrow_map(settled, _widen(id_kind(tokenizer)), PACKED)

"""Token ids of a corpus in flat files that training reads through a memory map.

A part is two files: ``part-N.bin`` holds the ids of its documents one after the
other as unsigned integers, of 16 bits if the vocabulary allows it, else of 32;
``part-N.idx`` holds 64-bit numbers: documents, documents without id, offsets
(one more than documents, in ids, from 0), document ids.  Documents lie in
ascending order of id over all parts.  The manifest has a row per part; the
place of a part in the whole corpus is the sum of what lies before it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .common import Batches, arrow_map, open_store, require, write_file
from .encoding import encoder, id_kind

BYTES_PER_PART = 32 << 20
_BATCH_BYTES = 1 << 23

MANIFEST = "part int, path string, width int, documents long, ids long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


def _cuts(docs: DataFrame, bytes_per_part: int) -> list[int]:
    """Ascending ids that cut the documents into parts of similar size; an id may occur more than once."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows")).first()
    parts = math.ceil(((size["bytes"] or 0) + 16 * size["rows"]) / bytes_per_part)
    parts = max(parts, min(docs.sparkSession.sparkContext.defaultParallelism, size["rows"]), 1)
    if parts == 1:
        return []
    shares = [i / parts for i in range(1, parts)]
    return docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * parts)).alias("at")).first()["at"] or []


def _encode(tokenizer: str, end_id: int, cuts: list[int]):
    """Adds the part of each document; equal ids that fill several parts are dealt among them."""
    def run(batches: Batches) -> Batches:
        own = encoder(tokenizer)
        kind = id_kind(tokenizer)
        at, dealt = np.array(cuts, dtype=np.int64), 0
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = np.frombuffer(own.encode([text.as_py()])[0], dtype="<u4")
                packed = np.append(ids, np.uint32(end_id)).astype(kind).tobytes()
                part = 0
                if doc_id is not None:
                    low, high = np.searchsorted(at, doc_id, "left"), np.searchsorted(at, doc_id, "right")
                    part = int(low + dealt % (high - low + 1))
                rows.append((part, doc_id, len(ids) + 1, packed))
                dealt, size = dealt + 1, size + len(packed)
                if size > _BATCH_BYTES:
                    yield _encoded(rows)
                    rows, size = [], 0
            if rows:
                yield _encoded(rows)

    return run


def _encoded(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "n_tokens", "ids"])


def _write(folder: str, width: int):
    def run(batches: Batches) -> Batches:
        """One task has one part or several, each sorted; a part's ids pass through, its index is kept."""
        waiting: dict = {}

        def rows():
            for batch in batches:
                yield from zip(*(batch[c].to_pylist() for c in ("part", "doc_id", "n_tokens", "ids")), strict=True)

        source = rows()
        waiting["row"] = next(source, None)

        def ids_of(part: int, doc_ids: list, lengths: list):
            while waiting["row"] is not None and waiting["row"][0] == part:
                _, doc_id, n, ids = waiting["row"]
                doc_ids.append(doc_id)
                lengths.append(n)
                yield ids
                waiting["row"] = next(source, None)

        found = []
        while waiting["row"] is not None:
            part, doc_ids, lengths = waiting["row"][0], [], []
            path = f"{folder}/part-{part:06d}"
            write_file(f"{path}.bin", ids_of(part, doc_ids, lengths))
            offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            without = sum(d is None for d in doc_ids)
            named = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
            head = np.array([len(doc_ids), without], dtype="<i8")
            write_file(f"{path}.idx", iter([head.tobytes(), offsets.astype("<i8").tobytes(), named.tobytes()]))
            found.append((part, path, width, len(doc_ids), int(offsets[-1])))
        if found:
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("part", "path", "width", "documents", "ids"), x, strict=True)) for x in found],
                schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("width", pa.int32()),
                                  ("documents", pa.int64()), ("ids", pa.int64())]),
            )

    return run


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id",
    text_col: str = "text", bytes_per_part: int = BYTES_PER_PART,
) -> DataFrame:
    """Encode all texts, each followed by ``end_id``, into token files; returns their manifest.

    ``folder`` is a URI all executors reach; without it the files go to the
    application's part of the shared folder.  Null texts are empty; documents
    without id come first; rows with the same id stand next to each other, in no
    particular order; an empty table gives an empty manifest.  Other columns of
    ``docs`` are not read.
    """
    require(docs, [id_col, text_col])
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token_files")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cuts = _cuts(texts, bytes_per_part)
    width = np.dtype(id_kind(tokenizer)).itemsize
    encoded = arrow_map(texts, _encode(tokenizer, end_id, cuts), "part int, doc_id long, n_tokens long, ids binary")
    dealt = encoded.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "ids")
    return materialize(arrow_map(dealt, _write(folder, width), MANIFEST), "token_manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Add ``start``: the ids before each part.  One row per part, so one task is enough."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long")))


def mapped(uri: str, kind: str) -> np.ndarray:
    """The numbers of a file: through a memory map where it is local, else read."""
    store, path = open_store(uri)
    if store.type_name == "local":
        return np.memmap(path, dtype=kind, mode="r") if store.get_file_info(path).size else np.empty(0, kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=kind)


def read_part(path: str, width: int) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """Ids, offsets and document ids of one part."""
    index = mapped(f"{path}.idx", "<i8")
    n, without = int(index[0]), int(index[1])
    doc_ids = [None] * without + index[3 + n + without :].tolist()
    return mapped(f"{path}.bin", f"<u{width}"), index[2 : 3 + n], doc_ids


def _read(batches: Batches) -> Batches:
    for batch in batches:
        for part in batch.to_pylist():
            ids, offsets, doc_ids = read_part(part["path"], part["width"])
            step = max(1, _BATCH_BYTES * len(doc_ids) // max(1, 4 * len(ids)))
            for low in range(0, len(doc_ids), step):
                at = offsets[low : low + step + 1].tolist()
                own = [ids[a:b].astype("<u4").tobytes() for a, b in zip(at, at[1:], strict=False)]
                columns = [
                    pa.array(doc_ids[low : low + step], pa.int64()),
                    pa.array([part["start"] + a for a in at[:-1]], pa.int64()),
                    pa.array([b - a for a, b in zip(at, at[1:], strict=False)], pa.int64()),
                    pa.array(own, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """All documents from their files: ``doc_id, start, n_tokens, ids`` (unsigned 32-bit, little-endian)."""
    parts = max(manifest.count(), 1)
    dealt = with_starts(manifest).repartitionById(parts, F.col("part") % parts)
    return arrow_map(dealt, _read, DOCUMENTS)

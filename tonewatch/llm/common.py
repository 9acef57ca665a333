"""What the operators share: Python tasks over Arrow batches, and files in the shared folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

Batches = Iterator[pa.RecordBatch]


_holders: dict[str, Callable[[], None]] = {}


def hold(owner: str, forget: Callable[[], None]) -> None:
    """Say that this worker keeps a table of remembered words, and how to forget it.

    A worker runs tasks of many operators one after the other; only the table of
    the last one stays, so their sizes do not add up.
    """
    if len(_holders) != 1 or owner not in _holders:
        for other in [x for x in _holders if x != owner]:
            _holders.pop(other)()
        _holders[owner] = forget


def sparing(function: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same rows, with the memory of batches that are done given back.

    Arrow's pool keeps what it freed, and a worker lives on through the stages:
    what large batches took once would stay to the end of the session.
    """
    def run(batches: Batches) -> Batches:
        pool = pa.default_memory_pool()
        for batch in function(batches):
            yield batch
            del batch
            pool.release_unused()
        pool.release_unused()

    return run


def arrow_map(df: DataFrame, function: Callable[[Batches], Batches], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` whose workers find this package where the driver has it installed, and keep no unused memory."""
    environment = df.sparkSession.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return df.mapInArrow(sparing(function), schema)


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for added columns that no column of ``df`` has, whatever its case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def partitions_for(spark: SparkSession, amount: int | None, per_partition: int) -> int:
    """Partitions for ``amount`` bytes or rows, ``per_partition`` each, at least one for each core."""
    return max(-(-(amount or 0) // per_partition), spark.sparkContext.defaultParallelism)


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of ``uri``; Spark's ``s3a`` is ``s3`` elsewhere."""
    if uri.startswith("s3a:"):
        uri = "s3:" + uri[4:]
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks: Iterator[bytes]) -> int:
    """Write a whole file under a name of its own, then give it its name.

    A task that is run twice replaces the file by one with the same bytes; a
    reader never sees half a file.  Returns the number of bytes.
    """
    store, path = open_store(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    draft, size = f"{path}.{uuid.uuid4().hex}", 0
    with store.open_output_stream(draft) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    store.move(draft, path)
    return size

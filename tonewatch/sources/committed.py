"""Tables that runs add to, all or nothing: readers see the runs whose manifest is there.

A run writes its files into a folder of their own.  Then one small file, its
manifest, is given its name by a rename; from that moment on readers read the
folder it names.  A run that ended half-way left a folder that no manifest
names; repeating it writes another folder, and the rename puts the new manifest
in the place of the old one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_DATA, _MANIFESTS = "data", "manifests"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def write_run(df: DataFrame, path: str, run_id: str) -> str:
    """Write a run's files and return the name of their folder; readers do not see them yet."""
    if not run_id or "/" in run_id:
        raise ValueError(f"{run_id!r} names no run")
    folder = f"{run_id}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{_DATA}/{folder}")
    return folder


def commit_run(spark: SparkSession, path: str, run_id: str, folder: str) -> None:
    """Let readers see ``folder`` as what the run wrote, in place of what it wrote before."""
    jvm = spark._jvm
    manifest, draft = _path(spark, f"{path}/{_MANIFESTS}/{run_id}.json"), _path(spark, f"{path}/{_MANIFESTS}/.{uuid.uuid4().hex}")
    out = _system(spark, path).create(draft)
    out.write(bytearray(json.dumps({"run_id": run_id, "folder": folder}).encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(draft, manifest, overwrite)


def append_run(df: DataFrame, path: str, run_id: str) -> None:
    """Add a run's rows; a run that is repeated replaces its own."""
    commit_run(df.sparkSession, path, run_id, write_run(df, path, run_id))


def committed_runs(spark: SparkSession, path: str) -> dict[str, str]:
    """Folder of each committed run: one small file is read per run."""
    system, found = _system(spark, path), {}
    for status in system.globStatus(_path(spark, f"{path}/{_MANIFESTS}/*.json")) or []:
        stream = system.open(status.getPath())
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        manifest = json.loads(text)
        found[manifest["run_id"]] = manifest["folder"]
    return found


def read_runs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of all committed runs; none has been committed, no rows."""
    folders = sorted(committed_runs(spark, path).values())
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{_DATA}/{x}" for x in folders])


def drop_uncommitted(spark: SparkSession, path: str) -> int:
    """Delete the folders that no manifest names and return how many; not while a run is writing."""
    system, known = _system(spark, path), set(committed_runs(spark, path).values())
    dropped = 0
    for status in system.globStatus(_path(spark, f"{path}/{_DATA}/*")) or []:
        if status.getPath().getName() not in known:
            system.delete(status.getPath(), True)
            dropped += 1
    return dropped

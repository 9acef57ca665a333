"""Versions of stored objects and the manifest of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import NO_VERSION, OBJECT_STORE_SCHEMES
from ..operators.lookup import lookup_join
from ..session import materialize


def object_latest_version(versions: DataFrame, requests: DataFrame, path_col: str = "path") -> DataFrame:
    """Add ``version_id`` to requested paths.

    ``versions`` is ``(bucket, key, version_id, is_latest, is_delete_marker)``.
    A live latest version wins over a delete marker; without either the result
    is ``'N/A'``.  Paths of another scheme, or without bucket or key, get null.
    """
    pattern = rf"^({'|'.join(OBJECT_STORE_SCHEMES)})://([^/?#]+)/+([^?#]+)"
    path = F.col(path_col)
    bucket, key = F.regexp_extract(path, pattern, 2), F.regexp_extract(path, pattern, 3)
    wanted = requests.withColumn("_object", F.when(key != "", F.concat(bucket, F.lit("/"), key)))
    latest = versions.filter("is_latest").groupBy(F.concat("bucket", F.lit("/"), "key").alias("_object")).agg(
        F.min_by("version_id", F.struct("is_delete_marker", "version_id")).alias("version_id")
    )
    # Many requests may name one object, or none at all: the lookup spreads such rows.
    found = lookup_join(wanted, materialize(latest, "latest_objects"), "_object")
    version = F.when(F.col("_object").isNotNull(), F.coalesce("version_id", F.lit(NO_VERSION)))
    return found.withColumn("version_id", version).drop("_object")


def dataset_manifest(rows: DataFrame, versions: DataFrame, path_col: str = "path", split_col: str = "split") -> DataFrame:
    """Per dataset path: its version and its rows in total, for training and for validation."""
    counts = rows.groupBy(path_col).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(split_col) == "train").alias("train"),
        F.count_if(F.col(split_col) == "validate").alias("validate"),
    )
    return object_latest_version(versions, counts, path_col)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path with size and modification time, without reading their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "modificationTime")

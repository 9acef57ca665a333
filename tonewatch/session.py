"""Session settings, the shared scratch folder, and written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app_name: str = "tonewatch", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution on; sizes are left to the cluster's own settings."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder of its own; a
    cluster session without it is refused, because a machine-local folder would
    be lost with its machine.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tonewatch-")
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def _application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tonewatch/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under this application's part of the shared folder that nothing has written to yet."""
    return f"{_application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once no result needs them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_application_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``scratch_path`` that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, once all that was made of it is written too."""
    spark = df.sparkSession
    for folder in {os.path.dirname(x) for x in df.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(_application_dir(spark).split(":", 1)[-1].lstrip("/")):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The files outlive any executor, and later readers prune columns, which a
    checkpoint of whole rows would not allow.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without_session(spark: SparkSession, model: PipelineModel) -> PipelineModel:
    """The same model, free to go to tasks.

    The summary of a regression of two classes holds the session, which cannot be
    sent once anything was observed in it.  Such a model is written and read
    back, which leaves its summary behind.
    """
    if not any(isinstance(x, LogisticRegressionModel) and x.hasSummary and x.numClasses == 2 for x in model.stages):
        return model
    path = scratch_path(spark, "fitted")
    model.write().save(path)
    return PipelineModel.load(path)


def share_package(spark: SparkSession) -> None:
    """Let Python tasks find this package where the driver has it installed."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])

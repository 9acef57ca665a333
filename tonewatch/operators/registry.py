"""Model versions and runs as tables.

"The latest" is always an aggregate of the largest version, never a window: it
combines within each partition first, so a model with very many versions costs
no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import RUN_NAME_FORMAT

VERSION_COLUMNS = ("version", "stage", "run_id", "last_updated_timestamp")


def all_model_versions(versions: DataFrame, name: str) -> DataFrame:
    return versions.filter(F.col("name") == name)


def latest_model_version(versions: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Per model the version updated last; names without any version get nulls."""
    kept = [c for c in versions.columns if c != "name"]
    latest = versions.groupBy("name").agg(
        F.max_by(F.struct(*kept), F.struct("last_updated_timestamp", "version")).alias("latest")
    ).select("name", "latest.*")
    return latest if names is None else names.select("name").distinct().join(latest, "name", "left")


def model_version_by_stage(versions: DataFrame, stage: str = "Production") -> DataFrame:
    """Per model the highest version number in a stage."""
    kept = [c for c in versions.columns if c != "name"]
    return versions.filter(F.col("stage") == stage).groupBy("name").agg(
        F.max_by(F.struct(*kept), F.col("version")).alias("first")
    ).select("name", "first.*")


def promote_version(versions: DataFrame, decisions: DataFrame, updated_at: Column) -> DataFrame:
    """Tag each promoted version and append a copy of it to the production model.

    ``decisions`` holds ``name, source_version, destination, decision``; promoted
    sources get the tag ``Production``, and ``destination`` their copies as its
    next versions, in order of name and version.  A tag that is already there
    stays, and missing tags count as none.
    """
    promoted = decisions.filter(F.col("decision") == "promote").select(
        "name", F.col("source_version").alias("version"), "destination"
    ).distinct()
    none = F.create_map().cast("map<string,string>")
    others = F.map_filter(F.coalesce("tags", none), lambda key, _: key != "Production")
    tagged = F.map_concat(others, F.create_map(F.lit("Production"), F.lit("True")))
    marks = promoted.groupBy("name", "version").agg(F.lit(True).alias("_promoted"))
    marked = versions.join(marks, ["name", "version"], "left").withColumn(
        "tags", F.when(F.col("_promoted"), tagged).otherwise(F.col("tags"))
    )
    highest = versions.groupBy(F.col("name").alias("destination")).agg(F.max("version").alias("highest"))
    place = F.row_number().over(Window.partitionBy("destination").orderBy("name", "version"))
    copies = (
        promoted.withColumn("place", place).join(versions, ["name", "version"])
        .join(highest, "destination", "left").select(
            F.col("destination").alias("name"),
            (F.coalesce("highest", F.lit(0)) + F.col("place")).alias("version"),
            F.lit("Production").alias("stage"),
            "run_id",
            updated_at.cast(versions.schema["last_updated_timestamp"].dataType).alias("last_updated_timestamp"),
            "accuracy",
            tagged.alias("tags"),
        )
    )
    return marked.select(versions.columns).unionByName(copies.select(versions.columns))


def run_name(started_at: Column) -> Column:
    return F.date_format(started_at, RUN_NAME_FORMAT)


def run_log(
    runs: DataFrame, run_id: str, started_at: Column, params: dict[str, Column], metrics: dict[str, Column],
    tags: dict[str, Column] | None = None,
) -> DataFrame:
    """Long table ``(run_id, run_name, kind, key, value)``: a row per parameter, metric and tag of each run.

    A tag without value, one that does not hold for the run, has no row.
    """
    def entry(kind: str, key: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("key"), value.cast("string").alias("value"))

    entries = [entry("param", k, v) for k, v in params.items()]
    entries += [entry("metric", k, v) for k, v in metrics.items()]
    entries += [entry("tag", k, v) for k, v in (tags or {}).items()]
    log = runs.select(
        F.col(run_id).cast("string").alias("run_id"), run_name(started_at).alias("run_name"),
        F.inline(F.array(*entries)),
    )
    return log.filter((F.col("kind") != "tag") | F.col("value").isNotNull())


def run_table(log: DataFrame, keys: list[str]) -> DataFrame:
    """One row per run, one column per named key."""
    return log.groupBy("run_id", "run_name").agg(*[
        F.max(F.when(F.col("key") == key, F.col("value"))).alias(key) for key in keys
    ])

"""Train/validate splits and folds that depend on the row key only.

A random split changes with the partitioning and, after a lost executor, with
every retry.  A hash of the key does neither and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SPLIT_SEED, TRAIN_RATIO
from ..functions.hashing import unit_hash


def split_name(key: Column, ratio: float = TRAIN_RATIO, seed: int = SPLIT_SEED) -> Column:
    return F.when(unit_hash(seed, key) < ratio, F.lit("train")).otherwise(F.lit("validate"))


def split_train_validate(
    df: DataFrame, key: str, ratio: float = TRAIN_RATIO, seed: int = SPLIT_SEED
) -> tuple[DataFrame, DataFrame]:
    in_train = unit_hash(seed, F.col(key)) < ratio
    return df.filter(in_train), df.filter(~in_train)


def fold_of(key: Column, k: int, seed: int = SPLIT_SEED) -> Column:
    return F.floor(unit_hash(seed, key) * k).cast("int")


def k_fold_split(df: DataFrame, key: str, k: int = 3, seed: int = SPLIT_SEED) -> list[DataFrame]:
    folds = df.withColumn("fold", fold_of(F.col(key), k, seed))
    return [folds.filter(F.col("fold") == i) for i in range(k)]


def fold_complement(df: DataFrame, key: str, k: int, held_out: int, seed: int = SPLIT_SEED) -> DataFrame:
    """All folds but one: a single filtered scan instead of a union of k-1 scans."""
    folds = df.withColumn("fold", fold_of(F.col(key), k, seed))
    return folds.filter(F.col("fold") != held_out)


def fold_union(folds: Sequence[DataFrame], held_out: int) -> DataFrame:
    """The same rows as :func:`fold_complement`, for folds that came apart already."""
    kept = [fold for i, fold in enumerate(folds) if i != held_out]
    return reduce(DataFrame.unionByName, kept)

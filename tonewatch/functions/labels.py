"""Column builders for class labels and predictions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EXCLUDED_CLASS, LABEL_CODES, UNKNOWN_LABEL


def encode_label(name: Column) -> Column:
    """Class name to code; unknown names become null."""
    code = F.lit(None).cast("int")
    for label, value in LABEL_CODES.items():
        code = F.when(name == label, F.lit(value)).otherwise(code)
    return code


def decode_label(code: Column) -> Column:
    """Class code to name; unknown codes become ``'Unknown'``."""
    name = F.lit(UNKNOWN_LABEL)
    for label, value in LABEL_CODES.items():
        name = F.when(code == value, F.lit(label)).otherwise(name)
    return name


def cast_label(value: Column) -> Column:
    """Truncating cast string -> double -> int; anything unreadable becomes null."""
    return value.try_cast("double").try_cast("int")


def unwrap_prediction(finished: Column) -> Column:
    """First element of a finished prediction array as a number; null when empty."""
    return F.get(finished, F.lit(0)).try_cast("double")


def is_kept_class(label: Column) -> Column:
    """True for every class but the excluded one; compared as int so ``'3.0'`` is seen too."""
    return cast_label(label) != EXCLUDED_CLASS

"""From raw comments to the clean ``(Label, Text)`` dataset, as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ENGLISH_STOP_WORDS
from ..functions import labels, text
from .pinning import pinned


def rename_columns(df: DataFrame) -> DataFrame:
    """Positional names of a headerless read to ``Product, Label, Text``."""
    return df.withColumnsRenamed({"_c0": "Product", "_c1": "Label", "_c2": "Text"})


def drop_header_row(df: DataFrame) -> DataFrame:
    """Remove a header that was read as data, by its values and not by its position.

    Row numbers would force an order onto the whole table; the values are
    enough, stay pushable, and never cost a real row.
    """
    is_header = F.lit(True)
    for name in df.columns:
        is_header = is_header & F.col(name).eqNullSafe(F.lit(name))
    return df.filter(~is_header)


def drop_null_text(df: DataFrame, text_col: str = "Text") -> DataFrame:
    """A plain null test, which reaches the Parquet scan; ``dropna`` does not."""
    return df.filter(F.col(text_col).isNotNull())


def filter_not_blank(df: DataFrame, columns: Sequence[str] = ("Text", "Label")) -> DataFrame:
    """Keep rows in which every named column holds something besides spaces."""
    for name in columns:
        df = df.filter(F.trim(F.col(name)) != "")
    return df


def filter_nonempty_length(df: DataFrame, text_col: str = "Text") -> DataFrame:
    return df.filter(F.col(text_col).isNotNull() & (F.length(F.col(text_col)) > 0))


def filter_known_label(df: DataFrame, label_col: str = "Label") -> DataFrame:
    return df.filter(F.col(label_col).isNotNull())


def exclude_class(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Drop the class that no model is trained on; rows without a readable label go too."""
    return df.filter(labels.is_kept_class(F.col(label_col)))


def clean_text_column(
    df: DataFrame,
    input_col: str = "Text",
    output_col: str = "Text",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """Emoji, links, mentions, unknown token, case, non-letters, whitespace, stop words: in that order.

    Each guarded step names its input several times.  Steps of their own keep
    that input a plain column, so no pattern runs twice for a row.  The result is
    pinned, so that a filter on it does not run all patterns a second time.
    """
    steps = (
        text.strip_emoji,
        text.strip_urls,
        text.strip_mentions,
        lambda column: text.normalize_alpha(text.strip_unknown_token(column)),
        lambda column: text.drop_stop_words(column, stop_words),
    )
    source: Column = F.col(input_col)
    for step in steps:
        df = df.withColumn(output_col, step(source))
        source = F.col(output_col)
    return pinned(df, output_col)


def preprocess(raw: DataFrame) -> DataFrame:
    """Raw ``(Product, Label, Text)`` rows to clean ``(Label int, Text)``; other columns ride along.

    The label test comes before the patterns: it is cheap and its result does
    not depend on the text, so rows of unknown classes cost no cleaning.  It names
    the known classes, which the scan can use to skip row groups.
    """
    rows = drop_null_text(rename_columns(raw))
    rows = filter_not_blank(rows).drop("Product")
    rows = rows.filter(F.col("Label").isin(list(labels.LABEL_CODES)))
    rows = rows.withColumn("Label", labels.encode_label(F.col("Label")))
    return filter_nonempty_length(clean_text_column(rows))

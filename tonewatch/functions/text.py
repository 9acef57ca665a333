"""Column builders for text.  All are built-in expressions; none needs Python workers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    EMOJI_PATTERN,
    ENGLISH_STOP_WORDS,
    MENTION_PATTERN,
    UNKNOWN_TOKEN,
    URL_MARKERS,
    URL_PATTERN,
)


def strip_emoji(text: Column) -> Column:
    """Delete emoji and symbols.

    All of them lie beyond ASCII, so a text with as many bytes as characters is
    left alone without running the pattern.
    """
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(
        F.regexp_replace(text, EMOJI_PATTERN, "")
    )


def strip_urls(text: Column) -> Column:
    """Delete links; the pattern runs only where one of its literal parts occurs."""
    marked = F.lit(False)
    for marker in URL_MARKERS:
        marked = marked | text.contains(marker)
    return F.when(marked, F.regexp_replace(text, URL_PATTERN, "")).otherwise(text)


def strip_mentions(text: Column) -> Column:
    """Delete ``@name`` and ``#tag`` (ASCII word characters only)."""
    return F.when(
        text.contains("@") | text.contains("#"), F.regexp_replace(text, MENTION_PATTERN, "")
    ).otherwise(text)


def strip_unknown_token(text: Column) -> Column:
    return F.replace(text, F.lit(UNKNOWN_TOKEN), F.lit(""))


def normalize_alpha(text: Column) -> Column:
    """Lower-case, keep ASCII letters and whitespace only, collapse whitespace to one space.

    Digits are no letters, so one pattern deletes both.  The last pattern skips
    the single spaces that make up nearly all whitespace.
    """
    letters = F.regexp_replace(F.lower(text), r"[^a-z\s]+", "")
    return F.regexp_replace(letters, r"\s{2,}|[\t\n\x0B\f\r]", " ")


def drop_stop_words(text: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    """Drop stop words from single-spaced text; null and ``''`` both give null."""
    words = F.split(F.trim(F.nullif(text, F.lit(""))), " ", -1)
    return F.array_join(F.filter(words, lambda word: ~word.isin(list(stop_words))), " ")


def clean_text_light(text: Column) -> Column:
    """Links, mentions, lower case, letters and whitespace only; no trim, no stop words."""
    return normalize_alpha(
        F.regexp_replace(F.regexp_replace(text, URL_PATTERN, ""), MENTION_PATTERN, "")
    )


def whitespace_tokens(text: Column) -> Column:
    """Words of a text, split on any whitespace, without empty words."""
    return F.filter(F.split(text, r"\s+", -1), lambda word: word != "")

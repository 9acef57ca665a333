"""Highest class score of a prediction, from each of the three forms it is stored in."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(value: Column) -> Column:
    """The text as a decimal number, or null: Spark's cast alone would also take ``0.9d``."""
    plain = value.rlike(r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$")
    return F.when(plain, value.try_cast("double"))


def max_confidence_text(annotation: Column) -> Column:
    """From the printed annotation: the first ``metadata=`` with its braces, digit keys only, else 0.0.

    Blanks may stand before the brace; a dictionary in the dictionary is skipped.
    """
    at = F.instr(annotation, "metadata=")
    rest = F.when(at > 0, F.substr(annotation, at + F.lit(len("metadata="))))
    block = F.regexp_extract(rest, r"^\s*([{](?:[^{}]|[{][^{}]*[}])*[}])", 1)
    outer = F.concat(F.lit("{"), F.regexp_replace(F.substr(block, F.lit(2)), r"[{][^{}]*[}]", "_"))
    values = F.regexp_extract_all(
        outer, F.lit(r"""['"]([0-9]+)['"]: *['"]?([^'",}]*)"""), F.lit(2)
    )
    scores = F.transform(values, _number)
    return F.coalesce(F.array_max(F.filter(scores, lambda s: s.isNotNull())), F.lit(0.0))


def max_confidence_nested(annotations: Column) -> Column:
    """From real annotation structs: the first one's metadata, digit keys only, else 0.0."""
    metadata = F.get(annotations, F.lit(0))["metadata"]
    classes = F.map_filter(metadata, lambda key, _: key.rlike("^[0-9]+$"))
    scores = F.transform(F.map_values(classes), _number)
    return F.coalesce(F.array_max(F.filter(scores, lambda s: s.isNotNull())), F.lit(0.0))


def max_confidence_vector(probability: Column) -> Column:
    """From the probability vector of a fitted classifier."""
    return F.array_max(vector_to_array(probability))

"""Explicit schemas; nothing in the library infers one from data."""

from pyspark.sql import types as T

RAW_COMMENTS = T.StructType([
    T.StructField("Product", T.StringType()),
    T.StructField("Label", T.StringType()),
    T.StructField("Text", T.StringType()),
])

"""CSV in and out, with schemas given and quoting that survives quotes and line breaks in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import RAW_COMMENTS

_QUOTING = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

#: No field holds this: an unquoted empty field is null, a quoted one is the empty text.
_NULL = "\x00"
BYTES_PER_FILE = 256 << 20


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = RAW_COMMENTS,
    header: bool = True,
    multi_line: bool = False,
    malformed_col: str | None = None,
) -> DataFrame:
    """Read CSV with a known schema, which also saves the scan that inference needs.

    A file whose fields contain line breaks cannot be cut, so it is one task's
    work: ask for ``multi_line`` only for such files; :func:`write_csv` keeps its
    files small.  ``malformed_col`` adds a column with the text of records that
    do not fit the schema, null for all others.
    """
    options = {"nullValue": _NULL, "multiLine": multi_line, **_QUOTING}
    if malformed_col is not None:
        schema = T.StructType([*schema.fields, T.StructField(malformed_col, T.StringType())])
        options["columnNameOfCorruptRecord"] = malformed_col
    return spark.read.csv(path, schema=schema, header=header, **options)


def read_csv_headerless(spark: SparkSession, path: str, names: list[str], multi_line: bool = False) -> DataFrame:
    """Read string columns ``_c0.._cN`` and give them their names."""
    positional = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
    return read_csv(spark, path, positional, header=False, multi_line=multi_line).toDF(*names)


def write_csv(df: DataFrame, path: str, header: bool = True, bytes_per_file: int = BYTES_PER_FILE) -> None:
    """Write CSV in as many files as there are tasks, each of about ``bytes_per_file`` at most.

    Spark bounds files by rows; how many make up the bytes follows from their average.
    """
    size = F.lit(0).cast("long")
    for name in df.columns:
        size = size + F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) + 3
    average = df.agg(F.avg(size)).first()[0] or 1
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", max(1, int(bytes_per_file / average)))
    writer.csv(path, header=header, **_QUOTING)

"""Binary files through Spark's own writers and readers, so that any store works and lost tasks are redone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_binary(rows: DataFrame, column: str, separator: bytes, path: str) -> None:
    """Write a binary column to files below ``path``, each value followed by ``separator`` (not empty).

    The text writer puts out the bytes as they are; the separator is given in Latin-1, which has every byte.
    """
    rows.select(F.col(column).cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option(
        "lineSep", separator.decode("latin-1")).text(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``path`` and ``content``.  A file must fit a task (and be under 2 GB); so do those above."""
    return spark.read.format("binaryFile").load(path).select("path", "content")

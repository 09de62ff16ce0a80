"""Incremental ingestion of landed JSON into append-only bronze tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.sources.evolve import CORRUPT, parse_evolving
from holdfast.sources.manifest import CODEC

METADATA = [T.StructField("_source_file", T.StringType()), T.StructField("_ingested_at", T.TimestampType())]


def bronze_schema(source: T.StructType) -> T.StructType:
    """Columns of a bronze table: the declared ones, what could not be placed, and the metadata."""
    text = T.StringType()
    return T.StructType([
        *source.fields, T.StructField(CORRUPT, text), T.StructField("_extra", T.MapType(text, text)), *METADATA,
    ])


def ingest_metadata(df: DataFrame) -> DataFrame:
    """Add the file a row came from and the time it arrived."""
    return df.select(
        "*", F.col("_metadata.file_path").alias("_source_file"), F.current_timestamp().alias("_ingested_at")
    )


def ingest_stream(
    spark: SparkSession, folder: str, table: str, schema: T.StructType, checkpoint: str,
    max_bytes_per_batch: str | None = None, unique_key: list[str] | None = None, repeats_within: str = "7 days",
) -> DataFrame:
    """Append the files that are new since the last run, then stop; returns the bronze table.

    The checkpoint remembers the files, and the parquet sink's log makes a batch that
    was retried appear once.  Fields unknown to the schema are kept in ``_extra``.
    Bronze keeps every landed row; with ``unique_key`` a row whose key arrived within the
    given time before is left out, for sources whose drops are landed again by accident.
    """
    reader = spark.readStream.schema("value string")
    if max_bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_batch)
    lines = ingest_metadata(reader.text(folder))
    parsed = parse_evolving(lines, schema, keep=["_source_file", "_ingested_at"])
    if unique_key:  # the state holds the keys of that time span, spread over the key
        parsed = parsed.withWatermark("_ingested_at", repeats_within).dropDuplicatesWithinWatermark(unique_key)
    run = (
        parsed.writeStream.format("parquet").option("compression", CODEC).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(table)
    )
    run.awaitTermination()
    return read_bronze(spark, table, schema)


def read_bronze(spark: SparkSession, table: str, source: T.StructType) -> DataFrame:
    """A bronze table in the current schema of its source.

    Files of older schema versions give NULL for newer columns, and no file footers
    have to be read to find that out.
    """
    return spark.read.schema(bronze_schema(source)).parquet(table)

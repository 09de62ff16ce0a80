"""The daily call counts, kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import rules
from holdfast.plans.marts import daily_counts
from holdfast.functions.rates import count_true, rows
from holdfast.streaming.partials import Partials

COUNTS = ["total_calls", "competitor_mentions", "saves", "disconnect_intent_calls"]


def stream_daily_counts(
    spark: SparkSession, folder: str, schema: T.StructType, table: str, checkpoint: str,
    disconnect_topics=rules.DISCONNECT_TOPICS,
) -> DataFrame:
    """Counts per day from all files seen so far.

    Each micro-batch adds its own partial counts, which are merged level by level (``Partials``), and the reader
    adds them up.  A retried batch counts once, and a call that arrives months late still counts: there is no
    watermark that could drop it and no state that grows.
    """
    partials = _partials(spark, table, schema, disconnect_topics)

    def write_partial(batch: DataFrame, batch_id: int) -> None:
        partials.add(daily_counts(batch, disconnect_topics), batch_id)

    calls = spark.readStream.schema(schema).json(folder)
    run = (
        calls.writeStream.foreachBatch(write_partial).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return read_daily_counts(partials)


def _partials(spark: SparkSession, table: str, schema: T.StructType, disconnect_topics=rules.DISCONNECT_TOPICS) -> Partials:
    return Partials(spark, table, ["call_date"], daily_counts(spark.createDataFrame([], schema), disconnect_topics))


def read_daily_counts(partials: Partials) -> DataFrame:
    """Sum of the partial counts of all batches."""
    return partials.read().groupBy("call_date").agg(*[F.sum(c).alias(c) for c in COUNTS])


def stream_closed_days(
    spark: SparkSession, folder: str, schema: T.StructType, table: str, checkpoint: str, lateness: str = "2 days",
    at: str = "call_date",
) -> DataFrame:
    """Days that can no longer change, given the allowed lateness, each written exactly once.

    For readers that must not see a day revised.  Calls later than ``lateness`` are not in
    this table; ``stream_daily_counts`` has them.
    """
    calls = spark.readStream.schema(schema).json(folder).withColumn("_at", F.col(at).try_cast("timestamp"))
    closed = (
        calls.withWatermark("_at", lateness).groupBy(F.window("_at", "1 day").alias("_day"))
        .agg(
            rows().alias("total_calls"), count_true(F.col("competitor_mentioned")).alias("competitor_mentions"),
            count_true(F.col("outcome") == "Saved").alias("saves"),
        )
        .select(F.col("_day.start").cast("date").alias("call_date"), "total_calls", "competitor_mentions", "saves")
    )
    run = (
        closed.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(table)
    )
    run.awaitTermination()
    return spark.read.parquet(table)

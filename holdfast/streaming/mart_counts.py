"""The marts kept up to date at the cost of the new calls only.

The aggregated marts rest on additive counts per agent, topic, offer and day.  Each micro-batch
adds its counts as one partial; a refresh sums the partials, which are small and merged level by
level, instead of reading all calls again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import rules
from holdfast.functions.rates import count_true, exact_total, rows
from holdfast.plans import marts
from holdfast.streaming.partials import Partials

KEYS = ["agent_id", "call_topic", "offer_id", "competitor_id", "call_date"]
# What each mart is counted by.
GRAINS = {"agents": ["agent_id"], "topics": ["call_topic"], "offers": ["offer_id", "competitor_id"], "days": ["call_date"]}


def partial_counts(calls: DataFrame, disconnect_topics=rules.DISCONNECT_TOPICS) -> DataFrame:
    """The counts of all four grains from a single pass, told apart by ``grain``."""
    keyed = calls.withColumn("offer_id", F.col("offer_presented_id")).withColumn(
        "call_date", F.col("call_date").try_cast("date")
    )
    outcome = F.col("outcome")
    counted = keyed.groupingSets([GRAINS[g] for g in GRAINS], *KEYS).agg(
        F.grouping_id().alias("_set"),
        rows().alias("total_calls"),
        count_true(outcome == "Saved").alias("saves"),
        count_true(outcome == "Churned").alias("churned"),
        count_true(F.col("competitor_mentioned")).alias("competitor_mentions"),
        count_true(F.col("offer_accepted")).alias("accepted"),
        count_true(F.col("call_topic").isin(*disconnect_topics)).alias("disconnect_intent_calls"),
        exact_total("handle_time_min").alias("handle_time_sum"),
        F.count("handle_time_min").alias("handled_calls"),
    )
    return counted.withColumn("grain", _grain(F.col("_set"))).drop("_set")


def _grain(grouping: Column) -> Column:
    """Name of a grouping set; its number has a bit for every key that is not in the set."""
    chosen = None
    for grain, keys in GRAINS.items():
        number = sum(1 << (len(KEYS) - 1 - i) for i, key in enumerate(KEYS) if key not in keys)
        chosen = F.when(grouping == number, grain) if chosen is None else chosen.when(grouping == number, grain)
    return chosen


def stream_mart_counts(
    spark: SparkSession, folder: str, schema: T.StructType, table: str, checkpoint: str,
    disconnect_topics=rules.DISCONNECT_TOPICS, source: str = "json",
) -> DataFrame:
    """Count the files that are new since the last run; returns the partials of all runs.

    The files are landed JSON, or a bronze table with ``source="parquet"``.

    A batch that is retried counts once.
    """
    partials = mart_partials(spark, table, schema, disconnect_topics)

    def write_partial(batch: DataFrame, batch_id: int) -> None:
        partials.add(partial_counts(batch, disconnect_topics), batch_id)

    calls = spark.readStream.schema(schema).format(source).load(folder)
    run = (
        calls.writeStream.foreachBatch(write_partial).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return partials.read()


def mart_partials(spark: SparkSession, table: str, schema: T.StructType, disconnect_topics=rules.DISCONNECT_TOPICS) -> Partials:
    """The kept counts of all four grains."""
    return Partials(spark, table, [*KEYS, "grain"], partial_counts(spark.createDataFrame([], schema), disconnect_topics))


def counts_of(partials: DataFrame, grain: str) -> DataFrame:
    """Counts of one grain, added up over all partials."""
    keys = GRAINS[grain]
    sums = [c for c in partials.columns if c not in {*KEYS, "grain", "batch_id"}]
    summed = partials.where(F.col("grain") == grain).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    summed = summed.where(F.col("total_calls") > 0)  # all calls of a group may have been taken back
    # Calls without an offer or a readable day belong to no row of those marts.
    return summed.where(F.col(keys[0]).isNotNull()) if grain in ("offers", "days") else summed


def marts_of(
    partials: DataFrame, customers: DataFrame, agents: DataFrame, competitors: DataFrame, offers: DataFrame, **kpi_settings
) -> dict[str, DataFrame]:
    """The aggregated marts from partial counts; equal to those computed from all calls."""
    return {
        "agent_performance": marts.agent_performance_of(counts_of(partials, "agents"), agents),
        "offer_effectiveness": marts.offer_effectiveness_of(counts_of(partials, "offers"), competitors, offers),
        "topic_mix": marts.topic_mix_of(counts_of(partials, "topics")),
        "daily_kpis": marts.daily_kpis_of(counts_of(partials, "days"), customers, **kpi_settings),
    }

"""Ingest what is new, then rebuild the marts."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast import rules, schemas
from holdfast.functions.rates import rows
from holdfast.operators.history import dedupe_latest
from holdfast.plans import marts, model, scoring
from holdfast.plans.fact_store import BUCKETS, FactStore, latest_calls
from holdfast.session import estimated_bytes, materialize
from holdfast.sources.publish import publish_snapshot, publish_table
from holdfast.streaming.ingest import bronze_schema, ingest_stream, read_bronze
from holdfast.streaming.mart_counts import KEYS, mart_partials, marts_of, partial_counts
from holdfast.streaming.partials import Partials, negated


@dataclass
class Store:
    """Folders of one deployment, all below a root that every executor can reach."""

    root: str

    def landing(self, source: str) -> str:
        return f"{self.root}/landing/{source}"

    def bronze(self, source: str) -> str:
        return f"{self.root}/bronze/{source}"

    def checkpoint(self, source: str) -> str:
        return f"{self.root}/checkpoints/{source}"

    def snapshots(self, name: str) -> str:
        return f"{self.root}/snapshots/{name}"

    def mart(self, name: str, version: str) -> str:
        return f"{self.root}/marts/{version}/{name}"


def refresh_marts(
    spark: SparkSession, store: Store, version: str, incremental: bool = False,
    disconnect_topics=rules.DISCONNECT_TOPICS, unique_key: Mapping[str, str] | None = None, fact_buckets: int = BUCKETS,
    **kpi_settings,
) -> dict[str, DataFrame]:
    """Run the ingestion of all sources and write a new version of the five marts.

    Running it again without new files rebuilds the same marts: ingestion adds nothing, and each version is written to
    its own folder.  ``unique_key`` names the key of sources of which a drop may land twice, or corrected: of rows with
    equal keys the latest arrival counts.

    With ``incremental`` the call table and the counts below the four aggregated marts are kept from refresh to refresh:
    only new calls are read, joined and counted, calls whose key comes again are taken back, and of the call table
    only folders with calls of changed dimension rows are rewritten.  The call table is then read where it is kept.
    All refreshes of a store must use the same ``disconnect_topics``, key of the calls and number of ``fact_buckets``
    (among which the call table is dealt out by customer).
    """
    keys = dict(unique_key or {})
    bronze = {
        name: ingest_stream(spark, store.landing(name), store.bronze(name), schema, store.checkpoint(name))
        for name, schema in schemas.SOURCES.items()
    }
    call_key = keys.get("call_interactions")
    for name, key in keys.items():
        if not (incremental and name == "call_interactions"):
            bronze[name] = dedupe_latest(bronze[name], [key], ["_ingested_at", "_source_file"])
    calls, customers, agents = bronze["call_interactions"], bronze["customer_profiles"], bronze["agents"]
    competitors, offers = bronze["competitor_intel"], bronze["retention_offers"]
    if incremental:
        facts, partials = _kept_up(spark, store, bronze, call_key, disconnect_topics, fact_buckets)
        plans = marts_of(partials, customers, agents, competitors, offers, **kpi_settings)
        kept = {"call_fact": facts.read()}
    else:
        kept, plans = {}, {
            "call_fact": marts.call_fact(calls, customers, agents, competitors, offers),
            "agent_performance": marts.agent_performance(calls, agents),
            "offer_effectiveness": marts.offer_effectiveness(calls, competitors, offers),
            "topic_mix": marts.topic_mix(calls),
            "daily_kpis": marts.daily_kpis(calls, customers, disconnect_topics=disconnect_topics, **kpi_settings),
        }
    return kept | {name: publish_table(plan, store.mart(name, version)) for name, plan in plans.items()}


def _kept_up(
    spark: SparkSession, store: Store, bronze: dict[str, DataFrame], key: str | None, disconnect_topics, buckets: int
) -> tuple[FactStore, DataFrame]:
    """The call table and the partial counts, with the calls that are new in bronze."""
    facts = FactStore(spark, store.bronze("call_facts"), buckets)
    schema = bronze_schema(schemas.SOURCES["call_interactions"])
    partials = mart_partials(spark, store.bronze("mart_counts"), schema, disconnect_topics)
    facts.propagate(bronze)

    def add(batch: DataFrame, batch_id: int) -> None:
        # With a key the batch is read several times, and choosing its latest calls is an exchange.
        calls = materialize(latest_calls(batch, key), "batch", "zstd") if key else batch
        add_calls(facts, partials, calls, bronze, batch_id, key, disconnect_topics)

    new = spark.readStream.schema(schema).parquet(store.bronze("call_interactions"))
    run = (
        new.writeStream.foreachBatch(add).option("checkpointLocation", store.checkpoint("mart_counts"))
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return facts, partials.read()


def add_calls(
    facts: FactStore, partials: Partials, calls: DataFrame, dims: Mapping[str, DataFrame], batch_id: int,
    key: str | None = None, disconnect_topics=rules.DISCONNECT_TOPICS,
) -> None:
    """Take a batch of calls, with at most one row for each ``key``, into the call table and the counts.

    With a key the batch is read several times, so hand over a written table or a narrow plan on one.  Calls that the
    table holds as they are change neither it nor the counts.
    The counts are written before the table changes, as they need the rows that the batch replaces; a batch that is
    retried in between finds its counts there and only changes the table.
    """
    marks, size, version = None, estimated_bytes(calls), facts.table.current()
    if key and version.entries and not (partials.has(batch_id) and batch_id <= version.batch):
        calls, marks = facts.changed(calls, key)
    if not partials.has(batch_id):
        counts = partial_counts(calls, disconnect_topics)
        if marks is not None:
            back = partial_counts(facts.replaced(calls, key, marks), disconnect_topics)
            counts = counts.unionByName(negated(back, [*KEYS, "grain"]))
        partials.add(counts, batch_id)
    facts.append(calls, dims, batch_id, key, marks, size)


def refresh_scores(
    spark: SparkSession, store: Store, version: str, critical_share: float = rules.CRITICAL_SHARE, **tree_settings
) -> tuple[DataFrame, DataFrame, str]:
    """Train on the ingested tables, score every customer, publish the score table and its keyed snapshot.

    Returns the table, the training report and the snapshot's folder.  The feature table is
    written once; training, scoring and ranking read that.
    """
    def bronze(name: str) -> DataFrame:
        return read_bronze(spark, store.bronze(name), schemas.SOURCES[name])

    frame = materialize(
        scoring.scoring_frame(bronze("customer_profiles"), bronze("call_interactions"), bronze("service_events")), "features"
    )
    trained, report = model.train_churn(frame, **tree_settings)
    scores = scoring.churn_scores(model.score_customers(trained, frame), critical_share)
    table = publish_table(scores, store.mart("churn_scores", version))
    return table, report, publish_snapshot(table, store.snapshots("churn_scores"), "customer_id", version)


def mart_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each mart."""
    counted = [frame.agg(rows().alias("n_rows")).select(F.lit(name).alias("mart"), "n_rows") for name, frame in tables.items()]
    result = counted[0]
    for part in counted[1:]:
        result = result.unionByName(part)
    return result


def full_refresh(spark: SparkSession, landing_root: str, new_root: str, version: str, **kpi_settings) -> dict[str, DataFrame]:
    """Read every landed file again into new bronze tables with new checkpoints."""
    class _Fresh(Store):
        def landing(self, source: str) -> str:
            return f"{landing_root}/landing/{source}"

    return refresh_marts(spark, _Fresh(new_root), version, **kpi_settings)

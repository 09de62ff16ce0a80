import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import schemas
from holdfast.operators.history import dedupe_latest
from holdfast.operators.notes import unlabeled_filter
from holdfast.plans import refresh
from holdfast.sources import evolve, landing, publish
from holdfast.streaming.daily_counts import stream_daily_counts
from holdfast.streaming.ingest import ingest_stream
from holdfast.streaming.mart_counts import marts_of, stream_mart_counts

CALLS = schemas.SOURCES["call_interactions"]


def calls(spark, first, n, day="2026-05-01", **extra):
    frame = spark.range(first, first + n).select(
        F.concat(F.lit("CALL-NEW-"), F.col("id").cast("string")).alias("call_id"), F.lit("CUST-1").alias("customer_id"),
        F.lit("AGT-1").alias("agent_id"), F.lit(day).alias("call_date"), F.lit(9.5).alias("handle_time_min"),
        (F.col("id") % 2 == 0).alias("competitor_mentioned"), F.lit("my bill went up").alias("mention_text"),
        F.lit(False).alias("offer_accepted"), F.lit("Saved").alias("outcome"),
    )
    return frame.withColumns({k: F.lit(v) for k, v in extra.items()})


@pytest.fixture
def store(tmp_path):
    return refresh.Store(str(tmp_path))


def run(spark, store, source="call_interactions"):
    return ingest_stream(spark, store.landing(source), store.bronze(source), schemas.SOURCES[source], store.checkpoint(source))


def test_only_new_files_are_read(spark, store):
    folder = store.landing("call_interactions")
    landing.land_json(calls(spark, 0, 10, call_topic="Billing Dispute", offer_presented_id="OFF-06"), folder)
    assert run(spark, store).count() == 10
    landing.land_increment(calls(spark, 10, 5), folder)  # without topic and offer
    bronze = run(spark, store)
    assert bronze.count() == 15 and bronze.where("call_topic IS NULL").count() == 5
    assert run(spark, store).count() == 15
    assert bronze.where("_source_file IS NULL OR _ingested_at IS NULL").count() == 0
    landing.land_increment(calls(spark, 10, 5), folder)  # the same batch again
    again = run(spark, store)
    assert again.count() == 20
    assert dedupe_latest(again.drop("_extra"), ["call_id"], ["_ingested_at", "_source_file"]).count() == 15
    assert unlabeled_filter(again).count() == 20


def test_a_new_schema_version_reads_old_and_new_rows(spark, tmp_path):
    v1 = T.StructType([T.StructField("a", T.LongType())])
    added = T.StructType([T.StructField("b", T.DoubleType())])
    folder, table, checkpoint = (str(tmp_path / n) for n in ("landing", "bronze", "checkpoint"))
    landing.land_increment(spark.createDataFrame([(1, 1.5)], "a long, b double"), folder)
    ingest_stream(spark, folder, table, v1, checkpoint)
    landing.land_increment(spark.createDataFrame([(2, 2.5)], "a long, b double"), folder)
    landing.land_increment(spark.createDataFrame([(3,)], "a long"), folder)
    bronze = ingest_stream(spark, folder, table, T.StructType([*v1.fields, *added.fields]), checkpoint)
    assert sorted((r.a, r.b is None) for r in bronze.collect()) == [(1, True), (2, False), (3, True)]
    promoted = evolve.promote_extra(bronze, added).orderBy("a").collect()
    assert [(r.a, r.b, r["_extra"]) for r in promoted] == [(1, 1.5, None), (2, 2.5, None), (3, None, None)]


def test_repeated_drops_can_be_left_out(spark, store):
    source = "call_interactions"
    folder, paths = store.landing(source), (store.bronze(source), CALLS, store.checkpoint(source))
    for first, n, total in [(0, 6, 6), (0, 6, 6), (4, 4, 8)]:
        landing.land_increment(calls(spark, first, n), folder)
        bronze = ingest_stream(spark, folder, *paths, unique_key=["call_id"])
        assert bronze.count() == total
    assert bronze.select("call_id").distinct().count() == 8


def test_evolution_keeps_what_the_schema_does_not_know(spark, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    lines = [
        {"a": 1, "b": "x"}, {"a": 2}, {"a": 3, "b": "z", "c": 2.5, "d": {"k": [1, 2]}}, {"a": "no number", "b": "y"},
    ]
    (folder / "one.json").write_text("\n".join(json.dumps(x) for x in lines) + "\n{broken\n")
    v1 = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    found = evolve.evolve_schema(spark, str(folder), v1).collect()
    assert len(found) == 5
    by_a = {r.a: r for r in found if r.a is not None}
    assert (by_a[1].b, by_a[1]["_extra"]) == ("x", None) and by_a[2].b is None
    assert by_a[3]["_extra"] == {"c": "2.5", "d": '{"k":[1,2]}'}
    assert {r["_corrupt_record"] for r in found if r["_corrupt_record"]} == {"{broken", json.dumps(lines[3])}
    v2 = evolve.promote_extra(evolve.evolve_schema(spark, str(folder), v1), T.StructType([T.StructField("c", T.DoubleType())]))
    row = v2.where("a = 3").first()
    assert row.c == 2.5 and row["_extra"] == {"d": '{"k":[1,2]}'}


def test_late_calls_still_count(spark, store):
    folder, table = store.landing("call_interactions"), store.bronze("daily")
    def update():
        return {r.call_date.isoformat(): r for r in stream_daily_counts(
            spark, folder, CALLS, table, store.checkpoint("daily")).collect()}

    landing.land_increment(calls(spark, 0, 4, "2026-06-01", call_topic="Moving / Relocation"), folder)
    assert update()["2026-06-01"].total_calls == 4
    landing.land_increment(calls(spark, 4, 3, "2026-01-01").unionByName(calls(spark, 7, 2, "2026-06-01")), folder)
    days = update()
    assert (days["2026-06-01"].total_calls, days["2026-06-01"].disconnect_intent_calls) == (6, 4)
    assert (days["2026-01-01"].total_calls, days["2026-01-01"].competitor_mentions, days["2026-01-01"].saves) == (3, 2, 3)
    assert update() == days


def _land_all(spark, store):
    values = {
        "customer_profiles": [{"customer_id": "CUST-1", "market": "Austin", "plan_type": "Internet Only", "has_mobile": False,
                               "tenure_months": 5, "monthly_spend": 60.0, "status": "Churned", "churn_date": "2026-05-01"}],
        "agents": [{"agent_id": "AGT-1", "agent_name": "One", "team": "A", "tier": "At Risk", "nps": 3, "hire_date": "2020-01-01"}],
        "service_events": [{"event_id": "SVC-1", "customer_id": "CUST-1", "event_type": "Outage", "event_date": "2026-05-01"}],
        "competitor_intel": [{"competitor_id": "COMP-01", "competitor_name": "North Fiber", "best_counter_offer_id": "OFF-01"}],
        "retention_offers": [{"offer_id": "OFF-06", "offer_name": "Credit", "price": 0.0, "monthly_cost": 100.0}],
    }
    for name, rows in values.items():
        frame = spark.createDataFrame([tuple(r.get(f.name) for f in schemas.SOURCES[name].fields) for r in rows],
                                      schemas.SOURCES[name])
        landing.land_json(frame, store.landing(name))
    landing.land_json(calls(spark, 0, 10, call_topic="Billing Dispute", offer_presented_id="OFF-06"),
                      store.landing("call_interactions"))


def test_incremental_marts_equal_the_full_ones(spark, store):
    _land_all(spark, store)
    landing.land_increment(calls(spark, 10, 5, "2026-05-02"), store.landing("call_interactions"))
    folder, table = store.landing("call_interactions"), store.bronze("counts")

    def update():
        return stream_mart_counts(spark, folder, CALLS, table, store.checkpoint("counts"))

    update()
    landing.land_increment(calls(spark, 15, 4, "no date", call_topic="Billing Dispute", offer_presented_id="OFF-06"), folder)
    partials = update()
    assert partials.select("batch_id").distinct().count() == 2
    full = refresh.refresh_marts(spark, store, "v1")
    bronze = [spark.read.schema(schemas.SOURCES[n]).json(store.landing(n))
              for n in ("customer_profiles", "agents", "competitor_intel", "retention_offers")]
    for name, frame in marts_of(partials, *bronze).items():
        assert frame.columns == full[name].columns, name
        assert sorted(map(repr, frame.collect())) == sorted(map(repr, full[name].collect())), name


def test_incremental_refresh(spark, store):
    _land_all(spark, store)
    refresh.refresh_marts(spark, store, "v1", incremental=True)
    landing.land_increment(calls(spark, 10, 5, "2026-05-02"), store.landing("call_interactions"))
    kept_up = refresh.refresh_marts(spark, store, "v2", incremental=True)
    rebuilt = refresh.refresh_marts(spark, store, "v3")
    for name, frame in rebuilt.items():
        assert sorted(map(repr, kept_up[name].collect())) == sorted(map(repr, frame.collect())), name


def test_scores_from_ingested_tables(spark, store):
    _land_all(spark, store)
    customers = spark.range(400).select(
        F.concat(F.lit("CUST-"), F.col("id").cast("string")).alias("customer_id"), F.lit("Austin").alias("market"),
        F.when(F.col("id") % 2 == 0, "Internet Only").otherwise("Triple Play").alias("plan_type"),
        (F.col("id") % 3 == 0).alias("has_mobile"), (F.col("id") % 60 + 1).alias("tenure_months"),
        (F.col("id") % 97 + 30.5).alias("monthly_spend"), F.lit("Month-to-Month").alias("contract_type"),
        F.lit(True).alias("autopay_enrolled"),
        F.when(F.col("id") % 60 < 12, "Churned").otherwise("Active").alias("status"),
    )
    landing.land_json(customers, store.landing("customer_profiles"))
    refresh.refresh_marts(spark, store, "v1")
    table, report, snapshot = refresh.refresh_scores(spark, store, "v1", maxIter=5)
    assert table.count() == 400 and spark.read.parquet(snapshot).count() == 400
    assert report.first().test_auc > 0.9
    assert table.where("risk_tier = 'Critical'").count() >= 40
    assert table.where("customer_id = 'CUST-1'").first().n_competitor_calls == 5


def test_refresh_is_repeatable_and_sees_new_drops(spark, store):
    _land_all(spark, store)
    first = refresh.refresh_marts(spark, store, "v1")
    sizes = {r.mart: r.n_rows for r in refresh.mart_sizes(first).collect()}
    assert sizes == {"call_fact": 10, "agent_performance": 1, "offer_effectiveness": 1, "topic_mix": 1, "daily_kpis": 1}
    again = refresh.refresh_marts(spark, store, "v2")
    for name in first:
        assert sorted(map(repr, again[name].collect())) == sorted(map(repr, first[name].collect()))
    landing.land_increment(calls(spark, 10, 5), store.landing("call_interactions"))
    third = refresh.refresh_marts(spark, store, "v3")
    topics = {r.call_topic: r.call_volume for r in third["topic_mix"].collect()}
    assert topics == {"Billing Dispute": 10, None: 5}  # a drop without topics is a group of its own
    assert third["offer_effectiveness"].agg(F.sum("times_presented")).first()[0] == 10
    publish.register_marts(third)
    answer = publish.read_result(spark, "SELECT SUM(call_volume) n FROM gold_call_topics WHERE call_volume > :least", least=1)
    assert answer.first().n == 15
    fresh = refresh.full_refresh(spark, store.root, store.root + "/fresh", "v1")
    assert fresh["call_fact"].count() == 15

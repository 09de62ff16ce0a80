"""Queries that land, ingest and refresh; each writes below the session's scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import schemas
from holdfast.operators.history import dedupe_latest
from holdfast.plans import refresh
from holdfast.plans.fact_store import FactStore
from holdfast.registry import marts
from holdfast.registry.sql import count_if, query, whole
from holdfast.session import materialize, scratch_dir
from holdfast.sources import evolve, landing
from holdfast.sources import star_tables as star
from holdfast.streaming.evolving import EvolvingTable
from holdfast.streaming.daily_counts import stream_closed_days, stream_daily_counts
from holdfast.streaming.ingest import ingest_stream
from holdfast.streaming.mart_counts import mart_partials, marts_of, stream_mart_counts

# Events in three drops: before, between and after these times.
DROP_TIMES = ("2024-01-11", "2024-01-21")
CALL_DROP = "1998-06-01"
EVENT_V1 = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.StringType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
])
EVENT_V2_FIELDS = T.StructType([T.StructField("props", T.StringType())])
LANDED = T.StructType([*EVENT_V1.fields, *EVENT_V2_FIELDS.fields])
CALL_COUNT_SCHEMA = T.StructType([f for f in schemas.SOURCES["call_interactions"].fields])


def _event_drops(spark, sf) -> list[DataFrame]:
    """First drop without ``props``, second without ``value`` either, third with a new ``props`` field."""
    time = F.col("ts")
    events = star.table(spark, sf, "events").withColumn("_at", time).withColumn(
        "ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
    first, second = (F.lit(t).cast("timestamp_ntz") for t in DROP_TIMES)
    return [
        events.where(F.col("_at") < first).drop("_at", "props"),
        events.where((F.col("_at") >= first) & (F.col("_at") < second)).drop("_at", "props", "value"),
        events.where(F.col("_at") >= second).drop("_at"),
    ]


def _whole_drops(spark, sf) -> list[DataFrame]:
    """All columns of the events, in three drops."""
    events = star.table(spark, sf, "events")
    first, second = (F.lit(t).cast("timestamp_ntz") for t in DROP_TIMES)
    time = F.col("ts")
    shown = lambda part: part.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return [shown(events.where(time < first)), shown(events.where((time >= first) & (time < second))),
            shown(events.where(time >= second))]


def _land_json(spark, sf):
    """Landing replaces: after a first drop, the whole table is landed, and that is what the folder holds."""
    folder = scratch_dir(spark, "landing")
    drops = _whole_drops(spark, sf)
    landing.land_json(drops[0], folder)
    landing.land_json(drops[0].unionByName(drops[1]).unionByName(drops[2]), folder, rows_per_file=100_000)
    return spark.read.schema(LANDED).json(folder)


def _land_increment(spark, sf):
    """Landing an increment adds: all drops are in the folder."""
    folder = scratch_dir(spark, "landing")
    for drop in _whole_drops(spark, sf):
        landing.land_increment(drop, folder)
    return spark.read.schema(LANDED).json(folder)


def _ingested(spark, sf):
    """Three drops, ingested one after the other, and once more with nothing new."""
    base = scratch_dir(spark, "ingest")
    folder, table, checkpoint = f"{base}/landing", f"{base}/bronze", f"{base}/checkpoint"
    bronze = None
    for drop in [*_event_drops(spark, sf), None]:
        if drop is not None:
            landing.land_increment(drop, folder)
        bronze = ingest_stream(spark, folder, table, EVENT_V1, checkpoint)
    return bronze


def _ingest_stream(spark, sf):
    return evolve.promote_extra(_ingested(spark, sf), EVENT_V2_FIELDS).select(
        "event_id", "ts", "user_id", "event_type", "value", "props"
    )


def _ingest_metadata(spark, sf):
    """Every bronze row names a file and a time; rows per drop, told by the arrival order."""
    bronze = _ingested(spark, sf)
    return bronze.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("_source_file").rlike(r"/landing/.*\.json(\.gz)?$")).alias("with_file"),
        F.count("_ingested_at").alias("with_time"),
        F.countDistinct("_ingested_at").alias("arrivals"),
    )


def _evolve_schema(spark, sf):
    folder = scratch_dir(spark, "landing")
    for drop in _event_drops(spark, sf):
        landing.land_increment(drop, folder)
    return evolve.promote_extra(evolve.evolve_schema(spark, folder, EVENT_V1), EVENT_V2_FIELDS).select(
        "event_id", "ts", "user_id", "event_type", "value", "props", F.col("_extra").isNull().alias("nothing_left"),
        F.col(evolve.CORRUPT).isNull().alias("readable"),
    )


def _evolving_ingest(spark, sf):
    """Drops whose fields nobody declared: whole numbers, then fractions, then a new field; a version of the schema for each."""
    base = scratch_dir(spark, "evolving")
    table, drops = EvolvingTable(spark, f"{base}/table"), _whole_drops(spark, sf)
    whole_numbers = F.floor("value").cast("long")
    for drop in (drops[0].withColumn("value", whole_numbers).drop("props"), drops[1].drop("props"), drops[2]):
        landing.land_increment(drop, f"{base}/landing")
        table.ingest(f"{base}/landing")
    return table.read().select(*LANDED.fieldNames(), F.col("_schema_version").alias("schema_version"))


def _dedupe_repeated(spark, sf):
    """A batch landed twice: bronze keeps both copies, the latest arrival of each event stays."""
    base = scratch_dir(spark, "repeat")
    folder, table, checkpoint = f"{base}/landing", f"{base}/bronze", f"{base}/checkpoint"
    bronze = None
    for drop in [*_event_drops(spark, sf), _event_drops(spark, sf)[2]]:
        landing.land_increment(drop, folder)
        bronze = ingest_stream(spark, folder, table, EVENT_V1, checkpoint)
    latest = dedupe_latest(bronze, ["event_id"], ["_ingested_at", "_source_file"])
    return evolve.promote_extra(latest, EVENT_V2_FIELDS).select(
        "event_id", "ts", "user_id", "event_type", "value", "props")


def _as_landed(frame: DataFrame, source: str) -> DataFrame:
    """Columns in the landed types: keys and dates become text."""
    schema = schemas.SOURCES[source]
    return frame.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields if f.name in frame.columns])


def _sources(spark, sf) -> dict[str, DataFrame]:
    return {
        "customer_profiles": star.customers(spark, sf), "call_interactions": star.calls(spark, sf),
        "agents": star.agents(spark, sf), "service_events": star.service_events(spark, sf),
        "competitor_intel": star.competitors(spark, sf), "retention_offers": star.offers(spark, sf),
    }


SETTINGS = {"warmup_until": marts.WARMUP_UNTIL, "churn_base": marts.CHURN_BASE, "disconnect_topics": star.DISCONNECT_TOPICS}


def _landed_store(spark, sf) -> refresh.Store:
    """All six sources, landed."""
    store = refresh.Store(scratch_dir(spark, "refresh"))
    for name, frame in _sources(spark, sf).items():
        landing.land_json(_as_landed(frame, name), store.landing(name))
    return store


def _refreshed(spark, sf) -> dict[str, DataFrame]:
    """Ingest the landed sources and build the marts."""
    return refresh.refresh_marts(spark, _landed_store(spark, sf), "v1", **SETTINGS)


def _refresh_marts(spark, sf):
    return refresh.mart_sizes(_refreshed(spark, sf))


def _refresh_repeated(spark, sf):
    """Customers and agents landed twice, with the guard: the days of a single drop."""
    store = _landed_store(spark, sf)
    keys = {"customer_profiles": "customer_id", "agents": "agent_id"}
    for name in keys:
        landing.land_increment(_as_landed(_sources(spark, sf)[name], name), store.landing(name))
    return refresh.refresh_marts(spark, store, "v1", unique_key=keys, **SETTINGS)["daily_kpis"]


def _full_refresh(spark, sf):
    """All landed files again into new tables."""
    store = _landed_store(spark, sf)
    return refresh.full_refresh(spark, store.root, scratch_dir(spark, "full"), "v2", **SETTINGS)["daily_kpis"]


def _agents_of(tables: dict[str, DataFrame]) -> DataFrame:
    return tables["agent_performance"].select(
        "agent_id", "total_calls", "saves", "save_rate", "avg_handle_time_min", "competitor_call_rate",
        "offer_conversion_rate", "save_rate_rank", "team_avg_save_rate", "save_rate_vs_avg",
    )


def _call_drops(spark, sf) -> list[DataFrame]:
    calls = _as_landed(star.calls(spark, sf), "call_interactions")
    return [calls.where(F.col("call_date") >= CALL_DROP), calls.where(F.col("call_date") < CALL_DROP)]


def _stream_daily_counts(spark, sf):
    """The older half of the calls arrives last and still counts."""
    base = scratch_dir(spark, "daily")
    result = None
    for drop in _call_drops(spark, sf):
        landing.land_increment(drop, f"{base}/landing")
        result = stream_daily_counts(
            spark, f"{base}/landing", CALL_COUNT_SCHEMA, f"{base}/counts", f"{base}/checkpoint", star.DISCONNECT_TOPICS
        )
    return result


def _incremental(spark, sf) -> dict[str, DataFrame]:
    """The marts from partial counts of two drops."""
    base = scratch_dir(spark, "incremental")
    partials = None
    for drop in _call_drops(spark, sf):
        landing.land_increment(drop, f"{base}/landing")
        partials = stream_mart_counts(
            spark, f"{base}/landing", CALL_COUNT_SCHEMA, f"{base}/counts", f"{base}/checkpoint", star.DISCONNECT_TOPICS
        )
    dims = {n: _as_landed(f, n) for n, f in _sources(spark, sf).items() if n not in ("call_interactions", "service_events")}
    return marts_of(
        partials, dims["customer_profiles"], dims["agents"], dims["competitor_intel"], dims["retention_offers"],
        warmup_until=marts.WARMUP_UNTIL, churn_base=marts.CHURN_BASE,
    )


def _renamed(dims: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Dimensions before a change: some customers in another market, some agents in another tier, some rows missing."""
    customers, agents = dims["customer_profiles"], dims["agents"]
    return {
        "customer_profiles": customers.where("CAST(customer_id AS LONG) % 50 <> 7").withColumn(
            "market", F.when(F.expr("CAST(customer_id AS LONG) % 40 = 3"), F.lit("elsewhere")).otherwise(F.col("market"))),
        "agents": agents.withColumn("tier", F.when(F.expr("CAST(agent_id AS LONG) % 9 = 4"), F.lit("New")).otherwise(F.col("tier"))),
        "competitor_intel": dims["competitor_intel"].where("competitor_id <> '2'"),
    }


def _kept(spark, drops: list, dims: dict[str, DataFrame], key: str | None = None, before: dict | None = None):
    """Call table and counts after some drops; the first is taken in with the dimensions ``before``."""
    base = scratch_dir(spark, "kept")
    facts = FactStore(spark, f"{base}/facts", buckets=8)
    partials = mart_partials(spark, f"{base}/counts", CALL_COUNT_SCHEMA, star.DISCONNECT_TOPICS)
    for number, drop in enumerate(drops):
        now = dims | before if before and number == 0 else dims
        facts.propagate(now)
        refresh.add_calls(facts, partials, drop, now, number, key, star.DISCONNECT_TOPICS)
    return facts, partials


def _landed_dimensions(spark, sf) -> dict[str, DataFrame]:
    return {n: materialize(_as_landed(f, n), n) for n, f in _sources(spark, sf).items() if n not in ("call_interactions", "service_events")}


def _incremental_fact(spark, sf):
    """The call table after two drops, with dimension rows that change and arrive in between."""
    dims = _landed_dimensions(spark, sf)
    return _kept(spark, _call_drops(spark, sf), dims, before=_renamed(dims))[0].read()


def _corrected(spark, sf):
    """Call table and counts over a wrong drop, its correction with the older half, and that half repeated."""
    # In the test tables a call has no key of its own: equal rows are one call.
    calls = materialize(_as_landed(star.distinct_calls(spark, sf), "call_interactions"), "calls", "zstd")
    wrong = calls.where(F.col("call_date") >= CALL_DROP).withColumns({
        "outcome": F.lit("Saved"), "handle_time_min": F.col("handle_time_min") + 7, "call_topic": F.lit("not yet known"),
        "call_date": F.lit("1990-01-01"), "agent_id": F.lit("1"), "customer_id": F.lit("1")})
    dims = _landed_dimensions(spark, sf)
    return (*_kept(spark, [wrong, calls, calls.where(F.col("call_date") < CALL_DROP)], dims, "call_id"), dims)


def _corrected_marts(spark, sf) -> dict[str, DataFrame]:
    _, partials, dims = _corrected(spark, sf)
    return marts_of(
        partials.read(), dims["customer_profiles"], dims["agents"], dims["competitor_intel"], dims["retention_offers"],
        warmup_until=marts.WARMUP_UNTIL, churn_base=marts.CHURN_BASE)


def _stream_closed_days(spark, sf):
    """Days up to two days before the newest call are final; later ones are not written yet."""
    base = scratch_dir(spark, "closed")
    result = None
    for drop in reversed(_call_drops(spark, sf)):
        landing.land_increment(drop, f"{base}/landing")
        result = stream_closed_days(spark, f"{base}/landing", CALL_COUNT_SCHEMA, f"{base}/days", f"{base}/checkpoint")
    return result


QUERIES = {
    "land_json": _land_json,
    "land_increment": _land_increment,
    "ingest_stream": _ingest_stream,
    "ingest_metadata": _ingest_metadata,
    "evolve_schema": _evolve_schema,
    "evolving_ingest": _evolving_ingest,
    "dedupe_repeated_batch": _dedupe_repeated,
    "refresh_marts": _refresh_marts,
    "stream_daily_counts": _stream_daily_counts,
    "stream_closed_days": _stream_closed_days,
    "incremental_daily_kpis": lambda s, d: _incremental(s, d)["daily_kpis"],
    "incremental_agents": lambda s, d: _agents_of(_incremental(s, d)),
    "incremental_topics": lambda s, d: _incremental(s, d)["topic_mix"],
    "incremental_offers": lambda s, d: _incremental(s, d)["offer_effectiveness"],
    "incremental_fact": _incremental_fact,
    "corrected_fact": lambda s, d: _corrected(s, d)[0].read().drop("call_id"),
    "corrected_agents": lambda s, d: _agents_of(_corrected_marts(s, d)),
    "corrected_topics": lambda s, d: _corrected_marts(s, d)["topic_mix"],
    "corrected_offers": lambda s, d: _corrected_marts(s, d)["offer_effectiveness"],
    "corrected_daily_kpis": lambda s, d: _corrected_marts(s, d)["daily_kpis"],
    "refresh_agents": lambda s, d: _agents_of(_refreshed(s, d)),
    "refresh_topics": lambda s, d: _refreshed(s, d)["topic_mix"],
    "refresh_offers": lambda s, d: _refreshed(s, d)["offer_effectiveness"],
    "refresh_daily_kpis": lambda s, d: _refreshed(s, d)["daily_kpis"],
    "refresh_repeated": _refresh_repeated,
    "full_refresh": _full_refresh,
}

_TS = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts"
_VALUE = f"CASE WHEN ts < TIMESTAMP '{DROP_TIMES[0]}' OR ts >= TIMESTAMP '{DROP_TIMES[1]}' THEN value END AS value"
_PROPS = f"CASE WHEN ts >= TIMESTAMP '{DROP_TIMES[1]}' THEN props END AS props"

_AGENTS = query(
    """SELECT CAST(agent_id AS VARCHAR) AS agent_id, total_calls, saves, save_rate, avg_handle_time_min,
              competitor_call_rate, offer_conversion_rate, save_rate_rank, team_avg_save_rate, save_rate_vs_avg
       FROM agent_performance""", "agent_performance"
)
_OFFERS = query("SELECT * REPLACE (CAST(offer_id AS VARCHAR) AS offer_id) FROM offer_effectiveness", "offer_effectiveness")



def _distinct(sql: str) -> str:
    """The same statement over calls of which equal rows are one."""
    return sql.replace("SELECT 'CALL-'", "SELECT DISTINCT 'CALL-'")


_FACT = f"""SELECT * REPLACE (CAST(customer_id AS VARCHAR) AS customer_id, CAST(agent_id AS VARCHAR) AS agent_id,
                               CAST(team AS VARCHAR) AS team, CAST(offer_presented_id AS VARCHAR) AS offer_presented_id)
            FROM ({marts.ORACLE["call_fact"]})"""

ORACLE = {
    "incremental_fact": _FACT,
    "corrected_fact": _distinct(f"SELECT * EXCLUDE (call_id) FROM ({_FACT})"),
    "corrected_agents": _distinct(_AGENTS),
    "corrected_topics": _distinct(whole("topic_mix")),
    "corrected_offers": _distinct(_OFFERS),
    "corrected_daily_kpis": _distinct(whole("daily_kpis", "call_date")),
    "land_json": f"SELECT event_id, {_TS}, user_id, event_type, value, props FROM events",
    "land_increment": f"SELECT event_id, {_TS}, user_id, event_type, value, props FROM events",
    "ingest_stream": f"SELECT event_id, {_TS}, user_id, event_type, {_VALUE.replace('ts ', 'events.ts ')}, {_PROPS.replace('ts ', 'events.ts ')} FROM events",
    "ingest_metadata": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, COUNT(*) AS n_rows, COUNT(*) AS with_file, COUNT(*) AS with_time,
                                 1 AS arrivals FROM events GROUP BY 1""",
    "evolve_schema": f"""SELECT event_id, {_TS}, user_id, event_type, {_VALUE.replace('ts ', 'events.ts ')}, {_PROPS.replace('ts ', 'events.ts ')},
                                TRUE AS nothing_left, TRUE AS readable FROM events""",
    "evolving_ingest": f"""
        SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, user_id, event_type,
               CASE WHEN events.ts < TIMESTAMP '{DROP_TIMES[0]}' THEN floor(value) ELSE value END AS value,
               {_PROPS.replace('ts ', 'events.ts ')},
               CASE WHEN events.ts < TIMESTAMP '{DROP_TIMES[0]}' THEN 1 WHEN events.ts < TIMESTAMP '{DROP_TIMES[1]}' THEN 2 ELSE 3 END AS schema_version
        FROM events""",
    "dedupe_repeated_batch": f"SELECT event_id, {_TS}, user_id, event_type, {_VALUE.replace('ts ', 'events.ts ')}, {_PROPS.replace('ts ', 'events.ts ')} FROM events",
    "refresh_marts": query(
        """SELECT 'call_fact' AS mart, COUNT(*) AS n_rows FROM calls
           UNION ALL SELECT 'agent_performance', COUNT(DISTINCT agent_id) FROM calls
           UNION ALL SELECT 'offer_effectiveness', COUNT(*) FROM (
             SELECT 1 FROM calls WHERE offer_presented_id IS NOT NULL GROUP BY offer_presented_id, competitor_id)
           UNION ALL SELECT 'topic_mix', COUNT(DISTINCT call_topic) FROM calls
           UNION ALL SELECT 'daily_kpis', COUNT(DISTINCT call_date) FROM calls WHERE call_date >= DATE '1995-02-01'""", "calls"
    ),
    "stream_daily_counts": query(
        f"""SELECT CAST(call_date AS VARCHAR) AS call_date, COUNT(*) AS total_calls, {count_if("competitor_mentioned")} AS competitor_mentions,
                   {count_if("outcome = 'Saved'")} AS saves,
                   {count_if("call_topic IN ('1-URGENT', '2-HIGH')")} AS disconnect_intent_calls
            FROM calls GROUP BY 1""", "calls"
    ),
    "incremental_daily_kpis": whole("daily_kpis", "call_date"),
    "incremental_agents": _AGENTS,
    "incremental_topics": whole("topic_mix"),
    "incremental_offers": _OFFERS,
    "refresh_agents": _AGENTS,
    "refresh_topics": whole("topic_mix"),
    "refresh_offers": _OFFERS,
    "refresh_daily_kpis": whole("daily_kpis", "call_date"),
    "refresh_repeated": whole("daily_kpis", "call_date"),
    "full_refresh": whole("daily_kpis", "call_date"),
    "stream_closed_days": query(
        f"""SELECT CAST(call_date AS VARCHAR) AS call_date, COUNT(*) AS total_calls, {count_if("competitor_mentioned")} AS competitor_mentions,
                   {count_if("outcome = 'Saved'")} AS saves
            FROM calls WHERE call_date + 1 <= (SELECT MAX(call_date) - 2 FROM calls) GROUP BY 1""", "calls"
    ),
}

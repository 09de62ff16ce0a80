"""Queries for the marts and the ranking primitives."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.functions.rates import count_true, rows
from holdfast.operators.ranks import global_rank, rank_pct, topk_per_key
from holdfast.operators.rolling import long_trailing, rolling_rate
from holdfast.plans import marts
from holdfast.registry.sql import query, rate, whole
from holdfast.session import scratch_dir
from holdfast.sources import star_tables as star
from holdfast.sources.rank_table import RankTable

WARMUP_UNTIL = "1995-02-01"
CHURN_BASE = 1500.0


def call_fact(spark, sf):
    return marts.call_fact(
        star.calls(spark, sf), star.customers(spark, sf, with_churn_date=False), star.agents(spark, sf),
        star.competitors(spark, sf), star.offers(spark, sf),
    )


def agent_performance(spark, sf):
    return marts.agent_performance(star.calls(spark, sf, with_orders=False), star.agents(spark, sf))


def offer_effectiveness(spark, sf):
    return marts.offer_effectiveness(
        star.calls(spark, sf, with_orders=False), star.competitors(spark, sf), star.offers(spark, sf)
    )


def topic_mix(spark, sf):
    return marts.topic_mix(star.calls(spark, sf))


def daily_kpis(spark, sf):
    return marts.daily_kpis(
        star.calls(spark, sf), star.customers(spark, sf), WARMUP_UNTIL, CHURN_BASE, star.DISCONNECT_TOPICS
    )


def _global_rank(spark, sf):
    """Rank of every customer by balance, which is not rounded to a small domain."""
    customers = star.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return global_rank(customers, "c_acctbal", "balance_rank")


def _rank_pct(spark, sf):
    """Mean-rank percentile of balances, and of balances tied in hundreds."""
    customers = star.table(spark, sf, "customer").select(
        "c_custkey", "c_acctbal", F.floor(F.col("c_acctbal") / 100).alias("band")
    )
    return rank_pct(rank_pct(customers, "c_acctbal", "balance_pct"), "band", "band_pct")


def _topk_per_key(spark, sf):
    """The 15 dearest lines of each supplier; every column takes part in the order."""
    lines = star.table(spark, sf, "lineitem").select(
        "l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"
    )
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return topk_per_key(lines, ["l_suppkey"], order, 15)


def _rolling_rate(spark, sf):
    """Seven-row rate of high-value events per event type."""
    daily = (
        star.table(spark, sf, "events").groupBy("event_type", F.col("ts").cast("date").alias("day"))
        .agg(rows().alias("n"), count_true(F.col("value") > 20).alias("high"))
    )
    return rolling_rate(daily, "day", "high", "n", 7, "high_rate", series=["event_type"])


def _kept_ranks(spark, sf):
    """Ranks from kept counts, after two thirds of the customers, the others, and a correction of the first third."""
    customers = star.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    third = lambda k: customers.where(F.col("c_custkey") % 3 == k)
    wrong = third(0).select((F.col("c_acctbal") + 1).alias("c_acctbal"))
    table = RankTable(spark, scratch_dir(spark, "rank-table"), "c_acctbal", customers.schema["c_acctbal"].dataType, 500)
    table.apply(wrong.unionByName(third(1).select("c_acctbal")), 0)
    table.apply(third(2), 1)
    table.apply(wrong.withColumn("sign", F.lit(-1)).unionByName(third(0).select("c_acctbal", F.lit(1).alias("sign"))), 2, "sign")
    ranked = global_rank(customers, "c_acctbal", "balance_rank", kept=table.values(ascending=False))
    return rank_pct(ranked, "c_acctbal", "balance_pct", kept=table.values(present=True))


def _rolling_long(spark, sf):
    """Sums over the last thousand events: one series, cut into ranges."""
    events = star.table(spark, sf, "events").select("event_id", F.col("value").cast("decimal(18,6)").alias("value"))
    events = events.withColumn("one", F.lit(1))
    return long_trailing(events, {"value": "last_values", "one": "last_events"}, 1_000, "event_id").drop("one")


QUERIES = {
    "call_fact": call_fact,
    "agent_performance": agent_performance,
    "offer_effectiveness": offer_effectiveness,
    "topic_mix": topic_mix,
    "daily_kpis": daily_kpis,
    "global_rank": _global_rank,
    "rank_pct": _rank_pct,
    "kept_ranks": _kept_ranks,
    "topk_per_key": _topk_per_key,
    "rolling_rate": _rolling_rate,
    "rolling_long": _rolling_long,
}

ORACLE = {
    "call_fact": query(
        """SELECT call_id, c.customer_id, market, plan_type, tenure_months, monthly_spend, c.agent_id, agent_name, team,
                  tier AS agent_tier, CAST(call_date AS VARCHAR) AS call_date, CAST(date_trunc('month', call_date) AS TIMESTAMP) AS call_month,
                  handle_time_min, competitor_mentioned, c.competitor_id, competitor_name, call_topic, mention_text,
                  offer_presented_id, offer_name AS offer_presented, offer_accepted, outcome,
                  CASE WHEN outcome = 'Saved' THEN 1 ELSE 0 END AS is_saved,
                  CASE WHEN outcome = 'Churned' THEN 1 ELSE 0 END AS is_churned
           FROM calls c LEFT JOIN customers u ON u.customer_id = c.customer_id
           LEFT JOIN agents a ON a.agent_id = c.agent_id
           LEFT JOIN competitors k ON k.competitor_id = c.competitor_id
           LEFT JOIN offers o ON o.offer_id = c.offer_presented_id""",
        "calls", "customers", "agents", "competitors", "offers",
    ),
    "agent_performance": whole("agent_performance", "hire_date"),
    "offer_effectiveness": whole("offer_effectiveness"),
    "topic_mix": whole("topic_mix"),
    "daily_kpis": whole("daily_kpis", "call_date"),
    "global_rank": "SELECT c_custkey, c_acctbal, RANK() OVER (ORDER BY c_acctbal DESC) AS balance_rank FROM customer",
    "rank_pct": """
        SELECT c_custkey, c_acctbal, CAST(FLOOR(c_acctbal / 100) AS BIGINT) AS band,
               (RANK() OVER (ORDER BY c_acctbal) - 1 + (COUNT(*) OVER (PARTITION BY c_acctbal) + 1) / CAST(2 AS DOUBLE))
                 / COUNT(*) OVER () AS balance_pct,
               (RANK() OVER (ORDER BY FLOOR(c_acctbal / 100)) - 1
                 + (COUNT(*) OVER (PARTITION BY FLOOR(c_acctbal / 100)) + 1) / CAST(2 AS DOUBLE))
                 / COUNT(*) OVER () AS band_pct
        FROM customer""",
    "topk_per_key": """
        SELECT l_suppkey, l_extendedprice, l_orderkey, l_linenumber, l_partkey,
               ROW_NUMBER() OVER (PARTITION BY l_suppkey
                                  ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS position
        FROM lineitem QUALIFY position <= 15""",
    "rolling_rate": f"""
        SELECT event_type, CAST(day AS VARCHAR) AS day, n, high, {rate("SUM(high) OVER w", "SUM(n) OVER w")} AS high_rate
        FROM (SELECT event_type, CAST(ts AS DATE) AS day, COUNT(*) AS n, COUNT(*) FILTER (WHERE value > 20) AS high
              FROM events GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "kept_ranks": """
        SELECT c_custkey, c_acctbal, RANK() OVER (ORDER BY c_acctbal DESC) AS balance_rank,
               (RANK() OVER (ORDER BY c_acctbal) - 1 + (COUNT(*) OVER (PARTITION BY c_acctbal) + 1) / CAST(2 AS DOUBLE))
                 / COUNT(*) OVER () AS balance_pct
        FROM customer""",
    "rolling_long": """
        SELECT event_id, CAST(value AS DECIMAL(18,6)) AS value, SUM(CAST(value AS DECIMAL(18,6))) OVER w AS last_values, COUNT(*) OVER w AS last_events
        FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)""",
}

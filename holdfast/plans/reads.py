"""Read-side queries over the marts: dashboard figures, app panels and example questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from holdfast import rules
from holdfast.functions.choice import order_in
from holdfast.functions.rates import count_true, exact_mean, exact_sum, null_to_zero, rows, share_pct


def pct(column: str, places: int = 1) -> Column:
    return F.round(F.col(column) * 100, places)


def _critical(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("risk_tier") == "Critical")


# --- daily KPIs ---------------------------------------------------------------

def kpi_churn_peak(kpis: DataFrame) -> DataFrame:
    """The highest churn percentage of the period (shown as the headline figure)."""
    return kpis.agg(F.round(F.max("churn_rate_pct"), 2).alias("churn_rate"))


def kpi_mention_peak(kpis: DataFrame) -> DataFrame:
    return kpis.agg(F.round(F.max("competitor_mention_rate") * 100, 1).alias("competitor_mention_rate_pct"))


def kpi_overall_save(kpis: DataFrame) -> DataFrame:
    overall = F.sum("saves") / F.nullif(F.sum("total_calls").cast("double"), F.lit(0.0)) * 100
    return kpis.agg(F.round(overall, 1).alias("overall_save_rate"))


def kpi_latest(kpis: DataFrame, scores: DataFrame) -> DataFrame:
    """Figures of the last day, and the number of critical customers."""
    day = F.struct("call_date", "churn_rate_pct", "competitor_mention_rate", "save_rate")
    last = kpis.agg(F.max_by(day, "call_date").alias("day")).select(
        "day.call_date",
        *[null_to_zero(F.col(f"day.{c}")).alias(c) for c in ("churn_rate_pct", "competitor_mention_rate", "save_rate")],
    )
    return last.crossJoin(F.broadcast(kpi_critical_count(scores)))


def trend(kpis: DataFrame) -> DataFrame:
    return kpis.select(
        "call_date", "churn_rate_pct", pct("competitor_mention_rate").alias("competitor_mention_pct")
    ).orderBy("call_date")


def baseline_vs_peak(kpis: DataFrame) -> DataFrame:
    return kpis.agg(F.min("churn_rate_pct").alias("baseline_pct"), F.max("churn_rate_pct").alias("peak_pct"))


# --- competitors and topics -----------------------------------------------------

def competitor_share(calls: DataFrame, competitors: DataFrame) -> DataFrame:
    """Mentions by competitor; counted by id first, named afterwards."""
    by_id = calls.where(F.col("competitor_mentioned")).groupBy("competitor_id").agg(rows().alias("_n"))
    return (
        by_id.join(competitors.select("competitor_id", "competitor_name"), "competitor_id", "left")
        .groupBy("competitor_name").agg(F.sum("_n").alias("mention_count"))
        .orderBy(F.desc("mention_count"), "competitor_name")
    )


def competitor_share_pct(calls: DataFrame, competitors: DataFrame) -> DataFrame:
    # One row per competitor, so the total is a window over a handful of rows.
    total = F.sum("mention_count").over(W.partitionBy())
    return competitor_share(calls, competitors).select(
        "competitor_name", F.col("mention_count").alias("mentions"),
        share_pct(F.col("mention_count"), total).alias("pct"),
    ).orderBy(F.desc("mentions"), "competitor_name")


def topics_by_volume(topics: DataFrame) -> DataFrame:
    return topics.select("call_topic", "call_volume", pct("save_rate").alias("save_rate_pct")).orderBy(
        F.desc("call_volume"), "call_topic"
    )


# --- offers ------------------------------------------------------------------------

def offers_by_save(offer_results: DataFrame) -> DataFrame:
    return offer_results.select(
        "offer_name", pct("save_rate").alias("save_rate_pct"), "times_presented", "times_accepted"
    ).orderBy(F.desc("save_rate_pct"), "offer_name")


def offers_vs_competitor(offer_results: DataFrame, competitor_name: str) -> DataFrame:
    return (
        offer_results.where(F.col("competitor_name") == competitor_name)
        .select("offer_name", "save_rate", "times_presented")
        .orderBy(F.desc("save_rate"), "offer_name")
    )


def best_rate_per_offer(offer_results: DataFrame) -> DataFrame:
    """The competitor row with the best save rate of each offer; ties go to the lowest competitor id."""
    order = W.partitionBy("offer_id").orderBy(F.desc("save_rate"), F.asc_nulls_first("competitor_id"))
    return (
        offer_results.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1)
        .select(
            "offer_id", "offer_name",
            *[null_to_zero(F.col(c)).alias(c) for c in ("save_rate", "price", "monthly_cost")],
            "best_for",
        )
    )


def competitor_cards(competitors: DataFrame, offer_results: DataFrame) -> DataFrame:
    """Facts of each competitor with its counter-offer and the best rate that offer reached."""
    # Only counter-offers are ranked and named.
    wanted = competitors.select(F.col("best_counter_offer_id").alias("offer_id")).distinct()
    counter = best_rate_per_offer(offer_results.join(wanted, "offer_id", "left_semi")).select(
        F.col("offer_id").alias("best_counter_offer_id"), F.col("offer_name").alias("counter_offer_name"),
        F.col("save_rate").alias("counter_save_rate"), F.col("price").alias("counter_price"),
        F.col("monthly_cost").alias("counter_monthly_cost"), F.col("best_for").alias("counter_best_for"),
    )
    cards = competitors.join(counter, "best_counter_offer_id", "left")
    if "weaknesses" in cards.columns:  # a comma-separated text in the landed source
        cards = cards.withColumn("weaknesses", F.split("weaknesses", r",\s+"))
    return cards


# --- agents ---------------------------------------------------------------------------

def agents_scatter(agents: DataFrame) -> DataFrame:
    return agents.select(
        "agent_id", "agent_name", "team", "tier", pct("save_rate").alias("save_rate_pct"), "avg_handle_time_min",
        F.col("nps").cast("double").alias("nps"),
    ).orderBy(F.desc("save_rate_pct"), "agent_id")


def agents_lowest(agents: DataFrame, n: int = 20) -> DataFrame:
    return agents.orderBy("save_rate", "agent_id").limit(n).select(
        "agent_id", "agent_name", "team", "tier", pct("save_rate").alias("save_rate_pct"),
        F.round("avg_handle_time_min", 1).alias("avg_handle_time"),
        pct("offer_conversion_rate").alias("offer_conversion_pct"),
        F.col("nps").cast("double").alias("nps"),
    )


def agents_need_coaching(agents: DataFrame, tiers=rules.COACHING_TIERS, n: int = 20) -> DataFrame:
    return agents.where(F.col("tier").isin(*tiers)).orderBy("save_rate", "agent_id").limit(n).select(
        "agent_id", "agent_name", "team", "tier", "save_rate", "avg_handle_time_min", "offer_conversion_rate"
    )


def tier_rollup(agents: DataFrame, tiers=rules.AGENT_TIERS) -> DataFrame:
    """Plain means over the agents of a tier (an agent counts once, whatever the number of calls)."""
    position = order_in(F.col("tier"), tiers, rules.UNKNOWN_TIER_ORDER)
    return agents.groupBy("tier").agg(
        rows().alias("agents"), exact_mean(F.col("save_rate"), 4).alias("avg_save_rate"),
        exact_mean(F.col("avg_handle_time_min"), 1).alias("avg_handle_time"), exact_mean(F.col("nps"), 1).alias("avg_nps"),
    ).withColumn("tier_order", position).orderBy("tier_order", "tier")


# --- at-risk customers -------------------------------------------------------------------

def kpi_critical_count(scores: DataFrame) -> DataFrame:
    return scores.agg(count_true(F.col("risk_tier") == "Critical").alias("critical_customers"))


def critical_avg(scores: DataFrame) -> DataFrame:
    mean = exact_mean(F.col("churn_score"), 4)
    return _critical(scores).agg(rows().alias("critical_customers"), F.round(mean, 3).alias("avg_score"))


def critical_top(scores: DataFrame, n: int = 200) -> DataFrame:
    return _critical(scores).orderBy(F.desc("churn_score"), "customer_id").limit(n).select(
        "customer_id", "market", "plan_type", "monthly_spend", pct("churn_score").alias("churn_score_pct"),
        "recommended_offer_id", "competitor_id",
    )


def roi_case(calls: DataFrame, customers: DataFrame, offers: DataFrame, months: int = 12) -> DataFrame:
    """Revenue kept from active customers with a saved call, against the cost of accepted offers."""
    # Two scans of two columns each; both combine before their small exchanges.
    saved = calls.where(F.col("outcome") == "Saved").select("customer_id").distinct()
    kept = customers.where(F.col("status") == "Active").join(saved, "customer_id", "left_semi").agg(
        rows().alias("saved_customers"),
        F.round(F.coalesce(exact_sum(F.col("monthly_spend")), F.lit(0.0)) * months, 2).alias("protected_revenue"),
    )
    accepted = calls.where("offer_accepted").groupBy(F.col("offer_presented_id").alias("offer_id")).agg(rows().alias("_n"))
    cost = accepted.join(offers.select("offer_id", "monthly_cost"), "offer_id").agg(
        F.coalesce(exact_sum(F.col("_n") * F.col("monthly_cost")), F.lit(0.0)).alias("program_cost")
    )
    multiple = F.round(F.col("protected_revenue") / F.nullif(F.col("program_cost"), F.lit(0.0)), 2)
    return kept.crossJoin(F.broadcast(cost)).withColumn("multiple", multiple)

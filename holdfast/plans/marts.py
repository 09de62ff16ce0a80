"""The retention marts.

Each mart is computed from the raw calls, not from the joined fact: dimension
keys are unique, so only the columns that a mart shows need a join, and that
join happens after the aggregation, on a handful of rows.  Dimension joins carry
no broadcast hint; Spark broadcasts a dimension whose file statistics are small
and falls back to a shuffle join (with skew splitting) for a large one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from holdfast import rules
from holdfast.functions.rates import count_true, exact_mean, exact_total, rate, ratio, rows, share_pct
from holdfast.operators.ranks import global_rank
from holdfast.operators.rolling import fill_days as add_missing_days
from holdfast.operators.rolling import trailing
from holdfast.session import materialize

RATE_DOMAIN = 10_001  # distinct values of a rate in [0, 1] rounded to four places


def _day(column: str) -> Column:
    """Date of an ISO text or a date; text that is no date gives NULL (see ``sources.evolve.quarantine``)."""
    return F.col(column).try_cast("date")


def _is(outcome: str) -> Column:
    return F.col("outcome") == outcome


def call_fact(
    calls: DataFrame, customers: DataFrame, agents: DataFrame, competitors: DataFrame, offers: DataFrame
) -> DataFrame:
    """One row per call with the attributes of its customer, agent, competitor and offer.

    Offers and customers may be too many to broadcast, and then each join exchanges the calls.  Offers come first, as
    they add a single column to what the second exchange carries; days travel as dates.
    """
    customer = customers.select("customer_id", "market", "plan_type", "tenure_months", "monthly_spend")
    agent = agents.select("agent_id", "agent_name", "team", F.col("tier").alias("agent_tier"))
    competitor = competitors.select("competitor_id", "competitor_name")
    offer = offers.select(
        F.col("offer_id").alias("offer_presented_id"), F.col("offer_name").alias("offer_presented")
    )
    shown = ["call_id", "customer_id", "agent_id", "handle_time_min", "competitor_mentioned", "competitor_id", "call_topic",
             "mention_text", "offer_presented_id", "offer_accepted", "outcome"]
    day = F.col("call_date")
    return (
        calls.select(*shown, _day("call_date").alias("call_date"))
        .join(offer, "offer_presented_id", "left")
        .join(customer, "customer_id", "left")
        .join(agent, "agent_id", "left")
        .join(competitor, "competitor_id", "left")
        .select(
            "call_id", "customer_id", "market", "plan_type", "tenure_months", "monthly_spend",
            "agent_id", "agent_name", "team", "agent_tier",
            day, F.date_trunc("month", day).alias("call_month"),
            "handle_time_min", "competitor_mentioned", "competitor_id", "competitor_name",
            "call_topic", "mention_text", "offer_presented_id", "offer_presented", "offer_accepted",
            "outcome",
            F.when(_is("Saved"), 1).otherwise(0).alias("is_saved"),
            F.when(_is("Churned"), 1).otherwise(0).alias("is_churned"),
        )
    )


def _counts(calls: DataFrame, *keys, **more: Column) -> DataFrame:
    """Additive figures per key: sums and counts that can be added up over batches of calls."""
    return calls.groupBy(*keys).agg(
        rows().alias("total_calls"),
        count_true(_is("Saved")).alias("saves"),
        count_true(F.col("competitor_mentioned")).alias("competitor_mentions"),
        *[column.alias(name) for name, column in more.items()],
    )


def _handled() -> dict[str, Column]:
    return {"handle_time_sum": exact_total("handle_time_min"), "handled_calls": F.count("handle_time_min")}


def _mean_handle_time() -> Column:
    return F.round(ratio(F.col("handle_time_sum"), F.col("handled_calls")), 1).alias("avg_handle_time_min")


def _rate_of(part: str) -> Column:
    return rate(F.col(part), F.col("total_calls"))


def agent_counts(calls: DataFrame) -> DataFrame:
    return _counts(calls, "agent_id", accepted=count_true(F.col("offer_accepted")), **_handled())


def agent_performance(calls: DataFrame, agents: DataFrame) -> DataFrame:
    """Calls, rates and peer rank for each agent that took at least one call."""
    return agent_performance_of(agent_counts(calls), agents)


def agent_performance_of(counts: DataFrame, agents: DataFrame) -> DataFrame:
    """The agent mart from additive counts."""
    measured = counts.select(
        "agent_id", "total_calls", "saves", _rate_of("saves").alias("save_rate"), _mean_handle_time(),
        _rate_of("competitor_mentions").alias("competitor_call_rate"),
        _rate_of("accepted").alias("offer_conversion_rate"),
    )
    profile = agents.select("agent_id", "agent_name", "team", "tier", "nps", "hire_date")
    # Ranks and the mean read this table again; the calls behind it are scanned once.
    known = materialize(profile.join(measured, "agent_id"), "agent_performance")
    ranked = global_rank(known, "save_rate", "save_rate_rank", domain_bound=RATE_DOMAIN)
    team = known.agg(exact_mean(F.col("save_rate"), 4).alias("_mean"))
    return ranked.crossJoin(F.broadcast(team)).select(
        "agent_id", "agent_name", "team", "tier", "nps", "hire_date", "total_calls", "saves", "save_rate",
        "avg_handle_time_min", "competitor_call_rate", "offer_conversion_rate", "save_rate_rank",
        F.round("_mean", 4).alias("team_avg_save_rate"),
        F.round(F.col("save_rate") - F.col("_mean"), 4).alias("save_rate_vs_avg"),
    )


def offer_counts(calls: DataFrame) -> DataFrame:
    presented = calls.where(F.col("offer_presented_id").isNotNull())
    key = F.col("offer_presented_id").alias("offer_id")
    return _counts(presented, key, "competitor_id", accepted=count_true(F.col("offer_accepted")))


def offer_effectiveness(calls: DataFrame, competitors: DataFrame, offers: DataFrame) -> DataFrame:
    """Results of each offer against each competitor; "no competitor" is a group of its own."""
    return offer_effectiveness_of(offer_counts(calls), competitors, offers)


def offer_effectiveness_of(counts: DataFrame, competitors: DataFrame, offers: DataFrame) -> DataFrame:
    """The offer mart from additive counts."""
    presented = counts.select(
        "offer_id", "competitor_id", F.col("total_calls").alias("times_presented"),
        F.col("accepted").alias("times_accepted"), _rate_of("saves").alias("save_rate"),
    )
    return (
        presented.join(competitors.select("competitor_id", "competitor_name"), "competitor_id", "left")
        .join(
            offers.select("offer_id", "offer_name", "price", "monthly_cost", "cost_type", "base_save_rate", "best_for"),
            "offer_id", "left",
        )
        .select(
            "offer_id", "offer_name", "competitor_id", "competitor_name", "times_presented", "times_accepted",
            "save_rate", "price", "monthly_cost", "cost_type", "base_save_rate", "best_for",
        )
    )


def topic_counts(calls: DataFrame) -> DataFrame:
    return _counts(calls, "call_topic", churned=count_true(_is("Churned")), **_handled())


def topic_mix(calls: DataFrame) -> DataFrame:
    """Volume, outcome rates and share of all calls for each topic; a missing topic is a group."""
    return topic_mix_of(topic_counts(calls))


def topic_mix_of(counts: DataFrame) -> DataFrame:
    """The topic mart from additive counts."""
    # One row per topic, a short fixed list, so the total is a window over a handful of rows.
    total = F.sum("total_calls").over(W.partitionBy())
    return counts.select(
        "call_topic", F.col("total_calls").alias("call_volume"), _rate_of("saves").alias("save_rate"),
        _rate_of("churned").alias("churn_rate"), _mean_handle_time(),
        _rate_of("competitor_mentions").alias("competitor_mention_rate"),
        share_pct(F.col("total_calls"), total).alias("pct_of_calls"),
    )


def daily_counts(calls: DataFrame, disconnect_topics=rules.DISCONNECT_TOPICS) -> DataFrame:
    """Additive counts per call day, for the calls that have a day."""
    dated = calls.withColumn("call_date", _day("call_date")).where(F.col("call_date").isNotNull())
    disconnect = count_true(F.col("call_topic").isin(*disconnect_topics))
    return _counts(dated, "call_date", disconnect_intent_calls=disconnect)


def daily_kpis(
    calls: DataFrame, customers: DataFrame, warmup_until: str | None = None,
    churn_base: float = rules.CHURN_BASE, disconnect_topics=rules.DISCONNECT_TOPICS, fill_gaps: bool = False,
) -> DataFrame:
    """Daily counts with 7-row mention and save rates and the 30-row churn percentage.

    The warm-up rows are cut after the windows, so the first days shown have full windows.
    ``fill_gaps`` turns the row windows into calendar windows.
    """
    return daily_kpis_of(daily_counts(calls, disconnect_topics), customers, warmup_until, churn_base, fill_gaps)


def daily_kpis_of(
    counts: DataFrame, customers: DataFrame, warmup_until: str | None = None, churn_base: float = rules.CHURN_BASE,
    fill_gaps: bool = False,
) -> DataFrame:
    """The daily mart from additive counts."""
    days = counts.select("call_date", "total_calls", "competitor_mentions", "saves", "disconnect_intent_calls")
    churned = (
        customers.where((F.col("status") == "Churned") & _day("churn_date").isNotNull())
        .groupBy(_day("churn_date").alias("call_date"))
        .agg(rows().alias("churned"))
    )
    joined = days.join(churned, "call_date", "left").withColumn("churned", F.coalesce("churned", F.lit(0)))
    if fill_gaps:
        counts = [c for c in joined.columns if c != "call_date"]
        joined = add_missing_days(joined, "call_date", counts)
    short, long = rules.MENTION_WINDOW_ROWS, rules.CHURN_WINDOW_ROWS
    calls_in_window = trailing("total_calls", short, "call_date")
    result = joined.select(
        "*",
        rate(trailing("competitor_mentions", short, "call_date"), calls_in_window).alias("competitor_mention_rate"),
        rate(trailing("saves", short, "call_date"), calls_in_window).alias("save_rate"),
        F.round(F.lit(100.0) * trailing("churned", long, "call_date") / F.lit(churn_base), 3).alias("churn_rate_pct"),
    )
    if warmup_until is not None:
        result = result.where(F.col("call_date") >= F.lit(warmup_until).cast("date"))
    return result

"""Churn features, score calibration, risk tiers and the next best offer."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import rules
from holdfast.functions.choice import first_match, lookup
from holdfast.functions.rates import count_true, rows
from holdfast.operators.ranks import rank_pct
from holdfast.session import materialize

FEATURES = [
    "tenure_months", "monthly_spend", "n_calls", "n_competitor_calls", "ever_competitor", "n_events",
    "n_quality_events", "is_month_to_month", "is_internet_only", "no_mobile", "low_tenure", "no_autopay",
]


def churn_features(
    customers: DataFrame, calls: DataFrame, service_events: DataFrame, quality_events=rules.QUALITY_EVENTS
) -> DataFrame:
    """One row per customer: profile, call behaviour, service events and the churn label.

    Both histories are aggregated to one row per customer before they are joined,
    so a customer with very many calls never meets the join as more than one row.
    """
    return _profiles(customers, customer_history(calls), service_events, quality_events).drop("competitor_id")


def scoring_frame(
    customers: DataFrame, calls: DataFrame, service_events: DataFrame, quality_events=rules.QUALITY_EVENTS,
    **flag_names: str,
) -> DataFrame:
    """Features, flags and the dominant competitor of every customer from a single pass over the calls."""
    profiles = _profiles(customers, customer_history(calls), service_events, quality_events)
    return churn_feature_flags(profiles, **flag_names)


def customer_history(calls: DataFrame) -> DataFrame:
    """Calls, competitor calls and dominant competitor per customer.

    Counted per (customer, competitor) first; the second step sees one row per
    competitor of a customer, whatever the number of calls.
    """
    mentioned = F.coalesce("competitor_mentioned", F.lit(False))
    counted = calls.groupBy("customer_id", "competitor_id", mentioned.alias("_mentioned")).agg(rows().alias("_n"))
    best = F.min(F.when(F.col("_mentioned"), F.struct((-F.col("_n")).alias("rank"), F.col("competitor_id"))))
    return counted.groupBy("customer_id").agg(
        F.sum("_n").alias("n_calls"),
        F.sum(F.when(F.col("_mentioned"), F.col("_n")).otherwise(0)).alias("n_competitor_calls"),
        best.alias("_best"),
    ).withColumn("competitor_id", F.col("_best.competitor_id")).drop("_best")


def _profiles(customers: DataFrame, call_history: DataFrame, service_events: DataFrame, quality_events) -> DataFrame:
    service_history = service_events.groupBy("customer_id").agg(
        rows().alias("n_events"),
        count_true(F.col("event_type").isin(*quality_events)).alias("n_quality_events"),
    )

    def count_or_zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).alias(name)

    return (
        customers.join(call_history, "customer_id", "left")
        .join(service_history, "customer_id", "left")
        .select(
            "customer_id", "plan_type", "has_mobile", "tenure_months", "monthly_spend", "contract_type",
            "autopay_enrolled", "internet_speed", "market",
            count_or_zero("n_calls"), count_or_zero("n_competitor_calls"),
            F.when(F.col("n_competitor_calls") > 0, 1).otherwise(0).alias("ever_competitor"),
            count_or_zero("n_events"), count_or_zero("n_quality_events"),
            F.when(F.col("status") == "Churned", 1).otherwise(0).alias("label"), "competitor_id",
        )
    )


def churn_feature_flags(
    features: DataFrame, month_to_month: str = "Month-to-Month", internet_only: str = "Internet Only"
) -> DataFrame:
    """Add the five binary model inputs; an unknown mobile line or autopay counts as none."""
    def flag(condition: Column) -> Column:
        return F.when(condition, 1).otherwise(0)

    return features.withColumns({
        "is_month_to_month": flag(F.col("contract_type") == month_to_month),
        "is_internet_only": flag(F.col("plan_type") == internet_only),
        "no_mobile": flag(~F.coalesce("has_mobile", F.lit(False))),
        "low_tenure": flag(F.col("tenure_months") < 12),
        "no_autopay": flag(~F.coalesce("autopay_enrolled", F.lit(False))),
    })


def calibrated(pct: Column, critical_share: float = rules.CRITICAL_SHARE) -> Column:
    """Score for a mean-rank percentile: the top share fills the critical band, skewed to its lower end."""
    threshold = 1 - critical_share
    cutoff, span, floor = rules.CRITICAL_CUTOFF, rules.CRITICAL_SPAN, rules.SCORE_FLOOR
    if threshold <= 0:  # everybody is in the critical band
        position = pct
        score = F.lit(cutoff) + position * position * span
    elif threshold >= 1:  # nobody is
        score = F.lit(floor) + pct * (cutoff - floor)
    else:
        position = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (pct - threshold) / (1 - threshold)))
        score = F.when(pct >= threshold, F.lit(cutoff) + position * position * span).otherwise(
            F.lit(floor) + pct / threshold * (cutoff - floor)
        )
    clipped = F.greatest(F.lit(0.01), F.least(F.lit(0.99), score))
    # Rounded to even as numerical libraries do. GREATEST and LEAST would pass over a NULL.
    return F.when(pct.isNotNull(), F.rint(clipped * 10_000) / 10_000)


def calibrate_scores(
    scored: DataFrame, raw: str = "raw_score", critical_share: float = rules.CRITICAL_SHARE,
    domain_bound: int | None = None,
) -> DataFrame:
    """Add ``churn_score`` from the rank of the raw score over all customers."""
    ranked = rank_pct(scored, raw, "_pct", domain_bound)
    return ranked.withColumn("churn_score", calibrated(F.col("_pct"), critical_share)).drop("_pct")


def risk_tier(score: Column) -> Column:
    """Tier of a rounded score."""
    tiers = [(score >= cutoff, F.lit(tier)) for tier, cutoff in rules.TIER_CUTOFFS]
    return first_match(tiers, F.when(score.isNotNull(), F.lit(rules.LOWEST_TIER)))


def dominant_competitor(calls: DataFrame) -> DataFrame:
    """The competitor a customer mentions most; ties go to the lowest competitor id."""
    return customer_history(calls.where(F.col("competitor_mentioned"))).select("customer_id", "competitor_id")


def next_best_offer(
    competitor: Column, counter_offers: Mapping = rules.COUNTER_OFFERS,
    internet_only=rules.INTERNET_ONLY_OFFER, no_mobile=rules.NO_MOBILE_OFFER,
    month_to_month=rules.MONTH_TO_MONTH_OFFER, default=rules.DEFAULT_OFFER,
) -> Column:
    """Counter-offer of the competitor if there is one, else the offer for the customer's profile."""
    by_profile = first_match(
        [
            (F.col("is_internet_only") == 1, F.lit(internet_only)),
            (F.col("no_mobile") == 1, F.lit(no_mobile)),
            (F.col("is_month_to_month") == 1, F.lit(month_to_month)),
        ],
        F.lit(default),
    )
    return F.coalesce(lookup(competitor, counter_offers), by_profile)


def topic_offer(
    competitor: Column, topic: Column, counter_offers: Mapping = rules.COUNTER_OFFERS,
    topic_offers: Mapping = rules.TOPIC_OFFERS,
) -> Column:
    """Offer shown on a call: the competitor's counter-offer when one was mentioned, else the topic's."""
    return F.coalesce(lookup(competitor, counter_offers), lookup(topic, topic_offers))


def churn_scores(
    scored: DataFrame, critical_share: float = rules.CRITICAL_SHARE,
    domain_bound: int | None = None, active_only: bool = False, **offer_rules,
) -> DataFrame:
    """The published score table, one row per customer.

    ``scored`` is a scoring frame with a ``raw_score``.  It is written down first, since
    ranking reads it again.  Customers who already left are ranked with the rest;
    ``active_only`` takes them out of the result.
    """
    result = calibrate_scores(materialize(scored, "scored"), "raw_score", critical_share, domain_bound)
    if active_only:
        result = result.where(F.col("label") == 0)
    return result.select(
        "customer_id", "churn_score", risk_tier(F.col("churn_score")).alias("risk_tier"),
        next_best_offer(F.col("competitor_id"), **offer_rules).alias("recommended_offer_id"),
        "competitor_id", "n_competitor_calls", "monthly_spend", "tenure_months", "plan_type", "market",
    )

"""Declared schemas of the landed sources and the operational tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


# Dates stay ISO strings in the landed JSON and are cast when marts are built.
SOURCES = {
    "customer_profiles": _table(
        customer_id=_S, customer_name=_S, market=_S, plan_type=_S, has_mobile=_B, internet_speed=_S,
        tenure_months=_L, monthly_spend=_D, contract_type=_S, autopay_enrolled=_B, signup_date=_S,
        status=_S, churn_date=_S,
    ),
    "call_interactions": _table(
        call_id=_S, customer_id=_S, agent_id=_S, call_date=_S, handle_time_min=_D,
        competitor_mentioned=_B, competitor_id=_S, call_topic=_S, mention_text=_S,
        offer_presented_id=_S, offer_accepted=_B, outcome=_S,
    ),
    "agents": _table(
        agent_id=_S, agent_name=_S, team=_S, tier=_S, baseline_save_rate=_D, avg_handle_time_min=_D,
        nps=_L, hire_date=_S,
    ),
    "service_events": _table(
        event_id=_S, customer_id=_S, event_type=_S, severity=_S, event_date=_S, duration_min=_L, market=_S,
    ),
    "competitor_intel": _table(
        competitor_id=_S, competitor_name=_S, mention_share=_D, pricing=_S, weaknesses=_S,
        best_counter_offer_id=_S, talk_track=_S,
    ),
    "retention_offers": _table(
        offer_id=_S, offer_name=_S, price=_D, monthly_cost=_D, base_save_rate=_D, cost_type=_S, best_for=_S,
    ),
}

# Payload of an assistant reply.
REPLY = T.StructType([
    T.StructField("output", T.ArrayType(T.StructType([
        T.StructField("type", _S),
        T.StructField("content", T.ArrayType(T.StructType([
            T.StructField("type", _S),
            T.StructField("text", _S),
        ]))),
    ]))),
    T.StructField("choices", T.ArrayType(T.StructType([
        T.StructField("message", T.StructType([T.StructField("content", _S)])),
    ]))),
])

MART_VIEWS = {
    "call_fact": "gold_call_interactions",
    "agent_performance": "gold_agent_performance",
    "offer_effectiveness": "gold_retention_offers",
    "topic_mix": "gold_call_topics",
    "daily_kpis": "gold_churn_metrics",
    "churn_scores": "gold_churn_risk_scores",
}

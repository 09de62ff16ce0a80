import datetime as dt

import pytest
from pyspark.sql import functions as F

from holdfast import schemas
from holdfast.plans import marts, reads

D = dt.date
CALLS = "call_id string, customer_id string, agent_id string, call_date string, handle_time_min double, " \
        "competitor_mentioned boolean, competitor_id string, call_topic string, mention_text string, " \
        "offer_presented_id string, offer_accepted boolean, outcome string"


def call(n, day="2026-05-01", customer="CUST-1", agent="AGT-1", minutes=10.0, mentioned=False, competitor=None,
         topic="Billing Dispute", offer="OFF-06", accepted=False, outcome="Pending"):
    return (f"CALL-{n}", customer, agent, day, minutes, mentioned, competitor, topic, "text", offer, accepted, outcome)


@pytest.fixture
def dims(spark):
    customers = spark.createDataFrame(
        [("CUST-1", "Austin", "Internet Only", 5, 60.0, "Active", None),
         ("CUST-2", "Dallas", "Triple Play", 50, 160.0, "Churned", "2026-05-02"),
         ("CUST-3", "Dallas", "Triple Play", 50, 160.0, "Churned", "2026-05-09"),
         ("CUST-4", "Dallas", "Triple Play", 50, 160.0, "Churned", None)],
        "customer_id string, market string, plan_type string, tenure_months int, monthly_spend double, status string, "
        "churn_date string",
    )
    agents = spark.createDataFrame(
        [("AGT-1", "One", "Team A", "On Target", 40, "2020-01-01"), ("AGT-2", "Two", "Team A", "At Risk", 10, "2021-01-01"),
         ("AGT-9", "Idle", "Team B", "At Risk", 10, "2021-01-01")],
        "agent_id string, agent_name string, team string, tier string, nps int, hire_date string",
    )
    competitors = spark.createDataFrame(
        [("COMP-01", "North Fiber", "OFF-01", "slow evenings, no TV")],
        "competitor_id string, competitor_name string, best_counter_offer_id string, weaknesses string",
    )
    offers = spark.createDataFrame(
        [("OFF-01", "Bundle", 49.99, 15.0, "monthly", 0.68, "x"), ("OFF-06", "Credit", 0.0, 100.0, "one-time", 0.35, "y")],
        "offer_id string, offer_name string, price double, monthly_cost double, cost_type string, base_save_rate double, "
        "best_for string",
    )
    return {"customers": customers, "agents": agents, "competitors": competitors, "offers": offers}


def calls_frame(spark, rows):
    return spark.createDataFrame(rows, CALLS)


def test_call_fact_keeps_calls_with_unknown_keys(spark, dims):
    calls = calls_frame(spark, [
        call(1, mentioned=True, competitor="COMP-01", offer="OFF-01", accepted=True, outcome="Saved"),
        call(2, customer="CUST-X", agent="AGT-X", competitor="COMP-X", offer="OFF-X", topic=None, outcome="Churned"),
        call(3, offer=None),
    ])
    rows = {r.call_id: r for r in marts.call_fact(calls, **dims).collect()}
    assert len(rows) == 3 and len(rows["CALL-1"]) == 24
    assert (rows["CALL-1"].competitor_name, rows["CALL-1"].offer_presented) == ("North Fiber", "Bundle")
    assert (rows["CALL-1"].is_saved, rows["CALL-1"].is_churned) == (1, 0)
    assert rows["CALL-1"].call_date == D(2026, 5, 1) and rows["CALL-1"].call_month == dt.datetime(2026, 5, 1)
    lost = rows["CALL-2"]
    assert (lost.market, lost.agent_name, lost.competitor_name, lost.offer_presented) == (None,) * 4
    assert (lost.is_saved, lost.is_churned) == (0, 1)


def test_agent_performance(spark, dims):
    calls = calls_frame(spark, [
        call(1, outcome="Saved", accepted=True), call(2, outcome="Churned"), call(3, mentioned=True, outcome="Pending"),
        call(4, agent="AGT-2", outcome="Saved"), call(5, agent="AGT-X", outcome="Saved"),
        call(6, agent="AGT-2", mentioned=None, accepted=None, outcome=None),
    ])
    rows = {r.agent_id: r for r in marts.agent_performance(calls, dims["agents"]).collect()}
    assert set(rows) == {"AGT-1", "AGT-2"}  # an agent without calls and an unknown agent are left out
    one, two = rows["AGT-1"], rows["AGT-2"]
    assert (one.total_calls, one.saves, one.save_rate) == (3, 1, 0.3333)
    assert (one.offer_conversion_rate, one.competitor_call_rate) == (0.3333, 0.3333)
    assert (two.save_rate, two.competitor_call_rate) == (0.5, 0.0)  # NULL flags count as no
    assert (two.save_rate_rank, one.save_rate_rank) == (1, 2)
    assert one.team_avg_save_rate == 0.4167  # mean of the rounded rates
    assert one.save_rate_vs_avg == -0.0834


def test_offer_effectiveness_has_a_group_without_competitor(spark, dims):
    calls = calls_frame(spark, [
        call(1), call(2, outcome="Saved", accepted=True), call(3, mentioned=True, competitor="COMP-01"), call(4, offer=None),
        call(5, offer="OFF-X"),
    ])
    rows = {(r.offer_id, r.competitor_id): r for r in
            marts.offer_effectiveness(calls, dims["competitors"], dims["offers"]).collect()}
    assert set(rows) == {("OFF-06", None), ("OFF-06", "COMP-01"), ("OFF-X", None)}
    assert (rows["OFF-06", None].times_presented, rows["OFF-06", None].save_rate) == (2, 0.5)
    assert rows["OFF-X", None].price is None


def test_topic_mix_shares(spark):
    rows = [call(i, topic=t) for i, t in enumerate(["a", "a", "b", None, None, None, "c"])]
    found = {r.call_topic: r for r in marts.topic_mix(calls_frame(spark, rows)).collect()}
    assert found[None].call_volume == 3
    assert sum(r.pct_of_calls for r in found.values()) == pytest.approx(100, abs=0.3)


def test_half_up_rounding(spark):
    rows = [call(i, topic="t", outcome="Saved" if i < 57 else "Pending") for i in range(800)]
    assert marts.topic_mix(calls_frame(spark, rows)).first().save_rate == 0.0713  # 0.07125


def test_daily_kpis_windows_and_gaps(spark, dims):
    days = [f"2026-05-{d:02d}" for d in range(1, 9)] + ["2026-05-20"]
    rows = [call(i, day=day, mentioned=i % 2 == 0, competitor="COMP-01", outcome="Saved" if i == 0 else "Pending")
            for i, day in enumerate(days)]
    calls = calls_frame(spark, rows)
    found = {r.call_date: r for r in marts.daily_kpis(calls, dims["customers"], churn_base=100.0).collect()}
    # A churner on a day without calls is not in the row window; one without a date never counts.
    assert sum(r.churned for r in found.values()) == 1
    assert found[D(2026, 5, 1)].competitor_mention_rate == 1.0
    assert found[D(2026, 5, 8)].competitor_mention_rate == round(3 / 7, 4)
    assert found[D(2026, 5, 20)].competitor_mention_rate == round(4 / 7, 4)  # the window stretches over the gap
    assert found[D(2026, 5, 20)].churn_rate_pct == 1.0
    filled = {r.call_date: r for r in marts.daily_kpis(calls, dims["customers"], fill_gaps=True).collect()}
    assert len(filled) == 20 and filled[D(2026, 5, 18)].competitor_mention_rate is None
    assert filled[D(2026, 5, 20)].competitor_mention_rate == 1.0
    cut = marts.daily_kpis(calls, dims["customers"], warmup_until="2026-05-08", churn_base=100.0).collect()
    assert {r.call_date: r for r in cut} == {d: r for d, r in found.items() if d >= D(2026, 5, 8)}


def test_unreadable_dates_are_kept_and_reported(spark, dims):
    from holdfast.sources.evolve import quarantine

    calls = calls_frame(spark, [call(1), call(2, day="soon"), call(3, day=None)])
    fact = {r.call_id: r.call_date for r in marts.call_fact(calls, **dims).collect()}
    assert fact == {"CALL-1": D(2026, 5, 1), "CALL-2": None, "CALL-3": None}
    assert [r.total_calls for r in marts.daily_kpis(calls, dims["customers"]).collect()] == [1]
    bad = quarantine(calls, {"call_date": "date"}).collect()
    assert [(r.call_id, r["_reason"]) for r in bad] == [("CALL-2", ["call_date is no date"])]


def test_empty_input(spark, dims):
    empty = calls_frame(spark, [])
    assert marts.call_fact(empty, **dims).count() == 0
    assert marts.agent_performance(empty, dims["agents"]).count() == 0
    assert marts.topic_mix(empty).count() == 0
    assert marts.daily_kpis(empty, dims["customers"], fill_gaps=True).count() == 0
    assert reads.kpi_overall_save(marts.daily_kpis(empty, dims["customers"])).first()[0] is None
    assert reads.competitor_share_pct(empty, dims["competitors"]).count() == 0


def test_competitor_cards_and_roi(spark, dims):
    calls = calls_frame(spark, [
        call(1, mentioned=True, competitor="COMP-01", offer="OFF-01", accepted=True, outcome="Saved"),
        call(2, offer="OFF-01", outcome="Pending"),
        call(3, customer="CUST-2", offer="OFF-06", accepted=True, outcome="Saved"),
    ])
    results = marts.offer_effectiveness(calls, dims["competitors"], dims["offers"])
    card = reads.competitor_cards(dims["competitors"], results).first()
    assert (card.counter_offer_name, card.counter_save_rate) == ("Bundle", 1.0)
    assert card.weaknesses == ["slow evenings", "no TV"]
    best = {r.offer_id: r.save_rate for r in reads.best_rate_per_offer(results).collect()}
    assert best == {"OFF-01": 1.0, "OFF-06": 1.0}
    roi = reads.roi_case(calls, dims["customers"], dims["offers"], months=10).first()
    assert tuple(roi) == (1, 600.0, 115.0, 5.22)
    free = reads.roi_case(calls.where(F.lit(False)), dims["customers"], dims["offers"]).first()
    assert tuple(free) == (0, 0.0, 0.0, None)


def test_tier_rollup_order(spark):
    agents = spark.createDataFrame(
        [("a", "At Risk", 0.1, 9.0, 1), ("b", "Top Performer", 0.9, 8.0, 60), ("c", "New Tier", 0.5, 7.0, 30),
         ("d", "Top Performer", 0.7, 8.0, 61)],
        "agent_id string, tier string, save_rate double, avg_handle_time_min double, nps int",
    )
    rows = reads.tier_rollup(agents).collect()
    assert [r.tier for r in rows] == ["Top Performer", "At Risk", "New Tier"]
    assert (rows[0].agents, rows[0].avg_save_rate, rows[0].avg_nps) == (2, 0.8, 60.5)


def test_landed_schemas_cover_the_marts():
    assert set(schemas.SOURCES) == {
        "customer_profiles", "call_interactions", "agents", "service_events", "competitor_intel", "retention_offers"}

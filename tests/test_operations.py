import datetime as dt

import pytest
from pyspark.sql import functions as F

from holdfast.operators import quality, worklist

T0 = dt.datetime(2026, 8, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


@pytest.fixture
def scores(spark):
    return spark.createDataFrame(
        [("C1", "Austin", 0.8, "Critical", "OFF-01", "COMP-01"), ("C2", "Dallas", 0.6, "Critical", "OFF-03", None),
         ("C3", "Dallas", 0.6, "Critical", "OFF-03", None), ("C4", "Dallas", 0.45, "High", "OFF-05", None)],
        "customer_id string, market string, churn_score double, risk_tier string, recommended_offer_id string, competitor_id string",
    )


@pytest.fixture
def cases(spark):
    return spark.createDataFrame(
        [(1, "C1", "COMP-01", "OFF-01", "Open", "Critical"), (2, "C2", None, "OFF-03", "In Progress", "Critical"),
         (3, "C3", None, "OFF-03", "Open", "High"), (4, "C1", None, "OFF-01", "Saved", "Low"),
         (5, "C4", None, "OFF-05", "Open", "Low"), (6, "CX", None, "OFF-05", "Open", "Low")],
        "case_id int, customer_id string, competitor_id string, recommended_offer_id string, status string, priority string",
    )


def actions(spark, rows):
    return spark.createDataFrame(rows, "action_id int, case_id int, committed_at timestamp")


def test_worklist_flag_closes_and_does_not_fan_out(spark, scores, cases):
    open_list = worklist.worklist(scores, cases, actions(spark, [(1, 1, None)]))
    rows = {r.case_id: r for r in open_list.collect()}
    assert set(rows) == {1, 2, 3} and all(r.needs_action for r in rows.values())
    assert [rows[i].priority_rank for i in (1, 2, 3)] == [1, 2, 2]
    assert worklist.refresh_event(open_list).first().detail == '{"flagged_needing_action":3}'
    committed = worklist.worklist(scores, cases, actions(spark, [(1, 1, at(1)), (2, 1, at(2)), (3, 2, None)]))
    assert {r.case_id: r.needs_action for r in committed.collect()} == {1: False, 2: True, 3: True}
    assert committed.count() == 3
    assert [r.case_id for r in worklist.worklist_topn(committed, 2).collect()] == [1, 2]
    assert [r.case_id for r in committed.orderBy(*worklist.worklist_order()).collect()] == [2, 3, 1]


def test_empty_worklist(spark, scores, cases):
    nobody = worklist.worklist(scores.where(F.lit(False)), cases, actions(spark, []))
    assert nobody.count() == 0
    assert worklist.refresh_event(nobody).first().detail == '{"flagged_needing_action":0}'


def test_action_state(spark):
    events = spark.createDataFrame(
        [(1, "proposed", at(1), 1), (1, "approved", at(2), 2), (1, "committed", at(2), 3),
         (2, "proposed", at(1), 4), (3, "committed", at(1), 5), (3, "proposed", at(2), 6),
         (4, "proposed", at(1), 7), (4, "rejected", at(2), 8), (4, "committed", at(3), 9),
         (5, "proposed", at(1), 10), (5, "corrected", at(2), 11)],
        "action_id int, event string, created_at timestamp, event_id int",
    )
    rows = {r.action_id: r for r in worklist.action_state(events, "action_id", "event", "created_at", "event_id").collect()}
    assert [rows[i].approval_status for i in range(1, 6)] == ["approved", "proposed", "proposed", "rejected", "corrected"]
    assert [rows[i].is_valid for i in range(1, 6)] == [True, True, False, False, True]
    assert rows[1].last_event == "committed" and rows[1].committed_at == at(2)


def test_actions_with_offers(spark):
    events = spark.createDataFrame(
        [(1, "proposed", at(1), 1, 10, "a", 7), (1, "corrected", at(2), 2, 11, "b", 7), (1, "committed", at(3), 3, 99, "c", 7),
         (2, "proposed", at(1), 4, 12, "a", 8), (2, "approved", at(1), 5, 13, "d", 8), (2, "committed", at(2), 6, 99, "c", 8),
         (3, "proposed", at(1), 7, 14, "a", 9), (3, "rejected", at(2), 8, 15, "e", 9), (4, "committed", at(1), 9, 1, None, None)],
        "action_id int, event string, created_at timestamp, event_id int, offer int, actor string, customer_id int",
    ).repartition(4)
    state = worklist.action_state(events, "action_id", "event", "created_at", "event_id", "offer", "actor", ["customer_id"])
    rows = {r.action_id: (r.customer_id, r.proposed_offer_id, r.final_offer_id, r.approver) for r in state.collect()}
    assert rows == {1: (7, 10, 11, "b"), 2: (8, 12, 12, "d"), 3: (9, 14, None, "e"), 4: (None, None, None, None)}
    given = worklist.committed_offers(state, "action_id").orderBy("action_id").collect()
    assert [(r.customer_id, r.offer_id, r.presented_at) for r in given] == [(7, 11, at(3)), (8, 12, at(2))]


def test_folding_actions_needs_no_sort(spark):
    events = spark.createDataFrame([(1, "proposed", at(1), 1)], "action_id int, event string, created_at timestamp, event_id int")
    plan = worklist.action_state(events, "action_id", "event", "created_at", "event_id")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_cases_go_round_the_agents(spark, scores):
    many = spark.range(103).select(
        F.concat(F.lit("C"), F.col("id").cast("string")).alias("customer_id"), F.lit("Austin").alias("market"),
        F.lit(0.7).alias("churn_score"), F.lit("Critical").alias("risk_tier"), F.lit("OFF-01").alias("recommended_offer_id"),
        F.lit("COMP-01").alias("competitor_id"),
    )
    agents = spark.createDataFrame([(f"AGT-{i}",) for i in range(8)], "agent_id string")
    opened = worklist.case_open(many, agents)
    per_agent = [r["count"] for r in opened.groupBy("assigned_agent_id").count().collect()]
    assert sum(per_agent) == 103 and sorted(set(per_agent)) == [12, 13]
    best = worklist.case_open(scores, agents).orderBy("assigned_agent_id").collect()
    assert [r.customer_id for r in best][0] == "C1" and len(best) == 3


def test_case_status_priority(spark, cases):
    rows = {(r.status, r.priority): (r.cases, r.is_open) for r in worklist.case_status_priority(cases).collect()}
    assert rows["Open", "Low"] == (2, True) and rows["Saved", "Low"] == (1, False)


def test_constraints(spark):
    agents = spark.createDataFrame([("A1", "One"), ("A1", "Two"), ("A2", None)], "agent_id string, agent_name string")
    cases = spark.createDataFrame(
        [(1, "C1", "A1", "Open", "High", at(1), None), (2, "C2", "A9", "Lost", "High", at(5), at(2)),
         (2, None, None, "Saved", "High", at(1), at(2))],
        "case_id int, customer_id string, assigned_agent_id string, status string, priority string, opened_at timestamp, "
        "closed_at timestamp",
    )
    found = quality.constraint_violations(quality.operational_constraints({"agents": agents, "retention_cases": cases}))
    rows = {(r.table_name, r.rule): r.violations for r in found.collect()}
    assert {k: n for k, n in rows.items() if n} == {
        ("agents", "primary_key(agent_id)"): 1, ("agents", "not_null(agent_name)"): 1,
        ("retention_cases", "primary_key(case_id)"): 1, ("retention_cases", "not_null(customer_id)"): 1,
        ("retention_cases", "domain(status)"): 1, ("retention_cases", "check(closed_at >= opened_at)"): 1,
        ("retention_cases", "foreign_key(assigned_agent_id)"): 1,
    }
    late = quality.temporal_order_check(cases, "opened_at", "closed_at").collect()
    assert [(r.case_id, r.status) for r in late] == [(2, "Lost")]


def test_dataset_checks(spark):
    calls = spark.createDataFrame(
        [("2026-03-27", False, "Saved"), ("2026-03-28", True, "Pending"), ("2026-08-01", True, "Churned"),
         ("2026-08-01", True, "Saved")], "call_date string, competitor_mentioned boolean, outcome string"
    )
    customers = spark.createDataFrame([("Churned",), ("Active",)], "status string")
    rows = {r.metric: r for r in quality.dataset_checks(
        calls, customers, "2026-04-15", ("2026-07-22", "2026-08-04"),
        {"mention_rate": (0.5, 0.8), "mention_rate_baseline": (0.2, 0.3), "mention_rate_spike": (0.9, 1.0),
         "save_rate": (0.4, 0.6), "churned_customers": (1, 1)},
    ).collect()}
    assert [(rows[m].value, rows[m].ok) for m in sorted(rows)] == [
        (1.0, True), (0.75, True), (0.5, False), (1.0, True), (0.5, True)]
    empty = quality.dataset_checks(calls.where(F.lit(False)), customers, "2026-04-15", ("2026-07-22", "2026-08-04"),
                                   {"mention_rate": (0, 1)}).first()
    assert empty.value is None and empty.ok is False

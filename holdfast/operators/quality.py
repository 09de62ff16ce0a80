"""Target checks and constraint checks; every check is a row."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import rules
from holdfast.functions.rates import count_true, exact_mean, ratio, rows


def _as_rows(one_row: DataFrame, metrics: dict[str, tuple[float, float]]) -> DataFrame:
    """Turn a one-row frame of metrics into (metric, value, low, high, ok) rows."""
    cells = [
        F.struct(
            F.lit(name).alias("metric"), F.round(F.col(name).cast("double"), 4).alias("value"),
            F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"),
        )
        for name, (low, high) in metrics.items()
    ]
    listed = one_row.select(F.explode(F.array(*cells)).alias("m")).select("m.*")
    inside = F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(False))
    return listed.withColumn("ok", inside)


def dataset_checks(
    calls: DataFrame, customers: DataFrame, baseline_until: str, spike: tuple[str, str],
    targets: dict[str, tuple[float, float]],
) -> DataFrame:
    """Mention rates (overall, at the start, in the spike), save rate and churners against their targets."""
    day = F.col("call_date").try_cast("date")
    mentioned = F.col("competitor_mentioned")
    in_baseline = day < F.lit(baseline_until).cast("date")
    in_spike = day.between(F.lit(spike[0]).cast("date"), F.lit(spike[1]).cast("date"))
    figures = calls.agg(
        ratio(count_true(mentioned), rows()).alias("mention_rate"),
        ratio(count_true(mentioned & in_baseline), count_true(in_baseline)).alias("mention_rate_baseline"),
        ratio(count_true(mentioned & in_spike), count_true(in_spike)).alias("mention_rate_spike"),
        ratio(count_true(F.col("outcome") == "Saved"), rows()).alias("save_rate"),
    )
    churners = customers.agg(count_true(F.col("status") == "Churned").alias("churned_customers"))
    return _as_rows(figures.crossJoin(F.broadcast(churners)), targets)


def tier_checks(scores: DataFrame) -> DataFrame:
    """Customers and mean score of each risk tier."""
    mean = exact_mean(F.col("churn_score"), 4)
    return scores.groupBy("risk_tier").agg(rows().alias("customers"), F.round(mean, 3).alias("mean_score"))


@dataclass
class Constraints:
    """What a table promises."""

    table: str
    frame: DataFrame
    primary_key: list[str] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    domains: dict[str, tuple] = field(default_factory=dict)
    checks: dict[str, Column] = field(default_factory=dict)
    foreign_keys: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)


def operational_constraints(tables: dict[str, DataFrame]) -> list[Constraints]:
    """The promises of the operational tables, for those that are given."""
    agents, cases = tables.get("agents"), tables.get("retention_cases")

    def refers(**parents: tuple[DataFrame | None, str]) -> dict[str, tuple[DataFrame, str]]:
        return {name: (frame, key) for name, (frame, key) in parents.items() if frame is not None}

    to_case = (cases, "case_id")
    known = {
        "agents": dict(primary_key=["agent_id"], not_null=["agent_id", "agent_name"]),
        "retention_cases": dict(
            primary_key=["case_id"], not_null=["case_id", "customer_id", "status", "priority", "opened_at"],
            domains={"status": rules.CASE_STATUSES, "priority": rules.CASE_PRIORITIES},
            checks={"closed_at >= opened_at": F.col("closed_at") >= F.col("opened_at")},
            foreign_keys=refers(assigned_agent_id=(agents, "agent_id")),
        ),
        "case_notes": dict(
            primary_key=["note_id"], not_null=["note_id", "case_id", "note_text"],
            foreign_keys=refers(case_id=to_case, agent_id=(agents, "agent_id")),
        ),
        "offers_presented": dict(
            primary_key=["offer_presentation_id"], not_null=["case_id", "offer_id"], foreign_keys=refers(case_id=to_case),
        ),
        "retention_actions": dict(
            primary_key=["action_id"], not_null=["customer_id", "action_type", "approval_status"],
            domains={"approval_status": rules.APPROVAL_STATUSES}, foreign_keys=refers(case_id=to_case),
        ),
        "workflow_events": dict(primary_key=["event_id"], not_null=["event_type"]),
    }
    return [Constraints(name, frame, **known[name]) for name, frame in tables.items()]


def constraint_violations(tables: list[Constraints]) -> DataFrame:
    """One row per rule with the number of violating rows (key groups for primary keys)."""
    return reduce(DataFrame.unionByName, [part for table in tables for part in _violations(table)])


def _violations(table: Constraints) -> list[DataFrame]:
    parts = []
    row_rules: dict[str, Column] = {}
    for name in table.not_null:
        row_rules[f"not_null({name})"] = F.col(name).isNull()
    for name, allowed in table.domains.items():
        row_rules[f"domain({name})"] = ~F.col(name).isin(*allowed)
    for name, holds in table.checks.items():
        row_rules[f"check({name})"] = ~holds
    if row_rules:  # all row rules in one scan
        counted = table.frame.agg(*[count_true(bad).alias(f"_{i}") for i, bad in enumerate(row_rules.values())])
        cells = [
            F.struct(F.lit(table.table).alias("table_name"), F.lit(rule).alias("rule"), F.col(f"_{i}").alias("violations"))
            for i, rule in enumerate(row_rules)
        ]
        parts.append(counted.select(F.explode(F.array(*cells)).alias("v")).select("v.*"))
    if table.primary_key:
        repeated = table.frame.groupBy(*table.primary_key).agg(rows().alias("_n")).where(F.col("_n") > 1)
        parts.append(_one_rule(table.table, f"primary_key({', '.join(table.primary_key)})", repeated, rows()))
    for name, (parent, parent_key) in table.foreign_keys.items():
        # One row per referenced key before the join: a hot key is a single row there.
        used = table.frame.where(F.col(name).isNotNull()).groupBy(name).agg(rows().alias("_n"))
        orphans = used.join(parent.select(F.col(parent_key).alias(name)), name, "left_anti")
        parts.append(_one_rule(table.table, f"foreign_key({name})", orphans, F.coalesce(F.sum("_n"), F.lit(0))))
    return parts


def _one_rule(table: str, rule: str, offending: DataFrame, count: Column) -> DataFrame:
    return offending.agg(count.alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), "violations"
    )


def temporal_order_check(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows that end before they start."""
    return df.where(F.col(end) < F.col(start))

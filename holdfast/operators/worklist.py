"""The ranked worklist, its cases and the state of retention actions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import rules
from holdfast.functions.rates import count_true, rows
from holdfast.operators.ranks import global_position, global_rank, value_table
from holdfast.session import materialize

SCORE_DOMAIN = 10_001  # scores in [0, 1] rounded to four places


def worklist(scores: DataFrame, cases: DataFrame, actions: DataFrame) -> DataFrame:
    """Open cases of critical customers, ranked by score and flagged while no action is committed.

    Committed cases are reduced to distinct ids first: a case with two committed
    actions stays one row.
    """
    critical = scores.where(F.col("risk_tier") == "Critical").select(
        "customer_id", "market", F.round("churn_score", 4).alias("churn_score"), "risk_tier"
    )
    still_open = cases.where(F.col("status").isin(*rules.OPEN_STATUSES)).select(
        "case_id", "customer_id", "competitor_id", "recommended_offer_id", "status"
    )
    committed = actions.where(F.col("committed_at").isNotNull()).select("case_id").distinct().withColumn(
        "_done", F.lit(True)
    )
    flagged = (
        still_open.join(critical, "customer_id")
        .join(committed, "case_id", "left")
        .withColumn("needs_action", F.col("_done").isNull())
    )
    flagged = materialize(flagged.drop("_done"), "worklist")  # ranking reads it again
    return global_rank(flagged, "churn_score", "priority_rank", domain_bound=SCORE_DOMAIN).select(
        "customer_id", "market", "churn_score", "risk_tier", "case_id", "competitor_id", "recommended_offer_id",
        "status", "needs_action", "priority_rank",
    )


def worklist_order() -> list[Column]:
    return [F.desc("needs_action"), F.desc("churn_score"), F.asc("case_id")]


def worklist_topn(ranked: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows by priority; the case id breaks ties."""
    return ranked.orderBy("priority_rank", "case_id").limit(n)


def refresh_event(
    ranked: DataFrame, source: str = "schedule", view: str = "v_retention_worklist", at: Column | None = None
) -> DataFrame:
    """One log row per refresh with the number of cases that need action; ``at`` is now, if not given."""
    return ranked.agg(count_true(F.col("needs_action")).alias("flagged_needing_action")).select(
        F.lit("view_refresh_trigger").alias("event_type"), F.lit(source).alias("trigger_source"),
        F.lit("view").alias("entity_type"), F.lit(view).alias("entity_id"), F.lit("system").alias("actor"),
        F.to_json(F.struct("flagged_needing_action")).alias("detail"),
        (F.current_timestamp() if at is None else at).alias("created_at"),
    )


def log_event(event: DataFrame, path: str) -> DataFrame:
    """Append to the event log and return it as read back."""
    event.write.mode("append").parquet(path)
    return event.sparkSession.read.parquet(path)


def case_status_priority(cases: DataFrame) -> DataFrame:
    """Cases by status and priority, with the mark that keeps them on the worklist."""
    return cases.groupBy("status", "priority").agg(rows().alias("cases")).withColumn(
        "is_open", F.col("status").isin(*rules.OPEN_STATUSES)
    )


_STEPS = ("proposed", "approved", "corrected", "rejected", "committed")


def _position(at: str, sequence: str, kind: str) -> Column:
    """Time, sequence and kind of an event as one number, so that a running maximum needs no sort.

    The time is in microseconds, the sequence a whole number from 0 below 10**18.
    """
    time = F.unix_micros(F.col(at).cast("timestamp")).cast("decimal(18,0)") * F.lit("10000000000000000000").cast("decimal(20,0)")
    code = F.coalesce(*[F.when(F.col(kind) == k, F.lit(i)) for i, k in enumerate(_STEPS)], F.lit(len(_STEPS)))
    return (time + F.col(sequence).cast("decimal(18,0)") * 10 + code).cast("decimal(38,0)")


def _kind_at(position: str) -> Column:
    names = F.array(*[F.lit(k) for k in _STEPS], F.lit(None).cast("string"))
    return F.element_at(names, (F.col(position) % 10).cast("int") + 1)


def action_state(
    events: DataFrame, key: str, kind: str, at: str, sequence: str, offer: str | None = None, actor: str | None = None,
    constant: Sequence[str] = (),
) -> DataFrame:
    """Fold proposed / approved / corrected / rejected / committed events into one row per action.

    Only running minima, maxima and counts are kept, so the fold combines before the
    exchange and a busy action needs no sorting.  ``is_valid`` is false where an action
    was decided before it was proposed, committed without a decision, or both rejected
    and committed.  ``constant`` are numeric columns that all events of an action share
    (case, customer).  With ``offer`` and ``actor`` the row has ``proposed_offer_id`` (of the
    first proposal), ``approver`` (of the last decision) and ``final_offer_id``: the decision's
    offer if it was corrected, none if it was rejected, else the proposed one.
    """
    events = events.withColumn("_position", _position(at, sequence, kind))

    def first(state: str) -> Column:
        return F.min(F.when(F.col(kind) == state, F.col(at)))

    decided = F.col(kind).isin("approved", "corrected", "rejected")
    folded = events.groupBy(key).agg(
        rows().alias("n_events"),
        *[F.max(c).alias(c) for c in constant],
        first("proposed").alias("proposed_at"),
        F.min(F.when(decided, F.col(at))).alias("decided_at"),
        first("rejected").alias("rejected_at"),
        first("committed").alias("committed_at"),
        F.min(F.when(F.col(kind) == "proposed", F.col("_position"))).alias("_proposal"),
        F.max(F.when(decided, F.col("_position"))).alias("_decision"),
        F.max("_position").alias("_last"),
    )
    approval = F.coalesce(_kind_at("_decision"), F.lit("proposed"))
    before_proposal = F.col("proposed_at").isNull() | (F.col("decided_at") < F.col("proposed_at"))
    undecided = F.col("committed_at").isNotNull() & (
        F.col("decided_at").isNull() | (F.col("committed_at") < F.col("decided_at"))
    )
    contradictory = F.col("committed_at").isNotNull() & F.col("rejected_at").isNotNull()
    broken = F.coalesce(before_proposal, F.lit(False)) | undecided | contradictory
    state = folded.select(
        key, *constant, "n_events", approval.alias("approval_status"), _kind_at("_last").alias("last_event"),
        "proposed_at", "decided_at", "committed_at", (~broken).alias("is_valid"), "_proposal", "_decision",
    )
    if offer is not None:
        chosen = events.where(F.col(kind) == "proposed").select(
            key, F.col("_position").alias("_proposal"), F.col(offer).alias("proposed_offer_id"))
        state = state.join(chosen, [key, "_proposal"], "left")
        own = [F.col(offer).alias("_own")] + ([F.col(actor).alias("approver")] if actor is not None else [])
        state = state.join(
            events.where(decided).select(key, F.col("_position").alias("_decision"), *own), [key, "_decision"], "left")
        final = F.when(F.col("approval_status") == "corrected", F.col("_own")).when(
            F.col("approval_status") != "rejected", F.col("proposed_offer_id"))
        state = state.withColumn("final_offer_id", final).drop("_own")
    return state.drop("_proposal", "_decision")


def committed_offers(state: DataFrame, key: str) -> DataFrame:
    """The offers that committed actions put before customers, with the moment of the commit."""
    done = state.where(F.col("committed_at").isNotNull() & F.col("final_offer_id").isNotNull())
    return done.select(
        key, "customer_id", F.col("final_offer_id").alias("offer_id"), F.col("committed_at").alias("presented_at"),
        F.lit("Presented").alias("outcome"),
    )


def case_open(scores: DataFrame, agents: DataFrame) -> DataFrame:
    """One new case per critical customer, handed to the agents in turn, highest scores first."""
    critical = scores.where(F.col("risk_tier") == "Critical").withColumn("churn_score", F.round("churn_score", 4))
    critical = materialize(critical, "critical")  # the positions read it three times
    placed = global_position(critical, "churn_score", "customer_id", "_place", domain_bound=SCORE_DOMAIN)
    numbered = value_table(agents.select("agent_id"), "agent_id")
    slots = numbered.frame.select(F.col("agent_id").alias("assigned_agent_id"), F.col("_before").alias("_slot"))
    if numbered.small:  # few agents: a shuffle on the slot would have few partitions
        slots = F.broadcast(slots)
    return (
        placed.withColumn("_slot", F.pmod("_place", F.lit(max(1, numbered.n_rows))))
        .join(slots, "_slot")
        .select(
            "customer_id", "market", "competitor_id", "assigned_agent_id", F.lit("Open").alias("status"),
            F.lit("Critical").alias("priority"), "recommended_offer_id", "churn_score",
        )
    )

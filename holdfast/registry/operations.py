"""Queries for the worklist, actions, history, snapshots and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.functions.rates import null_to_zero
from holdfast.operators import history, quality, worklist
from holdfast.registry import marts, scoring
from holdfast.registry.sql import count_if, half_up, query, whole
from holdfast.sources import star_tables as star
from holdfast.sources.change_history import ChangeHistory
from holdfast.sources.keyed_table import KeyedTable
from holdfast.sources.publish import current_snapshot, publish_snapshot, publish_table, read_result, register_marts
from holdfast.session import materialize, scratch_dir

# Snapshots of customer activity: all orders up to each of two dates.
SNAPSHOTS = ("1999-01-01", "1999-07-01")
REFRESHES = {"schedule": "2024-01-15 06:00:00", "manual": "2024-01-15 09:30:00"}
AS_OF = "2024-01-15 12:00:00"
BASELINE_UNTIL = "1995-02-01"
SPIKE = ("1998-01-01", "1998-01-31")
TARGETS = {
    "mention_rate": (0.5, 0.6), "mention_rate_baseline": (0.5, 0.6), "mention_rate_spike": (0.5, 0.6),
    "save_rate": (0.3, 0.35), "churned_customers": (0, 1000),
}


def ranked(spark, sf):
    return worklist.worklist(scoring.tiered(spark, sf), star.cases(spark, sf), star.actions(spark, sf))


def _refresh_event(spark, sf):
    """The log after two refreshes, one by schedule and one by hand."""
    log = scratch_dir(spark, "workflow_events")
    cases = materialize(ranked(spark, sf), "worklist")
    for source, moment in REFRESHES.items():
        event = worklist.refresh_event(cases, source, at=F.lit(moment).cast("timestamp_ntz"))
        logged = worklist.log_event(event, log)
    return logged


def _dedupe_increment(spark, sf):
    """Order lines share keys; the latest shipment of each key stays."""
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus"]
    return history.dedupe_latest(star.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], order)


def _activity(spark, sf, until: str):
    """Orders and revenue of each customer up to a date."""
    end = F.lit(until).cast("date")
    day = F.col("o_orderdate").cast("date")
    return (
        star.table(spark, sf, "orders").where(day < end)
        .groupBy(F.col("o_custkey").alias("customer_id"))
        .agg(F.count(F.lit(1)).alias("n_orders"),
             F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue"),
             F.max("o_orderdate").alias("last_order"))
    )


def _snapshot_diff(spark, sf):
    return history.snapshot_diff(_activity(spark, sf, SNAPSHOTS[0]), _activity(spark, sf, SNAPSHOTS[1]), "customer_id")


def _apply_snapshot_diff(spark, sf):
    """The first snapshot, brought to the second by their difference."""
    before, after = (_activity(spark, sf, day) for day in SNAPSHOTS)
    table = KeyedTable(spark, scratch_dir(spark, "activity"), "customer_id", before.schema, buckets=16)
    table.load(before)
    table.apply(history.snapshot_diff(table.read(), after, "customer_id"), 0)
    return table.read()


def _feed(spark, sf):
    """Events as a change feed of each user's state; an error deletes the state."""
    return star.table(spark, sf, "events").select(
        F.col("user_id"), F.col("event_id").alias("lsn"), F.col("ts").alias("changed_at"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("change_type"),
        F.col("event_type").alias("state"), "value",
    )


def _incremental_history(spark, sf):
    """Three batches of the feed: the middle events arrive last, every fifth event comes twice."""
    feed = _feed(spark, sf)
    kept = ChangeHistory(spark, scratch_dir(spark, "history"), feed.schema, "user_id", "lsn", "changed_at", "change_type",
                         ["state", "value"], buckets=16)
    third = F.col("lsn") % 3
    for batch, part in enumerate((feed.where(third == 0), feed.where((third == 2) | (F.col("lsn") % 5 == 0)), feed.where(third == 1))):
        kept.add(part, batch)
    return kept.read()


def _scd2_history(spark, sf):
    return history.scd2_history(_feed(spark, sf), "user_id", "lsn", "changed_at", "change_type", ["state", "value"])


def _scd2_as_of(spark, sf):
    return history.as_of(_scd2_history(spark, sf), F.lit(AS_OF).cast("timestamp_ntz"))


def _publish_table(spark, sf):
    topics = marts.topic_mix(spark, sf)
    return publish_table(topics, scratch_dir(spark, "topic_mix"))


def _publish_snapshot(spark, sf):
    """Two versions; readers follow the pointer to the second."""
    root = scratch_dir(spark, "risk_snapshot")
    scored = scoring.tiered(spark, sf)
    publish_snapshot(scored.where("churn_score > 0.5"), root, "customer_id", "v1")
    publish_snapshot(scored, root, "customer_id", "v2")
    return current_snapshot(spark, root)


def _read_result(spark, sf):
    """A dashboard statement over the published views."""
    register_marts({"topic_mix": marts.topic_mix(spark, sf), "offer_effectiveness": marts.offer_effectiveness(spark, sf)})
    return read_result(
        spark,
        """SELECT competitor_name, COUNT(*) AS offers, SUM(times_presented) AS presented,
                  SUM(times_accepted) AS accepted, (SELECT SUM(call_volume) FROM gold_call_topics) AS all_calls
           FROM gold_retention_offers WHERE times_presented >= :least GROUP BY competitor_name""",
        least=1,
    )


def _null_to_zero(spark, sf):
    """Presentation numbers from text: the payload number, and a field that is never numeric."""
    events = star.table(spark, sf, "events")
    return events.select(
        "event_id", null_to_zero(F.get_json_object("props", "$.k")).alias("k"),
        null_to_zero(F.col("event_type")).alias("kind"), null_to_zero(F.col("value").cast("string")).alias("value"),
    )


def _action_state(spark, sf):
    return worklist.action_state(
        star.action_events(spark, sf), "action_id", "event", "created_at", "event_id", "offer_id", "actor",
        ["case_id", "customer_id"])


def _dataset_checks(spark, sf):
    return quality.dataset_checks(
        star.calls(spark, sf, with_orders=False), star.customers(spark, sf, with_churn_date=False), BASELINE_UNTIL,
        SPIKE, TARGETS,
    )


def _constraint_violations(spark, sf):
    line, order = star.table(spark, sf, "lineitem"), star.table(spark, sf, "orders")
    event, customer = star.table(spark, sf, "events"), star.table(spark, sf, "customer")
    return quality.constraint_violations([
        quality.Constraints(
            "lineitem", line, primary_key=["l_orderkey", "l_linenumber"], not_null=["l_orderkey", "l_shipdate"],
            domains={"l_returnflag": ("R", "A")}, checks={"l_tax": F.col("l_tax") > 0},
            foreign_keys={"l_orderkey": (order, "o_orderkey")},
        ),
        quality.Constraints(
            "orders", order, primary_key=["o_orderkey"], not_null=["o_custkey"], domains={"o_orderstatus": ("O", "P", "F")},
            foreign_keys={"o_custkey": (customer, "c_custkey")},
        ),
        quality.Constraints(
            "events", event, primary_key=["event_id"], not_null=["ts", "props"],
            foreign_keys={"event_id": (order, "o_orderkey")},
        ),
    ])


def _temporal_order_check(spark, sf):
    """Lines shipped before they were ordered plus thirty days count as closed too early."""
    line = star.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("date").alias("closed_on")
    )
    order = star.table(spark, sf, "orders").select(
        "o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), 30).alias("opened_on")
    )
    return quality.temporal_order_check(
        line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey"), "opened_on", "closed_on"
    )


def _case_open(spark, sf):
    """A case per critical customer of the score table, for agents with ids of text."""
    agents = star.agents(spark, sf).withColumn("agent_id", F.format_string("AGT-%06d", F.col("agent_id").cast("long")))
    return worklist.case_open(scoring.scores(spark, sf), agents)


def _operational_constraints(spark, sf):
    """The declared promises of the operational tables, on the mapped tables."""
    agents = star.agents(spark, sf)
    cases = star.cases(spark, sf).withColumn("closed_at", F.when(F.col("status") == "Saved", F.col("opened_at")))
    cases = cases.withColumn("assigned_agent_id", (F.col("case_id") % 120).cast("long"))
    actions = _action_state(spark, sf).withColumn("action_type", F.lit("offer"))
    events = star.table(spark, sf, "events").select("event_id", "event_type")
    return quality.constraint_violations(quality.operational_constraints({
        "agents": agents, "retention_cases": cases, "retention_actions": actions, "workflow_events": events,
    }))


QUERIES = {
    "worklist": ranked,
    "worklist_topn": lambda s, d: worklist.worklist_topn(ranked(s, d)),
    "refresh_event": _refresh_event,
    "action_state": _action_state,
    "committed_offers": lambda s, d: worklist.committed_offers(_action_state(s, d), "action_id"),
    "case_status_priority": lambda s, d: worklist.case_status_priority(star.cases(s, d)),
    "case_open": _case_open,
    "dedupe_increment": _dedupe_increment,
    "snapshot_diff": _snapshot_diff,
    "apply_snapshot_diff": _apply_snapshot_diff,
    "scd2_history": _scd2_history,
    "incremental_history": _incremental_history,
    "scd2_as_of": _scd2_as_of,
    "publish_table": _publish_table,
    "publish_snapshot": _publish_snapshot,
    "read_result": _read_result,
    "null_to_zero": _null_to_zero,
    "dataset_checks": _dataset_checks,
    "constraint_violations": _constraint_violations,
    "operational_constraints": _operational_constraints,
    "temporal_order_check": _temporal_order_check,
}

_ACTIVITY = """SELECT o_custkey AS customer_id, COUNT(*) AS n_orders,
                      CAST(SUM(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue, MAX(o_orderdate) AS last_order
               FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '{0}' GROUP BY 1"""


_SCD2 = """
        SELECT user_id, event_id AS lsn, event_type AS state, value, ts AS valid_from, next_ts AS valid_to,
               next_ts IS NULL AS is_current
        FROM (SELECT *, LEAD(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS next_ts FROM events)
        WHERE event_type <> 'error'"""


def _check(metric: str, value: str) -> str:
    low, high = TARGETS[metric]
    return f"""SELECT '{metric}' AS metric, v AS value, CAST({low} AS DOUBLE) AS low, CAST({high} AS DOUBLE) AS high,
                      v BETWEEN {low} AND {high} AS ok FROM (SELECT {half_up(value, 4)} AS v FROM calls)"""


def _share(condition: str, within: str = "TRUE") -> str:
    return (f"(CAST({count_if(f'({condition}) AND ({within})')} AS DOUBLE) / CAST({count_if(within)} AS DOUBLE))")


def _rule(table: str, rule: str, count: str) -> str:
    return f"SELECT '{table}' AS table_name, '{rule}' AS rule, CAST(({count}) AS BIGINT) AS violations"


_DECIDED = "event IN ('approved', 'corrected', 'rejected')"
_ACTION_STATE = f"""
    SELECT action_id, case_id, customer_id, n_events, COALESCE(decision, 'proposed') AS approval_status, last_event,
           proposed_at, decided_at, committed_at, proposed_offer_id, approver,
           CASE WHEN decision = 'corrected' THEN own WHEN COALESCE(decision, '') <> 'rejected' THEN proposed_offer_id END AS final_offer_id,
           NOT (proposed_at IS NULL OR COALESCE(decided_at < proposed_at, FALSE)
                OR (committed_at IS NOT NULL AND (decided_at IS NULL OR committed_at < decided_at))
                OR (committed_at IS NOT NULL AND rejected_at IS NOT NULL)) AS is_valid
    FROM (SELECT action_id, MAX(case_id) AS case_id, MAX(customer_id) AS customer_id, COUNT(*) AS n_events,
                 MIN(created_at) FILTER (WHERE event = 'proposed') AS proposed_at,
                 MIN(created_at) FILTER (WHERE {_DECIDED}) AS decided_at,
                 MIN(created_at) FILTER (WHERE event = 'rejected') AS rejected_at,
                 MIN(created_at) FILTER (WHERE event = 'committed') AS committed_at,
                 FIRST(offer_id ORDER BY created_at, event_id) FILTER (WHERE event = 'proposed') AS proposed_offer_id,
                 LAST(event ORDER BY created_at, event_id) AS last_event,
                 LAST(event ORDER BY created_at, event_id) FILTER (WHERE {_DECIDED}) AS decision,
                 LAST(offer_id ORDER BY created_at, event_id) FILTER (WHERE {_DECIDED}) AS own,
                 LAST(actor ORDER BY created_at, event_id) FILTER (WHERE {_DECIDED}) AS approver
          FROM action_events GROUP BY 1)"""

_PROMISES = {
    ("agents", "agents"): {
        "not_null(agent_id)": "agent_id IS NULL", "not_null(agent_name)": "agent_name IS NULL", "primary_key(agent_id)": "agent_id"},
    ("retention_cases", "cases"): {
        **{f"not_null({c})": f"{c} IS NULL" for c in ("case_id", "customer_id", "status", "priority", "opened_at")},
        "domain(status)": "status NOT IN ('Open', 'In Progress', 'Saved', 'Churned')",
        "domain(priority)": "priority NOT IN ('Low', 'Medium', 'High', 'Critical')",
        "check(closed_at >= opened_at)": "status = 'Saved' AND opened_at < opened_at", "primary_key(case_id)": "case_id",
        "foreign_key(assigned_agent_id)": "case_id % 120 NOT IN (SELECT agent_id FROM agents)"},
    ("retention_actions", f"({_ACTION_STATE})"): {
        "not_null(customer_id)": "customer_id IS NULL", "not_null(action_type)": "FALSE",
        "not_null(approval_status)": "approval_status IS NULL",
        "domain(approval_status)": "approval_status NOT IN ('proposed', 'approved', 'corrected', 'rejected')",
        "primary_key(action_id)": "action_id", "foreign_key(case_id)": "case_id NOT IN (SELECT case_id FROM cases)"},
    ("workflow_events", "events"): {"not_null(event_type)": "event_type IS NULL", "primary_key(event_id)": "event_id"},
}


def _promise(table: str, source: str, rule: str, what: str) -> str:
    if rule.startswith("primary_key"):
        return _rule(table, rule, f"SELECT COUNT(*) FROM (SELECT 1 FROM {source} GROUP BY {what} HAVING COUNT(*) > 1)")
    return _rule(table, rule, f"SELECT COUNT(*) FROM {source} WHERE {what}")


ORACLE = {
    "operational_constraints": query(
        " UNION ALL ".join(_promise(*names, rule, what) for names, rules in _PROMISES.items() for rule, what in rules.items()),
        "agents", "cases", "action_events"),
    "worklist": whole("worklist"),
    "worklist_topn": query("SELECT * FROM worklist ORDER BY priority_rank, case_id LIMIT 10", "worklist"),
    "refresh_event": query(
        f"""SELECT 'view_refresh_trigger' AS event_type, trigger_source, created_at, 'view' AS entity_type,
                   'v_retention_worklist' AS entity_id, 'system' AS actor,
                   '{{"flagged_needing_action":' || {count_if("needs_action")} || '}}' AS detail
            FROM worklist, (VALUES ('schedule', TIMESTAMP '2024-01-15 06:00:00'), ('manual', TIMESTAMP '2024-01-15 09:30:00'))
                           AS t(trigger_source, created_at) GROUP BY trigger_source, created_at""", "worklist"
    ),
    "action_state": query(_ACTION_STATE, "action_events"),
    "committed_offers": query(
        f"""SELECT action_id, customer_id, final_offer_id AS offer_id, committed_at AS presented_at, 'Presented' AS outcome
            FROM ({_ACTION_STATE}) WHERE committed_at IS NOT NULL AND final_offer_id IS NOT NULL""", "action_events"
    ),
    "case_status_priority": query(
        """SELECT status, priority, COUNT(*) AS cases, status IN ('Open', 'In Progress') AS is_open
           FROM cases GROUP BY 1, 2""", "cases"
    ),
    "case_open": query(
        """SELECT customer_id, market, competitor_id, 'AGT-' || lpad(CAST(agent_id AS VARCHAR), 6, '0') AS assigned_agent_id,
                  'Open' AS status, 'Critical' AS priority, recommended_offer_id, churn_score
           FROM (SELECT *, (ROW_NUMBER() OVER (ORDER BY churn_score DESC, md5(CAST(customer_id AS VARCHAR)), customer_id) - 1)
                           % (SELECT COUNT(*) FROM agents) AS slot
                 FROM scores WHERE risk_tier = 'Critical')
           JOIN (SELECT agent_id, ROW_NUMBER() OVER (ORDER BY agent_id) - 1 AS slot FROM agents) USING (slot)""",
        "scores", "agents",
    ),
    "dedupe_increment": """
        SELECT * FROM lineitem
        QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
          ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC,
                   l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1""",
    "snapshot_diff": f"""
        SELECT COALESCE(a.customer_id, b.customer_id) AS customer_id,
               CASE WHEN b.customer_id IS NULL THEN 'insert' WHEN a.customer_id IS NULL THEN 'delete' ELSE 'update' END AS change_type,
               COALESCE(a.n_orders, b.n_orders) AS n_orders, COALESCE(a.revenue, b.revenue) AS revenue,
               COALESCE(a.last_order, b.last_order) AS last_order
        FROM ({_ACTIVITY.format(SNAPSHOTS[0])}) b FULL JOIN ({_ACTIVITY.format(SNAPSHOTS[1])}) a
          ON a.customer_id = b.customer_id
        WHERE a.customer_id IS NULL OR b.customer_id IS NULL OR a.n_orders <> b.n_orders OR a.revenue <> b.revenue
           OR a.last_order <> b.last_order""",
    "apply_snapshot_diff": _ACTIVITY.format(SNAPSHOTS[1]),
    "scd2_history": _SCD2,
    "incremental_history": _SCD2,
    "scd2_as_of": f"""
        SELECT * FROM ({_SCD2}) WHERE valid_from <= TIMESTAMP '{AS_OF}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AS_OF}')""",
    "publish_table": whole("topic_mix"),
    "publish_snapshot": query("SELECT customer_id, market, churn_score, raw_score, risk_tier FROM tiered", "tiered"),
    "read_result": query(
        """SELECT competitor_name, COUNT(*) AS offers, CAST(SUM(times_presented) AS BIGINT) AS presented,
                  CAST(SUM(times_accepted) AS BIGINT) AS accepted, (SELECT COUNT(*) FROM calls) AS all_calls
           FROM offer_effectiveness GROUP BY 1""", "offer_effectiveness"
    ),
    "null_to_zero": """
        SELECT event_id, COALESCE(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k,
               COALESCE(TRY_CAST(event_type AS DOUBLE), 0.0) AS kind, COALESCE(value, 0.0) AS value
        FROM events""",
    "dataset_checks": query(
        " UNION ALL ".join([
            _check("mention_rate", _share("competitor_mentioned")),
            _check("mention_rate_baseline", _share("competitor_mentioned", f"call_date < DATE '{BASELINE_UNTIL}'")),
            _check("mention_rate_spike", _share("competitor_mentioned", f"call_date BETWEEN DATE '{SPIKE[0]}' AND DATE '{SPIKE[1]}'")),
            _check("save_rate", _share("outcome = 'Saved'")),
            """SELECT 'churned_customers' AS metric, CAST(n AS DOUBLE) AS value, CAST(0 AS DOUBLE) AS low,
                      CAST(1000 AS DOUBLE) AS high, n BETWEEN 0 AND 1000 AS ok
               FROM (SELECT COUNT(*) FILTER (WHERE status = 'Churned') AS n FROM customers)""",
        ]), "calls", "customers",
    ),
    "constraint_violations": " UNION ALL ".join([
        _rule("lineitem", "not_null(l_orderkey)", "SELECT COUNT(*) FROM lineitem WHERE l_orderkey IS NULL"),
        _rule("lineitem", "not_null(l_shipdate)", "SELECT COUNT(*) FROM lineitem WHERE l_shipdate IS NULL"),
        _rule("lineitem", "domain(l_returnflag)", "SELECT COUNT(*) FROM lineitem WHERE l_returnflag NOT IN ('R', 'A')"),
        _rule("lineitem", "check(l_tax)", "SELECT COUNT(*) FROM lineitem WHERE NOT l_tax > 0"),
        _rule("lineitem", "primary_key(l_orderkey, l_linenumber)",
              "SELECT COUNT(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1)"),
        _rule("lineitem", "foreign_key(l_orderkey)",
              "SELECT COUNT(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)"),
        _rule("orders", "not_null(o_custkey)", "SELECT COUNT(*) FROM orders WHERE o_custkey IS NULL"),
        _rule("orders", "domain(o_orderstatus)", "SELECT COUNT(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'P', 'F')"),
        _rule("orders", "primary_key(o_orderkey)",
              "SELECT COUNT(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING COUNT(*) > 1)"),
        _rule("orders", "foreign_key(o_custkey)",
              "SELECT COUNT(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"),
        _rule("events", "not_null(ts)", "SELECT COUNT(*) FROM events WHERE ts IS NULL"),
        _rule("events", "not_null(props)", "SELECT COUNT(*) FROM events WHERE props IS NULL"),
        _rule("events", "primary_key(event_id)",
              "SELECT COUNT(*) FROM (SELECT 1 FROM events GROUP BY event_id HAVING COUNT(*) > 1)"),
        _rule("events", "foreign_key(event_id)",
              "SELECT COUNT(*) FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders)"),
    ]),
    "temporal_order_check": """
        SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS closed_on,
               CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS opened_on
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) + 30""",
}

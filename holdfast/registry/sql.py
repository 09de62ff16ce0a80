"""Building blocks of the checking SQL (DuckDB dialect)."""

from __future__ import annotations


def half_up(expression: str, places: int) -> str:
    """Round half up on the shortest decimal text of a DOUBLE, which is what Spark's ROUND does."""
    return f"CAST(ROUND(CAST(CAST({expression} AS VARCHAR) AS DECIMAL(38, 20)), {places}) AS DOUBLE)"


def rate(part: str, whole: str = "COUNT(*)", places: int = 4) -> str:
    return half_up(f"(CAST({part} AS DOUBLE) / NULLIF(CAST({whole} AS DOUBLE), 0))", places)


def count_if(condition: str) -> str:
    return f"COUNT(*) FILTER (WHERE {condition})"


CTES = {
    "calls": """
        SELECT 'CALL-' || l_orderkey || '-' || l_linenumber AS call_id,
               o_custkey AS customer_id, l_suppkey AS agent_id, CAST(l_shipdate AS DATE) AS call_date,
               l_quantity AS handle_time_min, l_discount >= 0.05 AS competitor_mentioned,
               CASE WHEN l_discount >= 0.05 THEN CAST(l_linenumber % 5 AS VARCHAR) END AS competitor_id,
               o_orderpriority AS call_topic, l_returnflag || ' ' || l_linestatus AS mention_text,
               CASE WHEN l_tax > 0 THEN l_partkey END AS offer_presented_id,
               (l_returnflag = 'R' AND l_linestatus = 'O') AS offer_accepted,
               CASE l_returnflag WHEN 'R' THEN 'Saved' WHEN 'A' THEN 'Churned' ELSE 'Pending' END AS outcome
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "customers": """
        SELECT c_custkey AS customer_id, c_name AS customer_name, n_name AS market, c_mktsegment AS plan_type,
               c_acctbal AS monthly_spend, c_custkey % 120 + 1 AS tenure_months, c_custkey % 3 = 0 AS has_mobile,
               'speed ' || (c_custkey % 4) AS internet_speed,
               CASE c_custkey % 3 WHEN 0 THEN 'Month-to-Month' WHEN 1 THEN '1-Year' ELSE '2-Year' END AS contract_type,
               c_custkey % 5 < 3 AS autopay_enrolled,
               CASE WHEN c_acctbal < 500 THEN 'Churned' ELSE 'Active' END AS status,
               CASE WHEN c_acctbal < 500 THEN last_order END AS churn_date
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT o_custkey, CAST(MAX(o_orderdate) AS DATE) AS last_order FROM orders GROUP BY 1)
               ON o_custkey = c_custkey""",
    "agents": """
        SELECT s_suppkey AS agent_id, s_name AS agent_name, s_nationkey AS team,
               CASE WHEN s_acctbal >= 7000 THEN 'Top Performer' WHEN s_acctbal >= 2500 THEN 'On Target'
                    WHEN s_acctbal >= 0 THEN 'Needs Coaching' ELSE 'At Risk' END AS tier,
               s_suppkey % 90 AS nps, DATE '2015-01-01' + CAST(s_suppkey % 3650 AS INTEGER) AS hire_date
        FROM supplier""",
    "competitors": """
        SELECT CAST(r_regionkey AS VARCHAR) AS competitor_id, r_name AS competitor_name,
               CAST(r_regionkey * 3 + 1 AS BIGINT) AS best_counter_offer_id
        FROM region""",
    "offers": """
        SELECT p_partkey AS offer_id, p_name AS offer_name, p_retailprice AS price, p_size AS monthly_cost,
               p_type AS cost_type, CAST(p_size AS DOUBLE) / 50 AS base_save_rate, p_brand AS best_for
        FROM part""",
    "agent_performance": f"""
        SELECT a.*, total_calls, saves, save_rate, avg_handle_time_min, competitor_call_rate, offer_conversion_rate,
               RANK() OVER (ORDER BY save_rate DESC) AS save_rate_rank,
               {half_up("m", 4)} AS team_avg_save_rate, {half_up("(save_rate - m)", 4)} AS save_rate_vs_avg
        FROM (SELECT *, CAST(SUM(CAST(save_rate AS DECIMAL(18, 4))) OVER () AS DOUBLE) / COUNT(*) OVER () AS m
              FROM (SELECT agent_id AS id, COUNT(*) AS total_calls, {count_if("outcome = 'Saved'")} AS saves,
                           {rate(count_if("outcome = 'Saved'"))} AS save_rate,
                           {half_up("AVG(handle_time_min)", 1)} AS avg_handle_time_min,
                           {rate(count_if("competitor_mentioned"))} AS competitor_call_rate,
                           {rate(count_if("offer_accepted"))} AS offer_conversion_rate
                    FROM calls GROUP BY 1) p
              JOIN agents ON agents.agent_id = p.id) p
        JOIN agents a ON a.agent_id = p.id""",
    "offer_effectiveness": f"""
        SELECT b.offer_id, offer_name, b.competitor_id, competitor_name, times_presented, times_accepted, save_rate,
               price, monthly_cost, cost_type, base_save_rate, best_for
        FROM (SELECT offer_presented_id AS offer_id, competitor_id, COUNT(*) AS times_presented,
                     {count_if("offer_accepted")} AS times_accepted, {rate(count_if("outcome = 'Saved'"))} AS save_rate
              FROM calls WHERE offer_presented_id IS NOT NULL GROUP BY 1, 2) b
        LEFT JOIN competitors c ON c.competitor_id = b.competitor_id
        LEFT JOIN offers o ON o.offer_id = b.offer_id""",
    "topic_mix": f"""
        SELECT call_topic, COUNT(*) AS call_volume, {rate(count_if("outcome = 'Saved'"))} AS save_rate,
               {rate(count_if("outcome = 'Churned'"))} AS churn_rate,
               {half_up("AVG(handle_time_min)", 1)} AS avg_handle_time_min,
               {rate(count_if("competitor_mentioned"))} AS competitor_mention_rate,
               {half_up("(CAST(100.0 AS DOUBLE) * COUNT(*) / (SELECT COUNT(*) FROM calls))", 1)} AS pct_of_calls
        FROM calls GROUP BY 1""",
    "daily_kpis": f"""
        SELECT * FROM (
          SELECT call_date, total_calls, competitor_mentions, saves, disconnect_intent_calls, churned,
                 {rate("SUM(competitor_mentions) OVER w7", "SUM(total_calls) OVER w7")} AS competitor_mention_rate,
                 {rate("SUM(saves) OVER w7", "SUM(total_calls) OVER w7")} AS save_rate,
                 {half_up("(CAST(100.0 AS DOUBLE) * CAST(SUM(churned) OVER w30 AS DOUBLE) / 1500.0)", 3)} AS churn_rate_pct
          FROM (SELECT d.*, COALESCE(churned, 0) AS churned
                FROM (SELECT call_date, COUNT(*) AS total_calls, {count_if("competitor_mentioned")} AS competitor_mentions,
                             {count_if("outcome = 'Saved'")} AS saves,
                             {count_if("call_topic IN ('1-URGENT', '2-HIGH')")} AS disconnect_intent_calls
                      FROM calls GROUP BY 1) d
                LEFT JOIN (SELECT churn_date, COUNT(*) AS churned FROM customers
                           WHERE status = 'Churned' AND churn_date IS NOT NULL GROUP BY 1) c
                       ON churn_date = call_date)
          WINDOW w7 AS (ORDER BY call_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
                 w30 AS (ORDER BY call_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
        WHERE call_date >= DATE '1995-02-01'""",
    "features": """
        SELECT customer_id, plan_type, has_mobile, tenure_months, monthly_spend, contract_type, autopay_enrolled,
               internet_speed, market, COALESCE(n_calls, 0) AS n_calls,
               COALESCE(n_competitor_calls, 0) AS n_competitor_calls,
               CASE WHEN n_competitor_calls > 0 THEN 1 ELSE 0 END AS ever_competitor,
               COALESCE(n_events, 0) AS n_events, COALESCE(n_quality_events, 0) AS n_quality_events,
               CASE WHEN status = 'Churned' THEN 1 ELSE 0 END AS label
        FROM customers
        LEFT JOIN (SELECT customer_id, COUNT(*) AS n_calls,
                          COUNT(*) FILTER (WHERE competitor_mentioned) AS n_competitor_calls
                   FROM calls GROUP BY 1) USING (customer_id)
        LEFT JOIN (SELECT user_id AS customer_id, COUNT(*) AS n_events,
                          COUNT(*) FILTER (WHERE event_type = 'error') AS n_quality_events
                   FROM events GROUP BY 1) USING (customer_id)""",
    "flagged": """
        SELECT *, CASE WHEN contract_type = 'Month-to-Month' THEN 1 ELSE 0 END AS is_month_to_month,
               CASE WHEN plan_type = 'BUILDING' THEN 1 ELSE 0 END AS is_internet_only,
               CASE WHEN NOT has_mobile THEN 1 ELSE 0 END AS no_mobile,
               CASE WHEN tenure_months < 12 THEN 1 ELSE 0 END AS low_tenure,
               CASE WHEN NOT autopay_enrolled THEN 1 ELSE 0 END AS no_autopay
        FROM features""",
    "raw_scores": "SELECT *, -monthly_spend AS raw_score FROM customers",
    "calibrated": """
        SELECT *, round_even((GREATEST(0.01, LEAST(0.99, CASE WHEN p >= thr THEN
                   0.55 + GREATEST(0.0, LEAST(1.0, (p - thr) / (1 - thr))) * GREATEST(0.0, LEAST(1.0, (p - thr) / (1 - thr))) * 0.3
                   ELSE 0.02 + p / thr * CAST(0.53 AS DOUBLE) END))) * 10000, 0) / 10000 AS churn_score
        FROM (SELECT *, CAST(below + (ties + 1) / CAST(2 AS DOUBLE) AS DOUBLE) / n AS p,
                     CAST(0.8725 AS DOUBLE) AS thr
              FROM (SELECT *, RANK() OVER (ORDER BY raw_score) - 1 AS below,
                           COUNT(*) OVER (PARTITION BY raw_score) AS ties, COUNT(*) OVER () AS n
                    FROM raw_scores))""",
    "tiered": """
        SELECT *, CASE WHEN churn_score >= 0.55 THEN 'Critical' WHEN churn_score >= 0.4 THEN 'High'
                       WHEN churn_score >= 0.25 THEN 'Medium' ELSE 'Low' END AS risk_tier
        FROM calibrated""",
    "dominant": """
        SELECT customer_id, competitor_id
        FROM (SELECT customer_id, competitor_id, COUNT(*) AS n FROM calls WHERE competitor_mentioned GROUP BY 1, 2)
        QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY n DESC, competitor_id) = 1""",
    "scores": """
        SELECT t.customer_id, churn_score, risk_tier,
               CASE WHEN d.competitor_id IS NOT NULL THEN 3 * CAST(d.competitor_id AS INTEGER) + 1
                    WHEN f.is_internet_only = 1 THEN 31 WHEN f.no_mobile = 1 THEN 32
                    WHEN f.is_month_to_month = 1 THEN 33 ELSE 35 END AS recommended_offer_id,
               d.competitor_id, f.n_competitor_calls, t.monthly_spend, t.tenure_months, t.plan_type, t.market
        FROM tiered t JOIN flagged f ON f.customer_id = t.customer_id
        LEFT JOIN dominant d ON d.customer_id = t.customer_id""",
    "cases": """
        SELECT o_orderkey AS case_id, o_custkey AS customer_id, CAST(o_orderkey % 5 AS VARCHAR) AS competitor_id,
               CAST(o_orderkey % 5 * 3 + 1 AS BIGINT) AS recommended_offer_id,
               CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'P' THEN 'In Progress' ELSE 'Saved' END AS status,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High'
                    WHEN '5-LOW' THEN 'Low' ELSE 'Medium' END AS priority,
               o_orderdate AS opened_at
        FROM orders""",
    "action_events": """
        SELECT event_id // 4 AS action_id, event_id // 4 AS case_id, event_id // 4 % 1000 AS customer_id,
               event_id % 7 AS offer_id, 'user ' || user_id AS actor, event_id, ts AS created_at,
               CASE event_type WHEN 'click' THEN 'proposed' WHEN 'view' THEN 'approved' WHEN 'purchase' THEN 'committed'
                    WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'corrected' END AS event
        FROM events""",
    "worklist": """
        SELECT s.customer_id, market, churn_score, risk_tier, c.case_id, c.competitor_id, c.recommended_offer_id,
               c.status, c.case_id NOT IN (SELECT case_id FROM action_events WHERE event = 'committed') AS needs_action,
               RANK() OVER (ORDER BY churn_score DESC) AS priority_rank
        FROM tiered s JOIN cases c ON c.customer_id = s.customer_id
        WHERE risk_tier = 'Critical' AND c.status IN ('Open', 'In Progress')""",
}

NEEDS = {
    "agent_performance": ["calls", "agents"],
    "offer_effectiveness": ["calls", "competitors", "offers"],
    "topic_mix": ["calls"],
    "daily_kpis": ["calls", "customers"],
    "features": ["calls", "customers"],
    "flagged": ["features"],
    "raw_scores": ["customers"],
    "calibrated": ["raw_scores"],
    "tiered": ["calibrated"],
    "dominant": ["calls"],
    "scores": ["tiered", "flagged", "dominant"],
    "worklist": ["tiered", "cases", "action_events"],
}


def query(body: str, *names: str) -> str:
    """Prefix a statement with the named building blocks and what they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    blocks = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in ordered)
    return f"WITH {blocks}\n{body}" if blocks else body


def whole(name: str, *dates: str) -> str:
    """The block itself, with its dates as text."""
    shown = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in dates)
    return query(f"SELECT * {f'REPLACE ({shown})' if dates else ''} FROM {name}", name)

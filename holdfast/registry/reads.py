"""Queries for the read side."""

from __future__ import annotations

from holdfast.plans import reads
from holdfast.registry import marts, scoring
from holdfast.registry.sql import count_if, half_up, query
from holdfast.sources import star_tables as star

COMPETITOR = "EUROPE"
MONTHS = 12

QUERIES = {
    "kpi_churn_peak": lambda s, d: reads.kpi_churn_peak(marts.daily_kpis(s, d)),
    "kpi_mention_peak": lambda s, d: reads.kpi_mention_peak(marts.daily_kpis(s, d)),
    "kpi_overall_save": lambda s, d: reads.kpi_overall_save(marts.daily_kpis(s, d)),
    "kpi_latest": lambda s, d: reads.kpi_latest(marts.daily_kpis(s, d), scoring.tiered(s, d)),
    "trend": lambda s, d: reads.trend(marts.daily_kpis(s, d)),
    "baseline_vs_peak": lambda s, d: reads.baseline_vs_peak(marts.daily_kpis(s, d)),
    "competitor_share": lambda s, d: reads.competitor_share(star.calls(s, d, False), star.competitors(s, d)),
    "competitor_share_pct": lambda s, d: reads.competitor_share_pct(star.calls(s, d, False), star.competitors(s, d)),
    "topics_by_volume": lambda s, d: reads.topics_by_volume(marts.topic_mix(s, d)),
    "offers_by_save": lambda s, d: reads.offers_by_save(marts.offer_effectiveness(s, d)),
    "offers_vs_competitor": lambda s, d: reads.offers_vs_competitor(marts.offer_effectiveness(s, d), COMPETITOR),
    "best_rate_per_offer": lambda s, d: reads.best_rate_per_offer(marts.offer_effectiveness(s, d)),
    "competitor_cards": lambda s, d: reads.competitor_cards(star.competitors(s, d), marts.offer_effectiveness(s, d)),
    "agents_scatter": lambda s, d: reads.agents_scatter(marts.agent_performance(s, d)),
    "agents_lowest": lambda s, d: reads.agents_lowest(marts.agent_performance(s, d)),
    "agents_need_coaching": lambda s, d: reads.agents_need_coaching(marts.agent_performance(s, d)),
    "tier_rollup": lambda s, d: reads.tier_rollup(marts.agent_performance(s, d)),
    "kpi_critical_count": lambda s, d: reads.kpi_critical_count(scoring.tiered(s, d)),
    "critical_avg": lambda s, d: reads.critical_avg(scoring.tiered(s, d)),
    "critical_top": lambda s, d: reads.critical_top(scoring.scores(s, d)),
    "roi_case": lambda s, d: reads.roi_case(
        star.calls(s, d), star.customers(s, d, with_churn_date=False), star.offers(s, d), MONTHS
    ),
}


def _mean(column: str, places: int) -> str:
    return f"CAST(SUM(CAST({column} AS DECIMAL(18, {places}))) AS DOUBLE) / COUNT(*)"


_BEST = """SELECT * FROM offer_effectiveness
           QUALIFY ROW_NUMBER() OVER (PARTITION BY offer_id ORDER BY save_rate DESC, competitor_id NULLS FIRST) = 1"""

ORACLE = {
    "kpi_churn_peak": query(f"SELECT {half_up('MAX(churn_rate_pct)', 2)} AS churn_rate FROM daily_kpis", "daily_kpis"),
    "kpi_mention_peak": query(
        f"SELECT {half_up('(MAX(competitor_mention_rate) * 100)', 1)} AS competitor_mention_rate_pct FROM daily_kpis",
        "daily_kpis",
    ),
    "kpi_overall_save": query(
        f"""SELECT {half_up("(CAST(SUM(saves) AS DOUBLE) / CAST(SUM(total_calls) AS DOUBLE) * 100)", 1)} AS overall_save_rate
            FROM daily_kpis""", "daily_kpis"
    ),
    "kpi_latest": query(
        f"""SELECT CAST(call_date AS VARCHAR) AS call_date, churn_rate_pct, competitor_mention_rate, save_rate,
                   (SELECT {count_if("risk_tier = 'Critical'")} FROM tiered) AS critical_customers
            FROM daily_kpis ORDER BY call_date DESC LIMIT 1""", "daily_kpis", "tiered"
    ),
    "trend": query(
        f"""SELECT CAST(call_date AS VARCHAR) AS call_date, churn_rate_pct, {half_up("(competitor_mention_rate * 100)", 1)} AS competitor_mention_pct
            FROM daily_kpis""", "daily_kpis"
    ),
    "baseline_vs_peak": query(
        "SELECT MIN(churn_rate_pct) AS baseline_pct, MAX(churn_rate_pct) AS peak_pct FROM daily_kpis", "daily_kpis"
    ),
    "competitor_share": query(
        """SELECT competitor_name, COUNT(*) AS mention_count
           FROM calls LEFT JOIN competitors USING (competitor_id) WHERE competitor_mentioned GROUP BY 1""",
        "calls", "competitors",
    ),
    "competitor_share_pct": query(
        f"""SELECT competitor_name, COUNT(*) AS mentions,
                   {half_up("(CAST(100 AS DOUBLE) * COUNT(*) / SUM(COUNT(*)) OVER ())", 1)} AS pct
            FROM calls LEFT JOIN competitors USING (competitor_id) WHERE competitor_mentioned GROUP BY 1""",
        "calls", "competitors",
    ),
    "topics_by_volume": query(
        f"SELECT call_topic, call_volume, {half_up('(save_rate * 100)', 1)} AS save_rate_pct FROM topic_mix", "topic_mix"
    ),
    "offers_by_save": query(
        f"""SELECT offer_name, {half_up("(save_rate * 100)", 1)} AS save_rate_pct, times_presented, times_accepted
            FROM offer_effectiveness""", "offer_effectiveness"
    ),
    "offers_vs_competitor": query(
        f"""SELECT offer_name, save_rate, times_presented FROM offer_effectiveness
            WHERE competitor_name = '{COMPETITOR}'""", "offer_effectiveness"
    ),
    "best_rate_per_offer": query(
        f"""SELECT offer_id, offer_name, save_rate, CAST(price AS DOUBLE) AS price,
                   CAST(monthly_cost AS DOUBLE) AS monthly_cost, best_for FROM ({_BEST})""", "offer_effectiveness"
    ),
    "competitor_cards": query(
        f"""SELECT c.*, o.offer_name AS counter_offer_name, o.save_rate AS counter_save_rate, o.price AS counter_price,
                   CAST(o.monthly_cost AS DOUBLE) AS counter_monthly_cost, o.best_for AS counter_best_for
            FROM competitors c LEFT JOIN ({_BEST}) o ON o.offer_id = c.best_counter_offer_id""",
        "competitors", "offer_effectiveness",
    ),
    "agents_scatter": query(
        f"""SELECT agent_id, agent_name, team, tier, {half_up("(save_rate * 100)", 1)} AS save_rate_pct,
                   avg_handle_time_min, CAST(nps AS DOUBLE) AS nps FROM agent_performance""", "agent_performance"
    ),
    "agents_lowest": query(
        f"""SELECT agent_id, agent_name, team, tier, {half_up("(save_rate * 100)", 1)} AS save_rate_pct,
                   {half_up("avg_handle_time_min", 1)} AS avg_handle_time,
                   {half_up("(offer_conversion_rate * 100)", 1)} AS offer_conversion_pct, CAST(nps AS DOUBLE) AS nps
            FROM agent_performance ORDER BY save_rate, agent_id LIMIT 20""", "agent_performance"
    ),
    "agents_need_coaching": query(
        """SELECT agent_id, agent_name, team, tier, save_rate, avg_handle_time_min, offer_conversion_rate
           FROM agent_performance WHERE tier IN ('Needs Coaching', 'At Risk')
           ORDER BY save_rate, agent_id LIMIT 20""", "agent_performance"
    ),
    "tier_rollup": query(
        f"""SELECT tier, COUNT(*) AS agents, {_mean("save_rate", 4)} AS avg_save_rate,
                   {_mean("avg_handle_time_min", 1)} AS avg_handle_time, {_mean("nps", 1)} AS avg_nps,
                   CASE tier WHEN 'Top Performer' THEN 0 WHEN 'On Target' THEN 1 WHEN 'Needs Coaching' THEN 2
                             WHEN 'At Risk' THEN 3 ELSE 9 END AS tier_order
            FROM agent_performance GROUP BY tier""", "agent_performance"
    ),
    "kpi_critical_count": query(
        "SELECT COUNT(*) AS critical_customers FROM tiered WHERE risk_tier = 'Critical'", "tiered"
    ),
    "critical_avg": query(
        f"""SELECT COUNT(*) AS critical_customers,
                   {half_up("(CAST(SUM(CAST(churn_score AS DECIMAL(18, 4))) AS DOUBLE) / COUNT(*))", 3)} AS avg_score
            FROM tiered WHERE risk_tier = 'Critical'""", "tiered"
    ),
    "critical_top": query(
        f"""SELECT customer_id, market, plan_type, monthly_spend, {half_up("(churn_score * 100)", 1)} AS churn_score_pct,
                   recommended_offer_id, competitor_id
            FROM scores WHERE risk_tier = 'Critical' ORDER BY churn_score DESC, customer_id LIMIT 200""", "scores"
    ),
    "roi_case": query(
        f"""SELECT saved_customers, protected_revenue, program_cost,
                   {half_up("(protected_revenue / program_cost)", 2)} AS multiple
            FROM (SELECT COUNT(*) AS saved_customers,
                         {half_up(f"(CAST(SUM(CAST(monthly_spend AS DECIMAL(18, 2))) AS DOUBLE) * {MONTHS})", 2)} AS protected_revenue
                  FROM customers WHERE status = 'Active'
                    AND customer_id IN (SELECT customer_id FROM calls WHERE outcome = 'Saved')),
                 (SELECT CAST(SUM(monthly_cost) AS DOUBLE) AS program_cost
                  FROM calls JOIN offers ON offer_id = offer_presented_id WHERE offer_accepted)""",
        "calls", "customers", "offers",
    ),
}

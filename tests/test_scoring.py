import bisect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast import rules
from holdfast.plans import model, scoring


def expected_score(x, ordered, share):
    """Calibrated score of one value among all sorted values."""
    below, upto = bisect.bisect_left(ordered, x), bisect.bisect_right(ordered, x)
    position = (below + (upto - below + 1) / 2) / len(ordered)
    start = 1 - share
    if position < start:
        score = 0.02 + position / start * 0.53
    else:
        depth = (position - start) / (1 - start)
        score = 0.55 + depth * depth * 0.30
    return float(np.rint(score * 10_000) / 10_000)


@pytest.mark.parametrize("ties", [False, True])
def test_calibration(spark, ties):
    rng = random.Random(1)
    raw = [round(rng.random(), 2 if ties else 12) for _ in range(4000)]
    frame = spark.createDataFrame(list(enumerate(raw)), "customer_id int, raw_score double")
    got = {r.customer_id: r.churn_score for r in scoring.calibrate_scores(frame).collect()}
    ordered = sorted(raw)
    assert got == {i: expected_score(x, ordered, rules.CRITICAL_SHARE) for i, x in enumerate(raw)}


def test_critical_count_of_fifty_thousand(spark):
    frame = spark.range(50_000).select(F.col("id").alias("customer_id"), (F.col("id") / 50_000).alias("raw_score"))
    scored = scoring.calibrate_scores(frame)
    tiers = dict(scored.groupBy(scoring.risk_tier(F.col("churn_score"))).count().collect())
    assert tiers["Critical"] == 6380 and sum(tiers.values()) == 50_000
    mean = scored.where("churn_score >= 0.55").agg(F.avg("churn_score")).first()[0]
    assert mean == pytest.approx(0.65, abs=0.001)


@pytest.mark.parametrize("share, tier", [(0.0, None), (1.0, "Critical")])
def test_calibration_at_the_ends(spark, share, tier):
    frame = spark.range(100).select(F.col("id").alias("customer_id"), F.rand(1).alias("raw_score"))
    tiers = {r[0] for r in scoring.calibrate_scores(frame, critical_share=share)
             .select(scoring.risk_tier(F.col("churn_score"))).distinct().collect()}
    assert tiers == {tier} if tier else "Critical" not in tiers or share == 0.0


def test_a_missing_score_stays_missing(spark):
    frame = spark.createDataFrame([(1, 0.1), (2, None), (3, 0.9)], "customer_id int, raw_score double")
    rows = {r.customer_id: (r.churn_score, r.tier) for r in
            scoring.calibrate_scores(frame).withColumn("tier", scoring.risk_tier(F.col("churn_score"))).collect()}
    assert rows[2] == (None, None) and rows[3] == (0.85, "Critical")


def test_all_scores_tied(spark):
    frame = spark.range(50).select(F.col("id").alias("customer_id"), F.lit(0.5).alias("raw_score"))
    assert scoring.calibrate_scores(frame).select("churn_score").distinct().count() == 1


def test_risk_tier_cutoffs(spark):
    scores = [0.55, 0.5499, 0.40, 0.3999, 0.25, 0.2499]
    frame = spark.createDataFrame([(s,) for s in scores], "s double")
    tiers = [r[0] for r in frame.orderBy(F.desc("s")).select(scoring.risk_tier(F.col("s"))).collect()]
    assert tiers == ["Critical", "High", "High", "Medium", "Medium", "Low"]


def _sources(spark):
    customers = spark.createDataFrame(
        [("CUST-1", "Internet Only", False, 5, 60.0, "Month-to-Month", False, "1 Gbps", "Austin", "Active"),
         ("CUST-2", "Triple Play", True, 50, 160.0, "2-Year", True, "1 Gbps", "Austin", "Churned"),
         ("CUST-3", "Triple Play", False, 11, 160.0, "2-Year", True, "1 Gbps", "Austin", "Active"),
         ("CUST-4", "Triple Play", True, 12, 160.0, "Month-to-Month", True, "1 Gbps", "Austin", "Active")],
        "customer_id string, plan_type string, has_mobile boolean, tenure_months int, monthly_spend double, "
        "contract_type string, autopay_enrolled boolean, internet_speed string, market string, status string",
    )
    calls = spark.createDataFrame(
        [("CUST-2", True, "COMP-02"), ("CUST-2", True, "COMP-04"), ("CUST-2", True, "COMP-04"), ("CUST-2", False, None),
         ("CUST-3", True, "COMP-06"), ("CUST-3", True, "COMP-02"), ("CUST-4", True, "COMP-77"), ("CUST-4", None, None)],
        "customer_id string, competitor_mentioned boolean, competitor_id string",
    )
    events = spark.createDataFrame(
        [("CUST-1", "Outage"), ("CUST-1", "Slow Speed"), ("CUST-1", "Billing System")], "customer_id string, event_type string"
    )
    return customers, calls, events


def test_features_and_flags(spark):
    frame = scoring.churn_feature_flags(scoring.churn_features(*_sources(spark)))
    rows = {r.customer_id: r for r in frame.collect()}
    one, two = rows["CUST-1"], rows["CUST-2"]
    assert (one.n_calls, one.n_competitor_calls, one.ever_competitor, one.n_events, one.n_quality_events) == (0, 0, 0, 3, 2)
    assert (one.is_month_to_month, one.is_internet_only, one.no_mobile, one.low_tenure, one.no_autopay) == (1,) * 5
    assert (two.n_calls, two.n_competitor_calls, two.ever_competitor, two.n_events, two.label) == (4, 3, 1, 0, 1)
    assert rows["CUST-3"].low_tenure == 1 and rows["CUST-4"].low_tenure == 0
    assert frame.columns[:15] == [
        "customer_id", "plan_type", "has_mobile", "tenure_months", "monthly_spend", "contract_type", "autopay_enrolled",
        "internet_speed", "market", "n_calls", "n_competitor_calls", "ever_competitor", "n_events", "n_quality_events",
        "label"]


def test_offers_and_score_table(spark):
    customers, calls, events = _sources(spark)
    dominant = dict(map(tuple, scoring.dominant_competitor(calls).collect()))
    assert dominant == {"CUST-2": "COMP-04", "CUST-3": "COMP-02", "CUST-4": "COMP-77"}  # ties: lowest id
    frame = scoring.scoring_frame(customers, calls, events).withColumn("raw_score", F.col("tenure_months") / 100)
    offers = {r.customer_id: r.recommended_offer_id for r in scoring.churn_scores(frame).collect()}
    # internet only; counter-offers; an unknown competitor falls back to the profile
    assert offers == {"CUST-1": "OFF-01", "CUST-2": "OFF-04", "CUST-3": "OFF-03", "CUST-4": "OFF-03"}
    assert scoring.churn_scores(frame, active_only=True).count() == 3


def test_topic_offer(spark):
    frame = spark.createDataFrame(
        [("COMP-04", "Billing Dispute"), (None, "Billing Dispute"), (None, None), ("COMP-99", "Moving / Relocation")],
        "c string, t string",
    )
    got = [r[0] for r in frame.select(scoring.topic_offer(F.col("c"), F.col("t"))).collect()]
    assert got == ["OFF-04", "OFF-06", None, "OFF-05"]


def test_model_finds_a_planted_signal(spark):
    noise = [F.rand(seed).alias(f"n{seed}") for seed in range(1, 4)]
    base = spark.range(4000).select(F.col("id").alias("customer_id"), *noise)
    frame = base.withColumns({name: F.floor(F.col("n1") * 60) for name in scoring.FEATURES}).withColumn(
        "monthly_spend", F.col("n2") * 100
    ).withColumn("label", (F.col("n1") * 0.7 + F.col("n3") * 0.3 > 0.6).cast("int"))
    trained, report = model.train_churn(frame, maxIter=10)
    row = report.first()
    assert 0.75 < row.test_auc < 1.0
    assert row.n_train / 4000 == pytest.approx(0.75, abs=0.03) and row.n_train + row.n_test == 4000
    train, test = model.split_by_hash(frame, "customer_id", "label")
    assert train.join(test, "customer_id").count() == 0
    rates = [part.agg(F.avg("label")).first()[0] for part in (train, test)]
    assert rates[0] == pytest.approx(rates[1], abs=0.05)
    assert model.score_customers(trained, frame).agg(F.min("raw_score"), F.max("raw_score")).first()[0] >= 0


def test_a_file_of_training_rows_is_dealt_over_all_cores(spark, tmp_path):
    """Every level of every tree is a pass over the training rows, however few files they are in."""
    frame = spark.range(2000).select(F.col("id").alias("customer_id"), *[(F.col("id") % 97).alias(n) for n in scoring.FEATURES],
                                     (F.col("id") % 97 > 48).cast("int").alias("label"))
    frame.coalesce(1).write.parquet(str(tmp_path / "rows"))
    rows = model.training_rows(spark.read.parquet(str(tmp_path / "rows")), "customer_id")[0]
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert rows.groupBy(F.spark_partition_id()).count().count() == spark.sparkContext.defaultParallelism
    train, _ = model.split_by_hash(frame, "customer_id", "label")
    assert sorted(rows.collect()) == sorted(train.collect())

"""Queries for features, the model, calibration and offers."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast import rules
from holdfast.operators.quality import tier_checks
from holdfast.plans import model, scoring
from holdfast.registry.sql import count_if, half_up, query, whole
from holdfast.session import scratch_root
from holdfast.sources import star_tables as star
from holdfast.sources.publish import publish_table


def features(spark, sf) -> DataFrame:
    return scoring.churn_features(
        star.customers(spark, sf, with_churn_date=False), star.calls(spark, sf), star.service_events(spark, sf),
        star.QUALITY_EVENTS,
    )


def flagged(spark, sf) -> DataFrame:
    return scoring.churn_feature_flags(features(spark, sf), internet_only=star.INTERNET_ONLY_PLAN)


def frame(spark, sf) -> DataFrame:
    return scoring.scoring_frame(
        star.customers(spark, sf, with_churn_date=False), star.calls(spark, sf), star.service_events(spark, sf),
        star.QUALITY_EVENTS, internet_only=star.INTERNET_ONLY_PLAN,
    )


def calibrated(spark, sf) -> DataFrame:
    return scoring.calibrate_scores(star.raw_scores(spark, sf)).select(
        "customer_id", "market", "churn_score", "raw_score"
    )


def tiered(spark, sf) -> DataFrame:
    return calibrated(spark, sf).withColumn("risk_tier", scoring.risk_tier(F.col("churn_score")))


def scores(spark, sf) -> DataFrame:
    """The score table, with the exact stand-in for the model's probability."""
    scored = frame(spark, sf).withColumn("raw_score", -F.col("monthly_spend"))
    return scoring.churn_scores(scored, **star.OFFER_RULES)


def _next_best_offer(spark, sf):
    return frame(spark, sf).select(
        "customer_id", "competitor_id",
        scoring.next_best_offer(F.col("competitor_id"), **star.OFFER_RULES).alias("recommended_offer_id"),
    )


def _topic_offer(spark, sf):
    """Offer per call, counted by competitor and topic."""
    offer = scoring.topic_offer(F.col("competitor_id"), F.col("call_topic"), star.COUNTER_PARTS, star.TOPIC_PARTS)
    return star.calls(spark, sf).select("call_id", "competitor_id", "call_topic", offer.alias("offer_id"))


def _trained(spark, sf) -> tuple[DataFrame, PipelineModel, DataFrame]:
    """Feature table, model and report, kept below the scratch folder under the session's and the tables' names."""
    name = re.sub(r"\W+", "_", f"{spark.sparkContext.applicationId} {sf}")
    base = f"{scratch_root(spark)}/churn-{name}"
    try:
        report = spark.read.parquet(f"{base}/report")  # written last
        return spark.read.parquet(f"{base}/features"), PipelineModel.load(f"{base}/model"), report
    except AnalysisException:
        table = publish_table(frame(spark, sf), f"{base}/features")
        trained, report = model.train_churn(table)
        trained.write().overwrite().save(f"{base}/model")
        return table, trained, publish_table(report, f"{base}/report")


def _train_churn(spark, sf):
    """Sizes of the split and settings; whether the hold-out AUC is better than chance."""
    return _trained(spark, sf)[2].withColumn("learns", F.col("test_auc").between(0.5, 1.0)).drop("test_auc")


def _score_customers(spark, sf):
    """Every customer has a probability; the model's own numbers have no SQL."""
    table, trained, _ = _trained(spark, sf)
    scored = model.score_customers(trained, table)
    return scored.select("customer_id", "label", F.col("raw_score").between(0.0, 1.0).alias("is_probability"))


def model_table(spark, sf) -> DataFrame:
    """The score table from the trained model."""
    table, trained, _ = _trained(spark, sf)
    return scoring.churn_scores(model.score_customers(trained, table), **star.OFFER_RULES)


def _model_scores(spark, sf):
    """The score table; of the columns that hang on the model, whether they are what they may be."""
    made = model_table(spark, sf)
    tier = F.col("risk_tier")
    return made.select(
        "customer_id", "competitor_id", "n_competitor_calls", "monthly_spend", "tenure_months", "plan_type", "market",
        "recommended_offer_id", F.col("churn_score").between(0.01, 0.99).alias("has_score"), tier.isNotNull().alias("has_tier"),
    )


QUERIES = {
    "churn_features": features,
    "churn_feature_flags": flagged,
    "calibrate_scores": calibrated,
    "risk_tier": lambda spark, sf: tiered(spark, sf).select("customer_id", "churn_score", "risk_tier"),
    "dominant_competitor": lambda spark, sf: scoring.dominant_competitor(star.calls(spark, sf)),
    "next_best_offer": _next_best_offer,
    "topic_offer": _topic_offer,
    "churn_scores": scores,
    "tier_checks": lambda spark, sf: tier_checks(tiered(spark, sf)),
    "train_churn": _train_churn,
    "score_customers": _score_customers,
    "model_scores": _model_scores,
}

_TRAIN = f"""CAST('0x' || substr(md5('42|' || CAST(label AS INTEGER) || '|' || customer_id), 1, 8) AS BIGINT) % 10000
             < {int(rules.TRAIN_SHARE * 10_000)}"""

ORACLE = {
    "churn_features": whole("features"),
    "churn_feature_flags": whole("flagged"),
    "calibrate_scores": query("SELECT customer_id, market, churn_score, raw_score FROM calibrated", "calibrated"),
    "risk_tier": query("SELECT customer_id, churn_score, risk_tier FROM tiered", "tiered"),
    "dominant_competitor": whole("dominant"),
    "next_best_offer": query(
        "SELECT customer_id, competitor_id, recommended_offer_id FROM scores", "scores"
    ),
    "topic_offer": query(
        """SELECT call_id, competitor_id, call_topic,
                  COALESCE(3 * CAST(competitor_id AS INTEGER) + 1, 20 + CAST(substr(call_topic, 1, 1) AS INTEGER)) AS offer_id
           FROM calls""", "calls"
    ),
    "churn_scores": whole("scores"),
    "tier_checks": query(
        f"""SELECT risk_tier, COUNT(*) AS customers,
                   {half_up("(CAST(SUM(CAST(churn_score AS DECIMAL(18, 4))) AS DOUBLE) / COUNT(*))", 3)} AS mean_score
            FROM tiered GROUP BY 1""", "tiered"
    ),
    "train_churn": query(
        f"""SELECT {count_if(_TRAIN)} AS n_train, {count_if(f"NOT ({_TRAIN})")} AS n_test, {rules.TREE_SETTINGS["maxIter"]} AS n_trees,
                   {rules.TREE_SETTINGS["maxDepth"]} AS max_depth, CAST({rules.TREE_SETTINGS["stepSize"]} AS DOUBLE) AS learning_rate,
                   TRUE AS learns
            FROM flagged""", "flagged"
    ),
    "score_customers": query("SELECT customer_id, label, TRUE AS is_probability FROM flagged", "flagged"),
    "model_scores": query(
        """SELECT customer_id, competitor_id, n_competitor_calls, monthly_spend, tenure_months, plan_type, market,
                  recommended_offer_id, TRUE AS has_score, TRUE AS has_tier FROM scores""", "scores"
    ),
}

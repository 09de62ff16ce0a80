"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from holdfast import registry
from holdfast.registry import scoring, text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, tables, name):
    assert differences(entry.queries()[name](spark, SF), tables, entry.oracle_sql()[name]) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sum(r.call_volume for r in rows) == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert [r.call_volume for r in rows] == sorted((r.call_volume for r in rows), reverse=True)


def test_score_table_from_the_model(spark):
    table = scoring.model_table(spark, SF)
    n = spark.read.parquet(f"{SF}/customer.parquet").count()
    assert table.columns == [
        "customer_id", "churn_score", "risk_tier", "recommended_offer_id", "competitor_id", "n_competitor_calls",
        "monthly_spend", "tenure_months", "plan_type", "market",
    ]
    assert table.count() == n and table.select("customer_id").distinct().count() == n
    assert table.where("churn_score < 0.01 OR churn_score > 0.99 OR recommended_offer_id IS NULL").count() == 0


def test_topic_model_labels_every_text(spark):
    labelled = text.topic_labels(spark, SF)
    assert labelled.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert {r[0] for r in labelled.select("predicted_topic").distinct().collect()} <= {"0", "1"}

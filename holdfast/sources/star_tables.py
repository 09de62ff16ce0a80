"""The retention tables as projections of an order-processing star schema.

Lines of orders play the calls, suppliers the agents, regions the competitors and
parts the offers.  Every expression is deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MENTION_DISCOUNT = 0.05
CHURN_BALANCE = 500
INTERNET_ONLY_PLAN = "BUILDING"
DISCONNECT_TOPICS = ("1-URGENT", "2-HIGH")
QUALITY_EVENTS = ("error",)
# Region r is countered by part 3r + 1; there are five regions.
COUNTER_PARTS = {"0": 1, "1": 4, "2": 7, "3": 10, "4": 13}
TOPIC_PARTS = {"1-URGENT": 21, "2-HIGH": 22, "3-MEDIUM": 23, "4-NOT SPECIFIED": 24, "5-LOW": 25}
INTERNET_ONLY_PART, NO_MOBILE_PART, MONTH_TO_MONTH_PART, DEFAULT_PART = 31, 32, 33, 35
OFFER_RULES = {
    "counter_offers": COUNTER_PARTS, "internet_only": INTERNET_ONLY_PART, "no_mobile": NO_MOBILE_PART,
    "month_to_month": MONTH_TO_MONTH_PART, "default": DEFAULT_PART,
}
ORDER_COLUMNS = {"customer_id", "call_topic"}


# Declared, so that planning a query starts no job to look the columns up.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def calls(spark: SparkSession, folder: str, with_orders: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Calls, one per order line. ``with_orders=False`` leaves out customer and topic, and so the join.

    ``keep`` names columns of the line to hand out too.
    """
    # The join exchanges these, so what calls do not show of a line is left behind.
    line = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("agent_id"), F.col("l_shipdate").cast("date").alias("call_date"),
        F.col("l_quantity").alias("handle_time_min"), (F.col("l_discount") >= MENTION_DISCOUNT).alias("competitor_mentioned"),
        F.when(F.col("l_tax") > 0, F.col("l_partkey")).alias("offer_presented_id"), "l_returnflag", "l_linestatus",
    )
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    columns: list[Column] = [
        F.concat_ws("-", F.lit("CALL"), "l_orderkey", "l_linenumber").alias("call_id"),
        F.col("agent_id"),
        F.col("call_date"),
        F.col("handle_time_min"),
        F.col("competitor_mentioned"),
        F.when(F.col("competitor_mentioned"), (F.col("l_linenumber") % 5).cast("string")).alias("competitor_id"),
        F.concat_ws(" ", flag, status).alias("mention_text"),
        F.col("offer_presented_id"),
        ((flag == "R") & (status == "O")).alias("offer_accepted"),
        F.when(flag == "R", "Saved").when(flag == "A", "Churned").otherwise("Pending").alias("outcome"),
    ]
    if not with_orders:
        return line.select(*columns)
    order = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("customer_id"), F.col("o_orderpriority").alias("call_topic")
    )
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select("customer_id", "call_topic", *columns, *keep)


def distinct_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls, of which equal rows are one, each with a ``call_id`` of its own.

    Equal rows belong to the same order, by which the join has dealt them out already, so they are found without an
    exchange of whole calls.  Different calls of one line are numbered in the order of their columns.
    """
    place = ["l_orderkey", "l_linenumber"]
    single = calls(spark, folder, keep=tuple(place)).distinct()
    others = sorted(c for c in single.columns if c not in (*place, "call_id"))
    number = F.row_number().over(W.partitionBy(*place).orderBy(*others))
    key = F.when(number == 1, F.col("call_id")).otherwise(F.concat_ws("/", "call_id", number.cast("string")))
    return single.withColumn("call_id", key).drop(*place)


def customers(spark: SparkSession, folder: str, with_churn_date: bool = True) -> DataFrame:
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    key = F.col("c_custkey")
    base = customer.join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    columns = [
        key.alias("customer_id"), F.col("c_name").alias("customer_name"), F.col("n_name").alias("market"),
        F.col("c_mktsegment").alias("plan_type"), F.col("c_acctbal").alias("monthly_spend"),
        (key % 120 + 1).alias("tenure_months"), (key % 3 == 0).alias("has_mobile"),
        F.concat(F.lit("speed "), (key % 4).cast("string")).alias("internet_speed"),
        F.when(key % 3 == 0, "Month-to-Month").when(key % 3 == 1, "1-Year").otherwise("2-Year").alias("contract_type"),
        (key % 5 < 3).alias("autopay_enrolled"),
        F.when(F.col("c_acctbal") < CHURN_BALANCE, "Churned").otherwise("Active").alias("status"),
    ]
    if not with_churn_date:
        return base.select(*columns)
    last_order = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.max("o_orderdate").cast("date").alias("_last_order")
    )
    churn_date = F.when(F.col("c_acctbal") < CHURN_BALANCE, F.col("_last_order")).alias("churn_date")
    return base.join(last_order, key == F.col("o_custkey"), "left").select(*columns, churn_date)


def agents(spark: SparkSession, folder: str) -> DataFrame:
    key, balance = F.col("s_suppkey"), F.col("s_acctbal")
    tier = (
        F.when(balance >= 7000, "Top Performer").when(balance >= 2500, "On Target")
        .when(balance >= 0, "Needs Coaching").otherwise("At Risk")
    )
    return table(spark, folder, "supplier").select(
        key.alias("agent_id"), F.col("s_name").alias("agent_name"), F.col("s_nationkey").alias("team"),
        tier.alias("tier"), (key % 90).alias("nps"),
        F.date_add(F.lit("2015-01-01").cast("date"), (key % 3650).cast("int")).alias("hire_date"),
    )


def competitors(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("r_regionkey")
    return table(spark, folder, "region").select(
        key.cast("string").alias("competitor_id"), F.col("r_name").alias("competitor_name"),
        (key * 3 + 1).cast("bigint").alias("best_counter_offer_id"),
    )


def offers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("offer_id"), F.col("p_name").alias("offer_name"),
        F.col("p_retailprice").alias("price"), F.col("p_size").alias("monthly_cost"),
        F.col("p_type").alias("cost_type"), (F.col("p_size") / 50.0).alias("base_save_rate"),
        F.col("p_brand").alias("best_for"),
    )


def service_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", F.col("user_id").alias("customer_id"), "event_type",
        F.col("ts").cast("date").alias("event_date"), F.col("value").alias("duration_min"),
    )


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """Cases from orders."""
    status = F.col("o_orderstatus")
    region = F.col("o_orderkey") % 5
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("customer_id"),
        region.cast("string").alias("competitor_id"), (region * 3 + 1).alias("recommended_offer_id"),
        F.when(status == "O", "Open").when(status == "P", "In Progress").otherwise("Saved").alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Critical").when(F.col("o_orderpriority") == "2-HIGH", "High")
        .when(F.col("o_orderpriority") == "5-LOW", "Low").otherwise("Medium").alias("priority"),
        F.col("o_orderdate").alias("opened_at"),
    )


ACTION_EVENTS = {
    "click": "proposed", "view": "approved", "purchase": "committed", "error": "rejected", "signup": "corrected",
}


def action_events(spark: SparkSession, folder: str) -> DataFrame:
    """Workflow events; four consecutive events belong to one action."""
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in ACTION_EVENTS.items()])
    return table(spark, folder, "events").select(
        F.expr("event_id div 4").alias("action_id"), kind.alias("event"), F.col("ts").alias("created_at"), "event_id",
        F.expr("event_id div 4").alias("case_id"), F.expr("event_id div 4 % 1000").alias("customer_id"),
        (F.col("event_id") % 7).alias("offer_id"), F.concat(F.lit("user "), F.col("user_id")).alias("actor"),
    )


def actions(spark: SparkSession, folder: str) -> DataFrame:
    """Current actions, with the time of the commit."""
    return action_events(spark, folder).groupBy("action_id", "case_id").agg(
        F.min(F.when(F.col("event") == "committed", F.col("created_at"))).alias("committed_at")
    )


def raw_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with an exact stand-in for the model's probability: low balance, high risk."""
    return customers(spark, folder, with_churn_date=False).withColumn("raw_score", -F.col("monthly_spend"))

"""Properties that only matter at scale: skew, pushdown, shared scans, shared folders."""

import ast
import pathlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from holdfast import session
from holdfast.plans import marts
from holdfast.sources import star_tables as star

ROOT = pathlib.Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def settings(spark):
    changed = []

    def use(**values):
        for key, value in values.items():
            changed.append("spark.sql." + key)
            spark.conf.set("spark.sql." + key, value)

    yield use
    for key in changed:
        spark.conf.unset(key)
    session.prepare(spark)


def test_a_hot_customer_is_split(spark, settings):
    settings(**{
        "autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "-1",
        "adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "adaptive.advisoryPartitionSizeInBytes": "20000",
        "adaptive.coalescePartitions.enabled": "false", "adaptive.skewJoin.skewedPartitionFactor": "2",
    })
    calls = spark.range(0, 60_000, 1, 16).select(
        F.col("id").cast("string").alias("call_id"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).alias("customer_id"),
        F.lit("2026-05-01").alias("call_date"), F.lit("Saved").alias("outcome"),
        *[F.lit(None).cast("string").alias(c) for c in ("agent_id", "competitor_id", "offer_presented_id", "call_topic", "mention_text")],
        F.lit(1.0).alias("handle_time_min"), F.lit(False).alias("competitor_mentioned"), F.lit(False).alias("offer_accepted"),
    )
    customers = spark.range(1000).select(F.col("id").alias("customer_id"), *[
        F.lit("x").alias(c) for c in ("market", "plan_type", "tenure_months", "monthly_spend")])
    joined = calls.join(customers, "customer_id", "left")
    assert joined.count() == 60_000
    plan = final_plan(joined.select("call_id", "market"))
    assert "skew=true" in plan.lower() or "skewed" in plan.lower()


def test_marts_read_only_the_columns_they_need(spark):
    topics = marts.topic_mix(star.calls(spark, SF))._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", topics)
    read = {c.split(":")[0] for s in schemas for c in s.split(",")}
    assert read == {"l_orderkey", "l_quantity", "l_discount", "l_returnflag", "o_orderkey", "o_orderpriority"}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_declared_columns_are_those_of_the_files(spark, folder):
    for name in star.SCHEMAS:
        found = spark.read.parquet(f"/root/testdata/{folder}/{name}.parquet").schema
        assert star.table(spark, SF, name).schema.simpleString() == found.simpleString(), name


def test_filters_reach_the_scan(spark):
    from holdfast.operators.notes import unlabeled_filter

    plan = unlabeled_filter(star.table(spark, SF, "documents"), "source", "src1")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(source,src1)" in plan


def test_scoring_reads_the_calls_once(spark):
    from holdfast.registry import scoring

    plan = scoring.frame(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[l_orderkey", plan)) == 1


def test_windows_without_a_key_only_follow_aggregations(spark):
    """A single-partition exchange may hold days, topics, competitors or value counts, never raw rows."""
    allowed = {"daily_kpis", "trend", "kpi_churn_peak", "kpi_mention_peak", "kpi_overall_save", "kpi_latest",
               "baseline_vs_peak"}
    for name in ("call_fact", "offer_effectiveness", "dominant_competitor", "churn_features", "topk_per_key",
                 "dedupe_increment", "snapshot_diff", "scd2_history", "last_turns", "action_state"):
        assert name not in allowed
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan, name


def test_scratch_folder_comes_from_the_session():
    class Session:
        conf = type("Conf", (), {"get": lambda self, key, default: {"spark.checkpoint.dir": "s3a://shared/scratch/"}.get(key)})()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    assert session.scratch_root(Session()) == "s3a://shared/scratch"
    assert session.scratch_dir(Session(), "x").startswith("s3a://shared/scratch/x-")


def test_materialize_evaluates_once(spark):
    frame = session.materialize(spark.range(5).select("id", F.uuid().alias("u")), "five")
    assert sorted(map(tuple, frame.collect())) == sorted(map(tuple, frame.collect()))


def test_partitions_follow_the_input():
    assert session.sized_for(1 << 20, 8)["spark.sql.shuffle.partitions"] == "16"
    settings = session.sized_for(100 << 40, 8000)
    partitions, scan = int(settings["spark.sql.shuffle.partitions"]), int(settings["spark.sql.files.maxPartitionBytes"])
    assert partitions >= 16_000 and partitions * ((100 << 40) / scan) <= session.MAX_BLOCKS
    assert scan <= session.MAX_SCAN_BYTES


def test_scratch_tables_can_be_removed(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    session.clear_scratch(spark)
    table = session.materialize(spark.range(5), "kept")
    place = Path(urlparse(table.inputFiles()[0]).path).parent
    assert table.count() == 5 and place.exists()
    assert session.clear_scratch(spark) == 1 and not place.exists() and session.clear_scratch(spark) == 0


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError):
        session.scratch_root(Session())


def test_no_driver_side_tables_in_the_library():
    """No localCheckpoint, toPandas, RDD or cross-machine local files; collect only where a bound is written down."""
    collects = {}
    for path in (ROOT / "holdfast").rglob("*.py"):
        if "llm" in path.parts:  # has tests of its own
            continue
        source = path.read_text()
        ast.parse(source)
        assert not re.search(r"localCheckpoint|toPandas|\.rdd\b|\.rand\(|monotonically", source), path
        collects[path.name] = len(re.findall(r"\.collect\(\)|\.toLocalIterator\(\)", source))
    assert {k: v for k, v in collects.items() if v} == {"ranks.py": 1, "search.py": 1}

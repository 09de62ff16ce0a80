import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from holdfast.operators import history
from holdfast.sources.publish import SnapshotRejected, publish_bucketed, publish_snapshot, publish_table

T0 = dt.datetime(2026, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_dedupe_keeps_the_latest(spark):
    frame = spark.createDataFrame(
        [("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None), ("b", None, "q")], "id string, seq int, v string"
    )
    assert sorted(map(tuple, history.dedupe_latest(frame, ["id"], ["seq"]).collect())) == [("a", 3, "z"), ("b", 1, None)]


def test_snapshot_diff(spark):
    before = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "c", 3.0), (4, None, None)], "k int, s string, x double")
    after = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (4, None, None), (5, "e", 5.0)], "k int, s string, x double")
    got = {r.k: (r.change_type, r.s, r.x) for r in history.snapshot_diff(before, after, "k").collect()}
    assert got == {2: ("update", "b", 2.0), 3: ("delete", "c", 3.0), 5: ("insert", "e", 5.0)}


FEED = "k string, lsn int, ts timestamp, change string, v string"


def scd2(feed, **options):
    return history.scd2_history(feed, "k", "lsn", "ts", "change", ["v"], **options)


def test_delete_closes_and_reinsert_opens(spark):
    feed = spark.createDataFrame(
        [("a", 1, at(1), "insert", "one"), ("a", 2, at(2), "update", "two"), ("a", 3, at(3), "delete", "two"),
         ("a", 5, at(5), "insert", "five"), ("b", 4, at(4), "insert", "x"), ("c", 6, at(6), "insert", "y"),
         ("c", 7, at(7), "delete", "y")], FEED
    )
    rows = sorted(map(tuple, scd2(feed).collect()))
    assert rows == [
        ("a", 1, "one", at(1), at(2), False), ("a", 2, "two", at(2), at(3), False), ("a", 5, "five", at(5), None, True),
        ("b", 4, "x", at(4), None, True), ("c", 6, "y", at(6), at(7), False),
    ]
    assert {(r.k, r.v) for r in history.as_of(scd2(feed), F.lit(at(4))).collect()} == {("b", "x")}
    assert {r.k for r in history.current_rows(scd2(feed)).collect()} == {"a", "b"}


def test_hot_keys_are_sliced_with_the_same_result(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", None, f"k{i % 40}"]), i, at(i), rng.choice(["update", "delete"]), str(i))
            for i in range(1500)]
    feed = spark.createDataFrame(rows, FEED).repartition(6)
    plain = sorted(map(tuple, scd2(feed).collect()), key=repr)
    assert sorted(map(tuple, scd2(feed, max_changes=50).collect()), key=repr) == plain


def test_sequences_of_text(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "k"]), f"0/{i:08X}", at(i), "update", str(i)) for i in range(400)]
    feed = spark.createDataFrame(rows, FEED.replace("lsn int", "lsn string")).repartition(5)
    plain = sorted(map(tuple, scd2(feed).collect()))
    assert sorted(map(tuple, scd2(feed, max_changes=60).collect())) == plain and len(plain) == 400


def test_before_images_are_left_out(spark):
    rows = [("a", 1, at(1), "insert", "one"), ("a", 2, at(2), "update_preimage", "one"), ("a", 2, at(2), "update_postimage", "two")]
    got = sorted(map(tuple, scd2(spark.createDataFrame(rows, FEED)).collect()))
    assert got == [("a", 1, "one", at(1), at(2), False), ("a", 2, "two", at(2), None, True)]


def test_latest_row_with_a_map(spark):
    frame = spark.createDataFrame([("a", 1, {"x": "1"}), ("a", 2, {"x": "2"}), ("b", 1, None)], "k string, t int, _extra map<string,string>")
    got = sorted((r.k, r.t, r._extra) for r in history.dedupe_latest(frame, ["k"], ["t"]).collect())
    assert got == [("a", 2, {"x": "2"}), ("b", 1, None)]


def test_intervals_of_a_key_do_not_overlap(spark):
    rng = random.Random(6)
    feed = spark.createDataFrame([(f"k{rng.randint(0, 5)}", i, at(i), "update", str(i)) for i in range(300)], FEED)
    by_key = {}
    for r in scd2(feed, max_changes=20).collect():
        by_key.setdefault(r.k, []).append((r.valid_from, r.valid_to))
    for spans in by_key.values():
        spans.sort()
        assert all(end == start for (_, end), (start, _) in zip(spans, spans[1:])) and spans[-1][1] is None


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    left = spark.range(100).select((F.col("id") % 10).alias("customer_id"), "id")
    right = spark.range(10).withColumnRenamed("id", "customer_id")
    a = publish_bucketed(left, "bucketed_calls", str(tmp_path / "a"), "customer_id", 4)
    b = publish_bucketed(right, "bucketed_customers", str(tmp_path / "b"), "customer_id", 4)
    joined = a.join(b.hint("merge"), "customer_id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 100
    spark.sql("DROP TABLE bucketed_calls")
    spark.sql("DROP TABLE bucketed_customers")


def test_publish(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "customer_id int, p string")
    assert publish_table(frame, str(tmp_path / "t")).count() == 2
    assert publish_table(frame.limit(1), str(tmp_path / "t")).count() == 1  # overwritten
    parted = publish_table(frame, str(tmp_path / "p"), ["p"])
    assert sorted(map(tuple, parted.select("customer_id", "p").collect())) == [(1, "a"), (2, "b")]
    path = publish_snapshot(frame, str(tmp_path / "s"), "customer_id", "v1")
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception):
        publish_snapshot(frame, str(tmp_path / "s"), "customer_id", "v1")  # versions are never replaced
    for bad in ([(1, "a"), (1, "b")], [(None, "a")]):
        with pytest.raises(SnapshotRejected):
            publish_snapshot(spark.createDataFrame(bad, "customer_id int, p string"), str(tmp_path / "s"), "customer_id")

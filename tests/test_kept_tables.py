"""Keyed tables and change histories that are kept batch by batch."""

import datetime as dt
import random

import pytest

from holdfast.operators.history import scd2_history, snapshot_diff
from holdfast.sources.change_history import OPEN, ChangeHistory
from holdfast.sources.keyed_table import ConflictingChanges, KeyedTable

SCHEMA = "k string, s string, x double"


def test_differences_rewrite_only_touched_folders(spark, tmp_path):
    before = spark.createDataFrame([(f"k{i}", "a", float(i)) for i in range(60)], SCHEMA)
    after = before.where("k NOT IN ('k3', 'k9')").unionByName(spark.createDataFrame([("new", "z", None), ("k9", None, 9.5)], SCHEMA))
    table = KeyedTable(spark, str(tmp_path), "k", before.schema, buckets=16)
    assert table.read().count() == 0
    table.load(before)
    was = set(table.table.current().entries)
    rewritten = table.apply(snapshot_diff(table.read(), after, "k"), 0)
    now = set(table.table.current().entries)
    assert rewritten <= 3 and len(was - now) <= 3 and len(was & now) >= 10
    assert sorted(map(repr, table.read().collect())) == sorted(map(repr, after.collect()))
    # The same batch again, an empty difference, and changes of the NULL key.
    assert table.apply(snapshot_diff(before, after, "k"), 0) == 0
    assert table.apply(snapshot_diff(table.read(), after, "k"), 1) == 0
    change = spark.createDataFrame([(None, "update", "m", 1.0)], "k string, change_type string, s string, x double")
    assert table.apply(change, 2) == 1 and table.read().where("k IS NULL").collect() == [(None, "m", 1.0)] and table.read().count() == 61
    with pytest.raises(ConflictingChanges):
        table.apply(change.unionByName(change), 3)
    table.apply(change.selectExpr("k", "'delete' AS change_type", "s", "x"), 3)
    assert table.read().where("k IS NULL").count() == 0 and table.read().count() == 60


FEED = "k string, lsn int, ts timestamp, change string, v string"
NAMES = ("k", "lsn", "ts", "change")


def feed_of(n, seed=5):
    rng = random.Random(seed)
    start = dt.datetime(2026, 1, 1)
    return [(rng.choice(["hot", "hot", None, f"k{rng.randrange(12)}"]), i, start + dt.timedelta(hours=i),
             rng.choice(["insert", "update", "delete", "update_preimage"]), str(i)) for i in range(n)]


def kept(spark, root, **options):
    return ChangeHistory(spark, str(root), spark.createDataFrame([], FEED).schema, *NAMES, ["v"], **options)


def rows(frame):
    return sorted(map(repr, frame.collect()))


def test_batches_in_any_order_give_the_full_history(spark, tmp_path):
    feed = feed_of(240)
    shuffled = random.Random(2).sample(feed, len(feed))
    orders = {
        "in order": [feed[:100], feed[100:200], feed[200:]],
        "one late": [feed[:80], feed[160:], feed[80:160]],  # the middle comes last
        "first last": [feed[150:], feed[:150]],
        "shuffled, with repeats": [shuffled[:90], shuffled[60:150], shuffled[150:] + shuffled[:20]],
    }
    want = rows(scd2_history(spark.createDataFrame(feed, FEED), *NAMES, ["v"]))
    for name, batches in orders.items():
        history = kept(spark, tmp_path / name.replace(" ", "_"), buckets=4, fanout=3)
        for number, batch in enumerate(batches):
            history.add(spark.createDataFrame(batch, FEED), number)
            history.add(spark.createDataFrame(batch, FEED), number)  # a retried batch
        assert rows(history.read()) == want, name


def test_a_late_change_splits_one_interval(spark, tmp_path):
    at = lambda i: dt.datetime(2026, 1, 1) + dt.timedelta(hours=i)
    history = kept(spark, tmp_path, buckets=4)
    one = [(f"k{i}", n, at(n), "update", f"{i}.{n}") for i in range(20) for n in (10, 20, 30)]
    history.add(spark.createDataFrame(one, FEED), 0)
    before = [e for e in history.table.current().entries if e.level != OPEN]
    history.add(spark.createDataFrame([("k3", 15, at(15), "update", "late"), ("k3", 5, at(5), "update", "earlier")], FEED), 1)
    got = {r.lsn: (r.v, r.valid_to, r.is_current) for r in history.read().where("k = 'k3'").collect()}
    assert got == {5: ("earlier", at(10), False), 10: ("3.10", at(15), False), 15: ("late", at(20), False),
                   20: ("3.20", at(30), False), 30: ("3.30", None, True)}
    left = history.table.current().entries
    assert len([e for e in before if e not in left]) == 1 and history.read().count() == 62
    history.add(spark.createDataFrame([], FEED), 2)
    assert history.read().count() == 62 and history.table.current().batch == 2

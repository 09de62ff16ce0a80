"""Kept counts against a full ranking."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.operators.ranks import global_rank, rank_pct
from holdfast.sources.rank_table import NegativeCount, RankTable


def ranked(frame, table=None):
    for name, ascending in (("up", True), ("down", False)):
        frame = global_rank(frame, "x", name, ascending, kept=table.values(ascending) if table else None)
    frame = rank_pct(frame, "x", kept=table.values(present=True) if table else None)
    return sorted(map(repr, frame.select("i", "x", "up", "down", "pct").collect()))


@pytest.mark.parametrize("small", [True, False])
def test_same_as_a_full_ranking_after_three_deltas(spark, tmp_path, monkeypatch, small):
    if not small:
        monkeypatch.setattr("holdfast.sources.rank_table.BROADCAST_VALUES", 0)
    rng = random.Random(4)
    draw = lambda n: [rng.choice([None, 7, rng.randint(-200, 200), rng.randint(0, 5)]) for _ in range(n)]
    table = RankTable(spark, str(tmp_path), "x", T.LongType(), per_range=12)
    have = draw(300)
    frame = lambda values, kind="i long, x long": spark.createDataFrame([*enumerate(values)], kind)
    table.apply(frame(have), 0)
    assert len(table.table.current().entries) > 4
    for batch in (1, 2, 3):
        gone = rng.sample(range(len(have)), 80)
        new = draw(120)
        changes = spark.createDataFrame([(have[i], -1) for i in gone] + [(v, 1) for v in new], "x long, sign int")
        table.apply(changes, batch, "sign")
        assert table.apply(changes, batch, "sign") == 0  # the same batch again
        have = [v for i, v in enumerate(have) if i not in set(gone)] + new
    assert ranked(frame(have), table) == ranked(frame(have))
    bounds = table.read().groupBy("range").agg(F.min("value").alias("a"), F.max("value").alias("b")).orderBy("a").collect()
    assert all(x.b < y.a for x, y in zip(bounds, bounds[1:]) if x.b is not None)


def test_other_ranges_keep_their_files(spark, tmp_path):
    table = RankTable(spark, str(tmp_path), "x", T.StringType(), per_range=10)
    frame = spark.range(100).select(F.format_string("%03d", "id").alias("x"))
    table.apply(frame)
    before = set(table.table.current().entries)
    assert table.apply(frame.where("x = '005'")) == 1
    assert len(before - set(table.table.current().entries)) == 1
    # A range that grows is cut, between those that stay.
    table.apply(spark.range(100).select(F.format_string("050-%d", "id").alias("x")))
    assert len(table.table.current().entries) > len(before) + 5
    both = frame.unionByName(frame.where("x = '005'")).unionByName(
        spark.range(100).select(F.format_string("050-%d", "id").alias("x"))).withColumn("i", F.lit(0))
    assert ranked(both, table) == ranked(both)


def test_edges(spark, tmp_path):
    table = RankTable(spark, str(tmp_path), "x", T.LongType())
    none = spark.createDataFrame([], "i long, x long")
    assert table.apply(none) == 0 and ranked(none, table) == []
    nulls = spark.createDataFrame([(1, None), (2, None)], "i long, x long")
    table.apply(nulls)
    assert ranked(nulls, table) == ranked(nulls)
    with pytest.raises(NegativeCount):
        table.apply(spark.createDataFrame([(1, -1)], "x long, sign int"), sign="sign")
    table.apply(nulls.withColumn("sign", F.lit(-1)), sign="sign")
    assert table.read().count() == 0

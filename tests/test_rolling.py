"""Trailing sums of long series against the plain window."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from holdfast.operators.rolling import long_trailing


def plain(frame, column, rows, order, series):
    window = W.partitionBy(*series).orderBy(order).rowsBetween(-(rows - 1), 0)
    return frame.withColumn("out", F.sum(column).over(window))


def same(left, right):
    return sorted(map(str, left.collect())) == sorted(map(str, right.select(left.columns).collect()))


@pytest.mark.parametrize("rows", [1, 2, 7, 40])
@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_same_as_the_window(spark, rows, ranges):
    rng = random.Random(rows * ranges)
    values = [(s, i, rng.choice([None, rng.randint(-9, 9)])) for s, n in (("a", 300), ("b", 5), (None, 60), ("c", 1))
              for i in rng.sample([*range(1_000), None], n)]
    frame = spark.createDataFrame(values, "s string, i int, x int").withColumn("_range", F.lit("own"))
    assert same(long_trailing(frame, {"x": "out"}, rows, "i", ["s"], ranges), plain(frame, "x", rows, "i", ["s"]))


def test_edges(spark):
    empty = spark.createDataFrame([], "i int, x int")
    assert long_trailing(empty, {"x": "out"}, 3, "i").count() == 0
    with pytest.raises(ValueError):
        long_trailing(empty, {"x": "out"}, 0, "i")


def test_one_long_series_in_many_tasks(spark):
    frame = spark.range(10_000_000).select(F.col("id").alias("i"), (F.col("id") % 7).alias("x"))
    out = long_trailing(frame, {"x": "out"}, 14, "i", ranges=16)
    per_task = out.groupBy(F.spark_partition_id().alias("t")).count().collect()
    assert sum(r["count"] for r in per_task) == 10_000_000
    assert max(r["count"] for r in per_task) < 10_000_000 / 3
    assert out.where((F.col("i") >= 13) & (F.col("out") != 42)).count() == 0
    assert out.where("i < 13").agg(F.sum("out")).first()[0] == sum(sum(k % 7 for k in range(i + 1)) for i in range(13))

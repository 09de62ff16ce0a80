import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from holdfast.functions.choice import first_match, lookup, order_in
from holdfast.functions.rates import count_true, exact_mean, exact_sum, rate, ratio, share_pct
from holdfast.operators.rolling import fill_days, rolling_rate
from holdfast.registry.sql import half_up


@pytest.mark.parametrize("places", [1, 3, 4])
def test_every_ratio_rounds_as_the_checking_sql_does(spark, tmp_path, places):
    """All k/n with n up to 1000: the two engines' own ROUND differ on some of them."""
    pairs = spark.range(1, 1001).withColumnRenamed("id", "n").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    path = str(tmp_path / "ratios")
    pairs.select("k", "n", F.round(ratio(F.col("k"), F.col("n")), places).alias("r")).write.parquet(path)
    quotient = "(CAST(k AS DOUBLE) / CAST(n AS DOUBLE))"
    differ = duckdb.sql(f"SELECT COUNT(*) FROM '{path}/*.parquet' WHERE r <> {half_up(quotient, places)}").fetchall()
    assert differ == [(0,)]


def test_zero_denominators(spark):
    row = spark.range(1).select(
        rate(F.lit(1), F.lit(0)), share_pct(F.lit(1), F.lit(0)), rate(F.lit(1), F.lit(3))
    ).first()
    assert tuple(row) == (None, None, 0.3333)


def test_sums_do_not_depend_on_the_order(spark):
    values = [0.1, 0.2, 0.3, 1e9 + 0.01, -1e9] * 40
    for parts in (1, 3, 7):
        frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(parts)
        total, mean = frame.agg(exact_sum(F.col("v")), exact_mean(F.col("v"), 2)).first()
        assert total == 24.4 and mean == 24.4 / 200


def test_conditions_that_are_null_count_as_no(spark):
    frame = spark.createDataFrame([(True,), (None,), (False,)], "b boolean")
    assert frame.agg(count_true(F.col("b")), count_true(~F.col("b"))).first() == (1, 1)


def test_choices(spark):
    frame = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    rows = frame.select(
        lookup(F.col("k"), {"a": 1}), order_in(F.col("k"), ["x", "a"], 9), lookup(F.col("k"), {}),
        first_match([], F.lit("d")), first_match([(F.col("k") == "z", F.lit("last"))], F.lit("d")),
    ).collect()
    assert [tuple(r) for r in rows] == [(1, 1, None, "d", "d"), (None, 9, None, "d", "last"), (None, 9, None, "d", "d")]


def test_rolling_rate_per_series_and_filled_days(spark):
    frame = spark.createDataFrame(
        [("a", "2026-01-01", 1, 2), ("a", "2026-01-03", 1, 1), ("b", "2026-01-01", 0, 0), ("b", "2026-01-02", 1, 4)],
        "s string, d string, x int, n int",
    ).withColumn("d", F.col("d").cast("date"))
    got = {(r.s, r.d.day): r.rate for r in rolling_rate(frame, "d", "x", "n", 2, series=["s"]).collect()}
    assert got == {("a", 1): 0.5, ("a", 3): 0.6667, ("b", 1): None, ("b", 2): 0.25}
    days = fill_days(frame.where("s = 'a'").drop("s"), "d", ["x", "n"]).orderBy("d").collect()
    assert [(r.d.day, r.x, r.n) for r in days] == [(1, 1, 2), (2, 0, 0), (3, 1, 1)]

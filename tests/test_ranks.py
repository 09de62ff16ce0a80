import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from holdfast.operators import ranks


def _frame(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, v {kind}")


def _values(shape):
    rng = random.Random(7)
    return {
        "plain": [rng.uniform(-5, 5) for _ in range(400)],
        "one value": [1.5] * 60,
        "hot value": [3.25] * 150 + [rng.uniform(0, 6) for _ in range(300)],
        "with nulls": [None, None] + [float(rng.randint(0, 9)) for _ in range(80)],
        "empty": [],
    }[shape]


SHAPES = ["plain", "one value", "hot value", "with nulls", "empty"]


@pytest.fixture(params=["broadcast", "sliced"])
def path(request, monkeypatch):
    if request.param == "sliced":  # force the way for value tables that one task cannot hold
        monkeypatch.setattr(ranks, "BROADCAST_VALUES", 3)
        monkeypatch.setattr(ranks, "VALUES_PER_SLICE", 20)
        monkeypatch.setattr(ranks, "HOT_SHARE", 20)
    return request.param


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("ascending", [True, False])
def test_global_rank(spark, path, shape, ascending):
    values = _values(shape)
    got = {r.id: r["rank"] for r in ranks.global_rank(_frame(spark, values), "v", ascending=ascending).collect()}
    direction = "ASC" if ascending else "DESC"
    _frame(spark, values).createOrReplaceTempView("ranked_values")
    want = {r.id: r.k for r in spark.sql(f"SELECT id, RANK() OVER (ORDER BY v {direction}) k FROM ranked_values").collect()}
    assert got == want


@pytest.mark.parametrize("shape", SHAPES)
def test_rank_pct_is_the_mean_rank(spark, path, shape):
    values = _values(shape)
    got = {r.id: r.pct for r in ranks.rank_pct(_frame(spark, values), "v").collect()}
    want = pd.Series(values, dtype=float).rank(pct=True)
    assert len(got) == len(values)
    for i, p in want.items():
        assert (got[i] is None) if pd.isna(p) else got[i] == pytest.approx(p, abs=1e-12)


@pytest.mark.parametrize("kind", ["string", "date", "bigint", "decimal(20,3)", "timestamp"])
@pytest.mark.parametrize("ascending", [True, False])
def test_every_type_ranks_alike(spark, path, kind, ascending):
    rng = random.Random(3)
    codes = [None if rng.random() < 0.4 else rng.randint(0, 90) for _ in range(300)]
    text = {"string": "concat('AGT-', lpad(v, 4, '0'))", "date": "date_add(date '2024-01-01', v)", "timestamp": "timestamp_seconds(v)"}
    frame = _frame(spark, codes, "int").selectExpr("id", f"{text.get(kind, f'CAST(v AS {kind})')} AS v")
    got = {r.id: r["rank"] for r in ranks.global_rank(frame, "v", ascending=ascending).collect()}
    frame.createOrReplaceTempView("typed_values")
    direction = "ASC" if ascending else "DESC"
    assert got == {r.id: r.k for r in spark.sql(f"SELECT id, RANK() OVER (ORDER BY v {direction}) k FROM typed_values").collect()}


def test_a_broken_domain_bound_is_an_error(spark):
    frame = _frame(spark, _values("plain"))
    with pytest.raises(Exception, match="promised"):
        ranks.global_rank(frame, "v", domain_bound=5).collect()


def test_domain_bound_gives_the_same(spark):
    frame = _frame(spark, [round(v, 1) for v in _values("hot value")])
    a = sorted(map(tuple, ranks.rank_pct(frame, "v").collect()))
    b = sorted(map(tuple, ranks.rank_pct(frame, "v", domain_bound=100).collect()))
    assert a == b


@pytest.mark.parametrize("shape", SHAPES)
def test_positions_are_distinct_and_ordered(spark, path, shape):
    frame = _frame(spark, _values(shape))
    placed = ranks.global_position(frame, "v", "id", spread_digits=1).orderBy("position").collect()
    assert [r.position for r in placed] == list(range(len(placed)))
    ordered = sorted((r.v for r in placed if r.v is not None), reverse=True)
    assert [r.v for r in placed] == ordered + [None] * (len(placed) - len(ordered))
    assert len(placed) == len(_values(shape))


@pytest.mark.parametrize("k", [1, 3, 2000])
def test_topk_per_key(spark, k):
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", rng.randint(0, 40), i) for i in range(9000)]
    frame = spark.createDataFrame(rows, "key string, v int, id int").repartition(16)
    got = ranks.topk_per_key(frame, ["key"], [F.desc("v"), F.asc("id")], k)
    want = []
    for key in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))[:k]
        want += [(*r, i + 1) for i, r in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_topk_cuts_before_the_exchange(spark):
    frame = spark.range(1000).select((F.col("id") % 3).alias("key"), "id")
    plan = ranks.topk_per_key(frame, ["key"], [F.asc("id")], 5)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_long_texts_are_not_broadcast(spark, monkeypatch):
    frame = spark.createDataFrame([(f"{i % 70:04d}" + "x" * 500,) for i in range(300)] + [(None,)] * 9, "v string")
    small = sorted((r.v or "", r["rank"]) for r in ranks.global_rank(frame, "v").collect())
    monkeypatch.setattr(ranks, "BROADCAST_BYTES", 10_000)
    assert not ranks.value_table(frame, "v").small
    assert sorted((r.v or "", r["rank"]) for r in ranks.global_rank(frame, "v").collect()) == small

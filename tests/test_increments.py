"""Marts and tables that are kept up by increments: what is read, what is rewritten, and what a crash leaves."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from holdfast import schemas
from holdfast.plans import refresh
from holdfast.plans.fact_store import FactStore
from holdfast.plans.marts import call_fact
from holdfast.sources import landing
from holdfast.sources.manifest import Entry, ManifestTable
from holdfast.streaming.partials import Partials

DIMS = ("customer_profiles", "agents", "competitor_intel", "retention_offers")


def frame(spark, name, rows):
    fields = schemas.SOURCES[name].fields
    return spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], schemas.SOURCES[name])


def customers(n, **changed):
    return [{"customer_id": f"C{i}", "market": changed.get(f"C{i}", "Austin"), "plan_type": "P", "tenure_months": i, "monthly_spend": 1.5 * i}
            for i in range(n)]


def call(i, customer, **more):
    return {"call_id": f"K{i}", "customer_id": customer, "agent_id": f"A{i % 3}", "call_date": f"2026-05-{i % 28 + 1:02d}",
            "handle_time_min": 1.25 * (i % 9), "competitor_mentioned": i % 2 == 0, "competitor_id": "COMP-01" if i % 2 == 0 else None,
            "call_topic": ["Billing Dispute", "Moving / Relocation", None][i % 3], "offer_presented_id": f"O{i % 2}",
            "offer_accepted": i % 4 == 0, "outcome": ["Saved", "Churned", "Pending"][i % 3]} | more


@pytest.fixture
def dims(spark):
    return {
        "customer_profiles": frame(spark, "customer_profiles", customers(40)),
        "agents": frame(spark, "agents", [{"agent_id": f"A{i}", "agent_name": f"Agent {i}", "team": "T", "tier": "On Target"} for i in range(3)]),
        "competitor_intel": frame(spark, "competitor_intel", [{"competitor_id": "COMP-01", "competitor_name": "North"}]),
        "retention_offers": frame(spark, "retention_offers", [{"offer_id": f"O{i}", "offer_name": f"Offer {i}"} for i in range(2)]),
    }


def same(one, two):
    assert one.columns == two.columns
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def spoil(root, entries):
    """Make files of some folders unreadable; returns their contents."""
    kept = {}
    for entry in entries:
        for file in Path(root, "calls/data", entry.folder).glob("*.parquet"):
            kept[file] = file.read_bytes()
            file.write_bytes(b"spoilt")
            file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    return kept


def test_a_refresh_touches_only_folders_of_changed_rows(spark, tmp_path, dims):
    root = str(tmp_path)
    store = FactStore(spark, root, buckets=16)
    rows = [call(i, f"C{i % 40}") for i in range(200)]
    first, second = frame(spark, "call_interactions", rows[:150]), frame(spark, "call_interactions", rows[150:])
    assert store.propagate(dims) == 0
    store.append(first, dims, 0)
    before = store.table.current()
    changed = dims | {"customer_profiles": frame(spark, "customer_profiles", customers(40, C3="Dallas"))}
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit("C3")), F.lit(16))).first()[0]
    untouched = [e for e in before.entries if e.bucket != bucket]
    kept = spoil(root, untouched)
    assert len(kept) >= 10
    # Reading any other folder would fail now.
    assert store.propagate(changed) == 1
    store.append(second, changed, 1)
    now = store.table.current()
    assert set(untouched) <= set(now.entries) and not {e for e in before.entries if e.bucket == bucket} & set(now.entries)
    for file, content in kept.items():
        file.write_bytes(content)
    same(store.read(), call_fact(frame(spark, "call_interactions", rows), *(changed[n] for n in DIMS)))
    assert store.propagate(changed) == 0
    store.append(second, changed, 1)  # a retried batch
    assert store.read().count() == 200 and store.table.current() == now
    # An agent has calls everywhere, an unknown offer nowhere.
    changed["agents"] = changed["agents"].withColumn("tier", F.lit("At Risk"))
    changed["retention_offers"] = changed["retention_offers"].unionByName(frame(spark, "retention_offers", [{"offer_id": "O9"}]))
    assert store.propagate(changed) == len(now.entries)
    same(store.read(), call_fact(frame(spark, "call_interactions", rows), *(changed[n] for n in DIMS)))


def test_calls_that_come_again_are_replaced(spark, tmp_path, dims):
    store = FactStore(spark, str(tmp_path), buckets=8, fanout=3)
    current = {}
    rng = random.Random(4)
    store.propagate(dims)
    for batch in range(7):
        rows = [call(rng.randrange(80), f"C{rng.randrange(45)}", outcome=f"batch {batch}") for _ in range(25)]
        rows = list({r["call_id"]: r for r in rows}.values())
        if batch == 3:
            rows.append(call(0, None, call_id=None, outcome="no key"))
        current |= {r["call_id"]: r for r in rows}
        store.append(frame(spark, "call_interactions", rows), dims, batch, "call_id")
    same(store.read(), call_fact(frame(spark, "call_interactions", list(current.values())), *(dims[n] for n in DIMS)))
    assert max(sum(e.bucket == b and e.level == level for e in store.table.current().entries)
               for b in range(8) for level in range(4)) < 3


def land(spark, store, dims, rows):
    for name in dims or ():
        landing.land_increment(dims[name], store.landing(name))
    landing.land_increment(frame(spark, "call_interactions", rows), store.landing("call_interactions"))


def test_corrected_and_repeated_drops_give_the_marts_of_a_rebuild(spark, tmp_path, dims):
    kept_up, keys = refresh.Store(str(tmp_path / "kept")), {"call_interactions": "call_id", "customer_profiles": "customer_id"}
    dims["service_events"] = frame(spark, "service_events", [{"event_id": "S", "customer_id": "C1"}])
    rows = [call(i, f"C{i % 40}") for i in range(60)]
    fixed = [call(i, f"C{(i + 1) % 40}", outcome="Saved", call_topic="Moving / Relocation", call_date="2026-06-09") for i in range(0, 60, 7)]
    drops = [rows[:40], rows[30:], fixed + rows[1:3]]
    for i, drop in enumerate(drops):
        land(spark, kept_up, dims if i == 0 else None, drop)
        if i == 1:
            landing.land_increment(frame(spark, "customer_profiles", customers(5, C2="Reno")), kept_up.landing("customer_profiles"))
        got = refresh.refresh_marts(spark, kept_up, f"v{i}", incremental=True, unique_key=keys, fact_buckets=4)
        want = refresh.refresh_marts(spark, kept_up, f"full{i}", unique_key=keys)
        for name in want:
            same(got[name], want[name])


def counts(spark, rows):
    return spark.createDataFrame(rows, "k string, n long")


def test_fifty_batches_leave_few_folders(spark, tmp_path):
    partials = Partials(spark, str(tmp_path), ["k"], counts(spark, []), fanout=4)
    total = {}
    rng = random.Random(1)
    for batch in range(50):
        rows = [(k, rng.randrange(-3, 5)) for k in rng.sample("abcdef", 3)]
        for k, n in rows:
            total[k] = total.get(k, 0) + n
        partials.add(counts(spark, rows).coalesce(1), batch)
        if batch % 9 == 0:
            partials.add(counts(spark, rows), batch)  # a retried batch
            assert partials.has(batch) and not partials.has(batch + 1)
    read = partials.read()
    assert {r.k: r.n for r in read.groupBy("k").agg(F.sum("n").alias("n")).collect()} == total
    assert len(partials.table.current().entries) <= 9 and len(read.inputFiles()) <= 9
    before = sorted(map(tuple, partials.summed(read).collect()))
    assert partials.table.vacuum(keep=1) > 0 and len(list((tmp_path / "data").iterdir())) <= 9
    assert sorted(map(tuple, partials.summed(partials.read()).collect())) == before


def test_a_crash_between_write_and_swap(spark, tmp_path, monkeypatch):
    partials = Partials(spark, str(tmp_path), ["k"], counts(spark, []), fanout=3)
    commit, left = ManifestTable.commit, []

    def failing(self, entries, batch):
        if left:
            left.pop()
            raise RuntimeError("gone")
        return commit(self, entries, batch)

    monkeypatch.setattr(ManifestTable, "commit", failing)
    read = lambda: {r.k: r.n for r in partials.read().groupBy("k").agg(F.sum("n").alias("n")).collect()}
    for batch in range(6):
        left.append(1)
        known = read()
        with pytest.raises(RuntimeError):  # the folder is there, the manifest is not
            partials.add(counts(spark, [("a", 1), ("b", batch)]), batch)
        assert read() == known and not partials.has(batch)
        partials.add(counts(spark, [("a", 1), ("b", batch)]), batch)
        assert read() == {"a": batch + 1, "b": sum(range(batch + 1))}
    # A manifest that was cut short does not count, and its number is not used again.
    whole = (tmp_path / "manifest" / f"{partials.table.current().number:012d}").read_text()
    (tmp_path / "manifest" / f"{partials.table.current().number + 1:012d}").write_text(whole[: len(whole) // 2])
    partials.add(counts(spark, [("a", 1)]), 6)
    assert read()["a"] == 7
    # A merge that fails after the batch was taken in is made up for by the next one.
    merge = ManifestTable.mergeable
    monkeypatch.setattr(ManifestTable, "mergeable", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
    with pytest.raises(RuntimeError):
        partials.add(counts(spark, [("a", 1)]), 7)
    monkeypatch.setattr(ManifestTable, "mergeable", merge)
    partials.add(counts(spark, [("a", 1)]), 7)
    partials.add(counts(spark, [("a", 1)]), 8)
    assert read()["a"] == 9


def test_an_empty_table(spark, tmp_path):
    table = ManifestTable(spark, str(tmp_path / "t"))
    assert table.current().entries == () and table.current().batch == -1
    assert table.commit([Entry("x")], 3).batch == 3 and table.current().entries == (Entry("x"),)
    assert Partials(spark, str(tmp_path / "p"), ["k"], counts(spark, [])).read().count() == 0


def many_calls(spark, start, stop, outcome, step=1):
    """Calls of a table of 40 customers and 3 agents, in a single file a folder."""
    n = F.col("id").cast("string")
    values = {"call_id": F.concat(F.lit("K"), n), "customer_id": F.concat(F.lit("C"), (F.col("id") % 40).cast("string")),
              "agent_id": F.concat(F.lit("A"), (F.col("id") % 3).cast("string")), "outcome": F.lit(outcome)}
    fields = schemas.SOURCES["call_interactions"].fields
    return spark.range(start, stop, step, 1).select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


@pytest.mark.parametrize("broadcast", [1 << 28, -1])
def test_replaced_calls_are_found_by_their_place(spark, tmp_path, dims, monkeypatch, broadcast):
    """Rows of several blocks of a file; whole calls are exchanged neither to find nor to keep them."""
    monkeypatch.setattr("holdfast.plans.fact_store.MARK_BYTES", broadcast)
    store = FactStore(spark, str(tmp_path), buckets=1)
    store.append(many_calls(spark, 0, 80_000, "Pending"), dims, 0, "call_id")
    again = many_calls(spark, 7, 90_007, "Saved", 1_009)
    marks = store.marks(again, "call_id")
    assert marks.count() == 3 and len(store.table.current().entries) == 1
    wide, in_place = store._with_marks(store.table.current().entries, marks)
    if broadcast > 0:
        wide.count()
        assert in_place and "ShuffleExchange" not in wide._jdf.queryExecution().executedPlan().toString().replace("ENSURE", "")
    back = store.replaced(again, "call_id", marks)
    assert back.count() == 80 and {r.outcome for r in back.collect()} == {"Pending"}
    store.append(again, dims, 1, "call_id", marks)
    kept = store.read()
    assert kept.count() == 80_010 and kept.where("outcome = 'Saved'").count() == 90
    assert kept.select("call_id").distinct().count() == 80_010


def test_offers_are_joined_before_the_columns_of_customers(spark, dims):
    """Where neither is broadcast, the second exchange of the calls carries one more column than the first."""
    fact = call_fact(frame(spark, "call_interactions", [call(i, f"C{i}") for i in range(9)]), *(dims[n] for n in DIMS))
    joins = [line for line in fact._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in line]
    assert len(joins) == 4 and "offer_presented_id" in joins[3] and "customer_id" in joins[2]


def test_calls_that_come_again_unchanged_stay_where_they_are(spark, tmp_path, dims):
    """Only changed and new calls are counted, joined and written; a value that moves to another column is a change."""
    from holdfast.session import materialize
    from holdfast.streaming.mart_counts import mart_partials

    store = FactStore(spark, str(tmp_path / "facts"), buckets=4)
    partials = mart_partials(spark, str(tmp_path / "counts"), schemas.SOURCES["call_interactions"], ())
    rows = {f"K{i}": call(i, f"C{i % 40}", mention_text="x", call_topic=None) for i in range(60)}
    first = materialize(frame(spark, "call_interactions", list(rows.values())), "first")
    store.propagate(dims)
    refresh.add_calls(store, partials, first, dims, 0, "call_id", ())
    before = store.table.current().entries
    refresh.add_calls(store, partials, first.where("call_id <> 'K9'"), dims, 1, "call_id", ())
    assert store.table.current().entries == before and store.table.current().batch == 1
    assert partials.read().where("batch_id = 1").count() == 0
    more = [rows["K1"], rows["K2"] | {"mention_text": None, "call_topic": "x"}, rows["K3"] | {"outcome": "Saved!"}, call(99, "C1"),
            call(0, None, call_id=None)]
    again = materialize(frame(spark, "call_interactions", more), "again")
    fresh, _ = store.changed(again, "call_id")
    assert sorted(str(r.call_id) for r in fresh.collect()) == ["K2", "K3", "K99", "None"]
    for batch in (2, 3):
        refresh.add_calls(store, partials, again, dims, batch, "call_id", ())
    rows |= {r["call_id"]: r for r in more}
    same(store.read(), call_fact(frame(spark, "call_interactions", list(rows.values())), *(dims[n] for n in DIMS)))
    counted = partials.read().where("grain = 'topics'").groupBy("call_topic").agg(F.sum("total_calls").alias("n")).where("n <> 0")
    assert {r.call_topic: r.n for r in counted.collect()} == {None: 59, "x": 1, "Billing Dispute": 2}


def test_large_batches_are_not_exchanged_once_more(spark, tmp_path, dims, monkeypatch):
    store = FactStore(spark, str(tmp_path), buckets=4)
    asked = []
    write = store.table.write
    monkeypatch.setattr(store.table, "write", lambda *a: asked.append(a[5]) or write(*a))
    rows = frame(spark, "call_interactions", [call(i, f"C{i}") for i in range(20)])
    store.append(rows, dims, 0, size=1 << 30)
    store.append(rows, dims, 1, size=1 << 10)
    assert asked == [True, False] and store.read().count() == 40
    assert {e.bucket for e in store.table.current().entries} <= set(range(4))


def test_distinct_calls_need_no_exchange_of_their_own(spark, tmp_path):
    """Equal lines are one call, different calls of one line stay apart."""
    from datetime import datetime

    from holdfast.sources import star_tables as star

    def line(number, quantity, part=1):
        return (1, part, 2, number, quantity, 1.0, 0.06, 0.01, "R", "O", datetime(1998, 1, 1))

    line_fields = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"
    rows = [line(1, 5.0), line(1, 5.0), line(1, 6.0), line(2, 5.0), line(None, 5.0), line(None, 5.0), line(None, None)]
    schema = star.SCHEMAS["lineitem"]
    assert [f.split()[0] for f in schema.split(", ")] == line_fields.split()
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7, "O", 1.0, datetime(1998, 1, 1), "1-URGENT")], star.SCHEMAS["orders"]).write.parquet(
        f"{tmp_path}/orders.parquet")
    calls = star.distinct_calls(spark, str(tmp_path))
    assert sorted((r.call_id, r.handle_time_min) for r in calls.collect()) == [
        ("CALL-1", None), ("CALL-1-1", 5.0), ("CALL-1-1/2", 6.0), ("CALL-1-2", 5.0), ("CALL-1/2", 5.0)]
    joined = star.calls(spark, str(tmp_path))
    exchanges = lambda f: f._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        assert exchanges(star.distinct_calls(spark, str(tmp_path))) == exchanges(star.calls(spark, str(tmp_path))) == 2
    finally:
        spark.conf.set(name, before)
    assert joined.count() == 7

"""Schema versions found from the drops."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.sources.schema_log import SchemaLog, found_fields, merged, wider
from holdfast.streaming.evolving import EvolvingTable


@pytest.fixture
def source(spark, tmp_path):
    (tmp_path / "landing").mkdir()
    table = EvolvingTable(spark, str(tmp_path / "table"))

    def drop(name, *rows):
        lines = [r if isinstance(r, str) else json.dumps(r) for r in rows]
        (tmp_path / "landing" / f"{name}.json").write_text("\n".join(lines) + "\n")
        return table.ingest(str(tmp_path / "landing"))

    return table, drop


def names(table):
    return {f.name: f.dataType.simpleString() for f in table.log.current()[1].fields}


def test_new_and_widened_fields_land_without_a_change(source):
    table, drop = source
    drop("a", {"k": 1, "v": 1}, {"k": 2, "v": None})
    assert names(table) == {"k": "bigint", "v": "bigint"}
    drop("b", {"k": 3, "v": 2.5, "w": True}, {"k": 4})
    assert names(table) == {"k": "bigint", "v": "double", "w": "boolean"}
    drop("c", {"k": 5, "w": "maybe", "n": {"x": [1, 2]}})
    assert names(table) == {"k": "bigint", "v": "double", "w": "string", "n": "string"}
    found = {r.k: (r.v, r.w, r.n, r._schema_version) for r in table.read().collect()}
    assert found == {1: (1.0, None, None, 1), 2: (None, None, None, 1), 3: (2.5, "true", None, 2), 4: (None, None, None, 2),
                     5: (None, "maybe", '{"x":[1,2]}', 3)}
    assert len(table.log.versions()) == 3
    assert {r.k: r.v for r in table.read(1).collect()} == {1: 1, 2: None, 3: 2, 4: None, 5: None}
    assert drop("c", {"k": 5}).count() == 5  # a file of that name was read


def test_what_no_version_can_place(source):
    table, drop = source
    rows = drop("a", {"k": 1, "K": 2, "_extra": 3}, "no json", "[1]", "", {"k": None, "z": None}).orderBy("k", "_corrupt_record")
    assert names(table) in ({"k": "bigint"}, {"K": "bigint"})
    assert rows.count() == 5 and rows.where("_corrupt_record = 'no json'").count() == 1
    assert rows.where("map_contains_key(_extra, '_extra')").count() == 1


def test_names_of_any_form(source):
    table, drop = source
    drop("a", {"a.b": 1, "c`d": "x", "e f": 2, "value": 1})
    drop("b", {"a.b": 1.5})
    assert names(table) == {"a.b": "double", "c`d": "string", "e f": "bigint", "value": "bigint"}
    assert sorted(r[0] for r in table.read().select("`a.b`").collect()) == [1.0, 1.5]


def test_a_batch_that_is_tried_again_counts_once(spark, source):
    table, drop = source
    drop("a", {"k": 1})
    number, schema = table.log.current()
    again = spark.createDataFrame([('{"k": 1}', "f")], "value string, _source_file string").withColumn(
        "_ingested_at", F.current_timestamp())
    table._append(again, table.table.current().batch, number, schema)
    assert table.read().count() == 1


def test_another_failure_is_raised(source, monkeypatch):
    table, drop = source
    monkeypatch.setattr(table.table, "commit", lambda *_: 1 / 0)
    with pytest.raises(Exception, match="division"):
        drop("a", {"k": 1})


def test_types(spark, tmp_path):
    long, double, text = T.LongType(), T.DoubleType(), T.StringType()
    assert wider(long, double) == double and wider(double, long) == double and wider(long, T.BooleanType()) == text
    assert wider(T.DateType(), text) == T.DateType() and wider(None, long) == long
    lines = spark.createDataFrame([('{"a":1,"b":[1]}',), ('{"a":12345678901234567890}',), ("{",), (None,)], "value string")
    assert found_fields(lines) == {"a": double, "b": text}
    schema = merged(T.StructType([T.StructField("A", long)]), {"a": double, "b": text})
    assert schema.fieldNames() == ["A", "b"]
    log = SchemaLog(spark, str(tmp_path))
    assert log.current() == (0, T.StructType([])) and log.add(schema) == 1 and log.add(schema) == 1

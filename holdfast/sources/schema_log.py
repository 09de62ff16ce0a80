"""Schemas of a landed source by version, found from the drops themselves."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.sources.evolve import CORRUPT
from holdfast.sources.manifest import VersionFiles

#: Fields that a source may have; more are taken for data that stands in the names.
MAX_FIELDS = 10_000
#: Columns of a kept table that no field may take.
RESERVED = frozenset({CORRUPT, "_extra", "_source_file", "_ingested_at", "_line", "_schema_version"})
# Numbers by width; a field with values of several kinds becomes text.
_WIDTH = {T.ByteType(): 0, T.ShortType(): 1, T.IntegerType(): 2, T.LongType(): 3, T.FloatType(): 4, T.DoubleType(): 5}
_PLAIN = (T.StringType(), T.BooleanType(), *_WIDTH)


def wider(old: T.DataType | None, new: T.DataType) -> T.DataType:
    """The type that has the values of both; a nested or calendar type stays as declared."""
    if old is None or old == new:
        return new
    if old not in _PLAIN:
        return old
    if old in _WIDTH and new in _WIDTH:
        return max(old, new, key=_WIDTH.__getitem__)
    return T.StringType()


def quoted(name: str) -> Column:
    """A column by its exact name."""
    return F.col("`" + name.replace("`", "``") + "`")


def found_fields(lines: DataFrame, value: str = "value") -> dict[str, T.DataType]:
    """Fields of JSON lines and the types of their values, by one aggregation over names and kinds.

    Nested values count as text, and lines that are not JSON, or no object, have no fields.  A field that is NULL
    throughout is not found: nothing says what it is.
    """
    parsed = lines.select(F.try_parse_json(F.col(value)).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    fields = parsed.lateralJoin(
        parsed.sparkSession.tvf.variant_explode(F.col("v").outer()).select("key", "value")).select("key", F.schema_of_variant("value").alias("kind"))
    kind = F.when(F.col("kind") == "BIGINT", "long").when(F.col("kind") == "BOOLEAN", "boolean").when(
        F.col("kind").rlike("^(DECIMAL|DOUBLE|FLOAT)"), "double").otherwise("string")
    pairs = fields.where("kind <> 'VOID'").select("key", kind.alias("kind")).distinct().limit(4 * MAX_FIELDS + 1).collect()
    types = {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}
    out: dict[str, T.DataType] = {}
    for key, name in sorted(map(tuple, pairs)):
        out[key] = wider(out.get(key), types[name])
    if len(out) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} fields")
    return out


def merged(schema: T.StructType, found: dict[str, T.DataType]) -> T.StructType:
    """The schema with the new fields behind the old, by name, and with widened types.

    A name that differs from another in case only, or is one of the table's own, gets no column; it stays in ``_extra``.
    """
    fields = {f.name: wider(f.dataType, found.get(f.name, f.dataType)) for f in schema.fields}
    taken = {name.lower() for name in fields} | RESERVED
    for name in sorted(found):
        if name not in fields and name.lower() not in taken:
            fields[name] = found[name]
            taken.add(name.lower())
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


class SchemaLog(VersionFiles):
    """The versions of a source's schema below ``root``; a file per version, written once."""

    kind = "schemas"

    def versions(self) -> dict[int, T.StructType]:
        """All complete versions by number."""
        read = {n: self._lines(n) for n in self._numbers()}
        return {n: T.StructType.fromJson(json.loads(lines[0])) for n, lines in read.items() if lines}

    def current(self) -> tuple[int, T.StructType]:
        """The last version; number 0 without fields before the first."""
        return max(self.versions().items(), default=(0, T.StructType([])))

    def add(self, schema: T.StructType) -> int:
        """Make ``schema`` the current version, unless it is."""
        number, last = self.current()
        return number if number and last == schema else self._add([schema.json()])

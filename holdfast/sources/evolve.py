"""Reading drops whose fields change over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def parse_evolving(lines: DataFrame, schema: T.StructType, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Columns of the declared schema from JSON lines.

    A field that a drop leaves out is NULL.  A field that the schema does not know is
    kept in ``_extra`` until a later schema version names it.  A line that is not JSON
    goes to ``_corrupt_record`` as it was.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    record = F.from_json(F.col(value), with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    known = F.array(*[F.lit(name) for name in schema.fieldNames()])
    # The names are cheap to list; the line is parsed a second time only when one of them is new.
    unknown = F.size(F.array_except(F.json_object_keys(F.col(value)), known)) > 0
    everything = F.from_json(F.col(value), T.MapType(T.StringType(), T.StringType()))
    extra = F.when(unknown, F.map_filter(everything, lambda name, _: ~F.array_contains(known, name)))
    return lines.select(record.alias("_r"), _none_if_empty(extra).alias("_extra"), *(keep or [])).select(
        "_r.*", "_extra", *(keep or [])
    )


def _none_if_empty(entries: Column) -> Column:
    return F.when(F.size(entries) > 0, entries)


def evolve_schema(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Read all drops of a folder, old and new, in the current schema."""
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_path").alias("_source_file"))
    return parse_evolving(lines, schema, keep=["_source_file"])


def quarantine(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Rows that a mart cannot use in full: lines that are not JSON, and values that do not fit their type.

    ``types`` names text columns and the type they must convert to; ``_reason`` lists what is wrong.
    """
    found = [F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(f"{c} is no {t}")) for c, t in types.items()]
    if CORRUPT in df.columns:
        found.append(F.when(F.col(CORRUPT).isNotNull(), F.lit("not readable as JSON")))
    return df.withColumn("_reason", F.array_compact(F.array(*found))).where(F.size("_reason") > 0)


def promote_extra(df: DataFrame, new_fields: T.StructType) -> DataFrame:
    """Turn fields kept in ``_extra`` into columns once a schema version names them.

    Rows that were ingested under the new version have the column already; older rows get
    it from ``_extra``.
    """
    def column(field: T.StructField) -> Column:
        kept = F.try_element_at("_extra", F.lit(field.name)).try_cast(field.dataType)
        return F.coalesce(F.col(field.name), kept) if field.name in df.columns else kept

    columns = {field.name: column(field) for field in new_fields.fields}
    names = F.array(*[F.lit(f.name) for f in new_fields.fields])
    left = F.map_filter("_extra", lambda name, _: ~F.array_contains(names, name))
    return df.withColumns(columns).withColumn("_extra", _none_if_empty(left))

"""Ingestion under a schema that follows the drops.

A batch is written under the current version of the schema.  If lines of it have fields or
values that do not fit, what was written is given up, the schema log gets a new version and
the stream stops; it starts again at the same batch under the new version.  The table keeps
rows as they landed, in folders by schema version, and is read in the current one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.sources.evolve import parse_evolving
from holdfast.sources.manifest import ManifestTable
from holdfast.sources.schema_log import SchemaLog, found_fields, merged, quoted
from holdfast.streaming.ingest import bronze_schema, ingest_metadata


class SchemaChanged(Exception):
    """A batch needs a schema version that the stream was not started with."""


def _stored(schema: T.StructType) -> T.StructType:
    return T.StructType([*bronze_schema(schema).fields, T.StructField("_line", T.StringType())])


class EvolvingTable:
    """A bronze table below ``root`` with its schema log; one stream writes to it at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = SchemaLog(spark, self.root)
        self.table = ManifestTable(spark, self.root)

    def ingest(self, folder: str, max_bytes_per_batch: str | None = None) -> DataFrame:
        """Append the files that are new in ``folder`` and return the table; stops and restarts for new versions."""
        while True:
            before = self.log.current()[0]
            try:
                self._run(folder, max_bytes_per_batch)
                return self.read()
            except StreamingQueryException:
                if self.log.current()[0] == before:  # something else than a new version
                    raise

    def _run(self, folder: str, max_bytes_per_batch: str | None) -> None:
        reader = self.spark.readStream.schema("value string")
        if max_bytes_per_batch:
            reader = reader.option("maxBytesPerTrigger", max_bytes_per_batch)
        number, schema = self.log.current()
        query = (
            ingest_metadata(reader.text(folder)).writeStream
            .foreachBatch(lambda batch, batch_id: self._append(batch, batch_id, number, schema))
            .option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()

    def _append(self, lines: DataFrame, batch_id: int, number: int, schema: T.StructType) -> None:
        version = self.table.current()
        if batch_id <= version.batch:  # a batch tried again that the table has
            return
        if not number:  # nothing is known of the source yet
            self._change(schema, lines)
        # No field has the name of this column.
        rows = parse_evolving(lines.withColumnRenamed("value", "_line"), schema, "_line", ["_source_file", "_ingested_at", "_line"])
        # The line itself is kept only where it does not fit, to find out what it needs.
        misfit = F.when(F.col("_extra").isNotNull() | F.col("_corrupt_record").isNotNull(), F.col("_line"))
        rows = rows.withColumn("_line", misfit).select(*[quoted(f.name) for f in _stored(schema).fields])
        entries = [_with_bucket(e, number) for e in self.table.write(rows, 0, batch_id, batch_id)]
        misfits = self.table.read(entries, _stored(schema)).select("_line").where("_line IS NOT NULL")
        self._change(schema, misfits, "_line")
        self.table.commit([*version.entries, *entries], batch_id)

    def _change(self, schema: T.StructType, lines: DataFrame, value: str = "value") -> None:
        """Log a new version and stop, if the lines need one."""
        needed = merged(schema, found_fields(lines, value))
        if needed != schema:
            raise SchemaChanged(f"schema version {self.log.add(needed)}")

    def read(self, version: int | None = None) -> DataFrame:
        """All rows in the current (or an older) schema version, with ``_schema_version`` under which each landed.

        Fields that a row's own version does not know are NULL; in a version older than the row's, values that do not
        fit are NULL.  Numbers widened to text are written as Spark casts them.
        """
        versions = self.log.versions()
        wanted = versions[version] if version else self.log.current()[1]
        by_version: dict[int, list] = {}
        for entry in self.table.current().entries:
            by_version.setdefault(entry.bucket, []).append(entry)
        parts = [self._shown(entries, number, versions.get(number, T.StructType([])), wanted)
                 for number, entries in sorted(by_version.items())]
        empty = T.StructType([*bronze_schema(wanted).fields, T.StructField("_schema_version", T.IntegerType(), False)])
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], empty)

    def _shown(self, entries: list, number: int, own: T.StructType, wanted: T.StructType) -> DataFrame:
        names = set(own.fieldNames())
        columns = [
            (quoted(f.name).try_cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in wanted.fields
        ]
        kept = [f.name for f in bronze_schema(T.StructType([])).fields]
        rows = self.table.read(entries, _stored(own))
        return rows.select(*columns, *kept, F.lit(number).alias("_schema_version"))


def _with_bucket(entry, number: int):
    """The entry of a folder with rows of one schema version."""
    return type(entry)(entry.folder, number, entry.level, entry.first, entry.last)

"""A table with one row per key that takes in changes by rewriting only the folders they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions.rates import count_true, rows
from holdfast.session import materialize
from holdfast.sources.manifest import Entry, ManifestTable

BUCKETS = 64


class ConflictingChanges(ValueError):
    """A key has several changes in one batch."""


class KeyedTable:
    """Rows below ``root``, dealt out to folders by a hash of ``key``; ``schema`` has the key and the other columns."""

    def __init__(self, spark: SparkSession, root: str, key: str, schema: T.StructType, buckets: int = BUCKETS):
        self.table, self.key, self.schema, self.buckets = ManifestTable(spark, root), key, schema, buckets

    def _bucketed(self, frame: DataFrame) -> DataFrame:
        return frame.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)))

    def _write(self, frame: DataFrame, batch: int) -> list[Entry]:
        return self.table.write(self._bucketed(frame.select(*self.schema.fieldNames())), 0, batch, batch, "bucket")

    def read(self) -> DataFrame:
        return self.table.read(self.table.current().entries, self.schema)

    def load(self, frame: DataFrame) -> None:
        """Put ``frame`` in place of all rows."""
        version = self.table.current()
        self.table.replace(version, version.entries, self._write(frame, version.batch))

    def apply(self, changes: DataFrame, batch_id: int | None = None, change_type: str = "change_type") -> int:
        """Take in inserts, updates and deletes, as ``snapshot_diff`` gives them; returns how many folders were rewritten.

        Inserts and updates put their row in place of the one with the key, if there is one; deletes take it away.
        Folders without a changed key keep their files.  A key, NULL included, may have one change; several are an
        error, before anything is written.  A batch whose number the table contains is not taken in again.
        """
        version = self.table.current()
        if batch_id is not None and batch_id <= version.batch:
            return 0
        changes = materialize(self._bucketed(changes.select(*self.schema.fieldNames(), change_type)), "changes")
        repeated = changes.groupBy(self.key).agg(rows().alias("_n")).agg(count_true(F.col("_n") > 1)).first()[0]
        if repeated:
            raise ConflictingChanges(f"{repeated} keys have several changes")
        # At most one row per bucket.
        hit = {r[0] for r in changes.select("bucket").distinct().collect()}
        old = [e for e in version.entries if e.bucket in hit]
        changed = changes.select(F.col(self.key).alias("_changed"))
        left = self.table.read(old, self.schema).join(changed, F.col(self.key).eqNullSafe(F.col("_changed")), "left_anti")
        kept = changes.where(~F.col(change_type).eqNullSafe(F.lit("delete"))).select(*self.schema.fieldNames())
        new = self._write(left.unionByName(kept), version.batch if batch_id is None else batch_id)
        self.table.replace(version, old, new, batch_id)
        return len(hit)

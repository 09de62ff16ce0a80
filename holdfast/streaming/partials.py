"""Additive partial results of batches, merged level by level.

Every batch adds a folder; when a level has enough folders they are summed into one of the
next level, so that a reader opens a number of folders that grows with the logarithm of the
batches.  A batch that is already in the table is not added again, whatever it was merged
into, so a retried batch counts once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.sources.manifest import FANOUT, ManifestTable


class Partials:
    """Partial sums below ``root``: ``keys`` name the groups, all other columns of ``empty`` are added up."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], empty: DataFrame, fanout: int = FANOUT):
        self.table, self.keys, self.fanout = ManifestTable(spark, root), keys, fanout
        self.schema = empty.withColumn("batch_id", F.lit(0).cast("long")).schema
        self.sums = [c for c in empty.columns if c not in keys]

    def has(self, batch_id: int) -> bool:
        return batch_id <= self.table.current().batch

    def add(self, counts: DataFrame, batch_id: int) -> None:
        """Add a batch's partial sums; batches come in order of their numbers."""
        version = self.table.current()
        if batch_id <= version.batch:
            return
        rows = counts.withColumn("batch_id", F.lit(batch_id).cast("long"))
        version = self.table.replace(version, [], self.table.write(self._typed(rows), 0, batch_id, batch_id), batch_id)
        while full := self.table.mergeable(version, self.fanout):
            for group in full:
                merged = self.table.write(
                    self.summed(self.table.read(group, self.schema)), group[0].level + 1,
                    min(e.first for e in group), max(e.last for e in group))
                version = self.table.replace(version, group, merged)

    def _typed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])

    def summed(self, rows: DataFrame) -> DataFrame:
        """One row per group; groups whose sums are all zero, as after retractions, add nothing and go."""
        total = rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.sums], F.max("batch_id").alias("batch_id"))
        some = reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(0)) != 0 for c in self.sums])
        return self._typed(total.where(some))

    def read(self) -> DataFrame:
        """The partial sums of all batches, to be added up by the reader; ``batch_id`` is the last batch in a sum."""
        return self.table.read(self.table.current().entries, self.schema)


def negated(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The sums that take ``counts`` back."""
    return counts.select(*[F.col(c) if c in keys else (-F.col(c)).alias(c) for c in counts.columns])

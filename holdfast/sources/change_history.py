"""Validity history of a change feed, kept batch by batch.

The table holds every change with the change that follows it.  The last change of each key is
open and lies apart, one folder for each bucket of keys, so a batch reads the open rows of its
buckets, closes those that get a successor and adds the rest.  A change that arrives late falls
into a closed interval: that interval is split, and only the folder it lies in is rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.operators.history import BEFORE_IMAGES
from holdfast.session import materialize
from holdfast.sources.manifest import FANOUT, Entry, ManifestTable

BUCKETS = 64
#: Level of the folders of open rows, of which every bucket has one.
OPEN = -1


class ChangeHistory:
    """Changes below ``root``; the names are those of the feed's columns, ``values`` are shown in the history."""

    def __init__(
        self, spark: SparkSession, root: str, feed: T.StructType, key: str, sequence: str, at: str, change_type: str,
        values: list[str], buckets: int = BUCKETS, fanout: int = FANOUT, leave_out: tuple[str, ...] = BEFORE_IMAGES,
    ):
        self.table, self.buckets, self.fanout, self.leave_out = ManifestTable(spark, root), buckets, fanout, leave_out
        self.key, self.sequence, self.at, self.change_type, self.values = key, sequence, at, change_type, values
        self.columns = list(dict.fromkeys([key, sequence, at, change_type, *values]))
        own = [T.StructField(c, feed[c].dataType) for c in self.columns]
        self.schema = T.StructType([
            *own, T.StructField("next_sequence", feed[sequence].dataType), T.StructField("next_at", feed[at].dataType)])

    def read(self) -> DataFrame:
        """The history, as ``scd2_history`` gives it for all changes so far."""
        rows = self.table.read(self.table.current().entries, self.schema)
        return rows.where(~F.col(self.change_type).eqNullSafe(F.lit("delete"))).select(
            self.key, self.sequence, *self.values, F.col(self.at).alias("valid_from"), F.col("next_at").alias("valid_to"),
            F.col("next_sequence").isNull().alias("is_current"))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets))

    def _write(self, rows: DataFrame, level: int, first: int, last: int) -> list[Entry]:
        return self.table.write(rows.select(*self.schema.fieldNames()).withColumn("bucket", self._bucket()), level, first, last, "bucket")

    def _followed(self, rows: DataFrame, *group: str, last: Column | None = None) -> DataFrame:
        """Rows with the change that follows in their group; ``last`` is what follows the last one."""
        window = W.partitionBy(self.key, *group).orderBy(self.sequence)
        after = F.lead(F.struct(F.col(self.sequence).alias("s"), F.col(self.at).alias("a"))).over(window)
        rows = rows.withColumn("_after", after if last is None else F.coalesce(after, last))
        return rows.withColumns({"next_sequence": F.col("_after.s"), "next_at": F.col("_after.a")}).drop("_after")

    def add(self, feed: DataFrame, batch_id: int) -> None:
        """Take in a batch of changes, in any order and with any that came before.

        Of changes with equal key and sequence one counts, whichever batch has it first; rows without a sequence, and
        before-images, are not looked at.  NULL is a key like others.  A batch that the table contains is not taken
        in again.
        """
        version = self.table.current()
        if batch_id <= version.batch:
            return
        feed = feed.select(*self.columns).where(F.col(self.sequence).isNotNull())
        if self.leave_out:
            feed = feed.where(~F.coalesce(F.col(self.change_type).isin(*self.leave_out), F.lit(False)))
        changes = materialize(feed.dropDuplicates([self.key, self.sequence]), "changes")
        # At most one row per bucket.
        hit = {r[0] for r in changes.select(self._bucket()).distinct().collect()}
        here = [e for e in version.entries if e.bucket in hit]
        old_open, old_closed = [e for e in here if e.level == OPEN], [e for e in here if e.level != OPEN]
        opened = self.table.read(old_open, self.schema)
        known = opened.select(F.col(self.key).alias("_key"), F.col(self.sequence).alias("_open"), F.col(self.at).alias("_open_at"))
        same_key = F.col(self.key).eqNullSafe(F.col("_key"))
        marked = materialize(changes.join(known, same_key, "left"), "marked")

        fresh = marked.where(F.col("_open").isNull() | (F.col(self.sequence) > F.col("_open"))).select(*self.columns)
        names = fresh.select(F.col(self.key).alias("_key")).distinct()
        line = self._followed(fresh.unionByName(opened.join(names, same_key, "left_semi").select(*self.columns)))
        line = materialize(line, "line")
        ends = F.col("next_sequence").isNull()
        untouched = opened.join(names, same_key, "left_anti")
        new_open = line.where(ends).select(*self.schema.fieldNames()).unionByName(untouched)
        new_closed = line.where(~ends)

        late = marked.where(F.col(self.sequence) < F.col("_open"))
        stale, rewritten = [], []
        if not late.isEmpty():
            split, moved = self._split(late, old_closed)
            new_closed = new_closed.unionByName(split)
            # At most one row per folder.
            folders = {r[0] for r in moved.select("_folder").distinct().collect()}
            stale = [e for e in old_closed if e.folder in folders]
            if stale:
                gone = moved.select(F.col(self.key).alias("_key"), F.col(self.sequence).alias("_sequence"))
                left = self.table.read(stale, self.schema).join(
                    gone, same_key & (F.col(self.sequence) == F.col("_sequence")), "left_anti")
                rewritten = self._write(
                    left, max(e.level for e in stale), min(e.first for e in stale), max(e.last for e in stale))
        new = [*self._write(new_open, OPEN, batch_id, batch_id), *rewritten, *self._write(new_closed, 0, batch_id, batch_id)]
        self._merge(self.table.replace(version, [*old_open, *stale], new, batch_id))

    def _split(self, late: DataFrame, entries: list[Entry]) -> tuple[DataFrame, DataFrame]:
        """Late changes with their successors and the rows before them; and those rows as they stood, with their folders."""
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"/data/(.+)/[^/]+$", 1) if entries else F.lit("")
        closed = self.table.read(entries, self.schema).withColumn("_folder", folder)
        names = late.select(F.col(self.key).alias("_key")).distinct()
        closed = materialize(closed.join(names, F.col(self.key).eqNullSafe(F.col("_key")), "left_semi"), "closed")
        rows = closed.select(
            F.col(self.key).alias("_row_key"), F.col(self.sequence).alias("_row"), F.col("next_sequence").alias("_end"),
            F.col("next_at").alias("_end_at"))
        # The intervals of a key do not overlap, so a change falls into one at most.
        inside = (F.col(self.key).eqNullSafe(F.col("_row_key")) & (F.col("_row") <= F.col(self.sequence))
                  & (F.col(self.sequence) < F.col("_end")))
        placed = late.join(rows, inside, "left").where(F.col("_row").isNull() | (F.col("_row") < F.col(self.sequence)))
        # Before all known changes of its key: what follows is the first of those.
        first = closed.groupBy(F.col(self.key).alias("_first_key")).agg(
            F.min_by(F.struct(F.col(self.sequence).alias("s"), F.col(self.at).alias("a")), self.sequence).alias("_first"))
        placed = placed.join(first, F.col(self.key).eqNullSafe(F.col("_first_key")), "left").withColumn(
            "_last", F.when(F.col("_row").isNotNull(), F.struct(F.col("_end").alias("s"), F.col("_end_at").alias("a"))).otherwise(
                F.coalesce("_first", F.struct(F.col("_open").alias("s"), F.col("_open_at").alias("a")))))
        placed = materialize(placed.select(*self.columns, "_row", "_last"), "placed")
        hit = placed.where("_row IS NOT NULL").select(F.col(self.key).alias("_hit_key"), F.col("_row").alias("_hit")).distinct()
        before = closed.join(
            hit, F.col(self.key).eqNullSafe(F.col("_hit_key")) & (F.col(self.sequence) == F.col("_hit")), "left_semi")
        after = F.struct(F.col("next_sequence").alias("s"), F.col("next_at").alias("a")).alias("_last")
        members = placed.unionByName(before.select(*self.columns, F.col(self.sequence).alias("_row"), after))
        return self._followed(members, "_row", last=F.col("_last")).drop("_row", "_last"), before

    def _merge(self, version) -> None:
        while full := self.table.mergeable(version, self.fanout):
            group = [e for g in full for e in g]
            merged = self._write(
                self.table.read(group, self.schema), group[0].level + 1, min(e.first for e in group), max(e.last for e in group))
            version = self.table.replace(version, group, merged)

"""The call table, kept by increments.

Rows lie in folders by a hash of the customer; each batch adds folders, and many small ones
are merged.  A refresh reads the new calls and joins them with the dimensions.  If dimension
rows changed since the last refresh, the folders that hold calls of those rows are found by
their key columns and rewritten; all other folders stay as they are.  A call whose key comes
again takes the place of the one before: its place in its file is marked from the key and a
digest, so whole calls are not exchanged to find it, and one that comes again unchanged stays.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from holdfast import schemas
from holdfast.operators.history import dedupe_latest, snapshot_diff
from holdfast.plans.marts import call_fact
from holdfast.session import estimated_bytes, materialize
from holdfast.sources.manifest import FANOUT, OPEN_FILES, Entry, ManifestTable

#: Dimensions: source, key in the source, key in the call table, columns that the call table shows.
DIMENSIONS = {
    "customer_profiles": ("customer_id", "customer_id", ["market", "plan_type", "tenure_months", "monthly_spend"]),
    "agents": ("agent_id", "agent_id", ["agent_name", "team", "tier"]),
    "competitor_intel": ("competitor_id", "competitor_id", ["competitor_name"]),
    "retention_offers": ("offer_id", "offer_presented_id", ["offer_name"]),
}
CALL_COLUMNS = schemas.SOURCES["call_interactions"].fieldNames()
BUCKETS = 64
#: Rows of a file that share a bitmap; the size of a bitmap is Spark's.
BLOCK_ROWS = 32_768
#: Bitmaps up to this size are broadcast (4 KB for 32,768 rows that have a marked one among them).
MARK_BYTES = 256 << 20
#: A batch above this size is written from the tasks that joined it.
LARGE_BATCH = 32 << 20
FILE = "_metadata.file_path"
FOLDER = r"/data/(.+)/[^/]+$"


class FactStore:
    """The enriched calls below ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.table = ManifestTable(spark, f"{root}/calls")
        self.seen = {name: ManifestTable(spark, f"{root}/dimensions/{name}") for name in DIMENSIONS}
        empty = {name: spark.createDataFrame([], schemas.SOURCES[name]) for name in schemas.SOURCES}
        self.schema = self._enriched(empty["call_interactions"], empty).schema

    def _enriched(self, calls: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
        return call_fact(calls, *(dims[name] for name in DIMENSIONS))

    def _bucket(self, customer: str = "customer_id") -> Column:
        return F.pmod(F.xxhash64(customer), F.lit(self.buckets))

    def read(self, entries: Iterable[Entry] | None = None) -> DataFrame:
        """The call table, or the rows of some of its folders."""
        return self.table.read(self.table.current().entries if entries is None else entries, self.schema)

    def _write(self, facts: DataFrame, level: int, first: int, last: int, in_place: bool = False) -> list[Entry]:
        return self.table.write(facts.withColumn("bucket", self._bucket()), level, first, last, "bucket", in_place)

    def _holding(self, entries: Iterable[Entry], column: str, keys: DataFrame, key: str) -> list[Entry]:
        """Folders with a row whose ``column`` is among the keys; only that column is read."""
        entries = list(entries)
        if not entries:
            return []
        folder = F.regexp_extract(F.col(FILE), FOLDER, 1)
        held = self.read(entries).select(F.col(column).alias("_held"), folder.alias("_folder"))
        wanted = keys.select(F.col(key).alias("_wanted"))
        # At most one row per folder.
        found = held.join(wanted, F.col("_held").eqNullSafe(F.col("_wanted")), "left_semi").select("_folder").distinct()
        names = {r[0] for r in found.collect()}
        return [e for e in entries if e.folder in names]

    def marks(self, calls: DataFrame, key: str) -> DataFrame:
        """Where the rows lie whose key comes again in ``calls``: ``_file``, ``_block`` and the ``_bits`` of its rows."""
        place = F.col("_metadata.row_index")
        held = self.read().select(F.col(key).alias("_held"), F.col(FILE).alias("_file"), place.alias("_row"))
        again = calls.select(F.col(key).alias("_again"))
        found = held.join(again, F.col("_held").eqNullSafe(F.col("_again")), "left_semi")
        return self._bitmaps(found)

    def _bitmaps(self, found: DataFrame) -> DataFrame:
        number = F.col("_row") + 1  # Spark's blocks begin at 1
        return materialize(found.groupBy("_file", F.bitmap_bucket_number(number).alias("_block")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bits")), "marks")

    def changed(self, calls: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """The calls of a batch that the table does not hold as they are, and the marks of the rows they replace.

        ``calls`` is a written table or a narrow plan on one.  A call is held as it is if the only row of its key in the
        table has the same digest of all call columns (64 bits; keys tell the rows apart, so only the two versions of a
        call are ever compared).  The table must be up to date with the dimensions (see ``propagate``).
        """
        place = [F.col(FILE).alias("_file"), F.col("_metadata.row_index").alias("_row")]
        values = [F.col(c).try_cast(self.schema[c].dataType) for c in CALL_COLUMNS]  # days as the table has them
        nulls = F.concat(*[v.isNull().cast("string") for v in values])  # the hash passes over NULLs
        digest = F.xxhash64(*values, nulls).alias("_digest")
        held = self.read().select(F.col(key).alias("_key"), digest, *place, F.lit(1).alias("_held"))
        again = calls.select(F.col(key).alias("_key"), digest, *place, F.lit(0).alias("_held"))
        of_key = W.partitionBy("_key")
        both = held.unionByName(again).select(
            "_file", "_row", "_held", F.sum("_held").over(of_key).alias("_old"), F.sum(1 - F.col("_held")).over(of_key).alias("_new"),
            (F.min("_digest").over(of_key) == F.max("_digest").over(of_key)).alias("_equal"))
        kept = (F.col("_old") == 1) & (F.col("_new") == 1) & F.col("_equal")
        # Of the table the rows to replace, of the batch those that replace nothing.
        marks = self._bitmaps(both.where(F.when(F.col("_held") == 1, (F.col("_new") > 0) & ~kept).otherwise(kept)))
        return self._marked_rows(calls, marks)[0].where("NOT _marked").drop("_marked"), marks

    def _with_marks(self, entries: Iterable[Entry], marks: DataFrame) -> tuple[DataFrame, bool]:
        """Rows of some folders with ``_marked``, and whether they stayed in the tasks that read them."""
        return self._marked_rows(self.read(entries), marks)

    def _marked_rows(self, rows_: DataFrame, marks: DataFrame) -> tuple[DataFrame, bool]:
        """Rows of a written table with ``_marked``, and whether they stayed in the tasks that read them."""
        row = F.col("_metadata.row_index")
        rows_ = rows_.select("*", F.col(FILE).alias("_file"), row.alias("_row")).withColumn(
            "_block", F.bitmap_bucket_number(F.col("_row") + 1))
        small = estimated_bytes(marks) <= MARK_BYTES
        joined = rows_.join(F.broadcast(marks) if small else marks, ["_file", "_block"], "left")
        bit = F.expr(f"getbit(CAST(conv(hex(substring(_bits, CAST(_row % {BLOCK_ROWS} DIV 8 AS INT) + 1, 1)), 16, 10) AS INT), CAST(_row % 8 AS INT))")
        return joined.withColumn("_marked", F.coalesce(bit == 1, F.lit(False))).drop("_file", "_row", "_block", "_bits"), small

    def _marked_entries(self, entries: Iterable[Entry], marks: DataFrame) -> list[Entry]:
        # At most one row per folder.
        names = {r[0] for r in marks.select(F.regexp_extract("_file", FOLDER, 1)).distinct().collect()}
        return [e for e in entries if e.folder in names]

    def replaced(self, calls: DataFrame, key: str, marks: DataFrame | None = None) -> DataFrame:
        """Rows of the table whose key comes again in ``calls``."""
        marks = self.marks(calls, key) if marks is None else marks
        old = self._marked_entries(self.table.current().entries, marks)
        return self._with_marks(old, marks)[0].where("_marked").drop("_marked") if old else self.read([])

    def propagate(self, dims: dict[str, DataFrame]) -> int:
        """Bring the calls of changed dimension rows up to date; returns how many folders were rewritten.

        The dimensions' rows are compared with those that the table was built with, in the columns that it shows.
        """
        shown = {name: materialize(dims[name].select(key, *columns), name) for name, (key, _, columns) in DIMENSIONS.items()}
        version, touched = self.table.current(), set()
        fresh = {}
        for name, (key, column, _) in DIMENSIONS.items():
            known = self.seen[name].current()
            before = self.seen[name].read(known.entries, shown[name].schema)
            changed = materialize(snapshot_diff(before, shown[name], key).select(key), "changed")
            if changed.isEmpty():
                continue
            fresh[name] = known
            candidates = version.entries
            if column == "customer_id":  # the folders' own hash leaves out most of them
                # At most one row per bucket.
                hit = {r[0] for r in changed.select(self._bucket(key)).distinct().collect()}
                candidates = [e for e in candidates if e.bucket in hit]
            touched.update(self._holding(candidates, column, changed, key))
        if touched:
            stale = self.read(touched).select(*CALL_COLUMNS)
            new = self._write(
                self._enriched(stale, shown), max(e.level for e in touched), min(e.first for e in touched), max(e.last for e in touched))
            self.table.replace(version, touched, new)
        # Only now: a refresh that died before finds the same changes again.
        for name, known in fresh.items():
            self.seen[name].replace(known, known.entries, self.seen[name].write(shown[name], 0, 0, 0))
        return len(touched)

    def append(
        self, calls: DataFrame, dims: dict[str, DataFrame], batch_id: int, key: str | None = None, marks: DataFrame | None = None,
        size: int | None = None,
    ) -> None:
        """Add a batch of calls; with ``key``, rows of the table whose key comes again go.

        A batch that the table contains is not added again.  ``marks`` are those of the batch and
        ``size`` its bytes, if they are known.
        """
        version = self.table.current()
        if batch_id <= version.batch:
            return
        old, new = [], []
        if key is not None and version.entries:
            marks = self.marks(calls, key) if marks is None else marks
            old = self._marked_entries(version.entries, marks)
            if old:
                left, in_place = self._with_marks(old, marks)
                new += self._write(
                    left.where("NOT _marked").drop("_marked"), max(e.level for e in old), min(e.first for e in old), max(e.last for e in old),
                    in_place)
        # A large batch gives every bucket a file of some size from each task, so its calls are not exchanged once more.
        many = self.buckets <= OPEN_FILES and (estimated_bytes(calls) if size is None else size) > LARGE_BATCH
        new += self._write(self._enriched(calls, dims), 0, batch_id, batch_id, many)
        self._merge(self.table.replace(version, old, new, batch_id))

    def _merge(self, version) -> None:
        while full := self.table.mergeable(version, self.fanout):
            group = [e for g in full for e in g]
            merged = self._write(self.read(group), group[0].level + 1, min(e.first for e in group), max(e.last for e in group))
            version = self.table.replace(version, group, merged)


def latest_calls(batch: DataFrame, key: str) -> DataFrame:
    """Of the calls of a batch with equal keys, the one that arrived last."""
    return dedupe_latest(batch, [key], ["_ingested_at", "_source_file"])


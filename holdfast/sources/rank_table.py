"""Counts per value, kept by ranges of values, from which ranks follow without another pass over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions.rates import count_true, rows
from holdfast.operators.ranks import BROADCAST_BYTES, BROADCAST_VALUES, HOT_SHARE, ValueTable
from holdfast.session import materialize
from holdfast.sources.manifest import ManifestTable, Version

#: Distinct values of a range, about; a range that grows beyond twice as many is cut anew.
VALUES_PER_RANGE = 1_000_000
# Bounds among which a value is looked for one by one.
_GROUP = 64


class NegativeCount(ValueError):
    """More rows of a value are taken away than there are."""


class RankTable:
    """How often each value of a column stands, in folders of one range of values each, below ``root``.

    ``kind`` is the column's type: any that has an order.  NULL is counted like a value, ahead of all others.
    """

    def __init__(self, spark: SparkSession, root: str, column: str, kind: T.DataType, per_range: int = VALUES_PER_RANGE):
        self.spark, self.table, self.column, self.per_range = spark, ManifestTable(spark, root), column, per_range
        self.schema = T.StructType([
            T.StructField("value", kind), T.StructField("n", T.LongType()), T.StructField("range", T.LongType())])

    def read(self) -> DataFrame:
        """``value``, ``n`` and the number of the ``range`` it is in."""
        return self.table.read(self.table.current().entries, self.schema)

    def _ranges(self, version: Version) -> list[tuple]:
        """Number, least value and rows of each range, in order of the values; a row per range."""
        stats = self.table.read(version.entries, self.schema).groupBy("range").agg(
            F.min("value").alias("low"), F.sum("n").alias("n_rows"))
        return [tuple(r) for r in stats.orderBy(F.asc_nulls_first("low")).collect()]

    def _range_of(self, frame: DataFrame, ranges: list[tuple]) -> DataFrame:
        """Add the ``range`` whose least value is the last that is not above ``value``; the first has what is below all."""
        bounds = [low for _, low, _ in ranges[1:]]
        kind = self.schema["value"].dataType
        known = self.spark.createDataFrame([(bounds, bounds[::_GROUP], [n for n, *_ in ranges])], T.StructType([
            T.StructField("_bounds", T.ArrayType(kind)), T.StructField("_coarse", T.ArrayType(kind)),
            T.StructField("_numbers", T.ArrayType(T.LongType()))]))
        passed = lambda some: F.size(F.filter(some, lambda x: x <= F.col("value")))
        group = F.greatest(passed(F.col("_coarse")) - 1, F.lit(0)) * _GROUP
        place = group + passed(F.slice("_bounds", group + 1, F.lit(_GROUP)))
        return frame.crossJoin(F.broadcast(known)).withColumn("range", F.element_at("_numbers", place + 1)).drop(*known.columns)

    def apply(self, changes: DataFrame, batch_id: int | None = None, sign: str | None = None) -> int:
        """Count the rows of ``changes`` in, or ``sign`` times each; returns how many ranges were rewritten.

        Ranges without a changed value keep their files.  Taking away what is not there is an error, before anything is
        written.  A batch whose number the table contains is not counted again.  No rows change nothing.
        """
        version = self.table.current()
        if batch_id is not None and batch_id <= version.batch:
            return 0
        batch = version.batch if batch_id is None else batch_id
        weight = F.col(sign).cast("long") if sign else F.lit(1).cast("long")
        delta = changes.select(F.col(self.column).alias("value"), weight.alias("n")).groupBy("value").agg(F.sum("n").alias("n"))
        ranges = self._ranges(version)
        delta = delta.where("n <> 0")
        delta = self._range_of(delta, ranges) if ranges else delta.withColumn("range", F.lit(-1).cast("long"))
        delta = materialize(delta, "delta")
        hit = {r[0] for r in delta.select("range").distinct().collect()}  # at most one row per range
        old = [e for e in version.entries if e.bucket in hit]
        both = self.table.read(old, self.schema).unionByName(delta)
        merged = materialize(both.groupBy("range", "value").agg(F.sum("n").alias("n")), "merged")
        missing = merged.agg(count_true(F.col("n") < 0)).first()[0]
        if missing:
            raise NegativeCount(f"{missing} values would stand less than never")
        kept = merged.where("n > 0")
        sizes = {r[0]: r[1] for r in kept.groupBy("range").agg(rows()).collect()}
        cut = {n: -(-size // self.per_range) for n, size in sizes.items() if n < 0 or size > 2 * self.per_range}
        new = kept.where(~F.col("range").isin(list(cut))) if cut else kept
        if cut:
            new = new.unionByName(self._cut(kept.where(F.col("range").isin(list(cut))), sum(cut.values()), version))
        written = self.table.write(
            new.select("value", "n", "range", F.col("range").alias("bucket")), 0, batch, batch, "bucket") if sizes else []
        self.table.replace(version, old, written, batch)
        return len(hit)

    def _cut(self, kept: DataFrame, parts: int, version: Version) -> DataFrame:
        """The rows of some ranges in smaller ones, with numbers that no range has had in this version."""
        # Ordered by the range first, and told apart by it, so that no part reaches over a range between two of them.
        part = kept.repartitionByRange(parts, "range", F.asc_nulls_first("value")).withColumn("part", F.spark_partition_id())
        part = materialize(part, "parts")
        first = max((e.bucket for e in version.entries), default=-1) + 1
        found = sorted(tuple(r) for r in part.select("range", "part").distinct().collect())  # a row per new range
        numbers = self.spark.createDataFrame(
            [(*key, first + i) for i, key in enumerate(found)], "range long, part int, number long")
        return part.join(F.broadcast(numbers), ["range", "part"]).select(F.col("number").alias("range"), "value", "n")

    def values(self, ascending: bool = True, present: bool = False) -> ValueTable:
        """Running counts, as ``ranks.value_table`` makes them of the rows; with ``present`` NULL is left out.

        Only the counts are read.  A window covers one range; the ranges before it come as one number.
        """
        version = self.table.current()
        table = self.table.read(version.entries, self.schema)
        ranges, offsets, n_rows = self._ranges(version), [], 0
        for number, _, n in ranges:
            offsets.append((number, n_rows))
            n_rows += n
        nulls = 0
        if present:
            nulls = table.where("value IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        inside = W.partitionBy("range").orderBy(F.asc_nulls_first("value")).rowsBetween(W.unboundedPreceding, -1)
        known = self.spark.createDataFrame(offsets, "range long, _offset long")
        before: Column = F.col("_offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))
        if not ascending:
            before = F.lit(n_rows) - before - F.col("n")
        frame = table.join(F.broadcast(known), "range").select(
            F.col("value").alias(self.column), F.col("n").alias("_ties"), (before - (nulls if ascending else 0)).alias("_before"))
        if present:
            frame = frame.where(F.col(self.column).isNotNull())
        fixed = isinstance(self.schema["value"].dataType, (T.NumericType, T.DatetimeType, T.BooleanType))
        size = F.lit(0) if fixed else F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("value")))), F.lit(0))
        n_values, n_bytes = table.agg(rows(), size).first()
        small = n_values <= BROADCAST_VALUES and n_bytes <= BROADCAST_BYTES
        # At most HOT_SHARE values.
        hot = [] if small else [r[0] for r in table.where(F.col("n") > n_rows / HOT_SHARE).select("value").collect()]
        return ValueTable(frame, self.column, n_rows - nulls, small, hot)

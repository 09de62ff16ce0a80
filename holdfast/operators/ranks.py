"""Ranks over a whole table, without a single-partition window.

``RANK() OVER (ORDER BY x)`` sends every row to one task.  Here rows are first
reduced to one row per distinct value (map-side combined, so a value that a
third of the rows share costs nothing), the distinct values get their running
count, and that small table is joined back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions.rates import rows
from holdfast.session import materialize

# A value table up to this many rows, and bytes of texts, is ranked by one task and broadcast.
BROADCAST_VALUES = 400_000
BROADCAST_BYTES = 32 << 20
# Distinct values per slice when the value table is too big for one task.
VALUES_PER_SLICE = 2_000_000
# A value is hot when more than 1/HOT_SHARE of the rows have it: at most HOT_SHARE such values.
HOT_SHARE = 1_000
HOT_SALTS = 256


@dataclass
class ValueTable:
    """Distinct values with ``_ties`` (rows that have the value) and ``_before`` (rows ahead).

    The two ways to build and attach it differ in the plan, never in the rows.
    """

    frame: DataFrame
    column: str
    n_rows: int | None
    small: bool
    hot: list

    def attach(self, df: DataFrame) -> DataFrame:
        """Add ``_ties`` and ``_before`` to every row of ``df``."""
        values = self.frame.withColumnRenamed(self.column, "_value")
        if not self.small:
            return self._attach_shuffled(df, values)
        return df.join(F.broadcast(values), df[self.column].eqNullSafe(values["_value"]), "left").drop("_value")

    def _attach_shuffled(self, df: DataFrame, values: DataFrame) -> DataFrame:
        # Rows of a hot value are spread over salts; its one table row is repeated per salt.
        # The salt follows from the row, so it is the same when a lost task is run again.
        if self.hot:
            hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
            spread = F.pmod(F.xxhash64(*hashed, F.spark_partition_id()), F.lit(HOT_SALTS)).cast("int")
            salt = F.when(self._is_hot(F.col(self.column)), spread).otherwise(F.lit(0))
            salts = F.when(self._is_hot(F.col("_value")), F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(
                F.array(F.lit(0)))
        else:
            salt, salts = F.lit(0), F.array(F.lit(0))
        left = df.withColumn("_salt", salt)
        right = values.withColumn("_value_salt", F.explode(salts))
        on = left[self.column].eqNullSafe(right["_value"]) & (left["_salt"] == right["_value_salt"])
        return left.join(right, on, "left").drop("_value", "_salt", "_value_salt")

    def _is_hot(self, value: Column) -> Column:
        known = F.coalesce(value.isin([v for v in self.hot if v is not None]), F.lit(False))
        return known | value.isNull() if None in self.hot else known


def value_table(df: DataFrame, column: str, ascending: bool = True, domain_bound: int | None = None) -> ValueTable:
    """Running counts over the distinct values of ``column``, which may have any type that has an order.

    ``domain_bound`` states that the column cannot have more distinct values than
    that (scores rounded to four places have 10,001), which saves the counting pass.
    A column that breaks the promise is an error when the plan runs.
    """
    ties = df.groupBy(column).agg(rows().alias("_ties"))
    if domain_bound is not None and domain_bound <= BROADCAST_VALUES:
        error = F.raise_error(F.lit(f"{column} has more than the {domain_bound} values that were promised"))
        counted = ties.withColumn("_values", F.count("*").over(W.partitionBy()))
        ties = counted.where(
            F.when(F.col("_values") <= domain_bound, F.lit(True)).otherwise(error.cast("boolean"))).drop("_values")
        return ValueTable(_running(ties, column, ascending), column, None, True, [])
    # Written once: the counts, the slices and the ranks are read from it.
    ties = materialize(ties, "values")
    # Numbers and times have a fixed size; the length of all else is measured.
    fixed = isinstance(ties.schema[column].dataType, (T.NumericType, T.DatetimeType, T.BooleanType))
    size = F.lit(0) if fixed else F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(column)))), F.lit(0))
    n_values, n_rows, n_bytes = ties.agg(rows(), F.sum("_ties"), size).first()
    if n_values <= BROADCAST_VALUES and n_bytes <= BROADCAST_BYTES:
        return ValueTable(_running(ties, column, ascending), column, n_rows or 0, True, [])
    return _sliced_table(ties, column, ascending, n_values, n_rows)


def _ordered(name: str, ascending: bool) -> Column:
    return F.col(name).asc() if ascending else F.col(name).desc()


def _running(ties: DataFrame, column: str, ascending: bool) -> DataFrame:
    before = F.sum("_ties").over(W.orderBy(_ordered(column, ascending)).rowsBetween(W.unboundedPreceding, -1))
    return ties.withColumn("_before", F.coalesce(before, F.lit(0)))


def _sliced_table(ties: DataFrame, column: str, ascending: bool, n_values: int, n_rows: int) -> ValueTable:
    # The values are dealt out in ranges of their own type; the slice is written with them, so it stays what it is.
    n_slices = max(2, -(-n_values // VALUES_PER_SLICE))
    sliced = materialize(
        ties.repartitionByRange(n_slices, _ordered(column, ascending)).withColumn("_slice", F.spark_partition_id()),
        "slices",
    )
    # One row per slice.
    totals = sliced.groupBy("_slice").agg(F.sum("_ties").alias("_in_slice"))
    ahead = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_slice").alias("_offset_slice"), F.coalesce(F.sum("_in_slice").over(ahead), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("_slice").orderBy(_ordered(column, ascending)).rowsBetween(W.unboundedPreceding, -1)
    frame = (
        sliced.join(offsets, F.col("_slice") == F.col("_offset_slice"))
        .withColumn("_before", F.col("_offset") + F.coalesce(F.sum("_ties").over(inside), F.lit(0)))
        .select(column, "_ties", "_before")
    )
    # At most HOT_SHARE values, NULL among them.
    hot = [r[0] for r in ties.where(F.col("_ties") > n_rows / HOT_SHARE).select(column).collect()]
    return ValueTable(frame, column, n_rows, False, hot)


def global_rank(
    df: DataFrame, column: str, out: str = "rank", ascending: bool = False, domain_bound: int | None = None,
    kept: ValueTable | None = None,
) -> DataFrame:
    """``RANK()`` over the whole table: ties share a rank and leave a gap.

    ``kept`` has the counts of the column in the same order, where they are kept (``sources.rank_table``).
    """
    table = kept or value_table(df, column, ascending, domain_bound)
    return table.attach(df).withColumn(out, F.col("_before") + 1).drop("_ties", "_before")


def rank_pct(
    df: DataFrame, column: str, out: str = "pct", domain_bound: int | None = None, kept: ValueTable | None = None
) -> DataFrame:
    """Mean-rank percentile in (0, 1], NULL for NULL: tied rows share the mean of their positions.

    ``kept`` has the counts of the values that are not NULL, in ascending order.
    """
    table = kept or value_table(df.where(F.col(column).isNotNull()), column, True, domain_bound)
    if table.n_rows is None:
        total = F.sum("_ties").over(W.partitionBy())
        table.frame = table.frame.withColumn("_total", total)
    else:
        table.frame = table.frame.withColumn("_total", F.lit(max(1, table.n_rows)))
    mean_rank = F.col("_before") + (F.col("_ties") + 1) / 2
    return table.attach(df).withColumn(out, mean_rank / F.col("_total")).drop("_ties", "_before", "_total")


def global_position(
    df: DataFrame, column: str, key: str, out: str = "position", ascending: bool = False,
    domain_bound: int | None = None, spread_digits: int = 3,
) -> DataFrame:
    """A distinct 0-based position per row, ordered by ``column``, then by the MD5 of ``key``, then ``key``.

    The order inside a group of ties is by digest, so that even one value shared by
    a third of the rows is split into ``16 ** spread_digits`` ordered parts.
    """
    table = value_table(df, column, ascending, domain_bound)
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    # The unit is one key for the window and the join, so the rows are exchanged once.
    parted = df.withColumn("_digest", digest).withColumn(
        "_unit", F.struct(F.col(column).alias("value"), F.substring("_digest", 1, spread_digits).alias("part"))
    )
    counts = parted.groupBy("_unit").agg(rows().alias("_in_unit")).withColumn(column, F.col("_unit.value"))
    ahead = W.partitionBy(column).orderBy("_unit.part").rowsBetween(W.unboundedPreceding, -1)
    offsets = table.attach(
        counts.withColumn("_units_before", F.coalesce(F.sum("_in_unit").over(ahead), F.lit(0)))
    ).select(F.col("_unit").alias("_offset_unit"), (F.col("_before") + F.col("_units_before")).alias("_start"))
    inside = W.partitionBy("_unit").orderBy("_digest", key)
    return (
        parted.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(offsets, F.col("_unit") == F.col("_offset_unit"))
        .withColumn(out, F.col("_start") + F.col("_inside"))
        .drop("_digest", "_unit", "_offset_unit", "_inside", "_start")
    )


def topk_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "position") -> DataFrame:
    """The first ``k`` rows of each key.

    Spark cuts each map task's rows to ``k`` per key before the exchange
    (``WindowGroupLimit``) for ``k`` up to 1000, so a hot key brings at most
    ``k`` rows per task.  For larger ``k`` a first stage cuts each key in salted parts.
    """
    if k > 1_000:
        df = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(HOT_SALTS)))
        local = W.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_local", F.row_number().over(local)).where(F.col("_local") <= k).drop("_local", "_salt")
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= k)

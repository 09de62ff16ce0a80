"""Latest versions, snapshot differences and validity history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from holdfast.functions.rates import rows
from holdfast.session import materialize

# Changes of one key that a single task sorts without trouble.
MAX_CHANGES_PER_TASK = 5_000_000
BROADCAST_ROWS = 400_000
# Change types whose image is that of the row before a change.
BEFORE_IMAGES = ("update_preimage",)


def dedupe_latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key.

    ``order`` must make the choice unique.  The latest is combined before the exchange, so
    copies of one key cost one row per map task.  Other columns may have any type, maps too.
    """
    payload = [c for c in df.columns if c not in key and c not in order]
    # The payload is carried as a value, so it needs no order of its own.
    latest = F.max_by(F.struct(*order, *payload), F.struct(*order)).alias("_latest")
    return df.groupBy(*key).agg(latest).select(*key, *[F.col(f"_latest.{c}").alias(c) for c in order + payload]).select(
        *df.columns
    )


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows a snapshot sync must carry: inserts and updates with the new image, deletes with the old one.

    Columns are compared one by one with NULL-safe equality, not by hash, so no change can be missed.
    """
    payload = [c for c in after.columns if c != key]
    old = before.select(F.col(key), F.struct(*payload).alias("_old"))
    new = after.select(F.col(key), F.struct(*payload).alias("_new"))
    joined = old.join(new, key, "full")
    kind = (
        F.when(F.col("_old").isNull(), "insert")
        .when(F.col("_new").isNull(), "delete")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "update")
    )
    image = F.coalesce("_new", "_old")
    return (
        joined.withColumn("change_type", kind).where(F.col("change_type").isNotNull())
        .select(key, "change_type", *[image[c].alias(c) for c in payload])
    )


def scd2_history(
    feed: DataFrame, key: str, sequence: str, at: str, change_type: str, values: list[str],
    max_changes: int = MAX_CHANGES_PER_TASK, leave_out: tuple[str, ...] = BEFORE_IMAGES,
) -> DataFrame:
    """Validity rows from a change feed: each change holds until the next change of its key.

    Deletes close the row before them and give no row of their own; changes of the types in
    ``leave_out`` are not looked at.  The sequence may have any type that has an order.  A key
    with more than ``max_changes`` changes is cut into slices of the sequence; only the first
    change of each slice is handed from slice to slice, and the rows are the same.
    """
    if leave_out:
        feed = feed.where(~F.coalesce(F.col(change_type).isin(*leave_out), F.lit(False)))
    heavy = materialize(feed.groupBy(key).agg(rows().alias("_n")).where(F.col("_n") > max_changes), "heavy")
    n_hot, n_hot_rows = heavy.agg(rows(), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if n_hot == 0:
        chained = feed.withColumn("_next", _following(at, W.partitionBy(key).orderBy(sequence)))
    else:
        chained = _chain_sliced(feed, key, sequence, at, heavy, n_hot, max(2, -(-n_hot_rows // max_changes)))
    return (
        chained.where(~F.col(change_type).eqNullSafe(F.lit("delete")))
        .select(
            key, sequence, *values, F.col(at).alias("valid_from"), F.col("_next.at").alias("valid_to"),
            F.col("_next").isNull().alias("is_current"),
        )
    )


def _following(at: str, window) -> Column:
    return F.lead(F.struct(F.col(at).alias("at"))).over(window)


def _chain_sliced(
    feed: DataFrame, key: str, sequence: str, at: str, heavy: DataFrame, n_hot: int, n_slices: int
) -> DataFrame:
    # At most (rows of the feed / max_changes) keys are heavy.
    hot_key = _small_side(heavy.select(F.col(key).alias("_hot_key")), n_hot)
    is_hot = feed[key].eqNullSafe(F.col("_hot_key"))
    calm = feed.join(hot_key, is_hot, "left_anti").withColumn(
        "_next", _following(at, W.partitionBy(key).orderBy(sequence)))
    # Ranges of the sequence in its own type, over all heavy keys. They are balanced for one dominant key, which is
    # what matters; any bounds give the same history. The slice is written with the rows, so it stays what it is.
    hot = materialize(
        feed.join(hot_key, is_hot, "left_semi").repartitionByRange(n_slices, F.col(sequence))
        .withColumn("_slice", F.spark_partition_id()),
        "hot_changes",
    )
    # First change of each slice of the heavy keys: at most n_hot * n_slices rows.
    first = hot.groupBy(key, "_slice").agg(F.min_by(F.struct(F.col(at).alias("at")), sequence).alias("_first"))
    handed = first.select(
        F.col(key).alias("_key"), F.col("_slice").alias("_key_slice"),
        F.lead("_first").over(W.partitionBy(key).orderBy("_slice")).alias("_handed"),
    )
    inside = _following(at, W.partitionBy(key, "_slice").orderBy(sequence))
    on = hot[key].eqNullSafe(handed["_key"]) & (hot["_slice"] == handed["_key_slice"])
    chained = (
        hot.withColumn("_inside", inside).join(_small_side(handed, n_hot * n_slices), on, "left")
        .withColumn("_next", F.coalesce("_inside", "_handed"))
        .drop("_inside", "_handed", "_key", "_key_slice", "_slice")
    )
    return calm.unionByName(chained)


def _small_side(df: DataFrame, most_rows: int) -> DataFrame:
    """Broadcast a side whose row count is known to be small; otherwise leave the join to Spark."""
    return F.broadcast(df) if most_rows <= BROADCAST_ROWS else df


def current_rows(history: DataFrame) -> DataFrame:
    return history.where(F.col("is_current")).drop("valid_to", "is_current")


def as_of(history: DataFrame, moment: Column) -> DataFrame:
    """Rows that were valid at a moment."""
    open_end = F.col("valid_to").isNull() | (moment < F.col("valid_to"))
    return history.where((F.col("valid_from") <= moment) & open_end)

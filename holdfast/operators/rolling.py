"""Rolling sums over a table that already has one row per day (and series)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from holdfast.session import materialize


def trailing(column: str, rows: int, day: str, series: list[str] | None = None) -> Column:
    """Sum of the current and the ``rows - 1`` preceding rows.

    This is a frame of rows, not of dates: a missing day stretches the window.
    Without a series key all days go to one task, which is safe because the input
    has one row per day; use ``fill_days`` first where gaps must count as zero.
    """
    window = W.partitionBy(*(series or [])).orderBy(day).rowsBetween(-(rows - 1), 0)
    return F.sum(column).over(window)


def rolling_rate(
    daily: DataFrame, day: str, part: str, whole: str, rows: int, out: str = "rate", places: int = 4,
    series: list[str] | None = None,
) -> DataFrame:
    """Trailing sum of ``part`` over trailing sum of ``whole``; NULL when the latter is zero."""
    share = trailing(part, rows, day, series) / F.nullif(trailing(whole, rows, day, series), F.lit(0))
    return daily.withColumn(out, F.round(share, places))


def fill_days(daily: DataFrame, day: str, counts: list[str]) -> DataFrame:
    """Add the missing days between the first and the last one, with zero counts."""
    span = daily.agg(F.min(day).alias("_first"), F.max(day).alias("_last")).where(F.col("_first").isNotNull())
    days = span.select(F.explode(F.sequence("_first", "_last")).alias(day))
    return days.join(daily, day, "left").fillna(0, subset=counts)


def long_trailing(
    frame: DataFrame, sums: dict[str, str], rows: int, order: str, series: list[str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Trailing sums like :func:`trailing`, for series that are too long for one task.

    ``sums`` names the result column of each summed column.  The rows are cut into ranges of (series, order), about
    equal in rows, and every range gets the up to ``rows - 1`` rows before it once more; then each range is a window of
    its own.  The rows and sums are those of the plain window.  ``order`` must tell the rows of a series apart.  A NULL
    is a series like any other and the first place of its order; an empty table gives an empty one.
    """
    if rows < 1:
        raise ValueError("a window has at least one row")
    series, columns = list(series or []), frame.columns
    part, n, ahead, halo, target = (_unused(frame, x) for x in ("_range", "_n", "_before", "_halo", "_target"))
    ranges = ranges or int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written, so that a range stays what it is when a task is run again.
    cut = materialize(frame.repartitionByRange(ranges, *series, order).withColumn(part, F.spark_partition_id()), "ranges")
    own = W.partitionBy(*series, part)
    by_series = W.partitionBy(*series).orderBy(part)
    # A row per series and range.  A range has a row at least, so the rows before it reach no more than rows - 1 ranges back.
    counts = cut.groupBy(*series, part).agg(F.count("*").alias(n))
    counts = counts.withColumn(ahead, F.coalesce(F.sum(n).over(by_series.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    borders = cut.withColumn(n, F.row_number().over(own.orderBy(F.desc(order)))).where(F.col(n) < rows)
    following = F.collect_list(F.struct(F.col(part).alias("to"), F.col(ahead).alias("ahead"))).over(
        by_series.rowsBetween(1, max(1, rows - 1)))
    at = {c: _unused(frame, f"_at_{c}") for c in [*series, part]}
    end, later = _unused(frame, "_end"), _unused(frame, "_later")
    ends = counts.select(
        *[F.col(c).alias(a) for c, a in at.items()], (F.col(ahead) + F.col(n)).alias(end), following.alias(later))
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(a)) for c, a in at.items()])
    # Row n from the end of its range stands n rows before the range's end; those between it and a later range count, too.
    near = F.filter(later, lambda x: x["ahead"] - F.col(end) + F.col(n) < rows)
    copies = borders.join(ends.where(F.size(later) > 0), on).withColumn(target, F.explode(near)).select(
        *columns, F.col(f"{target}.to").alias(part), F.lit(True).alias(halo))
    window = own.orderBy(order).rowsBetween(-(rows - 1), 0)
    both = cut.withColumn(halo, F.lit(False)).unionByName(copies)
    return both.withColumns({out: F.sum(c).over(window) for c, out in sums.items()}).where(~F.col(halo)).drop(halo, part)


def _unused(frame: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in frame.columns}:
        name = f"_{name}"
    return name

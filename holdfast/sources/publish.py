"""Publishing marts: overwrite, keyed snapshots, and SQL over the published views."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast import schemas
from holdfast.functions.rates import count_true, rows
from holdfast.session import materialize
from holdfast.sources.manifest import CODEC


def publish_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Replace a table and return it as read back."""
    if partition_by:
        # Few files per partition value, while a value with very many rows is split among writers.
        df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path, compression=CODEC)
    else:
        df.write.mode("overwrite").parquet(path, compression=CODEC)
    return df.sparkSession.read.parquet(path)


def publish_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Replace a catalog table whose files are split and sorted by a join key.

    Tables bucketed alike by ``customer_id`` join and aggregate on it without an exchange,
    which is worth one shuffle at publication for tables that are joined every day.
    """
    df.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


class SnapshotRejected(ValueError):
    """The rows do not identify one customer each."""


def publish_snapshot(df: DataFrame, root: str, key: str, version: str | None = None) -> str:
    """Write a new read-only version of a snapshot, once its key is proven unique and not NULL.

    The rows are written to the scratch folder and checked as written, so the check and the
    snapshot cannot differ, and a rejected version never comes below ``root``.  The name of
    the version stands in a table beside ``root``, which ``current_snapshot`` follows.
    """
    root = root.rstrip("/")
    version = version or uuid.uuid4().hex
    path = f"{root}/version={version}"
    rows_ = materialize(df, "snapshot")
    per_key = rows_.groupBy(key).agg(rows().alias("_n"))
    repeated, missing = per_key.agg(
        count_true(F.col("_n") > 1), count_true(F.col(key).isNull())
    ).first()
    if repeated or missing:
        raise SnapshotRejected(f"{repeated} repeated keys, {missing} NULL keys in {key}")
    rows_.write.mode("errorifexists").parquet(path)
    named = df.sparkSession.range(1).select(F.lit(version).alias("version"), F.lit(path).alias("path"))
    named.write.mode("overwrite").parquet(_pointer(root))
    return path


def _pointer(root: str) -> str:
    return f"{root.rstrip('/')}.current"


def current_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the version that was published last."""
    return spark.read.parquet(spark.read.parquet(_pointer(root)).first()["path"])


def register_marts(marts: dict[str, DataFrame]) -> None:
    """Make marts available to SQL under their published table names."""
    for name, frame in marts.items():
        frame.createOrReplaceTempView(schemas.MART_VIEWS.get(name, name))


def read_result(spark: SparkSession, statement: str, **arguments) -> DataFrame:
    """Run SQL over the registered marts; the caller decides when and how to act on the result."""
    return spark.sql(statement, args=arguments) if arguments else spark.sql(statement)

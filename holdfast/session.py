"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that results or skew handling depend on.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more exchange afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# A task handles about this much of a scan (up to MAX_SCAN_BYTES on large inputs) and of an exchange.
TASK_BYTES = 256 << 20
MAX_SCAN_BYTES = 1 << 30
EXCHANGE_BYTES = 1 << 30
# Shuffle blocks (scan tasks times exchange partitions) that the drivers and disks bear.
MAX_BLOCKS = 4_000_000_000

_local_root: str | None = None
_written: dict[str, list[str]] = {}  # scratch tables by application


def sized_for(input_bytes: int, cores: int, exchanged: float = 0.25) -> dict[str, str]:
    """Session settings for an input size: exchange partitions of about 1 GiB, within a bounded number of blocks.

    ``exchanged`` is the share of the input that the largest exchange carries: the marts exchange
    aggregates of pruned columns.  The adaptive planner merges partitions that turn out small.
    """
    scan = min(MAX_SCAN_BYTES, max(TASK_BYTES, -(-input_bytes // 100_000)))
    scan_tasks = max(1, -(-input_bytes // scan))
    partitions = max(2 * cores, -(-int(input_bytes * exchanged) // EXCHANGE_BYTES))
    partitions = max(1, min(partitions, MAX_BLOCKS // scan_tasks))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES // 2),
        "spark.sql.files.maxPartitionBytes": str(scan),
    }


def build_session(app_name: str = "holdfast", master: str | None = None, **settings: str) -> SparkSession:
    """Create (or reuse) a session with the engine's settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that somebody else created."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  A local session without
    that setting gets a temporary folder; a cluster session without it is an
    error, because executors could not see a folder of the driver's machine.
    """
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="holdfast-")
    return _local_root


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A path below the scratch root that no other run uses."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Evaluate a plan once into the shared scratch folder and return the written table.

    For results that later steps read more than once: without it, every reader would run
    the whole plan again.  The table survives the loss of executors.  ``codec`` compresses
    it otherwise than the session's setting.
    """
    path = scratch_dir(df.sparkSession, label)
    _written.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path, compression=codec)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(table: DataFrame) -> None:
    """Remove a table that ``materialize`` returned, once everything that reads it has been written."""
    spark = table.sparkSession
    written = _written.get(spark.sparkContext.applicationId, [])
    if table.scratch_path in written:
        written.remove(table.scratch_path)
        _delete(spark, table.scratch_path)


def clear_scratch(spark: SparkSession) -> int:
    """Remove the tables that ``materialize`` wrote for this application; returns how many.

    For the time after results have been written or collected: plans that still read those
    tables fail afterwards.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan, from file sizes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread_small(df: DataFrame, limit: int = 1 << 30, key: str | None = None) -> DataFrame:
    """Exchange a small table over all cores before costly work per row.

    A file with one row group is read by one task however many cores there are.  Tables
    above the limit have enough row groups and are left where they are.  With ``key`` rows are dealt by its hash.
    """
    if estimated_bytes(df) > limit:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *([key] if key else []))


def use_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` and iterative ML cut lineage in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{scratch_root(spark)}/checkpoints")

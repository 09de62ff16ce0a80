"""Session settings that the operators' memory bounds rest on, and the package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import holdfast
from pyspark.sql import DataFrame, SparkSession

from holdfast.session import estimated_bytes, prepare

#: Bytes that go to a Python worker at a time, besides those of a single longer row.
BATCH_BYTES = 8 << 20
#: Buckets of hashes: at least so many, and one for so many bytes of input files, so that one fits a task's memory.
LEAST_BUCKETS, BUCKET_BYTES = 32, 16 << 20
_shipped: set[str] = set()


def buckets_for(table: DataFrame) -> int:
    """Buckets among which the hashes of a table's words are dealt out; no fewer than exchange partitions."""
    partitions = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(LEAST_BUCKETS, partitions, estimated_bytes(table) // BUCKET_BYTES)


def unused(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has, in any case of its letters."""
    taken = {c.lower() for table in tables for c in table.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: their functions import it, and keep what they cache."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(holdfast.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="holdfast-")) / "holdfast.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(str(archive))  # the driver serves it
    _shipped.add(context.applicationId)


def bounded(spark: SparkSession) -> SparkSession:
    """The engine's settings, small batches between Spark and Python, and the package on the executors."""
    ship(spark)
    prepare(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark

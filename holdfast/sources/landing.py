"""Landing folders: one folder of JSON files per source.

Files are compressed, as the field names stand in every line; readers tell by the file name.  A compressed file
is read by one task, and the row limit bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS_PER_FILE = 1_000_000
CODEC = "gzip"


def land_json(df: DataFrame, folder: str, rows_per_file: int = ROWS_PER_FILE) -> str:
    """Replace a source's landing folder.

    File sizes are set by a row limit per file; the number of writers stays that of
    the plan, so a large source is not squeezed through a few tasks.
    """
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).json(folder, compression=CODEC)
    return folder


def land_increment(df: DataFrame, folder: str, rows_per_file: int = ROWS_PER_FILE) -> str:
    """Add one batch to a watched folder. Landing the same batch twice repeats its rows (see ``dedupe_latest``)."""
    df.write.mode("append").option("maxRecordsPerFile", rows_per_file).json(folder, compression=CODEC)
    return folder

"""Token counts of the documents in flat token files, by a separator scan.

A flat file is nothing but token ids of fixed width; an end-of-document id stands behind
each document, and there is no index.  The scan cuts the files into blocks, finds the ids
of each block in one vector comparison, and hands on one row per block: how many tokens it
has and where the separators are.  A running sum and a running maximum over a file's
blocks say how many documents and tokens came before and where the open document began,
so that documents that run over block boundaries are put together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from holdfast.llm.files import read_binary, write_binary

BLOCK_TOKENS = 1 << 20


def _width(id_type: str) -> np.dtype:
    return np.dtype(id_type).newbyteorder("<")


def _narrow(id_type: str, separator: int):
    def run(batches):
        for batch in batches:
            out = []
            for raw in batch.column(0):
                ids = np.frombuffer(raw.as_py() or b"", "<u4")
                if len(ids) and (ids.max() > np.iinfo(id_type).max or (ids == separator).any()):
                    raise ValueError(f"an id does not fit {id_type} or is the separator {separator}")
                out.append(ids.astype(_width(id_type)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["tokens"])

    return run


def write_flat(tokens: DataFrame, path: str, separator: int, id_type: str = "uint16", given: str = "uint32") -> None:
    """Write ``ids`` (little-endian, of the type ``given``) as flat files of ``id_type``, ``separator`` behind each row.

    Ids that are already of ``id_type`` are written as they are and must not hold the separator; others are checked.
    NULL is an empty document.  One file per task, its number in the name; rows stay in the order of the table.
    """
    if given == id_type:
        narrow = tokens.select(F.coalesce("ids", F.lit(b"")).alias("tokens"))
    else:
        narrow = tokens.select("ids").mapInArrow(_narrow(id_type, separator), "tokens binary")
    write_binary(narrow, "tokens", np.array([separator], _width(id_type)).tobytes(), path)


def _scan(separator: int, id_type: str, block_tokens: int):
    def run(batches):
        kind = _width(id_type)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = content.as_buffer()
                ids = np.frombuffer(raw, kind, len(raw) // kind.itemsize) if raw is not None else np.zeros(0, kind)
                for block, begin in enumerate(range(0, len(ids), block_tokens)):
                    part = ids[begin : begin + block_tokens]
                    at = np.flatnonzero(part == separator)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([path]), pa.array([block], pa.int64()), pa.array([len(part)], pa.int64()),
                        pa.array([at.tolist()], pa.list_(pa.int64()))], names=["path", "block", "n", "ends"])

    return run


def document_lengths(
    spark: SparkSession, path: str, separator: int, id_type: str = "uint16", block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Per document of the flat files below ``path``: ``path``, ``document`` (its place in the file, from 0),
    ``begin`` (its first token's place), ``n_tokens`` (without the separator).

    Separators next to each other enclose an empty document.  Tokens behind a file's last separator are a document,
    too.  An empty file has none; bytes at a file's end that are no whole id are left out.
    """
    blocks = read_binary(spark, path).mapInArrow(
        _scan(separator, id_type, block_tokens), "path string, block long, n long, ends array<long>")
    ahead = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n").over(ahead), F.lit(0))
    blocks = blocks.withColumn("base", base).withColumn(
        "last", F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1)))
    everything = W.partitionBy("path")
    blocks = blocks.select(
        "path", "block", "base", "ends", (F.col("base") + F.col("n")).alias("stop"),
        F.coalesce(F.sum(F.size("ends")).over(ahead), F.lit(0)).alias("documents"),
        # The open document begins behind the last separator of the blocks before.
        F.coalesce(F.max("last").over(ahead) + 1, F.lit(0)).alias("open"),
        F.max("block").over(everything).alias("final"),
        F.coalesce(F.max("last").over(everything) + 1, F.lit(0)).alias("tail"),
    )
    ends = F.transform("ends", lambda e: e + F.col("base"))
    # What stands behind the last separator of the file ends with the file.
    rest = F.when((F.col("block") == F.col("final")) & (F.col("tail") < F.col("stop")), F.array("stop"))
    cuts = F.concat(ends, F.coalesce(rest, F.array().cast("array<long>")))
    found = blocks.select("path", "documents", "open", cuts.alias("cuts")).select(
        "path", "documents", "open", "cuts", F.posexplode("cuts").alias("i", "end"))
    begin = F.when(F.col("i") == 0, F.col("open")).otherwise(F.expr("cuts[i - 1]") + 1)
    return found.select("path", (F.col("documents") + F.col("i")).alias("document"), begin.alias("begin"),
                        (F.col("end") - begin).alias("n_tokens"))


def file_number(column: str = "path"):
    """The number that the writer gave a file."""
    return F.regexp_extract(column, r"part-(\d+)", 1).cast("long")

"""Exact nearest-vector search that skips what cannot be near.

Vectors are dealt out to cells around centres that are fitted on a bounded sample; every
vector is in the index.  A cell knows the range of its vectors' angles to its centre.  By the
triangle inequality of angles, a vector at angle ``a`` to its centre is no nearer to a question
than the difference of ``a`` and the question's own angle to that centre.  A first pass searches
the cells that are nearest to each question, until they hold ``k`` vectors; the ``k``-th distance
found bounds the second pass, which leaves out cells, and vectors of a cell, beyond it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from holdfast import rules
from holdfast.operators import search
from holdfast.operators.ranks import topk_per_key
from holdfast.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors on which the centres are fitted, at most; rounds of fitting; cells, at most.
SAMPLE, ROUNDS, MAX_CELLS = 16_384, 8, 1_024
#: Distances are compared after rounding; angles carry the error of their arc cosine.
SLACK = 10.0 ** -search.DISTANCE_PLACES
ANGLE_SLACK = 1e-6


@dataclass
class VectorIndex:
    """The vectors by cell, written below ``path``, and what bounds the cells."""

    spark: SparkSession
    path: str
    schema: T.StructType  # note_id, v, angle, cell
    centres: np.ndarray  # unit vectors, one per cell
    rows: np.ndarray  # vectors per cell
    low: np.ndarray  # least and largest angle to the centre
    high: np.ndarray
    report: dict = field(default_factory=dict)  # of the last search: vectors, pairs, pairs_scanned, share

    def read(self, cells: np.ndarray) -> DataFrame:
        """Some cells; the others' folders are not opened."""
        table = self.spark.read.schema(self.schema).parquet(self.path)
        return table.where(F.col("cell").isin([int(c) for c in cells]))


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres by rounds of spherical k-means, from the first vectors of the sample."""
    centres = sample[:cells].copy()
    for _ in range(ROUNDS):
        nearest = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1)
        centres[norms > 0] = sums[norms > 0] / norms[norms > 0][:, None]
    return centres


def _checked(notes: DataFrame, note_id: str, vector: str, width: int) -> DataFrame:
    """Notes with a vector; one of another length, or with a NULL in it, is an error."""
    v = F.col(vector)
    whole = (F.size(v) == width) & ~F.exists(v, lambda x: x.isNull())
    error = F.raise_error(F.lit(f"a note's vector has not {width} numbers")).cast(notes.schema[vector].dataType)
    return notes.where(v.isNotNull()).select(F.col(note_id).alias("note_id"), F.when(whole, v).otherwise(error).alias("v"))


def _assign(centres: np.ndarray, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, search.STEP_CELLS // len(centres))
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                vectors = _matrix(batch.column(1), batch.num_rows)
                with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                    close = _units(vectors) @ centres.T
                cell = np.argmax(close, axis=1)
                angle = np.arccos(np.clip(close[np.arange(len(cell)), cell], -1.0, 1.0))
                use = pa.array(np.isfinite(angle))  # a zero vector has no direction
                columns = [batch.column(0), batch.column(1), pa.array(angle), pa.array(cell.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([c.filter(use) for c in columns], schema=schema)

    return run


def build_index(
    notes: DataFrame, path: str, note_id: str = "note_id", vector: str = "embedding", cells: int | None = None,
    sample: int = SAMPLE,
) -> VectorIndex | None:
    """Write the index of ``notes`` below ``path``, a folder per cell; nothing if no note has a vector.

    Centres are fitted on the ``sample`` vectors whose ids have the smallest hashes; there are as many as the square
    root of the vectors, up to ``MAX_CELLS`` and a fourth of the sample.  Every vector with a direction is indexed, rows
    that repeat an id included; NULL and zero vectors, and such with numbers that are not finite, are near to nothing.
    """
    spark = notes.sparkSession
    some = notes.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(note_id)).limit(sample).select(vector).collect()
    vectors = [np.array(r[0], dtype=np.float64) for r in some if None not in r[0]]
    width = max(map(len, vectors), default=0)
    vectors = [v for v in vectors if len(v) == width and np.isfinite(v).all() and v.any()]
    if not vectors:
        return None
    units = _units(np.array(vectors))
    wanted = cells or min(MAX_CELLS, int(notes.count() ** 0.5))
    centres = _fit(units, max(1, min(wanted, -(-len(units) // 4))))
    schema = T.StructType([
        T.StructField("note_id", notes.schema[note_id].dataType), T.StructField("v", notes.schema[vector].dataType),
        T.StructField("angle", T.DoubleType()), T.StructField("cell", T.IntegerType()),
    ])
    placed = _checked(notes, note_id, vector, width).mapInArrow(_assign(centres, to_arrow_schema(schema)), schema)
    # Few files a cell; a very large cell is split among writers.  In order of the angle, so that row groups have bounds.
    placed.hint("rebalance", "cell").sortWithinPartitions("cell", "angle").write.partitionBy("cell").parquet(path)
    rows, low, high = np.zeros(len(centres), np.int64), np.zeros(len(centres)), np.zeros(len(centres))
    sizes = spark.read.schema(schema).parquet(path).groupBy("cell").agg(F.count("*"), F.min("angle"), F.max("angle"))
    for cell, n, least, most in sizes.collect():  # a row per cell
        rows[cell], low[cell], high[cell] = n, least, most
    return VectorIndex(spark, path, schema, centres, rows, low, high)


def _scan(index: VectorIndex, wanted: np.ndarray, ids: list, matrix: np.ndarray, reach: np.ndarray, k: int, result):
    """The best ``k`` per question and task among the cells that ``wanted`` (question, cell) marks.

    ``reach`` has for each question the angle beyond which nothing is needed.
    """
    arrow = to_arrow_schema(result)
    units = _units(matrix)
    shared = index.spark.sparkContext.broadcast((ids, matrix, wanted, reach, _angles(units, index.centres)))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, questions, use, limit, off = shared.value
        best: dict[int, tuple] = {}
        for batch in batches:
            cell = np.asarray(batch.column(3))
            edges = np.flatnonzero(np.diff(cell)) + 1
            for low, high in zip([0, *edges], [*edges, len(cell)]):
                for q in np.array_split(np.flatnonzero(use[:, cell[low]]), max(1, len(questions) // 256)):
                    if len(q):
                        _merge(best, batch.slice(low, high - low), q, questions, limit[q] - off[q, cell[low]],
                               limit[q] + off[q, cell[low]], k)
        if best:
            found = sorted(best)
            yield search._nearest_batch([best[q] for q in found], [names[q] for q in found], arrow)

    return index.read(np.flatnonzero(wanted.any(axis=0))).select("note_id", "v", "angle", "cell").mapInArrow(nearest, result)


def _merge(best: dict, batch: pa.RecordBatch, asked: np.ndarray, questions: np.ndarray, minus: np.ndarray, plus: np.ndarray, k: int):
    """Merge a piece of one cell into the best of the questions asked.

    A vector is in reach if its angle to the centre differs from the question's by no more than the limit.
    """
    angle = np.asarray(batch.column(2))
    near = (angle >= (-minus).min()) & (angle <= plus.max())
    if not near.any():
        return
    part = batch.filter(pa.array(near))
    step = max(1, search.STEP_CELLS // len(asked))
    for i in range(0, part.num_rows, step):
        some = part.slice(i, step).select([0, 1])
        held = [best.get(q, (np.array(some.column(0).slice(0, 0).to_pylist()), np.zeros(0))) for q in asked]
        empty = all(len(h[1]) == 0 for h in held)
        merged = search._keep_nearest(None if empty else _same_kind(held, some), some, questions[asked], k)
        best.update(zip(asked, merged))


def _same_kind(held: list, some: pa.RecordBatch) -> list:
    """Empty lists of ids get the type of the ids."""
    kind = np.array(some.column(0).to_pylist()).dtype
    return [(ids if len(ids) else ids.astype(kind), d) for ids, d in held]


def _angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1.0, 1.0))


def search_index(
    index: VectorIndex | None, questions: DataFrame, k: int = rules.SEARCH_LEG_SIZE, vector: str = "embedding",
    question_id: str = "question_id",
) -> DataFrame:
    """The rows of :func:`~holdfast.operators.search.vector_topk` over the notes of the index.

    Questions come in blocks, each with its two passes; of a block its ``k``-th distances come to the driver.  Questions
    that are NULL or have no direction have no rows; one of another length than the notes' is an error.  ``index.report``
    then says how many of all (note, question) pairs lay in cells that were read for the question.
    """
    kind = index.schema["note_id"].dataType if index else T.LongType()
    result = T.StructType([
        T.StructField("question_id", questions.schema[question_id].dataType), T.StructField("note_id", kind),
        T.StructField("distance", T.DoubleType()),
    ])
    order, local = [F.asc("distance"), F.asc("note_id")], None
    scanned = asked_pairs = 0
    for ids, vectors in search._blocks(questions.select(question_id, vector).where(F.col(vector).isNotNull())) if index else ():
        if any(len(v) != index.centres.shape[1] or None in v for v in vectors):
            raise ValueError(f"a question's vector has not {index.centres.shape[1]} numbers")
        matrix = np.array(vectors, dtype=np.float64)
        usable = np.isfinite(matrix).all(axis=1) & matrix.any(axis=1)
        ids, matrix = [i for i, use in zip(ids, usable) if use], matrix[usable]
        if not ids:
            continue
        off = _angles(_units(matrix), index.centres)
        gap = np.maximum(0.0, np.maximum(off - index.high, index.low - off))
        gap[:, index.rows == 0] = np.inf
        # The cells nearest to a question that hold k vectors between them.
        by_angle = np.argsort(np.where(index.rows > 0, off, np.inf), axis=1, kind="stable")
        before = np.cumsum(index.rows[by_angle], axis=1) - index.rows[by_angle]
        first = np.zeros(off.shape, bool)
        np.put_along_axis(first, by_angle, before < k, axis=1)
        first &= index.rows > 0
        number = [*range(len(ids))]  # ids may repeat or be NULL
        counted = T.StructType([T.StructField("question_id", T.LongType()), *result.fields[1:]])
        probed = topk_per_key(
            _scan(index, first, number, matrix, np.full(len(ids), np.inf), k, counted), ["question_id"], order, k)
        probed = materialize(probed.drop("position"), "probed")
        bound = np.full(len(ids), np.inf)
        for q, n, last in probed.groupBy("question_id").agg(F.count("*"), F.max("distance")).collect():
            if n >= k:
                bound[q] = last
        reach = np.where(bound < 2.0 - SLACK, np.arccos(np.clip(1.0 - bound - SLACK, -1.0, 1.0)), np.inf) + ANGLE_SLACK
        second = (gap <= reach[:, None]) & (index.rows > 0) & ~first
        hits = probed.unionByName(_scan(index, second, number, matrix, reach, k, counted)) if second.any() else probed
        names = questions.sparkSession.createDataFrame([*zip(number, ids)], T.StructType([
            T.StructField("number", T.LongType()), result.fields[0]]))
        top = topk_per_key(hits.withColumnRenamed("question_id", "number"), ["number"], order, k).drop("position")
        top = top.withColumn("vector_rank", F.rank().over(W.partitionBy("number").orderBy("distance")))
        top = top.join(names, "number").select(*result.fieldNames(), "vector_rank")
        local = top if local is None else local.unionByName(top)
        scanned += int(((first | second) * index.rows).sum())
        asked_pairs += len(ids) * int(index.rows.sum())
    if index:
        index.report = {"vectors": int(index.rows.sum()), "pairs": asked_pairs, "pairs_scanned": scanned,
                        "share": scanned / asked_pairs if asked_pairs else 0.0}
    empty = T.StructType([*result.fields, T.StructField("vector_rank", T.IntegerType())])
    return local if local is not None else questions.sparkSession.createDataFrame([], empty)

"""Note search: nearest vectors, keyword ranking, and their fusion."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from holdfast import rules
from holdfast.functions.rates import rows
from holdfast.functions.text import pieces, sections, spaced_words, term_count, word_count
from holdfast.operators.ranks import topk_per_key
from holdfast.session import materialize

# The helpers below travel inside the task's closure, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Questions that every task holds at a time; more are searched in several passes over the notes.
BLOCK_QUESTIONS = 4_096
# Distances of one step: notes times questions.
STEP_CELLS = 1 << 22
DISTANCE_PLACES = 6
BM25_K1 = 1.2
BM25_B = 0.75


def vector_topk(
    notes: DataFrame, questions: DataFrame, k: int = rules.SEARCH_LEG_SIZE, note_id: str = "note_id",
    vector: str = "embedding", question_id: str = "question_id",
) -> DataFrame:
    """The ``k`` nearest notes of each question by cosine distance, with competition rank.

    Each task multiplies its Arrow batches with the question matrix and keeps only its
    own best ``k`` per question, so no (question, note) pair beyond those leaves a task.
    Distances are rounded before they are compared; the note id breaks ties.  Questions
    come in blocks of ``BLOCK_QUESTIONS``, each a pass over the notes of its own.

    Notes and questions without a vector are left out.  A vector of another length than
    the first question's, or with a NULL in it, is an error.
    """
    asked = questions.select(question_id, vector).where(F.col(vector).isNotNull())
    result = T.StructType([
        T.StructField("question_id", questions.schema[question_id].dataType),
        T.StructField("note_id", notes.schema[note_id].dataType),
        T.StructField("distance", T.DoubleType()),
    ])
    local, size = None, None
    for ids, vectors in _blocks(asked):
        size = size if size is not None else len(vectors[0])
        if any(len(v) != size or None in v for v in vectors):
            raise ValueError(f"a question's vector has not {size} numbers")
        found = _search_block(notes, note_id, vector, ids, np.array(vectors, dtype=np.float64), k, result)
        local = found if local is None else local.unionByName(found)
    if local is None:
        local = notes.sparkSession.createDataFrame([], result)
    order = [F.asc("distance"), F.asc("note_id")]
    top = topk_per_key(local, ["question_id"], order, k, "position")
    by_distance = W.partitionBy("question_id").orderBy("distance")
    return top.withColumn("vector_rank", F.rank().over(by_distance)).drop("position")


def _blocks(asked: DataFrame) -> Iterator[tuple[list, list]]:
    """The questions, a bounded block at a time."""
    ids, vectors = [], []
    for row in asked.toLocalIterator():
        ids.append(row[0])
        vectors.append(row[1])
        if len(ids) == BLOCK_QUESTIONS:
            yield ids, vectors
            ids, vectors = [], []
    if ids:
        yield ids, vectors


def _search_block(
    notes: DataFrame, note_id: str, vector: str, ids: list, matrix: np.ndarray, k: int, result: T.StructType
) -> DataFrame:
    arrow = to_arrow_schema(result)
    shared = notes.sparkSession.sparkContext.broadcast((ids, matrix))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted = shared.value
        best, step = None, max(1, STEP_CELLS // len(names))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                best = _keep_nearest(best, batch.slice(i, step), wanted, k)
        if best is not None:
            yield _nearest_batch(best, names, arrow)

    v = F.col(vector)
    whole = (F.size(v) == matrix.shape[1]) & ~F.exists(v, lambda x: x.isNull())
    error = F.raise_error(F.lit(f"a note's vector has not {matrix.shape[1]} numbers")).cast(notes.schema[vector].dataType)
    checked = notes.where(v.isNotNull()).select(
        F.col(note_id).alias("note_id"), F.when(whole, v).otherwise(error).alias("v"))
    return checked.mapInArrow(nearest, result)


def _keep_nearest(best, batch: pa.RecordBatch, wanted: np.ndarray, k: int):
    """Merge a batch into the best ``k`` per question; both are (ids, distances) per question."""
    values = batch.column(1)
    vectors = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
    ids = np.array(batch.column(0).to_pylist())
    norms = np.linalg.norm(vectors, axis=1)[:, None] * np.linalg.norm(wanted, axis=1)[None, :]
    with np.errstate(invalid="ignore", divide="ignore"):
        distances = np.round(1.0 - (vectors @ wanted.T) / norms, DISTANCE_PLACES) + 0.0
    merged = []
    for q in range(wanted.shape[0]):
        d, i = distances[:, q], ids
        valid = ~np.isnan(d)
        d, i = d[valid], i[valid]
        if best is not None:
            i, d = np.concatenate([best[q][0], i]), np.concatenate([best[q][1], d])
        if len(d) > k:  # keep all rows up to the k-th distance, then order those by (distance, id)
            near = d <= np.partition(d, k - 1)[k - 1]
            i, d = i[near], d[near]
        order = np.lexsort((i, d))[:k]
        merged.append((i[order], d[order]))
    return merged


def _nearest_batch(best, names: list, schema: pa.Schema) -> pa.RecordBatch:
    repeated = [name for name, (ids, _) in zip(names, best) for _ in range(len(ids))]
    ids = [note for found, _ in best for note in found.tolist()]
    distances = np.concatenate([d for _, d in best])
    columns = [pa.array(c, type=f.type) for c, f in zip((repeated, ids, distances), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def keyword_topk(
    notes: DataFrame, terms: Sequence[str] = rules.SEARCH_TERMS, k: int = rules.SEARCH_LEG_SIZE,
    note_id: str = "note_id", text: str = "text",
) -> DataFrame:
    """The ``k`` best notes for any of the terms by BM25, with competition rank.

    Terms are counted inside each row, so no token is ever shuffled; the corpus
    statistics are one row that is broadcast back.
    """
    worded = notes.select(F.col(note_id).alias("note_id"), spaced_words(F.col(text)).alias("_spaced"))
    # The counts, a few numbers per note, are read twice; the texts are read once.
    counted = materialize(worded.select(
        "note_id", word_count(F.col("_spaced")).alias("_words"),
        *[term_count(F.col("_spaced"), term).alias(f"_tf{i}") for i, term in enumerate(terms)],
    ), "word_counts")
    corpus = counted.agg(
        rows().alias("_n"), F.sum("_words").alias("_all_words"),
        *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))],
    )
    any_hit = F.greatest(*[F.col(f"_tf{i}") for i in range(len(terms))], F.lit(0)) > 0
    length_norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("_words") * F.col("_n") / F.col("_all_words"))
    score = F.lit(0.0)
    for i in range(len(terms)):
        df, tf = F.col(f"_df{i}"), F.col(f"_tf{i}")
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (BM25_K1 + 1) / (tf + length_norm)
    ranked = (
        counted.where(any_hit).crossJoin(F.broadcast(corpus))
        .select("note_id", F.round(score, 6).alias("score"))
        .orderBy(F.desc("score"), "note_id").limit(k)
    )
    return ranked.withColumn("text_rank", F.rank().over(W.orderBy(F.desc("score"))))


def hybrid_rrf(
    vector_hits: DataFrame, text_hits: DataFrame, questions: DataFrame | None = None, k: int = 5,
    offset: int = rules.RRF_OFFSET, notes: DataFrame | None = None, note_id: str = "note_id", text: str = "text",
) -> DataFrame:
    """Reciprocal rank fusion of the two lists of each question; a missing leg adds nothing.

    The keyword list does not depend on the question, so it is repeated for each.  ``questions``
    (``question_id``) names those that may have no vector hit.  With ``notes`` the result has
    their ``note_text``.
    """
    def as_map(rank: str):  # note -> rank; a list has one short leg, so the map is small
        return F.map_from_entries(F.collect_list(F.struct("note_id", rank)))

    def share(rank: str):
        return F.coalesce(1.0 / (F.lit(float(offset)) + F.col(rank)), F.lit(0.0))

    by_vector = vector_hits.groupBy("question_id").agg(as_map("vector_rank").alias("_v"))
    if questions is not None:
        by_vector = questions.select("question_id").distinct().join(by_vector, "question_id", "left")
    by_text = text_hits.agg(as_map("text_rank").alias("_t"))
    found = F.coalesce(F.map_keys("_v"), F.array().cast(f"array<{text_hits.schema['note_id'].dataType.simpleString()}>"))
    either = F.explode(F.array_union(found, F.map_keys("_t")))
    fused = (
        by_vector.crossJoin(F.broadcast(by_text)).select("question_id", "_v", "_t", either.alias("note_id"))
        .select(
            "question_id", "note_id", F.try_element_at("_v", F.col("note_id")).alias("vector_rank"),
            F.try_element_at("_t", F.col("note_id")).alias("text_rank"),
        )
        .withColumn("rrf_score", F.round(share("vector_rank") + share("text_rank"), 8))
    )
    top = topk_per_key(fused, ["question_id"], [F.desc("rrf_score"), F.asc("note_id")], k)
    if notes is None:
        return top
    return top.join(notes.select(F.col(note_id).alias("note_id"), F.col(text).alias("note_text")), "note_id", "left")


def chunk_corpus(documents: DataFrame, doc_id: str, text: str, max_chars: int = 1_200) -> DataFrame:
    """Section rows for retrieval; a section longer than ``max_chars`` gives several rows."""
    by_section = documents.select(doc_id, F.posexplode(sections(F.col(text))).alias("section_no", "_section"))
    return by_section.select(
        doc_id, "section_no", F.posexplode(pieces(F.col("_section"), max_chars)).alias("piece_no", "chunk_text")
    ).withColumn("n_chars", F.char_length("chunk_text"))

"""The index against the scan of all vectors."""

import numpy as np
import pytest

from holdfast.operators import search, vector_index

KINDS = "note_id long, embedding array<float>"


def both(spark, notes, asked, path, k=15, **options):
    index = vector_index.build_index(notes, str(path / "index"), **options)
    rows = lambda frame: sorted(
        (repr(r.question_id), r.vector_rank, r.distance, r.note_id) for r in frame.select(
            "question_id", "vector_rank", "distance", "note_id").collect())
    return rows(vector_index.search_index(index, asked, k)), rows(search.vector_topk(notes, asked, k)), index


def test_same_as_the_scan_and_reads_less(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24)) * 3
    vectors = (centres[rng.integers(0, 40, 6_000)] + rng.normal(size=(6_000, 24)) * 0.4).astype(np.float32)
    notes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], KINDS)
    asked = notes.where("note_id % 50 = 0").withColumnRenamed("note_id", "question_id")
    found, scanned, index = both(spark, notes, asked, tmp_path, cells=64)
    assert found == scanned and len(found) == 120 * 15
    assert index.report["vectors"] == 6_000 and index.report["pairs"] == 120 * 6_000
    assert index.report["share"] < 0.3


@pytest.mark.parametrize("k", [1, 3, 500])
def test_ties_and_even_vectors(spark, tmp_path, k):
    rng = np.random.default_rng(k)
    vectors = rng.integers(-1, 2, size=(300, 3)).astype(float)  # many equal, opposite and zero vectors
    notes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], KINDS)
    asked = notes.where("note_id % 50 = 0").withColumnRenamed("note_id", "question_id")
    found, scanned, _ = both(spark, notes, asked, tmp_path, k, cells=9)
    assert found == scanned


def test_blocks_of_questions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_QUESTIONS", 3)
    rng = np.random.default_rng(1)
    notes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 4)))], KINDS)
    asked = notes.where("note_id % 25 = 0").withColumnRenamed("note_id", "question_id")
    found, scanned, _ = both(spark, notes, asked, tmp_path, 5)
    assert found == scanned and len(found) == 8 * 5


def test_edges(spark, tmp_path):
    none = spark.createDataFrame([], KINDS)
    asked = none.withColumnRenamed("note_id", "question_id")
    assert vector_index.build_index(none, str(tmp_path / "none")) is None
    assert vector_index.search_index(None, asked).count() == 0
    notes = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (None, [1.0, 1.0])], KINDS)
    index = vector_index.build_index(notes, str(tmp_path / "few"))
    assert index.rows.sum() == 3
    assert vector_index.search_index(index, asked).count() == 0
    questions = spark.createDataFrame([(7, [1.0, 0.0]), (8, None), (9, [0.0, 0.0])], "question_id long, embedding array<float>")
    found = vector_index.search_index(index, questions, 1).collect()
    assert [(r.question_id, r.note_id, r.distance) for r in found] == [(7, 1, 0.0)]
    with pytest.raises(ValueError):
        vector_index.search_index(index, spark.createDataFrame([(1, [1.0])], "question_id long, embedding array<float>"))
    with pytest.raises(Exception, match="has not 2 numbers"):
        vector_index.build_index(notes.unionByName(spark.createDataFrame([(9, [1.0])], KINDS)), str(tmp_path / "bad"))

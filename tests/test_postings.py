"""The posting lists against BM25 by a scan of every note."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from holdfast.operators import postings
from holdfast.operators.search import BM25_B, BM25_K1

NOTES, ASKED = "note_id long, text string", "question_id long, text string"


def scan(notes, questions, k):
    """Every note scored for every question, word by word."""
    words = lambda text: re.findall(r"[^\W_]+", (text or "").lower())
    corpus = [(i, Counter(words(t))) for i, t in notes if i is not None]
    n, total = len(corpus), sum(sum(c.values()) for _, c in corpus)
    df = Counter(w for _, c in corpus for w in c)
    out = []
    for q, text in questions:
        scored = []
        for i, c in corpus:
            hit = [w for w in set(words(text)) if c[w]]
            norm = BM25_K1 * (1 - BM25_B + BM25_B * sum(c.values()) * n / max(1, total))
            score = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (BM25_K1 + 1) / (c[w] + norm) for w in hit)
            if hit:
                scored.append((-round(score, 6), i))
        scored.sort()
        out += [(q, i, -s, 1 + sum(t < s for t, _ in scored)) for s, i in scored[:k]]
    return sorted(out)


def both(spark, notes, questions, path, k=15, **options):
    index = postings.build_postings(spark.createDataFrame(notes, NOTES), str(path / "index"), **options)
    asked = spark.createDataFrame(questions, ASKED)
    found = sorted(tuple(r) for r in postings.search_postings(index, asked, k).select(
        "question_id", "note_id", "score", "text_rank").collect())
    return index, asked, found, scan(notes, questions, k)


def same(found, expected):
    assert [(q, i, r) for q, i, _, r in found] == [(q, i, r) for q, i, _, r in expected]
    assert [s for *_, s, _ in found] == pytest.approx([s for *_, s, _ in expected], abs=2e-6)


def zipf_notes(n, seed=3):
    rng = np.random.default_rng(seed)
    draw = lambda size: " ".join(f"w{min(int(x), 3_000)}" for x in rng.zipf(1.3, size))
    return [(i, draw(int(rng.integers(1, 120)))) for i in range(n)]


def test_same_as_the_scan_and_reads_less(spark, tmp_path):
    notes = zipf_notes(3_000)
    questions = [(1, "w1 w2 w700"), (2, "w1"), (3, "w1 w5 w9 w40 w41"), (4, "w2 W2 w900, w3"), (5, "unheard of")]
    index, asked, found, expected = both(spark, notes, questions, tmp_path)
    same(found, expected)
    plan = postings.search_plan(index, asked).groupBy().sum("notes", "notes_read").first()
    assert plan[1] < 0.6 * plan[0]
    # A common word alone: little beyond the k best is read, whatever the length of its list.
    alone = postings.search_plan(index, asked.where("question_id = 2")).first()
    assert alone["notes"] > 2_500 and alone["notes_read"] < 0.2 * alone["notes"]


def test_scan_names_folders_and_bands(spark, tmp_path):
    index, asked, *_ = both(spark, zipf_notes(400), [(1, "w1 w300")], tmp_path)
    plan = postings.search_plan(index, asked)
    scanned = postings._scan(index, plan, "cut")
    text = scanned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in text and "GreaterThanOrEqual(band" in text
    assert len(scanned.inputFiles()) <= index.lists().rdd.getNumPartitions() * 2
    assert scanned.select("term").distinct().count() <= 2


@pytest.mark.parametrize("k", [1, 4, 200])
def test_ties_and_many_questions(spark, tmp_path, k, monkeypatch):
    monkeypatch.setattr(postings, "PUSHED_WORDS", 3)  # the join alone chooses the words
    notes = [(i, ["a b", "a", "b c", "", "a a b"][i % 5]) for i in range(60)]
    questions = [(1, "a"), (2, "b a"), (3, "c"), (4, "a b c"), (5, "")]
    _, _, found, expected = both(spark, notes, questions, tmp_path, k, buckets=4)
    same(found, expected)


def test_edges(spark, tmp_path):
    notes = [(1, None), (2, ""), (3, "Größe, größe! 7"), (None, "größe"), (4, "x " * 5_000 + "7"), (5, "...")]
    questions = [(1, "GRÖSSE größe"), (2, None), (3, "7 x"), (3, "größe"), (4, "?!")]
    _, _, found, _ = both(spark, notes, questions, tmp_path)
    same(found, scan(notes, [(1, "größe"), (3, "7 x größe")], 15))
    none = postings.build_postings(spark.createDataFrame([], NOTES), str(tmp_path / "none"))
    assert none.notes == 0
    assert postings.search_postings(none, spark.createDataFrame(questions, ASKED)).count() == 0


def test_questions_in_blocks_leave_little_behind(spark, tmp_path, monkeypatch):
    """Many questions are answered block by block; partial scores and counted words are removed."""
    from holdfast import session

    monkeypatch.setattr(postings, "BLOCK_POSTINGS", 700, raising=False)
    before = set(session._written.get(spark.sparkContext.applicationId, []))
    notes = zipf_notes(200)
    questions = [(q, f"w{q % 7 + 1} w{q % 40 + 2}") for q in range(30)]
    _, _, found, expected = both(spark, notes, questions, tmp_path, 5)
    same(found, expected)
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(session._written[spark.sparkContext.applicationId]) - before}
    assert not left & {"note_words", "note_lengths", "banded", "partial_scores", "near_notes"}


def test_a_note_in_several_rows_is_one_note(spark, tmp_path):
    """Its words are counted together, whether or not some of its rows have none."""
    index = postings.build_postings(
        spark.createDataFrame([(1, "a b"), (1, None), (1, "a"), (2, ""), (2, "b")], NOTES), str(tmp_path / "index"))
    assert (index.notes, index.words) == (2, 4)
    assert sorted((r.term, r.note_id, r.tf, r.words) for r in index.lists().collect()) == [("a", 1, 2, 3), ("b", 1, 1, 3), ("b", 2, 1, 1)]


def test_a_search_hands_on_the_best_and_not_every_pair(spark, tmp_path, monkeypatch):
    """Of the pairs of questions and notes with a common word few leave the task of the note."""
    written, materialize = {}, postings.materialize

    def counting(df, label, *options):
        table = materialize(df, label, *options)
        written[label] = written.get(label, 0) + table.count()
        return table

    monkeypatch.setattr(postings, "materialize", counting)
    rng = np.random.default_rng(8)
    notes = zipf_notes(1_500, 5)
    questions = [(q, " ".join(f"w{int(x)}" for x in rng.integers(1, 60, 8))) for q in range(40)]
    _, _, found, expected = both(spark, notes, questions, tmp_path, 5)
    same(found, expected)
    terms = [set(t.split()) for _, t in notes]
    pairs = sum(bool(set(t.split()) & own) for _, t in questions for own in terms)
    assert written["partial_scores"] < 0.2 * pairs


def test_steps_and_blocks_of_any_size(spark, tmp_path, monkeypatch):
    notes = zipf_notes(150, 9)
    questions = [(q, f"w{q % 5 + 1} w{q % 11 + 1} w{q % 70 + 3}") for q in range(25)]
    for n, (cells, at_once, block, words) in enumerate([(1, 1, 1_000, 1_000), (300, 7, 13, 60)]):
        for name, value in (("STEP_CELLS", cells), ("STEP_POSTINGS", at_once), ("BLOCK_QUESTIONS", block), ("BLOCK_WORDS", words)):
            monkeypatch.setattr(postings, name, value)
        (tmp_path / str(n)).mkdir()
        _, _, found, expected = both(spark, notes, questions, tmp_path / str(n), 3)
        same(found, expected)

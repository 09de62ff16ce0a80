import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast import rules
from holdfast.functions.rates import null_to_zero
from holdfast.functions.text import note_sentiment, spaced_words, term_count, topic_label, whole_word, word_count
from holdfast.operators import conversation, notes, search


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id int, text string")


def test_sentiment(spark):
    cases = {
        "Ready to CANCEL but loyal": "negative", "A walkthrough of the bill": "negative", "wants a mismatch fixed": "at_risk",
        "Loyal customer": "at_risk", "asked about a bill": "neutral", "": "neutral", "will port out": "negative",
    }
    frame = texts(spark, list(cases))
    assert {r.text: r.s for r in frame.select("text", note_sentiment(F.col("text")).alias("s")).collect()} == cases
    triage = notes.sentiment_triage(
        notes.label_sentiment(frame, "text").withColumn("case_id", F.col("id") % 2), "case_id").collect()
    assert sum(r.notes for r in triage) == 7 and triage[0].negative >= triage[1].negative


def test_topic_rules(spark):
    cases = {
        "my internet is so slow in the evenings": "Slow Speed / Performance",
        "my contract is ending and they offered free install": "Promo / Contract Expiration",
        "I was CHARGED twice this month": "Billing Dispute", "hello": None, "": None, None: None,
        "slow and charged": "Billing Dispute",  # a tie: the earlier label
    }
    frame = texts(spark, list(cases)).select("text", topic_label(F.col("text")).alias("topic"))
    assert {r.text: r.topic for r in frame.collect()} == cases


def test_whole_word(spark):
    frame = texts(spark, ["der", "oder", "éder", "der9", "(der)", "DER x", "ader der"])
    hits = {r.text for r in frame.where(F.col("text").rlike("(?i)" + whole_word("der"))).collect()}
    assert hits == {"der", "(der)", "DER x", "ader der"}


def test_word_counts(spark):
    values = ["", "  ...  ", "one", "One one, ONE-two éone", "a b\nc\td", "9 lives"]
    spaced = spaced_words(F.col("text"))
    frame = texts(spark, values).select("text", word_count(spaced).alias("n"), term_count(spaced, "one").alias("one"))
    for r in frame.collect():
        words = re.findall(r"[^\W_]+", r.text.lower())
        assert (r.n, r.one) == (len(words), words.count("one")), r.text


def answer(spark, *payloads):
    frame = spark.createDataFrame([(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "i int, p string")
    return [r[1] for r in frame.select("i", conversation.final_answer(F.col("p"))).orderBy("i").collect()]


def message(*texts_, kind="output_text"):
    return {"type": "message", "content": [{"type": kind, "text": t} for t in texts_]}


def test_final_answer(spark):
    marker = message("<name>analyst\n</name>")
    assert answer(
        spark,
        {"output": [message("first"), marker, message(" sec", "ond "), {"type": "call", "content": [{"type": "output_text", "text": "x"}]}]},
        {"output": [marker, message("  ")], "content": "plain"},
        {"output": None, "content": {"a": 1}, "choices": [{"message": {"content": "chosen"}}]},
        {"output": [], "content": ["x"]},
        {"choices": [{"message": {}}]},
        {"content": ""},
        {"output": [message("hidden", kind="reasoning"), message("say <name>x</name>")]},
        {"choices": []},
        "not json",
    ) == ["second", "plain", "chosen", rules.NO_ANSWER, "", "", "say <name>x</name>", rules.NO_ANSWER, rules.NO_ANSWER]


def test_conversations(spark):
    rows = [("c1", i, "user" if i % 2 == 0 else "assistant", f"  message {i} " + "x" * 70) for i in range(12)]
    rows += [("c2", 0, "assistant", "hello"), ("c2", 1, "user", "   "), ("c2", 2, "user", "a question"), ("c3", 0, "system", "s")]
    frame = spark.createDataFrame(rows, "conv string, turn int, role string, text string")
    last = conversation.last_turns(frame, "conv", "turn").where("conv = 'c1'").orderBy("turns_back").collect()
    assert [r.turn for r in last] == list(range(11, 3, -1))
    index = {r.conv: r for r in conversation.conversation_index(frame, "conv", "turn").collect()}
    assert index["c1"].title == ("message 0 " + "x" * 70)[:60] and index["c1"].n_messages == 12
    assert index["c2"].title == "a question" and index["c3"].title is None
    history = {r.conv: r.messages for r in conversation.history_payload(frame, "conv", "turn", 2).collect()}
    assert [m.role for m in history["c1"]] == ["user", "assistant"] and len(history["c3"]) == 1


def test_chunks_hold_the_whole_text(spark):
    doc = "# Title\nintro line\n## One\n" + "word " * 700 + "\n\n\nlast paragraph\n \n## Two\nend"
    frame = texts(spark, [doc, "", "no headings"])
    rows = search.chunk_corpus(frame, "id", "text", 1000).orderBy("id", "section_no", "piece_no").collect()
    first = [r for r in rows if r.id == 0]
    assert all(0 < r.n_chars <= 1000 for r in rows) and {r.id for r in rows} == {0, 2}
    assert re.sub(r"\s", "", "".join(r.chunk_text for r in first)) == re.sub(r"\s", "", doc)
    assert [r.chunk_text[:6] for r in first if r.piece_no == 0] == ["# Titl", "## One", "last p", "## Two"]


def test_vectors_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    notes_ = rng.normal(size=(300, 8))
    notes_[100:130] = notes_[7]  # copies of one note tie
    asked = [notes_[7], rng.normal(size=8)]
    frame = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(notes_)] + [(900, None), (901, [0.0] * 8)], "note_id int, embedding array<double>"
    ).repartition(7)
    questions = spark.createDataFrame([(q, [float(x) for x in v]) for q, v in enumerate(asked)], "question_id int, embedding array<double>")
    got = sorted(map(tuple, search.vector_topk(frame, questions, 20).select("question_id", "distance", "note_id", "vector_rank").collect()))
    want = []
    for q, v in enumerate(asked):
        d = np.round(1 - notes_ @ v / np.linalg.norm(notes_, axis=1) / np.linalg.norm(v), 6) + 0.0
        best = sorted((float(x), i) for i, x in enumerate(d))[:20]
        want += [(q, x, i, 1 + sum(y < x for y, _ in best)) for x, i in best]
    assert [(g[0], pytest.approx(g[1], abs=1.1e-6), *g[2:]) for g in got] == sorted(want)
    monkeypatch.setattr(search, "BLOCK_QUESTIONS", 1)  # several passes give the same
    again = search.vector_topk(frame, questions, 20).select("question_id", "distance", "note_id", "vector_rank")
    assert sorted(map(tuple, again.collect())) == got
    assert search.vector_topk(frame, questions.limit(0)).collect() == []


@pytest.mark.parametrize("bad", [[1.0], [1.0, 2.0, 3.0], [None, 1.0]])
def test_vectors_of_another_length_are_refused(spark, bad):
    schema = "id int, embedding array<double>"
    asked = spark.createDataFrame([(1, [1.0, 0.0])], schema).withColumnRenamed("id", "question_id")
    notes_ = spark.createDataFrame([(1, [1.0, 0.0]), (2, bad), (3, [0.0, 1.0])], schema).withColumnRenamed("id", "note_id")
    with pytest.raises(Exception, match="has not 2 numbers"):
        search.vector_topk(notes_, asked).collect()
    wrong = asked.unionByName(spark.createDataFrame([(2, bad)], schema).withColumnRenamed("id", "question_id"))
    with pytest.raises(ValueError):
        search.vector_topk(notes_.where("note_id <> 2"), wrong)


def test_terms_of_several_words(spark):
    frame = texts(spark, ["Port out, please", "port-out port out", "out port", "report outs"]).withColumnRenamed("id", "note_id")
    assert sorted(r.note_id for r in search.keyword_topk(frame, ["port out"]).collect()) == [0, 1]
    assert sorted(r.note_id for r in search.keyword_topk(frame, ["Port  OUT!"]).collect()) == [0, 1]
    with pytest.raises(ValueError):
        search.keyword_topk(frame, ["!"])


def test_keywords_against_brute_force(spark):
    rng = random.Random(9)
    words = ["cancel", "switch", "pricing", "bill", "speed", "cancelled"]
    docs = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(120)] + ["Cancel!", "nothing here"]
    frame = texts(spark, docs).withColumnRenamed("id", "note_id").repartition(5)
    got = [(r.note_id, r.score) for r in search.keyword_topk(frame).orderBy(F.desc("score"), "note_id").collect()]
    tokens = [d.lower().replace("!", "").split() for d in docs]
    mean = sum(map(len, tokens)) / len(tokens)
    scores = []
    for i, t in enumerate(tokens):
        s = 0.0
        for term in rules.SEARCH_TERMS:
            df, tf = sum(term in x for x in tokens), t.count(term)
            s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
        if any(term in t for term in rules.SEARCH_TERMS):
            scores.append((i, round(s, 6)))
    want = sorted(scores, key=lambda x: (-x[1], x[0]))[:15]
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=2e-6)
    assert search.keyword_topk(frame, ["absent"]).count() == 0


def test_hybrid_joins_both_lists(spark):
    by_vector = spark.createDataFrame([("q", n, 0.1, r) for n, r in [(1, 1), (2, 2), (3, 2)]],
                                      "question_id string, note_id int, distance double, vector_rank int")
    by_text = spark.createDataFrame([(3, 2.0, 1), (9, 1.0, 2)], "note_id int, score double, text_rank int")
    rows = [(r.note_id, r.vector_rank, r.text_rank, r.rrf_score) for r in search.hybrid_rrf(by_vector, by_text, k=4).orderBy("position").collect()]
    assert rows == [(3, 2, 1, round(1 / 62 + 1 / 61, 8)), (1, 1, None, round(1 / 61, 8)), (2, 2, None, round(1 / 62, 8)),
                    (9, None, 2, round(1 / 62, 8))]


def test_hybrid_keeps_questions_without_a_vector(spark):
    by_vector = spark.createDataFrame([("q", 1, 0.1, 1)], "question_id string, note_id int, distance double, vector_rank int")
    by_text = spark.createDataFrame([(3, 2.0, 1)], "note_id int, score double, text_rank int")
    asked = spark.createDataFrame([("q",), ("r",)], "question_id string")
    notes_ = spark.createDataFrame([(1, "one"), (3, "three")], "note_id int, text string")
    rows = search.hybrid_rrf(by_vector, by_text, asked, notes=notes_).collect()
    assert sorted((r.question_id, r.note_id, r.note_text) for r in rows) == [("q", 1, "one"), ("q", 3, "three"), ("r", 3, "three")]
    nothing = search.hybrid_rrf(by_vector.limit(0), by_text, asked).collect()
    assert sorted((r.question_id, r.note_id) for r in nothing) == [("q", 3), ("r", 3)]


def test_null_to_zero(spark):
    frame = spark.createDataFrame([("1.5",), ("abc",), (None,), ("",), ("-2e3",)], "v string")
    assert [r[0] for r in frame.select(null_to_zero(F.col("v"))).collect()] == [1.5, 0.0, 0.0, 0.0, -2000.0]

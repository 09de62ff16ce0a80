"""Queries for notes, topics, search and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast import rules
from holdfast.functions.text import whole_word
from holdfast.operators import conversation, notes, postings, search, vector_index
from holdfast.plans import model
from holdfast.registry.sql import count_if, rate
from holdfast.session import materialize, scratch_dir, spread_small
from holdfast.sources import star_tables as star

# The documents are invented prose, so the patterns are syllables that occur in it.
SENTIMENT = {"negative": "rewh|thand", "at_risk": "ention|eux"}
TOPIC_WORDS = {"Articles": ("the", "der", "le"), "Joiners": ("and", "und", "et"), "Places": ("from", "von", "sur", "zu")}
TOPIC_ENDINGS = {"Endings": ("tion", "ment", "lich")}
TOPICS = {label: tuple(whole_word(w) for w in words) for label, words in TOPIC_WORDS.items()} | TOPIC_ENDINGS
TERMS = ("rewh", "eau", "den", "by")
CHUNK = 1_200


def _documents(spark, sf):
    return spread_small(star.table(spark, sf, "documents"))


def _note_sentiment(spark, sf):
    return notes.label_sentiment(_documents(spark, sf), "text", SENTIMENT).select("doc_id", "sentiment")


def _sentiment_triage(spark, sf):
    return notes.sentiment_triage(notes.label_sentiment(_documents(spark, sf), "text", SENTIMENT), "source")


def _topic_label_rules(spark, sf):
    return notes.topic_label_rules(_documents(spark, sf), "text", TOPICS).select("doc_id", "topic")


def topic_labels(spark, sf):
    """Quality labels learnt from the labelled documents and given to all of them."""
    labels = star.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("topic"))
    labelled = materialize(_documents(spark, sf).select("doc_id", "text").join(labels, "doc_id"), "labelled")
    return model.label_topics(
        model.train_topic_model(labelled, "text", "topic"), _documents(spark, sf), "text", ["doc_id"]
    )


def _topic_label_checks(spark, sf):
    """Every text has one of the labels, with at least the confidence of a choice between two."""
    given = topic_labels(spark, sf)
    return given.select("doc_id", F.col("predicted_topic").isin("0", "1").alias("has_label"),
                        F.col("confidence").between(0.5, 1.0).alias("is_confidence"))


def _unlabeled_filter(spark, sf):
    drop = notes.unlabeled_filter(_documents(spark, sf).select("doc_id", "source", "text"), "source", "src1")
    return notes.topic_label_rules(drop, "text", TOPICS).select("doc_id", "source", "topic")


def _questions(spark, sf):
    """Every embedding whose id is divisible by 50."""
    vectors = star.table(spark, sf, "embeddings")
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), "embedding")


def _vector_hits(spark, sf):
    vectors = star.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "note_id")
    return search.vector_topk(vectors, _questions(spark, sf))


def _index_hits(spark, sf):
    """The same search by an index that skips cells."""
    vectors = star.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "note_id")
    index = vector_index.build_index(vectors, scratch_dir(spark, "vector-index"))
    return vector_index.search_index(index, _questions(spark, sf))


def _text_hits(spark, sf):
    return search.keyword_topk(_documents(spark, sf), TERMS, note_id="doc_id")


def _asked_words(spark, sf):
    """What users said in every conversation whose id is divisible by 50, turn by turn, as questions."""
    turns = star.table(spark, sf, "conversations").where("conv_id % 50 = 0 AND role = 'user'")
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), "text")


def _posting_hits(spark, sf):
    """The best documents for the words of each question, by posting lists."""
    index = postings.build_postings(_documents(spark, sf), scratch_dir(spark, "postings"), "doc_id")
    return postings.search_postings(index, _asked_words(spark, sf))


def _hybrid(spark, sf):
    """Fused lists with the notes' texts, also for a question that has no vector; rank 0: not in that leg."""
    asked = _questions(spark, sf).select("question_id").unionByName(spark.createDataFrame([(-1,)], "question_id long"))
    fused = search.hybrid_rrf(
        _vector_hits(spark, sf), _text_hits(spark, sf), asked, notes=star.table(spark, sf, "documents"), note_id="doc_id")
    return fused.fillna(0, ["vector_rank", "text_rank"])


def _replies(spark, sf):
    """Reply payloads of every shape, one per message."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    item = lambda kind, *parts: F.struct(F.lit(kind).alias("type"), F.array(*parts).alias("content"))
    text = F.col("text")
    marker = item("message", part("output_text", F.lit("<name>analyst</name>")))
    answered = F.struct(F.array(
        marker, item("message", part("output_text", F.lit("earlier answer"))),
        item("tool_call", part("output_text", F.lit("rows"))),
        item("message", part("output_text", F.concat(F.lit(" "), text)), part("refusal", F.lit("no")),
             part("output_text", F.lit(" (end)\n"))),
        item("message", part("output_text", F.lit("  \n"))),
    ).alias("output"))
    plain = F.struct(F.array(marker).alias("output"), text.alias("content"))
    chosen = F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices"))
    payload = (
        F.when(F.col("role") == "assistant", F.to_json(answered))
        .when(F.col("role") == "system", F.to_json(chosen))
        .when(F.col("turn") > 0, F.to_json(plain))
        .otherwise(F.lit("{}"))
    )
    return star.table(spark, sf, "conversations").select("conv_id", "turn", payload.alias("payload"))


def _final_answer(spark, sf):
    return _replies(spark, sf).select("conv_id", "turn", conversation.final_answer(F.col("payload")).alias("answer"))


def _last_turns(spark, sf):
    return conversation.last_turns(star.table(spark, sf, "conversations"), "conv_id", "turn")


def _last_turns_short(spark, sf):
    return conversation.last_turns(star.table(spark, sf, "conversations"), "conv_id", "turn", 3)


def _conversation_index(spark, sf):
    index = conversation.conversation_index(star.table(spark, sf, "conversations"), "conv_id", "turn")
    return index.orderBy(F.desc("conv_id"))


QUERIES = {
    "note_sentiment": _note_sentiment,
    "sentiment_triage": _sentiment_triage,
    "topic_label_rules": _topic_label_rules,
    "topic_label_model": _topic_label_checks,
    "unlabeled_filter": _unlabeled_filter,
    "vector_topk": _vector_hits,
    "vector_index_topk": _index_hits,
    "keyword_topk": _text_hits,
    "keyword_postings": _posting_hits,
    "hybrid_rrf": _hybrid,
    "chunk_corpus": lambda s, d: search.chunk_corpus(_documents(s, d), "doc_id", "text", CHUNK),
    "final_answer": _final_answer,
    "last_turns": _last_turns,
    "last_turns_short": _last_turns_short,
    "conversation_index": _conversation_index,
}

_SENTIMENT_SQL = f"""CASE WHEN regexp_matches(text, '(?i)({SENTIMENT["negative"]})') THEN 'negative'
                          WHEN regexp_matches(text, '(?i)({SENTIMENT["at_risk"]})') THEN 'at_risk' ELSE 'neutral' END"""


def _topic_sql() -> str:
    alone = {label: [f"(^|[^\\p{{L}}\\p{{N}}]){w}([^\\p{{L}}\\p{{N}}]|$)" for w in words] for label, words in TOPIC_WORDS.items()}
    hits = {
        label: " + ".join(f"CAST(regexp_matches(text, '(?i){p}') AS INTEGER)" for p in patterns)
        for label, patterns in (alone | TOPIC_ENDINGS).items()
    }
    best = f"GREATEST({', '.join(hits.values())})"
    cases = " ".join(f"WHEN ({n}) = {best} THEN '{label}'" for label, n in hits.items())
    return f"CASE WHEN {best} = 0 THEN NULL {cases} END"


_VECTOR_SQL = """
    SELECT question_id, note_id, distance, RANK() OVER (PARTITION BY question_id ORDER BY distance) AS vector_rank
    FROM (SELECT q.vec_id AS question_id, n.vec_id AS note_id,
                 round(1 - list_cosine_similarity(CAST(n.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) + 0.0 AS distance
          FROM embeddings n, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q)
    QUALIFY ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY distance, note_id) <= 15"""


def _bm25_sql() -> str:
    counts = ", ".join(f"len(list_filter(tokens, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(TERMS))
    dfs = ", ".join(f"COUNT(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(TERMS)))
    norm = f"({search.BM25_K1} * (1 - {search.BM25_B} + {search.BM25_B} * words * n / all_words))"
    score = " + ".join(
        f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * ({search.BM25_K1} + 1) / (tf{i} + {norm})"
        for i in range(len(TERMS))
    )
    hit = " + ".join(f"tf{i}" for i in range(len(TERMS)))
    return f"""
    SELECT note_id, score, RANK() OVER (ORDER BY score DESC) AS text_rank
    FROM (SELECT doc_id AS note_id, round(CAST({score} AS DOUBLE), 6) AS score
          FROM (SELECT doc_id, len(tokens) AS words, {counts}
                FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS tokens FROM documents)) d,
               (SELECT COUNT(*) AS n, CAST(SUM(words) AS DOUBLE) AS all_words, {dfs}
                FROM (SELECT len(tokens) AS words, {counts}
                      FROM (SELECT regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS tokens FROM documents)))
          WHERE {hit} > 0 ORDER BY score DESC, note_id LIMIT 15)"""


_POSTING_SQL = f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS tokens FROM documents),
         c AS (SELECT COUNT(*) AS n, CAST(SUM(COALESCE(len(tokens), 0)) AS DOUBLE) AS all_words FROM d),
         p AS (SELECT doc_id, words, term, COUNT(*) AS tf
               FROM (SELECT doc_id, len(tokens) AS words, unnest(tokens) AS term FROM d) GROUP BY ALL),
         f AS (SELECT term, ln(1 + (ANY_VALUE(n) - COUNT(*) + 0.5) / (COUNT(*) + 0.5)) AS idf FROM p, c GROUP BY term),
         q AS (SELECT DISTINCT conv_id || '-' || turn AS question_id,
                      unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term
               FROM conversations WHERE conv_id % 50 = 0 AND role = 'user'),
         s AS (SELECT question_id, doc_id AS note_id,
                      round(SUM(idf * tf * ({search.BM25_K1} + 1) / (tf + {search.BM25_K1} * (1 - {search.BM25_B} + {search.BM25_B} * words * n / all_words))), 6) AS score
               FROM q JOIN f USING (term) JOIN p USING (term), c GROUP BY 1, 2)
    SELECT question_id, note_id, score, RANK() OVER (PARTITION BY question_id ORDER BY score DESC) AS text_rank
    FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY score DESC, note_id) <= 15"""

_TRIMMED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"

ORACLE = {
    "note_sentiment": f"SELECT doc_id, {_SENTIMENT_SQL} AS sentiment FROM documents",
    "sentiment_triage": f"""
        SELECT source, COUNT(*) AS notes, {count_if("s = 'negative'")} AS negative, {count_if("s = 'at_risk'")} AS at_risk,
               {count_if("s = 'neutral'")} AS neutral, {rate(count_if("s = 'negative'"))} AS negative_rate
        FROM (SELECT source, {_SENTIMENT_SQL} AS s FROM documents) GROUP BY 1""",
    "topic_label_rules": f"SELECT doc_id, {_topic_sql()} AS topic FROM documents",
    "topic_label_model": "SELECT doc_id, TRUE AS has_label, TRUE AS is_confidence FROM documents",
    "unlabeled_filter": f"SELECT doc_id, source, {_topic_sql()} AS topic FROM documents WHERE source LIKE 'src1%'",
    "vector_topk": _VECTOR_SQL,
    "vector_index_topk": _VECTOR_SQL,
    "keyword_topk": _bm25_sql(),
    "keyword_postings": _POSTING_SQL,
    "hybrid_rrf": f"""
        WITH v AS ({_VECTOR_SQL}), t AS ({_bm25_sql()}),
             tq AS (SELECT question_id, note_id, text_rank FROM t, (SELECT DISTINCT question_id FROM v UNION SELECT -1))
        SELECT question_id, note_id, text AS note_text, COALESCE(vector_rank, 0) AS vector_rank, COALESCE(text_rank, 0) AS text_rank, rrf_score,
               ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY rrf_score DESC, note_id) AS position
        FROM (SELECT COALESCE(v.question_id, tq.question_id) AS question_id, COALESCE(v.note_id, tq.note_id) AS note_id,
                     vector_rank, text_rank,
                     round(COALESCE(1.0 / CAST(60 + vector_rank AS DOUBLE), 0) + COALESCE(1.0 / CAST(60 + text_rank AS DOUBLE), 0), 8) AS rrf_score
              FROM v FULL JOIN tq ON v.question_id = tq.question_id AND v.note_id = tq.note_id) LEFT JOIN documents ON doc_id = note_id
        QUALIFY position <= 5""",
    "chunk_corpus": f"""
        WITH marked AS (SELECT doc_id, regexp_replace(text, '\\n(#{{1,6}} )', chr(10) || chr(10) || '\\1', 'g') AS t FROM documents),
             listed AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, '\\n[ \\t]*\\n\\s*'),
                               lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS parts FROM marked),
             sections AS (SELECT doc_id, unnest(range(len(parts))) AS section_no, unnest(parts) AS section FROM listed),
             pieces AS (SELECT *, unnest(range(CAST(ceil(length(section) / {CHUNK}.0) AS BIGINT))) AS piece_no FROM sections)
        SELECT doc_id, section_no, piece_no, substring(section, piece_no * {CHUNK} + 1, {CHUNK}) AS chunk_text,
               length(substring(section, piece_no * {CHUNK} + 1, {CHUNK})) AS n_chars
        FROM pieces""",
    "final_answer": f"""
        SELECT conv_id, turn,
               CASE WHEN role = 'assistant' THEN regexp_replace(' ' || text || ' (end)', '^\\s+', '')
                    WHEN role = 'system' THEN text WHEN turn > 0 THEN text
                    ELSE '{rules.NO_ANSWER.replace("'", "''")}' END AS answer
        FROM conversations""",
    "last_turns": """
        SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS turns_back
        FROM conversations QUALIFY turns_back <= 8""",
    "last_turns_short": """
        SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS turns_back
        FROM conversations QUALIFY turns_back <= 3""",
    "conversation_index": f"""
        SELECT conv_id, substring(FIRST({_TRIMMED} ORDER BY turn) FILTER (WHERE role = 'user' AND {_TRIMMED} <> ''), 1, 60) AS title,
               COUNT(*) AS n_messages, MAX(turn) AS last_message
        FROM conversations GROUP BY 1""",
}

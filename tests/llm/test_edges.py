"""Every operator on NULLs, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from plain import archive, near_copies, overlaps

import corpus_pipeline
from holdfast.llm import (
    bpe, decontaminate, html_region, line_align, ngram_join, projection_dedup, quality, separators, suffix_tree, warc,
)
from holdfast.llm import queries as registered

LONG = " ".join(f"word{i % 977}" for i in range(150_000))
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, ""), (4, "  \n\t "),
    (5, "One two three four five six seven eight nine ten eleven"), (6, LONG), (7, LONG + " end"),
    (1, "one two three four five six seven eight nine ten eleven"), (None, "one two three four five six"),
    (None, None), (8, "日本語 テキスト\nüber die Straße"), (9, "x"),
]
EXTRA = ["_gone", "_doc", "_kept", "_row", "n", "rep", "ids", "score", "component", "words", "lines", "value", "lang", "source"]


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in EXTRA) + ", n_chars long"
    rows = [(i, t, *("x" for _ in EXTRA), None if t is None else len(t)) for i, t in ROWS]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def ranks(spark):
    return bpe.read_ranks(spark, public_tokenizers.path(registered.RANKS))


def test_decontaminate(spark, docs):
    items = [(1, "three four five six seven eight nine ten eleven twelve"), (2, None), (None, "one two"), (3, ""),
             (4, "two three four five six seven eight nine ten eleven"), (4, "two three four five six seven eight nine ten eleven"),
             (5, "seven EIGHT"), (6, " ".join(f"word{i}" for i in range(900, 977)))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("item_id", "item_id")
    want = sorted(overlaps(ROWS, [x for x in items if x[0]]), key=repr)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for block in (decontaminate.BLOCK_WORDS, 12):  # one block, and one block for every item or two
        got = decontaminate.contamination(docs, bench, block_words=block)
        assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == want
        kept = decontaminate.drop_contaminated(docs, bench, block_words=block)
        assert kept.columns == docs.columns
        assert sorted(r[1] or "" for r in kept.collect()) == sorted(t or "" for (_, t), w in zip(ROWS, overlaps(ROWS, [x for x in items if x[0]])) if not w[5])
    assert decontaminate.contamination(docs.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def test_ngram_join(docs):
    got = [tuple(r) for r in ngram_join.near_duplicates(docs).collect()]
    want = near_copies([r for r in ROWS if r[0] is not None])
    assert sorted(r for r in got if r[0] is not None) == sorted([*want, want[0]])
    assert sorted((r[1], r[2]) for r in got if r[0] is None and r[1]) == [(2, None)]
    assert len(got) == len(ROWS)
    kept = ngram_join.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 6, 8, 9]
    assert ngram_join.near_duplicates(docs.limit(0)).collect() == []


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (6, 1), (9, 0), (2, None), (None, 1), (4, 7)], "doc_id long, quality int")
    chain = quality.train(docs, labels)
    scored = quality.score(docs, chain).collect()
    assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.doc_id == 1}) == 1
    assert quality.score(docs.limit(0), chain).collect() == []
    blank = quality.train(docs, labels.limit(0))
    assert {round(r.score, 9) for r in quality.score(docs, blank).collect()} == {0.5}


def test_bpe(docs, ranks):
    out = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks).collect()
    assert sorted((r.decoded.decode(), r.n or "") for r in out) == sorted((t or "", "x") for _, t in ROWS)
    digests = bpe.token_digests(docs, ranks, public_tokenizers.PATTERN).collect()
    assert sorted(r.decoded_sha256 for r in digests) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in ROWS)
    assert bpe.token_digests(docs.limit(0), ranks, public_tokenizers.PATTERN).collect() == []


def test_separators(spark, docs, ranks, tmp_path):
    tokens = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    want = sorted(len(r.ids) // 4 for r in tokens.collect())
    separators.write_flat(tokens, str(tmp_path / "flat"), 50_256)
    for block in (separators.BLOCK_TOKENS, 1_000, 7):
        got = separators.document_lengths(spark, str(tmp_path / "flat"), 50_256, block_tokens=block).collect()
        assert sorted(r.n_tokens for r in got) == want
    separators.write_flat(tokens.limit(0), str(tmp_path / "none"), 50_256)
    assert separators.document_lengths(spark, str(tmp_path / "none"), 50_256).collect() == []


def test_line_align(docs):
    left = line_align.remove_repeats(docs).collect()
    assert len(left) == len(ROWS)
    by_id = {r.doc_id: r for r in left if r.doc_id is not None}
    assert by_id[5].n_removed == 1 and by_id[5].text == "" and by_id[1].n_removed == 0 and by_id[7].n_removed == 0
    assert by_id[2].text is None and by_id[2].lines == "x"
    assert line_align.remove_repeats(docs.limit(0)).collect() == []


def test_suffix_tree(docs):
    tree, words = suffix_tree.train(docs)
    scored = suffix_tree.score(docs, tree, words).collect()
    assert len(scored) == len(ROWS)
    assert {r.n_tokens for r in scored if r.doc_id in (2, 3, 4)} == {1}
    assert all(r.n_known == r.n_tokens and r.score < 0 for r in scored)
    assert suffix_tree.score(docs.limit(0), tree, words).collect() == []
    empty, none = suffix_tree.train(docs.limit(0))
    assert {r.n_known for r in suffix_tree.score(docs, empty, none).collect()} == {0}


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [], 1),
            (7, [1.0, None], 1), (8, [float("nan"), 1.0], 1), (9, [1.0, 0.0], None), (None, [1.0, 0.0], 1),
            (2, [2.0, 0.0], 1), (10, [float("inf"), 0.0], 1), (11, [1e-200, 0.0], 1), (12, [1.0, 0.0, 0.0], 1),
            (13, [1.0, 0.0], 1), (14, [0.98, math_sqrt(1 - 0.98**2) * 1.001], 1)]
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, label int, digest string, size int")
    got = sorted(map(tuple, projection_dedup.near_duplicates(table).collect()), key=repr)
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (11, 3, 1, False), (13, 3, 1, False), (None, 0, None, False)]
    want += [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 12, 14)]
    assert got == sorted(want, key=repr)
    assert projection_dedup.near_duplicates(table.limit(0)).collect() == []


def math_sqrt(x):
    return float(np.sqrt(x))


def test_pages(spark, tmp_path):
    rows = [(3, "http://a/x y\r\nz", "<p>same"), (1, None, "<p>same"), (2, "u", None), (4, "u", ""), (5, "u", "<p>" + LONG),
            (None, "u", "<p>same"), (3, "http://a/x y\r\nz", "<p>same"), (6, "é", "&eacute;<b>ü</b>")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, seen int")
    found = html_region.main_text(pages, html_region.train(pages)).collect()
    assert sorted(r.text for r in found) == sorted(["same"] * 4 + ["", "", LONG, "éü"])
    assert html_region.main_text(pages.limit(0), {}).collect() == []
    warc.write_archive(pages, str(tmp_path / "a"))
    back = warc.read_archive(spark, str(tmp_path / "a")).collect()
    got = sorted(((int(r.record_id[10:-1]) if r.record_id else None), r.payload_bytes, r.payload_digest, r.type,
                  int(r.refers_to[10:-1]) if r.refers_to else None) for r in back if r.record_id)
    assert got == sorted(archive([r[:3] for r in rows if r[0] is not None]))
    assert [(r.type, r.payload) for r in back if not r.record_id] == [("response", b"<p>same")]
    warc.write_archive(pages.limit(0), str(tmp_path / "b"))
    assert warc.read_archive(spark, str(tmp_path / "b")).collect() == []


def test_stages(spark, docs, tmp_path):
    """Columns stay those of documents up to the last stage, also for an empty table."""
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, 1), (6, 1), (9, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= rows.count()
        assert corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).count() == rows.count()


def test_an_id_on_different_texts(spark):
    """Both clean texts of one id stay; its equal rows become one."""
    rows = [(1, "one clean text about the sea and its tides"), (1, "quite another text about bread and its crust"),
            (1, "One clean  text about the sea and its tides"), (2, "one clean text about the sea and its tides")]
    kept = ngram_join.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text.lower().split()[1]) for r in kept) == [(1, "another"), (1, "clean")]


def test_an_id_on_different_texts_and_blocks_of_any_size(spark):
    """Two rows with one id and equally many words, one of them contaminated, whatever the size of a block."""
    passage = "three four five six seven eight nine ten eleven twelve"
    rows = [(1, f"one two {passage}"), (1, "a b c d e f g h i j k l"), (1, f"one two {passage}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(12, passage), (13, "quite other words"), (14, "x y")], "item_id long, text string")
    for block in (1, 5, 1 << 20):
        got = decontaminate.contamination(docs, bench, block_words=block).select("n_words", "n_hit", "n_items", "contaminated").collect()
        assert sorted(map(tuple, got)) == [(12, 0, 0, False), (12, 10, 1, True), (12, 10, 1, True)]
        assert [r.text for r in decontaminate.drop_contaminated(docs, bench, block_words=block).collect()] == [rows[1][1]]

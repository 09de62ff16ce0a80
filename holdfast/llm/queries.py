"""Registered queries of the operators, each over its whole tables, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import (
    bpe, chunk_bpe, decontaminate, html_region, importance, line_align, ngram_join, oracle, projection_dedup, quality, separators,
    suffix_tree, vector_codes, warc,
)
from holdfast.llm.settings import bounded
from holdfast.session import scratch_dir

#: Rank file of the token queries; a parameter of the operators.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: The id of that vocabulary which no token has.
END_OF_DOCUMENT = 50_256
#: Tokenizer file of the query that reuses chunks.
TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_region.main_text(pages, html_region.train(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    ).drop("items")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    # A gap in an archive that was just written is a lost page.
    lost = F.raise_error(F.concat(F.lit("gap in the written archive: "), "reason")).cast("boolean")
    wanted = F.when(F.col("type") == "gap", lost).otherwise(F.col("type").isin("response", "revisit"))
    records = warc.read_archive(spark, path, payloads=False).where(wanted)
    return records.select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), warc.page_of("refers_to").alias("refers_to"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(spark, public_tokenizers.path(RANKS))
    docs = _table(spark, sf_dir, "documents").select("text")
    tokens = bpe.encode(docs, ranks, public_tokenizers.PATTERN, "uint16", keep=[])
    path = scratch_dir(spark, "tokens")
    separators.write_flat(tokens, path, END_OF_DOCUMENT, given="uint16")
    found = separators.document_lengths(spark, path, END_OF_DOCUMENT)
    return found.select(separators.file_number().alias("file"), "document", "begin", "n_tokens")


def op6_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_line_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_align.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select(
        "doc_id", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    chain = quality.train(docs, labels.where(~quality.is_held_out("doc_id", 5, 0)))
    scored = quality.score(docs.select("doc_id", "text"), chain)
    return scored.select(
        "doc_id", quality.is_held_out("doc_id", 5, 0).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(spark, public_tokenizers.path(RANKS))
    return bpe.token_digests(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)



def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = quality.is_held_out("doc_id", 7, 2)
    tree, words = suffix_tree.train(docs.where(~held_out))
    scored = suffix_tree.score(docs, tree, words)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    books, coded = vector_codes.fit(_table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_error(coded).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = chunk_bpe.read_tokenizer(spark, public_tokenizers.path(TOKENIZER))
    return chunk_bpe.token_digests(_table(spark, sf_dir, "documents"), tokenizer, public_tokenizers.PATTERN)


QUERIES = {query.__name__: query for query in (
    op1_html_region, op2_decontaminate, op3_warc, op4_ngram_join, op5_separators, op6_projection_dedup, op7_line_align, op8_quality, op9_bpe, op10_suffix_tree,
    op11_vector_codes, op12_importance, op13_chunk_bpe,
)}
#: The others have no SQL: tests/llm holds them against brute force, the tokenizer's library and held-out labels.
ORACLE = {
    "op2_decontaminate": oracle.DECONTAMINATE, "op3_warc": oracle.ARCHIVE, "op4_ngram_join": oracle.NGRAM_JOIN,
    "op6_projection_dedup": oracle.VECTORS, "op11_vector_codes": oracle.VECTOR_CODES, "op12_importance": oracle.IMPORTANCE,
}

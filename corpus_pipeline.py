"""A corpus pipeline: quality, repeated lines, near copies, benchmark passages, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import bpe, decontaminate, line_align, ngram_join, quality
from holdfast.llm.queries import RANKS
from holdfast.llm.settings import bounded
from holdfast.session import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, scored by a model of the labelled rows among them.

    Empty and NULL texts are scored, too; rows that repeat an id, or have none, each have
    their own score.  Without labels all scores are 0.5 and all documents stay; an empty table stays empty.
    """
    labels = bounded(spark).read.parquet(f"{sf_dir}/labels.parquet")
    chain = quality.train(docs, labels.where(~quality.is_held_out("doc_id", 5, 0)))
    return quality.score(docs, chain).where(F.col("score") >= quality.THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document has; one of which no word is left goes.

    Texts that had no words before stay, and ``n_chars`` follows the text.
    """
    bounded(spark)
    left = line_align.remove_repeats(docs)
    left = left.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", length).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id.

    Documents without words, and rows without id, stay.  Of rows that repeat an id with the same words one stays, with
    other words all; an empty table stays empty.
    """
    bounded(spark)
    return ngram_join.first_of_each(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row with a benchmark item.

    NULL and empty texts stay, and all documents if the benchmark is empty.  Each row stands for itself, also rows that
    repeat an id or have none.
    """
    return decontaminate.drop_contaminated(docs, bounded(spark).read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to.

    One row per document, also for NULL and empty texts (no tokens), for rows that repeat an id and for rows without one.
    """
    return bpe.token_digests(docs, bpe.read_ranks(bounded(spark), public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_good),
    ("repeated_lines", drop_repeated_lines),
    ("near_copies", keep_one_of_each),
    ("benchmark", drop_contaminated),
    ("tokens", tokenize),
]

#: SQL has no form of the classifier, the alignment or the encoding; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over the documents; what a stage returns is written and read again."""
    docs = bounded(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

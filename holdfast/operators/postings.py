"""Keyword search by posting lists that are cut into bands of falling weight.

``build_postings`` counts the words of every note once and writes a row per note and word, dealt
out to bucket folders by word and sorted by word and band.  The weight of a posting is its share
of a BM25 score before the word's rarity; a band holds the weights between two neighbouring
steps, so its number bounds them.  ``search_postings`` first looks at the bands' row counts: they
say how high the ``k``-th score is at least.  That much is dealt out among the question's words, from
the commonest: a note that has no more of each word than its part cannot be among the best, so bands
within a word's part are not read.  What is read goes to the task of its note once, however many
questions ask for it; the task adds up the scores of its notes for all questions and hands on those that
its own ``k`` best leave a chance.  What the bands below add is looked up for the notes that could still be
among the best.  The result is that of ``search.keyword_topk`` for each question's words.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from holdfast import rules
from holdfast.functions.rates import rows
from holdfast.operators.ranks import topk_per_key
from holdfast.operators.search import BM25_B, BM25_K1
from holdfast.session import discard, estimated_bytes, materialize

# The functions below travel inside the task's closure, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = r"[\p{L}\p{N}]+"
#: Bands per unit of weight; weights are below ``BM25_K1 + 1``.
BANDS = 64
#: Folders of words: one for so many bytes of counted words, within these bounds.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 1 << 30, 16, 4_096
#: Bytes that go to a Python worker at a time, besides those of a longer note; files that a task writes side by side.
BATCH_BYTES, WRITERS = 8 << 20, 64
#: Up to so many words their bands are named in the scan's filter; more are left to the join.
PUSHED_WORDS = 256
#: Questions are answered in blocks of about so many questions, and of words of questions, which every task holds.
BLOCK_QUESTIONS, BLOCK_WORDS = 4_096, 1_000_000
#: Scores of one step, questions times notes, and postings of questions that are added at a time.
STEP_CELLS, STEP_POSTINGS = 1 << 21, 1 << 21
#: Scores are rounded to ``PLACES``; bounds are compared with this margin, so that rounding loses no note.
PLACES, MARGIN = 6, 1e-5


@dataclass
class Postings:
    """A written index: the folder, its number of buckets, and the notes and words that it was built from."""

    spark: SparkSession
    path: str
    buckets: int
    notes: int
    words: int
    kind: str  # type of the note ids

    def lists(self) -> DataFrame:
        """``bucket``, ``term``, ``band``, ``note_id``, ``tf``, ``words``: a row per note and word."""
        kinds = f"term string, band int, note_id {self.kind}, tf long, words long, bucket int"
        return self.spark.read.schema(kinds).parquet(f"{self.path}/lists")

    def bands(self) -> DataFrame:
        """``bucket``, ``term``, ``band``, ``notes``, ``low``, ``top``: rows and weights of each band."""
        return self.summed(self.band_parts())

    def band_parts(self) -> DataFrame:
        """What ``bands`` adds up: a band has a row for each batch of lists that it stands in."""
        kinds = "term string, band int, notes long, low double, top double, bucket int"
        return self.spark.read.schema(kinds).parquet(f"{self.path}/bands")

    @staticmethod
    def summed(parts: DataFrame) -> DataFrame:
        return parts.groupBy("bucket", "term", "band").agg(
            F.sum("notes").alias("notes"), F.min("low").alias("low"), F.max("top").alias("top"))

    def weight(self) -> Column:
        """A posting's share of the score, before the word's rarity."""
        average = self.words / self.notes if self.words else 1.0
        norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("words") / F.lit(average))
        return F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + norm)

    def rarity(self, notes: Column) -> Column:
        return F.log(1 + (F.lit(self.notes) - notes + 0.5) / (notes + 0.5))


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each note and word, with the note's length; one without word for a note that has none."""
    for batch in batches:
        lists = batch.column(1)
        length = np.asarray(pa.compute.list_value_length(lists).fill_null(0)).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        size = max(1, len(words.dictionary))
        own, tf = np.unique(np.repeat(np.arange(len(length)), length) * size + words.indices.to_numpy(), return_counts=True)
        note, word = np.divmod(own, size)
        none = np.flatnonzero(length == 0)
        note = np.append(note, none)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(note)), pa.array(length[note]),
             pa.concat_arrays([words.dictionary.take(pa.array(word)), pa.nulls(len(none), words.dictionary.type)]),
             pa.array(np.append(tf, np.ones(len(none), tf.dtype)))], names=["note_id", "words", "term", "tf"])


def _band_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and weights of each run of rows with the same word and band."""
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.ones(batch.num_rows, bool)
        new[1:] = False
        for column in batch.columns[:3]:
            new[1:] |= np.asarray(pa.compute.not_equal(column.slice(1), column.slice(0, len(column) - 1)))
        first, weight = np.flatnonzero(new), np.asarray(batch.column(3))
        yield pa.RecordBatch.from_arrays(
            [*(c.take(pa.array(first)) for c in batch.columns[:3]), pa.array(np.diff(np.append(first, len(new)))),
             pa.array(np.minimum.reduceat(weight, first)), pa.array(np.maximum.reduceat(weight, first))],
            names=["term", "band", "bucket", "notes", "low", "top"])


def build_postings(
    notes: DataFrame, path: str, note_id: str = "note_id", text: str = "text", buckets: int | None = None
) -> Postings:
    """Write the index of ``notes`` below ``path``, which must be new and shared.

    ``note_id`` names a note: rows with the same id count as one note with all their words, so give
    each its own.  Rows without an id are not indexed.  A NULL or empty text is a note without words,
    which counts in the corpus statistics only.  An empty table gives an index that finds nothing.
    """
    spark = notes.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    kind = notes.schema[note_id].dataType.simpleString()
    # Texts are exchanged once, by note; a note's words are counted, and its length is known, where they arrive.
    named = notes.where(F.col(note_id).isNotNull()).groupBy(F.col(note_id).alias("note_id")).agg(
        F.concat_ws(" ", F.collect_list(text)).alias("_text"))
    # Read by the corpus totals and by the range sort below.
    counted = materialize(
        named.select("note_id", _words("_text").alias("_words")).mapInArrow(
            _count, f"note_id {kind}, words long, term string, tf long"),
        "note_words", "zstd")
    buckets = buckets or max(LEAST_BUCKETS, min(MOST_BUCKETS, estimated_bytes(counted) // BUCKET_BYTES))
    lengths = counted.groupBy("note_id").agg(F.max("words").alias("words"))
    total = lengths.agg(rows().alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    index = Postings(spark, path.rstrip("/"), buckets, total["n"], total["words"], kind)
    banded = (
        counted.where(F.col("term").isNotNull())
        .withColumn("band", F.floor(index.weight() * BANDS).cast("int"))
        .select(_bucket(buckets).alias("bucket"), "term", "band", "note_id", "tf", "words")
    )
    # By ranges, not by word: the list of a common word is cut between tasks.  A task has few buckets, so their files are
    # written side by side, and rows are sorted by words alone, whose first letters tell most of them apart.
    ranges = banded.repartitionByRange("bucket", "term", "band", F.xxhash64("note_id"))
    writers, before = "spark.sql.maxConcurrentOutputFileWriters", spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    spark.conf.set(writers, str(WRITERS))
    try:
        ranges.sortWithinPartitions("term", F.desc("band"), "note_id").write.partitionBy("bucket").parquet(
            f"{index.path}/lists", compression="zstd")
        # The lists are sorted, so that the rows of a band stand together but where files and batches end.
        (index.lists().select("term", "band", "bucket", index.weight().alias("weight"))
         .mapInArrow(_band_parts, "term string, band int, bucket int, notes long, low double, top double")
         .write.partitionBy("bucket").parquet(f"{index.path}/bands", compression="zstd"))
    finally:
        spark.conf.set(writers, before)
    discard(counted)
    return index


def _asked(index: Postings, questions: DataFrame, question_id: str, text: str) -> DataFrame:
    words = questions.select(F.col(question_id).alias("question_id"), F.explode(_words(text)).alias("term")).distinct()
    return words.withColumn("bucket", _bucket(index.buckets))


def search_plan(
    index: Postings, questions: DataFrame, k: int = rules.SEARCH_LEG_SIZE, question_id: str = "question_id", text: str = "text"
) -> DataFrame:
    """What a search reads: per question and word ``rarity``, ``cut`` (the lowest band that is read in full), ``rest``
    (the most that a band below it adds to a score), ``notes`` and ``notes_read``, and the question's ``floor`` and
    ``all_rest``.

    A word that no note has does not appear.
    """
    asked = materialize(_asked(index, questions, question_id, text), "asked")
    bands = index.summed(
        _of_buckets(index.band_parts(), asked).join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi"))
    falling = W.partitionBy("bucket", "term").orderBy(F.desc("band"))
    bands = materialize(bands.withColumn("_so_far", F.sum("notes").over(falling)), "asked_bands")
    # A word whose bands down to one hold k notes: the k-th score is at least what the lowest of them gives.
    words = bands.groupBy("bucket", "term").agg(
        F.sum("notes").alias("notes"), F.max("top").alias("top"), F.max("band").alias("_first"), F.min("band").alias("_last"),
        F.max(F.when(F.col("_so_far") >= k, F.col("low"))).alias("_kth"),
    ).withColumn("rarity", index.rarity(F.col("notes")))
    of_question = W.partitionBy("question_id")
    most = F.col("rarity") * F.col("top")
    cheaper = of_question.orderBy(most, "term").rowsBetween(W.unboundedPreceding, -1)
    planned = (
        asked.join(words, ["bucket", "term"])
        .withColumn("floor", F.coalesce(F.max(F.col("rarity") * F.col("_kth")).over(of_question), F.lit(0.0)))
        .withColumn("_left", F.col("floor") - MARGIN - F.coalesce(F.sum(most).over(cheaper), F.lit(0.0)))
        # Bands below the cut weigh less than cut / BANDS; a word that is skipped whole has a cut above its last band.
        .withColumn("cut", F.when(F.col("_left") >= most, F.col("_first") + 1).otherwise(
            F.greatest(F.floor(F.col("_left") / F.col("rarity") * BANDS), F.lit(0))).cast("int"))
        .withColumn("rest", F.when(F.col("cut") > F.col("_last"), F.col("rarity") * F.least(F.col("top"), F.col("cut") / BANDS))
                    .otherwise(0.0))
        .withColumn("all_rest", F.sum("rest").over(of_question))
    )
    read = planned.join(bands.select("bucket", "term", "band", F.col("notes").alias("_here")), ["bucket", "term"]).groupBy(
        "question_id", "bucket", "term").agg(F.sum(F.when(F.col("band") >= F.col("cut"), F.col("_here")).otherwise(0)).alias("notes_read"))
    return planned.drop("_kth", "_left", "_first", "_last", "top").join(read, ["question_id", "bucket", "term"])


def _of_buckets(table: DataFrame, asked: DataFrame) -> DataFrame:
    """Only the folders of words that are asked for; there are at most ``MOST_BUCKETS``."""
    return table.where(F.col("bucket").isin([r[0] for r in asked.select("bucket").distinct().collect()]))


def _scan(index: Postings, wanted: DataFrame, lowest: str | None = None) -> DataFrame:
    """The lists of the ``wanted`` words, from the ``lowest`` band that any question reads."""
    lists = _of_buckets(index.lists(), wanted)
    least = F.min(lowest) if lowest else F.lit(0)
    few = wanted.groupBy("term").agg(least.alias("band")).limit(PUSHED_WORDS + 1).collect()
    if 0 < len(few) <= PUSHED_WORDS:
        lists = lists.where(reduce(
            Column.__or__, ((F.col("term") == r["term"]) & (F.col("band") >= r["band"]) for r in few)))
    return lists


def search_postings(
    index: Postings, questions: DataFrame, k: int = rules.SEARCH_LEG_SIZE, question_id: str = "question_id", text: str = "text"
) -> DataFrame:
    """The ``k`` best notes of each question for any of its words by BM25: ``question_id``, ``note_id``, ``score``, ``text_rank``.

    A word counts once however often the question has it; rows with the same question id are one
    question.  Equal scores share their rank, and the lowest note ids come first.  A question without
    words, or none of whose words any note has, gives no row.
    """
    plan = materialize(search_plan(index, questions, k, question_id, text), "search_plan")
    size = plan.agg(rows().alias("words"), F.count_distinct("question_id").alias("questions")).first()
    blocks = max(1, -(-size["questions"] // BLOCK_QUESTIONS), -(-size["words"] // BLOCK_WORDS))
    block = F.pmod(F.xxhash64("question_id"), F.lit(blocks))
    tops = [_search_block(index, plan.where(block == number) if blocks > 1 else plan, k) for number in range(blocks)]
    return reduce(DataFrame.unionByName, tops)


@dataclass
class _Asked:
    """A block of questions, as every task holds it.  Words and questions are numbers."""

    first: np.ndarray  # where a word's questions begin among those of all words; one more than words
    asking: np.ndarray
    rarity: np.ndarray  # by word
    rest: np.ndarray  # by word: the most that the bands that are not read add
    questions: pa.Array  # ids
    floor: np.ndarray  # by question
    all_rest: np.ndarray
    norm: tuple[float, float]  # of a note's length, as ``Postings.weight`` has it: constant part, part for each word


def _search_block(index: Postings, plan: DataFrame, k: int) -> DataFrame:
    """The best notes of some of the questions; of what is written on the way only they stay."""
    # What one question reads of a word all have, so the word's lowest cut is that of all.
    of_term = W.partitionBy("bucket", "term")
    of_word = plan.select("question_id", "bucket", "term", "rarity", F.min("cut").over(of_term).alias("cut"),
                          F.min("rest").over(of_term).alias("rest"), "floor")
    words, asked = _numbered(index, of_word)
    found = materialize(
        _scan(index, plan, "cut").join(F.broadcast(words), ["bucket", "term"]).where(F.col("band") >= F.col("cut"))
        .select("note_id", "word", F.col("tf").cast("double").alias("tf"), F.col("words").cast("double").alias("words"))
        .repartition("note_id").mapInArrow(
            _best_here(index.spark.sparkContext.broadcast(asked), k),
            f"question_id {plan.schema['question_id'].dataType.simpleString()}, note_id {index.kind}, _partial double, _reach double"),
        "partial_scores")
    best = topk_per_key(found.select("question_id", "_partial"), ["question_id"], [F.desc("_partial")], k)
    kth = best.where(F.col("position") == k).select("question_id", F.col("_partial").alias("_kth"))
    near = found.join(kth, "question_id", "left").where(
        F.col("_reach") >= F.coalesce("_kth", F.lit(0.0)) - MARGIN).select("question_id", "note_id", "_partial")
    near = materialize(near, "near_notes")
    discard(found)
    more = F.lit(0.0)
    if asked.rest.any():
        # The bands below the cut, for these notes only.
        share = F.col("rarity") * index.weight()
        below = of_word.where(F.col("rest") > 0).select("question_id", "bucket", "term", "rarity", "cut")
        looked_up = near.select("question_id", "note_id").join(below, "question_id")
        added = (
            _scan(index, below).join(looked_up, ["bucket", "term", "note_id"]).where(F.col("band") < F.col("cut"))
            .groupBy("question_id", "note_id").agg(F.sum(share).alias("_more"))
        )
        scored, more = near.join(added, ["question_id", "note_id"], "left"), F.coalesce("_more", F.lit(0.0))
    else:
        scored = near
    scored = scored.select("question_id", "note_id", F.round(F.col("_partial") + more, PLACES).alias("score"))
    top = topk_per_key(scored, ["question_id"], [F.desc("score"), F.asc("note_id")], k)
    top = materialize(
        top.withColumn("text_rank", F.rank().over(W.partitionBy("question_id").orderBy(F.desc("score")))).drop("position"), "best_notes")
    discard(near)
    return top


def _numbered(index: Postings, of_word: DataFrame) -> tuple[DataFrame, _Asked]:
    """The words of a block with their numbers and cuts, and its questions."""
    table = of_word.toArrow().combine_chunks().sort_by([("bucket", "ascending"), ("term", "ascending")])
    column = lambda name: np.asarray(table.column(name).combine_chunks())
    terms = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy()  # a word has one bucket
    new = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else terms
    ids = table.column("question_id").combine_chunks().dictionary_encode()
    asking = ids.indices.to_numpy().astype(np.int64)
    floor = np.zeros(len(ids.dictionary))
    floor[asking] = column("floor")
    words = table.take(pa.array(new)).select(["bucket", "term", "cut"]).append_column("word", pa.array(np.arange(len(new), dtype=np.int32)))
    average = index.words / index.notes if index.words else 1.0
    asked = _Asked(
        np.append(new, len(terms)), asking, column("rarity")[new], column("rest")[new], ids.dictionary, floor,
        np.bincount(asking, column("rest"), len(floor)), (BM25_K1 * (1 - BM25_B), BM25_K1 * BM25_B / average))
    kinds = "bucket int, term string, cut int, word int"
    return index.spark.createDataFrame(words, kinds) if len(new) else index.spark.createDataFrame([], kinds), asked


def _best_here(shared, k: int):
    """Partial scores of a task's notes, all of whose postings it has, that its own ``k`` best leave a chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        asked, read = shared.value, pa.Table.from_batches(batches)
        ids = read.column(0).combine_chunks().dictionary_encode()
        note = ids.indices.to_numpy()
        order = np.argsort(note, kind="stable")
        note, (word, tf, length) = note[order], (np.asarray(read.column(n).combine_chunks())[order] for n in (1, 2, 3))
        share = asked.rarity[word] * (tf * (BM25_K1 + 1) / (tf + asked.norm[0] + asked.norm[1] * length))
        begin = np.searchsorted(note, np.arange(len(ids.dictionary) + 1))
        kept, least = [], asked.floor.copy()
        step = max(1, STEP_CELLS // len(least))
        for low in range(0, len(ids.dictionary), step):
            high = min(low + step, len(ids.dictionary))
            own = slice(begin[low], begin[high])
            partial, seen = _step_scores(asked, note[own] - low, word[own], share[own], high - low)
            if high - low >= k:
                least = np.maximum(least, np.partition(partial, high - low - k, axis=1)[:, high - low - k])
            reach = partial if seen is None else partial + (asked.all_rest[:, None] - seen)
            q, i = np.nonzero((partial > 0) & (reach >= least[:, None] - MARGIN))
            kept.append((q, i + low, partial[q, i], reach[q, i]))
        q, i, partial, reach = (np.concatenate(x) for x in zip(*kept))
        near = reach >= least[q] - MARGIN
        found = pa.Table.from_arrays(
            [asked.questions.take(pa.array(q[near])), ids.dictionary.take(pa.array(i[near])), pa.array(partial[near]), pa.array(reach[near])],
            names=["question_id", "note_id", "_partial", "_reach"])
        yield from found.to_batches(max_chunksize=1 << 16)

    return run


def _step_scores(
    asked: _Asked, note: np.ndarray, word: np.ndarray, share: np.ndarray, notes: int
) -> tuple[np.ndarray, np.ndarray | None]:
    """Sums of the shares by question and note, and of the words' rests if there are any."""
    times = asked.first[word + 1] - asked.first[word]
    ends = np.cumsum(times)
    size = len(asked.floor) * notes
    partial, seen = np.zeros(size), np.zeros(size) if asked.rest.any() else None
    at = 0
    while at < len(word):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_POSTINGS, "right")))
        own, n = slice(at, to), times[at:to]
        # Place among the askers of all words: from the word's first one on.
        place = np.arange(n.sum()) + np.repeat(asked.first[word[own]] - (np.cumsum(n) - n), n)
        cell = asked.asking[place] * notes + np.repeat(note[own], n)
        partial += np.bincount(cell, np.repeat(share[own], n), size)
        if seen is not None:
            seen += np.bincount(cell, np.repeat(asked.rest[word[own]], n), size)
        at = to
    shape = len(asked.floor), notes
    return partial.reshape(shape), None if seen is None else seen.reshape(shape)

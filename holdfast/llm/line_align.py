"""Line deduplication by pairwise alignment.

Documents overlap if they share a rare run: consecutive lines that together have enough words
to be deleted, be it a single long line or a passage of short ones that are common by
themselves.  The hash of every shortest such run (from each line on, and up to each line) ties
the documents that have it to the first of them, so a run that thousands of documents share
makes one pair for each, not one for every two, and every block that is long enough meets its
first holder.  A pair is aligned by patience diff: runs that stand once on both sides are
anchors, the longest sequence of them that rises on both sides is kept, and blocks grow from
the anchors over equal lines.  What no block has taken is aligned again with the whole earlier
document, until nothing is left to find, so that moved blocks and passages that stand more
often in the later document are found, too.  Aligned blocks are deleted from the later
document (the one with the larger id).

Blocks are found in the original texts, so the first document of a line keeps it unless a
longer block takes it to an even earlier one.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm import textbytes as tb
from holdfast.llm.quality import lines_of
from holdfast.llm.settings import unused
from holdfast.session import materialize

#: Words that a block must have to be deleted; runs of so many tie documents.
MIN_BLOCK_WORDS = 10


def line_hashes(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every line (A-Z count as a-z), its number of words, and each row's first line."""
    starts, ends, first = lines_of(flat, at)
    word_at = tb.words(flat, at, tb.SPACED)[0]
    count = np.searchsorted(word_at, ends) - np.searchsorted(word_at, starts)
    return tb.word_hashes(flat, starts, ends).view(np.int64), count, first


def _hashed(batches):
    for batch in batches:
        for low, high, flat, at in tb.slices(batch.column(1)):
            hashes, count, first = line_hashes(flat, at)
            edge = list(zip(first[:-1].tolist(), first[1:].tolist()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(low, high - low).cast(pa.int64()),
                pa.array([hashes[a:b].tobytes() for a, b in edge], pa.binary()),
                pa.array([count[a:b].astype("<u4").tobytes() for a, b in edge], pa.binary()),
            ], names=["doc_id", "hashes", "words"])


def runs(lines: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shortest runs of lines with ``least`` words, from each line on and up to each line: start, end and hash.

    They cover every run that has so many words, and equal runs are cut in the same way.
    """
    at = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    low = np.arange(len(lines))
    high = np.searchsorted(at, at[:-1] + least)
    low, high = low[high <= len(lines)], high[high <= len(lines)]
    until = np.flatnonzero(at >= max(1, least))
    starts = np.concatenate([low, np.searchsorted(at, at[until] - least, "right") - 1])
    ends = np.concatenate([np.maximum(high, low + 1), until])
    use = starts < ends
    return starts[use], ends[use], tb.run_hashes(lines.view(tb.U64), starts[use], ends[use]).view(np.int64)


def _runs(min_words: int):
    """Hashes of each document's runs of enough words."""

    def run(batches):
        for batch in batches:
            for doc, raw, words in zip(*(c.to_pylist() for c in batch.columns)):
                found = np.unique(runs(np.frombuffer(raw, np.int64), np.frombuffer(words, "<u4"), min_words)[2])
                if len(found):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found), pa.array(np.full(len(found), doc, np.int64))], names=["run", "doc_id"])

    return run


def _longest_rise(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (in order of the first number) whose second numbers rise."""
    tails, places, back = [], [], [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        if at == len(tails):
            tails.append(j)
            places.append(k)
        else:
            tails[at], places[at] = j, k
        back[k] = places[at - 1] if at else -1
    out, k = [], places[-1] if places else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _anchors(todo: list[tuple[int, int]], there: dict[int, list[int]]) -> list[tuple[int, int]]:
    """Matches (place in a, place in b) of runs: those that stand once on either side, or all at their first place in a."""
    places: dict[int, list[int]] = {}
    for start, key in todo:
        places.setdefault(key, []).append(start)
    single = [(there[key][0], at[0]) for key, at in places.items() if len(at) == len(there[key]) == 1]
    found = single or [(there[key][0], start) for start, key in todo]
    # Of several matches of one place of a, a rise takes one: falling places of b never rise.
    return _longest_rise(sorted(found, key=lambda m: (m[0], -m[1])))


def _grown(a: list, b: list, i: int, j: int) -> tuple[int, int]:
    """The block of ``b`` around place ``j`` that equals ``a`` around place ``i``."""
    low, high = 0, 0
    while i + high < len(a) and j + high < len(b) and a[i + high] == b[j + high]:
        high += 1
    while i - low > 0 and j - low > 0 and a[i - low - 1] == b[j - low - 1]:
        low += 1
    return j - low, j + high


def aligned_blocks(a, b, words, min_words: int = MIN_BLOCK_WORDS) -> list[int]:
    """Places of lines of ``b`` in blocks of at least ``min_words`` words that align with ``a``.

    ``words`` are those of each line of ``b``.  Every round aligns ``b`` with the whole of ``a``: anchors are runs of
    lines that both have, in the longest order that rises on both sides, and blocks grow from them over equal lines.
    The next round aligns what no block has taken yet, so that passages that are moved, or stand more often in
    ``b``, are found in the end.
    """
    a, b = list(a), list(b)
    # A line that b lacks gets words enough to be a run of its own.
    number = {line: k for k, line in enumerate(dict.fromkeys(b))}
    count = dict(zip(b, map(int, words)))
    lines = lambda x: tb.mix(np.array([number.get(line, len(number)) for line in x], tb.U64)).view(np.int64)
    there: dict[int, list[int]] = {}
    starts, _, keys = runs(lines(a), np.array([count.get(line, min_words) for line in a], np.int64), min_words)
    for start, key in sorted(set(zip(starts.tolist(), keys.tolist()))):
        there.setdefault(key, []).append(start)
    todo = [(i, j, key) for i, j, key in zip(*(x.tolist() for x in runs(lines(b), np.array([count[x] for x in b], np.int64), min_words)))
            if key in there]
    todo, gone = sorted(set(todo)), set()
    while todo:
        taken = (0, 0, 0)  # the block that grew last, and the distance of its places in a and b
        for i, j in _anchors([(start, key) for start, _, key in todo], there):
            if not (taken[0] <= j < taken[1] and i - j == taken[2]):
                taken = (*_grown(a, b, i, j), i - j)
                gone.update(range(*taken[:2]))
        todo = [run for run in todo if not all(k in gone for k in range(run[0], run[1]))]
    return sorted(gone)


def _aligned(min_words: int):
    def run(batches):
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            rows = []
            for doc, words, later, earlier in zip(*columns):
                count = np.frombuffer(words, "<u4")
                gone = aligned_blocks(np.frombuffer(earlier, np.int64).tolist(), np.frombuffer(later, np.int64).tolist(),
                                      count, min_words)
                if gone:
                    rows.append((doc, gone))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))],
                    names=["doc_id", "gone"])

    return run


def repeated_lines(docs: DataFrame, min_block_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """``doc_id`` and ``gone``: the line numbers (from 0) that each document loses; documents that lose any.

    ``docs`` needs an integer ``doc_id`` and ``text``; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text <> ''")
    lines = materialize(rows.mapInArrow(_hashed, "doc_id long, hashes binary, words binary"), "lines")
    held = lines.mapInArrow(_runs(min_block_words), "run long, doc_id long")
    first = held.groupBy("run").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    # Written, so that the join may split a run that very many documents have.
    first = materialize(first.select("run", "first"), "first_runs")
    pairs = held.join(first, "run").where("doc_id <> first").select("first", "doc_id").distinct()
    later = pairs.join(lines, "doc_id").select("first", "doc_id", "words", F.col("hashes").alias("later"))
    both = later.join(lines.select(F.col("doc_id").alias("first"), F.col("hashes").alias("earlier")), "first")
    found = both.select("doc_id", "words", "later", "earlier").mapInArrow(
        _aligned(min_block_words), "doc_id long, gone array<int>")
    return found.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("gone")))).alias("gone"))


def _without(batches):
    """The lines to remove stand in the last column."""
    for batch in batches:
        text = batch.schema.get_field_index("text")
        out, lost = [], []
        for value, lines in zip(batch.column(text).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            lost.append(len(lines or ()))
            if lines:
                drop = set(lines)
                value = "\n".join(line for i, line in enumerate(value.split("\n")) if i not in drop)
            out.append(value)
        columns = [pa.array(out, pa.string()) if i == text else c for i, c in enumerate(batch.columns[:-1])]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(lost, pa.int64())], names=[*batch.schema.names[:-1], "n_removed"])


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the repeated lines, and ``n_removed``, the number of lines that went.

    All other columns stay (one called ``n_removed`` is replaced).  A NULL or empty text, and the text of a row
    without id, stays as it is.  Rows that repeat an id are one document: they are not compared with each other, and
    each loses the lines that the document loses.  Equal lines are equal up to the case of A-Z; of documents with
    equal lines the smallest id keeps them.  An empty table gives an empty one; texts are taken whole.
    """
    docs = docs.drop("n_removed")
    doc, lost = unused("_doc", docs), unused("_gone", docs)
    gone = repeated_lines(docs, **options).select(F.col("doc_id").alias(doc), F.col("gone").alias(lost))
    joined = docs.join(gone, docs["doc_id"].cast("long") == F.col(doc), "left").select(*docs.columns, lost)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", n_removed long"
    return joined.mapInArrow(_without, schema)

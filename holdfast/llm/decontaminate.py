"""Benchmark decontamination by winnowed k-gram fingerprints.

A benchmark item is a list of words; its windows are its runs of ``window`` consecutive
words (an item of fewer words is one window of all of them).  Both sides keep the minimum
k-gram hash of every ``window - k + 1`` consecutive k-grams, so that two texts with a run
of ``window`` words in common share a fingerprint inside that run (the winnowing
guarantee).  Fingerprints that match are extended to the windows around them, and the
words of every window that occurs are marked.

The benchmark is read in blocks of at most ``block_words`` words (the bound of what the driver
and a task hold); each block meets all documents in a job of its own, whose hits are written
before the next block is read, so any size of benchmark is exact.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm import textbytes as tb
from holdfast.session import materialize

WINDOW, GRAM = 10, 5
#: Words of the benchmark that one broadcast holds at most, about 32 bytes each.
BLOCK_WORDS = 1 << 20
_SCHEMA = "doc_id {id}, n_words long, starts array<long>, ends array<long>, items array<string>, row binary"


@dataclass
class Block:
    """Windows of some benchmark items, by length, sorted by hash, with the items that have them."""

    prints: np.ndarray  # fingerprints of the long items
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length -> window hashes, item offsets, items
    items: list[str]


def winnow(hashes: np.ndarray, valid: np.ndarray, span: int) -> np.ndarray:
    """Indices of the k-grams that are the minimum of some ``span`` consecutive ones.

    A k-gram that is not ``valid`` (it crosses rows) never is one; windows at a row's end are shorter, which
    only adds fingerprints.
    """
    top = np.uint64(2**64 - 1)
    h = np.where(valid, hashes, top)
    padded = np.concatenate([np.full(span - 1, top), h, np.full(span - 1, top)])
    low = padded[: len(h) + span - 1].copy()
    for k in range(1, span):
        np.minimum(low, padded[k : k + len(low)], out=low)
    high = low[: len(h)].copy()
    for k in range(1, span):
        np.maximum(high, low[k : k + len(h)], out=high)
    return np.flatnonzero(valid & (high == h))


def _grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words and whether each lies in one row."""
    runs = tb.grams(hashes, n)
    row = tb.row_of(first, len(hashes))
    return runs, row[: len(runs)] == row[n - 1 :][: len(runs)]


def _block(ids: list[str], texts: list, window: int, k: int) -> Block:
    flat, at = tb.buffers(pa.array(texts, pa.large_string()))
    flat, at = flat[at[0] : at[-1]], at - at[0]
    starts, ends, first = tb.words(flat, at, tb.LETTERS)
    hashes, size = tb.word_hashes(flat, starts, ends), np.diff(first)
    # Rows that repeat an id are one item with the windows of all of them.
    index = {name: i for i, name in reversed(list(enumerate(ids)))}
    item = np.array([index[name] for name in ids], np.int64)
    kept = {}
    for n in sorted({min(int(s), window) for s in size if s}):
        runs, valid = _grams(hashes, first, n)
        row = tb.row_of(first, len(hashes))[: len(runs)]
        take = valid & (size[row] >= window if n == window else size[row] == n)
        pairs = np.unique(np.stack([runs[take], item[row[take]].astype(np.uint64)]), axis=1)
        keys, begin = np.unique(pairs[0], return_index=True)
        kept[n] = (keys, np.append(begin, pairs.shape[1]), pairs[1].astype(np.int64))
    prints = np.zeros(0, np.uint64)
    if window in kept:
        runs, valid = _grams(hashes, first, k)
        valid &= size[tb.row_of(first, len(hashes))[: len(runs)]] >= window
        prints = np.unique(runs[winnow(runs, valid, window - k + 1)])
    return Block(prints, kept, ids)


def _within(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur, and the index of each that does."""
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    found = sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), bool)
    return found, at[found]


def _hits(block: Block, hashes: np.ndarray, first: np.ndarray, window: int, k: int):
    """Word positions at which a window begins, the window's length, and its index among those of that length."""
    for n, (keys, _, _) in block.runs.items():
        if n == window:
            runs, valid = _grams(hashes, first, k)
            at = winnow(runs, valid, window - k + 1)
            at = at[_within(block.prints, runs[at])[0]]
            # A window around a fingerprint begins at most window - k words before it.
            at = np.unique((at[:, None] - np.arange(window - k + 1)).ravel())
            row = tb.row_of(first, len(hashes))
            at = at[(at >= 0) & (at + n <= len(hashes))]
            at = at[row[at] == row[at + n - 1]]
            runs = np.array([], np.uint64) if not len(at) else _runs_at(hashes, at, n)
        else:
            runs, valid = _grams(hashes, first, n)
            at = np.flatnonzero(valid)
            runs = runs[at]
        found, which = _within(keys, runs)
        if found.any():
            yield n, at[found], which


def _runs_at(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    picked = hashes[(at[:, None] + np.arange(n)).ravel()]
    return tb.grams(picked, n)[::n]


def _search(block: Block, window: int, k: int, id_type: pa.DataType):
    def run(batches):
        for batch in batches:
            for low, high, flat, at in tb.slices(batch.column(1)):
                starts, ends, first = tb.words(flat, at, tb.LETTERS)
                hashes = tb.word_hashes(flat, starts, ends)
                marks = np.zeros(len(hashes) + 1, np.int64)
                pairs = []
                row = tb.row_of(first, len(hashes))
                for n, begin, which in _hits(block, hashes, first, window, k):
                    np.add.at(marks, begin, 1)
                    np.add.at(marks, begin + n, -1)
                    _, offsets, items = block.runs[n]
                    seen = np.unique(np.stack([row[begin], which]), axis=1)
                    count = offsets[seen[1] + 1] - offsets[seen[1]]
                    index = np.repeat(offsets[seen[1]] - np.cumsum(count) + count, count) + np.arange(count.sum())
                    pairs.append(np.stack([np.repeat(seen[0], count), items[index]]))
                hit = np.cumsum(marks[:-1]) > 0
                step = np.diff(hit.astype(np.int8), prepend=0, append=0)
                # Spans end at a row's end: two rows' spans that touch are cut there.
                cut = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(hit))]
                cut = np.unique(cut[hit[cut] & hit[cut - 1]]) if len(cut) else cut
                span_from = np.union1d(np.flatnonzero(step > 0), cut).astype(np.int64)
                span_to = np.union1d(np.flatnonzero(step < 0), cut).astype(np.int64)
                owner = row[span_from] if len(span_from) else span_from
                found = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)
                rows = np.arange(high - low + 1)
                by_span, by_item = np.searchsorted(owner, rows), np.searchsorted(found[0], rows)
                base = np.repeat(first[:-1], np.diff(by_span))
                lists = [pa.ListArray.from_arrays(pa.array(by_span, pa.int32()), pa.array(x - base))
                         for x in (span_from, span_to)]
                ids = pa.array([block.items[i] for i in found[1]], pa.string())
                # Rows that share an id are told apart by their texts.
                seals = [hashlib.blake2b(flat[a:b], digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low).cast(id_type), pa.array(np.diff(first)), *lists,
                     pa.ListArray.from_arrays(pa.array(by_item, pa.int32()), ids), pa.array(seals, pa.binary())],
                    names=["doc_id", "n_words", "starts", "ends", "items", "row"],
                )

    return run


def _blocks(benchmark: DataFrame, block_words: int):
    """Ranges of items with at most ``block_words`` words each (a longer item is a block of its own)."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(
        "item_id IS NOT NULL AND text IS NOT NULL"
    )
    ids, texts, size = [], [], 0
    for r in rows.toLocalIterator():
        n = len(r.text.encode()) // 2 + 1  # words at most
        if ids and size + n > block_words:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += n
    yield ids, texts


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = GRAM, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Words of each document that lie in a window of a benchmark item.

    ``docs`` needs ``doc_id`` and ``text``, ``benchmark`` needs ``item_id`` and ``text``; further columns are not
    read.  One row per row of ``docs``: ``doc_id``, ``n_words``, ``starts`` and ``ends`` (word spans that are hit,
    in order, apart from each other), ``items`` (ids with an occurring window, sorted as text).

    A NULL or empty text has no words and no hits; an item without words or without id has no windows; repeated
    rows of ``docs`` give repeated rows, repeated items one id; an empty benchmark hits nothing.  Texts of any
    length are searched whole.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    schema = _SCHEMA.format(id=kind.simpleString())
    id_type = pa.string() if kind.simpleString() == "string" else _arrow(kind)
    search = lambda ids, texts: docs.mapInArrow(
        _search(_block(ids, texts, window, k), window, k, id_type), schema)
    blocks = _blocks(benchmark, block_words)
    head = list(islice(blocks, 2))
    if len(head) == 1:
        return search(*head[0]).drop("row")
    # The first block's table has all rows, those of the others the rows with hits.
    out = materialize(search(*head[0]).withColumn("whole", F.lit(True)), "overlaps")
    for ids, texts in chain(head[1:], blocks):
        found = search(ids, texts).where(F.size("starts") > 0).withColumn("whole", F.lit(False))
        out = out.unionByName(materialize(found, "overlaps"))
    grouped = out.groupBy("doc_id", "n_words", "row").agg(
        F.flatten(F.collect_set(F.arrays_zip("starts", "ends"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.count_if("whole").alias("_rows"),
    )
    merged = F.aggregate(
        F.array_sort("spans"), F.expr("CAST(array() AS array<struct<starts:bigint,ends:bigint>>)"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["ends"] >= s["starts"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["starts"].alias("starts"),
                                 F.greatest(F.element_at(done, -1)["ends"], s["ends"]).alias("ends"))),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    return grouped.withColumn("spans", merged).select(
        "doc_id", "n_words", F.col("spans.starts").alias("starts"), F.col("spans.ends").alias("ends"), "items",
        F.explode(F.sequence(F.lit(1), "_rows")).alias("_copy"),
    ).drop("_copy")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Counts of :func:`find_overlaps` per row of ``docs``; ``contaminated`` where any word is hit.

    A NULL or empty text has no words and is clean; repeated rows, ties and empty tables as there.
    """
    found = find_overlaps(docs, benchmark, **options)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    n_hit = total(F.col("ends")) - total(F.col("starts"))
    items = F.array_sort("items")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        items.alias("items"),
    )


def _clean(block: Block, window: int, k: int):
    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            for low, high, flat, at in tb.slices(column):
                starts, ends, first = tb.words(flat, at, tb.LETTERS)
                hashes = tb.word_hashes(flat, starts, ends)
                keep, row = np.ones(high - low, bool), tb.row_of(first, len(hashes))
                for _, begin, _ in _hits(block, hashes, first, window, k):
                    keep[row[begin]] = False
                yield batch.slice(low, high - low).filter(pa.array(keep))

    return run


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = GRAM, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The documents without a hit, with all their columns, in one pass per block and without an exchange.

    NULL and empty texts, and all documents if the benchmark is empty, stay; each row stands for itself, also rows
    that repeat an id.  Of a benchmark of several blocks, what each block leaves is written before the next is read.
    """
    blocks = _blocks(benchmark, block_words)
    head = list(islice(blocks, 2))
    for number, (ids, texts) in enumerate(chain(head, blocks)):
        docs = materialize(docs, "clean") if number else docs
        docs = docs.mapInArrow(_clean(_block(ids, texts, window, k), window, k), docs.schema)
    return docs

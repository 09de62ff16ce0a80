"""N-gram Jaccard join: a grouped prefix join over word shingles.

A document is the set of its distinct five-word shingles.  Equal sets are one document to
the join.  All shingles are ordered by how many documents have them (rare ones first), so
two sets that are similar enough share a shingle among the first ``n - ceil(t n) + 1`` of
each (the prefix), and a shingle of one document only never matters.  Documents with the
same size and the same prefix form one group; groups that share a prefix shingle and have
sizes and positions that allow the threshold are expanded to members and verified on the
whole sets.

Counting is packed: a task sends, per slice of texts and bucket of hashes, one row with
32-bit remainders, and gets back the shingles that several documents have.

Candidates are verified in two steps, so that a group of many near copies costs one link
per member and not one per pair: first every document against the smallest one that
shares a prefix shingle with it, which ties near copies together; then every remaining
pair whose documents are not yet in one component.  A pair inside a component cannot change
the components, so they are those of all links.
"""

import string

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm import textbytes as tb
from holdfast.llm.graph import components
from holdfast.llm.settings import buckets_for, unused
from holdfast.session import materialize

SHINGLE, PERCENT = 5, 80
#: Ids of repeated documents are broadcast up to this number (8 bytes each), else joined by an exchange.
BROADCAST_IDS = 1 << 20
#: Sets of several rows are broadcast up to this number (32 bytes each).
BROADCAST_SETS = 1 << 19
#: Documents that a task handles at a time where each brings all its shingles.
ROWS = 64
#: Texts whose shingles travel as one row per bucket.
SLICE = 16 << 20


def shingle_sets(flat: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and the rows' offsets.

    A row of fewer than ``n`` words, but not none, has one shingle: all its words.
    """
    starts, ends, first = tb.words(flat, at, tb.SPACED)
    hashes = tb.word_hashes(flat, starts, ends)
    size = np.diff(first)
    runs = tb.grams(hashes, n)
    kept = np.maximum(size - n + 1, 0)
    kept[(size > 0) & (size < n)] = 1
    offsets = np.concatenate([[0], np.cumsum(kept)])
    out = np.empty(offsets[-1], np.uint64)
    for row in np.flatnonzero(size):
        a, b, f = offsets[row], offsets[row + 1], first[row]
        out[a:b] = runs[f : f + b - a] if size[row] >= n else tb.grams(hashes[f : f + size[row]], int(size[row]))
        out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[offsets[:-1][offsets[:-1] < len(out)]] = True
    return out[fresh], np.concatenate([[0], np.cumsum(fresh)])[offsets]


def _digests(n: int):
    def run(batches):
        for batch in batches:
            for low, high, flat, at in tb.slices(batch.column(1)):
                sets, offsets = shingle_sets(flat, at, n)
                sums = []
                for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(tb.mix(sets ^ np.uint64(salt)))])
                    sums.append(pa.array((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low).cast(pa.int64()), pa.array(np.diff(offsets)), *sums],
                    names=["doc_id", "n", "d1", "d2"],
                )

    return run


def _packed(n: int, buckets: int):
    """Per slice and bucket: the documents, how many hashes each has there, and the hashes' low 32 bits."""

    def run(batches):
        for batch in batches:
            for low, high, flat, at in tb.slices(batch.column(1), SLICE):
                ids = np.asarray(batch.column(0).slice(low, high - low).cast(pa.int64()))
                hashes, offsets = [], [np.zeros(1, np.int64)]
                column = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(flat)])
                for _, _, some, here in tb.slices(column):
                    sets, ends = shingle_sets(some, here, n)
                    hashes.append(sets)
                    offsets.append(ends[1:] + offsets[-1][-1])
                hashes, offsets = np.concatenate(hashes), np.concatenate(offsets)
                if not len(hashes):
                    continue
                bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets < 65536 else np.uint32)
                order = np.argsort(bucket, kind="stable")
                row = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(offsets))[order]
                bucket, rest = bucket[order], hashes[order].astype(np.uint32)
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])]))
                counts = np.diff(np.append(new, len(row))).astype(np.uint32)
                owner, place = ids[row[new]], bucket[new]
                begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                stop = np.append(begin[1:], len(place))
                edge = np.append(new, len(row))
                yield pa.RecordBatch.from_arrays([
                    pa.array(place[begin].astype(np.int32)),
                    pa.array([owner[a:b].tobytes() for a, b in zip(begin, stop)], pa.binary()),
                    pa.array([counts[a:b].tobytes() for a, b in zip(begin, stop)], pa.binary()),
                    pa.array([rest[edge[a] : edge[b]].tobytes() for a, b in zip(begin, stop)], pa.binary()),
                ], names=["bucket", "ids", "counts", "hashes"])

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of one bucket: for each document its hashes that other documents have too, with their frequencies."""
    def joined(name, kind):
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    ids, counts, hashes = joined("ids", np.int64), joined("counts", np.uint32), joined("hashes", np.uint32)
    bucket = table.column("bucket")[0].as_py()
    order = np.argsort(hashes, kind="stable")
    keys, owner = hashes[order], np.repeat(ids, counts)[order]
    del order, hashes
    edge = np.concatenate([[True], keys[1:] != keys[:-1], [True]])
    size = np.diff(np.flatnonzero(edge))
    many = np.repeat(size > 1, size)
    frequency = np.repeat(size, size)[many].astype(np.uint32)
    keys, owner = keys[many], owner[many]
    order = np.lexsort((keys, owner))
    keys, owner, frequency = keys[order], owner[order], frequency[order]
    if len(keys):  # an id on repeated rows counts once
        once = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])
        keys, owner, frequency = keys[once], owner[once], frequency[once]
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    stop = np.append(begin[1:], len(owner))[: len(begin)]
    return pa.table({
        "doc_id": pa.array(owner[begin]), "bucket": pa.array(np.full(len(begin), bucket, np.int32)),
        "kept": pa.array(stop - begin),
        "hashes": pa.array([keys[a:b].tobytes() for a, b in zip(begin, stop)], pa.binary()),
        "frequencies": pa.array([frequency[a:b].tobytes() for a, b in zip(begin, stop)], pa.binary()),
    })


def _prefixes(percent: int):
    """Order a document's shared shingles: the prefix, and all of them for verification."""

    def run(batches):
        # Few rows at a time: a row holds all shared shingles of a document, in parts.
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            prefix, whole = [], []
            sizes, kept = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for n, k, parts in zip(sizes, kept, (p.as_py() for p in batch.column(3))):
                keys = np.concatenate([np.frombuffer(p["hashes"], np.uint32).astype(np.int64) | p["bucket"] << 32 for p in parts])
                frequency = np.concatenate([np.frombuffer(p["frequencies"], np.uint32) for p in parts])
                length = n + (-percent * n // 100) + 1 - (n - k)
                prefix.append(keys[np.lexsort((keys, frequency))[: max(0, length)]])
                keys.sort()
                whole.append(keys.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prefix, pa.list_(pa.int64())),
                 pa.array([n - k for n, k in zip(sizes, kept)], pa.int64()), pa.array(whole, pa.binary())],
                names=["doc_id", "n", "prefix", "ahead", "shared"],
            )

    return run


def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), True))
                      for x, y in zip(a, b)], dtype="int64")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) that link; the side with more pairs per document is joined last."""
    side = lambda x: sets.select(
        F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("shared").alias(f"shared_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    common = both.withColumn("common", F.pandas_udf(_overlap, "long")("shared_a", "shared_b"))
    return common.where(f"100 * common >= {percent} * (n_a + n_b - common)").select("a", "b")


def document_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n`` (size of the set), ``rep`` (smallest id with an equal set)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(docs.mapInArrow(_digests(shingle), "doc_id long, n long, d1 long, d2 long"), "sets")
    same = rows.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("_rows"))
    # Only sets that several rows have.  Written, so that a join by exchange can split a set that many have.
    same = materialize(same.where("_rows > 1").drop("_rows"), "repeated")
    if same.count() <= BROADCAST_SETS:
        same = F.broadcast(same)
    joined = rows.join(same, ["n", "d1", "d2"], "left")
    return materialize(joined.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "sets")


def links(docs: DataFrame, sets: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Links (``a``, ``b``) between the representatives of :func:`document_sets` whose components are those of all links."""
    buckets = buckets_for(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    repeated = sets.where("doc_id <> rep").select("doc_id").distinct()
    if repeated.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        repeated = F.broadcast(repeated)
    packed = docs.join(repeated, "doc_id", "left_anti").mapInArrow(
        _packed(shingle, buckets), "bucket int, ids binary, counts binary, hashes binary")
    shared = packed.groupBy("bucket").applyInArrow(
        _shared, "doc_id long, bucket int, kept long, hashes binary, frequencies binary")
    parts = shared.groupBy("doc_id").agg(
        F.sum("kept").alias("kept"), F.collect_list(F.struct("bucket", "hashes", "frequencies")).alias("parts"))
    size = sets.where("doc_id = rep AND n > 0").groupBy("doc_id").agg(F.max("n").alias("n"))
    # A document has candidates only if its own shingles do not fill the prefix.
    close = parts.join(size, "doc_id").where(f"n - kept < n - ({percent} * n + 99) div 100 + 1")
    tokens = materialize(
        close.select("doc_id", "n", "kept", "parts").mapInArrow(
            _prefixes(percent), "doc_id long, n long, prefix array<long>, ahead long, shared binary"),
        "shingles",
    )
    groups = tokens.groupBy("n", "prefix").agg(F.min("doc_id").alias("gid"), F.min("ahead").alias("ahead"))
    groups = materialize(groups, "groups")
    members = materialize(
        tokens.select("doc_id", "n", "prefix").join(groups, ["n", "prefix"]).select("doc_id", "gid"), "members")
    postings = groups.select("gid", "n", "ahead", F.posexplode("prefix").alias("at", "token"))
    ratio = 100 / percent
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(ratio))).cast("int")
    banded = postings.select("gid", "token", F.explode(F.array(band, band + 1)).alias("band"))
    leads = banded.groupBy("token", "band").agg(F.min("gid").alias("lead"), F.count("*").alias("_n")).where("_n > 1")
    stars = banded.join(leads, ["token", "band"]).select(F.col("lead").alias("a"), "gid").distinct()
    # Each member against the lead of its group's lists, and against the first of its own group.
    pairs = stars.join(members, "gid").select("a", F.col("doc_id").alias("b")).unionByName(
        members.select(F.col("gid").alias("a"), F.col("doc_id").alias("b"))).where("a <> b")
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    found = materialize(_verified(pairs, tokens, percent), "links")
    label = components(found, "a", "b").withColumnRenamed("node", "doc_id")
    known = members.join(label, "doc_id", "left").select(
        "doc_id", "gid", F.coalesce("component", "doc_id").alias("component"))
    lists = postings.join(known, "gid").select(
        "token", "n", (F.col("ahead") + F.col("at")).alias("at"), "doc_id", "component")
    mixed = lists.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    lists = materialize(lists.join(mixed.where("low < high").select("token"), "token"), "lists")
    one, two = lists.alias("one"), lists.alias("two")
    # The overlap of two sets that first meet here is at most what follows in the shorter rest.
    bound = F.least(F.expr("one.n - one.at"), F.expr("two.n - two.at"))
    rest = one.join(two, (F.col("one.token") == F.col("two.token"))
                    & F.expr("one.component <> two.component AND one.doc_id < two.doc_id")
                    & F.expr(f"100 * least(one.n, two.n) >= {percent} * greatest(one.n, two.n)")
                    & ((100 + percent) * bound >= percent * F.expr("one.n + two.n")))
    rest = rest.select(F.col("one.doc_id").alias("a"), F.col("two.doc_id").alias("b")).distinct()
    more = _verified(rest.join(pairs, ["a", "b"], "left_anti"), tokens, percent)
    return found.unionByName(materialize(more, "links"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``.

    Two documents link when ``100 * intersection >= percent * union`` of their shingle sets; ``component_id`` is the
    smallest ``doc_id`` reachable by links, itself included.  ``docs`` needs an integer ``doc_id`` and ``text``; other
    columns are not read.

    NULL and empty texts and texts without words have no shingles and are alone.  Repeated rows give repeated rows.
    A row without id has the component of an equal document, if there is one with an id, else NULL; it links nothing.
    An id on rows with different texts is one document to the links, with the size of each row its own.  Equal sizes
    and frequencies are ordered by hash.  Texts of any length are taken whole; an empty table gives an empty one.
    """
    sets = document_sets(docs, shingle)
    label = components(links(docs, sets, shingle, percent), "a", "b").withColumnRenamed("node", "rep")
    return sets.join(label, "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, with all columns: the one with the smallest id.

    Documents without words stay, and so do rows without id.  Of rows that repeat an id with the same words one
    stays; rows that repeat it with other words are documents of their own and stay.
    """
    kept, words = unused("_kept", docs), unused("_words", docs)
    first = near_duplicates(docs, **options).where("doc_id = component_id").select(F.col("doc_id").alias(kept)).distinct()
    named = docs.where("doc_id IS NOT NULL").join(first, docs["doc_id"].cast("long") == F.col(kept), "left_semi")
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    spaced = F.trim(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " "))
    named = named.withColumn(words, F.md5(spaced.cast("binary"))).dropDuplicates(["doc_id", words]).drop(words)
    return named.unionByName(docs.where("doc_id IS NULL"))

"""Importance resampling of documents towards a target distribution.

Features are words and pairs of words, hashed into buckets.  A bucket's gain is the
logarithm of its share in the target over its share in the documents, and a document's
weight is the mean gain of its features, computed on arrays of CRC-32 sums.  A Gumbel draw
that follows from the document's id is added, and the highest scores are drawn: a sample
without replacement in proportion to the exponentials of the weights.

The cutoff is found without sorting the table.  A quantile sketch gives a bracket of scores
around it; exact counts of the rows above the bracket and from its lower end on tell whether
the cutoff lies inside, and widen the bracket if not; only the bracket's rows are sorted.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from holdfast.llm import textbytes as tb
from holdfast.session import materialize

BUCKETS, SHARE, LEAST_WORDS, SEED = 10_000, 25, 20, "7"
#: Rows per sketch unit: the sketch's ranks are off by one part in so many.
ACCURACY = 10_000
#: Bytes of a word that are summed column by column; the rest of a longer one goes to zlib.
WIDE = 48
_SPACE = np.uint32(0x20)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def extend_crc(crc: np.ndarray, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of what ``crc`` stands for followed by the bytes from ``starts`` to before ``ends``."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, WIDE + 1).astype(np.int16), kind="stable")
    at, size, state = starts[order], size[order], ~crc[order]
    for k in range(min(int(size.max(initial=0)), WIDE)):
        live = int(np.searchsorted(-np.minimum(size, WIDE + 1), -k))
        now = state[:live]
        state[:live] = _CRC[(now ^ flat[at[:live] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    state = ~state
    for i in range(int(np.searchsorted(-np.minimum(size, WIDE + 1), -WIDE))):
        state[i] = zlib.crc32(flat[at[i] + WIDE : at[i] + size[i]], int(state[i]))
    out = np.empty_like(state)
    out[order] = state
    return out


def _features(flat: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, bucket of each word with the one behind it, whether there is one, the rows' first words."""
    low = _LOWER[flat]
    starts, ends, first = tb.words(flat, at, tb.LETTERS)
    word = extend_crc(np.zeros(len(starts), np.uint32), low, starts, ends)
    paired = np.ones(len(starts), bool)
    paired[first[1:][np.diff(first) > 0] - 1] = False
    i = np.flatnonzero(paired)
    spaced = ~(_CRC[(~word[i] ^ _SPACE) & np.uint32(255)] ^ (~word[i] >> np.uint32(8)))
    pair = np.zeros(len(starts), np.int64)
    pair[i] = extend_crc(spaced, low, starts[i + 1], ends[i + 1]) % np.uint32(buckets)
    return (word % np.uint32(buckets)).astype(np.int64), pair, paired, first


def _counter(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, flat, at in tb.slices(batch.column(0)):
                word, pair, paired, _ = _features(flat, at, buckets)
                total += np.bincount(word, minlength=buckets) + np.bincount(pair[paired], minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of the column ``text`` by bucket, over all rows: ``buckets`` numbers, which come to the driver.

    NULL and texts without words have no features; repeated rows count as often as they stand.
    """
    found = texts.select("text").mapInArrow(_counter(buckets), "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[np.asarray(found.column("bucket").combine_chunks())] = np.asarray(found.column("n").combine_chunks())
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share in the target over that in the source, rounded down."""
    n, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n))))
        for s, t in zip(source.tolist(), target.tolist())], np.int64)


def gumbel(seed: str, key: str) -> int:
    """Thousandths of a Gumbel draw that follows from ``seed`` and ``key``, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigher(gains: np.ndarray, seed: str, id_type: pa.DataType):
    def run(batches):
        for batch in batches:
            for low, high, flat, at in tb.slices(batch.column(2)):
                word, pair, paired, first = _features(flat, at, len(gains))
                each = gains[word] + np.where(paired, gains[pair], 0)
                sums = np.concatenate([[0], np.cumsum(each)])
                n_words = np.diff(first)
                n = n_words + np.maximum(n_words - 1, 0)
                weight = (sums[first[1:]] - sums[first[:-1]]) // np.maximum(n, 1)
                keys = batch.column(1).slice(low, high - low).to_pylist()
                score = weight + np.array([gumbel(seed, key or "") for key in keys], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low).cast(id_type), *map(pa.array, (n_words, n, weight, score))],
                    names=["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def weigh(docs: DataFrame, gains: np.ndarray, seed: str = SEED) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score``.

    ``weight`` is the floored mean of ``gains`` over the row's features, 0 without any (NULL and empty texts);
    ``score`` adds the Gumbel draw of the row's id (a NULL id draws as an empty one).  Other columns are not read.
    Rows that repeat an id draw the same number.  Texts of any length are weighed whole.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    docs = docs.select("doc_id", F.col("doc_id").cast("string").alias("key"), "text")
    kind = docs.schema["doc_id"].dataType
    return docs.mapInArrow(
        _weigher(gains, seed, to_arrow_type(kind)),
        f"doc_id {kind.simpleString()}, n_words long, n_features long, weight long, score long")


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]


def _up_to(score: int, doc_id, n_features: int) -> Column:
    """Whether a row comes no later in :func:`_order` than the row with these values."""
    same = F.col("doc_id").eqNullSafe(F.lit(doc_id))
    before = F.col("doc_id").isNotNull() if doc_id is None else F.col("doc_id") < F.lit(doc_id)
    return (F.col("score") > score) | (
        (F.col("score") == score) & (F.coalesce(before, F.lit(False)) & ~same | same & (F.col("n_features") <= n_features)))


def in_order(rows: DataFrame, out: str) -> DataFrame:
    """``rows`` with their place in :func:`_order`, from 1: sorted in ranges, written, and numbered range by range.

    Rows that are equal in the order's columns are dealt out by where they were read, so no range holds a hot value.
    """
    spread = [*_order(), F.col("_row")]
    sorted_rows = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*spread).sortWithinPartitions(*spread)
    # The number of a row: its partition in the upper bits, its place there in the lower 33.
    placed = materialize(sorted_rows.drop("_row").withColumn("_place", F.monotonically_increasing_id()), "in_order")
    part = F.shiftright("_place", 33)
    # One row per range.
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    inside = F.col("_place") - F.shiftleft(part, 33)
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(
        out, F.col("_start") + inside + 1).drop("_part", "_place", "_start")


def bracket(scores: DataFrame, n: int, k: int, accuracy: int = ACCURACY, margin: float | None = None) -> tuple[int, int, int]:
    """Lower and upper score between which the ``k``-th highest of ``n`` lies, and how many are above the upper one.

    The first bracket comes from a quantile sketch.  Exact counts outside of it show whether it holds the cutoff;
    if not, the sketch is asked for one four times as wide, in the end for the smallest and largest score.
    """
    margin = 2.0 / accuracy if margin is None else margin
    while True:
        at = 1 - k / n
        ends = [max(0.0, at - margin), min(1.0, at + margin)]
        low, high = scores.agg(F.percentile_approx("score", ends, accuracy)).first()[0]
        if ends == [0.0, 1.0]:
            low, high = scores.agg(F.min("score"), F.max("score")).first()
        above, from_low = scores.agg(
            F.sum((F.col("score") > high).cast("long")), F.sum((F.col("score") >= low).cast("long"))).first()
        if above < k <= from_low:
            return low, high, above
        margin *= 4


def draw(scored: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 … for the drawn rows by falling score, NULL for all others.

    Drawn are ``share`` percent, rounded down, of the rows with at least ``least_words`` words.  Ties go to the
    smaller ``doc_id``, rows without an id last, then to fewer features; rows equal in all of these are ranked one
    after another.  An empty table, and one too small for a draw, has no ranks.
    """
    scored = materialize(scored, "scored")
    able = F.col("n_words") >= least_words
    n = scored.where(able).count()
    k = share * n // 100
    none = F.lit(None).cast("long")
    if not k:
        return scored.withColumn("rank", none)
    low, high, above = bracket(scored.where(able).select("score"), n, k)
    inside = in_order(scored.where(able & F.col("score").between(low, high)).select("score", "doc_id", "n_features"), "place")
    cut = inside.where(F.col("place") == k - above).first()
    drawn = able & _up_to(cut.score, cut.doc_id, cut.n_features)
    ranked = in_order(scored.where(drawn), "rank")
    # Rows equal to the last one drawn may be one too many.
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return ranked.unionByName(scored.where(~drawn).withColumn("rank", none))


def resample(
    docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS,
    seed: str = SEED,
) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score``, ``rank`` of every row of ``docs``, drawn towards ``target``.

    See :func:`weigh` for NULLs and empty texts and :func:`draw` for ties, repeated rows and empty tables.  An empty
    target makes all gains those of a target without features.
    """
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    return draw(weigh(docs, gains, seed), share, least_words).select("doc_id", "n_features", "weight", "score", "rank")

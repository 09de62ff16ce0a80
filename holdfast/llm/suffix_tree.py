"""Language-model scoring with a probabilistic suffix tree over words.

Every word is a symbol, and so are the end of a text and (as context only) its start.  A
context is a run of up to ``DEPTH`` symbols.  It stores what follows it at least ``LEAST``
times, a fixed count whatever the corpus, and it is kept if that diverges from what follows
its suffix: the log-likelihood gain of its own next-symbol distribution must exceed half the
logarithm of the training size for every next symbol it stores.  The rest of a kept
context's mass, with ``BACKOFF`` added, goes to its suffix, and the empty context gives words
their add-one share.  So every state's distribution sums to one.  A text is scored by the
longest kept context at every word.

Nothing of the tree is collected or broadcast.  Runs of symbols have 64-bit keys, and the key
of a context is that of the run which it is.  Texts become slices of numbered words.  A slice
sends each key of its runs once, with its count, to the bucket of the key, whose task answers
with the count in all slices; one of the slices that sent a key gives the row of the run.  A run
can stand twice only if the runs without its first and without its last symbol do, so deeper
runs are sent only where those came back with two or more.  Scoring first asks which contexts
are kept, and then for the runs behind those.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm import textbytes as tb
from holdfast.llm.settings import buckets_for
from holdfast.session import discard, estimated_bytes, materialize

#: Times that a run must stand in the training texts to be stored; share that a word needs to be stored as next symbol.
LEAST, SYMBOL_SHARE = 2, 0.0
DEPTH, BACKOFF = 2, 4.0
#: Text of a slice, besides a single longer one; a task's memory is that of one slice, about 25 times its text.
SLICE = 4 << 20
#: Written slices for which there is a bucket, whatever the number of exchange partitions: about twice as many bytes of keys.
SLICES_BYTES = 4 << 20
#: The hashes that stand for the end and the start of a text; words hash to them by chance only.
END_HASH, START_HASH = np.int64(0x6C62272E07BB0142), np.int64(0x27D4EB2F165667C5)
_ODD = tb.U64(0xD6E8FEB86659FD93)


@dataclass
class Tree:
    """By depth, tables of the kept contexts and of their next symbols."""

    words: DataFrame  # word, n
    total: int  # training tokens
    distinct: int
    tables: list  # (contexts: b<depth> ... b1, context, size, escape; next symbols: context, word, key, n, value)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1.0) / (self.total + self.distinct + 1.0)

    def known(self, presence: bool = False) -> DataFrame:
        """``key``, ``kind``, ``value``: 0 for counts of words and of stored runs, 1 for back-off weights, 2 for sizes of contexts.

        ``presence`` leaves out what does not tell which contexts are kept, and which of them are stored as runs.
        """
        row = lambda t, key, kind, value: t.select(
            F.col(key).alias("key"), F.lit(kind).alias("kind"), F.col(value).cast("double").alias("value"))
        tables = [] if presence else [row(self.words, "word", 0, "n")]
        for depth, (contexts, following) in enumerate(self.tables, 1):
            tables.append(row(contexts, "context", 1, "escape"))
            if not presence:
                tables.append(row(contexts, "context", 2, "size"))
            if not presence or depth < len(self.tables):
                tables.append(row(following, "key", 0, "n"))
        return reduce(DataFrame.unionByName, tables) if tables else row(self.words.limit(0), "word", 0, "n")

    # A small tree in memory, to look at: symbol i is keys[i], a context is a number with the nearest symbol lowest.
    @cached_property
    def _alphabet(self) -> list[np.ndarray]:
        return _collected(self.words, "word", "n")

    keys = property(lambda self: self._alphabet[0])
    counts = property(lambda self: self._alphabet[1])
    other = property(lambda self: len(self.keys))
    start = property(lambda self: len(self.keys) + 1)
    radix = property(lambda self: len(self.keys) + 2)

    @cached_property
    def levels(self) -> list:
        """By depth: context keys, back-off weights, pair keys (index of the context, next symbol), counts, sizes."""
        out = []
        for depth, (contexts, following) in enumerate(self.tables, 1):
            names = [f"b{k}" for k in range(depth, 0, -1)]
            hashes, size, escape, *runs = _collected(contexts, "context", "size", "escape", *names)
            code = np.zeros(len(hashes), np.int64)
            for run in runs:
                code = code * self.radix + np.where(run == START_HASH, self.start, _look(self.keys, run))
            order = np.argsort(code)
            owner, word, n = _collected(following, "context", "word", "n")
            pairs = np.argsort(order)[_look(hashes, owner)] * self.radix + _look(self.keys, word)
            by = np.argsort(pairs)
            out.append((code[order], escape[order], pairs[by], n[by].astype(float), size[order]))
        return out


def _chain(run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a run that is one word longer."""
    return tb.mix(run.view(tb.U64) * _ODD + tb.mix(word.view(tb.U64) ^ _ODD)).view(np.int64)


def _look(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """The keys sorted, a place where each stands, the place of each among them, and how often it stands."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first, place = np.flatnonzero(new), np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return keys[first], order[first], place, np.diff(np.append(first, len(keys)))


def _tokens(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (signed) of each row's words with the end behind them, and the rows' first tokens."""
    starts, ends, first = tb.words(flat, at, tb.SPACED)
    hashes = tb.word_hashes(flat, starts, ends).view(np.int64)
    stop = first[1:] + np.arange(1, len(first))
    out = np.empty(len(hashes) + len(first) - 1, np.int64)
    is_end = np.zeros(len(out), bool)
    is_end[stop - 1] = True
    out[is_end], out[~is_end] = END_HASH, hashes
    return out, np.concatenate([[0], stop])


def _back(hashes: np.ndarray, first: np.ndarray, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The ``depth`` symbols before each token, farthest first, and whether the text is long enough for them.

    A text's start counts as one symbol, as the farthest of a context.
    """
    place, out = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first)), []
    for back in range(depth, 0, -1):
        one = np.full(len(hashes), START_HASH)
        one[back:] = hashes[:-back] if back < len(hashes) else hashes[:0]
        one[place < back] = START_HASH
        out.append(one)
    return out, place >= depth - 1


def _key(symbols: list[np.ndarray]) -> np.ndarray:
    key = symbols[0]
    for one in symbols[1:]:
        key = _chain(key, one)
    return key


def _with_keys(depth: int, run: bool):
    """Adds the keys of contexts, and of the runs that they are part of."""

    def keys(batches):
        for batch in batches:
            symbols = [np.asarray(batch.column(k)) for k in range(depth + run)]
            added = {"context": _key(symbols[:depth])} | ({"key": _key(symbols)} if run else {})
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, added.values())], names=[*batch.schema.names, *added])

    return keys


def _collected(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a small table, sorted by the first."""
    table = df.select(*names).toArrow().sort_by(names[0])
    return [np.asarray(table.column(n).combine_chunks()) for n in names]


def _probability(tree: Tree, symbols: np.ndarray, base: np.ndarray, contexts: list[np.ndarray], depth: int) -> np.ndarray:
    """Probability of each symbol after its longest kept context of at most ``depth`` symbols, from the tree in memory.

    ``base`` has the symbols' shares; for symbol ``other``, a word that no context has seen, give 1 to get the factor.
    """
    p = base.copy()
    for (keys, escape, pairs, counts, size), context in zip(tree.levels[:depth], contexts):
        at = _look(keys, context)
        use = np.flatnonzero(at >= 0)
        which = at[use]
        pair = _look(pairs, which * tree.radix + symbols[use])
        seen = np.where(pair >= 0, counts[np.maximum(pair, 0)], 0) if len(counts) else np.zeros(len(use))
        p[use] = seen / (size[which] + BACKOFF) + escape[which] * p[use]
    return p


def _written(df: DataFrame, label: str) -> DataFrame:
    """A scratch table; the exchanges behind it go as soon as it stands, since nothing reads them again."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return materialize(df, label, "zstd")
    finally:
        conf.set(name, before)


def _small(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in as few bytes each as the largest needs; the first byte says how many."""
    kind = np.min_scalar_type(int(numbers.max()) if len(numbers) else 0)
    return bytes([kind.itemsize]) + numbers.astype(kind).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{raw[0]}", offset=1).astype(np.int64)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(40)).astype(np.int64) % buckets


def _slice_columns(kind) -> str:
    """``words`` are the hashes that occur, sorted; ``at`` has a place among them for each token.  ``totals`` and ``mine``
    are, by depth, the counts of the runs that were asked for, and which of them this slice gives the rows of;
    ``answers`` are, by depth, the back-off weights of the contexts asked for, or (in scoring) which of them are kept."""
    return (f"slice string, ids array<{kind.simpleString()}>, words binary, at binary, first binary, totals array<binary>, "
            "mine array<binary>, answers array<binary>")


def _sliced(id_type: pa.DataType):
    """One row per slice of texts."""

    def run(batches):
        for batch in batches:
            for low, high, flat, at in tb.slices(batch.column(1), SLICE):
                tokens, first = _tokens(flat, at)
                words, place = np.unique(tokens, return_inverse=True)
                ids = batch.column(0).slice(low, high - low).cast(id_type)
                blank = pa.array([[]], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), ids),
                     pa.array([words.tobytes()], pa.binary()), pa.array([_small(place)], pa.binary()),
                     pa.array([_small(first)], pa.binary()), blank, blank, blank],
                    names=["slice", "ids", "words", "at", "first", "totals", "mine", "answers"])

    return run


class _Slice:
    """A slice's tokens, and what is known about the runs that end at them."""

    def __init__(self, row: dict):
        self.words, self.first = np.frombuffer(row["words"], np.int64), _wide(row["first"])
        self.at = _wide(row["at"])
        self.tokens = self.words[self.at]
        self.totals = [_wide(x) for x in row["totals"]]
        self.mine = [_flags(x, len(t)) for x, t in zip(row["mine"], self.totals)]
        self.answers = row["answers"]
        self._runs, self._asked = {}, {}

    def run(self, depth: int):
        """By token: whether the text is long enough, the key of the run, that of its context."""
        if depth not in self._runs:
            before, use = _back(self.tokens, self.first, depth)
            context = _key(before)
            self._runs[depth] = use, _chain(context, self.tokens), context
        return self._runs[depth]

    def asked(self, depth: int) -> tuple[np.ndarray, ...]:
        """The runs that can stand ``LEAST`` times: their tokens, sorted keys, a token of each key, each key's count here,
        and the place of each token's key."""
        if depth not in self._asked and depth == 0:
            at = np.empty(len(self.words), np.int64)
            at[self.at] = np.arange(len(self.at))
            self._asked[0] = np.arange(len(self.at)), self.words, at, np.bincount(self.at, minlength=len(self.words)), self.at
        elif depth not in self._asked:
            use, key = self.run(depth)[:2]
            if depth > 1:
                often = np.zeros(len(key), bool)
                tokens, _, _, _, place = self.asked(depth - 1)
                often[tokens] = (self.totals[depth - 1] >= LEAST)[place]
                use = use & often
                use[1:] &= often[:-1]
            tokens = np.flatnonzero(use)
            keys, at, place, counts = _distinct(key[tokens])
            self._asked[depth] = tokens, keys, tokens[at], counts, place
        return self._asked[depth]

    def count(self, depth: int, keys: np.ndarray) -> np.ndarray:
        """Counts of runs in all slices; 0 for those not asked for."""
        at = _look(self.asked(depth)[1], keys)
        return np.where(at >= 0, self.totals[depth][np.maximum(at, 0)], 0) if len(self.totals[depth]) else np.zeros(len(at), np.int64)

    def contexts(self, depth: int) -> np.ndarray:
        """Contexts that can be kept, sorted."""
        if depth == 1:
            return np.unique(np.append(self.words, START_HASH))
        return self.asked(depth - 1)[1][self.totals[depth - 1] >= LEAST]

    def size(self, depth: int, context: np.ndarray) -> np.ndarray:
        """How often contexts stand.  A text has one start and one end; the end has nothing behind it."""
        if depth == 1:
            return self.count(0, np.where(context == START_HASH, END_HASH, context))
        return self.count(depth - 1, context)


def _slices_of(batches) -> Iterator[tuple[dict, _Slice]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
            ids = row.pop("ids")
            yield (plain := {n: v.as_py() for n, v in row.items()} | {"ids": ids}), _Slice(plain)


def _dealt(keys: np.ndarray, buckets: int) -> dict[int, np.ndarray]:
    """By bucket, the places of its keys."""
    bucket = _bucket(keys, buckets).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    return {int(bucket[places[0]]): places for places in np.split(order, edges) if len(places)}


def _questions(buckets: int, want):
    """What ``want`` names of a slice, sorted run keys with counts and sorted context keys, in a row per bucket."""

    def run(batches):
        for row, part in _slices_of(batches):
            keys, counts, contexts = want(part)[:3]
            of_key, of_context, none = _dealt(keys, buckets), _dealt(contexts, buckets), np.zeros(0, np.int64)
            found = sorted(of_key.keys() | of_context.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int64()), pa.array([row["slice"]] * len(found), pa.string()),
                 pa.array([keys[of_key.get(b, none)].tobytes() for b in found], pa.binary()),
                 pa.array([_small(counts[of_key.get(b, none)]) for b in found], pa.binary()),
                 pa.array([contexts[of_context.get(b, none)].tobytes() for b in found], pa.binary())],
                names=["bucket", "slice", "keys", "counts", "contexts"])

    return run


def _by_kind(known: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sorted keys of each kind, and their values; a bucket sorts them once, however many slices ask."""
    kinds, keys, values = (np.asarray(known.column(c).combine_chunks()) for c in ("kind", "key", "value"))
    out = {}
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        at = at[np.argsort(keys[at])]
        out[int(kind)] = keys[at], values[at]
    return out


def _values(wanted: np.ndarray, known: dict[int, tuple[np.ndarray, np.ndarray]], kind: int) -> np.ndarray:
    """The value of each key of a kind; 0 where there is none."""
    keys, values = known.get(kind, (np.zeros(0, np.int64), np.zeros(0)))
    at = _look(keys, wanted)
    return np.where(at >= 0, values[np.maximum(at, 0)], 0.0) if len(keys) else np.zeros(len(wanted))


def _totals(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Answers in training: counts of the runs in all slices, which of them the slice gives the rows of, back-off weights."""
    asked, known = asked.sort_by("slice"), _by_kind(known)  # the first slice by name gives the rows, also when the task runs again
    keys = [np.frombuffer(x, np.int64) for x in asked.column("keys").to_pylist()]
    found, at, where = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_index=True, return_inverse=True)
    counts = np.concatenate([*map(_wide, asked.column("counts").to_pylist()), np.zeros(0, np.int64)])
    totals = np.bincount(where, counts, len(found)).astype(np.int64)[where]
    mine = np.zeros(len(where), bool)
    mine[at] = True
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    weights = [_values(np.frombuffer(x, np.int64), known, 1).tobytes() for x in asked.column("contexts").to_pylist()]
    return pa.table({
        "slice": asked.column("slice"), "bucket": asked.column("bucket"),
        "values": pa.array(map(_small, np.split(totals, cuts)), pa.binary()),
        "mine": pa.array(map(_bits, np.split(mine, cuts)), pa.binary()), "weights": pa.array(weights, pa.binary())})


def _looked_up(asked: pa.Table, known: pa.Table, **columns) -> pa.Table:
    """Answers from the tree: by column, which keys are looked up, as which kind, and how that is written."""
    out, known = {"slice": asked.column("slice"), "bucket": asked.column("bucket")}, _by_kind(known)
    for name, (column, kind, write) in columns.items():
        out[name] = pa.array([write(_values(np.frombuffer(x, np.int64), known, kind))
                              for x in asked.column(column).to_pylist()], pa.binary())
    return pa.table(out)


def _present(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Answers to the first question of scoring: which keys are kept contexts, and which are stored runs."""
    flags = lambda values: _bits(values > 0)
    return _looked_up(asked, known, values=("contexts", 0, flags), mine=("keys", 0, flags), weights=("contexts", 1, flags))


def _shares(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Answers to the second: counts of words and runs, sizes and back-off weights of contexts."""
    whole = lambda values: _small(values.astype(np.int64))
    return _looked_up(asked, known, values=("keys", 0, whole), mine=("contexts", 2, whole), weights=("contexts", 1, np.ndarray.tobytes))


def _answered(parts: DataFrame, known: DataFrame, buckets: int, want, answer) -> tuple[DataFrame, DataFrame]:
    """Slices with what the buckets answer, ``replies``, and the table of the answers that they are read from.

    The answers are written first, so that the exchange of keys is gone before the slices are exchanged.
    """
    asked = parts.mapInArrow(_questions(buckets, want), "bucket long, slice string, keys binary, counts binary, contexts binary")
    known = known.withColumn("bucket", F.expr(f"shiftrightunsigned(key, 40) % {buckets}"))
    replies = _written(asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(
        answer, "slice string, bucket long, values binary, mine binary, weights binary"), "replies")
    gathered = replies.groupBy("slice").agg(F.collect_list(F.struct("bucket", "values", "mine", "weights")).alias("replies"))
    return parts.join(gathered, "slice", "left"), replies


def _buckets(parts: DataFrame) -> int:
    """Buckets of keys: one for so many bytes of slices, so that one fits a task's memory also where partitions are few."""
    return max(buckets_for(parts), estimated_bytes(parts) // SLICES_BYTES)


def _by_key(replies, name: str, keys: np.ndarray, buckets: int, read, kind) -> np.ndarray:
    """The answers of all buckets, in the order of the keys."""
    dealt, out = _dealt(keys, buckets), np.zeros(len(keys), kind)
    for reply in replies or []:
        own = dealt.get(reply["bucket"])
        if own is not None:
            out[own] = read(reply[name], len(own))
    return out


def _numbers(raw: bytes, _: int) -> np.ndarray:
    return np.frombuffer(raw)


def _counts(raw: bytes, _: int) -> np.ndarray:
    return _wide(raw)


def _depths(depth: int) -> list[int]:
    """Runs of which depths are asked for together: words with the first, since they are few."""
    return [0, 1] if depth == 1 else [depth]


def _to_count(depth: int):
    def want(part: _Slice):
        asked = [part.asked(d) for d in _depths(depth)]
        keys, at = np.unique(np.concatenate([a[1] for a in asked]), return_index=True)
        contexts = part.contexts(depth - 1) if depth > 1 else np.zeros(0, np.int64)
        return keys, np.concatenate([a[3] for a in asked])[at], contexts

    return want


def _counted(depth: int, buckets: int, batches) -> Iterator[tuple[dict, _Slice]]:
    """Slices with the counts that came back."""
    for row, part in _slices_of(batches):
        replies = row.pop("replies")
        keys, _, contexts = _to_count(depth)(part)
        totals = _by_key(replies, "values", keys, buckets, _counts, np.int64)
        mine = _by_key(replies, "mine", keys, buckets, _flags, bool)
        for d in _depths(depth):
            at = np.searchsorted(keys, part.asked(d)[1])
            part.totals.append(totals[at])
            part.mine.append(mine[at])
            row["totals"].append(_small(totals[at]))
            row["mine"].append(_bits(mine[at]))
        if depth > 1:
            weights = _by_key(replies, "weights", contexts, buckets, _numbers, np.float64)
            row["answers"].append(weights.tobytes())
        yield row, part


def _counted_slices(depth: int, buckets: int):
    return lambda batches: (_row(row) for row, _ in _counted(depth, buckets, batches))


def _row(row: dict) -> pa.RecordBatch:
    lists = [pa.array([row[n]], pa.list_(pa.binary())) for n in ("totals", "mine", "answers")]
    ids = row["ids"].values
    return pa.RecordBatch.from_arrays(
        [pa.array([row["slice"]]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
         *(pa.array([row[n]], pa.binary()) for n in ("words", "at", "first")), *lists],
        names=["slice", "ids", "words", "at", "first", "totals", "mine", "answers"])


def _word_rows(batches):
    for _, part in _slices_of(batches):
        mine = part.mine[0]
        yield pa.RecordBatch.from_arrays([pa.array(part.words[mine]), pa.array(part.totals[0][mine])], names=["word", "n"])


def _run_rows(depth: int, names: list[str], total: int, distinct: int, least_share: float, slices=_slices_of):
    """Runs that stand ``LEAST`` times, each from one slice: symbols, count, size of the context, and what the suffix gives."""

    def run(batches):
        for _, part in slices(batches):
            tokens, n = part.asked(depth)[2], part.totals[depth]
            words = part.totals[0][part.at[tokens]]
            take = part.mine[depth] & (n >= LEAST) & (words >= least_share * total)
            tokens, n, words = tokens[take], n[take], words[take]
            below = (words + 1.0) / (total + distinct + 1.0)
            for d in range(1, depth):
                _, key, context = (x[tokens] for x in part.run(d))
                seen = part.count(d, key) / (part.size(d, context) + BACKOFF)
                kept, escape = part.contexts(d), np.frombuffer(part.answers[d - 1])
                at = _look(kept, context)
                escape = np.where(at >= 0, escape[np.maximum(at, 0)], 0.0) if len(kept) else np.zeros(len(at))
                below = np.where(escape > 0, seen + escape * below, below)
            symbols = [x[tokens] for x in (*_back(part.tokens, part.first, depth)[0], part.tokens)]
            size = part.size(depth, part.run(depth)[2][tokens])
            yield pa.RecordBatch.from_arrays([*map(pa.array, (*symbols, n, size, below))], names=[*names, "n", "size", "below"])

    return run


def _grow(parts: DataFrame, tree: Tree, depth: int, slices=_slices_of) -> None:
    """Keep the contexts of ``depth`` symbols that diverge, with what follows them."""
    back = [f"b{k}" for k in range(depth, 0, -1)]
    names = [*back, "word"]
    long = lambda columns: ", ".join(f"{n} long" for n in columns)
    rows = _written(parts.mapInArrow(
        _run_rows(depth, names, tree.total, tree.distinct, SYMBOL_SHARE, slices), f"{long(names)}, n long, size long, below double"), "runs")
    # One exchange by context: whatever is known of a context is gathered where its rows are.
    own, whole = W.partitionBy(*back), F.col("size") + BACKOFF
    # Divergence from the suffix: gain of log-likelihood over the training tokens behind the context.  Summed as
    # decimals, so that the order of rows does not matter.
    gain = F.col("n") * F.log((F.col("n") / whole + F.col("escape") * F.col("below")) / F.col("below"))
    price = 0.5 * math.log(max(2, tree.total))
    following = (
        rows.withColumn("stored", F.sum("n").over(own)).withColumn("pairs", F.count("*").over(own))
        .withColumn("escape", (F.col("size") - F.col("stored") + BACKOFF) / whole)
        .withColumn("gain", F.sum(gain.cast("decimal(28,9)")).over(own).cast("double"))
        .where(F.col("gain") + (F.col("size") - F.col("stored")) * F.log("escape") > F.col("pairs") * price)
        .select(*names, "n", "size", "escape")
    )
    following = _written(following.mapInArrow(
        _with_keys(depth, True), f"{long(names)}, n long, size long, escape double, context long, key long"), "next")
    kept = _written(following.groupBy(*back).agg(*(F.first(c).alias(c) for c in ("size", "escape", "context"))), "contexts")
    following = following.select("context", "word", "key", "n")
    discard(rows)
    tree.tables.append((kept, following))


def train(docs: DataFrame, depth: int = DEPTH) -> tuple[Tree, DataFrame]:
    """The tree of ``docs`` and the table of all word counts (``word``, ``n``).

    NULL texts count as empty: their end is a token.  An empty table gives a tree without contexts.
    """
    kind = T.LongType()
    texts = docs.select(F.lit(0).cast("long").alias("doc_id"), "text")
    parts = _written(texts.mapInArrow(_sliced(pa.int64()), _slice_columns(kind)), "slices")
    buckets = _buckets(parts)
    tree, words = Tree(None, 0, 0, []), None
    for d in range(1, depth + 1):
        # Weights of contexts that are one shorter; before the first depth there are none.
        known = tree.tables[-1][0].select(
            F.col("context").alias("key"), F.lit(1).alias("kind"), F.col("escape").alias("value")
        ) if tree.tables else docs.sparkSession.createDataFrame([], "key long, kind int, value double")
        answered, replies = _answered(parts, known, buckets, _to_count(d), _totals)
        if 1 < d == depth:  # nothing reads these slices but the rows of their runs
            _grow(answered, tree, d, partial(_counted, d, buckets))
            discard(replies)
            break
        counted = _written(answered.mapInArrow(_counted_slices(d, buckets), _slice_columns(kind)), "slices")
        discard(replies)
        discard(parts)
        parts = counted
        if d == 1:
            words = _written(parts.mapInArrow(_word_rows, "word long, n long"), "words")
            total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
            tree.words, tree.total, tree.distinct = words, int(total), int(distinct)
        _grow(parts, tree, d)
    discard(parts)
    return tree, words


def _all_contexts(part: _Slice, depth: int):
    """Every context of up to ``depth`` symbols in a slice, sorted, and by depth from 1 the place of each token's context
    among them, then that of each token's run (for runs shorter than ``depth``); -1 where the text is too short."""
    runs = [part.run(d)[:2] for d in range(1, depth)]
    tokens = [np.flatnonzero(use) for use, _ in runs]
    every = [part.words, np.array([START_HASH]), *(run[at] for at, (_, run) in zip(tokens, runs))]
    keys, place = np.unique(np.concatenate(every), return_inverse=True)
    words, start, *found = np.split(place, np.cumsum([len(x) for x in every])[:-1])
    of_run = []
    for at, one in zip(tokens, found):
        of_run.append(np.full(len(part.tokens), -1))
        of_run[-1][at] = one
    of_context, row_start = [], part.first[:-1]
    for d, before in enumerate([words[part.at], *of_run]):
        of_context.append(np.concatenate([[-1], before[:-1]]))
        of_context[-1][row_start] = start[0] if d == 0 else -1
    return keys, of_context, of_run


def _to_find(depth: int):
    def want(part: _Slice):
        none = np.zeros(0, np.int64)
        return none, none, _all_contexts(part, depth)[0]

    return want


def _found(depth: int, buckets: int):
    """Slices with two flags for each context: whether the tree has it, and whether it has it as a run."""

    def run(batches):
        for row, part in _slices_of(batches):
            contexts = _all_contexts(part, depth)[0]
            row["answers"] += [
                _bits(_by_key(row["replies"], name, contexts, buckets, _flags, bool)) for name in ("weights", "values")]
            yield _row(row)

    return run


def _to_score(depth: int):
    """Words, kept contexts and the runs behind them that can be stored; then what finds them again.

    A run shorter than ``depth`` is known to be stored or not.  One whose suffix is not stored behind a kept context
    stands too seldom itself.
    """

    def want(part: _Slice):
        contexts, of_context, of_run = _all_contexts(part, depth)
        kept, stored = (_flags(raw, len(contexts)) for raw in part.answers)
        behind = [(at >= 0) & kept[at] for at in of_context]
        every, tokens = [part.words], []
        for d in range(depth):
            use = behind[d].copy()
            if d < depth - 1:
                use &= stored[of_run[d]]
            if d > 0:
                use &= stored[of_run[d - 1]] | ~behind[d - 1]
            tokens.append(np.flatnonzero(use))
            every.append(part.run(d + 1)[1][tokens[-1]])
        keys, place = np.unique(np.concatenate(every), return_inverse=True)
        words, *runs = np.split(place, np.cumsum([len(x) for x in every])[:-1])
        among = np.cumsum(kept) - 1  # place of a context among the kept ones
        return keys, np.zeros(len(keys), np.int64), contexts[kept], words, [
            (use, among[at], asked, run) for use, at, asked, run in zip(behind, of_context, tokens, runs)]

    return want


def _scored(total: int, distinct: int, buckets: int, depth: int, id_type: pa.DataType):
    def run(batches):
        for row, part in _slices_of(batches):
            keys, _, kept, words, levels = _to_score(depth)(part)
            replies = row["replies"]
            seen = _by_key(replies, "values", keys, buckets, _counts, np.int64)
            size = _by_key(replies, "mine", kept, buckets, _counts, np.int64)
            escape = _by_key(replies, "weights", kept, buckets, _numbers, np.float64)
            counts = seen[words][part.at]
            base = (counts + 1.0) / (total + distinct + 1.0)
            p = base.copy()
            for use, context, asked, run in levels:
                stored = np.zeros(len(p))
                stored[asked] = seen[run] / (size[context[asked]] + BACKOFF)
                p[use] = stored[use] + escape[context[use]] * p[use]
            # Sums within each row only, so that a score does not depend on the rows around it.
            add = lambda x: pa.array(np.add.reduceat(x, part.first[:-1]))
            n_tokens = np.diff(part.first)
            yield pa.RecordBatch.from_arrays([
                row["ids"].values.cast(id_type), pa.array(n_tokens), add((counts > 0).astype(np.int64)),
                pa.array(np.full(len(n_tokens), total)), add(np.log10(base)), add(np.log10(p)),
            ], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, tree: Tree, words: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read.  ``words`` is the tree's own table.  A NULL or
    empty text is its end alone.  Every row has its own result, also rows that repeat an id or have none; an empty
    table gives an empty one.  Texts of any length are scored whole.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    depth = len(tree.tables)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    parts = _written(docs.mapInArrow(_sliced(id_type), _slice_columns(kind)), "slices")
    buckets, known = _buckets(parts), tree.known()
    answered, replies = _answered(parts, tree.known(presence=True), buckets, _to_find(depth), _present)
    found = _written(answered.mapInArrow(_found(depth, buckets), _slice_columns(kind)), "slices")
    discard(replies)
    discard(parts)
    return _answered(found, known, buckets, _to_score(depth), _shares)[0].mapInArrow(
        _scored(tree.total, tree.distinct, buckets, depth, id_type),
        f"doc_id {kind.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double")

"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut where a rolling hash of their last bytes has a given form, so equal passages
are cut alike wherever they stand.  A chunk that stands in several slices of the corpus is
encoded once, by the slice with the smallest number, and its ids go to the others; a chunk
that only one slice has is encoded there, once.

A chunk is encoded as if it were a whole text, so its ends are wrong in general.  Joins are
repaired: from the last match of the pattern that is safe from what follows the chunk, the
text is matched and encoded anew across the join, until a match begins where one of the next
chunk's matches begins.  From there on the next chunk's ids are those of the text, since a
match depends on nothing before it.

Slices of texts are exchanged once, compressed.  What goes to a slice are the ids of the
chunks that it shares; they are decoded and compared with its text before they are used, so
hashes only find chunks and never decide.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache
from itertools import chain, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import textbytes as tb
from holdfast.session import materialize

#: A cut after a byte at which the hash of the last ``REACH`` bytes has ``CUT_BITS`` leading zeros, ``LEAST`` bytes
#: after the cut before.
CUT_BITS, LEAST, REACH = 10, 64, 16
#: Bytes behind a match that may decide where it ends: "'re" looks two characters ahead, ``\s+(?!\S)`` one.
AHEAD = 8
#: Pieces whose ids a worker remembers; then the memory starts anew.
CACHE = 400_000
#: Bytes beyond a join that are matched at first.
WINDOW = 128
#: Pieces up to this many bytes are merged together, as matrices of so many cells at most; longer ones with a heap.
SHORT, CELLS = 32, 1 << 18
#: Ids that are written out or decoded at a time.
PART = 1 << 20

_GEAR = np.random.Generator(np.random.PCG64(20250114)).integers(0, 2**32, 256, dtype=np.uint32)


def _byte_characters() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of the pieces that a worker has met."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        self[piece] = ids = self.model.merged(piece)
        return ids


class Model:
    """Merges, token bytes and special tokens of a byte-level BPE in a tokenizer file."""

    def __init__(self, source: str, pattern: str):
        spec = json.loads(source)
        kind, before, added = spec["model"], spec["pre_tokenizer"], spec["added_tokens"]
        plain = not any(kind.get(k) for k in (
            "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if kind["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or spec["normalizer"] or not plain:
            raise ValueError("not a plain byte-level BPE")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("special tokens that change the text around them are not known here")
        byte = _byte_characters()
        vocab = kind["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in added}
        tokens = {i: bytes(byte[c] for c in token) for token, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.size = max(tokens) + 1
        self.lengths = np.array([len(tokens.get(i, b"")) for i in range(self.size)], np.int64)
        self.texts = pa.array([tokens.get(i, b"") for i in range(self.size)], pa.binary())
        self.numbers = pa.array([b"%d," % i for i in range(self.size)], pa.binary())
        self.byte = np.array([vocab[c] for c, _ in sorted(byte.items(), key=lambda x: x[1])], np.int64)
        merges = [merge if isinstance(merge, list) else merge.split(" ") for merge in kind["merges"]]
        self.joined = np.array([vocab[left + right] for left, right in merges], np.int64)  # by rank
        self.ranks = {(vocab[left], vocab[right]): rank for rank, (left, right) in enumerate(merges)}
        keys = np.array([left << 32 | right for left, right in self.ranks], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(self.ranks.values()), np.int64)[order]
        # Ranks of pairs of bytes, with which every piece begins.
        self.byte_ranks = self._ranks(np.repeat(self.byte, 256), np.tile(self.byte, 256)).reshape(256, 256)
        self.pattern = regex.compile(pattern)
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.known = _Pieces(self)

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that are not known, those of one length together."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(pieces)
        raws = [p.encode() for p in new]
        size = np.array([len(r) for r in raws], np.int64)
        for n in np.unique(size[size <= SHORT]).tolist():
            members = np.flatnonzero(size == n)
            for i in range(0, len(members), CELLS // n):
                rows = members[i : i + CELLS // n].tolist()
                flat = np.frombuffer(b"".join(raws[k] for k in rows), np.uint8)
                for k, ids in zip(rows, self._rows(flat.reshape(-1, n))):
                    self.known[new[k]] = ids

    def _rows(self, flat: np.ndarray) -> list[bytes]:
        """Ids of pieces of one length: each round merges the leftmost pair of the lowest rank in every row.

        A merge changes the ranks of two pairs only, which are looked up anew.
        """
        ids, none = self.byte[flat], len(self.joined)
        out, live = [b""] * len(ids), np.arange(len(ids))
        ranks = np.full(ids.shape, none)  # of each pair of neighbours, and a last column without one
        ranks[:, :-1] = self.byte_ranks[flat[:, :-1], flat[:, 1:]]
        while len(live):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(live)), at]
            done = best == none
            if done.any():
                for row, code in zip(live[done].tolist(), ids[done].astype("<u4")):
                    out[row] = code.tobytes()
                live, ids, ranks, at, best = (x[~done] for x in (live, ids, ranks, at, best))
            row, left = np.arange(len(live)), np.arange(ids.shape[1] - 1) <= at[:, None]
            ids, ranks = (np.where(left, x[:, :-1], x[:, 1:]) for x in (ids, ranks))
            ids[row, at] = self.joined[best]
            inner = at > 0
            ranks[row[inner], at[inner] - 1] = self._ranks(ids[row[inner], at[inner] - 1], ids[row[inner], at[inner]])
            inner = at < ids.shape[1] - 1
            ranks[row, at] = none
            ranks[row[inner], at[inner]] = self._ranks(ids[row[inner], at[inner]], ids[row[inner], at[inner] + 1])
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], len(self.joined))

    def merged(self, piece: str) -> bytes:
        """Ids of one match of the pattern, as 32-bit integers."""
        return np.array(self._many(self.byte[np.frombuffer(piece.encode(), np.uint8)].tolist()), "<u4").tobytes()

    def _many(self, ids: list[int]) -> list[int]:
        """The same merges, one after another, for a piece of any length."""
        ranks, n = self.ranks, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[pair], i, pair) for i, pair in enumerate(zip(ids, ids[1:])) if pair in ranks]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (ids[i], ids[j]) in ranks:
                heapq.heappush(heap, (ranks[ids[i], ids[j]], i, (ids[i], ids[j])))

        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], after[i] = int(self.joined[rank]), -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t in ids if t >= 0]

    def chunks(self, raws: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each chunk as if it were a whole text, and how many ids its matches have."""
        return [(code.ids, code.counts) for code in self.coded(raws)]

    def coded(self, raws: list[bytes]) -> list[_Coded]:
        """Each chunk encoded as if it were a whole text."""
        out, find, known = [], self.pattern.findall, self.known
        for group in _groups(raws, PART):
            split, codes = [], []
            for raw in group:
                split.append(find(raw.decode()))
                codes += map(known.get, split[-1])
            if None in codes:
                pieces = list(chain.from_iterable(split))
                self.learn({piece for piece, code in zip(pieces, codes) if code is None})
                codes = [known[piece] if code is None else code for piece, code in zip(pieces, codes)]
            ids = np.frombuffer(b"".join(codes), "<u4")
            counts = np.fromiter(map(len, codes), np.int64, len(codes)) >> 2
            firsts, begins = self.places(ids, counts)
            edges = np.cumsum([0, *map(len, split)])
            cut = np.append(firsts, len(ids))[edges].tolist()
            for k, (low, high) in enumerate(pairwise(edges.tolist())):
                own = slice(low, high)
                out.append(_Coded(
                    ids[cut[k] : cut[k + 1]], counts[own], firsts[own] - cut[k], begins[own] - begins[low] if high > low else begins[own]))
        return out

    def places(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first id of each match, and the byte at which it begins."""
        firsts, ends = np.cumsum(counts) - counts, np.cumsum(self.lengths[ids])
        return firsts, np.append(0, ends)[firsts]

    def decode(self, ids: np.ndarray) -> memoryview:
        """Bytes of the tokens, one after another."""
        return _joined(self.texts, ids)

    def written(self, ids: np.ndarray) -> memoryview:
        """The decimal ids, joined by commas."""
        return _joined(self.numbers, ids)[:-1]


def _joined(values: pa.Array, at: np.ndarray) -> memoryview:
    """The chosen values, one after another."""
    if not len(at):
        return memoryview(b"")
    _, offsets, data = values.take(pa.array(at)).buffers()
    return memoryview(data or b"")[: np.frombuffer(offsets, np.int32, len(at) + 1)[-1]]


def _groups(raws: list[bytes], limit: int):
    """Runs of chunks of about ``limit`` bytes."""
    group, size = [], 0
    for raw in raws:
        if group and size + len(raw) > limit:
            yield group
            group, size = [], 0
        group.append(raw)
        size += len(raw)
    if group:
        yield group


@lru_cache(maxsize=2)
def model(source: str, pattern: str) -> Model:
    return Model(source, pattern)


def cuts(flat: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where chunks begin: at the edges of the texts, and after bytes that the rolling hash picks."""
    total = _GEAR[flat]
    reach = 1
    while reach < REACH:  # sums over 2, 4, 8, ... bytes
        wider = total.copy()
        wider[reach:] += total[:-reach] << np.uint32(reach)
        total, reach = wider, 2 * reach
    found = np.flatnonzero(total >> np.uint32(32 - CUT_BITS) == 0) + 1
    text = np.searchsorted(edges, found, "right") - 1
    begin, end = edges[text], edges[np.minimum(text + 1, len(edges) - 1)]
    # The hash must lie inside the text, and a cut must not split a character.
    found, begin = found[(found - begin >= REACH) & (found < end)], begin[(found - begin >= REACH) & (found < end)]
    for _ in range(3):
        inside = (flat[np.minimum(found, len(flat) - 1)] & 0xC0) == 0x80
        found = found + inside
    kept, last = [], -LEAST
    for place, start in zip(found.tolist(), begin.tolist()):
        if place - max(last, start) >= LEAST:
            kept.append(place)
            last = place
    return np.unique(np.concatenate([edges[:-1], np.array(kept, np.int64)]))


def _segments(raw: bytes, at: np.ndarray, special: dict[bytes, int]) -> tuple[np.ndarray, dict[int, bytes]]:
    """Edges of the texts, and of the special tokens inside them; the tokens by their place."""
    found, split = {}, None
    if any(token in raw for token in special):
        split = regex.compile(b"|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)))
        for low, high in zip(at[:-1].tolist(), at[1:].tolist()):
            for match in split.finditer(raw, low, high):
                found[match.start()] = match.group()
    marks = [x for place, token in found.items() for x in (place, place + len(token))]
    return np.unique(np.concatenate([at, np.array(marks, np.int64)])), found


def digest(chunk: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(chunk, digest_size=8).digest(), "little", signed=True)


class Slice:
    """Texts of a slice, cut into chunks."""

    def __init__(self, raw: bytes, at: np.ndarray, special: dict[bytes, int]):
        self.raw, self.at = raw, at
        edges, self.found = _segments(raw, at, special)
        begins = cuts(np.frombuffer(raw, np.uint8), edges) if raw else np.zeros(0, np.int64)
        begins = begins[begins < len(raw)]
        self.bounds = np.append(begins, len(raw))
        self.edges = set(edges.tolist())

    def chunks(self):
        """Place and bytes of every chunk that is no special token."""
        b = self.bounds.tolist()
        for low, high in zip(b, b[1:]):
            if low not in self.found:
                yield low, self.raw[low:high]


class _Coded(NamedTuple):
    """Ids of a chunk, how many each of its matches has, their first ids, and where they begin (in bytes)."""

    ids: np.ndarray
    counts: np.ndarray
    firsts: np.ndarray
    begins: np.ndarray


def stitch(m: Model, raw: bytes, bounds: list[int], codes: list[_Coded]) -> list[np.ndarray]:
    """Ids of the text ``raw`` from those of its chunks, which begin at ``bounds`` (its end is the last of them)."""
    out, at, i, end = [], 0, 0, len(raw)

    def agrees() -> int:
        """The match of chunk ``i`` that begins at ``at``, or -1."""
        k = int(np.searchsorted(codes[i].begins, at - bounds[i]))
        return k if k < len(codes[i].begins) and codes[i].begins[k] == at - bounds[i] else -1

    while at < end:
        k, code = agrees(), codes[i]
        spent = i if k >= 0 else -1  # a chunk whose safe matches have been taken
        if k >= 0 and bounds[i + 1] == end:
            out.append(code.ids[code.firsts[k] :])
            break
        if k >= 0:
            # Matches that end far enough from the chunk's end stay whatever follows.
            safe = int(np.searchsorted(code.begins, bounds[i + 1] - bounds[i] - AHEAD, "right")) - 1
            if safe > k:
                out.append(code.ids[code.firsts[k] : code.firsts[safe]])
                at = bounds[i] + int(code.begins[safe])
        # Match anew across the join until a match begins where one of a chunk's does.
        width, agreed = bounds[i + 1] - at + WINDOW, False
        while not agreed and at < end:
            begin, stop = at, min(end, at + width)
            while stop < end and raw[stop] & 0xC0 == 0x80:
                stop += 1
            for match in m.pattern.finditer(raw[at:stop].decode()):
                size = len(match.group().encode())
                if stop < end and at + size > stop - AHEAD:
                    break
                out.append(np.frombuffer(m.known[match.group()], "<u4"))
                at += size
                while at < end and bounds[i + 1] <= at:
                    i += 1
                agreed = at < end and i != spent and agrees() >= 0
                if agreed:
                    break
            width = 2 * width if at == begin else WINDOW
    return out


def encode_slice(m: Model, part: Slice, shared: dict[int, tuple[bytes, bytes]]) -> list[np.ndarray]:
    """Ids of each text of a slice.  ``shared`` has the ids and counts of chunks that came from elsewhere."""
    known: dict[bytes, _Coded] = {}
    places = list(part.chunks())
    for chunk in {chunk for _, chunk in places} if shared else ():
        if ready := shared.get(digest(chunk)):
            ids = np.frombuffer(ready[0], m.kind).astype("<u4")
            # Only ids that stand for exactly these bytes are used.
            if m.lengths[ids].sum() == len(chunk) and m.decode(ids) == chunk:
                counts = np.frombuffer(ready[1], "<u4").astype(np.int64)
                known[chunk] = _Coded(ids, counts, *m.places(ids, counts))
    new = list(dict.fromkeys(chunk for _, chunk in places if chunk not in known))
    known.update(zip(new, m.coded(new)))
    coded = {low: known[chunk] for low, chunk in places}
    bounds, out = part.bounds.tolist(), []
    edge = np.flatnonzero([b in part.edges for b in bounds])
    segments = {bounds[a]: bounds[a : b + 1] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())}
    for low, high in zip(part.at[:-1].tolist(), part.at[1:].tolist()):
        ids = []
        while low < high:
            own = segments[low]
            if low in part.found:
                ids.append(np.array([m.special[part.found[low]]], "<u4"))
            else:
                ids += stitch(m, part.raw[low : own[-1]], [b - low for b in own], [coded[b] for b in own[:-1]])
            low = own[-1]
        out.append(np.concatenate(ids) if ids else np.zeros(0, "<u4"))
    return out


def _pack(id_type: pa.DataType):
    """A row per slice of texts: a number from its content, the rows' ids, the texts' sizes, and the texts, compressed."""

    def run(batches):
        for batch in batches:
            for low, high, flat, at in tb.slices(batch.column(1)):
                ids, raw = batch.column(0).slice(low, high - low), flat.tobytes()
                seal = hashlib.blake2b(at.tobytes(), digest_size=8)
                seal.update(repr(ids.to_pylist()).encode())
                seal.update(raw)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([
                    pa.array([int.from_bytes(seal.digest(), "little", signed=True)], pa.int64()), one(ids.cast(id_type)),
                    one(pa.array(np.diff(at))), pa.array([pa.compress(raw, "zstd", asbytes=True) if raw else b""], pa.binary()),
                ], names=["slice", "ids", "sizes", "texts"])

    return run


def _opened(sizes: pa.Scalar, texts: pa.Scalar, special: dict[bytes, int]) -> Slice:
    at = np.concatenate([[0], np.cumsum(np.asarray(sizes.values))]).astype(np.int64)
    packed = texts.as_py()
    return Slice(pa.decompress(packed, int(at[-1]), "zstd", asbytes=True) if packed else b"", at, special)


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}


def _places(special: dict[bytes, int]):
    """The chunks of each slice."""

    def run(batches):
        for row in _rows(batches):
            found = np.unique(np.array([digest(c) for _, c in _opened(row["sizes"], row["texts"], special).chunks()], np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array(np.full(len(found), row["slice"].as_py(), np.int64))], names=["chunk", "slice"])

    return run


def _owned(source: str, pattern: str):
    """Ids of the chunks that a slice encodes for the others."""

    def run(batches):
        m = model(source, pattern)
        for row in _rows(batches):
            if not row["own"].is_valid:
                continue
            wanted = set(row["own"].as_py())
            chunks = {digest(c): c for _, c in _opened(row["sizes"], row["texts"], m.special).chunks()}
            keys = sorted(wanted & chunks.keys())
            codes = m.chunks([chunks[k] for k in keys])
            ids = [code.astype(m.kind).tobytes() for code, _ in codes]
            counts = [count.astype("<u4").tobytes() for _, count in codes]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())],
                names=["chunk", "chunk_ids", "counts"])

    return run


def _assembled(source: str, pattern: str, result):
    """Encode the slices' texts; ``result`` makes a batch of the rows' ids and the texts' tokens."""

    def run(batches):
        m = model(source, pattern)
        for row in _rows(batches):
            shared = {r["chunk"]: (r["chunk_ids"], r["counts"]) for r in row["replies"].as_py() or []}
            part = _opened(row["sizes"], row["texts"], m.special)
            yield result(m, row["ids"].values, encode_slice(m, part, shared))

    return run


def _coding(docs: DataFrame, source: str, pattern: str, result, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    special = Model(source, pattern).special
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    parts = docs.mapInArrow(
        _pack(to_arrow_type(kind)), f"slice long, ids array<{kind.simpleString()}>, sizes array<long>, texts binary")
    # Slices that are alike in texts and ids have one number, and count once.
    places = materialize(
        parts.select("slice", "sizes", "texts").mapInArrow(_places(special), "chunk long, slice long").distinct(), "chunks")
    shared = places.groupBy("chunk").agg(F.min("slice").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = materialize(shared, "shared_chunks")
    own = shared.groupBy(F.col("owner").alias("slice")).agg(F.collect_list("chunk").alias("own"))
    # Both joins of the slices read one exchange of them.
    codes = parts.join(own, "slice", "left").mapInArrow(
        _owned(source, pattern), "chunk long, chunk_ids binary, counts binary").dropDuplicates(["chunk"])
    # A slice gets each of its shared chunks once: no more than it holds itself.
    replies = places.join(shared.select("chunk"), "chunk").join(codes, "chunk").groupBy("slice").agg(
        F.collect_list(F.struct("chunk", "chunk_ids", "counts")).alias("replies"))
    return parts.join(replies, "slice", "left").mapInArrow(_assembled(source, pattern, result), schema)


def read_tokenizer(spark: SparkSession, path: str) -> str:
    """A tokenizer file.  The driver reads it; it goes to the tasks with the functions (2 MB)."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, source: str, pattern: str) -> DataFrame:
    """Per row of ``docs``: ``doc_id`` and ``ids``, the tokens of ``text`` as little-endian 32-bit integers.

    The same ids as the tokenizer's library gives without adding special tokens; those that stand in a text are
    found there.  A NULL or empty text has no tokens.  Each row stands for itself, also rows that repeat an id or
    have none.  Other columns are not read.  An empty table gives an empty one.  Texts of any length are encoded
    whole; a text is one row of one slice.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def result(m, rows, ids):
        return pa.RecordBatch.from_arrays([rows, pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "ids"])

    return _coding(docs, source, pattern, result, f"doc_id {kind}, ids binary")


def decode(tokens: DataFrame, source: str, pattern: str) -> DataFrame:
    """``tokens`` with ``decoded``: the text that ``ids`` stand for, special tokens written out; empty for NULL.

    Bytes that are no UTF-8, as of a cut token list, become replacement characters.  A column called ``decoded`` is
    replaced; an empty table gives an empty one.
    """
    tokens = tokens.drop("decoded")

    def run(batches):
        m = model(source, pattern)
        for batch in batches:
            texts = []
            for value in batch.column(batch.schema.get_field_index("ids")):
                ids = np.frombuffer(value.as_py() or b"", "<u4")
                texts.append(b"".join(m.decode(ids[i : i + PART]) for i in range(0, len(ids), PART)).decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(run, f"{schema}, decoded string")


def token_digests(docs: DataFrame, source: str, pattern: str) -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass, of which only counts and digests leave the task.

    Per row of ``docs``: ``doc_id``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas) and
    ``decoded_sha256`` (of the decoded text in UTF-8).  NULLs, empty texts, repeated rows and empty tables as in
    :func:`encode`.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def result(m, rows, ids):
        numbers, texts = [], []
        for x in ids:
            number, text = hashlib.sha256(), hashlib.sha256()
            for i in range(0, len(x), PART):
                number.update(b"," if i else b"")
                number.update(m.written(x[i : i + PART]))
                text.update(m.decode(x[i : i + PART]))
            numbers.append(number.hexdigest())
            texts.append(text.hexdigest())
        return pa.RecordBatch.from_arrays(
            [rows, pa.array([len(x) for x in ids], pa.int64()), pa.array(numbers, pa.string()), pa.array(texts, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _coding(docs, source, pattern, result, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Byte-level BPE encoding and decoding with matrices of token ids.

A text is cut into chunks at its single blanks and line ends; no match of the pattern
reaches across those, so equal chunks have equal ids wherever they stand, and a chunk is
encoded once per worker (up to ``CACHE`` chunks; then the memory starts anew).  The pieces of new
chunks are laid out as rows of padded matrices, one matrix per length class.  In every
round each row merges its leftmost pair of minimum rank; pairs are looked up in a hash
table of packed ids, and the row is compacted.  Rows without a merge leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from holdfast.llm import textbytes as tb

CACHE = 400_000
#: Pieces up to these lengths share a matrix; longer ones go by powers of two.
BUCKETS = (2, 3, 4, 6, 8, 12, 16, 24, 32)
CELLS = 1 << 20
#: Bytes beyond which a piece (one match of the pattern) does not get a matrix row, whose rounds take its length squared.
LONG = 4096
#: Characters that are encoded at a time; a longer text is cut where the pattern cannot reach across.
PART = 1 << 21
_NONE = np.iinfo(np.int32).max
_GAP = re.compile(r"\s\s|\s\Z|\0")


class Vocabulary:
    """Ranks, merges and token bytes of one rank file."""

    def __init__(self, lines: bytes, pattern: str):
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, lines.split(b"\n")))}
        self.pattern = regex.compile(pattern)
        # Texts are cut at blanks before they are matched, which only this pattern is known to allow.
        self.cuts = pattern == public_tokenizers.PATTERN
        self.size = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.ranks = ranks
        lengths = np.zeros(self.size + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        self.lengths = lengths
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        flat = bytearray(int(lengths.sum()))
        for token, rank in ranks.items():
            flat[self.offsets[rank] : self.offsets[rank] + len(token)] = token
        self.flat = np.frombuffer(bytes(flat), np.uint8)
        self._build_pairs()
        self.chunks: dict[str, bytes] = {}

    def _build_pairs(self) -> None:
        """Open-addressed table from (left id, right id) to the rank of their joined bytes."""
        keys, values = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.pair_of = dict(zip(keys, values))
        keys, values = np.array(keys, np.int64), np.array(values, np.int32)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] < 0
            self.keys[slot[todo[free]]] = keys[todo[free]]
            done = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[done]]] = values[todo[done]]
            todo = todo[~done]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a rank above all others."""
        keys = left << 32 | right
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], _NONE)
        todo = np.flatnonzero((out == _NONE) & (self.keys[slot] >= 0) & (right >= 0) & (left >= 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            here = self.keys[slot[todo]]
            same = here == keys[todo]
            out[todo[same]] = self.values[slot[todo[same]]]
            todo = todo[~same & (here >= 0)]
        out[(right < 0) | (left < 0)] = _NONE
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of each piece as little-endian 32-bit integers."""
        size = np.array([len(p) for p in pieces], np.int64)
        limits = np.array(BUCKETS)
        group = np.where(size <= BUCKETS[-1], limits[np.minimum(np.searchsorted(limits, size), len(limits) - 1)],
                         1 << np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64))
        begin, tokens, codes, total = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [], 0
        group[size > LONG] = 0
        for width in np.unique(group):
            members = np.flatnonzero(group == width)
            if width == 0:
                for row in members:
                    one = self._merge_long(pieces[row])
                    codes.append(one)
                    begin[row], tokens[row] = total, len(one)
                    total += len(one)
                continue
            step = max(1, CELLS // int(width))
            for i in range(0, len(members), step):
                rows = members[i : i + step]
                flat = np.frombuffer(b"".join(map(pieces.__getitem__, rows.tolist())), np.uint8)
                ids, count = self._merge(flat, size[rows], int(width))
                codes.append(ids[np.arange(int(width)) < count[:, None]].astype("<u4"))
                begin[rows], tokens[rows] = total + np.cumsum(count) - count, count
                total += int(count.sum())
        raw = np.concatenate(codes).tobytes() if codes else b""
        return [raw[a:b] for a, b in zip((begin * 4).tolist(), ((begin + tokens) * 4).tolist())]

    def _merge(self, flat: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Padded matrix of final ids (int32) and each row's length."""
        n = len(size)
        ids = np.full((n, width), -1, np.int64)
        ids[np.arange(width) < size[:, None]] = self.byte[flat]
        final, count = np.empty((n, width), np.int32), size.copy()
        ranks = np.full((n, width), _NONE, np.int32)
        if width > 1:
            ranks[:, :-1] = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        live = np.arange(n)
        while True:
            # The first minimum of a row is its leftmost pair of minimum rank.
            at = ranks.argmin(1)
            best = ranks[np.arange(len(live)), at]
            over = best == _NONE
            if over.any():
                done = live[over]
                final[done, : ids.shape[1]] = ids[over]
                live, ids, ranks, at, best = live[~over], ids[~over], ranks[~over], at[~over], best[~over]
            if not len(live):
                return final, count
            # Close the gap: columns behind the merged pair move one to the left.
            r, last = np.arange(len(live)), ids.shape[1] - 1
            behind = np.arange(last) > at[:, None]
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(behind, ranks[:, 1:], ranks[:, :-1])
            ids[r, at] = best
            ids[:, -1], ranks[:, -1] = -1, _NONE
            count[live] -= 1
            # Only the pairs on either side of the new token are new.
            ids, ranks = ids[:, :last], ranks[:, :last]
            if last == 1:
                ranks[:] = _NONE
                continue
            after = np.minimum(at + 1, last - 1)
            right = np.where(at + 1 < last, ids[r, after], -1)
            ranks[r, np.minimum(at, last - 1)] = self.pair_ranks(best.astype(np.int64), right)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.pair_ranks(ids[left, at[left] - 1], best[left].astype(np.int64))

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one very long piece by the same rule, with a heap of (rank, place) instead of a matrix row."""
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        heap = [(int(r), i) for i, r in enumerate(ranks.tolist()) if r != _NONE]
        heapq.heapify(heap)
        ids, n = ids.tolist(), len(ids)
        after, before, rank = list(range(1, n + 1)), list(range(-1, n - 1)), [*ranks.tolist(), _NONE]
        pairs = self.pair_of

        def renew(i: int) -> None:
            j = after[i]
            rank[i] = pairs.get(ids[i] << 32 | ids[j], _NONE) if j < n else _NONE
            if rank[i] != _NONE:
                heapq.heappush(heap, (rank[i], i))

        while heap:
            best, i = heapq.heappop(heap)
            if ids[i] < 0 or rank[i] != best:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = best, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            renew(i)
            if before[i] >= 0:
                renew(before[i])
        return np.array([t for t in ids if t >= 0], "<u4")

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that were not seen before."""
        # Letters after at most one blank are one match of "an optional blank and letters".
        find = self.pattern.findall
        one = (lambda c: (c[1:] if c[0] == " " else c).isalpha()) if self.cuts else (lambda c: True)
        split = [(c,) if one(c) else find(c) for c in chunks]
        pieces = list(dict.fromkeys(p for found in split for p in found))
        code = dict(zip(pieces, self.encode_pieces([p.encode() for p in pieces])))
        return {chunk: code[chunk] if len(found) == 1 else b"".join([code[p] for p in found])
                for chunk, found in zip(chunks, split)}

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        known, split, new = self.chunks, [], set()
        for text in texts:
            if not self.cuts:
                parts = [m[0] for m in self.pattern.finditer(text)]
            elif _GAP.search(text):
                # Next to other white space a match may reach across a blank, so take the matches themselves.
                parts = self.pattern.findall(text)
            else:
                parts = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
            split.append(parts)
            new.update(parts)
        new.difference_update(known)
        if len(known) + len(new) > CACHE:
            # Everything this call needs, and nothing older.
            known = self.chunks = {}
            new = set().union(*split)
        new.discard("")
        known[""] = b""
        known.update(self._learn(list(new)))
        return [b"".join(map(known.__getitem__, parts)) for parts in split]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the tokens, one after another."""
        size = self.lengths[ids]
        total = int(size.sum())
        start = np.repeat(self.offsets[ids] - np.cumsum(size) + size, size)
        return self.flat[start + np.arange(total)]


@lru_cache(maxsize=2)
def vocabulary(lines: bytes, pattern: str) -> Vocabulary:
    return Vocabulary(lines, pattern)


def _encoded(texts: list[str], vocab: Vocabulary) -> list[bytes]:
    """Texts are taken in groups of bounded length; a long text is cut where the pattern starts anew."""
    out, group, size = [], [], 0
    for text in texts:
        if group and size + len(text) > PART:
            out += vocab.encode_texts(group)
            group, size = [], 0
        if len(text) > PART:
            out.append(b"".join(vocab.encode_texts([part])[0] for part in _parts(text)))
            continue
        group.append(text)
        size += len(text)
    return out + (vocab.encode_texts(group) if group else [])


def _parts(text: str):
    """Parts of a long text, cut before single blanks between other characters."""
    cut = regex.compile(r"(?<=\S) (?=\S)")
    begin = 0
    while len(text) - begin > PART:
        found = cut.search(text, begin + PART)
        if not found:
            break
        yield text[begin : found.start()]
        begin = found.start()
    yield text[begin:]


def _tokenizer(lines: bytes, pattern: str, id_type: str, keep: list[str]):
    def run(batches):
        vocab = vocabulary(lines, pattern)
        kind = np.dtype(id_type).newbyteorder("<")
        if vocab.size - 1 > np.iinfo(kind).max:
            raise ValueError(f"ids up to {vocab.size - 1} do not fit {id_type}")
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            for low, high, _, _ in tb.slices(column, PART * 4):
                texts = [t or "" for t in column.slice(low, high - low).to_pylist()]
                part, codes = batch.slice(low, high - low), _encoded(texts, vocab)
                if kind.itemsize != 4:
                    codes = [np.frombuffer(c, "<u4").astype(kind).tobytes() for c in codes]
                kept = [part.column(part.schema.get_field_index(name)) for name in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(codes, pa.binary())], names=[*keep, "ids"])

    return run


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """A rank file's lines.  The driver reads it; it goes to the tasks with the function (under 1 MB)."""
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_type: str = "uint32", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids``: the tokens of ``text`` as little-endian integers of ``id_type``.

    All columns stay, or those in ``keep``; a column called ``ids`` is replaced.  A NULL or empty text has no tokens.  Each row stands for
    itself, so repeated rows, ties and NULLs in other columns change nothing, and an empty table gives an empty one.
    A text of any length is encoded whole, in parts cut where no match of the pattern can reach across.
    """
    docs = docs.drop("ids")
    keep = docs.columns if keep is None else keep
    docs = docs.select(*keep, *[c for c in ("text",) if c not in keep])
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "ids binary"])
    return docs.mapInArrow(_tokenizer(ranks, pattern, id_type, keep), schema)


def _decoder(lines: bytes, pattern: str, id_type: str):
    def run(batches):
        vocab = vocabulary(lines, pattern)
        kind = np.dtype(id_type).newbyteorder("<")
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids"))
            texts = []
            for value in column:
                raw = value.as_py() or b""
                ids = np.frombuffer(raw, kind)
                # Long texts are decoded in parts of bounded size.
                texts.append(b"".join(vocab.decode(ids[i : i + PART]).tobytes() for i in range(0, len(ids), PART)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())],
                                             names=[*batch.schema.names, "decoded"])

    return run


def decode(tokens: DataFrame, ranks: bytes, pattern: str = r"\w+", id_type: str = "uint32") -> DataFrame:
    """``tokens`` with ``decoded``: the bytes that ``ids`` stand for.

    NULL and empty ``ids`` stand for no bytes.  Each row stands for itself, so repeated rows and NULLs in other columns
    change nothing; a column called ``decoded`` is replaced, and an empty table gives an empty one.
    """
    tokens = tokens.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields) + ", decoded binary"
    return tokens.mapInArrow(_decoder(ranks, pattern, id_type), schema)


def _digests(lines: bytes, pattern: str, id_type: pa.DataType):
    def run(batches):
        vocab = vocabulary(lines, pattern)
        for batch in batches:
            for low, high, _, _ in tb.slices(batch.column(1), PART * 4):
                texts = [t or "" for t in batch.column(1).slice(low, high - low).to_pylist()]
                codes = _encoded(texts, vocab)
                ids = [np.frombuffer(c, "<u4") for c in codes]
                back = []
                for row in ids:
                    digest = hashlib.sha256()
                    for i in range(0, len(row), PART):
                        digest.update(vocab.decode(row[i : i + PART]))
                    back.append(digest.hexdigest())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, high - low).cast(id_type), pa.array([len(r) for r in ids], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in codes]), pa.array(back),
                ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def token_digests(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass, of which only counts and digests leave the task.

    Per row of ``docs``: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.  A NULL or empty text has no
    tokens and the digests of nothing; rows that repeat an id, or have none, each have their own result; other columns
    are not read; an empty table gives an empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.mapInArrow(_digests(ranks, pattern, to_arrow_type(kind)), schema)

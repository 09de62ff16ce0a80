"""Words of UTF-8 text as NumPy arrays, without a Python object per word.

Texts stay in their Arrow buffers: a word is a pair of byte offsets and a 64-bit hash.
Work is done in slices of ``SLICE_BYTES`` so that memory does not depend on the Arrow
batch; one text longer than that is a slice of its own, hashed piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
HASH_BYTES = 1 << 20
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240607))
_LETTER = _rng.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_LETTER[65:91] = _LETTER[97:123]  # A-Z count as a-z
_BASE = int(_rng.integers(1, 2**61, dtype=U64)) * 8 + 5
_BACK = pow(_BASE, -1, 2**64)
_MIX = [U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)]
_power = {}


def byte_class(member) -> np.ndarray:
    """Table of 256 booleans from a predicate on byte values."""
    return np.array([bool(member(b)) for b in range(256)])


#: Words separated by ASCII white space: the pattern [^\x20\x09-\x0D]+.
SPACED = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words of letters and digits: the pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
LETTERS = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on every bit."""
    x = (x ^ (x >> U64(30))) * _MIX[0]
    x = (x ^ (x >> U64(27))) * _MIX[1]
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _power.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, HASH_BYTES + 1), base, dtype=U64)
        grown[0] = 1
        have = np.multiply.accumulate(grown)
        if n <= HASH_BYTES + 1:
            _power[base] = have
    return have


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary array; NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, at


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``limit`` bytes: first row, end row, bytes, offsets from 0."""
    flat, at = buffers(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, flat[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def words(flat: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each row's first word (one more than rows)."""
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = table[flat]
    edge = np.zeros(len(flat), bool)
    edge[at[:-1][at[:-1] < len(flat)]] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, equal for words that differ in the case of A-Z only."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASH_BYTES, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(high - low + 1, U64)
        np.cumsum(_LETTER[flat[low:high]] * _powers(_BASE, high - low)[: high - low], out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[b] - sums[a]) * _powers(_BACK, high - low + 1)[a] + (b - a).astype(U64) * _MIX[2]
        i = j
    return mix(out)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words; run i starts at word i (rows are not regarded)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.full(m, n, U64)
    for k in range(n):
        out *= U64(_BASE)
        out += hashes[k : k + m]
    return mix(out)


def run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the runs of hashes from ``starts`` to before ``ends``."""
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * _powers(_BASE, len(hashes))[: len(hashes)], out=sums[1:])
    back = _powers(_BACK, len(hashes) + 1)[starts]
    return mix((sums[ends] - sums[starts]) * back + (ends - starts).astype(U64) * _MIX[2])


def row_of(first: np.ndarray, n: int) -> np.ndarray:
    """Row of each of ``n`` words from the rows' first words."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first)) if n else np.zeros(0, np.int64)

"""Document quality from a linear-chain conditional random field over lines.

Every line of a document is labelled good or bad.  A line's features describe its own
characters and words and those of the lines before and after it; the chain adds a weight
for every pair of neighbouring labels.  Forward and backward passes give each line's
probability of being good, and a document's score is their mean, weighted by line length.

The labels are of documents, so each line takes its document's label for training.  The
fit uses at most ``SAMPLE`` documents of each label (those with the smallest hash of the
id); scoring covers every line of every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm import textbytes as tb

#: Labelled documents of each class that the fit takes at most.
SAMPLE = 2_000
ROUNDS, RATE, DECAY = 80, 0.1, 1e-3
THRESHOLD = 0.3
#: Lines that one forward-backward batch pads to at most (rows times longest row).
CELLS = 1 << 20

_UPPER = tb.byte_class(lambda b: 65 <= b <= 90)
_LOWER = tb.byte_class(lambda b: 97 <= b <= 122)
_DIGIT = tb.byte_class(lambda b: 48 <= b <= 57)
_MARK = tb.byte_class(lambda b: chr(b) in ".,;:?'\"-()")
_SYMBOL = tb.byte_class(lambda b: 32 < b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:?'\"-()")
_STOP = tb.byte_class(lambda b: chr(b) in ".!?")
N_OWN = 15


def lines_of(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every line, and each row's first line; every row has at least one line."""
    breaks = np.flatnonzero(flat == 10)
    per_row = np.searchsorted(breaks, at[1:]) - np.searchsorted(breaks, at[:-1])
    first = np.concatenate([[0], np.cumsum(per_row + 1)])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    is_first, is_last = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
    is_first[first[:-1]], is_last[first[1:] - 1] = True, True
    starts[is_first], ends[is_last] = at[:-1], at[1:]
    starts[~is_first], ends[~is_last] = breaks + 1, breaks
    return starts, ends, first


def line_features(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line by itself, its length in bytes, and each row's first line."""
    starts, ends, first = lines_of(flat, at)
    n, size = len(starts), (ends - starts).astype(float)

    def share(table):
        total = np.concatenate([[0], np.cumsum(table[flat], dtype=np.int32)])
        return total[ends] - total[starts]

    upper, lower, digit, mark, symbol = map(share, (_UPPER, _LOWER, _DIGIT, _MARK, _SYMBOL))
    w_from, w_to, _ = tb.words(flat, at, tb.SPACED)
    line = np.searchsorted(starts, w_from, "right") - 1
    count = np.bincount(line, minlength=n).astype(float)
    some, chars = np.maximum(count, 1), np.maximum(size, 1)
    hashes = tb.word_hashes(flat, w_from, w_to)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    keyed = hashes ^ tb.mix(line.astype(np.uint64) + tb.U64(1))
    _, lead = np.unique(keyed, return_index=True)
    distinct = np.bincount(line[lead], minlength=n)
    by_line = lambda what: np.bincount(line[what], minlength=n) / some
    length = w_to - w_from
    word_ok = (_LOWER | _UPPER | _DIGIT | tb.byte_class(lambda b: b >= 128))[flat]
    letters = np.concatenate([[0], np.cumsum(word_ok, dtype=np.int32)])
    bare = letters[w_to] == letters[w_from]
    odd_end = _SYMBOL[flat[w_to - 1]] if len(w_to) else np.zeros(0, bool)
    full = ends > starts
    last = np.where(full, flat[np.maximum(ends - 1, 0)] if len(flat) else 0, 0)
    head = np.where(full, flat[np.minimum(starts, max(0, len(flat) - 1))] if len(flat) else 0, 0)
    cased = np.maximum(upper + lower, 1)
    out = np.stack([
        np.log1p(count), np.log1p(size), upper / cased, np.minimum(upper / cased * 3, 1), digit / chars, mark / chars,
        symbol / chars, np.minimum(symbol / chars * 10, 1), by_line(bare), by_line(odd_end), by_line(again),
        1 - distinct / some, np.bincount(line, length, minlength=n) / some / 10, _STOP[last].astype(float),
        (_UPPER[head] & (count > 0)).astype(float),
    ], axis=1)
    return out, size, first


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and of the line after (0 where there is none), and a constant."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1]], after[first[1:] - 1] = 0, 0
    return np.concatenate([own, before, after, np.ones((len(own), 1))], axis=1)


@dataclass
class Chain:
    """Weights of a line's features for "good", and of neighbouring labels (bad or good, then bad or good)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights


def forward_backward(scores: np.ndarray, size: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of padded rows: P(good) of each line, and the expected share of each pair of neighbouring labels, added up."""
    n, width = scores.shape
    emit = np.empty((n, width, 2))
    emit[..., 1] = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
    emit[..., 0] = 1 - emit[..., 1]
    emit = np.maximum(emit, 1e-13)
    move = np.exp(steps - steps.max())
    ahead, back = np.empty_like(emit), np.ones_like(emit)
    ahead[:, 0] = emit[:, 0]
    for t in range(1, width):
        a = (ahead[:, t - 1] @ move) * emit[:, t]
        ahead[:, t] = a / a.sum(1, keepdims=True)
    for t in range(width - 2, -1, -1):
        b = (back[:, t + 1] * emit[:, t + 1]) @ move.T
        b /= b.sum(1, keepdims=True)
        back[:, t] = np.where((t + 1 < size)[:, None], b, 1.0)
    both = ahead * back
    good = both[..., 1] / both.sum(-1)
    pair = np.zeros((2, 2))
    for t in range(width - 1):
        use = t + 1 < size
        if not use.any():
            break
        p = ahead[use, t][:, :, None] * move * (back[use, t + 1] * emit[use, t + 1])[:, None, :]
        pair += (p / (p.sum((1, 2), keepdims=True) * size[use][:, None, None])).sum(0)
    return good, pair


def _padded(first: np.ndarray):
    """Batches of rows of similar length: rows, lengths, index of each cell's line, and which cells are lines."""
    size = np.diff(first)
    order = np.argsort(size, kind="stable")
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * size[order[j]] <= CELLS and size[order[j]] <= 2 * size[order[i]] + 8:
            j += 1
        rows = order[i:j]
        width = int(size[rows[-1]])
        mask = np.arange(width) < size[rows][:, None]
        yield rows, size[rows], np.where(mask, first[rows][:, None] + np.arange(width), first[rows][:, None]), mask
        i = j


def fit(own: np.ndarray, first: np.ndarray, label: np.ndarray) -> Chain:
    """Maximum likelihood by Adam steps with a small L2 penalty; the same result for the same rows."""
    x = with_neighbours(own, first)
    mean, scale = x.mean(0), x.std(0)
    mean[-1], scale[scale < 1e-9] = 0, 1
    x = (x - mean) / scale
    size = np.diff(first)
    # Each document counts as much as any other, however long it is.
    per_line = np.repeat(1 / size, size)
    want = np.repeat(label.astype(float), size)
    seen = np.zeros((2, 2))
    seen[0, 0], seen[1, 1] = ((size - 1) / size)[label == 0].sum(), ((size - 1) / size)[label == 1].sum()
    weights, steps = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)
    batches = list(_padded(first))
    for step in range(1, ROUNDS + 1):
        good, pair, scores = np.empty(len(x)), np.zeros((2, 2)), x @ weights
        for _, lengths, cells, mask in batches:
            p, q = forward_backward(scores[cells], lengths, steps)
            good[cells[mask]] = p[mask]
            pair += q
        gain = np.concatenate([((want - good) * per_line) @ x, (seen - pair).ravel()]) / len(size)
        gain -= DECAY * np.concatenate([weights, steps.ravel()])
        m, v = 0.9 * m + 0.1 * gain, 0.999 * v + 0.001 * gain**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, steps = weights + move[:-4], steps + move[-4:].reshape(2, 2)
    return Chain(mean, scale, weights, steps)


def _features(batches):
    for batch in batches:
        for low, high, flat, at in tb.slices(batch.column(1)):
            own, _, first = line_features(flat, at)
            raw = own.astype("<f4")
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(low, high - low).cast(pa.int32()),
                pa.array([raw[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary()),
            ], names=["quality", "lines"])


def is_held_out(doc_id, parts: int, part: int):
    """Whether the CRC32 of the id, written as text, leaves ``part`` when divided by ``parts``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """Fit the chain on at most ``sample`` documents of each label.

    ``labels`` has ``doc_id`` and ``quality`` (0 or 1; NULL and other values are left out).  With no row of one label
    the chain is fitted on what there is; with none at all, every line is as likely good as bad.
    """
    # An id with several labels counts with the lowest.
    chosen = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(
        F.min("quality").cast("int").alias("quality"))
    picked = None
    for value in (0, 1):
        some = chosen.where(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = some if picked is None else picked.unionByName(some)
    picked = F.broadcast(picked)  # at most 2 * sample ids
    rows = docs.select("doc_id", "text").join(picked, "doc_id").select("quality", "text")
    found = sorted(tuple(r) for r in rows.mapInArrow(_features, "quality int, lines binary").collect())
    if not found:
        wide = 3 * N_OWN + 1
        return Chain(np.zeros(wide), np.ones(wide), np.zeros(wide), np.zeros((2, 2)))
    parts = [np.frombuffer(lines, "<f4").reshape(-1, N_OWN).astype(float) for _, lines in found]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return fit(np.concatenate(parts), first, np.array([q for q, _ in found]))


def line_marginals(chain: Chain, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of every line, the line's length, and each row's first line."""
    own, size, first = line_features(flat, at)
    scores = chain.scores(with_neighbours(own, first))
    good = np.empty(len(size))
    for _, lengths, cells, mask in _padded(first):
        good[cells[mask]] = forward_backward(scores[cells], lengths, chain.steps)[0][mask]
    return good, size, first


def row_scores(chain: Chain, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    good, size, first = line_marginals(chain, flat, at)
    weight = size + 1  # an empty line has its break
    return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def _scored(chain: Chain):
    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            for low, high, flat, at in tb.slices(column):
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(row_scores(chain, flat, at))],
                                                 names=[*part.schema.names, "score"])

    return run


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` with ``score``: the length-weighted mean of the lines' probabilities of being good.

    Only ``text`` is looked at; all columns stay, a column called ``score`` is replaced.  A NULL or empty text is one
    empty line.  Each row stands for itself (repeated rows have equal scores); an empty table gives an empty one.
    """
    docs = docs.drop("score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", score double"
    return docs.mapInArrow(_scored(chain), schema)

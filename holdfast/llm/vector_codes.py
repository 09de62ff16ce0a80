"""Compression of vectors to short codes, with codebooks from active-entry Lloyd rounds.

Components become whole numbers, vectors are cut into equal parts, and every part position
has a codebook.  A round assigns each part to its nearest entry and moves every entry to the
floor of its parts' mean.  All of it is integer arithmetic, so results do not depend on how
the rows are dealt out.

A part keeps the exact distance to its entry.  If that entry did not move, all entries that
did not move either are still no better, so the part is compared with the moved entries
only.  A part whose entry moved is compared with the whole codebook.  Sums and counts of the
entries change by the parts that went from one entry to another.

Rows stay where they are: every round reads the table of the round before and writes its
own.  The driver holds the codebooks and their sums, whose size follows from the parameters.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.session import discard, materialize

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Scaled components must be smaller than this, so that distances fit 64 bits (parts of up to 4,096 components).
LIMIT = 1 << 24
#: Whole numbers up to this are exact in double precision.
EXACT = 1 << 53
#: Distances that are held at a time.
CELLS = 1 << 20


@dataclass
class Codebooks:
    """``entries[part, entry, place]``, whole numbers of ``1 / scale``."""

    entries: np.ndarray
    scale: int = SCALE

    def digest(self) -> str:
        """SHA-256 of all components in order, decimal, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each part (row) to each entry."""
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * parts.shape[1] * most * most < EXACT:
        x, c = parts.astype(float), entries.astype(float)
        square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", c, c)
        return (square - 2.0 * (x @ c.T)).astype(np.int64)
    out = np.zeros((len(parts), len(entries)), np.int64)
    for place in range(parts.shape[1]):
        gap = parts[:, place, None].astype(np.int64) - entries[None, :, place]
        out += gap * gap
    return out


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lowest of several, and its distance."""
    code, far = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    step = max(1, CELLS // max(1, len(entries)))
    for low in range(0, len(parts), step):
        d = distances(parts[low : low + step], entries)
        at = d.argmin(1)
        code[low : low + step], far[low : low + step] = at, d[np.arange(len(at)), at]
    return code, far


def reassign(
    parts: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, far: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """:func:`nearest`, from the codes and distances before the entries marked in ``moved`` got new values."""
    code, far = code.copy(), far.copy()
    again = moved[code]
    rows = np.flatnonzero(again)
    if len(rows):
        code[rows], far[rows] = nearest(parts[rows], entries)
    rows, active = np.flatnonzero(~again), np.flatnonzero(moved)
    if len(rows) and len(active):
        at, d = nearest(parts[rows], entries[active])
        at = active[at]
        better = (d < far[rows]) | ((d == far[rows]) & (at < code[rows]))
        code[rows[better]], far[rows[better]] = at[better], d[better]
    return code, far


def _scaled(scale: int):
    """The vectors as 32-bit whole numbers; NULL for those that cannot be coded."""

    def run(batches):
        for batch in batches:
            raw = []
            for v in batch.column(2):
                x = None
                if v.is_valid and len(v.values) and v.values.null_count == 0:
                    x = np.floor(np.asarray(v.values, dtype=float) * scale)
                    if not np.isfinite(np.asarray(v.values, dtype=float)).all():
                        x = None
                    elif np.abs(x).max() >= LIMIT:
                        raise ValueError(f"a vector has a component of {LIMIT // scale} or more")
                raw.append(None if x is None else x.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(raw, pa.binary())], names=["vec_id", "label", "vec"])

    return run


def _matrix(column, kind: str, *shape: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(-1, *shape)


def _step(books: np.ndarray, moved: np.ndarray | None):
    """A round's assignment: new ``code`` and ``far``, and the code before as ``was``."""
    parts, _, width = books.shape

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = _matrix(batch.column(2), "<i4", parts, width).astype(np.int64)
            code, far = np.zeros((2, len(vec), parts), np.int64)
            if moved is not None:
                was = _matrix(batch.column(3), np.uint8, parts)
                old = _matrix(batch.column(4), "<i8", parts)
            for p in range(parts):
                if moved is None:
                    code[:, p], far[:, p] = nearest(vec[:, p], books[p])
                else:
                    code[:, p], far[:, p] = reassign(vec[:, p], books[p], moved[p], was[:, p].astype(np.int64), old[:, p])
            row = lambda x, kind: pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
            before = pa.nulls(len(vec), pa.binary()) if moved is None else batch.column(3)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], row(code, np.uint8), row(far, "<i8"), before, pa.array(far.sum(1))],
                names=["vec_id", "label", "vec", "code", "far", "was", "error"])

    return run


def _changes(parts: int, entries: int, width: int):
    """What the rows add to, and take from, the entries' sums (first ``width`` places) and counts (the last)."""

    def run(batches):
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = _matrix(batch.column(0), "<i4", parts, width).astype(np.int64)
            vec = np.concatenate([vec, np.ones((len(vec), parts, 1), np.int64)], 2)
            code = _matrix(batch.column(1), np.uint8, parts)
            fresh = np.array([not x.is_valid for x in batch.column(2)])
            was = np.frombuffer(b"".join(bytes(parts) if x is None else x for x in batch.column(2).to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                new = np.flatnonzero(fresh | (code[:, p] != was[:, p]))
                np.add.at(total[p], code[new, p], vec[new, p])
                gone = new[~fresh[new]]
                np.subtract.at(total[p], was[gone, p], vec[gone, p])
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["slot", "change"])

    return run


def fit(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[Codebooks, DataFrame]:
    """Codebooks of ``vectors`` and the coded rows: ``vec_id``, ``label``, ``code`` (a byte a part), ``error``.

    The codebooks start as the parts of the ``entries`` (256 at most) smallest ids; rows with equal ids go by their
    vectors, rows without an id come last.  An entry that no part chose stays.  ``error``: squared distances of the
    row's parts, summed, in ``1 / scale`` units.

    Left out are vectors that are NULL or empty, that hold a NULL or non-finite component, or that are not as long
    as that of the smallest id.  Repeated rows count as often as they stand.  An empty table gives codebooks without
    entries and no rows.  Only the three columns are read.  A length that ``parts`` does not divide, and a component
    of ``LIMIT / scale`` or more, are errors.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    labels = vectors.schema[label_column].dataType.simpleString()
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"), F.col(vector_column).alias("vec"))
    ids = rows.schema["vec_id"].dataType.simpleString()
    head = f"vec_id {ids}, label {labels}, vec binary"
    whole = materialize(rows.mapInArrow(_scaled(scale), head).where("vec IS NOT NULL"), "scaled")
    order = [F.col("vec_id").asc_nulls_last(), F.col("vec")]
    first = whole.orderBy(*order).limit(1).select(F.length("vec")).collect()
    size = first[0][0] // 4 if first else 0
    if size % parts:
        raise ValueError(f"{parts} parts do not divide {size} components")
    state = whole.where(F.length("vec") == 4 * size)
    # The seeds: as many rows as a codebook has entries.
    seeds = [r.vec for r in state.orderBy(*order).limit(entries).select("vec").collect()]
    books = np.frombuffer(b"".join(seeds), "<i4").astype(np.int64).reshape(len(seeds), parts, size // parts).transpose(1, 0, 2).copy()
    width = size // parts
    sums = np.zeros((parts, len(seeds), width + 1), np.int64)
    moved, schema = None, f"{head}, code binary, far binary, was binary, error long"
    for turn in range(rounds + 1 if seeds else 0):
        after = materialize(state.mapInArrow(_step(books, moved), schema), "codes")
        discard(whole)
        whole = state = after
        if turn == rounds:
            break
        change = state.where("was IS NULL OR was <> code").select("vec", "code", "was").mapInArrow(
            _changes(*sums.shape[:2], width), "slot long, change long")
        # At most one row per place of the codebooks.
        found = change.groupBy("slot").agg(F.sum("change").alias("change")).toArrow()
        sums.ravel()[np.asarray(found.column("slot").combine_chunks())] += np.asarray(found.column("change").combine_chunks())
        new, used = books.copy(), sums[..., -1] > 0
        new[used] = sums[..., :-1][used] // sums[..., -1:][used]  # numpy's // goes down
        moved, books = (new != books).any(2), new
    if not seeds:
        state = whole.select("vec_id", "label", F.col("vec").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
    return Codebooks(books, scale), state.select("vec_id", "label", "code", "error")


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the errors of all rows with the same label, NULL labels together.

    Errors are summed before the exchange.  The table of labels is written, so that Spark knows its size: it is
    broadcast if it is small and joined by exchange, in which hot labels are split, if not.
    """
    totals = materialize(
        coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label_errors")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")


def _restored(books: np.ndarray, scale: int):
    parts = books.shape[0]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index("code"))
            code = np.frombuffer(b"".join(x or bytes(parts) for x in column.to_pylist()), np.uint8).reshape(-1, parts)
            vec = np.concatenate([books[p][code[:, p]] for p in range(parts)], 1) / scale
            out = pa.array([v if x.is_valid else None for v, x in zip(vec, column)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "restored"])

    return run


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """``coded`` with ``restored``: the entries that ``code`` names, one after another; NULL for a NULL code.

    A column called ``restored`` is replaced; an empty table gives an empty one.
    """
    coded = coded.drop("restored")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields)
    return coded.mapInArrow(_restored(books.entries, books.scale), f"{schema}, restored array<double>")

"""Near-duplicate vectors by sorted projection passes.

In every pass each vector gets a string of bits, the signs of random projections, and the
vectors of a label are put in the lexicographic order of those strings.  Close vectors
tend to stand close together, so each is compared with its neighbours in the order: the
order is cut into blocks, and every block is compared with itself and the one before it,
as a matrix product.  The verified pairs of all passes are united to components.

Before projecting, the mean of a label's vectors is taken off: vectors of one label often lie
in a cone, where most of them agree on most signs.  The number of passes follows, label by
label, from two measurements: how many leading bits of a trial key it takes until the groups
of equal bits fit a window, and how far the vectors lie from their mean, which says how often
two vectors at the threshold agree on a bit.  A pair is then missed by all passes with a
probability of about ``MISS``, up to ``MOST_PASSES``; ``search_plan`` tells what is expected of
each label.  What a window is too short for
is made up exactly: a link never leaves its component, so the links of each vector are
counted by comparing every component with itself, in blocks if it is large.  Tasks hand on
one row per vector (its smallest relative, its number of links), never pairs.

Equal vectors are one vector to the passes and are counted in afterwards.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from holdfast.llm.graph import components
from holdfast.session import materialize

COSINE, MISS, MOST_PASSES = 0.98, 0.002, 64
#: Vectors of a block, of a window's half, and of a part of a large component.
BLOCK, BITS, STEP = 512, 48, 16
#: Leading bits are measured in steps of PROBE, and suffice when all but one in TAIL vectors are in groups of a block.
PROBE, TAIL = 2, 100
#: Labels whose sums of vectors a task holds at a time.
HELD = 4096
SEED = 20240611


def _raw(kind: str):
    """The vectors that can link, as bytes: with all components there and finite, and not zero."""

    def run(batches):
        for batch in batches:
            raw = []
            for v in batch.column(2):
                x = None
                if v.is_valid and v.values.null_count == 0:
                    x = np.asarray(v.values, dtype=kind)
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                raw.append(None if x is None else x.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(raw, pa.binary())], names=["vec_id", "label", "vec"])

    return run


def _units(raws: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision, one per row (all of one size)."""
    x = np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1).astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _sums(kind: str):
    """Number and sum of the unit vectors by label and size."""

    def run(batches):
        held: dict = {}

        def flush():
            if held:
                keys = list(held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys], label), pa.array([k[1] for k in keys], pa.int32()),
                     pa.array([held[k][0] for k in keys], pa.int64()), pa.array([held[k][1].tobytes() for k in keys], pa.binary())],
                    names=["label", "size", "n", "total"])
                held.clear()

        for batch in batches:
            label, raws = batch.schema.field(0).type, batch.column(1).to_pylist()
            groups: dict = {}
            for i, (name, raw) in enumerate(zip(batch.column(0).to_pylist(), raws)):
                groups.setdefault((name, len(raw) // np.dtype(kind).itemsize), []).append(i)
            for key, rows in groups.items():
                x = _units([raws[i] for i in rows], kind)
                n, total = held.get(key, (0, 0.0))
                held[key] = n + len(rows), total + x.sum(0)
            if len(held) > HELD:
                yield from flush()
        yield from flush()

    return run


def _means(table: pa.Table) -> pa.Table:
    """Mean and spread of a label from the tasks' sums."""
    n = sum(table.column("n").to_pylist())
    mean = sum(np.frombuffer(t) for t in table.column("total").to_pylist()) / n
    return pa.table({"label": table.column("label")[:1], "size": table.column("size")[:1], "n": pa.array([n], pa.int64()),
                     "mean": pa.array([mean.tobytes()], pa.binary()), "spread": pa.array([max(0.0, 1.0 - float(mean @ mean))])})


def _keys(passes: int, kind: str, seed: int):
    """Keys of every vector, seen from the mean of its label, which is the last column."""

    def run(batches):
        planes = {}
        for batch in batches:
            raws = batch.column(2).to_pylist()
            size = np.array([len(r) for r in raws])
            keys = np.zeros((len(raws), passes), np.int64)
            for s in np.unique(size):
                rows = np.flatnonzero(size == s)
                means = b"".join(batch.column(3)[i].as_py() for i in rows.tolist())
                x = _units([raws[i] for i in rows], kind) - np.frombuffer(means).reshape(len(rows), -1)
                if s not in planes:
                    rng = np.random.Generator(np.random.PCG64(seed + int(s)))
                    planes[s] = rng.standard_normal((x.shape[1], passes * BITS))
                bits = (x @ planes[s] >= 0).reshape(len(rows), passes, BITS)
                keys[rows] = bits @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:3], pa.array((size // np.dtype(kind).itemsize).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(raws) + 1) * passes, pa.int32()), pa.array(keys.ravel())),
            ], names=["vec_id", "label", "vec", "size", "keys"])

    return run


def _relatives(cosine: float, kind: str):
    """Of one window, for each vector the smallest id that it reaches by links inside the window, if not its own."""

    def run(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("vec_id").combine_chunks())
        order = np.argsort(ids, kind="stable")
        raws = table.column("vec").to_pylist()
        x = _units([raws[i] for i in order], kind)
        one, two = np.nonzero(np.triu(x @ x.T >= cosine, 1))
        low = np.arange(len(ids))
        while True:  # ids are in order, so the smallest index is the smallest id
            new = low.copy()
            np.minimum.at(new, one, low[two])
            np.minimum.at(new, two, low[one])
            new = new[new]
            if (new == low).all():
                break
            low = new
        ids, far = ids[order], np.flatnonzero(low != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[far]), "b": pa.array(ids[low[far]])})

    return run


def search_plan(classes: DataFrame, kind: str, cosine: float = COSINE, miss: float = MISS, seed: int = SEED) -> DataFrame:
    """By ``label`` and ``size``: ``n``, ``mean``, ``spread``, leading ``bits``, ``passes``, ``expected_miss``.

    ``expected_miss`` is the probability that a pair at the threshold meets in no pass.  ``classes`` has distinct
    vectors: ``label``, ``rep``, ``vec``.
    """
    label = classes.schema["label"].dataType.simpleString()
    parts = classes.select("label", "vec").mapInArrow(_sums(kind), f"label {label}, size int, n long, total binary")
    means = materialize(parts.groupBy("label", "size").applyInArrow(
        _means, f"label {label}, size int, n long, mean binary, spread double"), "means")
    trial = _with_mean(classes, means, kind).mapInArrow(_keys(1, kind, seed), _KEYED.format(label=label))
    # The bits of one pass, cut to 0, PROBE, 2 * PROBE ... leading ones, and how many vectors agree on them.
    levels = F.explode(F.sequence(F.lit(0), F.lit(BITS), F.lit(PROBE)))
    cut = trial.select("label", "size", F.col("keys")[0].alias("key"), levels.alias("level"))
    # Keys have BITS bits, so at level 0 nothing is left.
    groups = cut.groupBy("label", "size", "level", F.expr(f"shiftright(key, {BITS} - level)").alias("lead")).agg(F.count("*").alias("_n"))
    fits = groups.groupBy("label", "size", "level").agg(
        F.sum(F.when(F.col("_n") > BLOCK, F.col("_n")).otherwise(0)).alias("_over"), F.sum("_n").alias("_all"))
    bits = fits.groupBy("label", "size").agg(
        F.coalesce(F.min(F.when(F.col("_over") * TAIL <= F.col("_all"), F.col("level"))), F.lit(BITS)).alias("bits"))
    known = means.join(bits, ["label", "size"])
    # Seen from the mean, two vectors at the threshold are further apart.  Where most vectors of a label link with each
    # other, any of their links will do, so the angle is not taken for larger than 60 degrees.  They must agree on the
    # leading bits, and on one more, which allows for uneven parts.
    seen = F.greatest(F.lit(0.5), 1 - (1 - cosine) / F.greatest("spread", F.lit(1e-12)))
    once = F.least(F.pow(1 - F.acos(F.least(seen, F.lit(1.0))) / math.pi, F.col("bits") + 1), F.lit(1 - 1e-9))
    passes = F.greatest(F.lit(1), F.least(F.lit(MOST_PASSES), F.ceil(math.log(miss) / F.log(1 - once)).cast("int")))
    return known.withColumn("passes", passes).withColumn("expected_miss", F.pow(1 - once, F.col("passes")))


_KEYED = "vec_id long, label {label}, vec binary, size int, keys array<long>"


def _with_mean(classes: DataFrame, means: DataFrame, kind: str, *more: str) -> DataFrame:
    """The classes' vectors with the mean of their label; the table of means is broadcast if Spark finds it small."""
    sized = classes.select(
        F.col("rep").alias("vec_id"), "label", "vec", F.expr(f"length(vec) div {np.dtype(kind).itemsize}").cast("int").alias("size"))
    return sized.join(means.select("label", "size", "mean", *more), ["label", "size"]).select("vec_id", "label", "vec", "mean", *more)


def _windows(vectors: DataFrame) -> DataFrame:
    """One row per vector, pass of its label and window; a vector is in the window of its block and in the next one's.

    A vector's place in the order comes from counts per group of leading bits, added up level by level, so that no
    sum spans more than ``2 ** STEP`` groups and no sort more than the vectors with one and the same key.
    """
    keyed = vectors.select("vec_id", "label", "size", "vec", F.posexplode("keys").alias("turn", "_key"))
    levels = [f"_bits{n}" for n in range(STEP, BITS, STEP)]
    for n, name in zip(range(STEP, BITS, STEP), levels):
        keyed = keyed.withColumn(name, F.shiftright("_key", BITS - n))
    table = ["turn", "label", "size"]
    groups = [*table, *levels, "_key"]
    starts = counts = keyed.groupBy(*groups).agg(F.count("*").alias("_n"))
    starts = starts.select(*groups, F.lit(0).cast("long").alias("_start"))
    while len(groups) > len(table):  # from the finest groups to the coarsest
        ahead = W.partitionBy(*groups[:-1]).orderBy(groups[-1]).rowsBetween(W.unboundedPreceding, -1)
        before = counts.select(*groups, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
        starts = starts.join(before, groups).withColumn("_start", F.col("_start") + F.col("_before")).drop("_before")
        groups = groups[:-1]
        counts = counts.groupBy(*groups).agg(F.sum("_n").alias("_n"))
    rank = F.row_number().over(W.partitionBy(*table, "_key").orderBy("vec_id")) - 1
    block = F.floor((F.col("_start") + rank) / BLOCK)
    placed = keyed.join(starts.select(*table, "_key", "_start"), [*table, "_key"]).withColumn("_block", block)
    return placed.select(*table, "vec_id", "vec", F.explode(F.array("_block", F.col("_block") + 1)).alias("block"))


def _counts(cosine: float, kind: str):
    """Links of each vector inside a unit: whole small components, or two parts of a large one."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("side", "ascending")])
        ids, comp, side, copies = (
            np.asarray(table.column(c).combine_chunks()) for c in ("vec_id", "component", "side", "copies"))
        raws, links = table.column("vec").to_pylist(), np.zeros(len(ids), np.int64)
        edge = np.flatnonzero(np.concatenate([[True], comp[1:] != comp[:-1], [True]]))
        for a, b in zip(edge[:-1], edge[1:]):
            x = _units(raws[a:b], kind)
            cut = int(np.searchsorted(side[a:b], 1))
            if cut in (0, b - a):  # one part with itself
                near = x @ x.T >= cosine
                np.fill_diagonal(near, False)
                links[a:b] = near @ copies[a:b]
            else:
                near = x[:cut] @ x[cut:].T >= cosine
                links[a : a + cut] = near @ copies[a + cut : b]
                links[a + cut : b] = near.T @ copies[a : a + cut]
        return pa.table({"vec_id": pa.array(ids), "links": pa.array(links)})

    return run


def _count_links(members: DataFrame, cosine: float, kind: str) -> DataFrame:
    """``vec_id``, ``links``: copies of other vectors of the component that are close enough."""
    size = members.groupBy("component").agg(F.count("*").alias("_size"))
    sized = members.join(size, "component").withColumn("_parts", F.expr(f"(_size + {BLOCK - 1}) div {BLOCK}"))
    packs = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    small = sized.where("_parts = 1").select(
        "vec_id", "vec", "copies", "component", F.lit(0).alias("side"), F.lit(-1).cast("long").alias("one"),
        F.pmod(F.xxhash64("component"), F.lit(packs)).alias("two"), F.lit(0).cast("long").alias("owner"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("_parts"))
    large = sized.where("_parts > 1").withColumn("_part", part).withColumn(
        "_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    large = large.select(
        "vec_id", "vec", "copies", "component", (F.col("_part") > F.col("_other")).cast("int").alias("side"),
        F.least("_part", "_other").alias("one"), F.greatest("_part", "_other").alias("two"),
        F.col("component").alias("owner"))
    units = small.unionByName(large).groupBy("one", "two", "owner")
    return units.applyInArrow(_counts(cosine, kind), "vec_id long, links long").groupBy("vec_id").agg(F.sum("links").alias("links"))


def near_duplicates(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    cosine: float = COSINE, miss: float = MISS, seed: int = SEED,
) -> DataFrame:
    """Per row of ``vectors``: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors link when their labels are equal and not NULL and their cosine, in double precision, is at least
    ``cosine``.  ``n_links``: other ids linked directly; ``component_id``: smallest id reachable, itself included;
    ``kept``: whether the row has that id.  Only the three columns are read.

    A NULL, empty or zero vector, one with a NULL or non-finite component, and a row without label or id link with
    nothing (without id: ``component_id`` NULL, not kept).  Vectors of different sizes never link.  Rows that repeat
    an id with an equal vector are one vector and have equal results.  Ties in the order go to the smaller id.  An
    empty table gives an empty one.
    """
    kind = "<f4" if vectors.schema[vector_column].dataType.elementType.simpleString() == "float" else "<f8"
    labels = vectors.schema[label_column].dataType.simpleString()
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).alias("label"),
                          F.col(vector_column).alias("vec"))
    rows = rows.mapInArrow(_raw(kind), f"vec_id long, label {labels}, vec binary")
    rows = materialize(rows.withColumn("digest", F.md5("vec")), "vectors")
    able = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    once = able.dropDuplicates(["vec_id", "label", "digest"])
    classes = materialize(
        once.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"),
                                            F.min("vec").alias("vec")), "classes")
    plan = materialize(search_plan(classes, kind, cosine, miss, seed), "plan")
    most = plan.agg(F.max("passes")).first()[0] or 1
    keyed = _with_mean(classes, plan, kind).mapInArrow(_keys(most, kind, seed), _KEYED.format(label=labels))
    keyed = keyed.join(plan.select("label", "size", "passes"), ["label", "size"]).withColumn("keys", F.expr("slice(keys, 1, passes)"))
    keyed = keyed.select("vec_id", "label", "vec", "size", "keys")
    near = _windows(materialize(keyed, "keys")).groupBy("turn", "label", "size", "block").applyInArrow(
        _relatives(cosine, kind), "a long, b long")
    label_of = materialize(components(near, "a", "b"), "components")
    members = classes.withColumnRenamed("rep", "vec_id").join(label_of.withColumnRenamed("node", "vec_id"), "vec_id")
    counts = _count_links(members, cosine, kind).withColumnRenamed("vec_id", "rep")
    known = classes.select("label", "digest", "rep", "copies").join(counts, "rep", "left").join(
        label_of.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select(
        "label", "digest", F.coalesce("component", "rep").alias("_component"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"))
    named = rows.select(
        "vec_id", "label", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(known, ["label", "digest"], "left")
    component = F.coalesce("_component", "vec_id")
    return named.select(
        "vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))

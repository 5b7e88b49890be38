"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with a cosine of at least ``t`` lie within ``epsilon =
sqrt(2 - 2 t)`` of each other, and so do their projections.  The leading
principal directions come from the second moments of all vectors, added up
by Spark.  Vectors are sorted by their grid cells of width epsilon on those
directions (epsilon grid order) and cut into blocks of ``BLOCK_ROWS`` along
that sequence; ``FAN`` blocks in a row make an interval, ``FAN`` intervals a
longer one, up to one that holds all.  The join descends from the whole
sequence with itself: a pair of intervals is split into the pairs of their
parts, and pairs whose bounding boxes are over epsilon apart are dropped
with all below them.  Boxes also bound the length of what the directions leave
out, which differs by no more than the vectors do.  Each level is one Spark
join of pairs with parts; inside a block the descent goes on to ``RUN_ROWS``.

Block pairs that are left are dealt into a grid of cells of ``CELL`` by
``CELL`` blocks, so a block is sent once to each cell that has a pair of it.
Runs are compared in double precision.  A pair returns a number of links per
vector and pairs that connect what its links connect (a spanning set), so a
group of near copies is never written out as all its pairs.  Equal vectors are
one numbered row with a count from the start, whatever ids they have.

Vectors that are null, zero, or hold null or non-finite components link with
nothing and are their own component, as are rows with a null id (component
null, not kept).  Vectors of different lengths never link.  Rows with equal
vectors are copies of each other, also under one id; an id that holds several
vectors has links, component and ``kept`` for each of its rows.  Extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.components import components, saved, spanning
from kiln.llm.vectors import matrix, usable

THRESHOLD = 0.95
DIRECTIONS = 6
BLOCK_ROWS = 4096
FAN = 8
CELL = 8
RUN_ROWS = 64
_SLACK = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither squares nor sums can overflow
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _moments(width: int):
    def run(batches):
        total, n = np.zeros((width + 1, width)), 0
        for b in batches:
            u = _unit(matrix(b.column(0)))
            total[:width] += u.T @ u
            total[width] += u.sum(axis=0)
            n += len(u)
        flat = np.concatenate((total.ravel(), [n]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "x"])

    return run


def directions(vectors: DataFrame, width: int, k: int) -> np.ndarray:
    """The k leading principal directions of all unit vectors, a column each."""
    got = vectors.select("v").mapInArrow(_moments(width), "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    flat = np.zeros(width * (width + 1) + 1)
    flat[got["i"]] = got["x"]
    n, mean = max(flat[-1], 1), flat[width * width : -1] / max(flat[-1], 1)
    _, axes = np.linalg.eigh(flat[: width * width].reshape(width, width) / n - np.outer(mean, mean))
    return np.ascontiguousarray(axes[:, ::-1][:, :k])


def _cells(axes: np.ndarray, epsilon: float):
    def run(batches):
        for b in batches:
            p = _unit(matrix(b.column(1))) @ axes
            cells = np.floor(p / epsilon).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(list(cells), pa.list_(pa.int32()))], ["rep", "v", "n", "cells"])

    return run


def _coordinates(u: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Projections of unit vectors and the length of what the directions leave out: no two vectors are nearer than these."""
    p = u @ axes
    return np.column_stack((p, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", p, p)))))


def _cut(axes: np.ndarray, rows: int):
    """Pieces of the sorted sequence, none longer than a block: number in the split, rows, box, ids, counts, vectors."""

    def run(batches):
        split, number, held = TaskContext.get().partitionId(), 0, []

        def out(t):
            x = matrix(t.column(1))
            p = _coordinates(_unit(x), axes)
            with np.errstate(over="ignore"):
                small = x.astype(np.float32)
            x = small if (small == x).all() else x  # half the bytes where nothing is lost
            return pa.RecordBatch.from_arrays(
                [pa.array([split]), pa.array([number]), pa.array([t.num_rows]), pa.array([p.min(axis=0).tolist()]), pa.array([p.max(axis=0).tolist()]),
                 pa.array([t.column(0).to_numpy().tobytes()], pa.binary()), pa.array([t.column(2).to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())],
                ["split", "number", "rows", "low", "high", "ids", "n", "x"])

        for b in batches:
            held.append(b)
            while sum(x.num_rows for x in held) >= rows:
                t = pa.concat_batches(held)
                yield out(t.slice(0, rows))
                number, held = number + 1, [t.slice(rows)]
        if sum(x.num_rows for x in held):
            yield out(pa.concat_batches(held))

    return run


def _read(ids, n, x, width: int):
    """Ids, counts and unit vectors of a block's pieces."""
    parts = [np.frombuffer(v, np.float32 if len(v) * 2 == len(i) * width else np.float64).reshape(-1, width) for i, v in zip(ids, x)]
    return np.frombuffer(b"".join(ids), np.int64), np.frombuffer(b"".join(n), np.int64), _unit(np.concatenate(parts).astype(np.float64))


class _Runs:
    """A block's vectors with the boxes of its runs."""

    def __init__(self, ids, n, x, axes: np.ndarray):
        self.ids, self.n, self.x = _read(ids, n, x, len(axes))
        self.at = np.arange(0, len(self.ids), RUN_ROWS)
        c = _coordinates(self.x, axes)
        self.low, self.high = np.minimum.reduceat(c, self.at), np.maximum.reduceat(c, self.at)

    def near(self, k: int, other: "_Runs", epsilon: float) -> np.ndarray:
        """Rows of the other block in runs that may hold a partner of run k."""
        gap = np.maximum(0, np.maximum(self.low[k] - other.high, other.low - self.high[k]))
        runs = np.flatnonzero(np.einsum("ij,ij->i", gap, gap) <= (epsilon + _SLACK) ** 2)
        rows = (other.at[runs][:, None] + np.arange(RUN_ROWS)).ravel()
        return rows[rows < len(other.ids)]


def _links(a: _Runs, b: _Runs, same: bool, threshold: float, epsilon: float):
    """(links of a's vectors, links of b's, pairs that connect what is linked) of two blocks, or of one with itself."""
    a_links, b_links, pairs = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64), []
    for k, at in enumerate(a.at.tolist()):
        cols = a.near(k, b, epsilon)
        if not len(cols):
            continue
        part = slice(at, at + RUN_ROWS)
        near = a.x[part] @ b.x[cols].T >= threshold
        if same:
            near &= np.arange(at, at + len(near))[:, None] != cols[None, :]
        if not near.any():
            continue
        a_links[part] += near @ b.n[cols]
        if not same:
            b_links[cols] += a.n[part] @ near
        for (side, i), (other, j) in spanning(near):
            pairs.append(((a.ids[part] if side == 0 else b.ids[cols])[i], (a.ids[part] if other == 0 else b.ids[cols])[j]))
    return a_links, b_links, pairs


def _compare(threshold: float, epsilon: float, axes: np.ndarray):
    """Links of a cell's block pairs: kind 0 is (vector, links), kind 1 a pair of connected vectors."""

    def run(pairs: pa.Table, members: pa.Table) -> pa.Table:
        blocks = {at: _Runs(ids, n, x, axes) for at, ids, n, x in zip(*[members.column(c).to_pylist() for c in ("at", "ids", "n", "x")])}
        counts = {at: np.zeros(len(b.ids), np.int64) for at, b in blocks.items()}
        edges = [np.zeros((2, 0), np.int64)]
        for p, q in zip(pairs.column("p").to_pylist(), pairs.column("q").to_pylist()):
            a_links, b_links, found = _links(blocks[p], blocks[q], p == q, threshold, epsilon)
            counts[p] += a_links
            counts[q] += b_links
            if found:
                a, c = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
                edges.append(np.unique(np.stack([np.minimum(a, c), np.maximum(a, c)]), axis=1))
        on = [(blocks[at].ids[n > 0], n[n > 0]) for at, n in counts.items()]
        ids, links = (np.concatenate(v) for v in zip(*on))
        e = np.concatenate(edges, axis=1)
        kind = np.repeat(np.array([0, 1], np.int32), [len(ids), e.shape[1]])
        return pa.table({"kind": pa.array(kind), "a": pa.array(np.concatenate((ids, e[0]))), "b": pa.array(np.concatenate((links, e[1])))})

    return run


def _apart(epsilon: float):
    """True if the boxes of intervals p and q are over epsilon apart."""
    gaps = F.zip_with(F.arrays_zip(F.col("p_low").alias("l"), F.col("p_high").alias("h")), F.arrays_zip(F.col("q_low").alias("l"), F.col("q_high").alias("h")),
                      lambda p, q: F.greatest(F.lit(0.0), p["l"] - q["h"], q["l"] - p["h"]))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x) > (epsilon + _SLACK) ** 2


def _close_pairs(blocks: DataFrame, n_blocks: int, epsilon: float) -> DataFrame:
    """``p, q`` (p <= q): block pairs left by the descent."""
    box = lambda side, level: level.select(F.col("at").alias(side), F.col("up").alias(f"{side}_up"), F.col("low").alias(f"{side}_low"), F.col("high").alias(f"{side}_high"))
    levels = [blocks.select("at", "low", "high")]
    size = n_blocks
    while size > 1:
        k = levels[-1]
        levels.append(saved(_box(k, F.floor(F.col("at") / FAN))))
        size = -(-size // FAN)
    pairs = levels[-1].select(F.col("at").alias("p"), F.col("at").alias("q"))
    for level in reversed(levels[:-1]):
        k = level.withColumn("up", F.floor(F.col("at") / FAN).cast("long"))
        split = pairs.withColumnsRenamed({"p": "p_up", "q": "q_up"}).join(box("p", k), "p_up").join(box("q", k), "q_up").where("p <= q")
        pairs = saved(split.where(~_apart(epsilon)).select("p", "q"))
    return pairs


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold))
    rows = usable(df, id_col, vector).where(F.exists("v", lambda x: x != 0))
    sets = saved(rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    sets = sets.withColumn("node", F.monotonically_increasing_id())  # a number per distinct vector
    found = None
    for width in [r["w"] for r in sets.select(F.size("v").alias("w")).distinct().collect()]:  # one per length of vectors
        same = sets.where(F.size("v") == width)
        axes = directions(same, width, DIRECTIONS)
        axes = np.pad(axes, ((0, 0), (0, DIRECTIONS - axes.shape[1])))
        placed = same.select("node", "v", "n").mapInArrow(_cells(axes, epsilon), "rep long, v array<double>, n long, cells array<int>")
        ordered = placed.repartitionByRange("cells", "rep").sortWithinPartitions("cells", "rep")
        pieces = saved(ordered.mapInArrow(_cut(axes, BLOCK_ROWS), "split long, number long, rows long, low array<double>, high array<double>, ids binary, n binary, x binary"))
        blocks, n_blocks = _blocks(pieces)
        pairs = _close_pairs(blocks.select("at", "low", "high"), n_blocks, epsilon)
        pairs = pairs.select(F.floor(F.col("p") / CELL).alias("i"), F.floor(F.col("q") / CELL).alias("j"), "p", "q")
        members = pairs.select(F.col("i").alias("mi"), F.col("j").alias("mj"), F.explode(F.array("p", "q")).alias("at")).distinct()
        members = members.join(blocks.select("at", *[F.col(f"parts.{c}").alias(c) for c in ("ids", "n", "x")]), "at")
        links = pairs.groupBy("i", "j").cogroup(members.groupBy("mi", "mj")).applyInArrow(_cell(threshold, epsilon, axes), "kind int, a long, b long")
        found = links if found is None else found.union(links)
    if found is None:
        found = rows.select(F.lit(0).alias("kind"), F.col("vec_id").alias("a"), F.col("vec_id").alias("b")).where("false")
    found = saved(found)
    groups = saved(components(found.where("kind = 1")))
    least = groups.join(sets.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("least"))
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    classes = (sets.join(counts, "node", "left").join(groups.join(least, "root").select("node", "least"), "node", "left")
               .select(F.col("v").alias("key"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id")))
    every = df.select(F.col(id_col).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    joined = every.join(saved(classes), (F.col("v") == F.col("key")) & F.col("vec_id").isNotNull(), "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id"),
                         F.coalesce(F.coalesce("component_id", F.col("vec_id").cast("long")) == F.col("vec_id"), F.lit(False)).alias("kept"))


def _cell(threshold: float, epsilon: float, axes: np.ndarray):
    """The comparison as a function of two tables, as Spark wants it."""
    run = _compare(threshold, epsilon, axes)
    return lambda pairs, members: run(pairs, members)


def _box(level: DataFrame, key, *more) -> DataFrame:
    """The rows of a level by key ``at`` with the box around theirs."""
    edge = lambda c, f: F.array(*[f(F.col(c)[i]) for i in range(DIRECTIONS + 1)])
    return level.groupBy(key.cast("long").alias("at")).agg(edge("low", F.min).alias("low"), edge("high", F.max).alias("high"), *more)


def _blocks(pieces: DataFrame) -> tuple[DataFrame, int]:
    """Blocks of about BLOCK_ROWS rows along the whole sequence, however many tasks sorted it.

    What lies before each task's share comes from one number per task.  A block
    holds the pieces that begin in its stretch: less than twice BLOCK_ROWS rows.
    """
    sizes = [(r["split"], r["n"]) for r in pieces.groupBy("split").agg(F.sum("rows").alias("n")).collect()]  # a row per task
    before, total = {}, 0
    for split, n in sorted(sizes):
        before[split], total = total, total + n
    if not before:
        return pieces.select(F.lit(0).cast("long").alias("at"), "low", "high", F.array(F.struct("ids", "n", "x")).alias("parts")), 0
    start = F.element_at(F.create_map(*[x for k, v in before.items() for x in (F.lit(k).cast("long"), F.lit(v).cast("long"))]), F.col("split")) + F.col("number") * BLOCK_ROWS
    parts = F.sort_array(F.collect_list(F.struct("split", "number", "ids", "n", "x"))).alias("parts")
    return saved(_box(pieces, F.floor(start / BLOCK_ROWS), parts)), -(-total // BLOCK_ROWS)


ORACLE = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
v AS (
  SELECT * FROM d WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.row AS a, b.row AS b FROM v a JOIN v b ON a.row <> b.row AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT row, row AS other FROM v UNION SELECT r.row, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT r.row, min(v.vec_id) AS component_id FROM r JOIN v ON v.row = r.other GROUP BY r.row),
n AS (SELECT a AS row, count(*) AS n_links FROM l GROUP BY a)
SELECT d.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, d.vec_id) AS component_id, coalesce(coalesce(component_id, d.vec_id) = d.vec_id, false) AS kept
FROM d LEFT JOIN c USING (row) LEFT JOIN n USING (row)
"""

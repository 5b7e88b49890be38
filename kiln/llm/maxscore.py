"""Exact top-k search by MaxScore.

A component of a vector is a term's weight, so a query's score is a sum over
its terms.  The rows are dealt into shards.  In a shard every term has a
bound, the most it can add to a score of this query there.  Terms are taken
by falling bound.  As soon as the bounds of the terms left sum to less than
the query's k-th best score so far, those terms are non-essential: a row
that gains from none of the essential terms can't be among the best.  The
postings (rows that gain) of the essential terms are traversed; the rows
found are then probed in the other terms for as long as their score so far
plus the bounds left is still competitive.  A shard's first rows are scored
whole, which gives the others a bar.  Each shard returns its k best rows of
every query, and those lists are merged.

Shards and blocks of queries meet in a grid: a cell holds up to about
``CELL_SHARDS`` shards and ``CELL_BLOCKS`` blocks, every shard goes to the cells
of one row and every block to those of one column.  Weights travel in the
smallest integers that hold them.  Memory is bounded by a cell, and nothing is
copied more often than there are groups on the other side.

Rows take part if their id is not null, their vector has only finite
components, and no weight is beyond 2**31 / sqrt(width): all scores then fit
into 64 bits.  Shorter vectors count as ending in zeros.  Every query row has a
list of its own, a repeated one too; an id that holds several vectors has a
list for each of its query rows.  Rows with the query's id are never among its
results, whatever their vector; other repeated rows are, each for itself.  Ties
go to the smaller id.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.components import saved
from kiln.llm.vectors import matrix, usable

SHARD_ROWS = 4096
QUERY_ROWS = 512
FIRST_ROWS = 256
TERMS_AT_ONCE = 8
CELL_SHARDS, CELL_BLOCKS = 64, 256
SCALE = 256


def _weights(column, scale: int, width: int | None = None) -> np.ndarray:
    return np.floor(scale * matrix(column, width)).astype(np.int64)


def _small(w: np.ndarray) -> tuple[int, bytes]:
    """Bytes a weight, and the weights as integers of that size."""
    most = int(np.abs(w).max(initial=0))
    size = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return size, np.ascontiguousarray(w.T).astype(f"i{size}").tobytes()


def _large(size: int, raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"i{size}").reshape(width, -1).astype(np.int64)


def _blocks(rows: int, scale: int, width: int):
    """Rows of a split as blocks: ``block`` number, ids and integer weights (one row per term)."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, weights, held = [], [], 0

        def out():
            size, raw = _small(np.concatenate(weights))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([size]), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([raw], pa.binary())], ["block", "size", "ids", "weights"])

        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                if held + part.num_rows > rows:
                    yield from out()
                    ids, weights, held, number = [], [], 0, number + 1
                ids.append(part.column(0).to_numpy() if pa.types.is_integer(part.column(0).type) else part.column(0).flatten().to_numpy())
                weights.append(_weights(part.column(1), scale, width))
                held += part.num_rows
        if held:
            yield from out()

    return run


def _exact_type(w: np.ndarray, q: np.ndarray):
    """Doubles add integers exactly below 2**53; beyond that, 64-bit integers."""
    most = float(np.abs(w).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, len(w))
    return np.float64 if most < 2.0**52 else np.int64


class Shard:
    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        order = np.argsort(ids, kind="stable")  # so that of equal scores the smaller id comes first
        self.ids, self.w = ids[order], np.ascontiguousarray(weights[:, order])
        self.high, self.low = self.w.max(axis=1, initial=0), self.w.min(axis=1, initial=0)

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the query's k best rows here."""
        bound = np.where(q > 0, q * self.high, q * self.low)  # of each term; never below zero
        order = np.argsort(-bound, kind="stable")
        q, bound = q[order], bound[order]
        left = np.concatenate((np.cumsum(bound[::-1])[::-1], [0]))  # bounds of the terms from here on
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, self.w.dtype)
        for first, last in ((0, FIRST_ROWS), (FIRST_ROWS, len(self.ids))):
            ids = self.ids[first:last]
            if not len(ids):
                continue
            bar = best[-1] if len(best) >= k else None
            rows, score = self._rows(order, q, left, first, last, bar)
            rows = rows[ids[rows] != own]
            all_ids, all_scores = np.concatenate((best_ids, ids[rows])), np.concatenate((best, score[rows]))
            if len(all_ids) > k:
                top = np.partition(all_scores, len(all_scores) - k)[len(all_scores) - k]
                some = all_scores >= top
                all_ids, all_scores = all_ids[some], all_scores[some]
            by = np.lexsort((all_ids, -all_scores))[:k]
            best_ids, best = all_ids[by], all_scores[by]
        return best_ids, best

    def _rows(self, order, q, left, first, last, bar):
        """(rows that may reach the bar, their scores)."""
        w = self.w[:, first:last]
        n_terms, n = len(order), w.shape[1]
        score = np.zeros(n, w.dtype)
        essential = n_terms if bar is None else int(np.searchsorted(-left[:-1], -bar, side="right"))
        found = np.full(n, bar is None or bar <= 0)  # a row that gains nothing can reach such a bar
        for t in range(0, essential, TERMS_AT_ONCE):
            part = slice(t, min(t + TERMS_AT_ONCE, essential))
            gain = q[part, None] * w[order[part]]
            found |= (gain > 0).any(axis=0)
            score += gain.sum(axis=0)
        rows = np.flatnonzero(found)
        for t in range(essential, n_terms, TERMS_AT_ONCE):
            rows = rows[score[rows] + left[t] >= bar]
            if not len(rows):
                break
            part = slice(t, t + TERMS_AT_ONCE)
            score[rows] += q[part] @ w[order[part]][:, rows]
        return rows if bar is None else rows[score[rows] >= bar], score


def _search(k: int, width: int):
    def run(shards: pa.Table, blocks: pa.Table) -> pa.Table:
        out = []
        asked = [(np.frombuffer(ids, np.int64).reshape(-1, 2), _large(size, raw, width).T) for size, ids, raw in zip(*[blocks.column(c).to_pylist() for c in ("size", "ids", "weights")])]
        for size, ids, raw in zip(*[shards.column(c).to_pylist() for c in ("size", "ids", "weights")]):
            w = _large(size, raw, width)
            for q_ids, q in asked:
                kind = _exact_type(w, q)
                shard = Shard(np.frombuffer(ids, np.int64), w.astype(kind))
                for (row, own), x in zip(q_ids.tolist(), q.astype(kind)):
                    found, score = shard.search(own, x, k)
                    out.append((np.full(len(found), row), np.full(len(found), own), found, score.astype(np.int64)))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["row", "query_id", "vec_id", "score"])

    return run


def _fitting(df: DataFrame, scale: int, width: int) -> DataFrame:
    """The rows whose weights are small enough for scores of 64 bits."""
    most = 2.0**31 / width**0.5
    return df.where(F.forall("v", lambda x: F.abs(x) * scale <= most))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of highest integer inner product for every query row."""
    data, asked = usable(rows, id_col, vector), usable(queries, id_col, vector)
    width = max(1, data.agg(F.max(F.size("v"))).first()[0] or 0, asked.agg(F.max(F.size("v"))).first()[0] or 0)
    fields = "block long, size long, ids binary, weights binary"
    shards = saved(_fitting(data, scale, width).mapInArrow(_blocks(SHARD_ROWS, scale, width), fields))
    asked = saved(_fitting(asked, scale, width)).withColumn("row", F.monotonically_increasing_id())  # tells repeated query rows apart
    asked = asked.select(F.array("row", "vec_id").alias("vec_id"), "v")
    blocks = saved(asked.repartition(max(1, -(-asked.count() // QUERY_ROWS)), "vec_id").mapInArrow(_blocks(QUERY_ROWS, scale, width), fields))
    groups = lambda n, most: -(-n // min(most, max(1, round(n**0.5))))
    across, down = groups(shards.count(), CELL_SHARDS), groups(blocks.count(), CELL_BLOCKS)
    place = lambda n: F.pmod(F.xxhash64("block"), F.lit(max(n, 1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    left = shards.select(place(across).alias("x"), every(down).alias("y"), "size", "ids", "weights")
    right = blocks.select(every(across).alias("x"), place(down).alias("y"), "size", "ids", "weights")
    found = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(lambda a, b: _search(k, width)(a, b), "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH f AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (
  SELECT row, vec_id, list_transform(e, lambda x: x::BIGINT) AS e FROM f, (SELECT 2147483648 / sqrt(greatest(1, max(len(e)))) AS most FROM f)
  WHERE len(e) = 0 OR greatest(list_max(e), -list_min(e)) <= most),
t AS (SELECT row, vec_id, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS w FROM v),
s AS (
  SELECT q.row AS q_row, q.vec_id AS query_id, r.row AS r_row, r.vec_id AS vec_id, sum(q.w * r.w)::BIGINT AS score
  FROM t q JOIN t r ON q.i = r.i AND q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY q_row ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""

"""Distributed list ranking by contraction.

A list is a table of elements with their successors.  In each round every
element draws a coin from a hash of its number and the round; an element whose
coin is 1 and whose predecessor's is 0 leaves the list (no two neighbours leave
together): its predecessor takes over its successor and its weight.  About a
quarter leaves in a round, so all rounds together move a few times the list.
What is left of at most ``CORE`` elements is ranked in one task; the elements
that left are put back in reverse order, each behind its predecessor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm import scan

CORE = 1 << 14


def _walk(batches):
    """Ranks of a short list: pointer jumping towards the end on arrays."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    ids = t.column("id").to_numpy()
    order = np.argsort(ids)
    ids, weight = ids[order], t.column("weight").to_numpy()[order]
    nxt = t.column("next").fill_null(-1).to_numpy()[order]
    to = np.where(nxt < 0, len(ids), np.searchsorted(ids, nxt))
    to, rest = np.append(to, len(ids)), np.append(weight, 0)  # rest: weight from the element to where it points
    while (to < len(ids)).any():
        rest = rest + np.where(to < len(ids), rest[to], 0)
        to = to[to]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(rest[: len(ids)].max() - rest[: len(ids)])], ["id", "rank"])


def rank(links: DataFrame, core: int = CORE) -> DataFrame:
    """``id, rank`` (from 0) of every element of ``id, next``, one list that ends where ``next`` is null."""
    now = scan.written(links.select("id", "next", F.lit(1).cast("long").alias("weight")), "list")
    gone, turn = [], 0
    while now.count() > core:
        coin = lambda c: F.xxhash64(c, F.lit(turn)).bitwiseAND(F.lit(1))  # noqa: B023, E731
        leaves = (coin(F.col("next")) == 1) & (coin(F.col("id")) == 0)
        out = now.where(leaves).select("id", F.col("next").alias("out"), F.col("weight").alias("behind"))
        # an element with coin 1 leaves if its predecessor's coin is 0; the first element and those behind a 1 stay
        left = scan.written(out.join(now.select(F.col("id").alias("out"), F.col("next").alias("then"), F.col("weight").alias("more")), "out"), "list-left")
        gone.append(left.select(F.col("out").alias("id"), F.col("id").alias("after"), "behind"))
        ones = now.where(coin(F.col("id")) == 1).join(left.select(F.col("out").alias("id")), "id", "left_anti")
        taken = left.select("id", "then", "more")
        zeros = now.where(coin(F.col("id")) == 0).join(taken, "id", "left").select(
            "id", F.when(F.col("more").isNotNull(), F.col("then")).otherwise(F.col("next")).alias("next"), (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight"))
        now = scan.written(zeros.unionByName(ones), "list")
        turn += 1
    ranks = now.repartition(1).mapInArrow(_walk, "id long, rank long")
    for left in reversed(gone):
        ranks = scan.written(ranks, "ranks")
        ranks = ranks.unionByName(left.join(ranks.withColumnRenamed("id", "after"), "after").select("id", (F.col("rank") + F.col("behind")).alias("rank")))
    return ranks

"""Connected components of a link table by hooking and pointer jumping.

Every round hooks each node to its smallest neighbour, follows those
pointers to their ends, and replaces the links by links between the ends.
At least half of the nodes that still have links vanish in a round, so the
number of rounds is logarithmic, and only minima by node are aggregated: a
node with a third of all links is combined before any exchange.  Each step
is a table in the folder that the cluster shares: a checkpointed frame would
hand on the planner's estimate of its size, which every join of a loop
squares until the number no longer fits.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.session import discard, ensure_checkpoint_dir, scratch_path


def saved(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of a link; the root is the smallest node reachable.

    Links may repeat, run either way, or join a node to itself; nulls are ignored.
    """
    spark, made = links.sparkSession, []

    def table(df: DataFrame) -> DataFrame:
        made.append(scratch_path(spark, f"components-{uuid.uuid4().hex}"))
        df.write.parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    def drop_others(*kept: str) -> None:
        for path in [p for p in made if p not in kept]:
            discard(spark, path)
        made[:] = kept

    pairs = table(_clean(links.select(F.col(a).alias("a"), F.col(b).alias("b"))))
    found = found_at = None
    while not pairs.isEmpty():
        both = pairs.union(pairs.select("b", "a"))
        hook = table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
                     .select("node", F.least("node", "up").alias("up")))
        while True:
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = table(hook.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            hook = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        if found is None:
            found = hook.select("node", F.col("up").alias("root"))
        else:
            step = hook.select(F.col("node").alias("root"), F.col("up").alias("top"))
            found = table(found.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        found_at = made[-1]
        for side in ("a", "b"):
            to = hook.select(F.col("node").alias(side), F.col("up").alias("to"))
            pairs = pairs.join(to, side).select(*[F.col("to").alias(c) if c == side else F.col(c) for c in ("a", "b")])
        pairs = table(_clean(pairs))
        drop_others(found_at, made[-1])
    if found is None:
        drop_others()
        return links.select(F.col(a).alias("node"), F.col(a).alias("root")).where("false")
    out = saved(found)
    drop_others()
    return out


def _clean(pairs: DataFrame) -> DataFrame:
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def spanning(near):
    """Pairs that connect just what a boolean link matrix connects, as ((side, indices), (side, indices)).

    Side 0 are the matrix's rows, side 1 its columns.  Every column is paired
    with its first row; rows that share a column are paired over that column's
    first row.
    """
    some = np.flatnonzero(near.any(axis=0))
    first = near[:, some].argmax(axis=0)
    yield (0, first), (1, some)
    for f in np.unique(first):
        peers = np.flatnonzero(near[:, some[first == f]].any(axis=1))
        yield (0, np.full(len(peers), f)), (0, peers)

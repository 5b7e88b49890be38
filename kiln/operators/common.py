"""Keyed row choice and batching: W1, W2, W3, W4, U1.

First-wins and latest-per-key are aggregates (``min``/``max`` of a struct
that leads with the ordering columns), not ``row_number`` windows: the
aggregate combines on every map task before the shuffle, so a key that
holds a third of all rows still moves one row per task, not all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(x) -> list:
    return [x] if isinstance(x, (str, Column)) else list(x)


def _pick(df: DataFrame, keys, order, agg) -> DataFrame:
    keys, order = _cols(keys), _cols(order)
    key_names = [k for k in keys if isinstance(k, str)]
    order_names = [o for o in order if isinstance(o, str) and o not in key_names]
    rest = [c for c in df.columns if c not in key_names and c not in order_names]
    packed = F.struct(*[F.col(o).alias(f"__o{i}") for i, o in enumerate(order_names)],
                      *[F.col(c) for c in rest])
    out = df.groupBy(*keys).agg(agg(packed).alias("__w"))
    sel = [F.col(k) for k in key_names] + \
          [F.col(f"__w.__o{i}").alias(o) for i, o in enumerate(order_names)] + \
          [F.col(f"__w.{c}").alias(c) for c in rest]
    return out.select(*sel).select(*df.columns)


# W1 -------------------------------------------------------------------------
def first_wins(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the one first in ``order`` (ties broken by the other columns)."""
    return _pick(df, keys, order, F.min)


# W3 -------------------------------------------------------------------------
def latest(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the newest by ``order``."""
    return _pick(df, keys, order, F.max)


# W2 -------------------------------------------------------------------------
def assign_batch(df: DataFrame, size: int, by, order, out: str = "batch_no") -> DataFrame:
    """``batch_no = floor((row_number - 1) / size)`` within each group ``by``.

    The window is partitioned by the group (a project, or project and layer);
    batching inside one group needs the group's order, the same as the rule.
    """
    w = Window.partitionBy(*_cols(by)).orderBy(*_cols(order))
    return df.withColumn(out, F.floor((F.row_number().over(w) - 1) / F.lit(size)).cast("int"))


# U1 -------------------------------------------------------------------------
def union_batches(*dfs: DataFrame) -> DataFrame:
    """Union of batch outputs whose columns drift: missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def assign_batch_two_level(df: DataFrame, size: int, by, sub: str, order,
                           out: str = "batch_no") -> DataFrame:
    """W2 without one task per group: rows are numbered inside (group, sub)
    partitions, offset by a running count over the group's sub-groups (one
    summary row per sub-group).  Same result as ``assign_batch`` when
    ``order`` starts with ``sub``."""
    by = _cols(by)
    counts = df.groupBy(*by, sub).agg(F.count(F.lit(1)).alias("__n"))
    w_sub = Window.partitionBy(*by).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*by, sub, F.coalesce(F.sum("__n").over(w_sub), F.lit(0)).alias("__off"))
    w_in = Window.partitionBy(*by, sub).orderBy(*_cols(order))
    out_col = out
    keys = [*by, sub]
    offs = offs.withColumnsRenamed({c: f"__k{i}" for i, c in enumerate(keys)})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)])
    out = df.withColumn("__rn", F.row_number().over(w_in)).join(offs, same).drop(*[f"__k{i}" for i in range(len(keys))])
    return (out.withColumn(out_col, F.floor((F.col("__off") + F.col("__rn") - 1) / F.lit(size)).cast("int"))
            .drop("__rn", "__off"))

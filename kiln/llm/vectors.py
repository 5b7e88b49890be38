"""Vectors as blocks of rows: what the search and the near-duplicate join share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``vec_id, v`` (array of double) of the rows whose id is not null and whose vector has only finite components."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)


def matrix(column, width: int | None = None) -> np.ndarray:
    """An Arrow column of lists as a matrix of doubles, padded with zeros to ``width``."""
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(n.max(initial=0)) if width is None else width
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out

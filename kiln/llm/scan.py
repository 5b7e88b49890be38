"""Order over whole tables: sorted layouts, numbers and running sums that no single task computes.

``ordered`` deals rows into ranges of the sort key, so a segment with a third
of all rows lies in many tasks; positions and sums are counted inside a range
and the ranges before it are added from one row per (range, segment).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.components import saved
from kiln.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared checkpoint folder, read back (for wide or many rows)."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered(df: DataFrame, *keys: str | Column) -> DataFrame:
    """The rows range-partitioned and sorted by the keys, kept as a table, with ``range_no`` and the row's place ``at`` in the
    table's order.

    Rows equal in all keys stay in one range: add a key that tells them apart where they may be many.
    """
    out = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(out.withColumn("range_no", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ordered")


def _before(rows: DataFrame, segment: list[str], sums: dict[str, Column]) -> DataFrame:
    """Per (range, segment): each sum over the segment's ranges before it."""
    parts = rows.groupBy(*segment, "range_no").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    w = Window.partitionBy(*segment).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    return saved(parts.select(*segment, "range_no", *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(f"{k}_before") for k in sums]))


def running(rows: DataFrame, segment: list[str], sums: dict[str, Column]) -> DataFrame:
    """``ordered`` rows with each sum over the rows of their segment up to and with themselves; the table is one segment
    if none is named.  Segments must be prefixes of the order."""
    seg = segment or ["_all"]
    rows = rows if segment else rows.withColumn("_all", F.lit(0))
    inside = Window.partitionBy(*seg, "range_no").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = rows.withColumns({k: F.sum(v).over(inside) for k, v in sums.items()})
    out = here.join(_before(rows, seg, sums), [*seg, "range_no"]).withColumns({k: F.col(k) + F.col(f"{k}_before") for k in sums})
    return out.drop(*[f"{k}_before" for k in sums], *([] if segment else ["_all"]))


def following(rows: DataFrame, segment: list[str], value: Column, name: str) -> DataFrame:
    """``ordered`` rows with the value of the next row of their segment (null at its end)."""
    inside = Window.partitionBy(*segment, "range_no").orderBy("at")
    firsts = rows.groupBy(*segment, "range_no").agg(F.min_by(value, "at").alias("_first"))
    nexts = firsts.withColumn("_next", F.lead("_first").over(Window.partitionBy(*segment).orderBy("range_no"))).drop("_first")
    out = rows.withColumn(name, F.lead(value).over(inside)).withColumn("_last", F.lead("at").over(inside).isNull())
    out = out.join(saved(nexts), [*segment, "range_no"])
    return out.withColumn(name, F.when(F.col("_last"), F.col("_next")).otherwise(F.col(name))).drop("_last", "_next")

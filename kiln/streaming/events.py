"""Structured Streaming: ST1 event ingest, ST2 windowed refresh, ST3 micro-batch upsert.

Sources are file streams (new files in a folder are new events).  The caller
names the progress folder of a stream, on shared storage, so a restarted
driver or a lost executor resumes from the last committed batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.operators.common import latest
from kiln.session import saved
from kiln.sources import commits

# Refresh frequency -> window length.
FREQUENCIES = {"Hourly": "1 hour", "Daily": "1 day", "Weekly": "7 days"}


def read_events(spark: SparkSession, folder: str, schema, glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of event files in ``folder`` (``glob`` picks the files)."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(folder)


# ST1 ------------------------------------------------------------------------
def event_stream(sdf: DataFrame, ts: str = "ts", event_id: str = "event_id",
                 delay: str = "1 hour") -> DataFrame:
    """Append-only, time-ordered events: event time as a timestamp, a watermark,
    duplicates of an event id dropped while the watermark keeps them."""
    x = sdf.withColumn("__et", F.col(ts).cast("timestamp"))
    return (x.withWatermark("__et", delay).dropDuplicatesWithinWatermark([event_id])
            .withColumn("event_date", F.to_date("__et")))


# ST2 ------------------------------------------------------------------------
def windowed(sdf: DataFrame, frequency: str, latency_hours: int, by=("event_type",),
             ts: str = "ts", value: str = "value") -> DataFrame:
    """Tumbling-window counts and sums per refresh frequency; the latency
    tolerance (0-24 h) is the watermark delay, after which a window closes."""
    if not 0 <= latency_hours <= 24:
        raise ValueError("latency must be 0-24 hours")
    x = sdf.withColumn("__et", F.col(ts).cast("timestamp")).withWatermark("__et", f"{latency_hours} hours")
    g = x.groupBy(F.window("__et", FREQUENCIES[frequency]).alias("w"), *by)
    return g.agg(F.count(F.lit(1)).alias("n_events"),
                 F.sum(F.col(value).cast("decimal(18,2)")).cast("decimal(38,2)").alias("total_value"))


def run_to_files(sdf: DataFrame, out: str, checkpoint: str, mode: str = "append") -> str:
    """Run a stream over everything available now into Parquet files at ``out``.

    ``checkpoint`` names the stream's progress folder: a run with the same
    folder goes on after the last committed batch.
    """
    q = (sdf.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
         .option("path", out).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


# ST3 ------------------------------------------------------------------------
PART_ROWS = 1_000_000


def _prefix(h, bits):
    """The leading bits of a hash."""
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", h, (F.lit(64) - bits).cast("int")))


def _placed(rows: DataFrame, key: str, parts: list[dict]) -> DataFrame:
    """Rows with the part of the store that their key's hash lies in: ``__bits, __prefix``."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(p["bits"], p["prefix"]) for p in parts], "__bits int, __prefix long")
    tried = F.array(*[F.lit(b) for b in sorted({p["bits"] for p in parts})])
    rows = rows.withColumn("__h", F.xxhash64(key)).withColumn("__bits", F.explode(tried))
    return rows.withColumn("__prefix", _prefix(F.col("__h"), F.col("__bits"))).join(table, ["__bits", "__prefix"])


def upsert_parts(spark: SparkSession, base: str, rows: DataFrame, key: str, order: str, parts: int = 16, part_rows: int = PART_ROWS,
                 stream: str | None = None, batch: int | None = None) -> dict | None:
    """The newest row per key of ``rows`` and of the store at ``base``, as one commit.

    The store's commit lists its parts: ranges of key hashes (leading bits)
    with a folder and a row count each.  A new store starts with ``parts``,
    rounded up to a power of two.  One job reads and rewrites the parts that
    the rows touch; a part that would grow beyond ``part_rows`` is split.  The
    other parts keep their files.  Another writer's commit in between makes
    the change start again; a batch that the commit lists as merged is left
    alone; a store of another key raises.
    """
    new = saved(latest(rows, key, [order]))

    def make(now):
        if now and now["key"] != key:
            raise ValueError(f"{base} is a store by {now['key']}, not by {key}")
        if now and stream and now["streams"].get(stream, -1) >= batch:
            return None
        first = max(0, (parts - 1).bit_length())
        table = now["parts"] if now else [{"bits": first, "prefix": p, "path": None, "rows": 0} for p in range(1 << first)]
        at = {(p["bits"], p["prefix"]): p for p in table}
        touched = {(r["__bits"], r["__prefix"]): r["n"] for r in  # a row per part
                   _placed(new.select(key), key, table).groupBy("__bits", "__prefix").agg(F.count(F.lit(1)).alias("n")).collect()}
        body = {"key": key, "parts": [p for k, p in at.items() if k not in touched], "streams": {**(now["streams"] if now else {}), **({stream: batch} if stream else {})}}
        if not touched:
            return body
        goal = {k: k[0] + max(0, -(-(at[k]["rows"] + n) // part_rows) - 1).bit_length() for k, n in touched.items()}
        paths = [at[k]["path"] for k in touched if at[k]["path"]]
        both = spark.read.parquet(*paths).unionByName(new, allowMissingColumns=True) if paths else new
        goals = spark.createDataFrame([(*k, g) for k, g in goal.items()], "__bits int, __prefix long, __goal int")
        merged = _placed(latest(both, key, [order]), key, [at[k] for k in touched]).join(goals, ["__bits", "__prefix"])
        out = merged.withColumn("__prefix", _prefix(F.col("__h"), F.col("__goal"))).withColumn("__bits", F.col("__goal")).drop("__h", "__goal")
        folder = f"{base.rstrip('/')}/data_{uuid.uuid4().hex}"
        out.repartition("__bits", "__prefix").write.partitionBy("__bits", "__prefix").parquet(folder)
        kept = {(r["__bits"], r["__prefix"]): r["n"] for r in spark.read.parquet(folder).groupBy("__bits", "__prefix").agg(F.count(F.lit(1)).alias("n")).collect()}
        for (bits, prefix), g in goal.items():
            for p in range(prefix << (g - bits), (prefix + 1) << (g - bits)):
                n = kept.get((g, p), 0)
                body["parts"].append({"bits": g, "prefix": p, "path": f"{folder}/__bits={g}/__prefix={p}" if n else None, "rows": n})
        return body

    return commits.change(spark, base, make)


def upsert_stream(sdf: DataFrame, base: str, key: str, order: str, checkpoint: str, parts: int = 16, part_rows: int = PART_ROWS) -> str:
    """Each micro-batch: its newest row per key, merged into the store at ``base`` (see upsert_parts).

    A commit names the stream (its id in ``checkpoint``) and the batch that was
    merged, so a batch that was merged already is left alone; batches of
    another stream, or of a new ``checkpoint``, are merged.
    """
    spark = sdf.sparkSession

    def merge(rows: DataFrame, batch: int):
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not stream:
            raise RuntimeError("the stream has no id")
        upsert_parts(spark, base, rows, key, order, parts, part_rows, stream, batch)

    q = (sdf.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return base


def read_upserted(spark: SparkSession, base: str) -> DataFrame:
    """The rows of all parts of an upserted store, however many it has."""
    now = commits.state(spark, base)
    paths = [p["path"] for p in now["parts"] if p["path"]] if now else []
    if not paths:
        raise FileNotFoundError(base)
    return spark.read.parquet(*paths)

"""Project store and deployment log: S8, S9, B12, P1, O4.

The store is a Parquet dataset of snapshots.  An upsert never rewrites the
path being read: it writes the merged rows to a new snapshot folder, then
commits the folder's name (kiln.sources.commits).  A reader always finds a
whole snapshot; of several writers none loses another's rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.operators.common import latest
from kiln.sources import commits

PROJECT_COLUMNS = ["id", "created_at", "user_name", "requirements", "data_profile", "architecture",
                   "schema_design", "pipeline", "governance", "ddl_sql", "documentation",
                   "mermaid_diagram", "status", "metadata", "history"]
JSON_COLUMNS = ["requirements", "data_profile", "architecture", "schema_design", "pipeline",
                "governance", "metadata", "history"]
LOG_SCHEMA = ("id string, project_id string, deployed_at timestamp_ntz, target_db string, "
              "target_schema string, statements_run long, statements_skipped long, status string, errors string")


# B12 ------------------------------------------------------------------------
def upsert_snapshot(old: DataFrame, new: DataFrame, key, order: str, created: str | None = None) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key, whatever their dates.

    Among new rows of one key the newest by ``order`` wins.  An update keeps
    the old row's ``created`` column (the time of the first save).
    """
    o = old.withColumn("__prio", F.lit(0))
    n = new.withColumn("__prio", F.lit(1))
    both = o.unionByName(n, allowMissingColumns=True)
    out = latest(both, key, ["__prio", order]).drop("__prio")
    if created is None:
        return out
    keys = [key] if isinstance(key, str) else list(key)
    first = old.groupBy(*keys).agg(F.min(created).alias("__first"))
    return out.join(first, keys, "left").withColumn(created, F.coalesce("__first", created)).select(*out.columns)


def _snapshot(df: DataFrame, base: str, version: int) -> str:
    path = f"{base.rstrip('/')}/snapshot_{version:016d}_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def _merged(now: dict | None, stream: str | None, batch: int | None) -> dict:
    """The batches that the store holds of each stream, with this one."""
    return {**(now or {}).get("streams", {}), **({stream: batch} if stream else {})}


def write_snapshot(df: DataFrame, base: str, version: int | None = None, stream: str | None = None, batch: int | None = None) -> str:
    """Write ``df`` as a new snapshot under ``base`` and commit it, whatever the store held.

    With a version it becomes that one, or commits.Taken is raised.  The
    commit also names the stream's batch that was merged.
    """
    spark = df.sparkSession
    path = _snapshot(df, base, version or 0)
    make = lambda now: {"path": path, "streams": _merged(now, stream, batch)}
    if version is None:
        commits.change(spark, base, make)
    else:
        commits.commit(spark, base, version, make(commits.state(spark, base)))
    return path


def upsert_store(spark: SparkSession, base: str, new: DataFrame, key, order: str, created: str | None = None) -> str:
    """B12 on a kept store: ``new`` merged into its newest snapshot (see upsert_snapshot); safe beside other writers."""
    def make(now):
        old = spark.read.parquet(now["path"]) if now else new.limit(0)
        return {"path": _snapshot(upsert_snapshot(old, new, key, order, created), base, (now["version"] if now else 0) + 1), "streams": _merged(now, None, None)}
    return commits.change(spark, base, make)["path"]


def current(spark: SparkSession, base: str) -> tuple[int, str] | None:
    """(version, path) of the current snapshot; None only if nothing was ever committed."""
    now = commits.state(spark, base)
    return (now["version"], now["path"]) if now else None


def merged_batch(spark: SparkSession, base: str, stream: str) -> int:
    """The last batch of ``stream`` that was merged into the store; -1 if none was."""
    return ((commits.state(spark, base) or {}).get("streams") or {}).get(stream, -1)


def read_store(spark: SparkSession, base: str) -> DataFrame:
    at = current(spark, base)
    if at is None:
        raise FileNotFoundError(base)
    return spark.read.parquet(at[1])


# P1 -------------------------------------------------------------------------
def get_project(store: DataFrame, project_id: str) -> DataFrame:
    """One project by id; JSON columns parsed, bad JSON -> {} (returned as normalised JSON text)."""
    out = store.filter(F.col("id") == project_id)
    for c in JSON_COLUMNS:
        if c in out.columns:
            v = F.coalesce(F.try_parse_json(F.col(c)), F.parse_json(F.lit("{}")))
            out = out.withColumn(c, F.to_json(v))
    return out


# S8 -------------------------------------------------------------------------
def typed_store(store: DataFrame) -> DataFrame:
    """The store with its JSON columns as VARIANT, the form they are kept in; text that is no JSON becomes {}."""
    return store.withColumns({c: F.coalesce(F.try_parse_json(F.col(c)), F.parse_json(F.lit("{}")))
                              for c in JSON_COLUMNS if c in store.columns})


# O4 -------------------------------------------------------------------------
def list_projects(store: DataFrame) -> DataFrame:
    """Newest projects first (a distributed range-partitioned sort)."""
    return store.select("id", "created_at", "user_name", "status").orderBy(F.col("created_at").desc(), "id")


# S9 -------------------------------------------------------------------------
def log_runs(runs: DataFrame, path: str) -> None:
    """Append any number of runs to the log at ``path``, in one job; ids and times are given where they lack.

    A run of a status other than success or failed ends the job.
    """
    wanted = ["project_id", "target_db", "target_schema", "statements_run", "statements_skipped", "status", "errors"]
    kinds = {"statements_run": "long", "statements_skipped": "long"}
    given = {c: F.col(c) if c in runs.columns else F.lit(0 if c in kinds else None) for c in wanted}
    checked = F.when(given["status"].isin("success", "failed"), given["status"]).otherwise(F.raise_error(F.lit("status must be success or failed")))
    has = lambda c, default: F.coalesce(F.col(c), default) if c in runs.columns else default
    rows = runs.select(has("id", F.uuid()).alias("id"), given["project_id"].cast("string").alias("project_id"), has("deployed_at", F.localtimestamp()).alias("deployed_at"),
                       *[(checked if c == "status" else v.cast(kinds.get(c, "string"))).alias(c) for c, v in given.items() if c != "project_id"])
    rows.write.mode("append").parquet(path)


def log_run(spark: SparkSession, path: str, project_id: str, target_db: str, target_schema: str,
            statements_run: int, statements_skipped: int, status: str, errors: str | None = None) -> DataFrame:
    """Append one deployment row to the log dataset at ``path``."""
    if status not in ("success", "failed"):
        raise ValueError("status must be success or failed")
    row = spark.sql("SELECT uuid() AS id, localtimestamp() AS deployed_at").first()
    df = spark.createDataFrame([(row["id"], project_id, row["deployed_at"], target_db, target_schema,
                                 int(statements_run), int(statements_skipped), status, errors)], LOG_SCHEMA)
    df.write.mode("append").parquet(path)
    return df

"""Deployment: B13 materialise layers, O3 load order, A9 audit, J7 only-new work."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kiln.functions import content_hash, is_identifier, layer_to_schema_name, load_rank
from kiln.sources import commits
from kiln.sources.store import log_run


# O3 / B13 plan ----------------------------------------------------------------
def deploy_plan(assigned: DataFrame, key: str = "project_id") -> DataFrame:
    """Per project: one schema per populated layer, tables in load order
    (dimensions first, facts last, then by name), statement number, and
    whether the names pass the identifier guard."""
    t = assigned.select(key, "schema_name", "table_name").withColumn("load_rank", load_rank("table_name"))
    # one sort numbers a project's tables and finds the copies: a row that is not the first of its equals has a larger number than rank
    w = Window.partitionBy(key).orderBy("load_rank", "table_name", "schema_name")
    numbered = t.select("*", F.dense_rank().over(w).cast("long").alias("statement_no"), F.rank().over(w).alias("__rank"), F.row_number().over(w).alias("__n"))
    return numbered.filter(F.col("__rank") == F.col("__n")).select(
        *t.columns, "statement_no", (is_identifier("table_name") & is_identifier("schema_name")).alias("valid_name"))


# B13 ------------------------------------------------------------------------
# Error classes that mean that a source object does not exist.
MISSING = {"TABLE_OR_VIEW_NOT_FOUND", "PATH_NOT_FOUND", "SCHEMA_NOT_FOUND"}


def materialise(spark: SparkSession, tables: dict, layers: dict, database: str,
                log_path: str | None = None, project_id: str = "N/A", location: str | None = None,
                journal: str | None = None, run_id: str = "run") -> DataFrame:
    """Write each layer's tables as ``<database>_<SCHEMA>.<table>`` in load order.

    ``tables`` maps table name -> DataFrame or function giving one; ``layers``
    maps table name -> layer label.  A table whose source object does not
    exist (None, or an error of a MISSING class) is counted as skipped; any
    other error ends the run as failed, is logged whole and raised.  With
    ``location`` the tables are external, under ``location/<schema>/<table>``.
    One log row per run, with the schemas written to.

    With ``journal`` every table is noted there when it is started and when it
    is done, as commits.  A run of the same ``run_id`` that follows a broken one
    goes on behind the last table done; a table that was started only is
    written again.  Tables done before count as run.
    """
    before = _noted(spark, journal, run_id) if journal else {}
    names = spark.createDataFrame([(n, layers.get(n) or "") for n in tables], "name string, label string")
    plan = names.select("name", layer_to_schema_name("label").alias("schema"), load_rank("name").alias("rank"),
                        (is_identifier("name") & is_identifier(F.concat(F.lit(database + "_"), layer_to_schema_name("label")))).alias("ok"))
    plan = plan.orderBy("rank", "name").collect()  # a row per table of one design
    run, skipped, failure, schemas = 0, 0, None, []
    try:
        for name, schema, _, ok in plan:
            db = f"{database}_{schema}".lower()
            if not ok:
                raise ValueError(f"invalid identifier {db}.{name}")
            spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}`")
            schemas.append(schema)
            step = f"{db}.{name}"
            if before.get(step) in ("done", "skipped"):
                done = before[step] == "done"
            else:
                if journal:
                    _note(spark, journal, run_id, step, "started")
                done = _written(spark, tables[name], db, name, location, again=before.get(step) == "started")
                if journal:
                    _note(spark, journal, run_id, step, "done" if done else "skipped")
            run, skipped = run + done, skipped + (not done)
    except Exception as e:
        failure = e  # logged as failed, then raised
    log = (log_run(spark, log_path, project_id, database, ",".join(sorted(set(schemas))), run, skipped,
                   "failed" if failure else "success", f"{type(failure).__name__}: {failure}" if failure else None)
           if log_path else None)
    if failure:
        raise failure
    return log


def _noted(spark: SparkSession, journal: str, run_id: str) -> dict:
    """What the journal says of a run's tables: started, done or skipped."""
    return (commits.state(spark, journal) or {}).get("runs", {}).get(run_id, {})


def _note(spark: SparkSession, journal: str, run_id: str, step: str, what: str) -> None:
    def make(now):
        runs = dict((now or {}).get("runs", {}))
        runs[run_id] = {**runs.get(run_id, {}), step: what}
        return {"runs": runs}
    commits.change(spark, journal, make)


def _written(spark: SparkSession, source, db: str, name: str, location: str | None, again: bool = False) -> bool:
    """Write one table unless it is there; False if its source object does not exist.  ``again``: over what a broken run left."""
    try:
        df = source() if callable(source) else source
        if df is None:
            return False
        if not spark.catalog.tableExists(f"{db}.{name}"):
            w = df.write.option("path", f"{location.rstrip('/')}/{db}/{name}") if location else df.write
            if again:
                w = w.mode("overwrite")
            w.saveAsTable(f"`{db}`.`{name}`")
        return True
    except AnalysisException as e:
        if (e.getCondition() or "").split(".")[0] in MISSING:
            return False
        raise


# A9 -------------------------------------------------------------------------
def audit(log: DataFrame) -> DataFrame:
    """Runs, statements and failures per project, target and status."""
    return (log.groupBy("project_id", "target_db", "target_schema", "status")
            .agg(F.count(F.lit(1)).alias("runs"), F.sum("statements_run").cast("long").alias("statements"),
                 F.count_if(F.col("status") == "failed").alias("failures")))


# J7 -------------------------------------------------------------------------
def only_new(items: DataFrame, done: DataFrame, step: str, model: str, prompt: str) -> DataFrame:
    """Items whose content hash (md5 of step, model, prompt) is not in ``done.hash``."""
    h = items.withColumn("hash", content_hash(step, model, prompt))
    return h.join(done.select("hash").distinct(), "hash", "left_anti")

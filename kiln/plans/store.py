"""Store and deployment plans: B12, S8, P1, O4, S9/A9, J7, B13/O3."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kiln.functions import content_hash, day_string, iso_day, or_now, sql_content_hash, sql_is_identifier, sql_load_rank, to_json_text
from kiln.operators import deploy as D
from kiln.operators import model as M
from kiln.operators.common import latest
from kiln.plans.fleet import spark_fleet
from kiln.session import scratch_path
from kiln.sources import store as S
from kiln.sources.tables import load

CUTOVER = "2000-01-01 00:00:00"
STEP, MODEL = "schema", "wh-model"


def _saves(spark, sf):
    """One project save per order: the customer is the project."""
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    req = F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"),
                 F.concat(F.lit('{"priority": "'), F.col("o_orderpriority"))) \
        .otherwise(F.concat(F.lit('{"priority":"'), F.col("o_orderpriority"), F.lit('","segment":"'),
                            F.col("c_mktsegment"), F.lit('"}')))
    status = F.when(F.col("o_orderstatus") == "F", "deployed").when(F.col("o_orderstatus") == "O", "draft") \
        .otherwise("in_review")
    return (o.join(c, F.col("o_custkey") == F.col("c_custkey"))
            .select(F.md5(F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderdate").alias("created_at"),
                    F.col("c_name").alias("user_name"), req.alias("requirements"), status.alias("status")))


def project_store_upsert(spark, sf):
    s = _saves(spark, sf)
    # stored: saves before the cut-over; updates: the later ones and some of older date
    late = (F.col("created_at") >= F.lit(CUTOVER).cast("timestamp_ntz")) | F.col("requirements").contains("1-URGENT")
    old = latest(s.filter(~late), "id", ["created_at"])
    return S.upsert_snapshot(old, s.filter(late), "id", "created_at", created="created_at")


def project_lookup(spark, sf):
    return S.get_project(project_store_upsert(spark, sf), _lookup_id())


def project_requirements(spark, sf):
    """Fields of the requirements, read from their VARIANT form."""
    t = S.typed_store(project_store_upsert(spark, sf))
    return t.select("id", F.try_variant_get("requirements", "$.priority", "string").alias("priority"),
                    F.try_variant_get("requirements", "$.segment", "string").alias("segment"))


def _lookup_id():
    import hashlib
    return hashlib.md5(b"0").hexdigest()


def projects_newest_first(spark, sf):
    return S.list_projects(project_store_upsert(spark, sf))


def _runs(spark, sf):
    o, li = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    c, n = load(spark, sf, "customer"), load(spark, sf, "nation")
    stmts = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("statements_run"))
    return (o.join(stmts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.md5(F.col("o_custkey").cast("string")).alias("project_id"),
                    F.concat(F.lit("DWH_"), F.col("n_name")).alias("target_db"),
                    F.substring("o_orderpriority", 3, 100).alias("target_schema"),
                    F.coalesce("statements_run", F.lit(0)).cast("long").alias("statements_run"),
                    F.when(F.col("o_orderstatus") == "P", "failed").otherwise("success").alias("status")))


def project_documents(spark, sf):
    """Projects as they are written (F16, F17): JSON text with ISO times, read back; a save without a time is dated now."""
    o = load(spark, sf, "orders")
    made = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate"))
    doc = to_json_text(F.struct(F.col("o_orderdate").alias("saved"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("status"),
                                F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("note")))
    return o.select(F.col("o_orderkey").alias("id"), day_string("o_orderdate").alias("day"), F.when(made.isNotNull(), iso_day(or_now(made))).alias("created_day"),
                    (or_now(made) > F.lit("2020-01-01").cast("timestamp_ntz")).alias("made_now"),
                    F.get_json_object(doc, "$.saved").alias("saved"), F.get_json_object(doc, "$.day").alias("json_day"), F.contains(doc, F.lit('"note":null')).alias("no_note"))


def deploy_audit(spark, sf):
    return D.audit(_runs(spark, sf))


def deploy_log_audited(spark, sf):
    """The runs appended to a log in two jobs, then audited from it."""
    path = scratch_path(spark, f"deploy-log-{uuid.uuid4().hex}")
    runs = _runs(spark, sf)
    for part in (F.col("status") == "failed", F.col("status") != "failed"):
        S.log_runs(runs.filter(part), path)
    return D.audit(spark.read.parquet(path))


def only_new_work(spark, sf):
    t = spark_fleet(spark, sf)["tables"].select(
        "project_id", "seq", "table_name", "layer", "batch_status",
        F.lit(STEP).alias("step"), F.lit(MODEL).alias("model"),
        F.concat_ws("|", F.col("project_id").cast("string"), "table_name", "layer").alias("prompt"))
    done = t.filter(F.col("batch_status") == "F").select(content_hash("step", "model", "prompt").alias("hash"))
    return D.only_new(t, done, "step", "model", "prompt").select("project_id", "seq", "table_name", "hash")


def deploy_plan(spark, sf):
    f = spark_fleet(spark, sf)
    return D.deploy_plan(M.assign_layers(f["tables"], f["layers"]))


# ---- oracles ----------------------------------------------------------------
_SAVES = """
saves AS (SELECT md5(CAST(o_custkey AS VARCHAR)) AS id, o_orderdate AS created_at, c_name AS user_name,
   CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN '{"priority": "' || o_orderpriority
        ELSE '{"priority":"' || o_orderpriority || '","segment":"' || c_mktsegment || '"}' END AS requirements,
   CASE WHEN o_orderstatus = 'F' THEN 'deployed' WHEN o_orderstatus = 'O' THEN 'draft' ELSE 'in_review' END AS status
   FROM orders JOIN customer ON o_custkey = c_custkey),
old AS (SELECT id, created_at, user_name, requirements, status, 0 AS prio FROM (
   SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC, user_name DESC, requirements DESC,
                                status DESC) AS rn
   FROM saves WHERE NOT (created_at >= TIMESTAMP '2000-01-01 00:00:00' OR contains(requirements, '1-URGENT'))) WHERE rn = 1),
new AS (SELECT id, created_at, user_name, requirements, status, 1 AS prio FROM saves
        WHERE created_at >= TIMESTAMP '2000-01-01 00:00:00' OR contains(requirements, '1-URGENT')),
store AS (SELECT u.id, coalesce(old.created_at, u.created_at) AS created_at, u.user_name, u.requirements, u.status FROM (
   SELECT *, row_number() OVER (PARTITION BY id ORDER BY prio DESC, created_at DESC, user_name DESC,
                                requirements DESC, status DESC) AS rn
   FROM (SELECT * FROM old UNION ALL SELECT * FROM new)) u LEFT JOIN old ON old.id = u.id WHERE rn = 1)"""


def _deploy_plan_sql():
    from kiln.plans.design import _ASSIGN, _with
    return _with(_ASSIGN, f"""
DP AS (SELECT DISTINCT project_id, schema_name, table_name FROM ASSIGNED)""") + f"""
SELECT project_id, schema_name, table_name, {sql_load_rank('table_name')} AS load_rank,
       row_number() OVER (PARTITION BY project_id ORDER BY {sql_load_rank('table_name')}, table_name, schema_name)
         AS statement_no,
       {sql_is_identifier('table_name')} AND {sql_is_identifier('schema_name')} AS valid_name
FROM DP"""


def _only_new_sql():
    from kiln.plans.fleet import duck_ctes
    h = sql_content_hash(f"'{STEP}'", f"'{MODEL}'", "concat_ws('|', CAST(project_id AS VARCHAR), table_name, layer)")
    return duck_ctes() + f""",
T AS (SELECT project_id, seq, table_name, batch_status, {h} AS hash FROM f_tables)
SELECT project_id, seq, table_name, hash FROM T
WHERE hash NOT IN (SELECT hash FROM T WHERE batch_status = 'F')"""


ORACLES = {
    "project_store_upsert": f"WITH {_SAVES} SELECT * FROM store",
    "project_lookup": f"""WITH {_SAVES} SELECT id, created_at, user_name,
       CASE WHEN json_valid(requirements) THEN CAST(json(requirements) AS VARCHAR) ELSE '{{}}' END AS requirements,
       status FROM store WHERE id = '{_lookup_id()}'""",
    "project_requirements": f"""WITH {_SAVES} SELECT id,
       CASE WHEN json_valid(requirements) THEN requirements->>'$.priority' END AS priority,
       CASE WHEN json_valid(requirements) THEN requirements->>'$.segment' END AS segment FROM store""",
    "projects_newest_first": f"WITH {_SAVES} SELECT id, created_at, user_name, status FROM store",
    "project_documents": """
SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderpriority <> '5-LOW' THEN strftime(o_orderdate, '%Y-%m-%d') END AS created_day,
       o_orderpriority = '5-LOW' OR o_orderdate > TIMESTAMP '2020-01-01' AS made_now, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS saved,
       strftime(o_orderdate, '%Y-%m-%d') AS json_day, o_orderstatus = 'P' AS no_note FROM orders""",
    "deploy_audit": """
WITH st AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
runs AS (SELECT md5(CAST(o_custkey AS VARCHAR)) AS project_id, 'DWH_' || n_name AS target_db,
                substr(o_orderpriority, 3, 100) AS target_schema, coalesce(n, 0) AS statements_run,
                CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'success' END AS status
         FROM orders LEFT JOIN st ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey
         JOIN nation ON c_nationkey = n_nationkey)
SELECT project_id, target_db, target_schema, status, count(*) AS runs, CAST(sum(statements_run) AS BIGINT) AS statements,
       count(*) FILTER (WHERE status = 'failed') AS failures
FROM runs GROUP BY project_id, target_db, target_schema, status""",
    "only_new_work": _only_new_sql(),
    "deploy_plan": _deploy_plan_sql(),
}

ORACLES["deploy_log_audited"] = ORACLES["deploy_audit"]

QUERIES = {
    "project_requirements": project_requirements,
    "project_store_upsert": project_store_upsert,
    "project_lookup": project_lookup,
    "projects_newest_first": projects_newest_first,
    "project_documents": project_documents,
    "deploy_audit": deploy_audit,
    "deploy_log_audited": deploy_log_audited,
    "only_new_work": only_new_work,
    "deploy_plan": deploy_plan,
}

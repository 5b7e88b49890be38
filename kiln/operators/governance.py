"""Governance: G2 masking, G3 row filter, G4 sovereignty, G5 retention,
G7/J5 lineage closure, G8 PII exposure.

Masks and filters come from metadata tables and are applied lazily to the
data; the data itself never reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions import compare_key
from kiln.operators import graph

# Sovereignty choice -> regions whose nations it keeps.
SOVEREIGNTY_REGIONS = {"US": ["AMERICA"], "EU": ["EUROPE"], "Other": ["AFRICA", "ASIA", "MIDDLE EAST"]}
# Retention depth choices.
RETENTION = {"6 months": "6 MONTHS", "1 year": "1 YEAR", "3 years": "3 YEARS", "Unlimited": None}


def mask_expr(c: Column, mask_type: str) -> Column:
    """The masked value of ``c`` for one mask type."""
    t = (mask_type or "").lower()
    s = c.cast("string")
    if t in ("hash", "sha2", "sha256"):
        return F.sha2(s, 256)
    if t == "partial":
        return F.concat(F.regexp_replace(F.substring(s, 1, F.greatest(F.length(s) - 4, F.lit(0))), ".", "*"),
                        F.right(s, F.lit(4)))
    if t == "email":
        return F.regexp_replace(s, "^[^@]+", "*****")
    if t in ("null", "nullify"):
        return F.lit(None).cast("string")
    return F.lit("*****")


# G2 -------------------------------------------------------------------------
def mask(df: DataFrame, masks: DataFrame, role: str, table: str | None = None) -> DataFrame:
    """Apply ``masks(column_name, mask_type, exempt_role[, table_name])`` for ``role``.

    Names match whatever their case.  A policy is a column's mask of one type;
    the role escapes it only as one of that type's exempt roles.  Of several
    policies that hold for the role, the strictest applies: nothing, a constant, a hash, the last characters, the mail domain.  The
    policies are reduced in Spark to one row per column of ``df`` before they
    are read; a column that no policy masks keeps its type.
    """
    names = [c.lower() for c in df.columns]
    m = masks.select(F.lower(F.trim("column_name")).alias("c"), F.lower(F.coalesce("mask_type", F.lit(""))).alias("t"),
                     "exempt_role", *(["table_name"] if "table_name" in masks.columns else [])).filter(F.col("c").isin(names))
    if table is not None and "table_name" in masks.columns:
        m = m.filter(F.lower(F.trim("table_name")) == table.lower())
    exempt = F.coalesce(F.max(F.upper("exempt_role") == role.upper()), F.lit(False))
    kinds = m.groupBy("c", "t").agg(exempt.alias("exempt")).filter(~F.col("exempt"))
    order = F.when(F.col("t").isin("null", "nullify"), 0).when(F.col("t").isin("hash", "sha2", "sha256"), 2) \
        .when(F.col("t") == "partial", 3).when(F.col("t") == "email", 4).otherwise(1)
    strictest = kinds.groupBy("c").agg(F.min(F.struct(order.alias("o"), "t")).alias("w")).select("c", "w.t")
    policy = {r["c"]: r["t"] for r in strictest.collect()}  # at most one row per column of df
    return df.select(*[mask_expr(F.col(c), policy[c.lower()]).alias(c) if c.lower() in policy else F.col(c) for c in df.columns])


# G3 -------------------------------------------------------------------------
def row_filter(df: DataFrame, entitlements: DataFrame, role: str, key: str, ent_key: str = "key_value") -> DataFrame:
    """Rows whose ``key`` the role is entitled to (left-semi join with the entitlement table)."""
    e = entitlements.filter(F.col("role_name") == role).select(F.col(ent_key).alias("__k")).distinct()
    return df.join(e, df[key] == e["__k"], "left_semi")


# G4 -------------------------------------------------------------------------
def region_filter(df: DataFrame, nation_key: str, nation: DataFrame, region: DataFrame, sovereignty: str) -> DataFrame:
    """Rows of nations inside the chosen sovereignty ('None' keeps all)."""
    if sovereignty in (None, "None"):
        return df
    regions = SOVEREIGNTY_REGIONS[sovereignty]
    keep = (nation.join(region.filter(F.col("r_name").isin(regions)), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_nationkey").alias("__nk")))
    return df.join(keep, df[nation_key] == keep["__nk"], "left_semi")


# G5 -------------------------------------------------------------------------
def retain(df: DataFrame, ts: str, depth: str) -> DataFrame:
    """Rows no older than ``depth`` before the newest ``ts`` (a scalar subquery)."""
    interval = RETENTION[depth]
    if interval is None:
        return df
    spark = df.sparkSession
    return spark.sql(f"SELECT * FROM {{d}} WHERE `{ts}` >= (SELECT max(`{ts}`) FROM {{d}}) - INTERVAL {interval}", d=df)


def write_by_date(df: DataFrame, ts: str, path: str, unit: str = "day") -> str:
    """A table laid out by the day, month or year of ``ts`` (folders ``_date``)."""
    df.withColumn("_date", F.to_date(F.date_trunc(unit, F.col(ts)))).repartition("_date").write.partitionBy("_date").parquet(path)
    return path


def retain_by_date(spark, path: str, ts: str, depth: str, unit: str = "day") -> DataFrame:
    """G5 on a table laid out by date: rows no older than ``depth`` before the newest ``ts``.

    The newest folder comes from the folder names alone, the newest time from
    that folder's rows; both are scalar subqueries, so at run time the scan
    leaves out the folders of older dates.  Rows without a time are not retained.
    """
    rows = spark.read.parquet(path)
    interval = RETENTION[depth]
    if interval is None:
        return rows.drop("_date")
    oldest = f"(SELECT max(`{ts}`) - INTERVAL {interval} FROM {{d}} WHERE _date = (SELECT max(_date) FROM {{d}}))"
    return spark.sql(f"SELECT * EXCEPT (_date) FROM {{d}} WHERE _date >= to_date(date_trunc('{unit}', {oldest})) AND `{ts}` >= {oldest}", d=rows)


# G7 / J5 ----------------------------------------------------------------------
def lineage_paths(edges: DataFrame, group: str = "project_id") -> DataFrame:
    """Reachability closure ``(group, src, dst, depth)`` with the shortest depth, to the fixpoint (see graph.shortest_paths)."""
    return graph.shortest_paths(edges, group)


on_cycles = graph.on_cycles

# G8 -------------------------------------------------------------------------
def exposure(tags: DataFrame, table_grants: DataFrame, masks: DataFrame, keys=()) -> DataFrame:
    """PII-tagged columns a role can read in clear: it holds SELECT on the table
    and the column has no mask, or the role is the mask's exempt role.
    ``keys`` (e.g. ``project_id``) scope every join.  Tables meet by their
    compare key (F3) and columns by their lower-case name, in all three
    inputs; a grant on 'All' holds for every table."""
    k = list(keys)

    def keyed(df, *more):
        return df.select(*k, compare_key("table_name").alias("__t"), F.lower("column_name").alias("__c"), *more)

    pii = keyed(tags.filter(F.col("tag") == "PII"), "table_name", "column_name").groupBy(*k, "__t", "__c").agg(
        F.min("table_name").alias("table_name"), F.min("column_name").alias("column_name"))
    readers = table_grants.filter(F.upper("privilege") == "SELECT")
    # a column is looked up under its table and under all tables, in one join
    every, table = F.lit("*"), F.concat(F.lit("="), F.col("__t"))
    on_all = F.upper(F.trim("table_name")) == "ALL"
    readers = (readers.filter(on_all.isNotNull()).select(*k, F.when(on_all, every).otherwise(F.concat(F.lit("="), compare_key("table_name"))).alias("__at"), "role_name")
               .distinct())
    pii = pii.withColumn("__at", F.explode(F.array(table, every)))
    cand = pii.join(readers, [*k, "__at"]).select(*k, "__t", "__c", "table_name", "column_name", "role_name")
    # the roles that a column's masks exempt, without a row where it has none
    exempt = keyed(masks, "exempt_role").groupBy(*k, "__t", "__c").agg(F.collect_set("exempt_role").alias("__x"))
    reason = F.when(F.col("__x").isNull(), "no_mask").when(F.array_contains("__x", F.col("role_name")), "exempt_role")
    found = cand.join(exempt, [*k, "__t", "__c"], "left").withColumn("reason", reason)
    # a role that reads a column in both ways is dropped where the masks were met
    return found.filter(F.col("reason").isNotNull()).drop("__x").distinct().drop("__t", "__c")

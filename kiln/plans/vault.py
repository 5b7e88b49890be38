"""Data-vault plans: B7-B9, W5, J9 over customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.functions import money, sql_surrogate_key
from kiln.operators import vault as V
from kiln.sources.tables import load

T1, T2 = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
SAT_ATTRS = ["c_name", "c_mktsegment", "c_acctbal"]


def hub_customer(spark, sf):
    """Customers of both sources: the orders, and the customer table (loaded at T1)."""
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderdate").alias("at"), F.lit("orders").alias("src"))
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), F.lit(T1).cast("timestamp_ntz").alias("at"), F.lit("customer").alias("src"))
    return V.hub(o.unionByName(c), "customer", "custkey", "at", F.col("src"))


def link_order_customer(spark, sf):
    return V.link(load(spark, sf, "orders"), "order_customer",
                  [("order", "o_orderkey"), ("customer", "o_custkey")], "o_orderdate", "orders")


def sat_customer_priority(spark, sf):
    return V.satellite(load(spark, sf, "orders"), "customer", "o_custkey", ["o_orderpriority"],
                       "o_orderdate", "orders")


def _versions(spark, sf):
    c = load(spark, sf, "customer").withColumn("c_acctbal", money("c_acctbal"))
    v1 = c.withColumn("load_ts", F.lit(T1).cast("timestamp_ntz"))
    open_total = (load(spark, sf, "orders").filter(F.col("o_orderstatus") == "O")
                  .groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("open_total")))
    v2 = (c.join(open_total, c.c_custkey == open_total.o_custkey, "left")
          .select("c_custkey", "c_name", "c_nationkey",
                  (F.col("c_acctbal") - F.coalesce("open_total", F.lit(0))).cast("decimal(18,2)").alias("c_acctbal"),
                  "c_mktsegment")
          .withColumn("load_ts", F.lit(T2).cast("timestamp_ntz")))
    return v1, v2


def sat_customer_two_versions(spark, sf):
    v1, v2 = _versions(spark, sf)
    first = V.satellite(v1, "customer", "c_custkey", SAT_ATTRS, "load_ts", "customer_v1")
    return V.satellite(v2, "customer", "c_custkey", SAT_ATTRS, "load_ts", "customer_v2", existing=first)


def vault_current_customer(spark, sf):
    v1, v2 = _versions(spark, sf)
    first = V.satellite(v1, "customer", "c_custkey", SAT_ATTRS, "load_ts", "customer_v1")
    second = V.satellite(v2, "customer", "c_custkey", SAT_ATTRS, "load_ts", "customer_v2", existing=first)
    h = V.hub(v1, "customer", "c_custkey", "load_ts", "customer_v1")
    return V.vault_current(h, "customer_hk", [first.unionByName(second)])


def vault_current_order(spark, sf):
    """J9 with a link: customers' current rows beside the orders they are linked to."""
    v1, _ = _versions(spark, sf)
    sat = V.satellite(v1, "customer", "c_custkey", SAT_ATTRS, "load_ts", "customer_v1")
    h = V.hub(v1, "customer", "c_custkey", "load_ts", "customer_v1")
    return V.vault_current(h, "customer_hk", [sat], link_order_customer(spark, sf)).select("customer_hk", "c_custkey", "c_name", "order_hk")


# ---- oracles ----------------------------------------------------------------
_HK = sql_surrogate_key


def _hd(*cols):
    return _HK(*cols)


_V = f"""
v1 AS (SELECT c_custkey, c_name, c_mktsegment, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal,
              TIMESTAMP '{T1}' AS load_ts FROM customer),
ot AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS open_total FROM orders
       WHERE o_orderstatus = 'O' GROUP BY o_custkey),
v2 AS (SELECT c_custkey, c_name, c_mktsegment,
              CAST(CAST(c_acctbal AS DECIMAL(18,2)) - coalesce(open_total, 0) AS DECIMAL(18,2)) AS c_acctbal,
              TIMESTAMP '{T2}' AS load_ts FROM customer LEFT JOIN ot ON c_custkey = o_custkey),
s1 AS (SELECT {_HK('c_custkey')} AS customer_hk, load_ts, c_name, c_mktsegment, c_acctbal,
              {_hd(*SAT_ATTRS)} AS hashdiff, 'customer_v1' AS record_source FROM v1),
s2 AS (SELECT {_HK('v2.c_custkey')} AS customer_hk, v2.load_ts, v2.c_name, v2.c_mktsegment, v2.c_acctbal,
              {_hd('v2.c_name', 'v2.c_mktsegment', 'v2.c_acctbal')} AS hashdiff, 'customer_v2' AS record_source
       FROM v2 JOIN s1 ON s1.customer_hk = {_HK('v2.c_custkey')}
       WHERE s1.hashdiff <> {_hd('v2.c_name', 'v2.c_mktsegment', 'v2.c_acctbal')})"""

ORACLES = {
    "hub_customer": f"""SELECT {_HK('custkey')} AS customer_hk, custkey, load_ts, record_source FROM (
        SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY load_ts, record_source) AS rn FROM (
          SELECT o_custkey AS custkey, o_orderdate AS load_ts, 'orders' AS record_source FROM orders
          UNION ALL SELECT c_custkey, TIMESTAMP '{T1}', 'customer' FROM customer)) WHERE rn = 1""",
    "link_order_customer": f"""SELECT {_HK('o_orderkey', 'o_custkey')} AS order_customer_hk,
        {_HK('o_orderkey')} AS order_hk, {_HK('o_custkey')} AS customer_hk, min(o_orderdate) AS load_ts,
        'orders' AS record_source FROM orders GROUP BY o_orderkey, o_custkey""",
    "sat_customer_priority": f"""
WITH r AS (SELECT {_HK('o_custkey')} AS customer_hk, o_orderdate AS load_ts, o_orderpriority,
                  {_hd('o_orderpriority')} AS hashdiff FROM orders),
     l AS (SELECT *, lag(hashdiff) OVER (PARTITION BY customer_hk ORDER BY load_ts, hashdiff) AS prev FROM r)
SELECT customer_hk, load_ts, o_orderpriority, hashdiff, 'orders' AS record_source
FROM l WHERE prev IS NULL OR prev <> hashdiff""",
    "sat_customer_two_versions": f"WITH {_V} SELECT * FROM s2",
    "vault_current_customer": f"""WITH {_V},
s AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2),
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_hk
                       ORDER BY load_ts DESC, hashdiff DESC) AS rn FROM s) WHERE rn = 1)
SELECT h.customer_hk, h.c_custkey, h.load_ts, h.record_source, cur.load_ts AS load_ts_0,
       cur.c_name, cur.c_mktsegment, cur.c_acctbal, cur.hashdiff AS hashdiff_0
FROM (SELECT {_HK('c_custkey')} AS customer_hk, c_custkey, TIMESTAMP '{T1}' AS load_ts,
             'customer_v1' AS record_source FROM customer) h
LEFT JOIN cur ON h.customer_hk = cur.customer_hk""",
}

ORACLES["vault_current_order"] = f"""
SELECT {_HK('c_custkey')} AS customer_hk, c_custkey, c_name, CASE WHEN o_orderkey IS NOT NULL THEN {_HK('o_orderkey')} END AS order_hk
FROM customer LEFT JOIN (SELECT DISTINCT o_orderkey, o_custkey FROM orders) ON o_custkey = c_custkey"""

QUERIES = {
    "vault_current_order": vault_current_order,
    "hub_customer": hub_customer,
    "link_order_customer": link_order_customer,
    "sat_customer_priority": sat_customer_priority,
    "sat_customer_two_versions": sat_customer_two_versions,
    "vault_current_customer": vault_current_customer,
}

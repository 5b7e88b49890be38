"""Star / snowflake plans over the TPC-H-like fixtures: B1-B6, B10, B11, J1, J4, J8, A11, Q1."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.functions import money, sql_surrogate_key
from kiln.operators import warehouse as W
from kiln.sources.tables import load

LOAD_TS = "2024-01-01 00:00:00"


def _customer_flat(spark, sf):
    c, n, r = (load(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")


def bronze_orders(spark, sf):
    return W.bronze(load(spark, sf, "orders"), "orders", "b0001", LOAD_TS)


def silver_customer(spark, sf):
    return W.silver(load(spark, sf, "customer"), "c_custkey", ["c_custkey"],
                    casts={"c_acctbal": "decimal(18,2)"})


def dim_customer(spark, sf):
    return W.dimension(_customer_flat(spark, sf), "customer", "c_custkey",
                       ["c_name", "c_mktsegment", "n_name", "r_name"])


def fact_orders(spark, sf):
    o = load(spark, sf, "orders")
    dim = dim_customer(spark, sf)
    o = o.withColumn("order_date_key", W.date_key("o_orderdate"))
    return W.fact(o, [("o_custkey", dim, "c_custkey", "customer_sk")],
                  ["order_date_key", money("o_totalprice").alias("total_price")],
                  degenerate=["o_orderkey"])


def fact_lineitem(spark, sf):
    li = load(spark, sf, "lineitem")
    part, supp, orders = (load(spark, sf, t) for t in ("part", "supplier", "orders"))
    li = li.withColumn("ship_date_key", W.date_key("l_shipdate"))
    return W.fact(
        li,
        [("l_partkey", part, "p_partkey", "part_sk"),
         ("l_suppkey", supp, "s_suppkey", "supplier_sk"),
         ("l_orderkey", orders, "o_orderkey", "order_sk")],
        ["ship_date_key", F.col("l_linenumber").alias("line_number"),
         money("l_quantity").alias("quantity"),
         (money("l_extendedprice") * (1 - money("l_discount"))).alias("revenue")])


def mart_revenue_nation_segment(spark, sf):
    return W.mart(fact_orders(spark, sf), "customer_sk", dim_customer(spark, sf),
                  ["n_name", "c_mktsegment"], sums={"revenue": "total_price"},
                  counts={"n_orders": "*"})


def dim_customer_snowflake(spark, sf):
    c, n, r = (load(spark, sf, t) for t in ("customer", "nation", "region"))
    levels = W.snowflake_chain([
        ("customer", c, "c_custkey", ["c_name", "c_mktsegment"], "c_nationkey"),
        ("nation", n, "n_nationkey", ["n_name"], "n_regionkey"),
        ("region", r, "r_regionkey", ["r_name"], None),
    ])
    return levels[0]


def dim_nation_snowflake(spark, sf):
    c, n, r = (load(spark, sf, t) for t in ("customer", "nation", "region"))
    return W.snowflake_chain([
        ("nation", n, "n_nationkey", ["n_name"], "n_regionkey"),
        ("region", r, "r_regionkey", ["r_name"], None),
    ])[0]


def drill_across_monthly(spark, sf):
    o, li = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    o = o.withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    li = li.withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    return W.drill_across([
        (o, {"n_orders": F.count(F.lit(1)),
             "order_total": F.sum(money("o_totalprice")).cast("decimal(38,2)")}),
        (li, {"n_lines": F.count(F.lit(1)),
              "revenue": F.sum(money("l_extendedprice") * (1 - money("l_discount"))).cast("decimal(38,4)")}),
    ], "month")


def pk_duplicates_lineitem(spark, sf):
    return W.check_pk(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def orphans_lineitem(spark, sf):
    parent = load(spark, sf, "orders").filter(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    return W.orphans(load(spark, sf, "lineitem"), parent, "l_orderkey", "o_orderkey")


def split_orders_3nf(spark, sf):
    """Orders out of the wide table: orders with their lines, orders without any too."""
    wide = load(spark, sf, "orders").join(load(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return W.normalize(wide, {"orders": ("o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"])})["orders"]


def split_customers_3nf(spark, sf):
    """Each customer's first order, whole: attributes that differ within the key stay together."""
    return W.normalize(load(spark, sf, "orders"), {"c": ("o_custkey", ["o_orderdate", "o_orderkey", "o_orderpriority"])})["c"]


def split_partsupp_3nf(spark, sf):
    return W.normalize(load(spark, sf, "lineitem"), {"part_supplier": (["l_partkey", "l_suppkey"], [])})["part_supplier"]


def fact_orders_orphans(spark, sf):
    """Orders against a customer dimension that lacks the customers without a balance (planted orphans)."""
    dim = load(spark, sf, "customer").filter(F.col("c_acctbal") > 0)
    o = load(spark, sf, "orders").withColumn("o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")))
    return W.fact(o, [("o_custkey", dim, "c_custkey", "customer_sk")], [money("o_totalprice").alias("total_price")], degenerate=["o_orderkey"])


def mart_order_average(spark, sf):
    return W.mart(fact_orders(spark, sf), "customer_sk", dim_customer(spark, sf), ["r_name"], sums={"revenue": "total_price"},
                  averages={"avg_order": "total_price"})


def drill_across_facts(spark, sf):
    """Two facts over a conformed key that is NULL in some rows of both."""
    key = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    o = load(spark, sf, "orders").select("o_orderkey", key.alias("priority"))
    li = load(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return W.drill_across([(o, {"n_orders": F.count(F.lit(1))}), (li, {"n_lines": F.count(F.lit(1))})], "priority")


def galaxy_customers(spark, sf):
    """Two facts over the conformed customer dimension, aggregated and joined on its surrogate key."""
    dim = dim_customer(spark, sf)
    orders = fact_orders(spark, sf)
    o = load(spark, sf, "orders").filter(F.col("o_orderstatus") != "P").select("o_orderkey", "o_custkey")  # lines of open orders have no customer
    li = load(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    lines = W.fact(li, [("o_custkey", dim, "c_custkey", "customer_sk")], [money("l_quantity").alias("quantity")])
    both = W.drill_across([(orders, {"n_orders": F.count(F.lit(1)), "total": F.sum("total_price").cast("decimal(38,2)")}),
                           (lines, {"n_lines": F.count(F.lit(1)), "quantity": F.sum("quantity").cast("decimal(38,2)")})], "customer_sk")
    return both.join(dim, "customer_sk", "left").select("c_custkey", "n_name", "n_orders", "total", "n_lines", "quantity")


def sample_lineitem(spark, sf):
    from kiln.sources.tables import sample
    return sample(load(spark, sf, "lineitem"),
                  ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], 10)


def event_stream(spark, sf):
    return W.event_stream_model(load(spark, sf, "events"), "event_id", "ts")


# ---- oracles ----------------------------------------------------------------
_SK = sql_surrogate_key
_UNK = "md5('-1')"
_DIM_CUSTOMER = f"""
SELECT {_SK('c_custkey')} AS customer_sk, c_custkey, c_name, c_mktsegment, n_name, r_name
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT {_UNK}, NULL, NULL, NULL, NULL, NULL"""
_FACT_ORDERS = f"""
SELECT CASE WHEN c.c_custkey IS NULL THEN {_UNK} ELSE {_SK('o_custkey')} END AS customer_sk,
       o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS order_date_key,
       CAST(o_totalprice AS DECIMAL(18,2)) AS total_price
FROM orders LEFT JOIN (SELECT DISTINCT c_custkey FROM customer) c ON o_custkey = c.c_custkey"""

ORACLES = {
    "bronze_orders": f"""SELECT *, TIMESTAMP '{LOAD_TS}' AS _load_ts, 'orders' AS _source,
        'b0001' AS _batch_id FROM orders""",
    "silver_customer": """SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM (
        SELECT c_custkey, trim(c_name) AS c_name, c_nationkey, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal,
               trim(c_mktsegment) AS c_mktsegment,
               row_number() OVER (PARTITION BY c_custkey ORDER BY trim(c_name), c_nationkey,
                                  CAST(c_acctbal AS DECIMAL(18,2)), trim(c_mktsegment)) AS rn
        FROM customer) WHERE rn = 1""",
    "dim_customer": _DIM_CUSTOMER,
    "fact_orders": _FACT_ORDERS,
    "fact_lineitem": f"""
SELECT {_SK('l_partkey')} AS part_sk, {_SK('l_suppkey')} AS supplier_sk, {_SK('l_orderkey')} AS order_sk,
       CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER) AS ship_date_key, l_linenumber AS line_number,
       CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DECIMAL(38,4))
         AS revenue
FROM lineitem""",
    "mart_revenue_nation_segment": f"""
SELECT d.n_name, d.c_mktsegment, CAST(sum(f.total_price) AS DECIMAL(38,2)) AS revenue,
       CAST(count(*) AS BIGINT) AS n_orders
FROM ({_FACT_ORDERS}) f LEFT JOIN ({_DIM_CUSTOMER}) d ON f.customer_sk = d.customer_sk
GROUP BY d.n_name, d.c_mktsegment""",
    "dim_customer_snowflake": f"""
SELECT {_SK('c_custkey')} AS customer_sk, c_custkey, c_name, c_mktsegment,
       {_SK('c_nationkey')} AS nation_sk FROM customer
UNION ALL SELECT {_UNK}, NULL, NULL, NULL, {_UNK}""",
    "dim_nation_snowflake": f"""
SELECT {_SK('n_nationkey')} AS nation_sk, n_nationkey, n_name, {_SK('n_regionkey')} AS region_sk FROM nation
UNION ALL SELECT {_UNK}, NULL, NULL, {_UNK}""",
    "drill_across_monthly": """
WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n_orders,
                  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS order_total
           FROM orders GROUP BY 1),
     l AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n_lines,
                  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))))
                       AS DECIMAL(38,4)) AS revenue
           FROM lineitem GROUP BY 1)
SELECT coalesce(o.month, l.month) AS month, n_orders, order_total, n_lines, revenue
FROM o FULL OUTER JOIN l ON o.month = l.month""",
    "pk_duplicates_lineitem": """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows,
       CASE WHEN l_orderkey IS NULL OR l_linenumber IS NULL THEN 'null_key' ELSE 'duplicate_key' END AS violation
FROM lineitem GROUP BY l_orderkey, l_linenumber
HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL""",
    "orphans_lineitem": """
SELECT * FROM lineitem l WHERE l_orderkey IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o_orderdate < TIMESTAMP '2000-01-01')""",
    "split_orders_3nf": """SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM (
        SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_custkey, o_orderstatus, o_orderpriority) AS rn
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey) WHERE rn = 1""",
    "split_customers_3nf": """SELECT o_custkey, o_orderdate, o_orderkey, o_orderpriority FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, o_orderpriority) AS rn
        FROM orders) WHERE rn = 1""",
    "split_partsupp_3nf": "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem",
    "fact_orders_orphans": f"""
SELECT CASE WHEN c.c_custkey IS NULL THEN {_UNK} ELSE {_SK('o_custkey')} END AS customer_sk, o_orderkey,
       CAST(o_totalprice AS DECIMAL(18,2)) AS total_price
FROM orders LEFT JOIN (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 0) c ON o_custkey = c.c_custkey AND o_orderstatus <> 'P'""",
    "mart_order_average": f"""
SELECT d.r_name, CAST(sum(f.total_price) AS DECIMAL(38,2)) AS revenue, CAST(sum(f.total_price) AS DOUBLE) / count(f.total_price) AS avg_order
FROM ({_FACT_ORDERS}) f LEFT JOIN ({_DIM_CUSTOMER}) d ON f.customer_sk = d.customer_sk GROUP BY d.r_name""",
    "drill_across_facts": """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority FROM orders),
     a AS (SELECT priority, count(*) AS n_orders FROM o GROUP BY 1),
     b AS (SELECT priority, count(*) AS n_lines FROM lineitem LEFT JOIN o ON l_orderkey = o_orderkey GROUP BY 1)
SELECT coalesce(a.priority, b.priority) AS priority, n_orders, n_lines FROM a FULL JOIN b ON a.priority IS NOT DISTINCT FROM b.priority""",
    "event_stream": "SELECT *, CAST(ts AS DATE) AS event_date FROM events",
    "galaxy_customers": """
WITH a AS (SELECT o_custkey AS k, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM orders GROUP BY 1),
     b AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS k, count(*) AS n_lines, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS quantity
           FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT coalesce(a.k, b.k) AS c_custkey, n_name, n_orders, total, n_lines, quantity
FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k LEFT JOIN customer ON c_custkey = coalesce(a.k, b.k) LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "sample_lineitem": """SELECT * FROM lineitem
        ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate LIMIT 10""",
}

QUERIES = {
    "bronze_orders": bronze_orders,
    "silver_customer": silver_customer,
    "dim_customer": dim_customer,
    "fact_orders": fact_orders,
    "fact_lineitem": fact_lineitem,
    "mart_revenue_nation_segment": mart_revenue_nation_segment,
    "dim_customer_snowflake": dim_customer_snowflake,
    "dim_nation_snowflake": dim_nation_snowflake,
    "drill_across_monthly": drill_across_monthly,
    "pk_duplicates_lineitem": pk_duplicates_lineitem,
    "orphans_lineitem": orphans_lineitem,
    "split_orders_3nf": split_orders_3nf,
    "split_customers_3nf": split_customers_3nf,
    "split_partsupp_3nf": split_partsupp_3nf,
    "fact_orders_orphans": fact_orders_orphans,
    "mart_order_average": mart_order_average,
    "drill_across_facts": drill_across_facts,
    "event_stream": event_stream,
    "galaxy_customers": galaxy_customers,
    "sample_lineitem": sample_lineitem,
}

"""A fleet of warehouse designs derived from the fixture tables.

them over input that grows with the data, every customer is a project and
every line item one designed table (or its columns, relationship, task,
grant): names come from the part bought, layer labels from the order
priority, the architecture's layer list from the market segment.  The same
SQL text is rendered for Spark SQL (engine input) and DuckDB (oracle input),
so both engines see identical metadata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.functions import compare_key
from kiln.operators.model import consolidate_designs
from kiln.sources.tables import load

# Layer lists by market segment (architecture of the project).
# They include a duplicate label after normalising and an empty label.
SEGMENT_LAYERS = {
    "BUILDING": ["Bronze", "Silver", "Gold"],
    "AUTOMOBILE": ["Raw Vault", "Business Vault", "Info Mart"],
    "MACHINERY": ["Staging", "Conformed", "Enriched", "Reporting Mart"],
    "HOUSEHOLD": ["Bronze", "Silver / Conformed", "Gold (Semantic)", "GOLD semantic"],
    "FURNITURE": ["Landing", "", "Mart"],
}
# A table's layer label by order priority (one blank, one partial).
PRIORITY_LAYER = {
    "1-URGENT": "Bronze", "2-HIGH": "Silver / Conformed", "3-MEDIUM": "Gold (Semantic)",
    "4-NOT SPECIFIED": "", "5-LOW": "Reporting",
}
# Table-name prefix by (return flag, line status).
PREFIX = {"AF": "DIM_", "AO": "dim ", "RF": "FACT_", "RO": "fct__", "NF": "HUB_", "NO": "SAT_"}
TYPE_BY_PREFIX = {"DIM_": "dimension", "dim ": "dimension", "FACT_": "fact", "fct__": "fact",
                  "HUB_": "hub", "SAT_": "satellite"}


def _case(expr: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def _layers_values() -> str:
    rows = [f"('{seg}', {i}, '{name}')" for seg, names in SEGMENT_LAYERS.items()
            for i, name in enumerate(names)]
    return ", ".join(rows)


def _prefix(flags: str) -> str:
    return _case(flags, PREFIX)


def _table_name(flags: str, large: str, part: str = "p_name") -> str:
    return f"{_prefix(flags)} || upper(split_part({part}, ' ', 2)) || (CASE WHEN {large} THEN 'S' ELSE '' END)"


def _base(ymd: str, project: str = "o_custkey", flags: str = "l_returnflag || l_linestatus", large: str = "l_quantity > 25", more: str = "",
          source: str = "{lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey") -> str:
    """One row per line item with the derived design attributes."""
    return f"""
SELECT {project} AS project_id,
       o_orderkey AS batch_id,
       lpad(CAST(o_orderkey AS STRING), 13, '0') || lpad(CAST(l_linenumber AS STRING), 2, '0') ||
       lpad(CAST(l_partkey AS STRING), 11, '0') || lpad(CAST(l_suppkey AS STRING), 9, '0') || {ymd} AS seq,
       o_orderstatus AS batch_status,
       {_prefix(flags)} AS prefix,
       lower(split_part(p_name, ' ', 1)) AS adj,
       lower(split_part(p_name, ' ', 2)) AS core,
       {_table_name(flags, large)} AS table_name,
       {_case('o_orderpriority', PRIORITY_LAYER, "''")} AS layer,
       p_type, p_size, l_discount, l_tax, l_linestatus{more}
FROM {source}"""


# What an engine with exchanges joins: only what a design is made of, each as short as it can be.
_LINES = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS l_day, l_returnflag || l_linestatus AS l_flags,
       l_quantity > 25 AS l_large, l_discount < 0.02 AS l_small, l_discount, l_tax, l_linestatus FROM {lineitem})"""
_PARTS = "(SELECT p_partkey, substring_index(p_name, ' ', 2) AS p_name, p_type, p_size FROM {part})"
_ORDERS_JOIN, _PARTS_JOIN = "JOIN {orders} ON l_orderkey = o_orderkey", f"JOIN {_PARTS} ON l_partkey = p_partkey"


def _joined(*joins: str) -> str:
    return f"""
SELECT o_custkey AS project_id, o_orderkey, o_orderstatus, o_orderpriority, l_linenumber, l_partkey, l_suppkey, l_day, l_flags, l_large, l_small,
       l_discount, l_tax, l_linestatus, p_name, p_type, p_size
FROM {_LINES} {' '.join(joins)}"""


def sql_texts(engine: str) -> dict:
    """The fleet tables as SQL text; ``{lineitem}`` etc. are table placeholders."""
    ymd = "CAST(CAST(l_shipdate AS DATE) AS STRING)"
    base = "{b}"
    ttype = _case("prefix", TYPE_BY_PREFIX)
    tables = f"""SELECT project_id, batch_id, seq, table_name, layer, {ttype} AS table_type, batch_status
FROM {base} b"""
    # one row per line item, multiplied by the three column numbers: the base is read once
    three = "explode(array(0, 1, 2))" if engine == "spark" else "unnest([0, 1, 2])"
    small = "l_small" if engine == "spark" else "l_discount < 0.02"
    columns = f"""
SELECT project_id, batch_id, seq, table_name, ordinal,
       CASE ordinal WHEN 0 THEN core || '_sk'
         WHEN 1 THEN CASE WHEN p_size > 40 THEN adj || '_id' WHEN prefix IN ('FACT_', 'fct__') THEN 'dim_' || core || '_sk'
                          ELSE adj || '_sk' END
         ELSE CASE WHEN p_size <= 3 THEN 'customer_email' WHEN p_size <= 6 THEN 'contact_phone'
                   ELSE lower(p_type) || '_amount' END END AS column_name,
       CASE ordinal WHEN 0 THEN 'NUMBER(38,0)' WHEN 1 THEN 'VARCHAR(' || CAST(p_size AS STRING) || ')'
         ELSE CASE WHEN p_size > 25 THEN 'NUMBER(12,2)' ELSE 'Double Precision' END END AS data_type,
       ordinal = 0 AND prefix IN ('DIM_', 'dim ', 'HUB_') AS is_pk, ordinal = 1 AS is_fk,
       CASE WHEN ordinal = 1 THEN CASE WHEN {small} THEN 'DIM_' || upper(adj)
            ELSE 'DIM_' || upper(core) || '.' || adj || '_id' END END AS ref
FROM (SELECT b.*, {three} AS ordinal FROM {base} b) c"""
    rels = f"""
SELECT project_id, batch_id, seq, table_name AS from_table, 'DIM_' || upper(core) AS to_table,
       '||--o{{{{' AS cardinality,
       CASE WHEN l_tax = 0 THEN '' ELSE 'rolls up ''' || adj || '''' END AS label
FROM {base} b"""
    tasks = f"""
SELECT project_id, seq, 'load_' || lower(table_name) AS name,
       CASE WHEN prefix IN ('FACT_', 'fct__') THEN 'dim_' || core ELSE 'src_' || core END AS source,
       lower(table_name) AS target,
       'merge on ' || core || '_sk' AS logic,
       CASE WHEN l_linestatus = 'O' THEN 'transformation' ELSE 'ingestion' END AS type,
       CASE WHEN layer = '' THEN 'Silver' ELSE layer END AS layer
FROM {base} b"""
    grants = f"""
SELECT project_id, seq, 'ANALYST_' || batch_status AS role_name,
       CASE WHEN l_tax = 0 THEN NULL ELSE table_name END AS object_name,
       CASE WHEN l_discount = 0 THEN NULL WHEN l_linestatus = 'O' THEN 'SELECT' ELSE 'INSERT' END AS privilege
FROM {base} b"""
    layers = f"""
SELECT c_custkey AS project_id, m.ordinal, m.layer_name
FROM {{customer}} JOIN (VALUES {_layers_values()}) AS m(segment, ordinal, layer_name)
  ON c_mktsegment = m.segment"""
    masks = f"""
SELECT DISTINCT project_id, table_name, 'customer_email' AS column_name, 'hash' AS mask_type,
       'ANALYST_F' AS exempt_role
FROM {base} b WHERE p_size <= 3"""
    made = _base("CAST(l_day AS STRING)", "project_id", "l_flags", "l_large", ", l_small", "{joined}") if engine == "spark" else _base(ymd)
    return {"base": made, "tables": tables, "columns": columns, "rels": rels, "tasks": tasks,
            "grants": grants, "layers": layers, "masks": masks}


FLEET_TABLES = ["lineitem", "orders", "part", "customer"]


# What rows of designs hold for every fleet table, for the number of a version, and for each of the tables that can
# share one dealing; what such a table does without.
_NAME_FIELDS, _SEQ_FIELDS = ["l_flags", "l_large", "p_name"], ["o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_day"]
_TABLE_FIELDS = {"tables": ["o_orderpriority"], "columns": ["l_small", "p_type", "p_size"], "rels": ["l_tax"], "tasks": []}
_NOT_DEALT = {"tables": ["batch_status"], "tasks": ["type", "layer"]}


def _dealt(designs: DataFrame, tables, numbered: bool) -> DataFrame:
    """``designs`` dealt by project and table key, once for all of ``tables``.

    The rows are dealt as arrays of one element, of which the planner leaves
    nothing out, and what a reader filters stays behind a test that it can't
    move: so the exchange is the same whichever table reads it, and runs once.
    """
    kept = _NAME_FIELDS + (_SEQ_FIELDS if numbered else []) + sorted({c for t in tables for c in _TABLE_FIELDS[t]})
    at = {c: f"element_at(line, 1).{c}" for c in kept}
    name = F.expr(_table_name(at["l_flags"], at["l_large"], at["p_name"]))
    packed = designs.select("project_id", F.array(F.struct(*kept)).alias("line")).repartition(F.col("project_id"), compare_key(name))
    packed = packed.filter(F.spark_partition_id() >= 0)
    return packed.select("project_id", *[F.expr(at[f.name]).alias(f.name) if f.name in at else F.lit(None).cast(f.dataType).alias(f.name)
                                         for f in designs.schema if f.name != "project_id"])


def spark_fleet(spark: SparkSession, sf_dir: str, together=(), numbered: bool = True) -> dict[str, DataFrame]:
    """The fleet as Spark DataFrames derived from the fixture tables.

    Nothing is computed or written here: every fleet table is a lazy plan over
    the fixtures, pruned to the columns that its consumer asks for.

    ``together``: the tables a query reads of those in ``_TABLE_FIELDS``; they
    are made of one dealing of the designs, and the others are left out.
    """
    srcs = {t: load(spark, sf_dir, t, spread=(t == "lineitem")) for t in FLEET_TABLES}
    texts = sql_texts("spark")
    texts.pop("base")
    joined = spark.sql(_joined(_ORDERS_JOIN, _PARTS_JOIN), **srcs)
    if together:
        joined = _dealt(joined, together, numbered)
        texts = {k: v for k, v in texts.items() if k in together or k == "layers"}
    base = design_versions(joined)
    # masks are made of a few parts' lines: those meet their part before their order
    few = design_versions(spark.sql(_joined(_PARTS_JOIN, _ORDERS_JOIN), **srcs))
    out = {"designs": joined}
    for k, v in texts.items():
        out[k] = spark.sql(v, b=few if k == "masks" else base, **({"customer": srcs["customer"]} if "{customer}" in v else {}))
    for k in together:
        out[k] = out[k].drop(*_NOT_DEALT.get(k, []), *([] if numbered else ["seq", "batch_id"]))
    return out


def design_versions(designs: DataFrame) -> DataFrame:
    """The table versions that rows of ``designs`` stand for: their texts are made here, after the joins."""
    return designs.sparkSession.sql(sql_texts("spark")["base"], joined=designs)


def design_name() -> Column:
    """The table name of a row of ``designs``, as in ``design_versions``."""
    return F.expr(_table_name("l_flags", "l_large"))


def design_columns(versions: DataFrame) -> DataFrame:
    """The columns of table versions, with whatever else the rows hold under other names."""
    text = sql_texts("spark")["columns"]
    more = [c for c in versions.columns if c in ("table_key", "__cn")]
    head = "SELECT project_id,"
    assert text.strip().startswith(head)
    return versions.sparkSession.sql(text.replace(head, f"SELECT {', '.join(more + ['project_id'])},", 1), b=versions)


def fleet_columns(designs: DataFrame, only=None, dealt: bool = False) -> DataFrame:
    """U2's consolidated columns of the fleet (those whose upper-case name passes ``only``); ``dealt``: of designs that lie by table."""
    return consolidate_designs(designs, design_columns, versions=(None if dealt else design_name(), design_versions), only=only)


def duck_ctes() -> str:
    """``WITH`` clause defining the same fleet in DuckDB (no trailing comma)."""
    texts = sql_texts("duckdb")
    names = {t: t for t in FLEET_TABLES}
    names["b"] = "f_base"
    parts = [f"f_base AS ({texts.pop('base').format(**names)})"]
    parts += [f"f_{k} AS ({v.format(**names)})" for k, v in texts.items()]
    return "WITH " + ",\n".join(parts)

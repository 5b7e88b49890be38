"""Profile plans: A1-A4, W6, P2, G1 over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.functions import sql_base_type, sql_is_key_name, sql_is_pii_name
from kiln.operators import profile as P
from kiln.plans.fixture_schema import SCHEMAS
from kiln.sources.tables import ALL_TABLES, load_all

PROFILED = ALL_TABLES
# The tagging policy of the query below.
TAG_WORDS = {"SENSITIVE": ["bal", "price", "toxic"], "CONFIDENTIAL": ["text", "props", "html"]}


def profile_columns_exact(spark, sf_dir):
    return P.profile(spark, load_all(spark, sf_dir), exact=True)[1]


def profile_columns_approx(spark, sf_dir):
    return P.profile(spark, load_all(spark, sf_dir), exact=False)[1]


def profile_sketch_error(spark, sf_dir):
    """Sketch against exact counts: columns off by more than a fifth (A1 checked by A2)."""
    a = profile_columns_approx(spark, sf_dir).select("table_name", "column_name", F.col("distinct_count").alias("approx"))
    e = profile_columns_exact(spark, sf_dir).select("table_name", "column_name", "distinct_count")
    off = F.abs(F.col("approx") - F.col("distinct_count")) > 0.2 * F.col("distinct_count")
    return e.join(a, ["table_name", "column_name"]).select("table_name", "column_name", off.alias("off"))


def profile_tables(spark, sf_dir):
    return P.profile(spark, load_all(spark, sf_dir))[0]


def profile_defaults(spark, sf_dir):
    """P9 over catalogue rows of which some lack a type, a nullable flag or a name."""
    c = P.schema_columns(load_all(spark, sf_dir)).select("table_name", "ordinal", "column_name", "data_type", "nullable")
    gaps = {"data_type": F.col("ordinal") % 2 == 0, "nullable": F.col("ordinal") % 3 == 0, "column_name": F.col("ordinal") == 4}
    return P.with_defaults(c.withColumns({k: F.when(~g, F.col(k)) for k, g in gaps.items()}))


def type_mix(spark, sf_dir):
    return P.type_mix(P.schema_columns(load_all(spark, sf_dir)))


def row_share(spark, sf_dir):
    return P.row_share(P.profile(spark, load_all(spark, sf_dir))[0])


def pii_columns(spark, sf_dir):
    return P.flagged(P.schema_columns(load_all(spark, sf_dir)), "is_pii")


def column_tags(spark, sf_dir):
    return P.tag(P.schema_columns(load_all(spark, sf_dir)), TAG_WORDS)


def _lean(mode):
    def run(spark, sf_dir):
        tables, columns = P.profile(spark, load_all(spark, sf_dir))
        return P.lean_profile(tables, columns, mode)
    return run


lean_profile_macro, lean_profile_meso, lean_profile_micro = map(_lean, ("macro", "meso", "micro"))


# ---- oracles ----------------------------------------------------------------
def _sql_columns() -> str:
    parts = []
    for t in PROFILED:
        for i, (c, ty) in enumerate(SCHEMAS[t]):
            lit = f"'{c}'"
            parts.append(
                f"SELECT '{t}' AS table_name, {i} AS ordinal, {lit} AS column_name, "
                f"'{ty}' AS data_type, true AS nullable, "
                f"CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count, "
                f"{sql_is_key_name(lit)} AS is_key, {sql_is_pii_name(lit)} AS is_pii FROM {t}")
    return "\nUNION ALL\n".join(parts)


def _sql_tables() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS row_count FROM {t}" for t in PROFILED)


ORACLES = {
    "profile_columns_exact": _sql_columns(),
    "profile_tables": f"SELECT *, CAST(NULL AS VARCHAR) AS error FROM ({_sql_tables()})",
    "profile_sketch_error": f"SELECT table_name, column_name, false AS off FROM ({_sql_columns()})",
    "profile_defaults": f"""SELECT table_name, ordinal, CASE WHEN ordinal = 4 THEN 'N/A' ELSE column_name END AS column_name,
        CASE WHEN ordinal % 2 = 0 THEN 'TEXT' ELSE data_type END AS data_type, true AS nullable FROM ({_sql_columns()})""",
    "type_mix": (f"SELECT {sql_base_type('data_type')} AS base_type, count(*) AS n_columns "
                 f"FROM ({_sql_columns()}) GROUP BY 1"),
    "row_share": (f"SELECT table_name, row_count, "
                  f"CAST(row_count / sum(row_count) OVER () AS DECIMAL(9,6)) AS row_share, "
                  f"rank() OVER (ORDER BY row_count DESC) AS size_rank FROM ({_sql_tables()})"),
    "pii_columns": f"SELECT * EXCLUDE (distinct_count) FROM ({_sql_columns()}) WHERE is_pii",
    "column_tags": """SELECT * FROM (SELECT table_name, column_name, CASE WHEN is_pii THEN 'PII' """ + "".join(
        f"WHEN {' OR '.join(f"contains(column_name, '{w}')" for w in ws)} THEN '{t}' " for t, ws in TAG_WORDS.items())
    + f"END AS tag FROM ({_sql_columns()})) WHERE tag IS NOT NULL",
}

_LINES = """
WITH c AS ({columns}), t AS ({tables}),
f AS (SELECT table_name, string_agg(CASE WHEN '{mode}' = 'meso' THEN column_name || CASE WHEN is_key THEN 'KEY' ELSE '' END || CASE WHEN is_pii THEN 'PII' ELSE '' END
             ELSE column_name || '(' || data_type || ')' END, ', ' ORDER BY ordinal) AS listed FROM c WHERE ordinal < {n} GROUP BY table_name)
SELECT t.table_name, '- ' || t.table_name || CASE WHEN '{mode}' = 'meso' THEN ' (' || row_count || ' rows)' ELSE '' END || ': [' || listed || ']' AS line
FROM t JOIN f ON f.table_name = t.table_name"""
ORACLES["lean_profile_macro"] = f"SELECT table_name, '- ' || table_name AS line FROM ({_sql_tables()})"
ORACLES["lean_profile_meso"] = _LINES.format(columns=_sql_columns(), tables=_sql_tables(), mode="meso", n=8)
ORACLES["lean_profile_micro"] = _LINES.format(columns=_sql_columns(), tables=_sql_tables(), mode="micro", n=12)

QUERIES = {
    "lean_profile_macro": lean_profile_macro,
    "lean_profile_meso": lean_profile_meso,
    "lean_profile_micro": lean_profile_micro,
    "profile_columns_exact": profile_columns_exact,
    "profile_columns_approx": profile_columns_approx,
    "profile_sketch_error": profile_sketch_error,
    "profile_tables": profile_tables,
    "profile_defaults": profile_defaults,
    "type_mix": type_mix,
    "row_share": row_share,
    "pii_columns": pii_columns,
    "column_tags": column_tags,
}

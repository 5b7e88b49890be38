"""Flag, layer and rank rules: F8, F10, F11, F15, O1, O3."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kiln.functions.naming import entity_id, sql_entity_id

__all__ = [
    "is_key_name", "is_pii_name", "layer_from_name", "flow_weight", "band", "level_score",
    "layer_rank", "load_rank",
    "sql_is_key_name", "sql_is_pii_name", "sql_layer_from_name", "sql_flow_weight",
    "sql_band", "sql_level_score", "sql_layer_rank", "sql_load_rank",
    "KEY_WORDS", "PII_WORDS", "FLOW_WEIGHTS", "RAW_LAYERS",
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any_contains(x: Column, words) -> Column:
    out = None
    for w in words:
        cond = x.contains(w)
        out = cond if out is None else (out | cond)
    return out


def _sql_any_contains(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


# F8 -------------------------------------------------------------------------
# Plain substrings of the lower-cased column name.
KEY_WORDS = ["id", "key"]
PII_WORDS = ["email", "phone", "ssn", "dob", "name"]


def is_key_name(c) -> Column:
    return _any_contains(F.lower(_c(c)), KEY_WORDS)


def is_pii_name(c) -> Column:
    return _any_contains(F.lower(_c(c)), PII_WORDS)


def sql_is_key_name(x: str) -> str:
    return _sql_any_contains(f"lower({x})", KEY_WORDS)


def sql_is_pii_name(x: str) -> str:
    return _sql_any_contains(f"lower({x})", PII_WORDS)


# F10 ------------------------------------------------------------------------
# Name fragments (of the F2 identifier) -> layer, first match wins.
LAYER_FRAGMENTS = [
    (["BRONZE", "RAW", "LANDING", "SRC_"], "Bronze"),
    (["SILVER", "STAGING", "STG_", "CLEAN", "CONFORMED"], "Silver"),
    (["ODS"], "ODS"),
    (["GOLD", "FACT_", "DIM_", "FCT_", "MART", "PRES_"], "Gold"),
]


def layer_from_name(c, known=None) -> Column:
    """Layer of a table: the one its metadata names (``known``), else the first fragment its name holds.

    The identifier is worked out once a row, not once a fragment.
    """
    def first(n):
        out = None
        for words, layer in LAYER_FRAGMENTS:
            cond = _any_contains(n, words)
            out = F.when(cond, layer) if out is None else out.when(cond, layer)
        return out.otherwise("Warehouse")

    out = F.get(F.transform(F.array(entity_id(_c(c))), first), F.lit(0))
    return out if known is None else F.coalesce(_c(known), out)


def sql_layer_from_name(x: str) -> str:
    n = sql_entity_id(x)
    whens = " ".join(f"WHEN {_sql_any_contains(n, w)} THEN '{l}'" for w, l in LAYER_FRAGMENTS)
    return f"(CASE {whens} ELSE 'Warehouse' END)"


# F11 ------------------------------------------------------------------------
# Node-name substring -> flow weight, checked in this order.
FLOW_WEIGHTS = [
    ("source", 0), ("src", 0), ("erp", 0), ("crm", 0), ("app", 0), ("s1", 0), ("s2", 0),
    ("s3", 0), ("s4", 0), ("feed", 0), ("landing", 0),
    ("bronze", 1), ("raw", 1), ("raw_vault", 1), ("hub", 1), ("lnk", 1), ("sat", 1), ("b1", 1),
    ("b2", 1), ("stage", 1), ("stg", 1), ("ingest", 1),
    ("silver", 2), ("cleaned", 2), ("conformed", 2), ("stg_", 2), ("business_vault", 2),
    ("bv_", 2), ("s1a", 2), ("s2a", 2),
    ("gold", 3), ("curated", 3), ("enriched", 3), ("semantic", 3), ("infomart", 3), ("mart", 3),
    ("info_mart", 3), ("fct_", 3), ("dim_", 3), ("fact_", 3), ("s1b", 3), ("s2b", 3), ("g1", 3),
    ("g2", 3), ("presentation", 3),
    ("consumption", 4), ("bi", 4), ("analytics", 4), ("analyst", 4), ("cortex", 4),
    ("reporting", 4), ("dashboard", 4), ("app_", 4),
]


def flow_weight(c) -> Column:
    """Weight of the first listed substring found in lower(name); -1 if none.

    The list is one literal array: generated code stays small wherever the
    weight is used more than once.  The name is lower-cased once a row.
    """
    words = F.array(*[F.lit(w) for w, _ in FLOW_WEIGHTS])
    weights = F.array(*[F.lit(k) for _, k in FLOW_WEIGHTS])
    place = lambda n: F.array_position(F.transform(words, n.contains), F.lit(True))
    found = F.get(F.transform(F.array(F.lower(_c(c))), place), F.lit(0))
    return F.coalesce(F.get(weights, found.cast("int") - 1), F.lit(-1))


def sql_flow_weight(x: str) -> str:
    n = f"lower({x})"
    whens = " ".join(f"WHEN contains({n}, '{w}') THEN {k}" for w, k in FLOW_WEIGHTS)
    return f"(CASE {whens} ELSE -1 END)"


# F15 ------------------------------------------------------------------------
def band(c) -> Column:
    """>70 High, >40 Medium, else Low."""
    x = _c(c)
    return F.when(x > 70, "High").when(x > 40, "Medium").otherwise("Low")


def sql_band(x: str) -> str:
    return f"(CASE WHEN {x} > 70 THEN 'High' WHEN {x} > 40 THEN 'Medium' ELSE 'Low' END)"


# Level word -> score.
LEVEL_SCORES = {"low": 30, "medium": 60, "high": 90}


def level_score(c) -> Column:
    x = F.lower(_c(c))
    out = None
    for k, v in LEVEL_SCORES.items():
        out = F.when(x == k, v) if out is None else out.when(x == k, v)
    return out.otherwise(50)


def sql_level_score(x: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in LEVEL_SCORES.items())
    return f"(CASE lower({x}) {whens} ELSE 50 END)"


# O1 -------------------------------------------------------------------------
# Layer-label substrings -> display rank, first match wins.
LAYER_RANKS = [
    (["bronze", "raw", "landing"], 0),
    (["staging", "silver", "clean", "conform"], 1),
    (["ods", "operational"], 2),
    (["gold", "curated", "mart", "fact", "dim"], 3),
]
# Layer labels hidden when any other layer is present (Q7).
RAW_LAYERS = ["bronze", "raw", "landing", "ingest"]


def layer_rank(c) -> Column:
    n = F.lower(_c(c))
    out = None
    for words, r in LAYER_RANKS:
        cond = _any_contains(n, words)
        out = F.when(cond, r) if out is None else out.when(cond, r)
    return out.otherwise(4)


def sql_layer_rank(x: str) -> str:
    n = f"lower({x})"
    whens = " ".join(f"WHEN {_sql_any_contains(n, w)} THEN {r}" for w, r in LAYER_RANKS)
    return f"(CASE {whens} ELSE 4 END)"


# O3 -------------------------------------------------------------------------
# Load-order prefixes of an upper-cased name, first match wins.
# A prefix counts at the start of the text or after a space, dot or parenthesis.
LOAD_RANKS = [
    (r"(^|[\s.(])DIM_", 0), (r"(^|[\s.(])(HUB_|LNK_|SAT_)", 1), (r"(^|[\s.(])(RAW_|STG_|STAGE_|BRONZE)", 2),
    (r"(^|[\s.(])(SILVER|CONFORMED|CLEANED)", 3), (r"(^|[\s.(])(FACT_|FCT_)", 4),
]


def load_rank(c) -> Column:
    """Dimensions first, facts last; of a table name, with or without its schema, or of a statement."""
    n = F.upper(_c(c))
    out = None
    for pat, r in LOAD_RANKS:
        out = F.when(n.rlike(pat), r) if out is None else out.when(n.rlike(pat), r)
    return out.otherwise(5)


def sql_load_rank(x: str) -> str:
    n = f"upper({x})"
    whens = " ".join(f"WHEN regexp_matches({n}, '{p}') THEN {r}" for p, r in LOAD_RANKS)
    return f"(CASE {whens} ELSE 5 END)"

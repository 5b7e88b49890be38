"""Identifier and label rules: F1-F5, F7, F12, F13, F18."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "layer_to_schema_name", "entity_id", "compare_key", "sanitize_column",
    "norm_label", "ref_table", "ref_column", "sanitize_label", "split_relation",
    "is_identifier", "collapse_underscores",
    "sql_layer_to_schema_name", "sql_entity_id", "sql_compare_key",
    "sql_sanitize_column", "sql_norm_label", "sql_ref_table", "sql_ref_column",
    "sql_sanitize_label", "sql_is_identifier", "sql_collapse_underscores",
    "sql_split_relation",
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_underscores(c) -> Column:
    """Collapse runs of ``_`` and strip them from both ends."""
    return F.regexp_replace(F.regexp_replace(_c(c), "_+", "_"), "^_+|_+$", "")


def sql_collapse_underscores(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '_+', '_', 'g'), '^_+|_+$', '', 'g')"


# F1 -------------------------------------------------------------------------
def layer_to_schema_name(c) -> Column:
    """'Silver / Conformed' -> 'SILVER_CONFORMED'; blank -> 'WAREHOUSE_LAYER'."""
    slug = F.upper(collapse_underscores(F.regexp_replace(_c(c), "[^a-zA-Z0-9]", "_")))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("WAREHOUSE_LAYER"))


def sql_layer_to_schema_name(x: str) -> str:
    raw = f"regexp_replace({x}, '[^a-zA-Z0-9]', '_', 'g')"
    slug = f"upper({sql_collapse_underscores(raw)})"
    return f"coalesce(nullif({slug}, ''), 'WAREHOUSE_LAYER')"


# F2 -------------------------------------------------------------------------
def entity_id(c) -> Column:
    """Upper-case alphanumeric/underscore identifier; blank -> 'ENTITY'."""
    s = F.upper(F.regexp_replace(_c(c), r"[.\s-]+", "_"))
    s = collapse_underscores(F.regexp_replace(s, "[^A-Z0-9_]", ""))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("ENTITY"))


def sql_entity_id(x: str) -> str:
    s = f"upper(regexp_replace({x}, '[.\\s-]+', '_', 'g'))"
    s = sql_collapse_underscores(f"regexp_replace({s}, '[^A-Z0-9_]', '', 'g')")
    return f"coalesce(nullif({s}, ''), 'ENTITY')"


# F3 -------------------------------------------------------------------------
def compare_key(c) -> Column:
    """Consolidation key: upper, collapse '_', drop one trailing S if len > 3."""
    n = collapse_underscores(F.upper(F.trim(_c(c))))
    return F.regexp_replace(n, "^(.{3,})S$", "$1")


def sql_compare_key(x: str) -> str:
    n = sql_collapse_underscores(f"upper(trim({x}))")
    return f"regexp_replace({n}, '^(.{{3,}})S$', '\\1')"


# F4 -------------------------------------------------------------------------
def sanitize_column(c) -> Column:
    return F.regexp_replace(_c(c), "[^a-zA-Z0-9_]", "")


def sql_sanitize_column(x: str) -> str:
    return f"regexp_replace({x}, '[^a-zA-Z0-9_]', '', 'g')"


# F5 -------------------------------------------------------------------------
def norm_label(c) -> Column:
    return F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]", "")


def sql_norm_label(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


# F7 -------------------------------------------------------------------------
def ref_table(c) -> Column:
    """Table part of 'table.column'; NULL when the ref holds no dot."""
    return F.when(F.instr(_c(c), ".") > 0, F.split_part(_c(c), F.lit("."), F.lit(1)))


def ref_column(c) -> Column:
    """Everything after the first dot; NULL when the ref holds no dot."""
    r = _c(c)
    return F.when(F.instr(r, ".") > 0, r.substr(F.instr(r, ".") + 1, F.lit(1 << 30)))


def sql_ref_table(x: str) -> str:
    return f"(CASE WHEN strpos({x}, '.') > 0 THEN split_part({x}, '.', 1) END)"


def sql_ref_column(x: str) -> str:
    return f"(CASE WHEN strpos({x}, '.') > 0 THEN substr({x}, strpos({x}, '.') + 1) END)"


# F12 ------------------------------------------------------------------------
def sanitize_label(c) -> Column:
    """Drop quotes, spaces -> '_'; blank -> 'relates'."""
    s = F.replace(F.translate(_c(c), "\"'", ""), F.lit(" "), F.lit("_"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("relates"))


def sql_sanitize_label(x: str) -> str:
    s = f"replace(replace(replace({x}, '\"', ''), '''', ''), ' ', '_')"
    return f"coalesce(nullif({s}, ''), 'relates')"


# F13 ------------------------------------------------------------------------
# The separators a relation text may use, case-insensitive.
_REL_SPLIT = r"(?i)\s*(?:->|joins|to|-|ref|references)\s*"


def split_relation(c) -> Column:
    """(from, to) of 'A -> B' style text: the first two pieces, upper-cased.

    Pieces come from splitting at every separator, as the rule does, so
    a name holding 'to' is cut as well.  NULL when there is no separator.
    """
    parts = F.split(_c(c), _REL_SPLIT)
    return F.when(F.size(parts) >= 2, F.struct(
        F.upper(F.trim(parts.getItem(0))).alias("from_entity"),
        F.upper(F.trim(parts.getItem(1))).alias("to_entity")))


def sql_split_relation(x: str) -> tuple[str, str]:
    p = f"regexp_split_to_array({x}, '\\s*(?:->|joins|to|-|ref|references)\\s*', 'i')"
    return (f"(CASE WHEN len({p}) >= 2 THEN upper(trim({p}[1])) END)",
            f"(CASE WHEN len({p}) >= 2 THEN upper(trim({p}[2])) END)")


# F18 ------------------------------------------------------------------------
def is_identifier(c) -> Column:
    return F.coalesce(_c(c).rlike("^[a-zA-Z0-9_]+$"), F.lit(False))


def sql_is_identifier(x: str) -> str:
    return f"coalesce(regexp_full_match({x}, '[a-zA-Z0-9_]+'), false)"

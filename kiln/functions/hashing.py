"""Keys, hashes, dates and JSON: F14, F16, F17 and the surrogate-key rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["surrogate_key", "unknown_key", "content_hash", "model_prompt_hash", "money",
           "day_string", "iso_day", "or_now", "to_json_text", "sql_surrogate_key", "sql_content_hash",
           "sql_money", "UNKNOWN_MEMBER"]

# Business key of the unknown member every dimension carries.
UNKNOWN_MEMBER = "-1"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def surrogate_key(*cols) -> Column:
    """md5 of the business key: stable, no global sort, same in DuckDB.

    Every part is written as its length and its text, NULL as '~', so that
    different keys never give one text: (a, NULL) and (NULL, a) differ, and
    so do NULL and ''.  Callers cast doubles to decimal and timestamps to
    text first.
    """
    parts = [_c(c).cast("string") for c in cols]
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("~")) for p in parts]))


def sql_surrogate_key(*xs: str) -> str:
    parts = [f"coalesce(CAST(length(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '~')" for x in xs]
    return "md5(" + " || ".join(parts) + ")"


def unknown_key() -> Column:
    """Key of the unknown member: the text it is made of has no length in front, so no business key gives it."""
    return F.md5(F.lit(UNKNOWN_MEMBER))


def money(c) -> Column:
    """Money is decimal(18,2) before any sum."""
    return _c(c).cast("decimal(18,2)")


def sql_money(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,2))"


# F14 ------------------------------------------------------------------------
def content_hash(step, model, prompt) -> Column:
    """md5 of step, model and prompt (the cache key of a generation step)."""
    return F.md5(F.concat_ws("|", _c(step), _c(model), _c(prompt)))


def sql_content_hash(step: str, model: str, prompt: str) -> str:
    return f"md5(concat_ws('|', {step}, {model}, {prompt}))"


def model_prompt_hash(model, prompt) -> Column:
    return F.sha2(F.concat_ws(":", _c(model), _c(prompt)), 256)


# F16 ------------------------------------------------------------------------
def day_string(c) -> Column:
    return F.date_format(_c(c), "yyyy-MM-dd")


def iso_day(c) -> Column:
    """First 10 characters of an ISO time text."""
    return F.left(_c(c).cast("string"), F.lit(10))


def or_now(c) -> Column:
    """The time, or the time of the query where there is none."""
    return F.coalesce(_c(c), F.localtimestamp())


# F17 ------------------------------------------------------------------------
def to_json_text(c) -> Column:
    """A struct, array or map as JSON text: dates and times in ISO form, other values as JSON or text, NULL fields kept."""
    return F.to_json(_c(c), {"dateFormat": "yyyy-MM-dd", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"})

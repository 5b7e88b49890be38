"""All registered plans, merged from the per-area modules."""

from __future__ import annotations

from kiln.plans import design, documents, governance, profile, responses, star, store, streams, vault

_MODULES = [profile, star, vault, design, documents, governance, store, responses, streams]


def queries() -> dict:
    out = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out = {}
    for m in _MODULES:
        out.update(m.ORACLES)
    return out

"""Operators of a training-data pipeline; each module has QUERIES and SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quality", "packing", "url_filter", "token_files", "fixity", "language", "recurrent_lm", "telephony", "pieces", "rtree_join", "mixing", "collocations", "alignment")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"{__name__}.{m}").SQL.items()}

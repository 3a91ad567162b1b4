"""The subpackage's queries and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = (
    "language_id",
    "secret_scan",
    "kd_sharding",
    "simhash_dedup",
    "quotation_links",
    "matroska",
    "best_fit_packing",
    "line_dedup",
    "source_mixing",
    "additive_quantisation",
)


def _modules():
    return [importlib.import_module(f"docquarry.llm.{name}") for name in MODULES]


def queries() -> dict:
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in _modules() if m.SQL}

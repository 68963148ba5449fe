"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from importlib import import_module

from .derive import one_ledger

#: Modules with a dict Q of queries and a dict S of SQL.
MODULES = ("close_queries", "transaction_queries", "gate_queries", "measure_queries", "text_queries", "check_queries", "file_queries", "pack_queries", "policy_queries", "document_queries")


def queries() -> dict:
    return {k: one_ledger(f) for m in MODULES for k, f in import_module(f"{__name__}.{m}").Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"{__name__}.{m}").S.items()}

"""Registered queries with their check SQL.

Each module of this package fills two dictionaries: ``QUERIES`` (Spark) and
``ORACLE`` (the same question as plain SQL). ``build()`` merges them.
"""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "bars", "features", "signals", "outcomes", "performance", "rankings", "cohorts",
    "quality", "schedules", "ledgers", "identity", "masters", "reports", "streams",
)


def build():
    queries, oracle = {}, {}
    for name in MODULES:
        module = import_module(f"barloom.catalog.{name}")
        queries.update(module.QUERIES)
        oracle.update(module.ORACLE)
    return queries, oracle

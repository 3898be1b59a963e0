"""All registered queries and oracles."""

from __future__ import annotations

import importlib

from folioflux.plans import base

MODULES = ("comparison", "signals", "validation", "audit", "studies", "ingestion")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"folioflux.plans.{name}")


def queries() -> dict:
    _load()
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: base.with_ctes(sql) for name, sql in base.ORACLES.items()}

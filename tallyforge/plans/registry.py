"""All registered queries of the core, by module."""

from __future__ import annotations

from tallyforge.plans import corpus, ledger, problems

MODULES = [ledger, corpus, problems]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}

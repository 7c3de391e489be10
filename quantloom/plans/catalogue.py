"""Registry of the queries over the driver's tables."""

from __future__ import annotations

from quantloom.plans import books, factors, frontends, months, research, returns, scoring, studies  # noqa: F401  the modules register their queries

FLAGSHIP = "factor_momentum_rank"


def queries() -> dict:
    return {name: factors.plan(*shape) for name, shape in factors.shapes().items()} | research.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: factors.text(*shape) for name, shape in factors.shapes().items()} | research.ORACLE

"""The queries of the engine's own operators, with their SQL twins."""

from __future__ import annotations

from .plans import queries as _queries
from .plans import sql as _sql


def queries() -> dict:
    return _queries.queries()


def oracle_sql() -> dict[str, str]:
    return _sql.oracle_sql()

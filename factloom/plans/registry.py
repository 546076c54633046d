"""All queries by name, and their SQL."""
from __future__ import annotations

from . import queries as q
from . import evidence, records, threads  # noqa: F401  add their queries


def queries() -> dict:
    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(q.SQL)

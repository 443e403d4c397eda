"""SQL for those of the queries that SQL can express over whole tables."""

from __future__ import annotations


def oracle_sql() -> dict[str, str]:
    return {}

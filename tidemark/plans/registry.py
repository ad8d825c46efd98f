"""How plan modules register their queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def registry() -> tuple[dict, dict, object]:
    """(queries, oracle SQL, decorator): the decorator names a query after its function and keeps its SQL."""
    queries: dict = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None):
        def keep(fn):
            queries[fn.__name__] = fn
            if sql:
                oracle[fn.__name__] = sql
            return fn

        return keep

    return queries, oracle, query


def r6(x: str | Column, name: str | None = None, digits: int = 6) -> Column:
    """Rounded, so that sums in another order compare equal."""
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c, digits).alias(name or x)

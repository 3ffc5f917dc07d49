"""Where queries are entered together with the SQL that an independent engine runs for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanlight.plans.views import VIEWS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Enter a query. ``sql`` follows the common views: more of them after a comma, then a SELECT."""

    def enter(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {VIEWS_SQL}\n{sql}"
        return f

    return enter

"""Name -> query and name -> DuckDB SQL, gathered from the modules beside this one."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame, with its DuckDB twin where SQL can express it."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


from . import evaluation_queries, feature_queries, mining_queries, ml_queries, model_queries, relational_queries, source_queries  # noqa: E402, F401

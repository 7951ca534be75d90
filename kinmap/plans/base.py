"""The tables of registered queries and oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the DuckDB SQL that gives its rows where SQL can."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return register

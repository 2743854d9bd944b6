"""Registration of queries beside the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.ledger import Ledger

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of a Ledger under its own name."""

    def add(f: Callable[[Ledger], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Ledger(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add

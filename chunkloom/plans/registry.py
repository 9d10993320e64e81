"""Registry of named queries: the DataFrame form and, where SQL can express it, the SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None
    operators: tuple[int, ...]  # rows of the operator inventory


REGISTRY: dict[str, Entry] = {}


def query(name: str, *operators: int, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Entry(run, sql, operators)
        return run

    return add

"""The library's queries over the standard tables, each with an equivalent SQL text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kilnspark.queries import corpus, examples, inspection, operations, releases, streams

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**corpus.QUERIES, **examples.QUERIES, **operations.QUERIES, **releases.QUERIES, **inspection.QUERIES, **streams.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**corpus.ORACLES, **examples.ORACLES, **operations.ORACLES, **releases.ORACLES, **inspection.ORACLES, **streams.ORACLES}

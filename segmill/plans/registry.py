"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from segmill.plans import streams
from segmill.plans.oracle import SQL
from segmill.plans.queries import QUERIES

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (*QUERIES, *streams.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return SQL | streams.STREAM_SQL

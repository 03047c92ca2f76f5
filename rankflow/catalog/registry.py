"""Registry of the queries over the driver tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query under ``name``; ``sql`` gives the same rows."""

    def add(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(run, sql)
        return run

    return add


SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its footers are read for the schema once per path."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in SCHEMAS:
        SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(SCHEMAS[path]).parquet(path)


def cents(column: str) -> str:
    """SQL for a two-digit amount as a whole number."""
    return f"CAST(round({column} * 100) AS BIGINT)"


def sql_div(a: str, b: int) -> str:
    """SQL for whole division of a number that is not negative."""
    return f"CAST(({a}) // {b} AS BIGINT)"


def sql_exact_sum(value: str, bits: int) -> str:
    """SQL for the exact sum of doubles that are multiples of ``2**-bits``, rounded once."""
    scale = f"CAST({2**bits} AS DOUBLE)"
    return f"CAST(sum(CAST(({value}) * {scale} AS HUGEINT)) AS DOUBLE) / {scale}"

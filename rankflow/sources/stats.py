"""Per-rank statistics documents and timer intervals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow import schemas
from rankflow.sources.headed import read_by_name

CREATED_AT = "yyyy-MM-dd.HH:mm:ss"


def _plain(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({f"{prefix}{n}": n for n in schemas.PREFIXED}) if prefix else df


def _finish(df: DataFrame, prefix: str) -> DataFrame:
    return _plain(df, prefix).withColumn("created_at", F.to_timestamp("created_at", CREATED_AT))


def read_rank_stats(spark: SparkSession, path: str, prefix: str = "", unsigned: bool = False) -> DataFrame:
    """Documents in cycles, one JSON object per file."""
    df = spark.read.schema(schemas.rank_stats_cycles(prefix, unsigned)).option("multiLine", True).json(path)
    return _finish(df, prefix)


def read_rank_stats_ns(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Documents with three clocks in nanoseconds."""
    df = spark.read.schema(schemas.rank_stats_ns(prefix)).option("multiLine", True).json(path)
    return _finish(df, prefix)


def parse_rank_stats(df: DataFrame, column: str, schema: T.StructType, prefix: str = "") -> DataFrame:
    """Documents held in a text column; other columns are kept."""
    doc = F.from_json(F.col(column), schema)
    return _plain(df.select(*[c for c in df.columns if c != column], doc.alias("_doc")).select(
        *[c for c in df.columns if c != column], "_doc.*"
    ), prefix)


def union_layouts(cycles: DataFrame, ns: DataFrame) -> DataFrame:
    """Both layouts in one table; columns only one of them has are null."""
    return cycles.unionByName(ns, allowMissingColumns=True)


def custom_timers_long(df: DataFrame, keep: list[str], measure: str = "elapsed_cycles") -> DataFrame:
    """Wide ``customN_*`` pairs to rows ``(timer_index, timer_name, elapsed)``, whatever numbers the columns have."""
    numbers = sorted(int(m[1]) for m in map(re.compile(r"custom(\d+)_timer_name").fullmatch, df.columns) if m)
    pairs = [
        F.struct(
            F.lit(i).alias("timer_index"),
            F.col(f"custom{i}_timer_name").alias("timer_name"),
            F.col(f"custom{i}_{measure}").alias("elapsed"),
        )
        for i in numbers
    ]
    rows = df.select(*keep, F.explode(F.array(*pairs)).alias("_t"))
    return rows.select(*keep, "_t.*").filter(F.col("timer_name").isNotNull())


def document_json(row: dict[str, Column]) -> Column:
    """A statistics document as JSON text."""
    return F.to_json(F.struct(*[value.alias(name) for name, value in row.items()]))


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Timer intervals in cycles."""
    return read_by_name(spark, path, schemas.TIMER_INTERVALS_CYCLES).drop("_file")


def read_intervals_ns(spark: SparkSession, path: str) -> DataFrame:
    """Timer intervals in nanoseconds."""
    return read_by_name(spark, path, schemas.TIMER_INTERVALS_NS).drop("_file")

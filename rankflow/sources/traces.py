"""Communication traces, channel lists and chunk logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow import schemas
from rankflow.sources.headed import read_by_name

TRIM = {"ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
DIRECTIONS = ("send", "recv")
# Calls of the message-passing standard that send and that receive.
SEND_CALLS = ("MPI_Send", "MPI_Bsend", "MPI_Ssend", "MPI_Rsend", "MPI_Isend", "MPI_Ibsend", "MPI_Issend", "MPI_Irsend")
RECV_CALLS = ("MPI_Recv", "MPI_Mrecv", "MPI_Irecv", "MPI_Imrecv")


def read_comm_trace(spark: SparkSession, path: str) -> DataFrame:
    """Seven-column trace; a file with any other header and a malformed number fail the load."""
    df = spark.read.csv(path, schema=schemas.COMM_TRACE, header=True, enforceSchema=False, mode="FAILFAST", **TRIM)
    return df.withColumnsRenamed({"from": "sender_rank", "to": "receiver_rank"})


def read_comm_trace_wide(spark: SparkSession, path: str) -> DataFrame:
    """Fourteen-column trace of the runtime."""
    df = spark.read.csv(path, schema=schemas.COMM_TRACE_WIDE, header=True, enforceSchema=False, mode="FAILFAST", **TRIM)
    return df.withColumnRenamed("file:line", "file_line")


def read_call_trace(spark: SparkSession, path: str) -> DataFrame:
    """Headerless call trace; a call that is neither a send nor a receive is an error."""
    df = spark.read.csv(path, schema=schemas.CALL_TRACE, header=False, mode="FAILFAST", **TRIM)
    other = F.raise_error(F.concat(F.lit("not a send or receive: "), F.coalesce("call", F.lit("null")))).cast("string")
    kind = F.when(F.col("call").isin(*SEND_CALLS), "send").when(F.col("call").isin(*RECV_CALLS), "recv")
    return df.withColumn("direction", kind.otherwise(other))


def read_channels(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Channel list of each process, bound by its header; the producer may put a prefix before its own ranks' names."""
    kinds = {name: (own, kind) for (own, kind), name in zip(_fields(schemas.CHANNELS), schemas.channel_headers(prefix), strict=True)}
    return _by_header(spark, path, kinds)


def read_wait_log(spark: SparkSession, path: str) -> DataFrame:
    """Four-column wait log, bound by its header."""
    return _by_header(spark, path, {own: (own, kind) for own, kind in _fields(schemas.WAIT_LOG)})


def _fields(schema: T.StructType) -> list[tuple[str, T.DataType]]:
    return [(f.name, f.dataType) for f in schema]


def _by_header(spark: SparkSession, path: str, kinds: dict[str, tuple[str, T.DataType]]) -> DataFrame:
    """Files whose headers name exactly ``kinds``, in any order; header name -> (column, type)."""
    schema = T.StructType([T.StructField(name, kind) for name, (_, kind) in kinds.items()])
    df = read_by_name(spark, path, schema, **TRIM)
    return df.select(*[F.col(f"`{name}`").alias(own) for name, (own, _) in kinds.items()])


def read_chunk_log(spark: SparkSession, path: str) -> DataFrame:
    """Chunk log; everything after ``max_idx`` is the backtrace, and a row with too few fields an error."""
    names = schemas.CHUNK_LOG.fieldNames()
    parts = F.split("value", "\t", len(names) + 1)
    rows = spark.read.text(path).select(parts.alias("p")).filter(F.get("p", F.lit(0)) != "executing rank")
    columns = [F.get("p", F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(schemas.CHUNK_LOG)]
    short = F.raise_error(F.concat(F.lit("short chunk row: "), F.array_join("p", " "))).cast("boolean")
    rows = rows.filter(F.array_join("p", "") != "").filter(F.when(F.size("p") >= len(names), F.lit(True)).otherwise(short))
    return rows.select(*columns, F.get("p", F.lit(len(names))).alias("backtrace"))


def row_is_good() -> Column:
    """Ranks of a trace row read as text are numeric and its direction is known."""
    numeric = F.col("sender_rank").rlike(r"\d") & F.col("receiver_rank").rlike(r"\d")
    return F.coalesce(numeric & F.col("direction").isin(*DIRECTIONS), F.lit(False))


def check_trace(raw: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejects of a trace; with ``strict`` the first bad row fails the job instead."""
    good = row_is_good()
    if strict:
        text = F.concat_ws(",", "direction", "sender_rank", "receiver_rank")
        failed = F.raise_error(F.concat(F.lit("bad trace row: "), text))
        return raw.filter(F.when(good, F.lit(True)).otherwise(failed.cast("boolean"))), raw.limit(0)
    return raw.filter(good), raw.filter(~good)

"""Reduce, all-reduce, broadcast, all-to-all and split over ``(comm, rank, idx, value)``.

``comm`` may be several columns.  Sums of integers widen to bigint, floats are
cast to double before they are reduced; sums of doubles are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.plans import attach, cut, exact_sums, row_number

OPS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "prod": F.product,
}


def to_elements(df: DataFrame, keep: list[str], buffer: str, idx: str = "idx", value: str = "value") -> DataFrame:
    """Array buffers to one row per element; floats become doubles."""
    rows = df.select(*keep, F.posexplode(buffer).alias(idx, value))
    return rows.withColumn(value, F.col(value).cast("double")) if dict(rows.dtypes)[value] == "float" else rows


Ops = dict[str, str | tuple[str, str]]


def reduce(df: DataFrame, comm: list[str], ops: Ops, idx: str = "idx", value: str = "value") -> DataFrame:
    """Element-wise reduce of every communicator.

    ``ops`` maps an output column to an operation on ``value``, or to
    (operation, column) for another column.

    Spark adds up each task's rows before the shuffle, so a communicator or an
    element of any size reaches its final task as one partial row per task.
    """
    return reduce_value(df, [*comm, idx], {n: op if isinstance(op, tuple) else (op, value) for n, op in ops.items()})


def reduce_to_root(
    df: DataFrame, comm: list[str], op: str, root: int = 0, idx: str = "idx", value: str = "value"
) -> DataFrame:
    """The reduced buffer, held by rank ``root`` of each communicator."""
    out = reduce(df, comm, {value: op}, idx, value)
    return out.select(*comm, F.lit(root).alias("rank"), idx, value)


def all_reduce(df: DataFrame, comm: list[str], ops: Ops, idx: str = "idx", value: str = "value") -> DataFrame:
    """Every rank's elements together with the reduced values."""
    return attach(df, reduce(df, comm, ops, idx, value), [*comm, idx])


def reduce_value(df: DataFrame, comm: list[str], ops: dict[str, tuple[str, str]]) -> DataFrame:
    """Reduce of single values: ``ops`` maps an output column to (operation, value column).

    Sums of floats and doubles are exact and rounded once, so they do not depend on how rows are partitioned.
    """
    kinds = dict(df.dtypes)
    sums = {name: col for name, (op, col) in ops.items() if op == "sum" and kinds[col] in ("float", "double")}
    if not sums:
        return df.groupBy(*comm).agg(*[OPS[op](F.col(col)).alias(name) for name, (op, col) in ops.items()])
    others = {name: (OPS[op], col) for name, (op, col) in ops.items() if name not in sums}
    return exact_sums(df, comm, sums, others).select(*comm, *ops)


def broadcast_root(
    df: DataFrame, comm: list[str], is_root: Column, buffer: list[str], prefix: str = "root_"
) -> DataFrame:
    """Every rank of a communicator gets the root's buffer columns."""
    root = df.filter(is_root).select(*comm, *[F.col(c).alias(f"{prefix}{c}") for c in buffer])
    return attach(df, root, comm)


def broadcast_lowest(df: DataFrame, comm: list[str], rank: str, buffer: list[str], prefix: str = "root_") -> DataFrame:
    """Every rank gets the buffer columns of its communicator's lowest rank (rank 0 after a split).

    One aggregate, combined before the shuffle, finds it; nobody has to be numbered.
    """
    lowest = df.groupBy(*comm).agg(F.min_by(F.struct(*buffer), rank).alias("_root"))
    return attach(df, lowest.select(*comm, *[F.col(f"_root.{c}").alias(f"{prefix}{c}") for c in buffer]), comm)


def all_to_all(df: DataFrame, block: int, rank: str = "rank", idx: str = "idx") -> DataFrame:
    """Block ``i`` of rank ``r`` becomes block ``r`` of rank ``i``.

    In long form this only renames keys, so it is a projection without a shuffle.
    """
    to = F.call_function("div", F.col(idx).cast("bigint"), F.lit(block))
    at = F.col(rank).cast("bigint") * block + F.col(idx) % block
    return df.withColumns({rank: to, idx: at})


def to_buffers(df: DataFrame, comm: list[str], rank: str = "rank", idx: str = "idx", value: str = "value") -> DataFrame:
    """Elements back to one array per rank; a rank's buffer must fit one row."""
    parts = F.array_sort(F.collect_list(F.struct(idx, value)))
    return df.groupBy(*comm, rank).agg(F.transform(parts, lambda p: p[value]).alias("buffer"))


def split(
    df: DataFrame,
    color: str,
    rank: str,
    key: str | None = None,
    honor_key: bool = False,
    parent: list[str] | None = None,
    **limits: int,
) -> DataFrame:
    """Form one communicator per color and number its ranks from 0 in origin order.

    ``honor_key`` orders by ``key`` first.  A numeric color below 0 is an error.
    """
    kind = dict(df.dtypes)[color]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        bad = F.raise_error(F.concat(F.lit("negative color "), F.col(color).cast("string"))).cast(kind)
        df = df.withColumn(color, F.when(F.col(color) >= 0, F.col(color)).otherwise(bad))
    order = [key, rank] if honor_key and key else [rank]
    return row_number(df, [*(parent or []), color], order, "new_rank", start=0, **limits)


def translate(ranks: DataFrame, comm: str, rank: str, table: DataFrame) -> DataFrame:
    """Follow ranks up to their world ranks, however deep their communicators are nested.

    ``table`` has ``(comm, parent_comm, origin_rank, new_rank)``; the world has no rows in it.  The result adds
    ``world_rank``.  Every row points to its parent; each round points it to where its target points, so pointers
    double their length and depth d takes log2(d) rounds.  Communicators nested in one another's children
    and an origin rank that its parent does not have are errors.
    """
    jumps = cut(table.select(
        F.col("comm").alias("_comm"), F.col("new_rank").alias("_rank"),
        F.col("parent_comm").alias("_up"), F.col("origin_rank").alias("_origin"),
    ), "jumps")
    comms = jumps.select(F.col("_comm").alias("_known")).distinct()
    rounds, moved = 0, True
    while moved:
        # More than 64 levels are rare enough to count the communicators, of which no path has more.
        if rounds > 6 and rounds > comms.count().bit_length():
            raise ValueError("communicators are nested in a cycle")
        further = jumps.select(
            F.col("_comm").alias("_up"), F.col("_rank").alias("_origin"), F.struct("_up", "_origin").alias("_next")
        )
        jumps = cut(jumps.join(further, ["_up", "_origin"], "left").select(
            "_comm", "_rank", F.coalesce("_next._up", "_up").alias("_up"),
            F.coalesce("_next._origin", "_origin").alias("_origin"), F.col("_next").isNotNull().alias("_moved"),
        ), "jumps")
        moved = not jumps.filter("_moved").isEmpty()
        rounds += 1
    lost = jumps.join(comms, F.col("_up") == F.col("_known"), "left_semi").select("_up", "_origin").first()
    if lost is not None:
        raise ValueError(f"no rank {lost[1]} in communicator {lost[0]}")
    ends = jumps.select(F.col("_comm").alias(comm), F.col("_rank").alias(rank), F.col("_origin").alias("_world"))
    return ranks.join(ends, [comm, rank], "left").withColumn("world_rank", F.coalesce("_world", rank)).drop("_world")

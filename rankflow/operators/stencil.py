"""Neighbour exchange and the one-dimensional three-point stencil.

The line is cut into buckets of ``2**bits`` positions.  Each bucket also gets
the rows within ``halo`` positions of its edges, after which ``halo`` iterations
run locally: all of them share one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.plans import cut

BUCKET_BITS = 14
MAX_HALO = 8


def _same(value: Column) -> Column:
    return value


def with_halo(df: DataFrame, position: str, halo: int, bits: int = BUCKET_BITS) -> DataFrame:
    """Rows with their bucket, edge rows also in the neighbour's bucket (``_own`` is false there)."""
    if halo > 1 << bits:
        raise ValueError("halo wider than a bucket")
    at = F.col(position).cast("bigint")
    own = F.shiftright(at, bits)
    targets = F.array_distinct(F.array(own, F.shiftright(at - halo, bits), F.shiftright(at + halo, bits)))
    return df.withColumn("_bucket", F.explode(targets)).withColumn("_own", F.col("_bucket") == own)


def neighbours(
    df: DataFrame, position: str, line: list[str], below: dict[str, Column], above: dict[str, Column],
    bits: int = BUCKET_BITS,
) -> DataFrame:
    """Values of the row one position below and one above; null at the ends of a line or at a gap."""
    window = Window.partitionBy(*line, "_bucket").orderBy(position)
    rows = with_halo(df, position, 1, bits)

    def next_to(near, step):
        return near(position).over(window) == F.col(position) + step

    columns = {n: F.when(next_to(F.lag, -1), F.lag(c).over(window)) for n, c in below.items()}
    columns |= {n: F.when(next_to(F.lead, 1), F.lead(c).over(window)) for n, c in above.items()}
    return rows.withColumns(columns).filter("_own").drop("_bucket", "_own")


def stencil_rows(
    df: DataFrame,
    position: str,
    value: str,
    iterations: int,
    line: list[str] | None = None,
    work: Callable[[Column], Column] = _same,
    bits: int = BUCKET_BITS,
    halo: int = MAX_HALO,
) -> DataFrame:
    """``a[i] = (t[i-1] + t[i] + t[i+1]) / 3`` with ``t = work(a)``; both ends keep their value.

    A row next to a gap in the positions is an end.
    """
    line = line or []
    window = Window.partitionBy(*line, "_bucket").orderBy(position)
    left = iterations
    while left > 0:
        steps = min(left, halo)
        rows = with_halo(df, position, steps, bits)
        for _ in range(steps):
            rows = rows.withColumn("_t", work(F.col(value)))
            low = F.when(F.lag(position).over(window) == F.col(position) - 1, F.lag("_t").over(window))
            high = F.when(F.lead(position).over(window) == F.col(position) + 1, F.lead("_t").over(window))
            rows = rows.withColumns({"_low": low, "_high": high})
            inside = F.col("_low").isNotNull() & F.col("_high").isNotNull()
            average = (F.col("_low") + F.col("_t") + F.col("_high")) / 3.0
            rows = rows.withColumn(value, F.when(inside, average).otherwise(F.col(value)))
        df = rows.filter("_own").drop("_bucket", "_own", "_t", "_low", "_high")
        left -= steps
        if left > 0:
            df = cut(df, "stencil")
    return df


def stencil_arrays(
    df: DataFrame,
    rank: str,
    buffer: str,
    iterations: int,
    line: list[str] | None = None,
    work: Callable[[Column], Column] = _same,
    bits: int = BUCKET_BITS,
    halo: int = MAX_HALO,
) -> DataFrame:
    """The same stencil over rank buffers laid end to end; a missing rank ends the line.

    A round takes at most as many steps as the shortest buffer has elements; empty buffers are an error.
    """
    line = line or []
    shortest = df.agg(F.min(F.size(buffer))).first()[0]
    if shortest is not None and shortest < 1:
        raise ValueError("an empty or missing buffer")
    halo = min(halo, shortest or halo)
    window = Window.partitionBy(*line, "_bucket").orderBy(rank)
    left = iterations
    while left > 0:
        steps = min(left, halo)
        rows = with_halo(df, rank, 1, bits)
        own = F.col(buffer).cast("array<double>")
        rows = rows.withColumns({
            "_tail": F.slice(own, -steps, steps),
            "_head": F.slice(own, 1, steps),
            buffer: F.when(F.col("_own"), own),
        })
        nothing = F.array().cast("array<double>")
        rows = rows.withColumns({
            "_low": F.coalesce(F.when(F.lag(rank).over(window) == F.col(rank) - 1, F.lag("_tail").over(window)), nothing),
            "_high": F.coalesce(F.when(F.lead(rank).over(window) == F.col(rank) + 1, F.lead("_head").over(window)), nothing),
        }).filter("_own")
        whole = F.concat("_low", F.col(buffer), "_high")
        done = F.reduce(F.sequence(F.lit(1), F.lit(steps)), whole, lambda t, _: _step(t, work))
        result = F.slice(done, F.size("_low") + 1, F.size(buffer))
        df = rows.withColumn(buffer, result).drop("_bucket", "_own", "_tail", "_head", "_low", "_high")
        left -= steps
        if left > 0:
            df = cut(df, "stencil")
    return df


def _step(a: Column, work: Callable[[Column], Column]) -> Column:
    last = F.size(a) - 1

    def average(x, i):
        return (work(F.get(a, i - 1)) + work(x) + work(F.get(a, i + 1))) / 3.0

    return F.transform(a, lambda x, i: F.when((i > 0) & (i < last), average(x, i)).otherwise(x))

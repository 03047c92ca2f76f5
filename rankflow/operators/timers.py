"""Timer intervals and timer totals over ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.functions.ratios import band, percent
from rankflow.plans import attach, row_number


def rebase(intervals: DataFrame, origins: DataFrame, run: list[str], start: str, end: str, origin: str) -> DataFrame:
    """Start and end relative to the run's origin, and the duration."""
    out = attach(intervals, origins.select(*run, F.col(origin).alias("_origin")), run, "inner")
    return out.withColumns({
        "start_from_origin": F.col(start) - F.col("_origin"),
        "end_from_origin": F.col(end) - F.col("_origin"),
        "duration": F.col(end) - F.col(start),
    }).drop("_origin")


def within_run(start: Column, end: Column, origin: Column, termination: Column) -> Column:
    """True for intervals that touch ``[origin, termination]``; those are kept whole."""
    return ~((origin > end) | (termination < start))


def timer_stats(df: DataFrame, timer: list[str], elapsed: str) -> DataFrame:
    """Least, greatest and mean time over ranks."""
    return df.groupBy(*timer).agg(
        F.min(elapsed).alias("min_elapsed"), F.max(elapsed).alias("max_elapsed"), F.avg(elapsed).alias("mean_elapsed")
    )


def slowest_rank(per_rank: DataFrame, timer: list[str], rank: str, elapsed: str, total: str) -> DataFrame:
    """Greatest time, its lowest rank, rounded mean of the non-zero times, and that rank's share of its own total.

    A share above 100 percent fails.
    """
    top = F.max(F.struct(F.col(elapsed).alias("e"), (-F.col(rank)).alias("r"), F.col(total).alias("t")))
    rows = per_rank.groupBy(*timer).agg(
        top.alias("_top"), F.round(F.avg(F.nullif(F.col(elapsed), F.lit(0)))).cast("bigint").alias("mean_nonzero")
    )
    share = F.round(percent(F.col("_top.e"), F.col("_top.t")), 2)
    checked = F.when(share > 100, F.raise_error(F.lit("share above 100 percent")).cast("double")).otherwise(share)
    return rows.select(
        *timer,
        F.col("_top.e").alias("max_elapsed"),
        (-F.col("_top.r")).alias("max_rank"),
        "mean_nonzero",
        checked.alias("share"),
        band(share).alias("band"),
    )


def timer_share(timers: DataFrame, doc: list[str], name: str, index: str, elapsed: str, total: str) -> DataFrame:
    """Each timer's percentage of its document's end-to-end time, with its place from the largest down.

    Of timers with one name the last index counts.  A document has at most a
    few dozen timers, so the window groups are small.
    """
    last = timers.groupBy(*doc, name).agg(
        F.max_by(elapsed, index).alias(elapsed), F.max(total).alias(total)
    )
    share = last.withColumn("share", percent(F.col(elapsed), F.col(total)))
    window = Window.partitionBy(*doc).orderBy(F.desc("share"), name)
    return share.select(*doc, name, "share", F.row_number().over(window).cast("bigint").alias("place"))


def sequence(df: DataFrame, group: list[str], order: list[str], **limits: int) -> DataFrame:
    """Sequence number from 0 in each group, and the group's row count on every row."""
    return row_number(df, group, order, "sequence_number", start=0, total="total_num", **limits)


def order_intervals(df: DataFrame, rank: str, start: str, tie: str, **limits: int) -> DataFrame:
    """Place of each interval in its rank's order of starts."""
    return row_number(df, [rank], [start, tie], "place", **limits)


def written_in_order(df: DataFrame, rank: str, start: str, pieces: int) -> DataFrame:
    """Rows arranged by rank and start for writing; a large rank is cut into ranges, not sent to one task."""
    return df.repartitionByRange(pieces, rank, start).sortWithinPartitions(rank, start)

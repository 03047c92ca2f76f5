"""Expansion of range lists such as ``0-11,24-35`` and ``name[01-03]``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.plans import cut, running_max

STEP = 1 << 14
HOSTS = r"^(.*?)\[(.*)\]$"


def _pieces(lo: Column, hi: Column) -> Column:
    # A wide range is first cut into steps: no row ever holds a whole range.
    return F.transform(
        F.sequence(lo, hi, F.lit(STEP).cast("bigint")),
        lambda at: F.struct(at.alias("lo"), F.least(at + (STEP - 1), hi).alias("hi")),
    )


def range_ends(df: DataFrame, spec: str, keep: list[str]) -> DataFrame:
    """``_lo`` and ``_hi`` of every part of a comma-separated list of numbers and ``a-b`` ranges."""
    parts = df.select(*keep, F.explode(F.split(spec, ",")).alias("_part"))
    ends = F.split(F.trim("_part"), "-")
    lo, hi = F.get(ends, F.lit(0)).cast("bigint"), F.get(ends, F.size(ends) - 1).cast("bigint")
    return parts.select(*keep, lo.alias("_lo"), hi.alias("_hi"))


def range_counts(df: DataFrame, spec: str, keys: list[str], **limits: int) -> DataFrame:
    """Members, different members and repeated ones of each group's range lists, without listing any.

    Ranges are swept in order of their first member with the largest last member so far: what
    lies below that was there before.  A group may have any number of ranges, and a range any length below 2**62.
    """
    ranges = cut(range_ends(df, spec, keys).withColumn("_tie", F.monotonically_increasing_id()), "ranges")
    swept = running_max(ranges, keys, ["_lo", "_hi", "_tie"], "_hi", "_reached", **limits)
    before = F.coalesce(F.col("_reached"), F.col("_lo") - 1)
    again = F.greatest(F.least(F.col("_hi"), before) - F.col("_lo") + 1, F.lit(0))
    wide = lambda c: F.sum(c.cast("decimal(20,0)")).cast("decimal(30,0)")
    counts = swept.groupBy(*keys).agg(
        wide(F.col("_hi") - F.col("_lo") + 1).alias("n_members"), wide(again).alias("n_repeated")
    )
    distinct = (F.col("n_members") - F.col("n_repeated")).cast("decimal(30,0)")
    return counts.select(*keys, "n_members", distinct.alias("n_distinct"), "n_repeated")


def check_ranges(df: DataFrame, spec: str, keys: list[str]) -> DataFrame:
    """The counts of ``range_counts``; fails where a group names a member twice."""
    counts = range_counts(df, spec, keys)
    bad = F.raise_error(F.concat(F.lit("repeated members in ranges: "), F.col("n_repeated").cast("string"))).cast("boolean")
    return counts.filter(F.when(F.col("n_repeated") > 0, bad).otherwise(F.lit(True)))


def expand_ranges(df: DataFrame, spec: str, name: str = "item", keep: list[str] | None = None) -> DataFrame:
    """One row per member of a comma-separated list of numbers and ``a-b`` ranges."""
    keep = keep or [c for c in df.columns if c != spec]
    pieces = range_ends(df, spec, keep).select(
        *keep, F.explode(_pieces(F.col("_lo"), F.col("_hi"))).alias("_p")
    )
    # The pieces of one wide range go to all tasks; a fixed number keeps them apart.
    pieces = pieces.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return pieces.select(*keep, F.explode(F.sequence("_p.lo", "_p.hi")).alias(name))


def expand_hosts(df: DataFrame, spec: str, name: str = "host", keep: list[str] | None = None) -> DataFrame:
    """``node[01-03]`` to ``node01`` .. ``node03``, keeping leading zeros."""
    keep = keep or [c for c in df.columns if c != spec]
    inside = F.regexp_extract(spec, HOSTS, 2)
    first = F.get(F.split(inside, "-"), F.lit(0))
    work = df.select(
        *keep,
        F.regexp_extract(spec, HOSTS, 1).alias("_base"),
        F.length(first).alias("_width"),
        inside.alias("_inside"),
    )
    numbers = expand_ranges(work, "_inside", "_n", [*keep, "_base", "_width"])
    digits = F.col("_n").cast("string")
    padded = F.lpad(digits, F.greatest(F.col("_width"), F.length(digits)), F.lit("0"))
    return numbers.select(*keep, F.concat("_base", padded).alias(name))


def check_unique(df: DataFrame, keys: list[str], message: str = "duplicate entries") -> DataFrame:
    """One row with the number of distinct keys; fails when a key occurs twice."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    worst = F.max("_n")
    return counts.agg(
        F.when(F.coalesce(worst, F.lit(0)) <= 1, F.count(F.lit(1))).otherwise(F.raise_error(F.lit(message))).alias(
            "n_unique"
        )
    )

"""Numbering, prefix sums and previous values inside ordered groups of any size.

A window runs one group in one task.  A group larger than ``group_rows`` is
first split by the high bits of its order key, starting at the highest bit in
which its keys differ; pieces still too large are split again the same way,
then by the next order key, until every piece is below the limit.  The pieces'
totals are scanned in small windows (at most ``2**FAN_BITS`` rows each) and
added to the local results.  ``order`` must be unique inside a group and
integral: any distribution of keys then ends in pieces of bounded size, and the
piece is a function of the row alone, so a retried task agrees with the first
run.  Null keys come first, as in a window, in a piece of their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.plans.shared import cut, null_safe

GROUP_ROWS = 1 << 20
FAN_BITS = 14
LEAST_BITS = 10
# A table that would fit one window is still given a few tasks.
SMALL_TABLE_BITS = 3
# The piece of null keys; sorts before all others.
NULL_PIECE = -(1 << 63)


@dataclass
class OrderedGroups:
    """A DataFrame whose window groups are ``partition + splits``."""

    df: DataFrame
    partition: list[str]
    order: list[str]
    splits: list[str] = field(default_factory=list)

    @property
    def groups(self) -> list[str]:
        return self.partition + self.splits

    def window(self, ordered: bool = True):
        window = Window.partitionBy(*(self.groups or [F.lit(0)]))
        return window.orderBy(*self.order) if ordered else window

    def closed(self) -> OrderedGroups:
        """Without the working column."""
        self.df = self.df.drop("_open")
        return self

    def split_totals(self, *totals: Column) -> DataFrame:
        """Aggregates of every piece of the groups that were split."""
        return self.df.filter(F.coalesce(*self.splits).isNotNull()).groupBy(*self.groups).agg(*totals)


def split_groups(
    df: DataFrame,
    partition: list[str],
    order: list[str],
    group_rows: int = GROUP_ROWS,
) -> OrderedGroups:
    """Add split columns until no window group exceeds ``group_rows`` rows.

    Each round is one aggregation over the rows of the groups that were too
    large in the round before; a table without large groups takes one round.
    """
    out = OrderedGroups(df, list(partition), list(order))
    for key in order:
        while True:
            rows = out.df.filter("_open") if "_open" in out.df.columns else out.df
            stats = rows.groupBy(*out.groups).agg(
                F.count(F.lit(1)).alias("_n"), F.count(key).alias("_keys"), F.min(key).alias("_lo"), F.max(key).alias("_hi")
            )
            large = _large_groups(stats, group_rows, whole=not out.groups)
            seen = large.agg(F.max("_n").alias("n"), F.max("_shift").alias("shift")).first()
            if seen.n is None:
                return out.closed()
            if seen.shift is None:
                break  # all keys of these groups are equal: the next order key decides
            _add_split(out, large, key, seen.shift)
            if seen.n <= group_rows:
                return out.closed()
    return out.closed()


def _large_groups(stats: DataFrame, group_rows: int, whole: bool) -> DataFrame:
    """Groups to split, with how far to shift their key; no shift where all keys are equal."""

    def bits(c):
        return F.length(F.bin(c))

    enough = bits(F.call_function("div", F.col("_n") * 4, F.lit(group_rows)))
    wanted = F.least(F.lit(FAN_BITS), F.greatest(F.lit(LEAST_BITS), enough))
    if whole:
        wanted = F.when(F.col("_n") <= group_rows, SMALL_TABLE_BITS).otherwise(wanted)
    differ = F.col("_lo").cast("bigint").bitwiseXOR(F.col("_hi").cast("bigint"))
    shift = F.when(differ != 0, F.greatest(bits(differ) - wanted, F.lit(0)))
    # Where all keys that are not null are equal, nulls still have to be told apart from them.
    shift = F.coalesce(shift, F.when((F.col("_keys") > 0) & (F.col("_keys") < F.col("_n")), F.lit(0)))
    # A table without groups is one group and always split.
    large = stats.filter(F.col("_n") > (0 if whole else group_rows)).withColumn("_shift", shift)
    return large if whole else cut(large, "large")


def _add_split(out: OrderedGroups, large: DataFrame, key: str, shift: int) -> None:
    name = f"_split{len(out.splits)}"
    at = F.col(key).cast("bigint")
    if out.groups:
        flags = large.select(*out.groups, F.lit(True).alias("_large"), "_shift")
        marked = null_safe(out.df.drop("_open"), flags, out.groups)
        piece = F.when(F.col("_large"), F.coalesce(F.call_function("shiftright", at, F.col("_shift")), F.lit(NULL_PIECE)))
        out.df = marked.withColumns({name: piece, "_open": F.coalesce("_large", F.lit(False))}).drop("_large", "_shift")
    else:
        piece = F.coalesce(F.shiftright(at, shift), F.lit(NULL_PIECE))
        out.df = out.df.withColumns({name: piece, "_open": F.lit(True)})
    out.splits.append(name)


def _level(out: OrderedGroups, depth: int) -> tuple[list[str], object]:
    """Key columns of a split level and the window over one parent's pieces."""
    keys = out.partition + out.splits[:depth]
    return keys, Window.partitionBy(*(keys[:-1] or [F.lit(0)])).orderBy(keys[-1])


def _join_bases(out: OrderedGroups, df: DataFrame, bases: DataFrame) -> DataFrame:
    # One level below no partition has at most 2**FAN_BITS rows.
    if not out.partition and len(out.splits) == 1:
        return null_safe(df, F.broadcast(bases), out.groups)
    return null_safe(df, cut(bases, "bases"), out.groups)


def _sum_bases(out: OrderedGroups, totals: DataFrame, names: list[str], depth: int) -> DataFrame:
    keys, window = _level(out, depth)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in names])
    if depth == 1:
        return bases
    parents = totals.groupBy(*keys[:-1]).agg(*[F.sum(n).alias(n) for n in names])
    upper = _sum_bases(out, parents, names, depth - 1)
    upper = upper.select(*keys[:-1], *[F.col(n).alias(f"_up{n}") for n in names])
    both = null_safe(bases, upper, keys[:-1])
    return both.select(*keys, *[(F.col(n) + F.col(f"_up{n}")).alias(n) for n in names])


def running_sum(
    df: DataFrame,
    partition: list[str],
    order: list[str],
    sums: dict[str, str | Column],
    inclusive: bool = True,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Prefix sums over each ordered group; the first exclusive value is 0 and a null adds nothing."""
    out = split_groups(df, partition, order, group_rows)
    names = {name: f"_base_{i}" for i, name in enumerate(sums)}
    values = {name: F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit(0)) for name, v in sums.items()}
    frame = out.window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = {n: F.sum(v).over(frame) for n, v in values.items()}
    if not inclusive:
        local = {n: F.coalesce(v, F.lit(0)) for n, v in local.items()}
    work = out.df.withColumns(local)
    if out.splits:
        totals = out.split_totals(*[F.sum(values[n]).alias(b) for n, b in names.items()])
        # Joined after the window, so the shuffle does not carry the bases.
        work = _join_bases(out, work, _sum_bases(out, totals, list(names.values()), len(out.splits)))
        work = work.withColumns({n: F.col(n) + F.coalesce(F.col(b), F.lit(0)) for n, b in names.items()})
    return work.drop(*out.splits, *names.values())


def running_max(
    df: DataFrame, partition: list[str], order: list[str], column: str, name: str, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """The largest value of the rows before each row of an ordered group; null on the first one."""
    out = split_groups(df, partition, order, group_rows)
    before = out.window().rowsBetween(Window.unboundedPreceding, -1)
    work = out.df.withColumn(name, F.max(column).over(before))
    if out.splits:
        totals = out.split_totals(F.max(column).alias("_base"))
        work = _join_bases(out, work, _max_bases(out, totals, len(out.splits)))
        work = work.withColumn(name, F.greatest(F.col(name), F.col("_base")))
    return work.drop(*out.splits, "_base")


def _max_bases(out: OrderedGroups, totals: DataFrame, depth: int) -> DataFrame:
    """The largest value before each piece, over all pieces of its group."""
    keys, window = _level(out, depth)
    bases = totals.select(*keys, F.max("_base").over(window.rowsBetween(Window.unboundedPreceding, -1)).alias("_base"))
    if depth == 1:
        return bases
    upper = _max_bases(out, totals.groupBy(*keys[:-1]).agg(F.max("_base").alias("_base")), depth - 1)
    both = null_safe(bases, upper.withColumnRenamed("_base", "_up"), keys[:-1])
    return both.select(*keys, F.greatest("_base", "_up").alias("_base"))


def row_number(
    df: DataFrame,
    partition: list[str],
    order: list[str],
    name: str = "row_num",
    start: int = 1,
    group_rows: int = GROUP_ROWS,
    total: str | None = None,
) -> DataFrame:
    """Number the rows of each ordered group from ``start``; ``total`` also puts the group's size on every row."""
    out = split_groups(df, partition, order, group_rows)
    work = out.df.withColumn(name, F.row_number().over(out.window()).cast("bigint") + F.lit(start - 1))
    if total:
        work = work.withColumn(total, F.count(F.lit(1)).over(out.window(ordered=False)))
    if out.splits:
        totals = out.split_totals(F.count(F.lit(1)).alias("_base"))
        if total and not out.partition:
            work = work.withColumn(total, totals.agg(F.sum("_base")).scalar())
        elif total:
            sizes = totals.groupBy(*out.partition).agg(F.sum("_base").alias("_size"))
            work = null_safe(work, cut(sizes, "sizes"), out.partition)
            work = work.withColumn(total, F.coalesce("_size", total)).drop("_size")
        work = _join_bases(out, work, _sum_bases(out, totals, ["_base"], len(out.splits)))
        work = work.withColumn(name, F.col(name) + F.coalesce(F.col("_base"), F.lit(0)))
    return work.drop(*out.splits, "_base")


def previous_value(
    df: DataFrame,
    partition: list[str],
    order: list[str],
    columns: dict[str, str],
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """The value of the row before, per ordered group; null on its first row."""
    out = split_groups(df, partition, order, group_rows)
    row = F.struct(*[F.col(c).alias(name) for name, c in columns.items()])
    work = out.df.withColumn("_before", F.lag(row).over(out.window()))
    if out.splits:
        at = F.struct(*out.order)
        last = out.split_totals(F.max_by(row, at).alias("_last"), F.max(at).alias("_at"))
        work = _join_bases(out, work, _carry(out, last, len(out.splits)))
        work = work.withColumn("_before", F.coalesce("_before", "_carry"))
    keep = [c for c in out.df.columns if c not in out.splits]
    return work.select(*keep, *[F.col(f"_before.{name}").alias(name) for name in columns])


def _carry(out: OrderedGroups, last: DataFrame, depth: int) -> DataFrame:
    keys, window = _level(out, depth)
    carry = last.select(*keys, F.lag("_last").over(window).alias("_carry"))
    if depth == 1:
        return carry
    parents = last.groupBy(*keys[:-1]).agg(F.max_by("_last", "_at").alias("_last"), F.max("_at").alias("_at"))
    upper = _carry(out, parents, depth - 1).withColumnRenamed("_carry", "_up")
    both = null_safe(carry, upper, keys[:-1])
    return both.select(*keys, F.coalesce("_carry", "_up").alias("_carry"))

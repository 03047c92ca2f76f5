"""Sums of doubles that do not depend on the order of addition.

A double is a whole number times a power of two.  Each value is cut into whole numbers of at
most 2**25 at fixed binary places, ``WIDTH`` bits apart; the numbers of one place are added up as integers,
which is exact in any order, and one row per place and group is joined to the exact
sum, rounded once to the nearest double (ties to even).  The result is the same bits for any number of partitions,
retries and row orders.

A value takes part in at most four places, a group has at most 88, and tasks add up their own rows
before the shuffle.  One place holds 2**38 values before its integer sum overflows, which fails the query.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits between two places, and the exponent of the lowest place: that of the smallest double.
WIDTH, LOWEST = 24, -1074
PLACES = (1024 - LOWEST) // WIDTH + 1
#: Places above the highest that carries may reach.
SPARE = 3


def _highest(value: Column) -> Column:
    """The highest place of a double; null for null and values that are not finite.

    A logarithm that is rounded to the next place still leaves four digits that hold all bits.
    """
    high = F.floor((F.log2(F.abs(value)) - LOWEST) / WIDTH)
    finite = F.abs(value) <= F.lit(1.7976931348623157e308)
    return F.when(finite, F.least(F.greatest(high, F.lit(3)), F.lit(PLACES - 1)).cast("int"))


def _scaled(value: Column, high: Column) -> Column:
    """The value in units of its highest place; dividing by a power of two is exact."""
    return value / F.get(F.array(*[F.lit(2.0 ** (LOWEST + WIDTH * i)) for i in range(PLACES)]), high)


def _digit(scaled: Column, i: int) -> Column:
    """The digit ``i`` places below the highest; remainders of doubles are exact, the cast cuts towards zero."""
    return (scaled if i == 0 else scaled * F.lit(2.0 ** (WIDTH * i)) % F.lit(2.0**WIDTH)).cast("bigint")


def joined(pairs: Column) -> Column:
    """The double nearest to the sum of digit * 2**place, from one (place, digit) pair per place."""
    low, high = F.array_min(F.transform(pairs, lambda p: p["place"])), F.array_max(F.transform(pairs, lambda p: p["place"]))
    held = F.map_from_entries(pairs)
    # From the lowest place to the carries' last one; few places are ever used at once.
    plain = F.transform(F.sequence(low, high + SPARE), lambda i: F.coalesce(F.element_at(held, i), F.lit(0).cast("bigint")))
    negative = _carried(plain)["carry"] < 0
    sign = F.when(negative, F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
    # A list of one list is worked on once, however often it is read.
    return F.transform(F.array(_carried(F.transform(plain, lambda d: d * sign))["digits"]), lambda d: _rounded(d, low) * sign)[0]


def _carried(digits: Column) -> Column:
    """Digits from 0 to 2**WIDTH - 1 and the carry, which is -1 where the sum is negative."""
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("digits"))

    def step(a: Column, d: Column) -> Column:
        total = a["carry"] + d
        return F.struct(
            F.shiftright(total, WIDTH).alias("carry"),
            F.concat(a["digits"], F.array(total.bitwiseAND(F.lit((1 << WIDTH) - 1)))).alias("digits"),
        )

    return F.aggregate(digits, start, step)


def _rounded(digits: Column, low: Column) -> Column:
    """The nearest double of digits that are not negative, the first of them at place ``low``."""
    top = F.array_max(F.transform(digits, lambda d, i: F.when(d > 0, i)))
    # The first four digits hold 73 bits or more; what follows only decides ties, as one more bit.
    four = [F.coalesce(F.get(digits, top - i), F.lit(0)).cast("decimal(38,0)") for i in range(4)]
    head = fold(lambda a, d: (a * F.lit(1 << WIDTH).cast("decimal(8,0)") + d).cast("decimal(38,0)"), four[1:], four[0])
    more = F.exists(F.slice(digits, 1, F.greatest(top - 3, F.lit(0))), lambda d: d > 0)
    whole = (head * F.lit(2).cast("decimal(1,0)") + F.when(more, 1).otherwise(0).cast("decimal(1,0)")).cast("decimal(38,0)")
    # In two steps, so that neither factor leaves the range of doubles; powers of two do not round.
    shift = (low + top - 3) * WIDTH + LOWEST - 1
    half = F.floor(shift / 2)
    return F.coalesce(whole.cast("double") * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), shift - half), F.lit(0.0))


def exact_sums(df: DataFrame, keys: list[str], sums: dict[str, str], others: dict[str, tuple] | None = None) -> DataFrame:
    """Groups of ``keys`` with exact sums of double columns (name -> column).

    ``others`` maps further names to (function, column) where the function gives the same over partial results: sum
    of integers, min, max, product.  All come out of one scan: a row is dealt into one row per digit, of
    which the first also carries the other columns.  A sum of nulls only is null; infinities and NaN act as in a plain sum.
    """
    others = others or {}
    work = df.select(*keys, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(sums.values())],
                     *[F.col(c).alias(f"_o{i}") for i, (_, c) in enumerate(others.values())])
    work = work.withColumns({f"_k{i}": _highest(F.col(f"_v{i}")) for i in range(len(sums))})
    work = work.withColumns({f"_x{i}": _scaled(F.col(f"_v{i}"), F.col(f"_k{i}")) for i in range(len(sums))})

    def entry(of: int, place: Column, digit: Column) -> Column:
        return F.struct(F.lit(of).alias("of"), place.alias("place"), digit.alias("digit"))

    listed = [entry(-1, F.lit(0), F.lit(0).cast("bigint"))]
    listed += [entry(i, F.col(f"_k{i}") - j, _digit(F.col(f"_x{i}"), j)) for i in range(len(sums)) for j in range(4)]
    whole = F.col("_p.of") == -1
    # What a digit cannot carry: whether there was a value at all, and values that are not finite.
    odd = lambda v: F.when(whole & (F.isnan(v) | (F.abs(v) == float("inf"))), F.col(v))
    rows = work.withColumn("_p", F.explode(F.array(*listed))).filter("_p.of < 0 OR _p.digit <> 0").select(
        *keys, "_p.of", "_p.place", "_p.digit",
        *[F.when(whole & F.col(f"_v{i}").isNotNull(), F.lit(True)).alias(f"_some{i}") for i in range(len(sums))],
        *[odd(f"_v{i}").alias(f"_odd{i}") for i in range(len(sums))],
        *[F.when(whole, F.col(f"_o{i}")).alias(f"_o{i}") for i in range(len(others))],
    )
    partial = rows.groupBy(*keys, "of", "place").agg(
        F.sum("digit").alias("digit"),
        *[F.bool_or(f"_some{i}").alias(f"_some{i}") for i in range(len(sums))],
        *[F.sum(f"_odd{i}").alias(f"_odd{i}") for i in range(len(sums))],
        *[f(F.col(f"_o{i}")).alias(f"_o{i}") for i, (f, _) in enumerate(others.values())],
    )
    pair = F.struct("place", "digit")
    groups = partial.groupBy(*keys).agg(
        *[F.collect_list(F.when(F.col("of") == i, pair)).alias(f"_d{i}") for i in range(len(sums))],
        *[F.bool_or(f"_some{i}").alias(f"_some{i}") for i in range(len(sums))],
        *[F.sum(f"_odd{i}").alias(f"_odd{i}") for i in range(len(sums))],
        *[f(F.col(f"_o{i}")).alias(name) for i, (name, (f, _)) in enumerate(others.items())],
    )

    def result(i: int) -> Column:
        exact = F.when(F.size(f"_d{i}") > 0, joined(F.col(f"_d{i}"))).otherwise(F.lit(0.0))
        return F.when(F.col(f"_some{i}"), F.coalesce(f"_odd{i}", exact))

    return groups.select(*keys, *[result(i).alias(name) for i, name in enumerate(sums)], *others)

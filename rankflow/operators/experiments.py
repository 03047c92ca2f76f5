"""Experiments, runs and their results: joins, grids, checks, medians, speed-ups."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.functions.ratios import percent
from rankflow.plans import attach, cut, row_number
from rankflow.plans.shared import null_safe

# Default of spark.sql.optimizer.windowGroupLimitThreshold.
WINDOW_LIMIT = 1000


def star(experiments: DataFrame, runs: DataFrame, ranks: DataFrame, experiment: str, run: str) -> DataFrame:
    """Ranks with their run and experiment; Spark broadcasts a dimension only below its size limit."""
    return ranks.join(runs, run).join(experiments, experiment)


def with_common_values(rows: DataFrame, common: DataFrame, run: list[str]) -> DataFrame:
    """A run's common values on each of its rank rows."""
    return attach(rows, common, run, "inner")


def parameter_grid(
    df: DataFrame, options: dict[str, list], dependent: str, values: list, used: Column, sentinel
) -> DataFrame:
    """Every row with every combination of ``options``.

    ``dependent`` takes ``values`` where ``used`` holds and the one ``sentinel``
    elsewhere.  The grid is a set of literals, multiplied out by explode.
    """
    for name, choices in options.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(c) for c in choices])))
    several, one = F.array(*[F.lit(v) for v in values]), F.array(F.lit(sentinel))
    return df.withColumn(dependent, F.explode(F.when(used, several).otherwise(one)))


def chunked_channel(version: Column) -> Column:
    """Versions 460 to 499 take a number of chunks."""
    return version.between(460, 499)


def duplicate_configs(df: DataFrame, keys: list[str], allowed: int) -> DataFrame:
    """Configurations that occur more than ``allowed`` times."""
    label = F.concat_ws("-", *[F.col(k).cast("string") for k in keys])
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > allowed).select(label.alias("config"), "n")


def completeness(
    expected: DataFrame, found: DataFrame, job: list[str], want: str, have: str, factors: tuple[int, ...] = (1, 2, 4)
) -> DataFrame:
    """Status of every job: failed with too few results, surplus with more, and whether the row builder accepts it."""
    both = expected.join(found, job, "left").withColumn(have, F.coalesce(have, F.lit(0)))
    status = F.when(F.col(have) < F.col(want), "failed").when(F.col(have) > F.col(want), "surplus").otherwise("ok")
    accepted = fold(lambda a, b: a | b, [F.col(have) == F.col(want) * f for f in factors])
    return both.withColumns({"status": status, "accepted": accepted})


def within_tolerance(actual: Column, lines: Column, files: Column, limit: float = 0.01) -> Column:
    """A combined table may be at most ``limit`` larger than its inputs less their headers."""
    wanted = lines - files + 1
    return (actual - wanted) / wanted <= limit


def config_median(df: DataFrame, config: list[str], run: list[str], elapsed: str, **limits: int) -> DataFrame:
    """Median over a configuration's runs of each run's slowest rank; ``elapsed`` is a whole number.

    The middle places are picked by number, so a configuration may have any
    number of runs.  Runs without a time count in ``n_runs`` only; a
    configuration without any time has a null median.
    """
    slowest = df.groupBy(*config, *run).agg(F.max(elapsed).alias("_slowest"))
    runs = cut(slowest.withColumn("_tie", F.xxhash64(*run)), "runs")
    timed = runs.filter(F.col("_slowest").isNotNull())
    counted = row_number(timed, config, ["_slowest", "_tie"], "_place", total="_timed", **limits)
    low = F.call_function("div", F.col("_timed") + 1, F.lit(2))
    high = F.call_function("div", F.col("_timed") + 2, F.lit(2))
    middle = counted.filter(F.col("_place").between(low, high))
    medians = middle.groupBy(*config).agg(F.avg("_slowest").alias("median_elapsed"))
    counts = runs.groupBy(*config).agg(F.count(F.lit(1)).alias("n_runs"))
    return attach(counts, medians, config).select(*config, "median_elapsed", "n_runs")


BIN_BITS = 11


def middle_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(keys, n, low, high)``: the two middle values of each group (equal for odd counts), without sorting rows.

    All groups are narrowed at once: each round counts a bracket's values in 2**``BIN_BITS`` bins, combined
    in the tasks before the shuffle, and keeps the bin that holds the lower middle place, until a bin is one
    value.  A group of any size and skew is spread over all tasks.  Values are whole numbers; nulls are left out.
    """
    bits = lambda c: F.length(F.bin(c))
    start = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).cast("bigint").alias("_lo"), F.max(value).cast("bigint").alias("_hi")
    )
    shift = F.greatest(bits(F.col("_hi") - F.col("_lo")) - BIN_BITS, F.lit(0))
    state = cut(start.select(
        *keys, "n", "_lo", shift.alias("_shift"), F.call_function("div", F.col("n") + 1, F.lit(2)).alias("_place")
    ), "brackets")
    while (state.agg(F.max("_shift")).first()[0] or 0) >= 0 and not state.isEmpty():
        rows = null_safe(df.select(*keys, value), state, keys, "inner")
        bin_ = F.call_function("shiftright", F.col(value).cast("bigint") - F.col("_lo"), F.greatest("_shift", F.lit(0)))
        inside = rows.filter(F.col("_shift") >= 0).withColumn("_bin", bin_).filter(F.col("_bin").between(0, (1 << BIN_BITS) - 1))
        counts = inside.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
        listed = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_bin", "_n"))).alias("_bins"))
        both = null_safe(state, listed, keys)
        found = both.withColumn("_found", _bin_of("_bins", "_place"))
        open_ = F.col("_shift") >= 0
        state = cut(found.select(
            *keys, "n",
            F.when(open_, F.col("_lo") + F.call_function("shiftleft", F.col("_found.bin"), F.col("_shift"))).otherwise(F.col("_lo")).alias("_lo"),
            F.when(F.col("_shift") > 0, F.greatest(F.col("_shift") - BIN_BITS, F.lit(0))).otherwise(-1).alias("_shift"),
            F.when(open_, F.col("_place") - F.col("_found.before")).otherwise(F.col("_place")).alias("_place"),
        ), "brackets")
    # The upper middle value: the same, unless all values up to it end there.
    rows = null_safe(df.select(*keys, value), state.select(*keys, "n", "_lo"), keys, "inner")
    ends = rows.groupBy(*keys, "n", "_lo").agg(
        F.count_if(F.col(value) <= F.col("_lo")).alias("_upto"), F.min(F.when(F.col(value) > F.col("_lo"), F.col(value))).alias("_next")
    )
    upper = F.call_function("div", F.col("n") + 2, F.lit(2))
    return ends.select(*keys, "n", F.col("_lo").alias("low"), F.when(F.col("_upto") >= upper, F.col("_lo")).otherwise(F.col("_next")).alias("high"))


def _bin_of(bins: str, place: str) -> Column:
    """The bin that holds the given place, and how many values lie before it."""
    start = F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(None).cast("bigint").alias("bin"))

    def step(a: Column, b: Column) -> Column:
        here = a["bin"].isNull() & (a["before"] + b["_n"] >= F.col(place))
        return F.struct(
            F.when(a["bin"].isNotNull() | here, a["before"]).otherwise(a["before"] + b["_n"]).alias("before"),
            F.when(here, b["_bin"]).otherwise(a["bin"]).alias("bin"),
        )

    return F.aggregate(bins, start, step)


def config_median_counted(df: DataFrame, config: list[str], run: list[str], elapsed: str) -> DataFrame:
    """The rows of :func:`config_median`, its middle values found by counting: no run is sorted or numbered."""
    runs = cut(df.groupBy(*config, *run).agg(F.max(elapsed).alias("_slowest")), "runs")
    middle = middle_values(runs, config, "_slowest")
    mean = (F.col("low").cast("double") + F.col("high").cast("double")) / 2
    counts = runs.groupBy(*config).agg(F.count(F.lit(1)).alias("n_runs"))
    return attach(counts, middle.select(*config, mean.alias("median_elapsed")), config).select(*config, "median_elapsed", "n_runs")


def speed_up(medians: DataFrame, config: list[str], variant: str, baseline: str, tested: str, elapsed: str) -> DataFrame:
    """Baseline median over tested median per configuration."""

    def side(value):
        return F.max(F.when(F.col(variant) == value, F.col(elapsed)))

    both = medians.groupBy(*config).agg(side(baseline).alias("baseline"), side(tested).alias("tested"))
    return both.withColumn("speed_up", F.col("baseline") / F.nullif(F.col("tested"), F.lit(0.0)))


def union_results(tables: list[DataFrame], min_rows: int = 1) -> DataFrame:
    """All result tables by column name; a table with fewer than ``min_rows`` rows is an error."""
    for i, df in enumerate(tables):
        if df.limit(min_rows).count() < min_rows:
            raise ValueError(f"table {i} has fewer than {min_rows} rows")
    return fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def newest(df: DataFrame, group: list[str], stamp: str, tie: str, n: int, **limits: int) -> DataFrame:
    """The ``n`` newest rows of each group; ``stamp`` and ``tie`` are whole numbers.

    Spark keeps the first ``n`` rows of a group in each task before the shuffle
    when the number is compared right away, so a large group arrives small.  It
    does so for small ``n`` only; beyond that, large groups are split.
    """
    if n > WINDOW_LIMIT:
        # Descending, nulls last, as below.
        keys = {f"_{i}{part}": c for i, name in enumerate((stamp, tie)) for part, c in
                (("null", F.col(name).isNull().cast("bigint")), ("back", -F.col(name).cast("bigint")))}
        placed = row_number(df.withColumns(keys), group, list(keys), "place", **limits)
        return placed.filter(F.col("place") <= n).drop(*keys)
    window = Window.partitionBy(*group).orderBy(F.desc(stamp), F.desc(tie))
    placed = df.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= n)
    return placed.withColumn("place", F.col("place").cast("bigint"))


def progress(done: Column, total: Column) -> Column:
    """Percent complete with two digits."""
    return F.round(percent(done, total), 2)


def minutes_left(elapsed_seconds: Column, percent_done: Column) -> Column:
    """Time left at the pace so far; null before the first job is done."""
    rest = elapsed_seconds / F.nullif(percent_done, F.lit(0.0)) * (F.lit(100.0) - percent_done)
    return F.round(rest / 60.0, 1)

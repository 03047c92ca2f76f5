"""Writers: appended results, combined TSV, classed rows, maps, matrices, three-table load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.functions.labels import zero_padded


def append_results(df: DataFrame, path: str) -> None:
    """Add the rows of a run to the results table."""
    df.write.mode("append").parquet(path)


def write_tsv(df: DataFrame, path: str, compression: str | None = None, header: bool = True) -> None:
    """Tab-separated text, optionally compressed (``bzip2`` keeps it splittable)."""
    df.write.csv(path, sep="\t", header=header, compression=compression or "none", emptyValue="")


def write_combined(df: DataFrame, path: str) -> None:
    """The union of many runs as plain TSV and as a bzip2 copy of that; the union is evaluated once."""
    write_tsv(df, f"{path}/tsv")
    texts = ", ".join(f"`{name}` string" for name in df.columns)
    written = df.sparkSession.read.csv(f"{path}/tsv", schema=texts, sep="\t", header=True)
    write_tsv(written, f"{path}/tsv_bz2", "bzip2")


def write_classed(df: DataFrame, path: str, mode: str = "mode") -> None:
    """Rows with their class as a partition column."""
    df.write.partitionBy(mode).csv(path, header=True, quoteAll=True)


def write_class_listing(df: DataFrame, path: str, classes: list[str], order: list[str], mode: str = "mode") -> None:
    """One listing of quoted rows in class order, its header in the first line only.

    The parts are written by ranges of (class, ``order``), so put one after another by name they are the
    listing; no task sorts more than its range.  A class that is not among ``classes`` is an error.
    """
    other = F.raise_error(F.concat(F.lit("unknown class "), F.coalesce(F.col(mode), F.lit("null")))).cast("int")
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(mode)).cast("int")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", *[quoted(F.col(f"`{c}`")) for c in df.columns])
    keys = [f"_{i}" for i in range(len(order))]
    rows = df.select(
        F.when(place > 0, place).otherwise(other).alias("_class"), *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)], line.alias("value")
    )
    head = F.concat_ws(",", *[quoted(F.lit(c)) for c in df.columns])
    nothing = [F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys]
    top = df.sparkSession.range(1).select(F.lit(0).alias("_class"), *nothing, head.alias("value"))
    top.unionByName(rows).orderBy("_class", *keys, "value").select("value").write.text(path)


def write_rank_map(stats: DataFrame, path: str) -> None:
    """rank -> cpu map, four-digit ranks in rank order across the part files."""
    columns = [
        zero_padded(F.col("thread_rank"), 4).alias("thread_rank"),
        "thread_name",
        "cpu_number",
        "hostname",
    ]
    stats.orderBy("thread_rank").select(*columns).write.csv(path, header=True)


def write_matrix(matrix: DataFrame, path: str) -> None:
    """A pivoted matrix as TSV."""
    write_tsv(matrix, path)


def write_experiment(experiments: DataFrame, runs: DataFrame, ranks: DataFrame, path: str) -> None:
    """The three related tables; the large ones are partitioned by their parent's bucket.

    A partition per parent key would make one folder per run, so the key's
    remainder is used: readers still prune on it.
    """
    experiments.write.parquet(f"{path}/experiments")
    for name, df, key in (("runs", runs, "experiment_id"), ("thread_runs", ranks, "run_id")):
        df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(8))).write.partitionBy("part").parquet(f"{path}/{name}")


def read_experiment(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of :func:`write_experiment`."""

    def load(name):
        return spark.read.parquet(f"{path}/{name}").drop("part")

    return load("experiments"), load("runs"), load("thread_runs")

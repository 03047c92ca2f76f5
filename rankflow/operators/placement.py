"""Where ranks run: block, round-robin and grid placement, slots, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.plans import previous_value, row_number


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a.cast("bigint"), F.lit(b))


def block_process(rank: Column, threads: int) -> Column:
    """``floor(rank / threads)``."""
    return _div(rank, threads)


def round_robin(df: DataFrame, rank: str, total: int, nodes: int, tasks: int) -> DataFrame:
    """Node ``rank % nodes``; the ranks of a node go to its tasks in rank order.

    Ranks are ``0 .. total-1``, so a rank's place on its node is ``rank div nodes``.
    """
    per_node = -(-total // nodes)
    if per_node % tasks:
        raise ValueError(f"{per_node} ranks per node do not divide into {tasks} tasks")
    node = F.col(rank) % nodes
    task = F.least(_div(_div(F.col(rank), nodes), per_node // tasks), F.lit(tasks - 1))
    return df.withColumns({"node": node.cast("bigint"), "process": node * tasks + task})


def grid_process(grid: DataFrame, tasks: int) -> DataFrame:
    """Processes of ``(node, position, rank)`` with one or two tasks per node; the first takes the larger half."""
    if tasks not in (1, 2):
        raise ValueError("one or two tasks per node")
    if tasks == 1:
        return grid.withColumn("process", F.col("node"))
    sizes = grid.groupBy("node").agg(F.count(F.lit(1)).alias("_n"))
    upper = (F.col("position") >= F.ceil(F.col("_n") / 2)).cast("bigint")
    return grid.join(sizes, "node").withColumn("process", F.col("node") * 2 + upper).drop("_n")


def node_slots(df: DataFrame, order: list[str], threads_per_node: int, name: str = "slot", **limits: int) -> DataFrame:
    """Running number in placement order, modulo the threads of a node."""
    numbered = row_number(df, [], order, "_place", start=0, **limits)
    return numbered.withColumn(name, F.col("_place") % threads_per_node).drop("_place")


def ranks_per_process(df: DataFrame, process: str) -> DataFrame:
    """Ranks of each process."""
    return df.groupBy(process).agg(F.count(F.lit(1)).alias("n_ranks"))


def check_placement(df: DataFrame, rank: str, process: str, position: str, total: int, processes: int) -> DataFrame:
    """One row of counts: repeated, missing and foreign ranks, bad processes, and steps back in process order."""
    spark = df.sparkSession
    counts = df.groupBy(F.col(rank).alias("_rank")).agg(F.count(F.lit(1)).alias("_n"))
    expected = spark.range(total).withColumnRenamed("id", "_rank")
    found = expected.join(counts, "_rank", "full_outer").agg(
        F.struct(F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_n") > 1).alias("repeated")).alias("f")
    ).scalar()
    before = previous_value(df, [], [position], {"_before": process})
    foreign = ~F.col(rank).between(0, total - 1)
    wrong = ~F.col(process).between(0, processes - 1)
    return before.agg(
        F.count(F.lit(1)).alias("n_ranks"),
        F.count_if(foreign).alias("n_foreign"),
        F.count_if(wrong).alias("n_bad_process"),
        F.count_if(F.col(process) < F.col("_before")).alias("n_steps_back"),
    ).withColumns({"n_missing": found["missing"], "n_repeated": found["repeated"]})

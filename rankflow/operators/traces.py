"""Messages and channels: matching, matrices, bundles, mixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.functions.ratios import percent
from rankflow.plans import row_number


def match_messages(
    sends: DataFrame, recvs: DataFrame, channel: list[str], order: list[str], columns: list[str], **limits: int
) -> DataFrame:
    """Pair the nth send with the nth receive of each channel; leftovers keep a null other side.

    Both sides are numbered together, and the running number is part of the key on which they
    meet, so a busy channel spreads over all tasks.  A null channel is a channel too.
    """
    used = list(dict.fromkeys([*channel, *order, *columns]))
    rows = sends.select(*used, F.lit(True).alias("_sent")).unionByName(recvs.select(*used, F.lit(False).alias("_sent")))
    numbered = row_number(rows, [*channel, "_sent"], order, "seq", **limits)
    row = F.struct(*columns)
    both = numbered.groupBy(*channel, "seq").agg(
        F.any_value(F.when(F.col("_sent"), row), ignoreNulls=True).alias("_send"),
        F.any_value(F.when(~F.col("_sent"), row), ignoreNulls=True).alias("_recv"),
    )
    state = F.when(F.col("_recv").isNull(), "no_recv").when(F.col("_send").isNull(), "no_send").otherwise("matched")
    kept = [F.col(f"_{side}.{c}").alias(f"{side}_{c}") for side in ("send", "recv") for c in columns]
    return both.select(*channel, "seq", *kept, state.alias("state"))


def unmatched_endpoints(sends: DataFrame, recvs: DataFrame, channel: list[str]) -> DataFrame:
    """Channels only one side uses, with that side's message count.

    Both sides are counted per channel first, so the anti joins see one row per channel.
    """

    def count(df):
        return df.groupBy(*channel).agg(F.count(F.lit(1)).alias("n_messages"))

    send, recv = count(sends), count(recvs)
    only_send = send.join(recv, channel, "left_anti").withColumn("side", F.lit("send"))
    only_recv = recv.join(send, channel, "left_anti").withColumn("side", F.lit("recv"))
    return only_send.unionByName(only_recv)


def comm_matrix(messages: DataFrame, by: list[str], size: str | Column) -> DataFrame:
    """Messages and bytes per sender, receiver and whatever else is in ``by``."""
    size = F.col(size) if isinstance(size, str) else size
    return messages.groupBy(*by).agg(F.count(F.lit(1)).alias("messages"), F.sum(size).alias("bytes"))


def add_matrices(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sum of partial matrices, for example after a key was replaced by its process."""
    return parts.groupBy(*by).agg(F.sum("messages").alias("messages"), F.sum("bytes").alias("bytes"))


def bundle_sizes(trace: DataFrame, threads: int, direction: str, tag: str, sender: str, receiver: str) -> DataFrame:
    """Messages and thread pairs per (direction, tag, process pair).

    The pairs come with their counts: at most ``threads ** 2`` of them per
    process pair however many messages there are.
    """

    def process(c):
        return F.call_function("div", F.col(c).cast("bigint"), F.lit(threads))

    pairs = trace.groupBy(direction, tag, sender, receiver).agg(F.count(F.lit(1)).alias("_n"))
    label = F.concat(F.lit("t"), F.col(sender), F.lit(" -> t"), F.col(receiver))
    keyed = pairs.select(
        direction, tag, process(sender).alias("send_proc"), process(receiver).alias("recv_proc"),
        F.struct(F.col(sender).alias("s"), F.col(receiver).alias("r"), label.alias("pair"), "_n").alias("_p"),
    )
    listed = F.transform(F.array_sort(F.collect_list("_p")), lambda p: F.concat(p["pair"], F.lit(" x"), p["_n"]))
    return keyed.groupBy(direction, tag, "send_proc", "recv_proc").agg(
        F.sum("_p._n").alias("n_messages"),
        F.count(F.lit(1)).alias("n_pairs"),
        F.array_join(listed, "; ").alias("pairs"),
    )


def channel_mix(channels: DataFrame, by: list[str], channel_type: str) -> DataFrame:
    """Process and direct channels and their percentages; both ends report a direct channel, so it counts half."""
    process = F.count_if(F.col(channel_type) == "process")
    ends = F.count_if(F.col(channel_type) == "direct_mpi")
    counts = channels.groupBy(*by).agg(process.alias("n_process"), F.call_function("div", ends, F.lit(2)).alias("n_direct"))
    total = F.col("n_process") + F.col("n_direct")
    return counts.withColumns({
        "process_percent": percent(F.col("n_process"), total),
        "direct_percent": percent(F.col("n_direct"), total),
    })


def steal_share(chunks: DataFrame, task: list[str], executor: str, owner: str, ranks: list[int]) -> DataFrame:
    """Chunks run by other ranks than the owner, of all chunks, and one column per rank; other ranks are an error."""
    unlisted = F.raise_error(F.concat(F.lit("rank not listed: "), F.col(executor).cast("string")))
    known = F.when(F.col(executor).isNull() | F.col(executor).isin(ranks), F.col(executor))
    kind = chunks.schema[executor].dataType
    chunks = chunks.withColumn(executor, known.otherwise(unlisted.cast(kind)))
    stolen = F.count_if(F.col(executor) != F.col(owner))
    counts = chunks.groupBy(*task).agg(
        stolen.alias("steals"),
        F.count(F.lit(1)).alias("chunks"),
        *[F.count_if(F.col(executor) == r).alias(f"rank_{r}") for r in ranks],
    )
    return counts.withColumn("steal_percent", F.round(percent(F.col("steals"), F.col("chunks")), 2))


def wait_mix(waits: DataFrame, by: list[str], outcome: str, outcomes: list[str]) -> DataFrame:
    """Count and percentage of each wait outcome; an outcome outside the list fails the check."""
    counts = waits.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_waits"), *[F.count_if(F.col(outcome) == o).alias(f"n_{o}") for o in outcomes]
    )
    known = sum((F.col(f"n_{o}") for o in outcomes), F.lit(0))
    checked = F.when(known == F.col("n_waits"), F.col("n_waits")).otherwise(
        F.raise_error(F.lit("wait outcomes do not add up to all waits")).cast("bigint")
    )
    shares = {f"pct_{o}": percent(F.col(f"n_{o}"), F.col("n_waits")) for o in outcomes}
    return counts.withColumn("n_waits", checked).withColumns(shares)


def queue_ratios(df: DataFrame, by: list[str], spins: str, depth: str, capacity: int) -> DataFrame:
    """Spins per wait, and the deepest queue as a percentage of its capacity."""
    return df.groupBy(*by).agg(
        (F.sum(spins) / F.count(F.lit(1))).alias("spins_per_wait"),
        F.max(depth).alias("peak_depth"),
        percent(F.max(depth), F.lit(capacity)).alias("peak_percent"),
    )


def counter_delta(end: Column, start: Column, width: int) -> Column:
    """``end - start`` of a counter of ``width`` bits that may have wrapped once."""
    if not 0 < width <= 64:
        raise ValueError(f"counter width {width}")
    wrapped = end.cast("decimal(20,0)") + F.lit(str(2**width)).cast("decimal(20,0)") - start.cast("decimal(20,0)")
    plain = (end - start).cast("bigint")
    return F.when(end >= start, plain).otherwise(wrapped.cast("bigint") if width < 63 else wrapped)

"""Following growing folders: unseen lines, progress, late output, rank statistics.

State lives in Spark's state store and results go to tables in the shared
folder, so a query resumes after the loss of an executor or the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import partial
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rankflow import schemas
from rankflow.operators.experiments import completeness, minutes_left, progress
from rankflow.plans import new_path


def open_table(spark: SparkSession, path: str, schema: T.StructType | str, **options) -> DataFrame:
    """Parquet files as a stream; a single file must be named by a glob such as ``{name}.parquet``."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def _stripped(text: str) -> Column:
    return F.trim(F.col(text), F.lit(" \t\r\n\f\v\0"))


def follow_lines(spark: SparkSession, path: str) -> DataFrame:
    """A folder of text files as a stream of stripped lines."""
    return spark.readStream.text(path).select(_stripped("value").alias("line"))


def stripped_lines(stream: DataFrame, text: str) -> DataFrame:
    """The stripped lines of a text column."""
    return stream.select(F.explode(F.split(text, "\n")).alias("line")).select(_stripped("line").alias("line"))


def _first_rows(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The first row of each key in a record batch."""
    for batch in batches:
        rows = pa.Table.from_batches([batch]).select(keys).append_column("_row", pa.array(range(batch.num_rows)))
        first = rows.group_by(keys).aggregate([("_row", "min")])["_row_min"]
        yield batch.take(first.combine_chunks())


def seen_once(stream: DataFrame, keys: list[str], event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """Only rows whose keys have not been seen.

    Without ``event_time`` every key stays in the state for good; with it a
    key is forgotten ``delay`` after its time.  Streaming deduplication has no
    map-side step, so each task first drops the repeats inside its own record
    batches: a key with a third of all rows then sends one row per batch.
    """
    stream = stream.mapInArrow(partial(_first_rows, keys=keys), stream.schema)
    if event_time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, outside the heap."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


#: What a run over what is there now waits for: nothing.
NOW = (None,)


def run_to_table(stream: DataFrame, name: str, growth: Iterable = NOW) -> DataFrame:
    """Run an append stream over what is there now and return the written table; its state is kept in RocksDB.

    The stream resumes after each step of ``growth``, which may add files to its folders.
    """
    spark = stream.sparkSession
    out, state = new_path(spark, name), new_path(spark, f"{name}-state")
    for _ in growth:
        with rocks_state(spark):
            writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
            query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _each_batch(stream: DataFrame, name: str, mode: str, write, growth: Iterable = NOW) -> None:
    state = new_path(stream.sparkSession, f"{name}-state")
    for _ in growth:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(write)
        writer.trigger(availableNow=True).start().awaitTermination()


def _without_rows(spark: SparkSession, out: str, schema: T.StructType | str) -> None:
    """An empty part of a table, so that it can be read before the first batch."""
    spark.createDataFrame([], schema).write.mode("append").parquet(out)


def arrivals(
    stream: DataFrame, job: str, total: Column, started: Column, now: Column, name: str = "progress", growth: Iterable = NOW
) -> DataFrame:
    """Progress after each batch: jobs done, percent of all jobs, minutes left.

    A job is done when its first output arrives; ``started`` and ``now`` are
    seconds, ``now`` an aggregate of the batch's jobs (its columns are ``job``
    and ``last_seen``).
    """
    spark = stream.sparkSession
    out = new_path(spark, name)
    _without_rows(spark, f"{out}/none", "batch bigint, jobs_done bigint, percent double, minutes_left double")
    done = stream.groupBy(job).agg(F.max("arrived").alias("last_seen"))

    def write(batch: DataFrame, batch_id: int) -> None:
        row = batch.agg(F.count(F.lit(1)).alias("jobs_done"), now.alias("_now"))
        row = row.withColumn("percent", progress(F.col("jobs_done"), total))
        left = minutes_left(F.col("_now") - started, F.col("percent"))
        row = row.select(F.lit(batch_id).cast("bigint").alias("batch"), "jobs_done", "percent", left.alias("minutes_left"))
        # One folder per batch: a batch that is run again replaces its own row.
        row.write.mode("overwrite").parquet(f"{out}/{batch_id}")

    _each_batch(done, name, "complete", write, growth)
    return spark.read.parquet(f"{out}/*")


def first_wait_seconds(expected: Column) -> Column:
    """How long to wait before the first look, by the number of expected files."""
    # Size classes and their waits in seconds.
    return F.when(expected > 20000, 900).when(expected > 2000, 300).otherwise(60)


def gate_late(
    stream: DataFrame,
    gate: Column,
    expected: DataFrame,
    job: str,
    want: str,
    name: str = "late",
) -> tuple[DataFrame, DataFrame]:
    """Rows that arrive before and after the gate, and the jobs' completeness at the gate.

    A row is on time when ``gate``, which reads its event time, holds; in which
    batch it came does not matter.  Returns the status of every job and the late rows.
    """
    spark = stream.sparkSession
    out = new_path(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        flagged = batch.withColumn("on_time", gate)
        flagged.write.mode("overwrite").partitionBy("on_time").parquet(f"{out}/batch={batch_id}")

    _without_rows(spark, f"{out}/batch=-1/on_time=false", stream.schema)
    _each_batch(stream, name, "append", write)
    schema = T.StructType([*stream.schema, T.StructField("on_time", T.BooleanType())])
    rows = spark.read.schema(schema).option("basePath", out).parquet(f"{out}/batch=*").drop("batch")
    found = rows.filter("on_time").groupBy(job).agg(F.count(F.lit(1)).alias("found"))
    return completeness(expected, found, [job], want, "found"), rows.filter("NOT on_time").drop("on_time")


#: Seconds between two looks, and looks after the first.
LOOK_SECONDS, LOOKS = 15, 60
LATE_STATE = "want bigint, looks array<bigint>, done boolean"
LATE_STATUS = "job string, want bigint, found bigint, look int, status string"


class LateJobs(StatefulProcessor):
    """Counts a job's files by the look at which they are there; one timer a job.

    The first look is ``first`` (seconds), others follow every ``LOOK_SECONDS``; a look is decided once the watermark has
    passed it.  A job's row comes out at the first look with all its files, or, with what there is, at the last.
    """

    def __init__(self, first: int):
        self.first = first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("files", LATE_STATE)

    def look_at(self, seconds: float) -> int:
        """The first look at which what arrives then is there; ``LOOKS`` + 1 if none."""
        return min(LOOKS + 1, max(0, -int(-(seconds - self.first) // LOOK_SECONDS)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        want, looks, done = self.state.get() if self.state.exists() else (None, [0] * (LOOKS + 2), False)
        looks, new = list(looks), want is None
        for frame in rows:
            for n, seconds in zip(frame["want"], frame["seconds"]):
                if pd.isna(n):
                    looks[self.look_at(seconds)] += 1
                else:
                    want = int(n)
        self.state.update((want, looks, done))
        if new and want is not None:
            self.handle.registerTimer(int(self.first * 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        want, looks, _ = self.state.get()
        # Looks the watermark has passed: nothing that arrived until then is still to come.
        passed = self.look_at(timerValues.getCurrentWatermarkInMs() / 1000 + 0.001) - 1
        there = list(accumulate(looks[: LOOKS + 1]))
        full = next((i for i, n in enumerate(there) if n >= want), None)
        if full is not None and full <= passed:
            found, look = there[full], full
        elif passed >= LOOKS:
            found, look = there[LOOKS], LOOKS
        else:
            ahead = full if full is not None else passed + 1
            self.handle.registerTimer(int((self.first + ahead * LOOK_SECONDS) * 1000))
            return
        status = "failed" if found < want else "surplus" if found > want else "ok"
        yield pd.DataFrame({"job": [key[0]], "want": [want], "found": [found], "look": [look], "status": [status]})

    def close(self) -> None:
        pass


def watch_jobs(arrivals: DataFrame, expected: DataFrame, started: int, first_wait: int, delay: str = "0 seconds") -> DataFrame:
    """The status of every expected job, as a stream that decides each job at the look at which its files are there.

    ``arrivals`` is a stream of ``(job, arrived)``, a row per file; ``expected`` one of ``(job, want)``; both times are
    seconds since the epoch, ``delay`` is how far arrivals may come out of order.  Time is that of the arrivals: looks
    pass as the watermark does, so the answer does not depend on how files fall into batches.
    Needs the RocksDB state store, as ``run_to_table`` sets it.
    """
    empty = F.lit(None)
    files = arrivals.select(F.col("job").cast("string").alias("job"), empty.cast("bigint").alias("want"), F.col("arrived").alias("at"))
    wanted = expected.select(F.col("job").cast("string").alias("job"), F.col("want").cast("bigint"), F.lit(started).cast("bigint").alias("at"))
    rows = wanted.unionByName(files)
    rows = rows.select("job", "want", F.col("at").cast("double").alias("seconds"), F.timestamp_seconds("at").alias("at"))
    return rows.withWatermark("at", delay).groupBy("job").transformWithStateInPandas(
        LateJobs(started + first_wait), LATE_STATUS, outputMode="Append", timeMode="EventTime"
    )


def require_all(status: DataFrame, job: str = "job", most: int = 20) -> DataFrame:
    """The status table; fails with the names of all jobs that lack output, ``most`` of them at most, and their number."""
    failed = status.filter(F.col("status") == "failed")
    names = [str(r[0]) for r in failed.select(job).orderBy(job).limit(most + 1).collect()]
    if names:
        more = failed.count() - most
        rest = f" and {more} more" if more > 0 else ""
        raise RuntimeError(f"missing output of jobs {', '.join(names[:most])}{rest}")
    return status


def require_complete(status: DataFrame, job: str) -> DataFrame:
    """The status table, failing with the first job that lacks output."""
    missing = F.raise_error(F.concat(F.lit("missing output of job "), F.col(job).cast("string"))).cast("boolean")
    return status.filter(F.when(F.col("status") == "failed", missing).otherwise(F.lit(True)))


def follow_rank_stats(
    spark: SparkSession, path: str, prefix: str = "", one_per_line: bool = False, files_a_batch: int | None = None
) -> DataFrame:
    """Rank statistics documents as they are written, a file or a line each."""
    reader = spark.readStream.schema(schemas.rank_stats_cycles(prefix)).option("multiLine", not one_per_line)
    reader = reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader
    names = {f"{prefix}{n}": n for n in schemas.PREFIXED}
    stream = reader.json(path)
    return stream.withColumnsRenamed(names) if prefix else stream


def stats_to_table(
    spark: SparkSession,
    path: str,
    summary: Callable[[DataFrame], DataFrame],
    prefix: str = "",
    one_per_line: bool = False,
    name: str = "summary",
    files_a_batch: int | None = None,
    growth: Iterable = NOW,
) -> DataFrame:
    """Keep a summary of all documents seen so far; returns its state after the last batch."""
    out = new_path(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{out}/{batch_id}")

    state = summary(follow_rank_stats(spark, path, prefix, one_per_line, files_a_batch))
    _without_rows(spark, f"{out}/none", T.StructType([*state.schema, T.StructField("batch", T.LongType())]))
    _each_batch(state, name, "complete", write, growth)
    states = spark.read.parquet(f"{out}/*")
    return states.filter(F.col("batch") == states.agg(F.max("batch")).scalar()).drop("batch")

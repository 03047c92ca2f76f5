"""Structured Streaming jobs run over what the tables hold now."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.catalog.files import SQL_LINES
from rankflow.catalog.registry import cents, query, table
from rankflow.functions.ratios import hundredths, micros
from rankflow.operators.timers import timer_stats
from rankflow.plans import new_path
from rankflow.sources.stats import document_json
from rankflow.streaming import (
    arrivals,
    first_wait_seconds,
    gate_late,
    open_table,
    run_to_table,
    seen_once,
    stats_to_table,
    stripped_lines,
    watch_jobs,
)


def growing(spark: SparkSession, path: str, parts: Iterable[DataFrame], form: str = "parquet") -> Iterator[int]:
    """Add each part to a folder when its turn comes, in as many files as it has tasks."""
    for turn, part in enumerate(parts):
        part.write.mode("append").format(form).save(path)
        yield turn


def split(df: DataFrame, column: str, parts: int) -> list[DataFrame]:
    """The rows of a table in parts; those of one key are in one part."""
    return [df.filter(F.pmod(F.xxhash64(column), F.lit(parts)) == part) for part in range(parts)]


def empty_folder(df: DataFrame, name: str) -> str:
    """A folder for rows like ``df``'s, to be opened as a stream before it grows."""
    path = new_path(df.sparkSession, name)
    df.sparkSession.createDataFrame([], df.schema).write.parquet(path)
    return path


@query("stream_dedup", f"SELECT DISTINCT trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line FROM ({SQL_LINES})")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = empty_folder(docs, "followed")
    lines = stripped_lines(open_table(spark, path, docs.schema), "text")
    return run_to_table(seen_once(lines, ["line"]), "lines", growing(spark, path, split(docs, "doc_id", 3)))


SECONDS = "epoch_us(ts) // 1000000"


@query(
    "stream_progress",
    f"""WITH n AS (SELECT count(DISTINCT user_id) AS u, max({SECONDS}) - 1704067200 AS s FROM events)
       SELECT u AS jobs_done, round(100.0::DOUBLE * u::DOUBLE / (u * 3 + 1)::DOUBLE, 2) AS percent,
       round(s::DOUBLE / round(100.0::DOUBLE * u::DOUBLE / (u * 3 + 1)::DOUBLE, 2)
             * (100.0::DOUBLE - round(100.0::DOUBLE * u::DOUBLE / (u * 3 + 1)::DOUBLE, 2)) / 60.0::DOUBLE, 1) AS minutes_left,
       CAST(4 AS BIGINT) AS n_batches, TRUE AS grows FROM n""",
)
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four parts, a batch each; three times as many jobs are planned as write anything, and one more."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    total = events.agg(F.count_distinct("user_id") * 3 + 1).first()[0]
    path = empty_folder(events, "followed")
    stream = open_table(spark, path, events.schema)
    seen = stream.select("user_id", F.call_function("div", micros("ts"), F.lit(1000000)).alias("arrived"))
    grown = growing(spark, path, split(events, "user_id", 4))
    steps = arrivals(seen, "user_id", F.lit(total), F.lit(1704067200), F.max("last_seen"), growth=grown)
    done = F.transform(F.array_sort(F.collect_list(F.struct("batch", "jobs_done"))), lambda b: b["jobs_done"])
    return steps.agg(
        F.max_by("jobs_done", "batch").alias("jobs_done"),
        F.max_by("percent", "batch").alias("percent"),
        F.max_by("minutes_left", "batch").alias("minutes_left"),
        F.count_distinct("batch").alias("n_batches"),
        # A user's rows are all in one part, so every batch brings new jobs.
        (F.size(F.array_distinct(done)) == F.size(done)).alias("grows"),
    )


LOOKS_START = 1704067200
SQL_WAIT = "(SELECT CASE WHEN count(*) > 20000 THEN 900 WHEN count(*) > 2000 THEN 300 ELSE 60 END FROM events)"


@query(
    "stream_looks",
    """SELECT CAST(user_id AS VARCHAR) AS job, count(*) AS want, count(*) - CASE user_id % 3 WHEN 2 THEN 1 ELSE 0 END AS found,
       CAST(CASE user_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 60 END AS INT) AS look,
       CASE user_id % 3 WHEN 2 THEN 'failed' ELSE 'ok' END AS status FROM events GROUP BY user_id""",
)
def stream_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per event: a third of the jobs is complete at the first look, a third at the third after it, a third never."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    expected = events.groupBy(F.col("user_id").alias("job")).agg(F.count(F.lit(1)).alias("want"), F.max("event_id").alias("last"))
    wait = expected.agg(first_wait_seconds(F.sum("want"))).first()[0]
    last = events.join(expected, events["user_id"] == expected["job"]).filter("event_id = last").select("user_id", "event_id")
    files = events.select(F.col("user_id").cast("string").alias("job"), "event_id")
    last = last.select(F.col("user_id").cast("string").alias("job"), "event_id")
    late = last.filter("job % 3 = 1")
    clock = spark.range(1).select(F.lit("clock").alias("job"), F.col("id").alias("event_id"))
    on_time = files.join(last.filter("job % 3 <> 0"), ["job", "event_id"], "left_anti")
    parts = [
        rows.select("job", F.lit(LOOKS_START + arrived).cast("bigint").alias("arrived"))
        for rows, arrived in ((on_time, 30), (late, wait + 37), (clock, 7200))
    ]
    wanted = new_path(spark, "wanted")
    expected.select(F.col("job").cast("string").alias("job"), "want").write.parquet(wanted)
    path = empty_folder(parts[0], "arrivals")
    jobs = open_table(spark, wanted, "job string, want bigint")
    status = watch_jobs(open_table(spark, path, "job string, arrived bigint"), jobs, LOOKS_START, wait)
    return run_to_table(status, "status", growing(spark, path, parts))


SQL_GATE = "1706000000000000"


@query(
    "stream_late",
    f"""WITH f AS (SELECT user_id, count(*) AS found FROM events WHERE epoch_us(ts) <= {SQL_GATE} GROUP BY 1),
        e AS (SELECT user_id, count(*) AS expected FROM events GROUP BY 1)
       SELECT user_id, expected, coalesce(found, 0) AS found,
       CASE WHEN coalesce(found, 0) < expected THEN 'failed' ELSE 'ok' END AS status,
       coalesce(found, 0) IN (expected, expected * 2, expected * 4) AS accepted, expected - coalesce(found, 0) AS n_late
       FROM e LEFT JOIN f USING (user_id)""",
)
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    expected = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("expected"))
    stream = open_table(spark, f"{sf_dir}/{{events}}.parquet", events.schema).select(
        "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")
    )
    status, late = gate_late(stream, F.unix_micros("ts") <= int(SQL_GATE), expected, "user_id", "expected")
    n_late = late.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_late"))
    return status.join(n_late, "user_id", "left").fillna(0, ["n_late"])


@query(
    "stream_stats",
    f"""SELECT event_type AS hostname, min({cents("value")}) AS min_elapsed, max({cents("value")}) AS max_elapsed,
        round(avg({cents("value")}), 6) AS mean_elapsed FROM events GROUP BY 1""",
)
def stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "documents")
    doc = document_json({
        "hostname": F.col("event_type"), "thread_rank": F.col("user_id"), "elapsed_cycles": hundredths("value")
    })
    events = table(spark, sf_dir, "events")
    parts = [events.filter(F.col("event_id") % 3 == part).select(doc) for part in range(3)]
    parts[0].limit(0).write.text(path)
    grown = growing(spark, path, parts, "text")
    rows = stats_to_table(spark, path, lambda df: timer_stats(df, ["hostname"], "elapsed_cycles"), one_per_line=True, growth=grown)
    return rows.withColumn("mean_elapsed", F.round("mean_elapsed", 6))

"""Streams over growing folders, compared with the batch result."""

import pytest
from pyspark.sql import functions as F

from rankflow.catalog import streams
from rankflow.operators.timers import timer_stats
from rankflow.plans import new_path
from rankflow.streaming import (
    arrivals,
    first_wait_seconds,
    follow_lines,
    gate_late,
    open_table,
    require_complete,
    run_to_table,
    seen_once,
    stats_to_table,
)


def test_dedup_equals_distinct(spark, write):
    write("f/1.txt", "a\nb\n a \n" + "\ta\n" * 500)
    path = write("f/2.txt", "b\nc\n")
    got = run_to_table(seen_once(follow_lines(spark, path), ["line"]), "t")
    assert sorted(r.line for r in got.collect()) == ["a", "b", "c"]


def test_bounded_dedup(spark, tmp_path):
    schema = "ts timestamp, k int"
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS ts, 1 AS k UNION ALL SELECT timestamp'2024-01-01 00:00:01', 1")
    df.write.parquet(str(tmp_path / "in"))
    stream = open_table(spark, str(tmp_path / "in"), schema)
    assert run_to_table(seen_once(stream, ["k"], "ts", "10 minutes"), "t").count() == 1


def test_progress_per_batch(spark, tmp_path):
    path = str(tmp_path / "jobs")
    for i in range(3):
        spark.range(i, i + 1).selectExpr("id AS job", "100 + id * 10 AS arrived").coalesce(1).write.mode("append").parquet(path)
    schema = "job bigint, arrived bigint"
    stream = open_table(spark, path, schema, maxFilesPerTrigger=1)
    steps = arrivals(stream, "job", F.lit(6), F.lit(100), F.max("last_seen")).orderBy("batch").collect()
    assert [r.jobs_done for r in steps] == [1, 2, 3]
    assert [r.percent for r in steps] == [16.67, 33.33, 50.0]
    assert steps[-1].minutes_left == round(20 / 50 * 50 / 60, 1)


def test_late_rows(spark, tmp_path):
    df = spark.sql("SELECT explode(sequence(0, 9)) AS id").selectExpr("id % 2 AS job", "timestamp_seconds(id) AS ts")
    df.write.parquet(str(tmp_path / "in"))
    expected = spark.createDataFrame([(0, 5), (1, 5)], "job int, want bigint")
    stream = open_table(spark, str(tmp_path / "in"), df.schema)
    status, late = gate_late(stream, F.col("ts") < F.timestamp_seconds(F.lit(9)), expected, "job", "want")
    assert {(r.job, r.found, r.status) for r in status.collect()} == {(0, 5, "ok"), (1, 4, "failed")}
    assert late.count() == 1
    with pytest.raises(Exception, match="missing output of job 1"):
        require_complete(status, "job").collect()


def test_output_of_late_batches_is_on_time_by_its_event_time(spark, tmp_path):
    path = str(tmp_path / "jobs")
    for i in range(3):
        spark.range(i, i + 1).selectExpr("id AS job").coalesce(1).write.mode("append").parquet(path)
    expected = spark.range(3).selectExpr("id AS job", "1 AS want")
    stream = open_table(spark, path, "job bigint", maxFilesPerTrigger=1)
    status, late = gate_late(stream, F.lit(True), expected, "job", "want")
    assert {(r.job, r.status) for r in status.collect()} == {(0, "ok"), (1, "ok"), (2, "ok")}
    assert late.count() == 0


def test_folders_without_files(spark, tmp_path):
    path = str(tmp_path / "empty")
    (tmp_path / "empty").mkdir()
    jobs = open_table(spark, path, "job bigint, arrived bigint")
    assert arrivals(jobs, "job", F.lit(6), F.lit(0), F.max("last_seen")).count() == 0
    expected = spark.range(2).selectExpr("id AS job", "1 AS want")
    status, late = gate_late(jobs, F.lit(True), expected, "job", "want")
    assert {r.status for r in status.collect()} == {"failed"} and late.count() == 0
    assert stats_to_table(spark, path, lambda df: timer_stats(df, ["hostname"], "elapsed_cycles")).count() == 0


def test_first_wait(spark):
    waits = spark.createDataFrame([(10,), (2001,), (20001,)], "n int").select(first_wait_seconds(F.col("n")).alias("w"))
    assert [r.w for r in waits.collect()] == [60, 300, 900]


def test_rank_statistics_as_they_arrive(spark, write):
    write("s/stats_rank_0.json", '{"hostname": "h",\n "x_thread_rank": 0, "elapsed_cycles": 10}')
    path = write("s/stats_rank_1.json", '{"hostname": "h",\n "x_thread_rank": 1, "elapsed_cycles": 30}')
    out = stats_to_table(spark, path, lambda df: timer_stats(df, ["hostname"], "elapsed_cycles"), prefix="x_")
    assert tuple(out.first()) == ("h", 10, 30, 20.0)


def test_followed_tables_are_written_by_as_many_tasks_as_read_them(spark, tmp_path, monkeypatch):
    rows = [(i, f"line {i}\nsaid by all\n line {i % 7} ") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    folders = []

    def noted(session, name):
        folders.append((name, new_path(session, name)))
        return folders[-1][1]

    monkeypatch.setattr(streams, "new_path", noted)
    got = [r.line for r in streams.stream_dedup(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted({f"line {i}" for i in range(400)} | {"said by all"})
    files = spark.read.parquet(dict(folders)["followed"]).select(F.col("_metadata.file_path").alias("f"), "doc_id")
    per_part = files.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("part")).agg(F.count_distinct("f").alias("n")).collect()
    assert len(per_part) == 3 and all(r.n == 4 for r in per_part)

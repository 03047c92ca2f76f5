"""Late output: jobs that are complete at the first look, later, with too much, and never."""

import pytest

from rankflow.plans import new_path
from rankflow.streaming import require_all, run_to_table, watch_jobs

START, WAIT = 1_700_000_000, 60


def stream_of(spark, batches, schema):
    """Parquet files as a stream, one file a batch, in the order given."""
    path = new_path(spark, "arrivals")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_looks_and_missing_jobs(spark):
    at = lambda look, extra=0: START + WAIT + 15 * look + extra
    batches = [
        [("a", START + 5), ("a", START + 50), ("b", START + 59), ("d", START + 1)],
        [("b", at(2, 3)), ("e", at(1)), ("e", at(1, 1)), ("c", at(4))],
        [("d", at(30))],
        [("c", at(61)), ("d", at(60)), ("clock", at(300))],
    ]
    jobs = [(job, n) for job, n in (("a", 2), ("b", 2), ("c", 2), ("d", 3), ("e", 1), ("f", 4))]
    expected = stream_of(spark, [jobs], "job string, want long")
    status = run_to_table(watch_jobs(stream_of(spark, batches, "job string, arrived long"), expected, START, WAIT), "status")
    got = {r.job: (r.found, r.look, r.status) for r in status.collect()}
    assert got == {
        "a": (2, 0, "ok"), "b": (2, 3, "ok"), "c": (1, 60, "failed"), "d": (3, 60, "ok"), "e": (1, 1, "ok"), "f": (0, 60, "failed"),
    }
    with pytest.raises(RuntimeError, match="missing output of jobs c, f$"):
        require_all(status)
    with pytest.raises(RuntimeError, match="missing output of jobs c and 1 more$"):
        require_all(status, most=1)
    assert require_all(status.filter("status <> 'failed'")).count() == 4

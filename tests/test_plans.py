"""The plans Spark makes of the operators."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from check import plan_of
from rankflow.operators import collectives, experiments, stencil, traces
from rankflow.plans import attach, cut, running_sum, shared_dir


@pytest.fixture
def facts(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 AS comm", "id % 10 AS idx", "id AS value", "id AS unused").write.parquet(
        str(tmp_path / "facts")
    )
    return spark.read.parquet(str(tmp_path / "facts"))


def shuffles(df):
    return plan_of(df).count("Exchange hashpartitioning")


def test_all_to_all_does_not_shuffle(facts):
    df = facts.withColumnRenamed("id", "rank")
    assert "Exchange" not in plan_of(collectives.all_to_all(df, 2))


def test_reduce_aggregates_before_its_only_shuffle(facts):
    plan = plan_of(collectives.reduce(facts, ["comm"], {"s": "sum"}))
    assert plan.count("Exchange") == 1 and "partial_sum" in plan
    assert "unused" not in plan


def test_all_reduce_reads_facts_without_a_shuffle(facts):
    plan = plan_of(collectives.all_reduce(facts, ["comm"], {"s": "sum"}))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_attach_is_not_forced_to_broadcast(spark, facts):
    sums = facts.groupBy("comm").agg(F.sum("value").alias("s"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(attach(facts, sums, ["comm"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan


def test_stencil_iterations_share_one_shuffle(facts):
    assert shuffles(stencil.stencil_rows(facts, "id", "value", 8)) == 1


def test_newest_is_limited_before_the_shuffle(facts):
    plan = plan_of(experiments.newest(facts, ["comm"], "id", "value", 3))
    assert plan.count("WindowGroupLimit") == 2


def test_scan_shuffles_the_facts_once(facts):
    # One for the totals of the pieces, one for the rows.
    assert shuffles(running_sum(facts, [], ["id"], {"s": "value"})) == 2


def test_filters_reach_the_scan(facts):
    plan = plan_of(traces.unmatched_endpoints(facts.filter("idx = 3"), facts.filter("idx = 4"), ["comm"]))
    assert "EqualTo(idx,3)" in plan and "EqualTo(idx,4)" in plan


def test_written_tables_use_the_shared_folder(spark, facts):
    written = cut(facts, "probe")
    path = written.select(F.col("_metadata.file_path")).first()[0]
    assert "/probe-" in path and shared_dir(spark).rstrip("/").split("/")[-1] in path


def session_on(master, configured, used=None):
    conf = SimpleNamespace(get=lambda key, default=None: configured)
    context = SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: used)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_shared_folder_comes_from_the_session():
    assert shared_dir(session_on("spark://host:7077", "hdfs:///shared")) == "hdfs:///shared"
    assert shared_dir(session_on("local[2]", None, "file:/tmp/x")) == "file:/tmp/x"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session_on("spark://host:7077", None))

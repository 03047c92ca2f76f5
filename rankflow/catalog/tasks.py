"""Chunk tasks and staged tasks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.catalog.registry import cents, query, table
from rankflow.functions.ratios import hundredths
from rankflow.operators.tasks import (
    Reducer,
    Stage,
    chunk_reduce,
    chunk_reduce_python,
    chunk_states,
    chunk_task,
    chunk_task_python,
    merge_states,
    run_stages,
    with_chunks,
)

CHUNKS = 24
SQL_CHUNK = f"least(l_orderkey // ((SELECT count(*) FROM orders) // {CHUNKS}), {CHUNKS - 1})"


def chunked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in chunks of the range of order keys."""
    total = table(spark, sf_dir, "orders").agg(F.count(F.lit(1))).scalar()
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    return with_chunks(lines, "l_orderkey", total, CHUNKS)


@query(
    "chunk_task",
    f"""SELECT {SQL_CHUNK} AS chunk_id, count(*) AS n,
        CAST(sum({cents("l_extendedprice")} * (100 - {cents("l_discount")})) AS BIGINT) AS paid FROM lineitem GROUP BY 1""",
)
def chunk_task_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = hundredths("l_extendedprice") * (100 - hundredths("l_discount"))
    return chunk_task(chunked_lines(spark, sf_dir), paid=paid).groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("paid").alias("paid")
    )


def halve_odd_chunks(batch: pd.DataFrame) -> pd.DataFrame:
    """A user task: even chunks keep their value, odd chunks get half of it."""
    batch["value"] = batch["value"].where(batch["chunk_id"] % 2 == 0, batch["value"] / 2)
    return batch


@query(
    "chunk_task_python",
    f"""SELECT event_id, c AS chunk_id, CASE WHEN c % 2 = 0 THEN value ELSE value / 2 END AS value
        FROM (SELECT event_id, value, least(event_id // ((SELECT count(*) FROM events) // {CHUNKS}), {CHUNKS - 1}) AS c FROM events)""",
)
def chunk_task_python_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "value")
    chunked = with_chunks(events, "event_id", events.agg(F.count(F.lit(1))).scalar(), CHUNKS)
    return chunk_task_python(chunked, halve_odd_chunks, "event_id bigint, value double, chunk_id bigint")


@query(
    "chunk_reduce",
    f"SELECT max({cents('l_extendedprice')})::DOUBLE AS result, count(DISTINCT {SQL_CHUNK}) AS n_chunks FROM lineitem",
)
def chunk_reduce_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.max(hundredths("l_extendedprice")).cast("double")
    return chunk_reduce(chunked_lines(spark, sf_dir), part, lambda a, b: F.greatest(a, b), F.lit(0.0))


@query(
    "chunk_reduce_python",
    f"SELECT max(value * 2) AS result, CAST({CHUNKS} AS BIGINT) AS n_chunks FROM events",
)
def chunk_reduce_python_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "value")
    chunked = with_chunks(events, "event_id", events.agg(F.count(F.lit(1))).scalar(), CHUNKS)
    return chunk_reduce_python(chunked, lambda rows: (float((rows["value"] * 2).max()),), ["max"], lambda most: most, "max")


@query(
    "staged_tasks",
    f"""SELECT o_orderpriority, CAST(sum(v) AS DOUBLE) AS stage_0, CAST(NULL AS DOUBLE) AS stage_1,
        CAST(sum(v * 2) AS DOUBLE) AS stage_2, CAST(max(v * 2 + 1) AS DOUBLE) AS stage_3
        FROM (SELECT o_orderpriority, {cents("o_totalprice")} AS v FROM orders) GROUP BY 1""",
)
def staged_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", hundredths("o_totalprice").alias("v"))

    def total(c):
        return F.sum(c).cast("double")

    stages = [
        Stage(result=total, of=F.col("v")),
        Stage(columns={"v": F.col("v") * 2}),
        Stage(result=total, of=F.col("v")),
        Stage(columns={"v": F.col("v") + 1}, result=lambda c: F.max(c).cast("double"), of=F.col("v")),
    ]
    return run_stages(orders, stages, ["o_orderpriority"])


def moments(rows: pd.DataFrame) -> dict:
    v = rows["v"]
    return {"n": len(v), "total": int(v.sum()), "squares": int((v * v).sum()), "top": sorted(v.tolist(), reverse=True)[:3]}


def merge_moments(a: dict, b: dict) -> dict:
    return {k: a[k] + b[k] for k in ("n", "total", "squares")} | {"top": sorted(a["top"] + b["top"], reverse=True)[:3]}


#: Mean, variance and the three largest values at once.
MOMENTS = Reducer(
    "n bigint, total bigint, squares bigint, top array<bigint>", {"n": 0, "total": 0, "squares": 0, "top": []}, moments, merge_moments
)
SQL_TOP = "array_to_string(list_slice(list_sort(list(v), 'DESC'), 1, 3), ',')"
SQL_MOMENTS = f"""count(*) AS n, CAST(sum(v) AS DOUBLE) / count(*) AS mean,
    CAST(sum(v * v) AS DOUBLE) / count(*) - (CAST(sum(v) AS DOUBLE) / count(*)) * (CAST(sum(v) AS DOUBLE) / count(*)) AS variance,
    {SQL_TOP} AS top"""


@query(
    "chunk_moments",
    f"""WITH r AS (SELECT CAST(floor(o_totalprice) AS BIGINT) AS v,
          least(o_orderkey // ((SELECT count(*) FROM orders) // {CHUNKS}), {CHUNKS - 1}) AS chunk_id FROM orders)
        SELECT chunk_id, {SQL_MOMENTS} FROM r GROUP BY chunk_id
        UNION ALL SELECT -1, {SQL_MOMENTS} FROM r""",
)
def chunk_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").alias("v"))
    total = orders.agg(F.count(F.lit(1))).first()[0]
    chunks = chunk_states(with_chunks(orders, "o_orderkey", total, CHUNKS), MOMENTS, fan_in=4)
    whole = merge_states(chunks.drop("chunk_id"), [], MOMENTS, fan_in=4).withColumn("chunk_id", F.lit(-1).cast("bigint"))
    mean = F.col("total").cast("double") / F.col("n")
    return chunks.unionByName(whole).select(
        "chunk_id", "n", mean.alias("mean"), (F.col("squares").cast("double") / F.col("n") - mean * mean).alias("variance"),
        F.array_join(F.col("top").cast("array<string>"), ",").alias("top"),
    )


def fold_high(batch: pd.DataFrame) -> pd.DataFrame:
    """A user task: values above 100,000 lose that much."""
    batch["v"] = batch["v"].where(batch["v"] <= 100_000, batch["v"] - 100_000)
    return batch


def double(batch: pd.DataFrame) -> pd.DataFrame:
    batch["v"] = batch["v"] * 2
    return batch


SQL_FOLDED = "CASE WHEN v + 1 > 100000 THEN v + 1 - 100000 ELSE v + 1 END"


@query(
    "staged_tasks_python",
    f"""WITH r AS (SELECT o_orderpriority, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders),
        s AS (SELECT o_orderpriority, v, {SQL_FOLDED} AS folded FROM r)
        SELECT o_orderpriority, CAST(sum(v + 1) AS DOUBLE) AS stage_0,
          (SELECT {SQL_TOP} FROM (SELECT t.folded AS v FROM s t WHERE t.o_orderpriority = s.o_orderpriority)) AS stage_1,
          CAST(sum(folded * folded * 4) AS BIGINT) AS stage_2, CAST(max(folded * 2 - 1) AS DOUBLE) AS stage_3,
          CAST(NULL AS DOUBLE) AS stage_4 FROM s GROUP BY 1""",
)
def staged_tasks_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column stages and Python stages over one buffer, in one scan."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", F.floor("o_totalprice").alias("v"))
    stages = [
        Stage(columns={"v": F.col("v") + 1}, result=lambda c: F.sum(c).cast("double"), of=F.col("v")),
        Stage(python=fold_high, reducer=MOMENTS, finish=lambda n, t, s, top: F.array_join(top.cast("array<string>"), ",")),
        Stage(python=double, reducer=MOMENTS, finish=lambda n, total, squares, top: squares),
        Stage(columns={"v": F.col("v") - 1}, result=lambda c: F.max(c).cast("double"), of=F.col("v")),
        Stage(python=double),
    ]
    return run_stages(orders, stages, ["o_orderpriority"], fan_in=4)

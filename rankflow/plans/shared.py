"""Tables written once to the folder all executors share.

A written table survives lost executors, cuts the lineage of an iteration and
tells Catalyst its true size, so that a later join broadcasts it only when it
is below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster the setting is required.
    """
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    folder = sc.getCheckpointDir()
    if folder is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="rankflow-"))
        folder = sc.getCheckpointDir()
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys that may be null; keeps the left side's key columns."""
    renamed = right.select(*[right[c].alias(f"_r_{c}") if c in keys else right[c] for c in right.columns])
    cond = None
    for key in keys:
        term = left[key].eqNullSafe(renamed[f"_r_{key}"])
        cond = term if cond is None else cond & term
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def attach(fact: DataFrame, groups: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Bring one row per group back to every fact row.

    ``groups`` is written first, so the fact side is scanned without a shuffle
    whenever the table is small.  When it is not, this is a sort-merge join
    whose oversize partitions adaptive execution splits; a hot group is then
    read by many tasks against one replicated row.  A null key is a group too.
    """
    return null_safe(fact, cut(groups, "groups"), keys, how)

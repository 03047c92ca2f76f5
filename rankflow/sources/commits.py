"""Tables of parquet parts that count only once a record of them is written.

A part is written first, under a name of its own; the record that names it is written last.  Readers take the
recorded parts only, so a failed try leaves rows behind that nobody reads.

``append_run`` keeps one record per run: appending a run again, after a success or a failure, does not double it.
``refresh`` keeps a manifest of the inputs of a combined table: only groups whose input files have changed (by
path, size or time) are read and written again, and one new manifest swaps all of them in.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_RECORD = "run string, part string"
MANIFEST = "version long, grp string, files long, mark decimal(38,0), part string"


def _records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records written so far; none where nothing is there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_run(df: DataFrame, path: str, run: str) -> bool:
    """Add the rows of a run exactly once; False where the run is recorded already.

    Where two tries race, both are recorded and readers take the part with the smaller name.
    """
    spark = df.sparkSession
    if not _records(spark, f"{path}/records", RUN_RECORD).filter(F.col("run") == run).isEmpty():
        return False
    part = f"p{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/parts/part={part}")
    spark.createDataFrame([(run, part)], RUN_RECORD).coalesce(1).write.mode("append").parquet(f"{path}/records")
    return True


def read_runs(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All rows of recorded runs; parts that no record names are pruned by the join on their folder's name."""
    records = _records(spark, f"{path}/records", RUN_RECORD)
    taken = records.groupBy("run").agg(F.min("part").alias("part"))
    reader = spark.read if schema is None else spark.read.schema(T.StructType([*schema, T.StructField("part", T.StringType())]))
    return reader.parquet(f"{path}/parts").join(taken.select("part"), "part", "left_semi").drop("part")


def input_marks(spark: SparkSession, inputs: str, group: str) -> DataFrame:
    """``(grp, files, mark)`` of the input files: ``group`` is a regular expression whose first group names a file's group.

    The mark changes with any file's path, size or time.  Only the listing is read, no content.
    """
    files = spark.read.format("binaryFile").load(inputs).select("path", "length", "modificationTime")
    name = F.regexp_extract("path", group, 1)
    mark = F.xxhash64("path", "length", F.unix_micros("modificationTime")).cast("decimal(20,0)")
    return files.groupBy(name.alias("grp")).agg(F.count(F.lit(1)).alias("files"), F.sum(mark).cast("decimal(38,0)").alias("mark"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The newest manifest: one row per group with the part that holds it."""
    rows = _records(spark, f"{path}/manifests", MANIFEST)
    newest = rows.groupBy().agg(F.max("version").alias("version"))
    return rows.join(newest, "version", "left_semi")


def refresh(
    spark: SparkSession, inputs: str, group: str, read: Callable[[list[str]], DataFrame], path: str
) -> tuple[list[str], list[str]]:
    """Bring the combined table up to date; returns the names of the groups written again and of those gone.

    ``read`` reads the input files of the stale groups, given as a list of paths, and has to keep their path as
    ``_file``.  Names of stale groups and paths of their files go through the driver, as does any list
    of paths that Spark reads; unchanged groups are neither listed nor read.
    """
    now = input_marks(spark, inputs, group)
    old = manifest(spark, path)
    both = now.select("grp", "files", "mark").join(
        old.select("grp", F.col("mark").alias("_mark"), F.col("part").alias("_part"), "version"), "grp", "full_outer"
    )
    state = both.select(
        "grp", "files", "mark", "_part",
        F.when(F.col("files").isNull(), "gone").when(F.col("mark").eqNullSafe(F.col("_mark")), "same").otherwise("stale").alias("state"),
    ).persist()
    stale = sorted(r["grp"] for r in state.filter("state = 'stale'").select("grp").collect())
    gone = sorted(r["grp"] for r in state.filter("state = 'gone'").select("grp").collect())
    if stale or gone:
        part = f"p{uuid.uuid4().hex}"
        if stale:
            files = spark.read.format("binaryFile").load(inputs).select("path")
            names = [r["path"] for r in files.filter(F.regexp_extract("path", group, 1).isin(stale)).collect()]
            rows = read(names)
            rows = rows.withColumn("grp", F.regexp_extract("_file", group, 1)).drop("_file")
            rows.write.partitionBy("grp").parquet(f"{path}/parts/part={part}")
        version = (old.agg(F.max("version")).first()[0] or 0) + 1
        kept = state.filter("state <> 'gone'").select(
            F.lit(version).cast("long").alias("version"), "grp", "files", "mark",
            F.when(F.col("state") == "same", F.col("_part")).otherwise(F.lit(part)).alias("part"),
        )
        # One file, so that the manifest is there as a whole or not at all.
        kept.coalesce(1).write.mode("append").parquet(f"{path}/manifests")
    state.unpersist()
    return stale, gone


def read_combined(spark: SparkSession, path: str) -> DataFrame:
    """The combined rows by the newest manifest, with their group as ``grp``; other parts are pruned by the join."""
    taken = manifest(spark, path).select("part", "grp")
    found = spark.read.parquet(f"{path}/parts").schema
    # Folder names are texts, whatever they look like.
    named = [T.StructField(f.name, T.StringType()) if f.name in ("part", "grp") else f for f in found]
    rows = spark.read.schema(T.StructType(named)).parquet(f"{path}/parts")
    return rows.join(taken, ["part", "grp"], "left_semi").drop("part")

"""Text logs with line numbers, profiler reports, placement maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow import schemas
from rankflow.plans import row_number
from rankflow.sources.headed import read_united


def lines_of(df: DataFrame, text: str, keep: list[str], start: int = 1) -> DataFrame:
    """The lines of a text column, numbered from ``start``."""
    rows = df.select(*keep, F.posexplode(F.split(text, "\n")).alias("_pos", "line"))
    return rows.select(*keep, (F.col("_pos") + start).cast("bigint").alias("line_no"), "line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, line)`` of small log files, one whole file per row first."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines_of(whole.withColumn("value", F.regexp_replace("value", "\n$", "")), "value", ["file"])


def read_long_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, line)`` of files of any size.

    A block of a file is read in order by one task, so (block start, running
    id) is the order of lines in the file; numbering then works on groups of
    bounded size.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    numbered = row_number(raw, ["file"], ["_block", "_id"], "line_no")
    return numbered.select("file", "line_no", "line")


def read_profiler(spark: SparkSession, path: str) -> DataFrame:
    """Profiler report bound by its header: symbol, effective seconds, wait seconds, then its other columns as text."""
    kinds = {f.name: f.dataType for f in schemas.PROFILER}
    df = read_united(spark, path, lambda name: kinds.get(name, T.StringType()), kinds).drop("_file")
    more = [F.col(f"`{n}`") for n in df.columns if n not in kinds]
    named = zip(kinds, ("symbol", "effective_time", "wait_time"), strict=True)
    return df.select(*[F.col(f"`{n}`").alias(own) for n, own in named], *more)


def read_placement(spark: SparkSession, path: str) -> DataFrame:
    """``rank:process`` lines; a malformed line fails the load."""
    good = F.col("value").rlike(r"^\s*\d+\s*:\s*\d+\s*$")
    ends = F.split(F.when(good, F.col("value")).otherwise(
        F.raise_error(F.concat(F.lit("bad placement line: "), F.col("value")))
    ), ":")
    rows = read_long_lines(spark, path).withColumnRenamed("line", "value").filter(F.trim("value") != "")
    return rows.select(
        F.col("line_no").alias("position"),
        F.trim(ends[0]).cast("bigint").alias("rank"),
        F.trim(ends[1]).cast("bigint").alias("process"),
    )


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """``r,r,r`` per node, ``#`` comments: ``(node, position, rank)``."""
    lines = read_long_lines(spark, path).filter(~F.trim("line").startswith("#") & (F.trim("line") != ""))
    nodes = row_number(lines, ["file"], ["line_no"], "node", start=0)
    cells = nodes.select("node", F.posexplode(F.split("line", ",")).alias("position", "_r"))
    return cells.select("node", "position", F.trim("_r").cast("bigint").alias("rank"))

"""Results tables, counter files and directories of CSV files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow import schemas
from rankflow.sources.headed import read_by_name, read_united
from rankflow.sources.stats import _plain


#: Names of hardware events: whole words, or with a hyphen or dot, which no layout column has; a precision may follow.
COUNTER = re.compile(r"(cycles|instructions|branches|faults|[A-Za-z0-9_]+[-.][A-Za-z0-9_.-]*[A-Za-z0-9])(:[a-z]+)?")
#: Layout columns that come in any number, with their types.
NUMBERED = {
    re.compile(r"custom\d+_timer_name|run_args_\d+"): T.StringType(),
    re.compile(r"custom\d+_elapsed_cycles"): T.LongType(),
}


def read_results(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    header: bool = True,
    prefix: str = "",
    counters: re.Pattern | None = COUNTER,
    keep_file: bool = False,
) -> DataFrame:
    """Tab-separated results, one row per rank per run, bound by each file's own header.

    Files may differ in the order of columns, in how many custom timers they have and in their counters: a column
    whose name ``counters`` matches holds whole numbers.  The result has the layout's columns, then further timers and
    counters, each null in rows of files without it.  A header without run, rank or time, an unknown
    column and a malformed number fail the load.  With ``schema`` the columns are exactly its own.  ``keep_file``
    adds the path of each row's file as ``_file``.
    """
    if not header:
        plain = spark.read.csv(path, schema=schema or schemas.results(prefix=prefix), sep="\t", header=False, mode="FAILFAST")
        return _plain(plain, prefix)
    if schema is not None:
        return _plain(read_by_name(spark, path, schema, sep="\t").drop("_file"), prefix)
    layout = {f.name: f.dataType for f in schemas.results(prefix=prefix)}

    def kind(name: str) -> T.DataType | None:
        if name in layout:
            return layout[name]
        if counters is not None and counters.fullmatch(name):
            return T.LongType()
        return next((t for form, t in NUMBERED.items() if form.fullmatch(name)), None)

    df = read_united(spark, path, kind, [f"{prefix}run_unique_id", f"{prefix}thread_rank", "elapsed_cycles"], sep="\t")
    absent = [F.lit(None).cast(t).alias(n) for n, t in layout.items() if n not in df.columns]
    more = [n for n in df.columns if n not in layout and n != "_file"]
    own = [*layout, *more, *(["_file"] if keep_file else [])]
    return _plain(df.select("*", *absent).select(*[F.col(f"`{n}`") for n in own]), prefix)


def counter_rows(lines: DataFrame, position: str, line: str, names: list[str]) -> DataFrame:
    """Counter lines to ``(event, value)``: the first field is the value, the line's place names it.

    Empty lines are skipped; a counter beyond the names is an error.
    """
    surplus = F.raise_error(F.concat(F.lit("counter without a name: "), F.col(line))).cast("string")
    labels = F.array(*[F.lit(n) for n in names])
    keep = [c for c in lines.columns if c not in (position, line)]
    return lines.filter(F.trim(line) != "").select(
        *keep,
        F.coalesce(F.get(labels, F.col(position).cast("int")), surplus).alias("event"),
        F.get(F.split(line, ";"), F.lit(0)).try_cast("bigint").alias("value"),
    )


def read_counters(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """One row per counter file, one column per event."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    rows = counter_rows(lines, "pos", "line", names)
    return rows.groupBy("file").pivot("event", names).agg(F.first("value"))


def read_csvs(spark: SparkSession, path: str, schema: T.StructType | str, file_regex: str | None = None) -> DataFrame:
    """All CSV files of a directory whose path matches, bound by their headers; no file is an error."""
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    df = read_by_name(spark, path, kinds, pathGlobFilter="*.csv")
    if file_regex is not None:
        df = df.filter(F.col("_file").rlike(file_regex))
    if df.isEmpty():
        raise FileNotFoundError(f"no rows in CSV files below {path} matching {file_regex}")
    return df.drop("_file")

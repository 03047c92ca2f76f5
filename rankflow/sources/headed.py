"""Delimited files bound to columns by their header lines."""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.plans import attach

Kinds = Callable[[str], T.DataType | None]
FILE = "_file"


def _ddl(names: Iterable[str], kinds: Kinds) -> str:
    return ", ".join(f"`{n}` {kinds(n).simpleString()}" for n in names)


def header_lines(lines: DataFrame) -> DataFrame:
    """``(file, head)``: the first line of each file of a text scan; one row per file.

    The first line's number is found first, then its text: a minimum of numbers is kept in a
    hash table of files, while one of texts would sort every line of a block.
    """
    first = lines.select(
        F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value",
    ).filter("block = 0")
    least = first.groupBy(FILE).agg(F.min("id").alias("_first")).select("_first")
    # One number a file; without the hint every line is shuffled before the numbers' size is known.
    return first.join(F.broadcast(least), F.col("id") == F.col("_first")).select(FILE, F.col("value").alias("head"))


def read_united(
    spark: SparkSession, path: str | list[str], kinds: Kinds, needed: Iterable[str] = (), sep: str = ",", **options
) -> DataFrame:
    """Delimited files, each bound by its own header; the columns of all headers united by name and type.

    ``kinds`` gives a column's type by its name, None for a column that must not be there; names in ``needed`` have to
    be in every header, or in the folders' names (``name=value``).  A column that a file does not have is null in its
    rows.  A row that does not fit its header or types fails the load.  The result has the file's path as ``_file``.

    Only the different headers reach the driver, however many files there are.  With one header the files are
    scanned as they are; with several, one scan of their lines parses each by its file's header.  A quoted field
    must not hold a line break.
    """
    glob = {k: options.pop(k) for k in ("pathGlobFilter",) if k in options}
    lines = spark.read.text(path, **glob)
    folders = [c for c in lines.columns if c != "value"]
    files = header_lines(lines)
    heads = sorted(r["head"] for r in files.select("head").distinct().collect())
    bound = [[name.strip() for name in next(csv.reader([head], delimiter=sep))] for head in heads]
    for names in bound:
        other = [n for n in names if kinds(n) is None]
        missing = [n for n in needed if n not in names and n not in folders]
        twice = sorted({n for n in names if names.count(n) > 1})
        if other or missing or twice:
            raise ValueError(f"columns {names}: unknown {other}, missing {missing}, repeated {twice}")
    columns = list(dict.fromkeys(n for names in bound for n in names))
    # A folder's name stands for a column only where no header has it.
    folders = [n for n in folders if n not in columns and kinds(n) is not None]
    if len(heads) <= 1:
        layout = _ddl([*columns, *folders], kinds) or "value string"
        df = spark.read.csv(path, schema=layout, header=True, sep=sep, mode="FAILFAST", **glob, **options)
        return df.withColumn(FILE, F.col("_metadata.file_path")).select(*[F.col(f"`{n}`") for n in [*columns, *folders]], FILE)
    place = F.array_position(F.array(*[F.lit(h) for h in heads]), F.col("head"))
    held = [F.col(f"`{n}`").cast(kinds(n)).alias(n) for n in folders]
    rows = lines.select("value", *held, F.col("_metadata.file_path").alias(FILE))
    rows = attach(rows, files, [FILE]).filter((F.col("value") != F.col("head")) & (F.trim("value") != ""))
    form = {k: str(v) for k, v in {"sep": sep, "mode": "FAILFAST", **options}.items()}
    parsed = [
        F.when(place == i, F.from_csv("value", _ddl(names, kinds), form)).alias(f"_{i}") for i, names in enumerate(bound, 1)
    ]
    rows = rows.select(*folders, FILE, *parsed)

    def united(name: str) -> Column:
        found = [F.col(f"_{i}")[name] for i, names in enumerate(bound, 1) if name in names]
        return F.coalesce(*found).alias(name)

    return rows.select(*[united(n) for n in columns], *[F.col(f"`{n}`") for n in folders], FILE)


def read_by_name(spark: SparkSession, path: str | list[str], schema: T.StructType, sep: str = ",", **options) -> DataFrame:
    """Delimited files whose headers name exactly the schema's columns, in any order, or their folders do."""
    kinds = {f.name: f.dataType for f in schema}
    df = read_united(spark, path, kinds.get, kinds, sep, **options)
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in df.columns]
    return df.select("*", *absent).select(*[F.col(f"`{n}`") for n in kinds], FILE)

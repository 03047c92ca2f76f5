"""Names, keys and text clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THREAD_NAME = r"p(\d{4,})m(\d{4,})t(\d{4,})"


def zero_padded(number: Column, width: int) -> Column:
    """At least ``width`` digits; longer numbers stay whole."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))


def _four(number: Column) -> Column:
    return zero_padded(number, 4)


def thread_name(rank: Column, process: Column, thread: Column) -> Column:
    """``pRRRRmMMMMtTTTT``."""
    return F.concat(F.lit("p"), _four(rank), F.lit("m"), _four(process), F.lit("t"), _four(thread))


def thread_fields(name: Column) -> Column:
    """Rank, process and thread of a thread name."""

    def part(i):
        return F.regexp_extract(name, THREAD_NAME, i).cast("int")

    return F.struct(part(1).alias("rank"), part(2).alias("process"), part(3).alias("thread"))


def config_label(*parts: Column) -> Column:
    """Join the parts that are present with ``-`` and squeeze runs of it."""
    joined = F.regexp_replace(F.concat_ws("-", *parts), "-+", "-")
    return F.regexp_replace(joined, "-$", "")


def numbered(label: str, value: Column, digits: int) -> Column:
    """``label-000123``; null for a null value."""
    return F.concat(F.lit(f"{label}-"), zero_padded(value, digits))


def runtime_key(
    runtime: Column, procs: Column, threads: Column, version: Column, queue: Column, extra: Column
) -> Column:
    """``runtime-pNtN[-pcvX[-qsNNNN]][-extra]``."""
    size = F.concat(F.lit("p"), procs.cast("string"), F.lit("t"), threads.cast("string"))
    channel = F.concat(F.lit("pcv"), version.cast("string"))
    depth = F.when(version.isNotNull(), numbered("qs", queue, 4))
    depth = F.regexp_replace(depth, "^qs-", "qs")
    return F.concat_ws("-", runtime, size, channel, depth, extra)


def last_parts(path: Column, count: int = 2) -> Column:
    """The last ``count`` components of a path."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - (count - 1), F.lit(1)), F.lit(count)), "/")


def blank_commas(text: Column) -> Column:
    """Commas to blanks, so that the value fits one field."""
    return F.translate(text, ",", " ")


def clean_zero(text: Column) -> Column:
    """Empty text and a lone ``0`` stand for no value."""
    return F.when(~text.isin("", "0"), text)


def padded_arguments(text: Column, width: int, prefix: str = "run_args_") -> list[Column]:
    """Blank-separated arguments as ``width`` columns; too many is an error."""
    parts = F.split(text, r"\s+")
    checked = F.when(F.size(parts) <= width, parts).otherwise(
        F.raise_error(F.concat(F.lit(f"more than {width} arguments: "), text))
    )
    return [F.get(checked, F.lit(i)).alias(f"{prefix}{i}") for i in range(width)]

"""Fixed-width message headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field names and widths of the header, in order.
FIELDS = (
    ("count", 6),
    ("count_bytes", 7),
    ("datatype", 10),
    ("receiver", 5),
    ("tag", 5),
    ("sender", 5),
    ("seq_id", 5),
)
WIDTH = sum(w for _, w in FIELDS)


def encode_header(**values: Column) -> Column:
    """Seven zero-padded fields in one string; null when a value is too wide or negative."""
    fits = F.lit(True)
    for name, width in FIELDS:
        fits = fits & values[name].between(0, 10**width - 1)
    text = F.concat(*[F.lpad(values[name].cast("string"), width, "0") for name, width in FIELDS])
    return F.when(fits, text)


def decode_header(header: Column) -> Column:
    """The seven fields as a struct."""
    fields, at = [], 1
    for name, width in FIELDS:
        fields.append(F.substring(header, at, width).try_cast("bigint").alias(name))
        at += width
    return F.struct(*fields)


def header_is_good(header: Column) -> Column:
    """Right length, digits only, and whole elements (``bytes % count == 0``)."""
    fields = decode_header(header)
    whole = F.when(fields["count"] > 0, fields["count_bytes"] % fields["count"] == 0).otherwise(False)
    return F.coalesce(header.rlike(f"^[0-9]{{{WIDTH}}}$") & whole, F.lit(False))

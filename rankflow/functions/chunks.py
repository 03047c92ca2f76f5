"""Which chunk or slice an index belongs to, and the range of each chunk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_BYTES = 64


def _whole(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _checked(length: Column, what: str) -> Column:
    return F.when(length > 0, length).otherwise(F.raise_error(F.lit(f"more chunks than {what}")))


def chunk_length(total: Column, chunks: int) -> Column:
    """Elements per chunk; the last chunk also takes the rest."""
    return _checked(_whole(total, F.lit(chunks)), "elements")


def chunk_of(idx: Column, total: Column, chunks: int, offset: int = 0) -> Column:
    """Chunk of an element when ``total`` elements go into ``chunks`` parts."""
    return F.least(_whole(idx - offset, chunk_length(total, chunks)), F.lit(chunks - 1))


def aligned_length(total: Column, chunks: int, element_bytes: int) -> Column:
    """Elements per chunk when chunks hold whole 64-byte lines."""
    per_line = LINE_BYTES // element_bytes
    lines = _whole(_whole(total, F.lit(per_line)), F.lit(chunks))
    return _checked(lines, "lines") * per_line


def aligned_chunk_of(idx: Column, total: Column, chunks: int, element_bytes: int) -> Column:
    """Line-aligned chunk of an element."""
    return F.least(_whole(idx, aligned_length(total, chunks, element_bytes)), F.lit(chunks - 1))


def chunk_bounds(chunk: Column, length: Column, total: Column, chunks: int, offset: int = 0) -> Column:
    """Inclusive ``(min_idx, max_idx)`` of a chunk."""
    low = chunk * length + offset
    high = F.when(chunk == chunks - 1, total + offset - 1).otherwise(low + length - 1)
    return F.struct(low.alias("min_idx"), high.alias("max_idx"))


def slice_of(idx: Column, count: Column, ranks: int, element_bytes: int) -> Column:
    """Rank that reduces an element: whole lines per rank, the last active rank takes the rest."""
    lines = _whole(count * element_bytes + (LINE_BYTES - 1), F.lit(LINE_BYTES))
    per_rank = F.greatest(_whole(lines, F.lit(ranks)), F.lit(1))
    active = F.least(lines, F.lit(ranks))
    return F.least(_whole(idx * element_bytes, per_rank * LINE_BYTES), active - 1)

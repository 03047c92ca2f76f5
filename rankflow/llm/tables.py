"""Input tables and small helpers shared by the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words: blank and the five ASCII controls from tab to carriage return.
BLANKS = "[\\x20\\x09-\\x0D]+"
#: The same for byte strings in Python.
BLANK_BYTES = b" \t\n\x0b\x0c\r"
#: Bytes with A-Z lower-cased and every blank turned into a space.
LOWER = bytes.maketrans(bytes(range(65, 91)) + BLANK_BYTES, bytes(range(97, 123)) + b" " * 6)
#: Texts handled at once inside a task; bounds what numpy holds beside one Arrow batch.
CHUNK_CHARS = 1 << 21
#: Bytes at which Spark ends an Arrow batch inside ``small_batches``; a row more still fits in ``CHUNK_CHARS``, unless its text is long.
BATCH_BYTES = 3 << 19
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read whole."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words of a UTF-8 text."""
    return text.translate(LOWER).split()


def present(text: str | Column) -> Column:
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def map_rows(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``work`` to Arrow batches cut to at most about ``CHUNK_CHARS`` of text each.

    A batch holds as many rows as the session's Arrow settings allow; long texts
    are handed on in smaller pieces so that a task's memory follows the longest
    single text, not the batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut_batch(batch):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def cut_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose buffers stay near ``CHUNK_CHARS`` bytes."""
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, int(rows * CHUNK_CHARS / max(batch.nbytes, 1)))
    if step >= rows:
        yield batch
        return
    for start in range(0, rows, step):
        yield batch.slice(start, step)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of queries run inside end at ``BATCH_BYTES``, or with a text that is longer.

    Else they hold as many rows as the session allows, whatever their texts: an executor keeps each
    running task's batch as vectors and once more as the bytes it sends, and its Python worker keeps it too.
    """
    before = spark.conf.get(ARROW_BYTES, None)
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ARROW_BYTES)
        else:
            spark.conf.set(ARROW_BYTES, before)


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hashes of ``key``; the same in every run.

    Where there are many more, a bound on the hash drops most of them first, so that no task
    has to sort what all others have kept; where few keys repeat and it would leave too few, it
    is not used.  The rows are the same either way.  Callers select narrow columns.
    """
    total, space = df.count(), 1 << 30
    place = F.pmod(F.xxhash64(key), F.lit(space))
    if total > 8 * rows:
        likely = df.filter(place < math.ceil(space * 2 * rows / total))
        df = likely if likely.limit(rows).count() == rows else df
    return df.orderBy(place, F.xxhash64(key), *df.columns).limit(rows)


#: Numbers that ``touched`` broadcasts at most.
RESIDUES = 1 << 21


def touched(rows: DataFrame, keyed: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Rows whose ``column`` has the residue of one in ``keyed`` (left_semi), or has not (left_anti).

    A sieve before a join: rows left out need not be shuffled.  At most ``RESIDUES``
    numbers are broadcast, whatever the data; where they are used up, all rows pass.
    """
    residues = keyed.select(F.pmod(column, F.lit(RESIDUES)).alias("_residue")).distinct()
    return rows.join(F.broadcast(residues), F.pmod(rows[column], F.lit(RESIDUES)) == F.col("_residue"), how)


class Memo(dict):
    """A cache inside a Python worker that forgets everything once it holds ``limit`` entries.

    Keys longer than ``longest`` are not kept.  Only speed depends on it: what is missing is computed again.
    """

    def __init__(self, make: Callable, limit: int = 1 << 19, longest: int | None = None):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if self.longest is None or len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value

"""Chunk tasks: a function over chunks of an indexed array, with or without a result."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankflow.functions.chunks import aligned_chunk_of, chunk_of
from rankflow.operators.collectives import OPS
from rankflow.plans import cut, row_number
from rankflow.plans.shared import null_safe

#: States that one task merges at a time.
FAN_IN = 64


def with_chunks(
    df: DataFrame, idx: str, total: int | Column, chunks: int, element_bytes: int | None = None, offset: int = 0
) -> DataFrame:
    """Add ``chunk_id``; ``element_bytes`` asks for chunks of whole 64-byte lines."""
    total = F.lit(total) if isinstance(total, int) else total
    at = F.col(idx)
    if element_bytes:
        chunk = aligned_chunk_of(at, total, chunks, element_bytes)
    else:
        chunk = chunk_of(at, total, chunks, offset)
    return df.withColumn("chunk_id", chunk)


def chunk_task(chunked: DataFrame, **columns: Column) -> DataFrame:
    """A task without a result: new or changed columns of each element."""
    return chunked.withColumns(columns)


def chunk_task_python(chunked: DataFrame, task: Callable, schema) -> DataFrame:
    """A task written in Python.

    ``task`` gets pandas batches that carry ``chunk_id``; a chunk may come in
    several batches, so no chunk has to fit one task's memory.
    """

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            yield task(batch)

    return chunked.mapInPandas(run, schema)


def chunk_reduce(
    chunked: DataFrame,
    partial: Column,
    merge: Callable[[Column, Column], Column],
    identity: Column,
    name: str = "result",
) -> DataFrame:
    """A returning task: ``partial`` aggregates each chunk, ``merge`` folds the chunks in order.

    There is one value per chunk, so the fold sees at most as many values as
    there are chunks.  ``identity`` must not change a value it is merged with.
    """
    parts = chunked.groupBy("chunk_id").agg(partial.alias("_part"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_id", "_part")))
    checked = F.transform(
        F.transform(ordered, lambda p: p["_part"]),
        lambda x: F.when(merge(identity, x).eqNullSafe(x), x).otherwise(
            F.raise_error(F.lit("the initial value is not an identity of the reducer")).cast("double")
        ),
    )
    return parts.agg(F.reduce(checked, identity, merge).alias(name), F.count(F.lit(1)).alias("n_chunks"))


def chunk_reduce_python(
    chunked: DataFrame,
    partial: Callable,
    merge: list[str],
    finish: Callable[..., Column],
    op: str,
    name: str = "result",
) -> DataFrame:
    """A returning task written in Python.

    ``partial`` turns a pandas frame of rows of one chunk into as many floats as
    ``merge`` names reducers (sum, min, max or prod).  A chunk may come in several
    frames; their floats meet in those reducers, and ``finish`` makes the chunk's
    value of them, so that it does not matter how rows were cut into frames.
    The chunks' values meet in ``op``.
    """
    fields = [f"_p{i}" for i in range(len(merge))]

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            parts = [(chunk, *partial(rows)) for chunk, rows in batch.groupby("chunk_id")]
            yield pd.DataFrame(parts, columns=["chunk_id", *fields])

    parts = chunked.mapInPandas(run, "chunk_id bigint, " + ", ".join(f"{f} double" for f in fields))
    merged = parts.groupBy("chunk_id").agg(*[OPS[m](F.col(f)).alias(f) for m, f in zip(merge, fields)])
    chunks = merged.select("chunk_id", finish(*map(F.col, fields)).alias("_part"))
    return chunks.agg(OPS[op](F.col("_part")).alias(name), F.count(F.lit(1)).alias("n_chunks"))


@dataclass
class Reducer:
    """A user's reducer in Python: states with typed fields, in any order of rows and merges.

    ``state`` lists the fields and their types; ``partial`` turns a pandas frame of rows into a state (a dict),
    ``merge`` makes one of two and has to be associative and commutative, and ``zero`` must not change a state
    it is merged with.
    """

    state: str
    zero: dict
    partial: Callable[[pd.DataFrame], dict]
    merge: Callable[[dict, dict], dict]

    @property
    def fields(self) -> T.StructType:
        return T.StructType.fromDDL(self.state)

    def checked(self, state: dict) -> dict:
        if self.merge(dict(self.zero), dict(state)) != state:
            raise ValueError(f"the initial value {self.zero} is not an identity of the reducer: it changes {state}")
        return state


def merge_states(states: DataFrame, keys: list[str], reducer: Reducer, fan_in: int = FAN_IN) -> DataFrame:
    """One state per group of ``keys``, whatever number there is.

    The states of a group are numbered, and rounds merge ``fan_in`` neighbours in a task each until one is
    left, so no group, hot or not, meets in one task beyond that number.
    """
    names = reducer.fields.fieldNames()
    plain = states.select(*keys, *names)
    out = to_arrow_schema(T.StructType([*(plain.schema[k] for k in keys), T.StructField("_slot", T.LongType()), *reducer.fields]))
    rows = cut(plain.withColumn("_slot", F.monotonically_increasing_id()), "states")
    rows = cut(row_number(rows, keys, ["_slot"], "_place", start=0).drop("_slot").withColumnRenamed("_place", "_slot"), "states")

    def merged(group: pa.Table) -> pa.Table:
        total, held = None, group.to_pylist()
        for row in held:
            state = reducer.checked({n: row[n] for n in names})
            total = state if total is None else reducer.merge(total, state)
        return pa.Table.from_pylist([{k: held[0][k] for k in keys} | {"_slot": held[0]["_slot"]} | total], schema=out)

    kinds = T.StructType([*(rows.schema[k] for k in keys), rows.schema["_slot"], *reducer.fields])
    while True:
        if not rows.agg(F.max("_slot")).first()[0]:
            return rows.select(*keys, *names)
        rows = rows.withColumn("_slot", F.call_function("div", F.col("_slot"), F.lit(fan_in)))
        rows = cut(rows.groupBy(*keys, "_slot").applyInArrow(merged, kinds).select(*keys, "_slot", *names), "states")


def chunk_states(chunked: DataFrame, reducer: Reducer, fan_in: int = FAN_IN) -> DataFrame:
    """The reducer's state of every chunk; a task sends on one state per chunk it has rows of."""
    kinds = T.StructType([T.StructField("chunk_id", chunked.schema["chunk_id"].dataType), *reducer.fields])
    schema = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for chunk, state in _partials(batch.to_pandas(), ["chunk_id"], reducer):
                held[chunk] = reducer.merge(held[chunk], state) if chunk in held else state
        yield pa.RecordBatch.from_pylist([{"chunk_id": chunk[0]} | state for chunk, state in held.items()], schema=schema)

    return merge_states(chunked.mapInArrow(run, kinds), ["chunk_id"], reducer, fan_in)


def _partials(rows: pd.DataFrame, keys: list[str], reducer: Reducer) -> Iterator[tuple[tuple, dict]]:
    """(key values, state) of each group of a frame; a missing key is None."""
    for key, group in rows.groupby(keys, dropna=False) if keys else [((), rows)]:
        yield tuple(None if pd.isna(k) else k for k in key), reducer.checked(reducer.partial(group))


@dataclass
class Stage:
    """A step over the buffer: changed columns, then an optional aggregate of the buffer's state.

    A step in Python gives ``python`` instead of ``columns``: a function from pandas batches to batches with the same
    columns, in which a group's rows may come in several batches; with ``reducer`` it returns the
    reducer's state of the changed buffer, of which ``finish`` makes the result.
    """

    columns: dict[str, Column] = field(default_factory=dict)
    result: Callable[[Column], Column] | None = None
    of: Column | None = None
    python: Callable[[pd.DataFrame], pd.DataFrame] | None = None
    reducer: Reducer | None = None
    finish: Callable[..., Column] | None = None


def run_stages(df: DataFrame, stages: list[Stage], keys: list[str] | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """Run stages in order over the same buffer; one result column per stage, null when it returns nothing.

    Each stage's input is kept in its own column, so all results come out of one pass.  Python stages are a
    chain of Arrow maps in that pass: a task hands a stage's partial states on as rows of their own beside the
    buffer, marked with the stage's number, which later stages leave alone.  Where there are such stages, what the
    results need is written once; states are then merged by rounds of bounded size.
    """
    keys = keys or []
    python = [i for i, stage in enumerate(stages) if stage.python is not None]
    buffer = list(df.columns)
    if python:
        df = df.withColumns({"_side": F.lit(None).cast("int"), "_state": F.lit(None).cast("binary")})
    results = []
    for i, stage in enumerate(stages):
        if stage.python is not None:
            df = df.mapInArrow(_python_stage(df.schema, stage, i, keys, buffer), df.schema)
        elif stage.columns:
            df = df.withColumns(stage.columns)
        if stage.result is None:
            results.append(F.max(F.lit(None).cast("double")).alias(f"stage_{i}"))
        else:
            df = df.withColumn(f"_stage_{i}", stage.of)
            results.append(stage.result(F.col(f"_stage_{i}")).alias(f"stage_{i}"))
    if not python:
        return df.groupBy(*keys).agg(*results)
    df = cut(df.select(*keys, "_side", "_state", *[c for c in df.columns if c.startswith("_stage_")]), "stages")
    out = df.filter("_side IS NULL").groupBy(*keys).agg(*results)
    for i in python:
        if stages[i].reducer is not None:
            out = _with_states(out, df.filter(F.col("_side") == i), stages[i], f"stage_{i}", keys, fan_in)
    return out.select(*keys, *[f"stage_{i}" for i in range(len(stages))])


def _python_stage(schema: T.StructType, stage: Stage, number: int, keys: list[str], buffer: list[str]) -> Callable:
    """An Arrow map that changes the buffer's rows, passes other stages' rows on, and adds its own at its end."""
    arrow, reducer = to_arrow_schema(schema), stage.reducer
    fields = to_arrow_schema(reducer.fields) if reducer is not None else None
    rest = [n for n in schema.fieldNames() if n not in buffer]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("_side")).is_null()
            yield batch.filter(pc.invert(own))
            rows = batch.filter(own)
            if not rows.num_rows:
                continue
            changed = stage.python(rows.select(buffer).to_pandas())
            table = pa.Table.from_pandas(changed, schema=pa.schema([arrow.field(n) for n in buffer]), preserve_index=False)
            for name in rest:
                table = table.append_column(arrow.field(name), rows.column(rows.schema.get_field_index(name)))
            yield from table.select(arrow.names).cast(arrow).to_batches()
            for key, state in _partials(changed, keys, reducer) if reducer is not None else ():
                held[key] = reducer.merge(held[key], state) if key in held else state
        if held:
            states = [
                dict(zip(keys, key, strict=True)) | {"_side": number, "_state": _packed(state, fields)} for key, state in held.items()
            ]
            yield pa.RecordBatch.from_pylist(states, schema=arrow)

    return run


def _packed(state: dict, fields: pa.Schema) -> bytes:
    """A state as an Arrow stream of one row."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, fields) as stream:
        stream.write_batch(pa.RecordBatch.from_pylist([state], schema=fields))
    return out.getvalue().to_pybytes()


def _with_states(out: DataFrame, side: DataFrame, stage: Stage, name: str, keys: list[str], fan_in: int) -> DataFrame:
    kinds = T.StructType([*(side.schema[k] for k in keys), *stage.reducer.fields])
    schema = to_arrow_schema(kinds)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select([*keys, "_state"]).to_pylist()
            states = [pa.ipc.open_stream(row["_state"]).read_all().to_pylist()[0] for row in rows]
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in keys} | s for r, s in zip(rows, states, strict=True)], schema=schema)

    merged = merge_states(side.mapInArrow(unpack, kinds), keys, stage.reducer, fan_in)
    values = stage.finish(*[F.col(n) for n in stage.reducer.fields.fieldNames()]).alias(name)
    merged = merged.select(*keys, values)
    if not keys:
        # One row each.
        return out.drop(name).withColumn(name, merged.scalar())
    return null_safe(out.drop(name), cut(merged, "merged"), keys)

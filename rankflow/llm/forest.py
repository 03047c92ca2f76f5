"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives every vector a long string of random-hyperplane bits; a tree is
the sorted array of these strings.  A query descends in every tree to the longest
prefix it shares with anything, then all trees ascend together, one bit at a time,
until the prefixes they hold have enough rows and at least one tree alone holds k
ids besides the query's; all those rows are compared
exactly, in double precision.

How many rows are enough is measured: for a bounded sample of queries the true
neighbours are found by comparing with all rows, and the smallest number is taken
at which the ascent reaches ``RECALL`` of them.

Counts per prefix (at most ``TREES * 2 ** DEPTH`` numbers) tell each query its level
before any vector moves.  Then rows are dealt to cells, a tree's prefixes of a few
bits; queries go to the cells their prefix meets.  A cell of more than ``BLOCK`` rows
or queries is split into blocks, so that a common vector does not gather in one task.

Inner products are made angles by one more coordinate that gives all rows the
largest norm.

Defined cases: vectors that are null, zero or hold null or non-finite numbers take
no part; shorter vectors count as padded with zeros; ties go to the smaller id;
rows with a query's own id are not its neighbours, of repeated ids the best row
counts; a null id takes no part; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankflow.plans import cut

TREES, BITS, DEPTH, BLOCK = 24, 32, 12, 4096
#: Queries whose true neighbours are found to choose the number of candidates, and the recall aimed at.
SAMPLE, RECALL = 64, 0.97


def matrix_of(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows padded to ``dim``, and which of them take part."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    out = np.zeros((len(lists), dim))
    flat = lists.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    missing = np.isnan(values) | ~np.isfinite(values)
    sizes = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    bad = np.zeros(len(lists), bool)
    bad[row[missing]] = True
    fine = ~missing
    out[row[fine], column[fine]] = values[fine]
    return out, ~bad & out.any(axis=1)


def planes(dim: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((dim + 1, TREES * BITS))


def strings(vectors: np.ndarray, extra: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """Bit strings of every tree, as numbers whose highest bit comes first."""
    signs = (np.column_stack([vectors, extra]) @ normals > 0).reshape(len(vectors), TREES, BITS)
    return signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _measures(rows: DataFrame) -> tuple[int, float, int]:
    """(longest vector, largest norm, rows that take part)."""

    def run(batches):
        for batch in batches:
            longest = int(np.max(batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), initial=0))
            vectors, fine = matrix_of(batch.column(1), longest)
            norms = np.linalg.norm(vectors[fine], axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([longest]), pa.array([float(norms.max(initial=0.0))]), pa.array([int(fine.sum())])], names=["dim", "norm", "n"])

    found = rows.mapInArrow(run, "dim long, norm double, n long").agg(F.max("dim"), F.max("norm"), F.sum("n")).first()
    return int(found[0] or 0), float(found[1] or 0.0), int(found[2] or 0)


def _index(rows: DataFrame, dim: int, norm: float) -> DataFrame:
    """(id, vector, asked, strings as a row, strings as a query) of the rows that take part."""

    def run(batches):
        normals = planes(dim)
        for batch in batches:
            vectors, fine = matrix_of(batch.column(1), dim)
            at = np.flatnonzero(fine)
            vectors = vectors[at]
            rest = np.sqrt(np.maximum(norm**2 - (vectors**2).sum(axis=1), 0.0))
            own = strings(vectors, rest, normals)
            asking = strings(vectors, np.zeros(len(at)), normals)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), TREES).cast(pa.list_(pa.int64())) for x in (own, asking)]
            raw = pa.array([v.tobytes() for v in vectors], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), raw, batch.column(2).take(pa.array(at)), *lists],
                names=["id", "vector", "asked", "own", "asking"],
            )

    return rows.mapInArrow(run, "id long, vector binary, asked boolean, own array<long>, asking array<long>")


def _histogram(index: DataFrame, strings_column: str, depth: int) -> np.ndarray:
    """counts[tree, prefix] of all rows; bounded by the depth."""
    each = index.select(F.posexplode(strings_column).alias("tree", "s"))
    counted = each.groupBy("tree", F.shiftright("s", BITS - depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    out = np.zeros((TREES, 1 << depth), np.int64)
    out[counted["tree"].to_numpy(), counted["prefix"].to_numpy()] = counted["n"].to_numpy()
    return out


def _rows_at_levels(counts: np.ndarray, strings_of: np.ndarray, depth: int, over=np.sum) -> np.ndarray:
    """rows[query, level]: rows that share at least ``level`` bits with the query, summed over the trees (or ``over`` them)."""
    out = np.zeros((len(strings_of), depth + 1), np.int64)
    tree = np.arange(TREES)
    for level in range(depth, -1, -1):
        held = counts[tree[None, :], strings_of >> (BITS - level)]
        out[:, level] = over(held, axis=1)
        counts = counts.reshape(TREES, -1, 2).sum(axis=2) if level else counts
    return out


def _levels(rows_at: np.ndarray, ids_at: np.ndarray, enough: int, k: int) -> np.ndarray:
    """The deepest level at which a query has enough rows and one tree alone holds k ids besides its own, else 0: the end of its ascent."""
    reached = (rows_at >= enough) & (ids_at > k)
    return np.where(reached.any(axis=1), reached.shape[1] - 1 - reached[:, ::-1].argmax(axis=1), 0)


def best(scores: np.ndarray, ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the best rows of the k best ids; ``scores`` may be off by rounding and -inf where a row does not count."""
    counting, most = np.flatnonzero(scores > -np.inf), k
    while True:
        at = counting
        if len(at) > most:
            least = np.partition(scores[at], len(at) - most)[len(at) - most]
            at = at[scores[at] >= least - 1e-9 * (1 + abs(least))]
        exact = (vectors[at] * query[None, :]).sum(axis=1)
        order = np.lexsort((ids[at], -exact))
        first = np.sort(np.unique(ids[at[order]], return_index=True)[1])
        # Ids that repeat take up places: look at more rows.
        if len(first) >= k or len(at) == len(counting):
            return at[order[first[:k]]], exact[order[first[:k]]]
        most *= 4


def _enough(index: DataFrame, counts: np.ndarray, single: np.ndarray, depth: int, dim: int, k: int) -> int:
    """The least number of candidates at which a sample of queries finds ``RECALL`` of its true neighbours."""
    sample = index.filter("asked").select("id", "vector", "asking").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    ids = np.array([r.id for r in sample])
    asked = np.array([np.frombuffer(r.vector) for r in sample])
    asking = np.array([r.asking for r in sample])

    def run(batches):
        for batch in batches:
            own = batch.column(0).to_numpy()
            vectors = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, dim)
            scores = asked @ vectors.T
            scores[ids[:, None] == own[None, :]] = -np.inf
            trees = batch.column(2)
            for q in range(len(ids)):
                found, exact = best(scores[q], own, vectors, asked[q], k)
                at = pa.array(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), q)), pa.array(own[found]), pa.array(exact), trees.take(at)], names=["q", "id", "score", "own"])

    scored = index.select("id", "vector", "own").mapInArrow(run, "q long, id long, score double, own array<long>")
    scored = scored.groupBy("q", "id").agg(F.max("score").alias("score"), F.max_by("own", "score").alias("own"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    truth = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).collect()
    if not truth:
        return 0
    q = np.array([r.q for r in truth])
    differ = np.array([r.own for r in truth]) ^ asking[q]
    shared = BITS - np.ceil(np.log2(differ + 1.0)).astype(int).min(axis=1)
    rows_at, ids_at = _rows_at_levels(counts, asking, depth), _rows_at_levels(single, asking, depth, np.max)
    for enough in np.unique(rows_at):
        levels = _levels(rows_at, ids_at, int(enough), k)
        if (shared >= levels[q]).mean() >= RECALL:
            return int(enough)
    return int(rows_at.max())


def nearest(vectors: DataFrame, asked, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each row where ``asked`` holds."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"), asked.alias("asked"))
    rows = given.filter("id IS NOT NULL AND v IS NOT NULL").withColumn("asked", F.coalesce("asked", F.lit(False)))
    dim, norm, n = _measures(rows)
    index = cut(_index(rows, dim, norm), "forest")
    depth = int(np.clip(np.ceil(np.log2(max(n, 2) / 32)), 1, DEPTH))
    counts = _histogram(index, "own", depth)
    # The same with one row of each id: a tree's count of these is one of different neighbours.
    single = _histogram(index.groupBy("id").agg(F.min("own").alias("own")), "own", depth)
    enough = _enough(index, counts, single, depth, dim, k)

    bits = int(np.clip(np.ceil(np.log2(max(n, 1) / BLOCK)), 0, depth))
    in_cell = counts.reshape(TREES, 1 << bits, -1).sum(axis=2)
    blocks = np.maximum(1, -(-in_cell // BLOCK))
    placed = cut(_route(index.filter("asked").select("id", "vector", "asking"), counts, single, depth, bits, enough, blocks, k), "asked")
    # How many blocks of queries each cell has; at most TREES * 2 ** DEPTH numbers.
    per_cell = placed.filter("block = 0").groupBy("tree", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("turns")).toArrow()
    in_turn = np.zeros((TREES, 1 << bits), np.int64)
    in_turn[per_cell["tree"].to_numpy(), per_cell["cell"].to_numpy()] = per_cell["turns"].to_numpy()
    placed = placed.join(F.broadcast(spark.createDataFrame(per_cell)), ["tree", "cell"])
    placed = placed.withColumn("turn", F.pmod(F.xxhash64("id"), F.col("turns"))).drop("turns")

    def deal(batches):
        for batch in batches:
            own = np.array(batch.column(2).to_pylist(), np.int64).reshape(-1, TREES)
            ids = batch.column(0).to_numpy()
            cell = own >> (BITS - bits)
            tree = np.broadcast_to(np.arange(TREES), cell.shape)
            block = (ids[:, None] * np.int64(0x9E3779B1) >> 7) % blocks[tree, cell]
            many = in_turn[tree, cell].ravel()
            at = np.repeat(np.arange(len(ids)).repeat(TREES), many)
            turn = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            spread = [pa.array(np.repeat(x.ravel(), many)) for x in (tree, cell, block)]
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [*spread, pa.array(turn), batch.column(0).take(take), batch.column(1).take(take), pa.array(np.repeat(own.ravel(), many))],
                names=["tree", "cell", "block", "turn", "id", "vector", "s"],
            )

    cells = "tree long, cell long, block long, turn long"
    dealt = index.select("id", "vector", "own").mapInArrow(deal, f"{cells}, id long, vector binary, s long")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            s = left["s"].to_numpy()
            order = np.argsort(s, kind="stable")
            s, ids = s[order], left["id"].to_numpy()[order]
            rows = np.frombuffer(b"".join(left["vector"].to_pylist())).reshape(-1, dim)[order]
            asks = np.frombuffer(b"".join(right["vector"].to_pylist())).reshape(-1, dim)
            own, level = right["id"].to_numpy(), right["level"].to_numpy()
            width = BITS - level
            low = np.searchsorted(s, right["s"].to_numpy() >> width << width)
            high = np.searchsorted(s, (right["s"].to_numpy() >> width) + 1 << width)
            for start in range(0, len(own), 256):
                scores = asks[start : start + 256] @ rows.T
                for i, score in enumerate(scores, start):
                    score[: low[i]], score[high[i] :] = -np.inf, -np.inf
                    score[ids == own[i]] = -np.inf
                    found, exact = best(score, ids, rows, asks[i], k)
                    out["query_id"].append(np.full(len(found), own[i]))
                    out["vec_id"].append(ids[found])
                    out["score"].append(exact)
        columns = [np.concatenate(c) if c else np.empty(0) for c in out.values()]
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, kinds, strict=True)], names=list(out))

    names = ["tree", "cell", "block", "turn"]
    found = dealt.groupBy(*names).cogroup(placed.groupBy(*names)).applyInArrow(search, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _route(
    queries: DataFrame, counts: np.ndarray, single: np.ndarray, depth: int, bits: int, enough: int, blocks: np.ndarray, k: int
) -> DataFrame:
    """Queries sent to every block of the cells their prefix meets, with the level where their ascent ends."""

    def run(batches):
        for batch in batches:
            asking = np.array(batch.column(2).to_pylist(), np.int64).reshape(-1, TREES)
            if not len(asking):
                continue
            ids_at = _rows_at_levels(single, asking, depth, np.max)
            level = _levels(_rows_at_levels(counts, asking, depth), ids_at, enough, k)
            cells = []
            for i in range(len(asking)):
                wide = max(0, bits - level[i])
                first = asking[i] >> (BITS - bits) >> wide << wide
                for tree in range(TREES):
                    for cell in range(first[tree], first[tree] + (1 << wide)):
                        cells += [(i, tree, cell, b) for b in range(blocks[tree, cell])]
            at, tree, cell, block = np.array(cells, np.int64).T
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree), pa.array(cell), pa.array(block), batch.column(0).take(take), batch.column(1).take(take),
                 pa.array(asking[at, tree]), pa.array(level[at])],
                names=["tree", "cell", "block", "id", "vector", "s", "level"],
            )

    schema = "tree long, cell long, block long, id long, vector binary, s long, level long"
    return queries.mapInArrow(run, schema)

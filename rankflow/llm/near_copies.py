"""Near copies: texts whose sets of five-word shingles have a similarity of 0.8 or more.

A 64-bit SimHash alone does not find these: at similarity 0.8 two fingerprints differ in
about ten bits, and at a radius that holds nearly all such pairs blocks of a
fingerprint tell nothing apart.  So its groups may be given (``groups``) and are joined
with those found here.  Here candidates come from ``BANDS`` bands of ``ROWS``
minima over the hashed shingles (two texts of similarity s meet in a band with chance
s ** ROWS, at 0.8 in one of the bands at least with 0.998), and every candidate pair is
verified on the shingles themselves before it is linked.

No bucket is gathered or cut.  In each bucket all are compared with the smallest one.
Where that leaves several groups, the members outside the largest one are compared with
``LANDMARKS`` members of it, other ones from round to round, as long as a round still joins
many of them: in a large group of near copies nearly all find a partner so, at a cost
linear in the bucket.  Those left are compared with every member of another group, so the components are
those of all pairs that meet: in buckets of up to ``SMALL`` texts pair by pair, in larger ones by blocks of about
``BLOCK`` texts, where a task gets two blocks, counts all shared shingles at once and returns one partner for
each text and group.  No list of pairs of a large bucket is made.  The comparisons of that last step grow
with the square of the texts that share a band and have no near copy among those they were compared with;
what is shuffled for it is that number divided by the size of a block.

Defined cases: words are lower-cased (A-Z); a text of fewer than five words is one shingle;
null and empty texts and texts without words equal each other; a null id is kept only
where its component has no other; texts are compared whole, of any length; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.llm.components import components
from rankflow.llm.simhash import first_of_each
from rankflow.llm.tables import Memo, map_rows, present, touched, words_of
from rankflow.plans import cut

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 20, 6
#: Members of a bucket's largest group that the others are compared with in a round, the share of these that
#: has to be joined for another round, and the most rounds.
LANDMARKS, WORTH, ROUNDS = 8, 1 / 16, 6
#: Largest bucket that is compared pair by pair, and texts in a block of larger ones.
SMALL, BLOCK = 32, 256
#: Different shingles counted at once in a pair of blocks.
COLUMNS = 1 << 13
#: Characters of the texts whose shingles a worker remembers.
MEMO_CHARS = 1 << 20
_DICE = np.random.default_rng(20240501)
_FLIP = _DICE.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_TIMES = _DICE.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str) -> list[bytes]:
    words = words_of(text.encode())
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist() if words else []
    return [line[a:b] for a, b in zip(starts, ends[min(SHINGLE, len(words)) - 1 :].tolist(), strict=False)]


def similarity(a: set[bytes], b: set[bytes]) -> float:
    """Shared shingles among all; two texts without words are equal."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def bands_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the words, different shingles, keys [text, band]); texts without words have the keys of no shingle."""
    found = [shingles(t) for t in texts]
    node = np.array([xxhash.xxh64_intdigest(b" ".join(words_of(t.encode()))) for t in texts], np.uint64)
    count = np.fromiter(map(len, found), np.int64, len(found))
    full = np.flatnonzero(count)
    least = np.zeros((len(texts), BANDS * ROWS), np.uint64)
    if len(full):
        hashes = np.array([xxhash.xxh64_intdigest(s) for each in found for s in each], np.uint64)
        begins = np.concatenate([[0], np.cumsum(count[full])[:-1]])
        for j in range(BANDS * ROWS):
            least[full, j] = np.minimum.reduceat((hashes ^ _FLIP[j]) * _TIMES[j], begins)
    keys = [[xxhash.xxh64_intdigest(part.tobytes(), k) for k, part in enumerate(row.reshape(BANDS, ROWS))] for row in least]
    return node, np.array([len(set(each)) for each in found], np.int64), np.array(keys, np.uint64).reshape(len(texts), BANDS)


def banded(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, text_hash, node, size, bands) of every row; texts with the same words are one node."""
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(present(text)).alias("text_hash"), present(text).alias("_text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, size, keys = bands_of(batch.column(2).to_pylist())
        lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
        columns = [*batch.columns[:2], pa.array(node.view(np.int64)), pa.array(size), lists]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "node", "size", "bands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_rows(rows, run, f"doc_id {kind}, text_hash long, node long, size long, bands array<long>")


class TextMemo(Memo):
    """Forgets everything once its texts have ``MEMO_CHARS`` characters, so that long texts do not fill a worker."""

    held = 0

    def __missing__(self, text: str):
        if self.held + len(text) > MEMO_CHARS:
            self.clear()
            self.held = 0
        self.held += len(text)
        return super().__missing__(text)


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are as similar as asked."""
    sides = [texts.select(F.col("node").alias(n), F.col("text").alias(f"text_{n}")) for n in "ab"]
    both = pairs.join(sides[1], "b").join(sides[0], "a").select("a", "b", "text_a", "text_b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = TextMemo(lambda t: set(shingles(t)))
        close = [similarity(sets[a], sets[b]) >= least for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        at = pa.array(np.flatnonzero(close))
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return map_rows(both, run, "a long, b long")


def _labelled(met: DataFrame, links: DataFrame) -> DataFrame:
    """(key, node, size, label, main): members of mixed buckets, their group's label and the largest group's."""
    labels = components(links).select("node", F.col("root").alias("label"))
    member = met.select("key", "node", "size").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    member = cut(member, "member")
    groups = member.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = groups.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("groups"))
    mixed = cut(mixed.filter("groups > 1").select("key", "main"), "mixed")
    return member.join(mixed, "key")


def hashes_of(text: str) -> np.ndarray:
    """The different shingles of a text as hashes, in order."""
    found = shingles(text)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))


def shared_shingles(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each left text shares with each right one."""
    empty = [np.empty(0, np.uint64)]
    both = np.intersect1d(np.concatenate(left + empty), np.concatenate(right + empty))

    def places_of(text: np.ndarray) -> np.ndarray:
        at = np.searchsorted(both, text)
        return at[both[np.minimum(at, len(both) - 1)] == text] if len(both) else at[:0]

    places = [[places_of(text) for text in side] for side in (left, right)]
    out = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, len(both), COLUMNS):
        held = []
        for side in places:
            matrix = np.zeros((len(side), min(COLUMNS, len(both) - begin)), np.float32)
            for i, at in enumerate(side):
                matrix[i, at[np.searchsorted(at, begin) : np.searchsorted(at, begin + COLUMNS)] - begin] = 1
            held.append(matrix)
        out += held[0] @ held[1].T
    return out.astype(np.int64)


def _block_pairs(member: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of a bucket's strays and members of other groups that are as similar as asked, one for each stray and group."""
    in_blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    block = lambda n: F.pmod(F.xxhash64("node", F.lit(n)), in_blocks(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), in_blocks(n) - 1))
    stray = member.filter("label <> main").withColumn("i", block("strays")).withColumn("j", all_of("n"))
    every = member.withColumn("j", block("n")).withColumn("i", all_of("strays"))
    grid = ["key", "i", "j"]
    left, right = (df.select(*grid, "node", "label").join(texts, "node").select(*grid, "node", "label", "text") for df in (stray, every))
    # Other names on one side, for both come from the same table.
    right = right.select(*[F.col(c).alias(f"{c}_") for c in right.columns])

    def compare(one: pa.Table, other: pa.Table) -> pa.Table:
        sets = [[hashes_of(t.as_py()) for t in side.column(5)] for side in (one, other)]
        size = [np.array([len(x) for x in side], np.int64) for side in sets]
        if not len(size[0]) or not len(size[1]):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        both = shared_shingles(*sets)
        label = [side.column(4).to_numpy() for side in (one, other)]
        close = both >= least * (size[0][:, None] + size[1][None, :] - both)
        x, y = np.nonzero(close & (label[0][:, None] != label[1][None, :]))
        first = np.unique(np.stack([x, label[1][y]]), axis=1, return_index=True)[1] if len(x) else x
        a, b = one.column(3).to_numpy()[x[first]], other.column(3).to_numpy()[y[first]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return left.groupBy(*grid).cogroup(right.groupBy(*[f"{c}_" for c in grid])).applyInArrow(compare, "a long, b long")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _group_links(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Links (a, b) from the smallest node of each group (text_hash, root) to its others."""
    at = rows.select("text_hash", "node").distinct().join(groups.select("text_hash", F.col("root").alias("group")).distinct(), "text_hash")
    at = cut(at.select("group", "node").distinct(), "placed")
    ends = at.groupBy("group").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("group", "a")
    return at.join(ends, "group").filter("node <> a").select("a", F.col("node").alias("b"))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, groups: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_hash, root) of every row; rows of one root are linked by pairs of that similarity.

    ``groups`` (text_hash, root) are texts that another method has linked, as ``simhash.near_duplicates``
    does; they are linked here too, so a root is a component of both methods' links.
    """
    rows = cut(banded(docs, key, text), "banded")
    # Texts with the same words have the same bands.
    nodes = rows.groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    keys = nodes.select("node", "text_hash", "size", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).filter("n > 1").drop("n")
    met = cut(keys.join(buckets, "key"), "met")
    wanted = cut(met.select("node", "text_hash").distinct(), "wanted")
    given = docs.select(F.xxhash64(present(text)).alias("text_hash"), present(text).alias("text"))
    texts = touched(given, wanted, "text_hash").drop("_residue").join(wanted, "text_hash").select("node", "text")
    texts = cut(texts.dropDuplicates(["node"]), "texts")

    seen = cut(met.filter("node <> least").select(*_ordered("least", "node")).distinct(), "pairs")
    links = cut(_verified(seen, texts, least), "links")
    member = _labelled(met, links)
    for turn in range(ROUNDS):
        marks = [F.min_by("node", F.xxhash64("node", F.lit(turn * LANDMARKS + i))) for i in range(LANDMARKS)]
        marks = member.filter("label = main").groupBy("key").agg(F.array_distinct(F.array(*marks)).alias("marks"))
        stray = member.filter("label <> main").select("key", F.col("node").alias("x"))
        pairs = stray.join(marks, "key").select("x", F.explode("marks").alias("y")).select(*_ordered("x", "y")).distinct()
        pairs = cut(pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
        found = cut(_verified(pairs, texts, least), "links")
        joined, strays = found.count(), stray.select("x").distinct().count()
        if joined:
            seen, links = seen.unionByName(pairs), links.unionByName(found)
            member = _labelled(met, links)
        if joined < WORTH * strays or not joined:
            break
    sizes = member.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("label <> main")).alias("strays"))
    member = cut(member.join(sizes, "key"), "member")
    stray = member.filter("label <> main").select("key", F.col("node").alias("x"), F.col("label").alias("x_label"), F.col("size").alias("x_size"))
    near = F.least("size", "x_size") >= least * F.greatest("size", "x_size")
    few = member.filter(F.col("n") <= SMALL)
    cross = stray.join(few.select("key", "node", "label", "size"), "key").filter((F.col("x_label") != F.col("label")) & near)
    cross = cross.select(*_ordered("x", "node"))
    blocks = _block_pairs(member.filter(F.col("n") > SMALL), texts, least)
    cross = cross.unionByName(blocks).distinct().join(seen, ["a", "b"], "left_anti")
    links = links.unionByName(_verified(cross, texts, least))
    if groups is not None:
        links = links.unionByName(_group_links(rows, groups))
    roots = components(cut(links, "links")).select("node", "root")
    return rows.select("doc_id", "text_hash", "node").join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, groups: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` with one row of each group of near copies: the one with the smallest id."""
    return first_of_each(docs, near_copies(docs, key, text, least, groups), key, text)

"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits have a word between them that
is within r / 2 bits of both, so if each emits all variants within half the
radius, both emit that word and meet in the shuffle.

The radius is 4 bits of 64.  A ball of radius 2 around whole fingerprints has
2,081 variants, so the first shuffle works on halves: of two linked fingerprints
one 32-bit half differs in at most 2 bits, hence variants of the halves within
1 bit suffice, 66 per fingerprint.  Fingerprints that meet are compared as a
whole before they are linked.  Where more than ``BUCKET`` fingerprints meet in
one half variant, these (and only these) emit the 2,081 variants of their whole
fingerprints instead: all that meet there are linked by the triangle rule, so a
star of links to the smallest one stands for all pairs.  No pair list is made,
no bucket is cut, and no bucket of unbounded size reaches a task.

Defined cases: null and empty texts and texts without words have fingerprint
zero, which links like any other; equal fingerprints are one node, whatever
number of documents has them; repeated rows each get a row; a null id is kept,
but never becomes a component's id unless no other id is there; texts are read whole,
of any length; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.llm.components import components
from rankflow.llm.tables import map_rows, present, touched, words_of
from rankflow.plans import cut

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Most fingerprints that are compared with each other in one task.
BUCKET = 1024


def fingerprint_of(texts: list[str]) -> np.ndarray:
    """Fingerprints of texts: bit majorities over the hashes of their word shingles."""
    digest = xxhash.xxh64_intdigest
    hashes, counts = [], []
    for text in texts:
        words = words_of(text.encode())
        if not words:
            counts.append(0)
            continue
        line = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        last = min(SHINGLE, len(words)) - 1
        starts = (ends - size).tolist()
        found = [digest(line[a:b], SEED) for a, b in zip(starts, ends[last:].tolist(), strict=False)]
        hashes += found
        counts.append(len(found))
    count = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    begins = np.concatenate([[0], np.cumsum(count[full])[:-1]])
    ones = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
    major = np.packbits(2 * ones > count[full][:, None], axis=1, bitorder="little")
    out[full] = major.view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp holds the 64 bits as a signed number."""
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(present(text)).alias("text_hash"), present(text).alias("_text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = fingerprint_of(batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fp.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return map_rows(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def _flips(bits: int) -> Column:
    """Masks of no bit or one bit."""
    ones = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i))
    return F.concat(F.array(F.lit(0).cast("bigint")), ones)


def _around(half: Column) -> Column:
    return F.transform(_flips(32), lambda mask: half.bitwiseXOR(mask))


def half_variants(fps: DataFrame) -> DataFrame:
    """(key, fp): both halves of each fingerprint and all words within one bit of them."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32))
    return fps.select(F.explode(F.concat(_around(low), _around(high))).alias("key"), "fp")


def ball_variants(fps: DataFrame) -> DataFrame:
    """(key, fp): all words within two bits of each whole fingerprint."""

    def pair(i: Column) -> Column:
        bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
        return F.transform(F.sequence(i, F.lit(63)), lambda j: bit(i).bitwiseOR(bit(j)))

    masks = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), pair))
    masks = F.concat(F.array(F.lit(0).cast("bigint")), masks)
    return fps.select(F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("key"), "fp")


def bucket_links(values: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the fingerprints of one bucket as all pairs within the radius would."""
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= RADIUS
    label = np.arange(len(values))
    while True:
        least = np.where(near, label[None, :], len(values)).min(axis=1)
        if (least == label).all():
            return [(int(values[i]), int(values[r])) for i, r in enumerate(label.tolist()) if i != r]
        label = least


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints within the radius."""
    # A small file is read by one task, but has 66 variants a row.
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    variants = half_variants(fps)
    met = cut(variants.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "met")
    few, many = met.filter(F.col("n") <= bucket).select("key"), met.filter(F.col("n") > bucket).select("key")
    small = touched(variants, few, "key").join(few, "key")
    # At most ``bucket`` fingerprints each.
    lists = small.groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")

    def compare(batches):
        for batch in batches:
            found = [e for x in batch.column(0).to_pylist() for e in bucket_links(np.array(x, np.int64).view(np.uint64))]
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    edges = lists.mapInArrow(compare, "a long, b long")
    hot = cut(touched(variants, many, "key").join(many, "key").select("fp").distinct(), "hot")
    balls = ball_variants(hot)
    least = balls.groupBy("key").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    stars = balls.join(least, "key").select(F.col("fp").alias("a"), "b").filter("a <> b")
    return edges.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, root) of every row; the component's id is its smallest doc_id."""
    rows = cut(fingerprints(docs, key, text), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = components(links(nodes.select("fp"), bucket)).select(F.col("node").alias("fp"), "root")
    placed = cut(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
    ids = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = cut(placed.join(ids, "root").select("fp", "component_id", "root"), "ids")
    return rows.join(ids, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each component: the one with the smallest id."""
    return first_of_each(docs, near_duplicates(docs, key, text), key, text)


def first_of_each(docs: DataFrame, grouped: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each root in ``grouped`` (doc_id, text_hash, root): the one with the smallest id.

    Only texts of components with several rows move (and those that the sieve takes for them).
    """
    rows = cut(grouped.select("doc_id", "text_hash", "root"), "grouped")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    groups = cut(rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("one")), "groups")
    several = rows.join(groups.filter("n > 1").select("root"), "root").select(F.col("text_hash").alias("_text_hash"))
    ones = groups.select(F.col("one.doc_id").alias("_id"), F.col("one.text_hash").alias("_hash"))
    hashed = docs.withColumn("_text_hash", F.xxhash64(present(text)))
    several = cut(several, "several")
    moved = touched(hashed, several, "_text_hash").drop("_residue")
    moved = moved.join(ones, F.col(key).eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_semi")
    once = moved.dropDuplicates([key, "_text_hash"])
    return touched(hashed, several, "_text_hash", "left_anti").unionByName(once).select(*docs.columns)


def hex_digits(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

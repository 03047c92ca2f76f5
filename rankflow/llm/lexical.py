"""Ranked lexical search by groups of equal presence masks.

A document's score for an item sums, over the item's terms (repeats included), the term's weight times
a ratio of the term's frequency and the document's length; all but the logarithm in the weight is
64-bit integer arithmetic, so equal scores are equal and ties are decided by the id.

1. *Term counts.*  One pass over the documents counts each one's terms, and lists those that any item
   asks for with their frequencies.  The table is written: N, L and the document frequencies of the
   asked terms follow from it, and no text is read again.
2. *Presence masks.*  A task takes the rows in batches.  For each item, bit k of a document's mask says
   that it holds the item's k-th term; masks are filled term by term from the batch's postings, and
   equal masks form a group.
3. *Safe end.*  A group cannot score more than the sum of its terms' largest weighted ratios in the
   batch.  Groups are evaluated exactly by descending bound, until the bound falls below the score of
   the k-th document held for the item.  A bound equal to it is still evaluated, for the smaller id
   wins a tie.  What a task holds for an item goes on from batch to batch.
4. Each task hands k documents an item on at most; a window per item keeps the k best of all.

Items are read in blocks of about ``BLOCK_BYTES`` of text, each of which is asked against all
documents; only a block's terms and their counts are sent to the tasks.

Defined cases: null texts have no terms; documents and items without terms are in no result; documents
with score 0 are not listed; each repeated row of documents or items counts as one of its own; a null doc_id
comes last among ties; texts are worked on whole, of any length; other columns do not matter; without
documents or items the result is empty.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankflow.llm.tables import map_rows, present
from rankflow.plans import cut

#: Bytes of item texts that are asked in one pass.
BLOCK_BYTES = 4 << 20
#: Documents evaluated at once at first; doubled from turn to turn.
TURN = 32
_KEPT = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
_LOWER = bytes(range(256)).lower()
#: Bytes with A-Z lower-cased and all other ASCII but letters and digits turned into spaces.
TERM_BYTES = bytes(b if b in _KEPT else 32 for b in _LOWER)


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order, with repeats."""
    return text.encode().translate(TERM_BYTES).split()


def term_counts(docs: DataFrame, asked: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts) of the documents with terms: all terms counted, the asked ones listed by number."""
    rows = docs.select(F.col(key).alias("doc_id"), present(text).alias("_text"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, terms, counts, bounds = [], [], [], [0]
        for text in batch.column(1).to_pylist():
            words = terms_of(text)
            held = Counter(map(asked.get, words))
            held.pop(None, None)
            sizes.append(len(words))
            terms += held.keys()
            counts += held.values()
            bounds.append(len(terms))
        at = pa.array(bounds, pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (terms, counts)]
        columns = [batch.column(0), pa.array(sizes, pa.int64()), *lists]
        out = pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "counts"])
        return out.filter(pa.array(np.array(sizes, np.int64) > 0))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_rows(rows, count, f"doc_id {kind}, n long, terms array<int>, counts array<int>")


class Postings:
    """The rows of one batch by term."""

    def __init__(self, batch: pa.RecordBatch, n_docs: int, n_terms: int, total: int):
        self.ids = batch.column(0)
        size = batch.column(1).to_numpy()
        lists = batch.column(2)
        many = np.diff(lists.offsets.to_numpy())
        term = lists.flatten().to_numpy()
        freq = batch.column(3).flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(size)), many)
        m = 75 + 25 * size * n_docs // total
        ratio = 1_000_000_000 * freq // (1000 * freq + 12 * m[doc])
        order = np.argsort(term, kind="stable")
        self.doc, self.ratio = doc[order], ratio[order]
        self.bounds = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.rows = len(size)

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with the term, in order, and its ratios there."""
        a, b = self.bounds[term], self.bounds[term + 1]
        return self.doc[a:b], self.ratio[a:b]


def mask_groups(postings: Postings, terms: list[int]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(documents by group, where each group begins, for each term which groups hold it); documents with none are left out."""
    lanes = [np.zeros(postings.rows, np.uint64) for _ in range(-(-len(terms) // 64))]
    for k, term in enumerate(terms):
        lanes[k // 64][postings.of(term)[0]] |= np.uint64(1 << k % 64)
    label = np.zeros(postings.rows, np.int64)
    for lane in lanes:
        kinds, number = np.unique(lane, return_inverse=True)
        # Renumbered after every lane, so that the label stays below the number of documents.
        label = np.unique(label * len(kinds) + number, return_inverse=True)[1]
    order = np.argsort(label, kind="stable")
    begins = np.flatnonzero(np.append(True, np.diff(label[order]) > 0))
    first = order[begins]
    holds = [(lanes[k // 64][first] >> np.uint64(k % 64)) & np.uint64(1) == 1 for k in range(len(terms))]
    return order, begins, holds


def best_of(postings: Postings, terms: list[tuple[int, int]], held: list[tuple], k: int) -> list[tuple]:
    """The k best of ``held`` and the batch's documents, as (-score, id is null, id), for terms of (number, weight times repeats)."""
    terms = [(t, w) for t, w in terms if postings.bounds[t] < postings.bounds[t + 1]]
    if not terms:
        return held
    order, begins, holds = mask_groups(postings, [t for t, _ in terms])
    bound = np.zeros(len(begins), np.int64)
    for (t, weight), has in zip(terms, holds, strict=True):
        bound[has] += weight * postings.of(t)[1].max()
    ends = np.append(begins[1:], len(order))
    ranked = np.argsort(-bound, kind="stable")
    ranked = ranked[bound[ranked] > 0]
    at, turn = 0, TURN
    while at < len(ranked) and (len(held) < k or bound[ranked[at]] >= -held[-1][0]):
        size = np.cumsum(ends[ranked[at:]] - begins[ranked[at:]])
        stop = at + int(np.searchsorted(size, turn)) + 1
        docs = np.sort(np.concatenate([order[begins[g] : ends[g]] for g in ranked[at:stop]]))
        score = np.zeros(len(docs), np.int64)
        for t, weight in terms:
            own, ratio = postings.of(t)
            place = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            score += np.where(own[place] == docs, weight * ratio[place], 0)
        keep = score > 0
        if len(held) == k:
            keep &= score >= -held[-1][0]
        found = postings.ids.take(pa.array(docs[keep])).to_pylist()
        held = held + [(-s, i is None, i) for s, i in zip(score[keep].tolist(), found, strict=True)]
        held = sorted(held, key=lambda r: (r[0], r[1], r[2] if r[2] is not None else 0))[:k]
        at, turn = stop, 2 * turn
    return held


def search(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents of ``docs``."""
    asked = items.select(F.col(item).alias("item_id"), present(text).alias("_text"))
    asked = cut(asked.withColumn("_item", F.monotonically_increasing_id()), "items")
    total = asked.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    found = [_search_block(docs, rows, k, key, text) for rows in _blocks(asked, blocks)]
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(asked.select("_item", "item_id"), "_item").select("item_id", "rank", "doc_id", "score")


def _blocks(asked: DataFrame, blocks: int) -> Iterator[list[tuple[int, Counter]]]:
    """Item numbers and terms of one block after the other."""
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == block).select("_item", "_text").collect()
        yield [(r["_item"], Counter(terms_of(r["_text"]))) for r in rows]


def _search_block(docs: DataFrame, items: list[tuple[int, Counter]], k: int, key: str, text: str) -> DataFrame:
    """(_item, doc_id, score): at least the k best documents of every item, if that many have a score."""
    number = {term: i for i, term in enumerate(sorted({t for _, terms in items for t in terms}))}
    rows = cut(term_counts(docs, number, key, text), "terms")
    n_docs, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
    weight = {r["term"]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in held}
    wanted = [(i, [(number[t], weight[number[t]] * c) for t, c in sorted(terms.items()) if number[t] in weight]) for i, terms in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {i: [] for i, _ in wanted}
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            postings = Postings(batch, n_docs, len(number), total)
            for i, terms in wanted:
                best[i] = best_of(postings, terms, best[i], k)
        listed = [(i, doc, -score) for i, found in best.items() for score, _, doc in found]
        if listed:
            item, doc, score = zip(*listed, strict=True)
            columns = [pa.array(item, pa.int64()), pa.array(doc, kind), pa.array(score, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["_item", "doc_id", "score"])

    return rows.mapInArrow(run, f"_item long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, score long")

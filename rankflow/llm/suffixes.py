"""Removal of long repeated byte strings by distributed prefix doubling.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere
goes.  A suffix array sorted by doubled prefixes would tell which starts share
their first 400 bytes, but ranks every byte of the corpus in every round; here
the rounds keep only starts that can still be repeated, and rank whole stretches
of starts where that decides them:

1. Starts are tied to anchors: the smallest ``GRAM``-byte string (by hash) inside
   the string that begins at the start.  Equal strings have equal anchors at equal
   distance, so starts whose anchor's string is unique are done: not repeated.
   One anchor stands for the stretch of neighbouring starts that share it.
2. A stretch is ranked by all bytes its strings cover.  Where that rank is shared
   with another stretch, all its starts are repeated.
3. Stretches still open are cut into shorter ones (16 starts, then single starts)
   and ranked again by a longer common prefix: the bytes that all their strings
   share.  Unique ones are done; of the others, those that share the bytes they
   cover are repeated; the rest goes to the next round, until the prefix has grown
   past the threshold, 400 bytes.  One stretch of each kind found repeated goes along
   where open ones share its prefix, for single starts of these may equal its own.

In each round Spark groups the (position, rank) pairs on the rank, combines counts
before the shuffle, and joins them back, so a passage that most documents share
is split like any skewed join.  Ranks are 64-bit hashes of the bytes themselves,
equal for equal bytes wherever they lie.  A text only moves for rounds that open
stretches of it, and once more if something is removed from it.

Passages may be judged in words too (``passage_starts``): there each window of so many
words is tied to the smallest string of ``WORD_GRAM`` words in it, and neighbouring windows
that share it are one stretch.  Those whose anchor is unique are done; where all bytes a
stretch covers are shared, all its windows are repeated; windows of the others are counted
by the hash of all their bytes, with one stretch of each repeated kind beside them.

Defined cases: a null text counts as empty; texts under 400 bytes lose nothing;
repeated rows repeat each other; rows are told apart by id and text, so repeated
and null ids are fine; overlapping repeats inside one text count; texts of any length are
worked on whole, one at a time; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.pieces import mixed
from rankflow.llm.tables import BLANK_BYTES, map_rows, present, touched
from rankflow.plans import cut

LENGTH, GRAM, WORD_GRAM = 400, 64, 8
#: Which bytes words are made of; all others stand between words.
IN_WORD = np.array([b not in BLANK_BYTES for b in range(256)], np.int8)
#: Starts per stretch in the rounds after the first.
STEPS = (16, 1)
KEYS = ["doc_id", "text_hash"]


class Hasher:
    """Hashes of any substring of a text in constant time, from prefix sums modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15
    BACK = pow(BASE, -1, 1 << 64)
    VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    up = down = np.ones(1, np.uint64)

    def __init__(self, text: bytes):
        n = len(text)
        if len(self.up) < n + 1:
            Hasher.up, Hasher.down = self._powers(self.BASE, 2 * n), self._powers(self.BACK, 2 * n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.VALUES[np.frombuffer(text, np.uint8)] * self.up[:n], out=self.sums[1:])

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        done = 1
        while done < n:
            k = min(done, n - done)
            out[done : done + k] = out[:k] * np.uint64(pow(base, done, 1 << 64))
            done += k
        return out

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def anchors(text: bytes, length: int, gram: int) -> tuple[Hasher, np.ndarray, np.ndarray, np.ndarray] | None:
    """(hasher, anchor, first start, last start) of the stretches of a text; None if it is too short."""
    if len(text) < length:
        return None
    own = Hasher(text)
    start = np.arange(len(text) - gram + 1)
    anchor = least_places(own.of(start, start + gram), length - gram + 1)
    first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    last = np.concatenate([first[1:] - 1, [len(anchor) - 1]])
    return own, anchor[first], first, last


def least_places(grams: np.ndarray, window: int) -> np.ndarray:
    """Place of the smallest hash in every window of that many neighbours."""
    start = np.arange(len(grams))
    # The hash above, the place (rightmost first) below: one minimum finds both.
    low = np.uint64(0xFFFFFFFF)
    best = (grams & ~low) | (low - start.astype(np.uint64))
    done = 1
    while 2 * done <= window:
        best = np.minimum(best[:-done], best[done:])
        done *= 2
    if window > done:
        best = np.minimum(best[: len(best) - (window - done)], best[window - done :])
    return (low - (best & low)).astype(np.int64)


def word_windows(text: bytes, words: int, gram: int) -> tuple[Hasher, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(hasher, begin, end, anchor place, anchor hash) of every window of ``words`` words; None if there are fewer."""
    edges = np.flatnonzero(np.diff(IN_WORD[np.frombuffer(text, np.uint8)], prepend=0, append=0))
    begin, end = edges[::2], edges[1::2]
    if len(begin) < words:
        return None
    own = Hasher(text)
    grams = own.of(begin[: len(begin) - gram + 1], end[gram - 1 :])
    place = least_places(grams, words - gram + 1)
    return own, begin[: len(begin) - words + 1], end[words - 1 :], place, grams[place]


def _arrow_kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def _stretches(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(keys, first, last, base, known, prefix, whole) of every stretch: its anchor's hash and that of all bytes it covers."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for i, text in enumerate(batch.column(2).to_pylist()):
            cut_text = anchors(text.encode(), length, gram)
            if cut_text is not None:
                own, anchor, first, last = cut_text
                shape = mixed((anchor - first).astype(np.uint64) * np.uint64(1 << 32) + (last - first).astype(np.uint64))
                found.append((i, first, last, anchor, np.zeros(len(first), bool), own.of(anchor, anchor + gram),
                              own.of(first, last + length) ^ shape))
        return _ranked_batch(batch, found)

    return map_rows(rows, run, _ranked_schema(rows))


def _ranked_schema(rows: DataFrame) -> str:
    return f"doc_id {_arrow_kind(rows)}, text_hash long, first int, last int, base int, known boolean, prefix long, whole long"


def _ranked_batch(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch | None:
    """Rows of stretches, given per text: its place in the batch and arrays of the other columns."""
    if not found:
        return None
    at = pa.array(np.concatenate([np.full(len(f[1]), f[0]) for f in found]))
    first, last, base, known, prefix, whole = (np.concatenate(c) for c in list(zip(*found, strict=True))[1:])
    places = [pa.array(x.astype(np.int32)) for x in (first, last, base)]
    ranks = [pa.array(x.view(np.int64)) for x in (prefix, whole)]
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(at), batch.column(1).take(at), *places, pa.array(known), *ranks],
        names=[*KEYS, "first", "last", "base", "known", "prefix", "whole"],
    )


def _with_list(rows: DataFrame, stretches: DataFrame, how: str) -> DataFrame:
    """Texts with their different stretches, also where many equal rows have found them; a list is bounded by its text."""
    fields = [c for c in stretches.columns if c not in KEYS]
    lists = stretches.groupBy(*KEYS).agg(F.collect_set(F.struct(*fields)).alias("list"))
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "list")
    both = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), how)
    return both.select(*rows.columns, "list")


def _ranks(texts: DataFrame, step: int, length: int) -> DataFrame:
    """Stretches of ``step`` starts, cut from the listed ones at whole steps from their base.

    The prefix is what all strings of such a step have in common, also where the stretch
    holds only some of its starts: equal strings then have equal prefixes.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for i, (text, spans) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            own = Hasher(text.encode())
            items = sorted({(s["first"], s["last"], s["base"], s["known"]) for s in spans})
            begins = [np.arange(a - (a - base) % step, b + 1, step) for a, b, base, _ in items]
            sizes = list(map(len, begins))
            begin = np.concatenate(begins)
            low, high, _, known = (np.repeat(np.array(c), sizes) for c in zip(*items, strict=True))
            first, last = np.maximum(begin, low), np.minimum(begin + step - 1, high)
            shape = mixed((first - begin).astype(np.uint64) * np.uint64(1 << 32) + (last - begin).astype(np.uint64))
            found.append((i, first, last, begin, known, own.of(begin + step - 1, begin + length), own.of(first, last + length) ^ shape))
        return _ranked_batch(batch, found)

    return map_rows(texts, run, _ranked_schema(texts))


def _shared(ranked: DataFrame, *rank: str) -> DataFrame:
    """Ranks that more than one position has; counted inside tasks before the shuffle."""
    return ranked.groupBy(*rank).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*rank)


def _judged(ranked: DataFrame) -> DataFrame:
    """Positions whose prefix is shared, and whether all they cover is (``repeated``)."""
    shared = cut(ranked.join(_shared(ranked, "prefix"), "prefix"), "shared")
    whole = _shared(shared, "whole").withColumn("repeated", F.lit(True))
    return cut(shared.join(whole, "whole", "left").withColumn("repeated", F.coalesce("repeated", F.lit(False))), "judged")


def _still_open(judged: DataFrame) -> DataFrame:
    """Stretches to cut further, and one of each kind of repeated ones that share their prefix."""
    fields = [*KEYS, "first", "last", "base"]
    rest = judged.filter("NOT repeated")
    twins = judged.filter("repeated").groupBy("prefix", "whole").agg(F.min(F.struct(*fields)).alias("one"))
    twins = twins.join(rest.select("prefix").distinct(), "prefix").select("one.*", F.lit(True).alias("known"))
    return cut(rest.select(*fields, "known").unionByName(twins), "open")


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    rows = docs.select(F.col(key).alias("doc_id"), present(text).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """(doc_id, text_hash, first, last): runs of starts whose strings of ``length`` bytes also start elsewhere."""
    rows = keyed(docs)
    judged = _judged(cut(_stretches(rows, length, gram), "ranks"))
    found = judged.filter("repeated")
    for step in steps:
        listed = _still_open(judged)
        texts = _with_list(touched(rows, listed, "text_hash"), listed, "inner")
        judged = _judged(cut(_ranks(texts, step, length), "ranks"))
        found = found.unionByName(judged.filter("repeated AND NOT known"))
    return found.select(*KEYS, "first", "last")


def passage_starts(docs: DataFrame, words: int, length: int = LENGTH, gram: int = WORD_GRAM) -> DataFrame:
    """(doc_id, text_hash, first, last) of windows of ``words`` words that also start elsewhere, equal in every byte.

    A window ends ``length`` bytes behind ``last``, as the runs of ``repeated_starts`` do.
    """
    rows = keyed(docs)

    def tied(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = []
        for i, text in enumerate(batch.column(2).to_pylist()):
            cut_text = word_windows(text.encode(), words, gram)
            if cut_text is not None:
                own, begin, end, place, anchor = cut_text
                low = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
                high = np.concatenate([low[1:] - 1, [len(place) - 1]])
                found.append((i, begin[low], begin[high], end[high], np.zeros(len(low), bool), anchor[low], own.of(begin[low], end[high])))
        return _ranked_batch(batch, found)

    # Here first and last are where a stretch's first and last windows begin, base is where it ends.
    judged = _judged(cut(map_rows(rows, tied, _ranked_schema(rows)), "anchors"))
    listed = _still_open(judged)
    texts = _with_list(touched(rows, listed, "text_hash"), listed, "inner")

    def ranked(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = []
        for i, (text, spans) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            own, begin, end, _, anchor = word_windows(text.encode(), words, gram)
            for first, last, known in sorted({(s["first"], s["last"], s["known"]) for s in spans}):
                at = slice(np.searchsorted(begin, first), np.searchsorted(begin, last, "right"))
                many = at.stop - at.start
                found.append((i, begin[at], begin[at], end[at], np.full(many, known), anchor[at], own.of(begin[at], end[at])))
        return _ranked_batch(batch, found)

    windows = cut(map_rows(texts, ranked, _ranked_schema(texts)).select(*KEYS, "first", "base", "known", "whole"), "windows")
    windows = windows.join(_shared(windows, "whole"), "whole").filter("NOT known")
    found = judged.filter("repeated").select(*KEYS, "first", "base").unionByName(windows.select(*KEYS, "first", "base"))
    return found.select(*KEYS, "first", (F.col("base") - length).alias("last"))


def spans_of(starts: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs (start, end) from runs of starts."""
    out: list[list[int]] = []
    for first, last in sorted((s["first"], s["last"] + length) for s in starts or ()):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(text)], strict=True))


def kept_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters that lie wholly in removed runs."""
    raw = text.encode()

    def inner(start: int, end: int) -> tuple[int, int]:
        while start < end and start < len(raw) and raw[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        return start, end

    return kept_bytes(raw, [inner(a, b) for a, b in spans]).decode()


def _finish(rows: DataFrame, starts: DataFrame, work, schema: str) -> DataFrame:
    """Apply ``work`` to every text and the list of its repeated starts; untouched texts stay where they are."""
    lists = cut(starts, "starts")
    hit = _with_list(touched(rows, lists, "text_hash"), lists, "left")
    none = F.lit(None).cast(hit.schema["list"].dataType).alias("list")
    rest = touched(rows, lists, "text_hash", "left_anti").select("*", none)
    return map_rows(rest, work, schema).unionByName(map_rows(hit, work, schema))


def digests(docs: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, text.

    The first five are of repeats of ``length`` bytes.  ``text`` is what is left, without the
    characters that lie wholly in these or, where ``words`` is given, in passages of so many words.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, starts in zip(batch.column("text").to_pylist(), batch.column("list").to_pylist(), strict=True):
            raw, spans = text.encode(), spans_of([s for s in starts or () if not s["in_words"]], length)
            removed, digest = sum(b - a for a, b in spans), hashlib.sha256(kept_bytes(raw, spans)).hexdigest()
            out.append((len(raw), removed, len(spans), digest, kept_text(text, spans_of(starts, length)) if starts else text))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    schema = f"doc_id {_arrow_kind(docs)}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    starts = repeated_starts(docs, length).withColumn("in_words", F.lit(False))
    if words is not None:
        starts = starts.unionByName(passage_starts(docs, words, length).withColumn("in_words", F.lit(True)))
    return _finish(keyed(docs), starts, work, schema)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, words: int | None = None) -> DataFrame:
    """All columns, the text without the characters that lie wholly in removed runs; a null text becomes empty.

    Runs are those of ``length`` bytes and, where ``words`` is given, of so many words.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"), F.xxhash64(present(text)).alias("text_hash"), present(text).alias("text"),
        F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("row"),
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = zip(batch.column("text").to_pylist(), batch.column("list").to_pylist(), strict=True)
        kept = pa.array([kept_text(t, spans_of(starts, length)) for t, starts in pairs], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("row"), kept], names=["row", "kept"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, kept string"
    given = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    starts = repeated_starts(given, length)
    if words is not None:
        starts = starts.unionByName(passage_starts(given, words, length))
    done = _finish(rows, starts, work, schema)
    return done.select(*[F.col("kept").alias(c) if c == text else F.col(f"row.{c}") for c in docs.columns])

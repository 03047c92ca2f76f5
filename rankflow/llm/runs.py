"""Periodic runs of words by seeds on diagonals.

A run is a stretch of words that repeats itself: words ``period`` apart are equal,
the stretch is at least ``SHORTEST`` words and two periods long, no neighbouring word
extends it, and no smaller period fits.  On the diagonal of lag q (word i against
word i + q) a run of period q is an unbroken stretch of at least
``max(q, SHORTEST - q)`` equal words: its guaranteed overlap.

1. *Seeds.*  Words are named by number, then grams of 3, 6, 12, ... words by the pair of
   names of their halves; only grams that repeat inside their document keep a name.  Lags
   of one octave, [2g, 4g), guarantee an overlap that holds a whole gram of g words that
   starts at a multiple of g, so only such grams are looked up, among the starts 2g to
   4g - 1 words later (the first octave, g = 3, takes all lags below 12).  That is at most
   four pairs a word and octave, however often a gram occurs: no list of all pairs of a
   frequent gram is made.
2. *Extension.*  Pairs are taken by lag and place.  A table holds for each lag how far its
   diagonal is covered; a pair below that mark lies in a stretch already extended and is
   passed over.  The others grow to both sides by the names of ever shorter grams, so an
   extension takes as many steps as there are octaves, not as it has words.
3. *Smallest period.*  A multiple of a run's period gives the same stretch again; of equal
   stretches the one with the smallest lag is the run.

Documents do not meet: this is one pass without a shuffle.  A task works on about
``tables.CHUNK_CHARS`` of text at a time, or on one longer text, and holds about four bytes a
word and octave.

Defined cases: a null text counts as empty, an empty text has no words and no runs; texts
are worked on whole, of any length; repeated rows each get their result; other columns are
kept, except those named ``runs`` and ``collapsed``, which are replaced; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.llm.tables import BLANKS, map_rows, present

#: Fewest words of a run, and the words of a seed in the first octave: every guaranteed
#: overlap of 6 words or more holds a seed that starts at a multiple of 3.
SHORTEST, SEED = 12, 3


class Grams:
    """Names of the grams of some documents' words, laid end to end."""

    def __init__(self, words: np.ndarray, docs: np.ndarray):
        """``words`` are word numbers, ``docs`` the number of each word's document."""
        self.n = len(words)
        # One more place, of no document, so that ends can be looked at.
        self.words, self.docs = np.append(words, -1), np.append(docs, -1)
        #: (length, names), longest last; -1 where the gram is the only one of its kind.
        self.levels: list[tuple[int, np.ndarray]] = []
        if self.n >= 2:
            self._name_all()

    def _name_all(self) -> None:
        n, words, docs = self.n, self.words, self.docs
        kinds = int(words.max()) + 1
        at = np.flatnonzero(docs[: n - 1] == docs[1:n])
        pairs = self._named((docs[at] * kinds + words[at]) * kinds + words[at + 1], at)
        at = np.flatnonzero((pairs[: n - 1] >= 0) & (pairs[1:n] >= 0))
        names, length = self._named(pairs[at] * kinds + words[at + 2], at), SEED
        while (names >= 0).any():
            self.levels.append((length, names))
            last = n - length
            at = np.flatnonzero((names[:last] >= 0) & (names[length:n] >= 0)) if last > 0 else np.empty(0, np.int64)
            names = self._named(names[at] * np.int64(n) + names[at + length], at)
            length *= 2

    def _named(self, key: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Names at the places ``at`` by equal keys, -1 elsewhere and where a key is the only one."""
        out = np.full(self.n + 1, -1, np.int32)
        if len(key):
            order = np.argsort(key, kind="stable")
            placed = key[order]
            first = np.append(True, placed[1:] != placed[:-1])
            group = np.cumsum(first) - 1
            shared = np.bincount(group)[group] > 1
            out[at[order[shared]]] = group[shared]
        return out

    def pairs(self, length: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, lag) of equal grams whose lag is in the octave of ``length``, by lag and place."""
        low, high = (1 if length == SEED else 2 * length), 4 * length
        at = np.flatnonzero(names >= 0)
        at = at[np.argsort(names[at], kind="stable")]
        space = np.int64(self.n + high)
        index = names[at] * space + at
        left = np.flatnonzero(names[::length] >= 0) * length
        asked = names[left] * space + left
        begin, end = np.searchsorted(index, asked + low), np.searchsorted(index, asked + high)
        many = end - begin
        place = np.repeat(left, many)
        found = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
        lag = at[found] - place
        order = np.lexsort((place, lag))
        return place[order], lag[order]

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from places ``a`` on equal those from ``b`` on."""
        x, y = a.copy(), b.copy()
        for length, names in reversed(self.levels):
            step = length * ((names[x] == names[y]) & (names[x] >= 0))
            x, y = x + step, y + step
        for _ in range(SEED - 1):
            step = (self.words[x] == self.words[y]) & (self.docs[x] == self.docs[y])
            x, y = x + step, y + step
        return x - a

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before places ``a`` equal those before ``b``."""
        x, y = a.copy(), b.copy()
        for length, names in reversed(self.levels):
            # A place before the first one is looked up at the end, where nothing is named.
            p, q = np.where(x >= length, x - length, self.n), np.where(x >= length, y - length, self.n)
            step = length * ((names[p] == names[q]) & (names[p] >= 0))
            x, y = x - step, y - step
        for _ in range(SEED - 1):
            p, q = np.maximum(x - 1, 0), np.maximum(y - 1, 0)
            step = (x > 0) & (self.words[p] == self.words[q]) & (self.docs[p] == self.docs[q])
            x, y = x - step, y - step
        return a - x


def runs_of(words: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then length; starts count from the first word of all."""
    grams = Grams(words, docs)
    found = [np.empty((0, 3), np.int64)]
    for length, names in grams.levels:
        place, lag = grams.pairs(length, names)
        if not len(place):
            continue
        space = np.int64(grams.n + 1)
        index = lag * space + place
        at = np.flatnonzero(np.append(True, lag[1:] != lag[:-1]))
        ends = np.append(at[1:], len(lag))
        while len(at):
            # The first uncovered pair of each lag.
            x, q = place[at], lag[at]
            start, end = x - grams.backward(x, x + q), x + grams.forward(x, x + q)
            whole = end - start >= np.maximum(q, SHORTEST - q)
            found.append(np.column_stack([start, end + q - start, q])[whole])
            at = np.searchsorted(index, q * space + end)
            at, ends = at[at < ends], ends[at < ends]
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    again = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
    return rows[np.append(True, ~again)] if len(rows) else rows


def repeated_words(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:n]) > 0


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``runs`` (start, length, period in words) and ``collapsed``.

    Runs are ordered by start, then period.  ``collapsed`` is the text's words, one space between them,
    without those that any run holds after its first period.
    """
    keep = [c for c in docs.columns if c not in (text, "runs", "collapsed")]
    rows = docs.select(*keep, present(text).alias("_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema]
    run_type = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        split = [t.encode().split() for t in batch.column(batch.num_columns - 1).to_pylist()]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        begins = np.cumsum(counts) - counts
        flat = pa.array([w for words in split for w in words], pa.binary())
        numbers = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
        found = runs_of(numbers, np.repeat(np.arange(len(split)), counts))
        found = found[np.lexsort((found[:, 2], found[:, 0]))]
        again = repeated_words(found, len(flat))
        own = np.searchsorted(begins, found[:, 0], "right") - 1
        bounds = np.searchsorted(own, np.arange(len(split) + 1))
        left = []
        for words, begin, has in zip(split, begins.tolist(), np.diff(bounds).tolist(), strict=True):
            if has:
                words = [w for w, gone in zip(words, again[begin : begin + len(words)].tolist(), strict=True) if not gone]
            left.append(b" ".join(words).decode())
        starts = found[:, 0] - begins[own]
        fields = [pa.array(a) for a in (starts, found[:, 1], found[:, 2])]
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(run_type)))
        columns = [*(batch.column(i) for i in range(len(keep))), lists, pa.array(left, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[*keep, "runs", "collapsed"])

    out = [*kinds, "runs array<struct<start: long, length: long, period: long>>", "collapsed string"]
    return map_rows(rows, find, ", ".join(out))


def longest(runs: str = "runs") -> Column:
    """The longest run (ties: smallest start, then period), null if there is none."""
    order = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    best = F.array_max(order)
    return F.when(
        best.isNotNull(), F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period"))
    )


def listed(runs: str = "runs") -> Column:
    """All runs as text: one line ``start,length,period`` each."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def looped(text: Column, key: Column) -> Column:
    """Words of a text made periodic from one on, for about a tenth of all keys; the others' texts as they are.

    Which ones, where and with which period follows from the CRC of the key's decimal text.
    """
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i).cast("int")))

    # A list of one list: its element is split once, however often it is read.
    repeated = F.transform(F.array(F.split(trimmed, BLANKS)), repeat)[0]
    return F.when((h % 10 == 0) & (trimmed != ""), F.array_join(repeated, " ")).otherwise(text)

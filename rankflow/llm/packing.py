"""Packing documents into training windows by non-negative least squares.

A document longer than a window first fills whole windows.  What remains of
each document has fewer tokens than a window, so the remainders are described
by a histogram of bounded size.  On that histogram, whatever the number of
documents: enumerate combinations of a few lengths that fill a window exactly,
solve for how often to repeat each (least squares, not negative), round down,
and take the windows.  What rounding leaves is strung together in order of
length and cut at window ends, so only the very last window is padded.

Which document takes which place follows from its number among the remainders
of its length; the numbers are made of a running count inside each task and the
totals of the tasks before it, so equal lengths, even of all documents, are
numbered without bringing them together.

Defined cases: a null text counts as empty, and an empty document still has its
end token; repeated rows are packed as rows of their own; an empty table gives
no pieces.  Input columns other than the key and the text are not read.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankflow.llm.tables import cut_batch, present
from rankflow.plans import cut

#: White space as the vocabulary's pattern understands it.
SPACE = "\t-\r \x85\xa0  -     　"
WORD = re.compile(f"[^{SPACE}]+")
#: Controls that count as white space elsewhere, but not in the pattern.
ODD = re.compile("[\x1c-\x1f]")
#: A stop behind a letter without capitals, whose form no rule changes.
STOP = "([a-z\u00e0-\u00f6\u00f8-\u00ff])([.,])"
#: Once the words a worker remembers have so many ids together, it keeps the most frequent ones with half of them.
MEMO_IDS = 1_500_000
#: Combinations of each depth, and rounds of the solver.
COMBINATIONS, ROUNDS = 4096, 400


class WordIds:
    """Token ids of texts, encoded word by word: words between white space encode independently."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.has_special = bool(special)
        self.known: dict[str, int] = {}
        self.starts, self.flat = np.zeros(1, np.int64), np.empty(0, np.uint32)
        self.used = np.empty(0, np.int64)  # in how many batches each word was

    def forget_rare(self) -> None:
        """Keep the words that were in most batches, with at most half of ``MEMO_IDS`` ids."""
        length = np.diff(self.starts)
        order = np.argsort(-self.used, kind="stable")
        kept = np.sort(order[np.cumsum(length[order]) <= MEMO_IDS // 2])
        words = list(self.known)
        self.flat = self._gather(kept, length[kept])
        self.starts = np.concatenate([[0], np.cumsum(length[kept])])
        self.known = {words[i]: n for n, i in enumerate(kept.tolist())}
        self.used = self.used[kept] // 2

    def odd(self, text: str) -> bool:
        """Whether splitting at white space would not do."""
        return "<|" in text or bool(ODD.search(text))

    def words(self, text: str) -> list[str]:
        if not self.has_special:
            return WORD.findall(text)
        parts = self.special.split(text)
        return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else WORD.findall(p))]

    def learn(self, words: list[str]) -> None:
        """Encode the words that are not known yet."""
        new = [w for w in words if w not in self.known]
        if new:
            found = [e.ids for e in self.library.encode_batch_fast(new, add_special_tokens=False)]
            self._add(new, np.fromiter(map(len, found), np.int64, len(found)), itertools.chain.from_iterable(found))

    def _add(self, words, lengths: np.ndarray, ids) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(lengths)), strict=True))
        ends = len(self.flat) + np.cumsum(lengths)
        self.starts = np.concatenate([self.starts, ends])
        self.flat = np.concatenate([self.flat, np.fromiter(ids, np.uint32, int(lengths.sum()))])
        self.used = np.concatenate([self.used, np.zeros(len(lengths), np.int64)])

    def _gather(self, place: np.ndarray, length: np.ndarray) -> np.ndarray:
        ends = np.cumsum(length)
        take = np.repeat(self.starts[place] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[take]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and where each text begins in it."""
        column = pa.array(texts, pa.string())
        if any(map(self.odd, texts)):
            lists = pa.array(list(map(self.words, texts)), pa.list_(pa.string()))
        else:
            # Capitals do not matter, and a stop behind a letter is a word of its own anyway.
            column = pc.replace_substring_regex(pc.ascii_lower(column), STOP, r"\1 \2")
            lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(column))
        coded = lists.flatten().dictionary_encode()
        different = coded.dictionary.to_pylist()
        if len(self.flat) > MEMO_IDS:
            self.forget_rare()
        self.learn(different)
        numbers = np.fromiter(map(self.known.__getitem__, different), np.int64, len(different))
        self.used[numbers] += 1
        place = numbers[coded.indices.to_numpy()]
        length = self.starts[place + 1] - self.starts[place]
        ends = np.concatenate([[0], np.cumsum(length)])
        return self._gather(place, length), ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The encoder of a vocabulary file, kept by the Python worker between tasks."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def plan_windows(histogram: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Places for remainders: histogram[n] of them have n tokens.

    Returns ranges: numbers ``low`` to ``high`` (exclusive) of the remainders of
    ``length`` go to windows ``first`` + (number - low) at ``offset``; and per
    length from which number on remainders are strung together (``strung_from``)
    and at which token of the string those begin (``strung_at``).
    """
    left = histogram.astype(np.int64).copy()
    rows, first = [], 0
    used = np.zeros_like(left)
    combos = combinations(left, window)
    times = repeats(combos, left)
    order = np.argsort(-times, kind="stable")
    wanted = [(combos[i], int(times[i])) for i in order]
    # Rounded down first; then whatever still fits, greedily.
    for combo, most in [*wanted, *((c, 1 << 62) for c, _ in wanted)]:
        parts = combo[combo > 0]
        sizes, many = np.unique(parts, return_counts=True)
        n = min(most, int((left[sizes] // many).min()))
        if n <= 0:
            continue
        offset = 0
        for part in parts.tolist():
            rows.append((part, used[part], used[part] + n, first, offset))
            used[part] += n
            left[part] -= n
            offset += part
        first += n
    lengths = np.arange(len(left))
    strung_at = np.concatenate([[0], np.cumsum(left * lengths)[:-1]])
    table = np.array(rows, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return {
        **dict(zip(("length", "low", "high", "first", "offset"), table.T, strict=True)),
        "strung_from": used, "strung_at": strung_at, "windows": np.array([first]),
    }


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """Combinations of two to five lengths that fill a window; rows padded with zeros.

    All pairs; of the deeper ones a spread over the histogram: all but the last
    length are read off at evenly spread quantiles, the last fills the window.
    """
    found = np.flatnonzero(histogram)
    found = found[found > 0]
    if not len(found):
        return np.empty((0, 5), np.int64)
    out = []
    half = found[found <= window // 2]
    out.append(np.stack([half, window - half], axis=1))
    share = np.cumsum(histogram[found]) / histogram[found].sum()
    for depth in (3, 4, 5):
        # Additive recurrences spread the points evenly in as many dimensions as lengths are free.
        steps = (1 / np.array([1.32471795724, 1.75487766625, 2.32471795724, 3.07959562349]))[: depth - 1]
        points = (0.5 + np.arange(COMBINATIONS * 4)[:, None] * steps[None, :]) % 1
        free = found[np.minimum(np.searchsorted(share, points), len(found) - 1)]
        out.append(np.concatenate([free, window - free.sum(axis=1, keepdims=True)], axis=1))
    kept = []
    for combo in out:
        last = combo[:, -1]
        good = (last > 0) & (histogram[np.clip(last, 0, len(histogram) - 1)] > 0)
        combo = np.sort(combo[good], axis=1)[:, ::-1]
        combo = np.unique(combo, axis=0)
        if combo.shape[1] > 2:
            combo = combo[:: max(1, len(combo) // COMBINATIONS)]
        kept.append(np.pad(combo, ((0, 0), (0, 5 - combo.shape[1]))))
    return np.concatenate(kept)


def repeats(combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """How often to repeat each combination: least squares against the histogram, not negative.

    Multiplicative updates keep the solution positive and need only sums over
    the few lengths of each combination.
    """
    if not len(combos):
        return np.zeros(0)
    row, col = np.nonzero(combos)
    length, size = combos[row, col], len(histogram)
    goal = np.bincount(row, histogram[length].astype(float), len(combos))
    x = goal / max(goal.sum(), 1) * histogram.sum() / 3
    for _ in range(ROUNDS):
        made = np.bincount(length, x[row], size)
        x *= goal / np.maximum(np.bincount(row, made[length], len(combos)), 1e-12)
    return np.floor(x + 1e-9)


def pack(docs: DataFrame, path: str, end_id: int, window: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of the documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every token (a document's ids and then ``end_id``) lies in one piece; the pieces
    of a sequence lie side by side from offset 0 and have ``window`` tokens together,
    but for the last sequence.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), present(text).alias("text"))
    lengths = cut(_measure(rows, path, end_id, window), "lengths")
    sizes = lengths.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum("n_full").alias("full"))
    sizes = cut(sizes, "sizes")
    totals = sizes.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).collect()
    histogram = np.zeros(window + 1, np.int64)
    for row in totals:
        histogram[row.rest] = row.n
    histogram[0] = 0
    n_full = sum(row.full for row in totals)
    plan = plan_windows(histogram, window)

    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", "rest", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    per_task = sizes.groupBy("part").agg(F.sum("full").alias("full"))
    # One row per task of the measuring pass.
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = per_task.select("part", F.coalesce(F.sum("full").over(before), F.lit(0)).alias("full_base"))
    placed = lengths.join(bases, ["part", "rest"]).join(cut(tasks, "tasks"), "part")
    whole = placed.select(
        "doc_id", "n_tokens", "full_base",
        F.posexplode("full_crcs").alias("at", "crc"), "full_rank",
    ).select(
        "doc_id", (F.col("at") * window).cast("bigint").alias("start"), F.lit(window).cast("bigint").alias("length"),
        F.col("crc").alias("ids_crc32"), F.col("n_tokens").alias("doc_tokens"),
        (F.col("full_base") + F.col("full_rank") + F.col("at")).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )
    rests = placed.filter("rest > 0").select(
        "doc_id", "text_hash", "n_tokens", "rest", "rest_crc", (F.col("base") + F.col("rank")).alias("number"))
    assigned = cut(_assign(rests, plan, window, n_full), "assigned")
    uncut = assigned.filter("head = rest").select(
        "doc_id", (F.col("n_tokens") - F.col("rest")).alias("start"), F.col("rest").alias("length"),
        F.col("rest_crc").alias("ids_crc32"), F.col("n_tokens").alias("doc_tokens"), "sequence_id", "offset",
    )
    return whole.unionByName(uncut).unionByName(_cut_pieces(rows, assigned.filter("head < rest"), path, end_id, window))


def _measure(rows: DataFrame, path: str, end_id: int, window: int) -> DataFrame:
    """Lengths and checksums of the documents' whole windows and remainders, numbered inside each task."""

    def run(batches):
        own, part = word_ids(path), TaskContext.get().partitionId()
        ranks, full_rank = np.zeros(window, np.int64), 0
        for batch in itertools.chain.from_iterable(map(cut_batch, batches)):
            texts = batch.column(1).to_pylist()
            flat, ends = own.ids(texts)
            out = {name: [] for name in ("n", "full", "rest", "rank", "full_rank", "crcs", "crc")}
            for i in range(len(texts)):
                ids = np.append(flat[ends[i] : ends[i + 1]], np.uint32(end_id))
                full, rest = divmod(len(ids), window)
                out["n"].append(len(ids))
                out["full"].append(full)
                out["rest"].append(rest)
                out["rank"].append(int(ranks[rest]))
                out["full_rank"].append(full_rank)
                out["crcs"].append([crc(ids[k * window : (k + 1) * window]) for k in range(full)])
                out["crc"].append(crc(ids[full * window :]))
                ranks[rest] += 1
                full_rank += full
            kinds = dict.fromkeys(out, pa.int64()) | {"rest": pa.int32(), "crcs": pa.list_(pa.int64())}
            arrays = [pa.array(out[k], kinds[k]) for k in ("n", "full", "rest", "rank", "full_rank", "crcs", "crc")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([part] * len(texts), pa.int32()), *arrays],
                names=["doc_id", "text_hash", "part", "n_tokens", "n_full", "rest", "rank", "full_rank", "full_crcs", "rest_crc"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, text_hash long, part int, n_tokens long, n_full long, rest int, rank long, "
        "full_rank long, full_crcs array<long>, rest_crc long"
    )
    return rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, schema)


def _assign(rests: DataFrame, plan: dict[str, np.ndarray], window: int, first: int) -> DataFrame:
    """Sequence, offset and the tokens that lie in that sequence (``head``) of every remainder."""
    # Ranges in order of (length, low): a key finds the range it lies in.
    span = 1 << 44
    starts = plan["length"] * span + plan["low"]
    strung_first = first + int(plan["windows"][0])

    def run(batches):
        for batch in batches:
            rest = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            number = batch.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(starts, rest * span + number, side="right") - 1
            inside = number < plan["strung_from"][rest]
            safe = np.where(inside, at, 0)
            if len(starts):
                seq = first + plan["first"][safe] + number - plan["low"][safe]
                offset = plan["offset"][safe]
            else:
                seq = offset = np.zeros_like(number)
            token = plan["strung_at"][rest] + (number - plan["strung_from"][rest]) * rest
            seq = np.where(inside, seq, strung_first + token // window)
            offset = np.where(inside, offset, token % window)
            head = np.where(inside, rest, np.minimum(rest, window - offset))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(seq), pa.array(offset), pa.array(head)],
                names=[*batch.schema.names, "sequence_id", "offset", "head"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rests.schema)
    return rests.mapInArrow(run, f"{kinds}, sequence_id long, offset long, head long")


def _cut_pieces(rows: DataFrame, broken: DataFrame, path: str, end_id: int, window: int) -> DataFrame:
    """The two pieces of remainders that a window's end cuts; only their texts are encoded once more."""
    texts = rows.withColumn("text_hash", F.xxhash64("text"))
    own = broken.select(
        F.col("doc_id").alias("k"), F.col("text_hash").alias("h"), "n_tokens", "rest", "number", "sequence_id", "offset", "head")
    # Only texts of broken remainders move; of repeated rows one text serves all.
    wanted = own.select("k", "h").distinct()
    texts = texts.join(wanted, F.col("k").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")), "left_semi")
    texts = texts.dropDuplicates(["doc_id", "text_hash"])
    found = own.join(texts, F.col("k").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")))
    found = found.select("doc_id", "text", "n_tokens", "rest", "sequence_id", "offset", "head")

    def run(batches):
        encoder = word_ids(path)
        for batch in itertools.chain.from_iterable(map(cut_batch, batches)):
            keys, texts, tokens, rests, seqs, offsets, heads = (c.to_pylist() for c in batch.columns)
            flat, ends = encoder.ids(texts)
            out = []
            for i, key in enumerate(keys):
                ids = np.append(flat[ends[i] : ends[i + 1]], np.uint32(end_id))
                start, middle = tokens[i] - rests[i], tokens[i] - rests[i] + heads[i]
                out.append((key, start, heads[i], crc(ids[start:middle]), tokens[i], seqs[i], offsets[i]))
                out.append((key, middle, tokens[i] - middle, crc(ids[middle:]), tokens[i], seqs[i] + 1, 0))
            columns = list(zip(*out, strict=True))
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return found.mapInArrow(run, schema)

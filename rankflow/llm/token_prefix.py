"""Token counts of every prefix of a text by dynamic programming.

A byte-pair encoding is valid exactly where each pair of neighbouring tokens
is, so the last token of every prefix follows from the last tokens of shorter
prefixes.  The program below stores, for each prefix of a stretch of text, how
many tokens it has; a text's stretches (white space and the word behind it)
encode independently, so the count of any prefix of the text is the sum of the
stretches before plus one stored number.  Truncation ("the longest prefix of at
most n tokens") and budget questions read these numbers and never encode again.

Counts equal those of the library for the same vocabulary file, without added
begin or end tokens; a special string inside the text is one token.

Defined cases: a null text counts as empty and has no tokens; repeated rows
each get a row; all other columns are kept, except those with the names of the
results, which are replaced; texts are worked on whole, in time linear in their length; an
empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.tables import Memo, map_rows, present

# White space as the vocabulary's pattern understands it, and the pattern itself.
SPACE = "\t-\r \x85\xa0  -     　"
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
STRETCH = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
BLANK = re.compile(f"[{SPACE}]*")

#: A worker remembers so many pieces, of at most so many characters; others are computed each time.
MEMO_ENTRIES = 700_000
MEMO_CHARS = 48


def byte_letters() -> dict[str, int]:
    """The letters in which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of the prefixes of texts under a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letter = byte_letters()
        as_bytes = lambda token: bytes(letter[c] for c in token)
        special = {t["content"] for t in spec["added_tokens"]}
        ids = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.token = {as_bytes(t): i for t, i in ids.items()}
        self.longest = max(map(len, self.token))
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for merge in spec["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (ids[left], ids[right]), ids[left + right]
            self.merged[pair] = whole
            self.parts.setdefault(whole, pair)
        self.rank = {whole: rank for rank, whole in enumerate(self.parts)}
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.fits = Memo(self._fits)
        self.totals = Memo(lambda piece: self.piece_counts(piece.encode())[-1], MEMO_ENTRIES, MEMO_CHARS)

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether two tokens stay apart when their bytes are encoded together.

        They do unless a merge across the border would have come before the
        merges that made the two tokens; so undo those, latest first, and look
        for such a merge at each step.
        """
        left, right = pair
        rank, parts, never = self.rank, self.parts, len(self.parts) + 1
        before = never  # merges from this rank on have been undone
        while True:
            across = self.merged.get((left, right))
            if across is not None and rank[across] < before:
                return False
            of_left, of_right = rank.get(left, -1), rank.get(right, -1)
            if of_left < 0 and of_right < 0:
                return True
            # At equal ranks the left one is merged first.
            if of_left > of_right:
                before, left = of_left, parts[left][1]
            else:
                before, right = of_right + 1, parts[right][0]

    def piece_counts(self, piece: bytes) -> list[int]:
        """Tokens of every byte prefix of one piece (which the pattern never cuts), from 0."""
        last, count = [-1], [0]
        token, fits, longest = self.token.get, self.fits, self.longest
        for end in range(1, len(piece) + 1):
            # No longer prefix is a token, and copying it would cost its length each time.
            whole = token(piece[:end]) if end <= longest else None
            if whole is not None:
                last.append(whole)
                count.append(1)
                continue
            # One token only fits; mostly it is short.
            for start in range(end - 1, max(1, end - longest) - 1, -1):
                one = token(piece[start:end])
                if one is not None and fits[last[start], one]:
                    last.append(one)
                    count.append(count[start] + 1)
                    break
            else:
                raise ValueError(f"no token ends {piece[:end]!r}")
        return count

    def stretch_counts(self, stretch: str) -> tuple[int, ...]:
        """Tokens of every character prefix of white space and the word behind it."""
        blank = BLANK.match(stretch).end()
        # The prefixes inside the white space are runs of it.
        out = self._by_chars(stretch[:blank])
        base = 0
        for found in PIECE.finditer(stretch):
            start, piece = found.start(), found.group()
            counts = self._by_chars(piece)
            if found.end() <= blank:  # before a word the run is cut in two
                base += counts[-1]
                continue
            if piece in CONTRACTIONS and len(piece) == 3:
                counts[1] = counts[0] + self._by_chars(piece[1:2])[-1]
            # A blank that leads the word is, without the word, the end of the run of white space.
            skip = max(0, blank - start)
            out += [base + c for c in counts[skip:]]
            base += counts[-1]
        return tuple(out)

    def _by_chars(self, piece: str) -> list[int]:
        if not piece:
            return []
        counts = self.piece_counts(piece.encode())
        if len(counts) == len(piece) + 1:
            return counts[1:]
        return [counts[end] for end in accumulate(len(c.encode()) for c in piece)]

    def total(self, text: str) -> int:
        """Tokens of a text without special strings: the last stored number of each of its pieces."""
        return sum(map(self.totals.__getitem__, PIECE.findall(text)))

    def stretches(self, text: str) -> list[tuple[str, bool]]:
        """(stretch, whether it is a special string), in order."""
        out, at = [], 0
        for found in self.special.finditer(text) if self.special else ():
            out += [(s, False) for s in STRETCH.findall(text[at : found.start()])]
            out.append((found.group(), True))
            at = found.end()
        return out + [(s, False) for s in STRETCH.findall(text[at:])]

    def count(self, text: str) -> int:
        if self.special and self.special.search(text):
            return sum(1 if special else self.total(s) for s, special in self.stretches(text))
        return self.total(text)

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of every character prefix of a text: entry i for the first i + 1 characters."""
        out, base, before = [], 0, ""
        for stretch, special in self.stretches(text):
            if not special:
                counts = self.stretch_counts(stretch)
                out += [base + c for c in counts]
                base, before = base + counts[-1], stretch
                continue
            # Until its last character the special string is ordinary text that goes on with the stretch before.
            known = len(before)
            whole = [n for s in STRETCH.findall(before + stretch[:-1]) for n in [self.stretch_counts(s)]]
            flat, sum_before = [], 0
            for counts in whole:
                flat += [sum_before + c for c in counts]
                sum_before += counts[-1]
            out += [base - (flat[known - 1] if known else 0) + c for c in flat[known:]]
            base, before = base + 1, ""
            out.append(base)
        return out

    def fitting(self, text: str, budget: int) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens."""
        if self.special and self.special.search(text):
            counts = self.prefix_counts(text)
            return max((i + 1 for i, c in enumerate(counts) if c <= budget), default=0)
        # The sums over pieces never fall, but a longer prefix of one stretch may have fewer tokens,
        # so whole stretches are looked at from the last one that begins within the budget.
        tokens, chars = 0, 0
        for piece in PIECE.finditer(text):
            tokens += self.totals[piece.group()]
            if tokens > budget:
                break
            chars = piece.end()
        start = max((m.start() for m in STRETCH.finditer(text[: chars + 1])), default=0)
        base, best = self.total(text[:start]), start
        for stretch in STRETCH.finditer(text, start):
            if base > budget:
                break
            fit = [i + 1 for i, c in enumerate(self.stretch_counts(stretch.group())) if base + c <= budget]
            best = stretch.start() + fit[-1] if fit else best
            base += self.total(stretch.group())
        return best


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of a vocabulary file, kept by the Python worker between tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, budget: int, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: ``n_bytes``, ``n_tokens``, ``over_limit`` and ``fit_chars``.

    ``fit_chars`` is the length of the longest prefix of at most ``budget`` tokens.
    ``keep`` names the columns to carry (default: all but the text).  One pass over
    the rows where they lie; a worker remembers a bounded number of stretches.
    """
    results = ["n_bytes", "n_tokens", "over_limit", "fit_chars"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text, *results)]
    rows = docs.select(*keep, present(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    schema = ", ".join(filter(None, [kinds, "n_bytes long, n_tokens long, over_limit boolean, fit_chars long"]))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, at = counter(path), batch.num_columns - 1
        texts = batch.column(at).to_pylist()
        tokens = [own.count(t) for t in texts]
        fit = [len(t) if n <= budget else own.fitting(t, budget) for t, n in zip(texts, tokens, strict=True)]
        columns = [batch.column(i) for i in range(at)]
        columns += [
            pa.array([len(t.encode()) for t in texts], pa.int64()),
            pa.array(tokens, pa.int64()),
            pa.array([n > budget for n in tokens], pa.bool_()),
            pa.array(fit, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[*keep, *results])

    return map_rows(rows, count, schema)


def prefix_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns with ``prefix_tokens``: the token count of every character prefix of the text."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema if f.name != "prefix_tokens"}
    rows = docs.select(*kinds, present(text).alias("_text"))
    schema = ", ".join(f"`{name}` {kind}" for name, kind in kinds.items()) + ", prefix_tokens array<int>"

    def fill(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, at = counter(path), batch.num_columns - 1
        lists = [own.prefix_counts(t) for t in batch.column(at).to_pylist()]
        columns = [*(batch.column(i) for i in range(at)), pa.array(lists, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=[*kinds, "prefix_tokens"])

    return map_rows(rows, fill, schema)


def tokens_at(chars: str, counts: str = "prefix_tokens"):
    """Tokens of the prefix of ``chars`` characters, read from the stored counts."""
    return F.coalesce(F.get(F.col(counts), F.least(F.col(chars), F.size(counts)) - 1), F.lit(0))

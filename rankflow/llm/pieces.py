"""Sampled segmentation of texts into pieces, and lossless decoding.

Forward-filtering backward-sampling over the piece lattice: the forward pass
sums, for every place in a word, the weights of all segmentations up to it; the
backward pass draws pieces from the end, each with its share of that sum.  So a
segmentation is drawn exactly in proportion to the product of its pieces'
weights.  Draws come from a counter-based hash of the row key, the place of the
word in its text and the step, so a row always gets the same pieces, whichever
task computes it.

The vocabulary file is of the merge kind and holds ranks, no probabilities; a
piece of rank r weighs (r + 1) ** -alpha, the usual rank-frequency law.  No
piece runs over the border between a word and the white space behind it, so
words are filtered independently and the forward pass runs once for each
different word a worker meets.

Defined cases: a null text counts as empty; an empty text has no pieces;
repeated rows get the same pieces; a null key seeds like any other value.
Characters outside the vocabulary, and the character that stands for blanks
inside pieces, are written as bytes, so that decoding always gives back the
text.  Other columns are kept, except those with the names of the results.  Texts are worked on
whole, of any length; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.tables import map_rows, present

MARK = "▁"
#: Stands for a literal mark inside a text; no valid text holds a lone surrogate.
LITERAL = "\ud800"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: A worker forgets its lattices once they hold so many arcs.
MEMO_ARCS = 4_000_000
#: Kinds of pieces in the vocabulary file, as its format numbers them.
NORMAL, BYTE = 1, 6


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lattices:
    """Filtered lattices of the words met so far, in flat arrays, and the sampler over them."""

    def __init__(self, path: str, alpha: float):
        from sentencepiece import sentencepiece_model_pb2 as layout

        model = layout.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.byte = [0] * 256
        surfaces, plain = [], {}
        for at, p in enumerate(model.pieces):
            surface = b""
            if p.type == NORMAL:
                plain[p.piece] = at
                surface = p.piece.replace(MARK, " ").encode()
            elif p.type == BYTE:
                value = int(p.piece[3:5], 16)
                self.byte[value] = at
                surface = bytes([value])
            surfaces.append(surface)
        size = len(model.pieces)
        ranks = np.array([min(max(-p.score, 0.0), size) for p in model.pieces])
        self.weight = (ranks + 1) ** -alpha
        self.byte_weight = float(size) ** -alpha
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        self.surface_ends = np.concatenate([[0], np.cumsum(list(map(len, surfaces)))])
        self._grow(plain)
        self.forget()

    def forget(self) -> None:
        self.end_of: dict[str, int] = {}
        self.nodes = 0
        self.cumulated, self.arc_piece, self.arc_from = np.empty(0), np.empty(0, np.int32), np.empty(0, np.int32)
        self.first = np.zeros(0, bool)

    def _grow(self, plain: dict[str, int]) -> None:
        """The tree of all pieces as sorted edges (node and letter -> node)."""
        letters = sorted(set(chain.from_iterable(plain)))
        self.letter = np.full(0x110000, -1, np.int64)
        self.letter[[ord(c) for c in letters]] = np.arange(len(letters))
        self.letters = len(letters)
        code = {c: i for i, c in enumerate(letters)}
        edges: dict[int, int] = {}
        ends = {}
        for text, at in plain.items():
            node = 0
            for char in text:
                node = edges.setdefault(node * self.letters + code[char], len(edges) + 1)
            ends[node] = at
        self.edge = np.array(sorted(edges), np.int64)
        self.edge_to = np.array([edges[e] for e in self.edge.tolist()], np.int64)
        self.tree_piece = np.full(len(edges) + 1, -1, np.int64)
        self.tree_piece[list(ends)] = list(ends.values())
        self.deepest = max(map(len, plain))

    def learn(self, words: set[str]) -> None:
        """Filter the lattices of all words not known yet, together."""
        new = [w for w in words if w not in self.end_of]
        if not new:
            return
        length = np.fromiter(map(len, new), np.int64, len(new))
        stop = np.cumsum(length)
        char = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        # Nodes lie between characters: one more than characters in each word.
        word = np.repeat(np.arange(len(new)), length)
        begin_node = np.arange(len(char)) + word
        limit = stop[word]
        code = self.letter[char]
        start, node = np.arange(len(char)), np.zeros(len(char), np.int64)
        froms, tos, pieces = [], [], []
        for depth in range(1, self.deepest + 1):
            at = start + depth - 1
            inside = at < limit[start]
            start, node, at = start[inside], node[inside], at[inside]
            key = np.where(code[at] >= 0, node * self.letters + code[at], -1)
            place = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            going = self.edge[place] == key
            start, node = start[going], self.edge_to[place[going]]
            if not len(start):
                break
            piece = self.tree_piece[node]
            full = piece >= 0
            froms.append(begin_node[start[full]])
            tos.append(begin_node[start[full]] + depth)
            pieces.append(piece[full])
            if depth == 1:
                # A character without a piece of its own is written as bytes, like the library does.
                single = np.zeros(len(char), bool)
                single[start[full]] = True
                odd = np.flatnonzero(~single)
        source, target, piece = np.concatenate(froms), np.concatenate(tos), np.concatenate(pieces)
        weight = self.weight[piece]
        if len(odd):
            raw = np.where(char[odd] == ord(LITERAL), ord(MARK), char[odd])
            width = 1 + (raw > 0x7F) + (raw > 0x7FF) + (raw > 0xFFFF)
            source = np.concatenate([source, begin_node[odd]])
            target = np.concatenate([target, begin_node[odd] + 1])
            piece = np.concatenate([piece, -1 - raw])
            weight = np.concatenate([weight, self.byte_weight**width])
        share = self._forward(source, target, np.log(weight), stop + np.arange(len(new)) - length, length)
        order = np.lexsort((source, target))
        source, target, piece, share = source[order], target[order], piece[order], share[order]
        last = np.append(target[1:] != target[:-1], True)
        rank = np.cumsum(last) - last
        cumulated = np.where(last, target + 1.0, np.cumsum(share) - rank + target)
        cumulated = np.maximum.accumulate(np.minimum(cumulated, target + 1.0))
        self.end_of.update(zip(new, (self.nodes + stop + np.arange(len(new))).tolist(), strict=True))
        self.cumulated = np.concatenate([self.cumulated, cumulated + self.nodes])
        self.arc_piece = np.concatenate([self.arc_piece, piece.astype(np.int32)])
        self.arc_from = np.concatenate([self.arc_from, (source + self.nodes).astype(np.int32)])
        first = np.zeros(len(char) + len(new), bool)
        first[stop + np.arange(len(new)) - length] = True
        self.first = np.concatenate([self.first, first])
        self.nodes += len(first)

    @staticmethod
    def _forward(source, target, weight, begin, length) -> np.ndarray:
        """Each arc's share of its end node's sum; all words advance one character at a time.

        ``weight`` holds logarithms; every word's sums are rescaled by its node's own
        logarithm, so long words do not run out of range.
        """
        total = int(begin[-1] + length[-1] + 1)
        depth = target - np.repeat(begin, length + 1)[target]
        order = np.argsort(depth, kind="stable")
        bounds = np.searchsorted(depth[order], np.arange(1, int(length.max()) + 2))
        log = np.zeros(total)
        share = np.empty(len(source))
        for step in range(len(bounds) - 1):
            arcs = order[bounds[step] : bounds[step + 1]]
            if not len(arcs):
                continue
            nodes, group = np.unique(target[arcs], return_inverse=True)
            value = log[source[arcs]] + weight[arcs]
            top = np.full(len(nodes), -np.inf)
            np.maximum.at(top, group, value)
            value = np.exp(value - top[group])
            sums = np.bincount(group, value, len(nodes))
            log[nodes] = top + np.log(sums)
            share[arcs] = value / sums[group]
        return share

    def sample(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts in one array, and where each text begins in it."""
        lists = [WORD.findall(MARK + t.replace(MARK, LITERAL).replace(" ", MARK)) if t else [] for t in texts]
        if len(self.cumulated) > MEMO_ARCS:
            self.forget()
        self.learn(set(chain.from_iterable(lists)))
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        many = int(sizes.sum())
        node = np.fromiter(map(self.end_of.__getitem__, chain.from_iterable(lists)), np.int64, many)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(many) - np.repeat(begin[:-1], sizes)
        with np.errstate(over="ignore"):
            seed = np.repeat(seeds.astype(np.uint64), sizes) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        # In order of words, so that the arcs of one word are read together.
        order = np.argsort(node, kind="stable")
        node, seed, own = node[order], mixed(seed[order]), order
        steps, count = [], np.zeros(many, np.int64)
        while len(own):
            seed = mixed(seed + np.uint64(0x632BE59BD9B4E019))
            draw = (seed >> np.uint64(11)).astype(np.float64) * 2.0**-53
            arc = np.searchsorted(self.cumulated, node + draw, side="right")
            steps.append((own, self.arc_piece[arc]))
            count[own] += 1
            node = self.arc_from[arc]
            going = ~self.first[node]
            node, seed, own = node[going].astype(np.int64), seed[going], own[going]
        ends = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(int(ends[-1]), np.int64)
        for step, (own, piece) in enumerate(steps):
            out[ends[own + 1] - 1 - step] = piece
        starts = ends[begin]
        return self._with_bytes(out, starts) if (out < 0).any() else (out, starts)

    def _with_bytes(self, out: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Write code points (stored as -1 - code) as byte pieces."""
        width = np.ones(len(out), np.int64)
        at = np.flatnonzero(out < 0)
        raws = [chr(-1 - int(code)).encode() for code in out[at]]
        width[at] = [len(r) for r in raws]
        ends = np.concatenate([[0], np.cumsum(width)])
        wide = np.repeat(out, width)
        for place, raw in zip(ends[at].tolist(), raws, strict=True):
            wide[place : place + len(raw)] = [self.byte[b] for b in raw]
        return wide, ends[starts]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a list of pieces."""
        start, width = self.surface_ends[ids], self.surface_ends[np.asarray(ids) + 1] - self.surface_ends[ids]
        ends = np.concatenate([[0], np.cumsum(width)])
        raw = self.surface[np.repeat(start - ends[:-1], width) + np.arange(ends[-1])].tobytes()
        return raw[1:].decode()  # without the blank put before the text


_LATTICES: dict[tuple[str, float], Lattices] = {}


def lattices(path: str, alpha: float) -> Lattices:
    """The sampler of a vocabulary file, kept by the Python worker between tasks."""
    if (path, alpha) not in _LATTICES:
        _LATTICES[path, alpha] = Lattices(path, alpha)
    return _LATTICES[path, alpha]


def _seeded(docs: DataFrame, key: str, text: str, keep: list[str], seed: int) -> tuple[DataFrame, str]:
    seeds = F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = docs.select(*keep, seeds.alias("_seed"), present(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows, kinds


def _map_samples(rows: DataFrame, path: str, alpha: float, results: dict[str, str], kinds: str, of) -> DataFrame:
    names = [*rows.columns[:-2], *results]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, n = lattices(path, alpha), batch.num_columns
        texts = batch.column(n - 1).to_pylist()
        ids, starts = own.sample(texts, batch.column(n - 2).to_numpy(zero_copy_only=False).view(np.uint64))
        columns = of(own, texts, ids, starts)
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n - 2)), *columns], names=names)

    schema = ", ".join(filter(None, [kinds, ", ".join(f"{n} {k}" for n, k in results.items())]))
    return map_rows(rows, run, schema)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """All columns and ``pieces``, a sampled segmentation of each text as piece ids."""
    keep = [c for c in docs.columns if c != "pieces"]
    rows, kinds = _seeded(docs, key, text, keep, seed)

    def of(_, texts, ids, starts):
        return [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))]

    return _map_samples(rows, path, alpha, {"pieces": "array<int>"}, kinds, of)


def decode(docs: DataFrame, path: str, pieces: str = "pieces", to: str = "decoded") -> DataFrame:
    """All columns and the text of the piece ids; null where these are null."""
    keep = [c for c in docs.columns if c != to]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    at = keep.index(pieces)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = lattices(path, 1.0)
        texts = [None if x is None else own.decode(np.array(x, np.int64)) for x in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*keep, to])

    return map_rows(docs.select(*keep), run, f"{kinds}, `{to}` string")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """Per row: n_chars, n_pieces, the sampled pieces, their pieces_crc32, and whether they decode to the text."""
    rows, kinds = _seeded(docs, key, text, [key], seed)
    results = {"n_chars": "long", "n_pieces": "long", "pieces": "array<int>", "pieces_crc32": "long", "lossless": "boolean"}

    def of(own, texts, ids, starts):
        spans = [ids[starts[i] : starts[i + 1]] for i in range(len(texts))]
        return [
            pa.array(list(map(len, texts)), pa.int64()),
            pa.array(np.diff(starts), pa.int64()),
            pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32())),
            pa.array([zlib.crc32(s.astype("<u4").tobytes()) for s in spans], pa.int64()),
            pa.array([own.decode(s) == t for s, t in zip(spans, texts, strict=True)], pa.bool_()),
        ]

    return _map_samples(rows, path, alpha, results, kinds, of)

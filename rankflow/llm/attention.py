"""Scores of texts under a causal self-attention model over subword ids.

The network (embedding, one causal attention with learned distance biases, one
hidden layer) looks at the ids before a place and mixes ``CLASSES`` distributions
over the vocabulary: p(id | context) = sum over k of pi_k(context) E_k[id].  It is
trained in numpy: gradients for the network, expected counts for the E_k.  Texts
are read in windows of ``WINDOW`` ids that overlap by ``WINDOW - STRIDE``; the overlap
is context only, so each id is scored once, in batches of masked attention.

A word is written as an id, the longest entry of a byte-level vocabulary that it starts
with (a blank before it), and the bytes behind.  The network reads and predicts these ids:
p(x1 | context).  A, the probability of the bytes behind and of ending there, comes from
counted bytes after the three bytes before them.  Of the training tokens that begin with x1, C in number and V
different ones, c are the word itself; so its probability is p(x1 | context) times
(1 - m) (max(c - D, 0) / C + D V / C A) + m A, which adds up to at most one.  D is fixed;
m is the weight under which all training tokens are most likely, each one's own occurrence
taken off its count.

What is learned from: everything from all training texts.  Word counts, C, V, counts
of bytes and m come from the table of counted words.  The network starts from ``STEPS`` steps
on ``SAMPLE`` texts; then every task goes on from there over all of its training texts, and
the tasks' weights are averaged by the ids they read, their expected counts added up.  The
last digits of a score thus depend on how the table is split into tasks.

Counts of the ``FREQUENT`` most frequent words of at most ``WORD_BYTES`` bytes (a bounded
table) go to all tasks; other words are joined with the table of counts.  Tasks get their
texts in small Arrow batches; a task's steps do not depend on where these end.

Defined cases: a null text counts as empty, and an empty text has its end token; a
null id counts as the text ''; repeated rows each get a row; without training texts
the counts are zero and the untrained network scores alone; only the named columns
are read; texts are scored whole, of any length; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.tables import cut_batch, hash_sample, map_rows, present, small_batches
from rankflow.plans import cut

WINDOW, STRIDE, WIDTH, HIDDEN, CLASSES = 16, 12, 8, 16, 16
SAMPLE, STEPS, BATCH = 1500, 400, 1024
#: Windows of one step and its rate where tasks go on from the first steps.
READ, RATE = 4096, 0.002
#: Windows whose arrays are held at once; a step adds up its gradients over as many parts as it takes.
PART = 1024
#: Numbers in one row of what a task has learned.
BLOCK = 1024
FREQUENT, WORD_BYTES = 1 << 18, 64
DISCOUNT = 0.75
#: Batches over which expected counts fade.
HORIZON = 200
#: Pseudo-counts by which corpus frequencies smooth each class.
SMOOTH = 200.0
#: Factors that put the three bytes before a byte into one of ``CONTEXTS`` places, and the pseudo-counts that smooth what follows.
FACTORS, CONTEXTS, SPREAD = (1, 67, 1543), 1 << 14, 4.0
#: Weights m to choose from.
MIXES = (0.0003, 0.001, 0.003, 0.01, 0.03, 0.06, 0.1, 0.2, 0.3, 0.5, 0.7)
#: Words counted inside a task before they are handed on.
COUNTED = 500_000


def word_list(column: pa.Array) -> list[bytes]:
    """Words of a column; by way of numpy, for Arrow's own list makes an object per value first."""
    return column.to_numpy(zero_copy_only=False).tolist()


@dataclass
class Tokens:
    """Tokens of some texts: the different words, which of them each token is, and how many each text has."""

    words: list[bytes]
    place: np.ndarray
    many: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Tokens:
        """Lower-cased words, and behind those of each text its end, the empty word."""
        column = pc.replace_substring_regex(pc.ascii_lower(pa.array(texts, pa.string())), "[\\t-\\r]", " ")
        lists = pc.split_pattern(column, " ")
        coded = lists.flatten().cast(pa.binary()).dictionary_encode()
        words = word_list(coded.dictionary)
        place = coded.indices.to_numpy().astype(np.int64)
        full = (pc.binary_length(coded.dictionary).to_numpy() > 0)[place]
        offsets = lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(texts) else 0)
        ends = np.concatenate([[0], np.cumsum(full)])[offsets]
        place = np.insert(place[full], ends[1:], len(words))
        # Empty strings between blanks are no words; their place is left to the ends.
        return cls([*words, b""], place, np.diff(ends) + 1)

    def each(self, words: pa.Array, numbers: np.ndarray) -> np.ndarray:
        """A number per token, looked up once per different word; the last number is that of words not among ``words``."""
        return numbers[pc.index_in(pa.array(self.words, pa.binary()), value_set=words).fill_null(len(numbers) - 1).to_numpy()][self.place]


class Subwords:
    """Entries of a byte-level vocabulary file that begin a word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.size, self.end = library.get_vocab_size(), library.token_to_id("<|endoftext|>")
        # The file writes bytes as printable characters: these as themselves, the others from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.entry = {}
        for token, at in library.get_vocab().items():
            if token[0] == "Ġ" and all(c in shown for c in token):
                self.entry[bytes(shown[c] for c in token[1:])] = at
        self.longest = min(255, max(map(len, self.entry)))
        self.starts_word = np.zeros(self.size, bool)
        self.starts_word[[*self.entry.values(), self.end]] = True
        self.blank = self.split(b"")
        #: (bytes, entries, id * 256 + bytes) of the entries of each length, longest first.
        self.lengths = []
        for n in sorted({len(e) for e in self.entry if e}, reverse=True):
            entries = [e for e in self.entry if len(e) == n]
            self.lengths.append((n, pa.array(entries, pa.binary()), np.array([self.entry[e] << 8 | n for e in entries])))

    def split(self, word: bytes) -> int:
        """First id of a word and the bytes it stands for, as id * 256 + bytes."""
        for n in range(min(len(word), self.longest), -1, -1):
            at = self.entry.get(word[:n])
            if at is not None:
                return at << 8 | n
        raise ValueError("vocabulary without a blank")

    def first(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(first id, how many bytes it stands for) of every word; the empty word is the end."""
        column = pa.array(words, pa.binary())
        sizes = pc.binary_length(column).to_numpy()
        both = np.where(sizes > 0, self.blank, self.end << 8)
        left = np.flatnonzero(sizes)
        # Entries of one length at a time, for the words that no longer one begins.
        for n, entries, found in self.lengths:
            able = left[sizes[left] >= n]
            if len(able):
                heads = pc.binary_slice(column.take(pa.array(able)), 0, n)
                at = pc.index_in(heads, value_set=entries).fill_null(-1).to_numpy()
                both[able[at >= 0]] = found[at[at >= 0]]
                left = left[both[left] == self.blank]
        return both >> 8, both & 255


@dataclass
class Bytes:
    """p(byte | three bytes before) by counts, smoothed by p(byte | byte before); 256 stands for the end of the word.

    Before the first byte of a word there are blanks, also written 256.
    """

    one: np.ndarray  # [byte before, byte]: probability
    counts: np.ndarray  # [context, byte]
    totals: np.ndarray
    #: Size of both tables of counts.
    SIZE = (257 + CONTEXTS) * 257

    @staticmethod
    def behind(words: list[bytes], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in both tables of the bytes behind each word's first id and of its end, and each word's first of them."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.append(np.frombuffer(b"".join(words), np.uint8).astype(np.int64), 256)
        begin, many = np.cumsum(sizes) - sizes, sizes - known + 1
        starts = np.cumsum(many) - many
        word = np.repeat(np.arange(len(words)), many)
        at = known[word] + np.arange(len(word)) - starts[word]
        place = begin[word] + at
        byte = np.where(at < sizes[word], flat[np.minimum(place, len(flat) - 1)], 256)
        before = [np.where(at >= k, flat[np.maximum(place - k, 0)], 256) for k in (1, 2, 3)]
        context = sum(b * f for b, f in zip(before, FACTORS, strict=True)) % CONTEXTS
        return before[0] * 257 + byte, context * 257 + byte, starts

    @classmethod
    def counted(cls, counts: np.ndarray) -> Bytes:
        pairs, longer = counts[: 257 * 257].reshape(257, 257), counts[257 * 257 :].reshape(CONTEXTS, 257)
        every = pairs.sum(axis=0) + 1.0
        one = pairs + SPREAD * every / every.sum()
        return cls(one / one.sum(axis=1, keepdims=True), longer.astype(np.float32), longer.sum(axis=1).astype(float))

    def ends(self, words: list[bytes], known: np.ndarray) -> np.ndarray:
        """log A of every word; the end of a text has no bytes to come."""
        pair, longer, starts = self.behind(words, known)
        p = (self.counts.ravel()[longer] + SPREAD * self.one.ravel()[pair]) / (self.totals[longer // 257] + SPREAD)
        found = np.add.reduceat(np.log(p), starts) if len(words) else np.zeros(0)
        found[[not w for w in words]] = 0.0
        return found


_SUBWORDS: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    """The encoder of a vocabulary file, kept by the Python worker between tasks."""
    if path not in _SUBWORDS:
        _SUBWORDS[path] = Subwords(path)
    return _SUBWORDS[path]


@dataclass
class Network:
    weights: dict[str, np.ndarray]
    emission: np.ndarray  # [id, class]: E_k[id]

    @classmethod
    def fresh(cls, size: int, frequency: np.ndarray) -> Network:
        rng = np.random.default_rng(11)
        scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        weights = {
            "embed": (0.3 * rng.standard_normal((size, WIDTH))).astype(np.float32),
            "q": scale(WIDTH, WIDTH), "k": scale(WIDTH, WIDTH), "v": scale(WIDTH, WIDTH),
            "far": np.linspace(0, -2, WINDOW).astype(np.float32),
            "h": scale(2 * WIDTH, HIDDEN), "hb": np.zeros(HIDDEN, np.float32),
            "o": scale(HIDDEN, CLASSES), "ob": np.zeros(CLASSES, np.float32),
        }
        # Each id begins with one favourite class, else all classes would stay alike.
        lean = np.ones((size, CLASSES))
        lean[np.arange(size), rng.integers(0, CLASSES, size)] += 20.0
        emission = lean * frequency[:, None]
        return cls(weights, (emission / emission.sum(axis=0)).astype(np.float32))

    def attend(self, inputs: np.ndarray, score_from: int = 0) -> tuple[np.ndarray, tuple]:
        """Class shares at every place of the windows [window, place] from ``score_from`` on."""
        w = self.weights
        many, long = inputs.shape
        x = w["embed"][inputs.ravel()]
        scale = np.float32(1 / np.sqrt(WIDTH))
        mixed = (x @ np.concatenate([w["q"] * scale, w["k"], w["v"]], axis=1)).reshape(many, long, -1)
        q, k, v = mixed[:, score_from:, :WIDTH], mixed[:, :, WIDTH : 2 * WIDTH], mixed[:, :, 2 * WIDTH :]
        gap = np.arange(score_from, long)[:, None] - np.arange(long)[None, :]
        s = q @ k.transpose(0, 2, 1)
        s += np.where(gap >= 0, w["far"][np.clip(gap, 0, None)], np.float32(-1e9))
        np.minimum(s, np.float32(60), out=s)
        np.exp(s, out=s)
        total = s.reshape(-1, long) @ np.ones(long, np.float32)
        # A place whose every share is too small to tell looks at nothing.
        s /= np.maximum(total, np.float32(1e-30)).reshape(many, -1, 1)
        x = x.reshape(many, long, WIDTH)
        both = np.concatenate([x[:, score_from:], s @ v], axis=2).reshape(-1, 2 * WIDTH)
        h = np.maximum(both @ w["h"] + w["hb"], 0)
        z = h @ w["o"] + w["ob"]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= (z @ np.ones(CLASSES, np.float32))[:, None]
        return z.reshape(many, -1, CLASSES), (x, q, k, v, s, both, h, gap)

    def gradients(self, inputs: np.ndarray, goal: np.ndarray, exists: np.ndarray, expected: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the windows' mean negative log probability; their expected counts are added to ``expected``."""
        each = np.float32(1 / max(exists.sum(), 1))
        posterior, dx = np.empty((goal.size, CLASSES), np.float32), np.empty((inputs.size, WIDTH), np.float32)
        grad: dict[str, np.ndarray] = {}
        for at in range(0, len(inputs), PART):
            part = slice(at, at + PART)
            goals, places = slice(at * STRIDE, (at + PART) * STRIDE), slice(at * WINDOW, (at + PART) * WINDOW)
            found = self._part_gradients(inputs[part], goal[part].ravel(), exists[part].ravel(), each, posterior[goals], dx[places])
            grad = {name: grad[name] + x for name, x in found.items()} if grad else found
        _add_rows(expected, goal.ravel(), posterior)
        grad["embed"] = np.zeros_like(self.weights["embed"])
        _add_rows(grad["embed"], inputs.ravel(), dx)
        return grad

    def _part_gradients(self, inputs, goal, real, each: np.float32, posterior: np.ndarray, dx: np.ndarray) -> dict[str, np.ndarray]:
        """What some windows add to all gradients but that of the embedding; for this ``dx`` is filled, by place, and ``posterior`` by goal."""
        w, skip = self.weights, WINDOW - STRIDE
        share, (x, q, k, v, s, both, h, gap) = self.attend(inputs, skip)
        many = len(inputs)
        share = share.reshape(-1, CLASSES)
        np.multiply(share, self.emission[goal], out=posterior)
        posterior *= (real / np.maximum(posterior @ np.ones(CLASSES, np.float32), 1e-30))[:, None]
        dz = (share * real[:, None] - posterior) * each
        grad = {"o": h.T @ dz, "ob": dz.sum(axis=0)}
        dh = (dz @ w["o"].T) * (h > 0)
        grad |= {"h": both.T @ dh, "hb": dh.sum(axis=0)}
        dboth = (dh @ w["h"].T).reshape(many, STRIDE, -1)
        da = dboth[:, :, WIDTH:]
        ds = da @ v.transpose(0, 2, 1)
        ds *= s
        ds -= s * (ds.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32)).reshape(many, STRIDE, 1)
        grad["far"] = np.bincount(np.clip(gap, 0, None).ravel(), np.where(gap >= 0, ds.sum(axis=0), 0).ravel(), WINDOW).astype(np.float32)
        scale = np.float32(1 / np.sqrt(WIDTH))
        # q holds its scale already.
        dq, dk, dv = scale * (ds @ k), ds.transpose(0, 2, 1) @ q, s.transpose(0, 2, 1) @ da
        flat = lambda a: a.reshape(-1, a.shape[-1])
        grad |= {"q": flat(x[:, skip:]).T @ flat(dq), "k": flat(x).T @ flat(dk), "v": flat(x).T @ flat(dv)}
        by_window = dx.reshape(x.shape)
        by_window[:] = (flat(dk) @ w["k"].T + flat(dv) @ w["v"].T).reshape(x.shape)
        by_window[:, skip:] += (flat(dq) @ w["q"].T).reshape(many, STRIDE, -1) + dboth[:, :, :WIDTH]
        return grad


def _add_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """total[at] += rows, repeated places included."""
    for k in range(rows.shape[1]):
        total[:, k] += np.bincount(at, rows[:, k], len(total))


class Adam:
    """Steps of Adam on a network's weights."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights, self.steps = weights, 0
        self.moments = {name: (np.zeros_like(x), np.zeros_like(x)) for name, x in weights.items()}

    def step(self, grad: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        for name, g in grad.items():
            a, b = self.moments[name]
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            self.weights[name] -= (rate * (a / (1 - 0.9**self.steps)) / (np.sqrt(b / (1 - 0.99**self.steps)) + 1e-8)).astype(np.float32)


def windows_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first id, text) of the windows' scored parts: every STRIDE ids of each text."""
    many = -(-sizes // STRIDE)
    text = np.repeat(np.arange(len(sizes)), many)
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    first = begin[text] + (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    return first, text


def gather(ids: np.ndarray, sizes: np.ndarray, first: np.ndarray, text: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs [window, WINDOW], the scored ids [window, STRIDE] and which of those exist.

    The input at a place is the id before it; before a text there is its end id.
    """
    begin = np.concatenate([[0], np.cumsum(sizes)])
    low, high = begin[text][:, None], begin[text + 1][:, None]
    place = first[:, None] + np.arange(STRIDE - WINDOW, STRIDE)[None, :] - 1
    inside = (place >= low) & (place < high)
    inputs = np.where(inside, ids[np.clip(place, 0, len(ids) - 1)], end)
    goal = first[:, None] + np.arange(STRIDE)[None, :]
    exists = goal < high
    return inputs, ids[np.clip(goal, 0, len(ids) - 1)], exists


def train(network: Network, ids: np.ndarray, sizes: np.ndarray, frequency: np.ndarray, end: int, steps: int = STEPS) -> Network:
    """Fit the network to the windows of some texts, in a seeded order."""
    first, text = windows_of(sizes)
    rng, adam = np.random.default_rng(13), Adam(network.weights)
    expected = network.emission * 0
    floor = (SMOOTH * frequency)[:, None]
    order = np.empty(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(first))])
        batch, order = order[:BATCH], order[BATCH:]
        inputs, goal, exists = gather(ids, sizes, first[batch], text[batch], end)
        # Expected counts, older ones fading while the network still moves.
        expected *= 1 - 1 / max(2, min(step / 2, HORIZON))
        adam.step(network.gradients(inputs, goal, exists, expected), 0.02 * min(1, 4 * (1 - step / (steps + 1))))
        emission = expected + floor
        network.emission = (emission / emission.sum(axis=0)).astype(np.float32)
    return network


class Reader:
    """A task's copy of the network, which goes on over the task's texts and adds up its expected counts."""

    def __init__(self, network: Network):
        self.network = Network({name: x.copy() for name, x in network.weights.items()}, network.emission)
        self.adam, self.expected, self.read = Adam(self.network.weights), np.zeros_like(network.emission), 0
        #: Inputs, goals and which of these exist of windows that do not fill a step yet.
        self.held: list[tuple[np.ndarray, ...]] = []
        self.many = 0

    def learn(self, ids: np.ndarray, sizes: np.ndarray, end: int) -> None:
        """Go on over some texts; a step takes ``READ`` windows, however the texts are dealt to calls."""
        first, text = windows_of(sizes)
        at = 0
        while at < len(first):
            part = slice(at, at + READ - self.many)
            self.held.append(gather(ids, sizes, first[part], text[part], end))
            self.many += len(first[part])
            at = part.stop
            if self.many == READ:
                self.step()
        self.read += len(ids)

    def step(self) -> None:
        """A step over the windows held."""
        if self.held:
            inputs, goal, exists = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held, self.many = [], 0
            self.adam.step(self.network.gradients(inputs, goal, exists, self.expected), RATE)

    def learned(self) -> np.ndarray:
        """The ids read, the weights times that, and the expected counts, one after the other."""
        self.step()
        weights = [x.ravel().astype(float) * self.read for x in self.network.weights.values()]
        return np.concatenate([[self.read], *weights, self.expected.ravel()])


def merged(network: Network, learned: np.ndarray, frequency: np.ndarray) -> Network:
    """The network of all tasks, from the sum of what they have learned."""
    at, weights = 1, {}
    for name, x in network.weights.items():
        weights[name] = (learned[at : at + x.size] / max(learned[0], 1)).reshape(x.shape).astype(np.float32) if learned[0] else x
        at += x.size
    emission = learned[at:].reshape(network.emission.shape) + (SMOOTH * frequency)[:, None]
    return Network(weights, (emission / emission.sum(axis=0)).astype(np.float32))


def id_scores(network: Network, ids: np.ndarray, sizes: np.ndarray, begins: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Natural logarithms of p(id | before) and of p(a word begins | before) at every place."""
    first, text = windows_of(sizes)
    begin_share = network.emission[begins].sum(axis=0)
    p, b = np.empty(len(ids), np.float32), np.empty(len(ids), np.float32)
    for at in range(0, len(first), PART):
        inputs, goal, exists = gather(ids, sizes, first[at : at + PART], text[at : at + PART], end)
        share, _ = network.attend(inputs, WINDOW - STRIDE)
        place = (first[at : at + PART, None] + np.arange(STRIDE)[None, :])[exists]
        share = share[exists]
        p[place] = np.einsum("ij,ij->i", share, network.emission[goal[exists]])
        b[place] = share @ begin_share
    return np.log(np.maximum(p, 1e-37)), np.log(np.clip(b, 1e-37, 1))


def _read(rows: DataFrame, path: str, network: Network) -> tuple[DataFrame, DataFrame]:
    """What all tasks find in their texts: (word, c) of their tokens, counted inside tasks first,
    and (block, part), blocks of what each one's network has learned."""
    start = rows.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        counts: Counter = Counter()
        own, reader = subwords(path), Reader(start.value)

        def row(words, counts, blocks, parts):
            columns = [pa.array(words, pa.binary()), pa.array(counts, pa.int64()), pa.array(blocks, pa.int32()), pa.array(parts, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["word", "c", "block", "part"])

        def handed():
            none = [None] * len(counts)
            out = row(list(counts), list(counts.values()), none, none)
            counts.clear()
            return out

        for batch in chain.from_iterable(map(cut_batch, batches)):
            tokens = Tokens.of(batch.column(0).to_pylist())
            found = np.bincount(tokens.place, minlength=len(tokens.words)).tolist()
            counts.update({w: n for w, n in zip(tokens.words, found, strict=True) if n})
            reader.learn(own.first(tokens.words)[0][tokens.place], tokens.many, own.end)
            if len(counts) > COUNTED:
                yield handed()
        yield handed()
        if reader.read:
            learned = reader.learned().astype(np.float32)
            parts = [learned[at : at + BLOCK].tobytes() for at in range(0, len(learned), BLOCK)]
            none = [None] * len(parts)
            yield row(none, none, list(range(len(parts))), parts)

    found = cut(rows.mapInArrow(run, "word binary, c long, block int, part binary"), "read")
    words = found.filter("word IS NOT NULL").groupBy("word").agg(F.sum("c").alias("c"))
    return words, found.filter("block IS NOT NULL").select("block", "part")


def _sum_blocks(parts: DataFrame, network: Network) -> np.ndarray:
    """What all tasks have learned, added up by tasks that hold some blocks each; its size is the network's."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                numbers = np.frombuffer(part.as_buffer(), np.float32)
                if block in total:
                    total[block] += numbers
                else:
                    total[block] = numbers.astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["block", "part"])

    sums = parts.repartition(16, "block").mapInArrow(run, "block int, part binary").orderBy("block").toArrow()
    size = 1 + sum(x.size for x in network.weights.values()) + network.emission.size
    return np.frombuffer(b"".join(sums["part"].to_pylist()), float) if sums.num_rows else np.zeros(size)


def _id_counts(vocabulary: DataFrame, path: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all counted tokens: how many begin with each subword id (C) and how many different
    ones (V), and the counts of the bytes behind first ids; both of fixed size."""

    def run(batches):
        own, total, behind = subwords(path), np.zeros((2, size), np.int64), np.zeros(Bytes.SIZE, np.int64)
        for batch in batches:
            words, counts = word_list(batch.column(0)), batch.column(1).to_numpy()
            first, known = own.first(words)
            total[0] += np.bincount(first, counts, size).astype(np.int64)
            total[1] += np.bincount(first, minlength=size)
            # Each different word counts once: A stands in for words that were not seen.
            full = np.flatnonzero([bool(w) for w in words])
            pair, longer, _ = Bytes.behind([words[i] for i in full], known[full])
            at, many = np.unique(np.concatenate([pair, longer + 257 * 257]), return_counts=True)
            behind[at] += many
        at, more = np.flatnonzero(total[0]), np.flatnonzero(behind)
        ids, c = np.concatenate([at, size + more]), np.concatenate([total[0][at], behind[more]])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(c), pa.array(np.append(total[1][at], np.zeros(len(more), np.int64)))], names=["id", "c", "v"])

    counted = vocabulary.mapInArrow(run, "id long, c long, v long")
    found = counted.groupBy("id").agg(*[F.sum(x).alias(x) for x in "cv"]).toArrow()
    out = np.zeros((2, size + Bytes.SIZE), np.int64)
    out[:, found["id"].to_numpy()] = [found[x].to_numpy() for x in "cv"]
    return out[:, :size], out[0, size:]


def _parts(firsts: np.ndarray, c: np.ndarray, v: np.ndarray, mix: float) -> tuple[np.ndarray, np.ndarray]:
    """What each of a word's counts and its A weigh, by its first id."""
    many = c[firsts].astype(float)
    seen = many > 0
    each = np.where(seen, (1 - mix) / np.maximum(many, 1), 0.0)
    return each, np.where(seen, each * DISCOUNT * v[firsts] + mix, 1.0)


def _choose_mix(vocabulary: DataFrame, path: str, spelled: Bytes, c_first: np.ndarray, v_first: np.ndarray) -> float:
    """The weight m under which all training tokens are most likely, each one's own occurrence taken off its count."""

    def run(batches):
        own, total = subwords(path), np.zeros(len(MIXES))
        for batch in batches:
            words, counts = word_list(batch.column(0)), batch.column(1).to_numpy()
            firsts, known = own.first(words)
            a = np.exp(spelled.ends(words, known))
            for i, mix in enumerate(MIXES):
                each, own_part = _parts(firsts, c_first, v_first, mix)
                likely = np.maximum(counts - 1 - DISCOUNT, 0) * each + own_part * a
                total[i] += counts @ np.log(np.maximum(likely, 1e-300))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(MIXES)), pa.int32()), pa.array(total)], names=["mix", "sum"])

    sums = vocabulary.mapInArrow(run, "mix int, sum double").groupBy("mix").agg(F.sum("sum").alias("sum")).collect()
    return MIXES[max(sums, key=lambda r: (r["sum"], r["mix"]))["mix"]]


def score(docs: DataFrame, path: str, held_out, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    with small_batches(docs.sparkSession):
        return _score(docs, path, held_out, key, text)


def _score(docs: DataFrame, path: str, held_out, key: str, text: str) -> DataFrame:
    """What ``score`` returns; all Python work is done when it does."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), held_out.alias("held_out"), present(text).alias("text"))
    own = subwords(path)
    training = rows.filter("NOT held_out")
    network = Network.fresh(own.size, np.full(own.size, 1 / own.size))
    # Ids and text hashes are chosen first; at most SAMPLE of them are broadcast to fetch the texts.
    hashed = training.withColumn("text_hash", F.xxhash64("text"))
    chosen = hash_sample(hashed.select("doc_id", "text_hash"), "doc_id", SAMPLE).distinct()
    chosen = chosen.select(F.col("doc_id").alias("k"), F.col("text_hash").alias("h"))
    texts = hashed.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")))
    texts = texts.select("doc_id", "text_hash", "text").dropDuplicates(["doc_id", "text_hash"])
    sample = texts.orderBy("text_hash", "doc_id").toArrow()["text"].to_pylist()
    if sample:
        tokens = Tokens.of(sample)
        ids = own.first(tokens.words)[0][tokens.place]
        # Where the tasks start from; what they start with is fitted again on all texts.
        frequency = (np.bincount(ids, minlength=own.size) + 0.01) / (len(ids) + 0.01 * own.size)
        network = train(Network.fresh(own.size, frequency), ids, tokens.many, frequency, own.end)

    words, parts = _read(training.select("text"), path, network)
    vocabulary = cut(words, "vocabulary")
    totals = vocabulary.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(totals.n or 0), int(totals.v)
    (c_first, v_first), behind = _id_counts(vocabulary, path, own.size)
    frequency = (c_first + 0.01) / (c_first + 0.01).sum()
    network, spelled = merged(network, _sum_blocks(parts, network), frequency), Bytes.counted(behind)
    mix = _choose_mix(vocabulary, path, spelled, c_first, v_first) if n else 1.0
    top = vocabulary.filter(F.length("word") <= WORD_BYTES).orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow()
    # As Arrow and numpy: a dictionary of Python objects takes ten times the memory in every worker.
    frequent = pa.array(word_list(top["word"]), pa.binary()), np.append(top["c"].to_numpy(), -1)
    shared = spark.sparkContext.broadcast((network, spelled, frequent, c_first, v_first))
    floor = n + 0.5 * (v + 1)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        net, spelling, (counted, counts), c_of, v_of = shared.value
        encoder = subwords(path)
        tokens = Tokens.of(batch.column(2).to_pylist())
        firsts, known = encoder.first(tokens.words)
        each, own_part = _parts(firsts, c_of, v_of, mix)
        own_part *= np.exp(spelling.ends(tokens.words, known))
        each, own_part = each[tokens.place], own_part[tokens.place]
        p, b = id_scores(net, firsts[tokens.place], tokens.many, encoder.starts_word, encoder.end)
        # A word begins here anyway.
        begun = np.minimum(p - b, 0).astype(np.float64)
        many = tokens.many
        c = tokens.each(counted, counts)
        begin = np.cumsum(many) - many
        here = c >= 0
        base = np.where(here, np.log10((np.maximum(c, 0) + 0.5) / floor), 0.0)
        mixed = np.log10(np.maximum(np.maximum(c - DISCOUNT, 0) * each + own_part, 1e-300))
        mixed = begun / np.log(10) + np.where(here, mixed, 0.0)
        rare = np.flatnonzero(~here)
        text_of = np.repeat(np.arange(len(many)), many)[rare]
        offsets = np.searchsorted(text_of, np.arange(len(many) + 1)).astype(np.int32)
        words = pa.array(tokens.words, pa.binary()).take(pa.array(tokens.place[rare]))
        listed = pa.ListArray.from_arrays(
            pa.array(offsets), pa.StructArray.from_arrays(
                [words, pa.array(each[rare]), pa.array(own_part[rare])], names=["word", "each", "own"]))
        sums = [np.add.reduceat(x, begin) for x in (here.astype(np.int64), base, mixed)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(many), *map(pa.array, sums), listed],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base", "mixed", "rare"],
        )

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, mixed double, rare array<struct<word:binary,each:double,own:double>>"
    # The row's own number tells repeated rows apart; the table is written once, so it stays.
    scored = map_rows(rows, run, schema).withColumn("row", F.monotonically_increasing_id())
    scored = cut(scored, "scored")
    each = scored.select("row", F.explode("rare").alias("r")).select("row", "r.*")
    joined = each.join(vocabulary, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    mixed = F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) * F.col("each") + F.col("own")
    sums = joined.groupBy("row").agg(
        F.count_if(F.col("c") > 0).alias("rare_known"),
        F.sum(F.log10((F.col("c") + 0.5) / floor)).alias("rare_base"),
        F.sum(F.log10(F.greatest(mixed, F.lit(1e-300)))).alias("rare_mixed"),
    )
    whole = scored.drop("rare").join(sums, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return whole.select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "rare_known").cast("bigint").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"), plus("base", "rare_base").alias("base_score"), plus("mixed", "rare_mixed").alias("score"),
    )

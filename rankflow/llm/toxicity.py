"""Toxicity as ordinal severity: a cumulative-link model over sparse text features.

Labelled texts only say whether a text is toxic.  Grades are made of that and of
the features that mark toxic texts: grade 0 is not toxic, and toxic texts are
graded 1 to 3 by how many marking words they hold (terciles).  The model has one
weight per feature, shared by all grades, and one ordered threshold per grade:
P(grade >= k) = sigmoid(w . x - t_k).  It gives the expected grade (severity) and
P(grade >= 1); a text is called toxic from a probability of one half.

Features are words (A-Z lower-cased, outer punctuation off) and their prefixes
of 4 to 6 bytes, hashed; so inflected forms count as their stem.

The model is fitted on at most ``SAMPLE`` labelled texts, chosen by a hash of the
id; everything else covers all rows.

Defined cases: a null text counts as empty and gets the severity of no features;
null labels and labels without a text are left out, of several labels of an id
the largest counts; without toxic examples nothing is called toxic; repeated
rows each get a row; other columns are kept, except those with result names; texts are
read whole, of any length; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.tables import Memo, hash_sample, map_rows, present, words_of
from rankflow.plans import cut

#: Labelled texts the model is fitted on, at most.
SAMPLE = 20_000
#: Features of the model, at most, and the hash space they come from.
FEATURES, SPACE = 2048, 1 << 20
GRADES = 3
PUNCTUATION = b".,;:!?\"'()[]{}"


def feature_ids(word: bytes) -> tuple[int, ...]:
    """Hashed features of one word."""
    word = word.strip(PUNCTUATION)
    if not word:
        return ()
    forms = [b"w" + word, *(b"%d" % n + word[:n] for n in (4, 5, 6) if len(word) >= n)]
    return tuple(zlib.crc32(f) % SPACE for f in forms)


@dataclass(frozen=True)
class Model:
    """Weights by hashed feature, and the ordered thresholds."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each row and k = 1, 2, ..."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - np.array(self.thresholds)[None, :], -60, 60)))


def sample_texts(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic, text) of at most ``sample`` labelled texts."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # At most ``sample`` rows of an id and a label: safe to broadcast.
    chosen = hash_sample(known, "doc_id", sample)
    texts = docs.select("doc_id", present("text").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")


def _feature_counts(texts: DataFrame) -> DataFrame:
    """Per hashed feature: texts that hold it, toxic and not; counted inside tasks first."""

    def run(batches):
        totals = np.zeros((2, SPACE + 1), np.int32)
        memo = Memo(feature_ids, 200_000, 64)
        for batch in batches:
            for toxic, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = {f for word in set(words_of(text.encode())) for f in memo[word]}
                totals[int(toxic > 0), list(found)] += 1
                totals[int(toxic > 0), SPACE] += 1
        at = np.flatnonzero(totals.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(totals[1, at].astype(np.int64)), pa.array(totals[0, at].astype(np.int64))],
            names=["feature", "n_toxic", "n_clean"],
        )

    counted = texts.mapInArrow(run, "feature long, n_toxic long, n_clean long")
    return counted.groupBy("feature").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))


def _sparse_rows(texts: DataFrame, chosen: list[int]) -> DataFrame:
    """(toxic, feature, n, row) of the chosen features in each sampled text."""
    wanted = frozenset(chosen)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo = Memo(lambda word: [f for f in feature_ids(word) if f in wanted], 200_000, 64)
        rows = []
        columns = (batch.column(i).to_pylist() for i in range(3))
        for key, toxic, text in zip(*columns, strict=True):
            counts = Counter(f for word in words_of(text.encode()) for f in memo[word])
            rows.append((key, int(toxic > 0), list(counts), list(counts.values())))
        kinds = [batch.schema.field(0).type, pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "toxic", "feature", "n"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return map_rows(texts, run, f"doc_id {kind}, toxic int, feature array<long>, n array<long>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit the model; only the sample's counts of at most ``FEATURES`` features reach the driver."""
    texts = cut(sample_texts(docs, labels, sample), "labelled")
    counts = cut(_feature_counts(texts), "features")
    total = counts.filter(F.col("feature") == SPACE).first()
    none = Model({}, tuple(20.0 + k for k in range(GRADES)))
    if total is None or not total.n_toxic:
        return none
    toxic_share = (F.col("n_toxic") + 0.5) / (total.n_toxic + 1.0)
    clean_share = (F.col("n_clean") + 0.5) / (total.n_clean + 1.0)
    lift = F.log(toxic_share / clean_share)
    strong = counts.filter((F.col("feature") < SPACE) & (F.col("n_toxic") + F.col("n_clean") >= 5)).select(
        "feature", lift.alias("lift"), (F.abs(lift) * F.sqrt(F.least("n_toxic", F.lit(10_000)) + 0.25)).alias("weight"))
    strong = strong.orderBy(F.desc("weight"), "feature").limit(FEATURES).collect()
    chosen = sorted(r.feature for r in strong)
    marks = {r.feature for r in strong if r.lift > 2}
    rows = sorted(_sparse_rows(texts, chosen).collect(), key=lambda r: (r.doc_id, r.toxic, sorted(zip(r.feature, r.n))))
    place = {f: i for i, f in enumerate(chosen)}
    at = np.array([i for i, r in enumerate(rows) for _ in r.feature], np.int64)
    feature = np.array([place[f] for r in rows for f in r.feature], np.int64)
    value = np.log1p(np.array([n for r in rows for n in r.n], float))
    toxic = np.array([r.toxic for r in rows])
    marked = np.array([sum(n for f, n in zip(r.feature, r.n) if f in marks) for r in rows])
    bounds = np.quantile(marked[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + np.searchsorted(bounds, marked, side="left"), 0)
    weights, thresholds = fit_ordinal(at, feature, value, grade, len(chosen))
    return Model(dict(zip(chosen, weights.tolist())), tuple(thresholds.tolist()))


def fit_ordinal(at, feature, value, grade, size, rounds: int = 400, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Full-batch fit of shared weights and ordered thresholds with adaptive moments."""
    n = max(len(grade), 1)
    # thresholds: the first, then logarithms of the steps, so that they stay in order.
    params = np.concatenate([np.zeros(size), [2.0], np.zeros(GRADES - 1)])
    first, second = np.zeros_like(params), np.zeros_like(params)
    reached = (grade[:, None] >= np.arange(1, GRADES + 1)[None, :]).astype(float)
    for step in range(1, rounds + 1):
        steps = np.exp(params[size + 1 :])
        thresholds = params[size] + np.concatenate([[0], np.cumsum(steps)])
        score = np.bincount(at, params[feature] * value, len(grade)) if len(at) else np.zeros(len(grade))
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds[None, :], -60, 60)))
        # Each threshold is a yes-or-no question; the sum of their losses fits all with the same weights.
        slope = (p - reached) / n
        gradient = np.zeros_like(params)
        if len(at):
            gradient[:size] = np.bincount(feature, slope.sum(axis=1)[at] * value, size) + decay * params[:size]
        gradient[size] = -slope.sum()
        for k in range(1, GRADES):
            gradient[size + k] = -slope[:, k:].sum() * steps[k - 1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        params = params - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return params[:size], params[size] + np.concatenate([[0], np.cumsum(np.exp(params[size + 1 :]))])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns with ``severity`` (expected grade), ``p_toxic`` and ``toxic``; one pass where the rows lie."""
    results = ["severity", "p_toxic", "toxic"]
    keep = [c for c in docs.columns if c not in results]
    rows = docs.select(*keep, present(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    weights = model.weights

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo = _memo(weights)
        scores = []
        for t in batch.column(batch.num_columns - 1).to_pylist():
            found = Counter(f for hits in map(memo.__getitem__, words_of(t.encode())) if hits for f in hits)
            scores.append(sum(weights[f] * np.log1p(n) for f, n in found.items()))
        reach = model.at_least(np.array(scores, float))
        columns = [pa.array(reach.sum(axis=1)), pa.array(reach[:, 0]), pa.array(reach[:, 0] >= 0.5)]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*keep, *results])

    return map_rows(rows, run, f"{kinds}, severity double, p_toxic double, toxic boolean")


_MEMO: dict[int, tuple[dict[int, float], Memo]] = {}


def _memo(weights: dict[int, float]) -> Memo:
    """The weighted features of words met so far, kept while a Python worker stays with one model."""
    key = hash(frozenset(weights.items()))
    if key not in _MEMO:
        _MEMO.clear()
        _MEMO[key] = (weights, Memo(lambda word: tuple(f for f in feature_ids(word) if f in weights), 400_000, 48))
    return _MEMO[key][1]

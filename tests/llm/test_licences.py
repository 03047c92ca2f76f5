"""The licence index against trying every template at every place, as function and as registered query."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from rankflow.llm import licences
from rankflow.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(licences.UPPER, licences.LOWER)


def plain_scan(texts):
    """(n_words, n_base, first, last, base labels, labels, score) of each text."""
    split = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    held = Counter(w for words in split for w in set(words))
    weight = {w: max(1, math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * held[w] + 1)))) for w in licences.vocabulary()}
    out = []
    for words in split:
        base, based, labels, best = [], set(), set(), 0.0
        for t in licences.TEMPLATES:
            own, keys = t.text.split(), t.key_places()
            total = sum(weight[w] for w in own)
            for start in range(-len(own), len(words)):
                same = [i for i, w in enumerate(own) if 0 <= start + i < len(words) and words[start + i] == w]
                aligned = sum(weight[own[i]] for i in same)
                if 100 * aligned >= licences.SHARE * total and keys <= set(same):
                    labels.add(t.label)
                    best = max(best, aligned / total)
                    if t.base:
                        base.append(start)
                        based.add(t.label)
        ends = (min(base), max(base)) if base else (None, None)
        out.append((len(words), len(base), *ends, ",".join(sorted(based)), ",".join(sorted(labels)), best))
    return out


def made(rng):
    """Words and whole, cut and damaged licence texts in odd punctuation."""
    parts = []
    for _ in range(rng.randint(0, 6)):
        words = list(rng.choice(licences.TEMPLATES).text.split())
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = rng.choice(["the", "word", "ñandú", "license"])
        if rng.random() < 0.3:
            words = words[rng.randrange(len(words)) :]
        parts += [w.title() if rng.random() < 0.2 else w for w in words] + ["plain", "The", "of"][: rng.randint(0, 3)]
    return "".join(w + rng.choice([" ", "\n", ", ", "--", "/ ", "\x00"]) for w in parts)


def test_labels_equal_a_plain_scan(spark):
    rng = random.Random(12)
    texts = [made(rng) for _ in range(150)] + [None, "", "...", "under the MIT license " * 300, " CC BY-NC 4.0", "x" * 100_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in licences.scan(df).collect()}
    want = plain_scan(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(1 for w in want if w[5]) > 50 and sum(1 for w in want if not w[5]) > 10


def test_every_template_is_its_own_match(spark):
    texts = [t.text.upper() for t in licences.TEMPLATES]
    got = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in got.collect():
        assert licences.TEMPLATES[r.doc_id].label in r.labels.split(",") and r.score == 1.0


def test_repeats_nulls_and_clashing_columns(spark):
    rows = [(1, "Under the MIT License."), (1, "Under the MIT License."), (None, "Under the MIT License."), (2, None)]
    clash = {c: F.lit("own") for c in ("labels", "score", "n_words", "word", "place", "template", "start", "row", "label", "h")}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash)
    got = licences.scan(df)
    assert got.columns == ["doc_id", "word", "place", "template", "start", "row", "label", "h", *licences.RESULTS]
    found = [(r.doc_id, r.n_base, r.first_word, r.base_labels, r.word) for r in got.collect()]
    assert sorted(found, key=str) == sorted([(1, 1, 0, "mit", "own")] * 2 + [(None, 1, 0, "mit", "own"), (2, 0, None, "", "own")], key=str)
    assert licences.scan(df.limit(0)).count() == 0


def test_query_runs_no_python(spark, tmp_path):
    spark.createDataFrame([(1, "cc by nc")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["op12_licence_scan"][0](spark, str(tmp_path))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert [tuple(r) for r in df.collect()] == [(1, 3, 1, 0, 0, "cc-by-nc", "cc-by-nc", 1.0)]

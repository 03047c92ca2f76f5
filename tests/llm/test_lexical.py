"""Ranked search against scoring every document, with ties, repeats, several blocks and small turns."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankflow.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plain_search(docs, items, k):
    split = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    total, n_docs = sum(n for _, _, n in split), len(split)
    held = Counter(t for _, counts, _ in split for t in counts)
    out = []
    for item, text in items:
        scored = []
        for doc, counts, n in split:
            m = 75 + 25 * n * n_docs // total
            score = 0
            for t in terms(text):
                if counts[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1)))
                    score += w * (1_000_000_000 * counts[t] // (1000 * counts[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def made(rng, words, most):
    return "".join(rng.choice(words) + rng.choice([" ", "-", "\n", ". ", "\x00"]) for _ in range(rng.randint(0, most)))


@pytest.mark.parametrize("block, turn", [(lexical.BLOCK_BYTES, lexical.TURN), (200, 1)])
def test_search_equals_scoring_all(spark, monkeypatch, block, turn):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical, "TURN", turn)
    rng = random.Random(13)
    words = ["the", "The", "of", "a", "ÉTÉ", "été", "x1", "日本"] + [f"w{i}" for i in range(90)]
    docs = [(i, made(rng, words, 60)) for i in range(400)]
    docs += [(i, "the of w1 w2") for i in range(500, 560)] + [(7, docs[7][1]), (None, "the of w1 w2"), (600, None), (601, ""), (602, "the " * 30_000)]
    items = [(i, made(rng, words, 40)) for i in range(12)] + [(3, "w1 w2 the"), (None, "w1"), (20, None), (21, ""), (22, "nowhere")]
    items += [(23, " ".join(f"w{i}" for i in range(90)) + " the the été"), (3, "w1 w2 the")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "terms", "counts", "score", "rank")})
    b = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("doc_id", "_n", "score")})
    got = lexical.search(d, b, k=20)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(docs, items, 20)


def test_empty_tables(spark):
    one = spark.createDataFrame([(1, "a word")], "doc_id long, text string")
    item = one.withColumnRenamed("doc_id", "item_id")
    assert lexical.search(one.limit(0), item).count() == 0
    assert lexical.search(one, item.limit(0)).count() == 0
    assert lexical.search(one.withColumn("text", F.lit("  ")), item).count() == 0
    assert [tuple(r)[:3] for r in lexical.search(one, item).collect()] == [(1, 1, 1)]

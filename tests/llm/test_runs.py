"""Periodic runs against a plain scan of every diagonal, as function and as registered query."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankflow.llm import runs
from rankflow.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """(start, length, period) of all runs, by start, then period."""
    found = {}
    for q in range(1, len(words)):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(12, 2 * q):
                found.setdefault((start, i + q - start), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        g, n, given = h // 10, len(words), list(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [given[i] if i < a else given[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    text = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(found), *best, milli, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def made(rng):
    n, kinds = rng.randint(0, 120), rng.choice([1, 2, 2, 3, 40])
    words = [rng.randrange(kinds) for _ in range(n)]
    if n > 3 and rng.random() < 0.5:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 2))
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    unit = [rng.randrange(kinds) for _ in range(rng.randint(1, 25))]
    return words + unit * rng.randint(0, 3) + words[: rng.randint(0, 5)]


def test_runs_equal_a_scan_of_all_diagonals():
    rng = random.Random(11)
    for _ in range(300):
        texts = [made(rng) for _ in range(rng.randint(1, 4))]
        flat = np.array([w for t in texts for w in t], np.int64)
        got = runs.runs_of(flat, np.repeat(np.arange(len(texts)), [len(t) for t in texts]))
        begin, want = 0, []
        for t in texts:
            want += [(s + begin, n, q) for s, n, q in plain_runs(t)]
            begin += len(t)
        assert sorted(map(tuple, got.tolist())) == sorted(want)


def test_a_long_text_of_one_word_and_of_two():
    for words, count in ((np.zeros(100_000, np.int64), 1), (np.arange(100_000) % 500 // 499, 201)):
        assert len(runs.runs_of(words.astype(np.int64), np.zeros(100_000, np.int64))) == count


def test_rows_nulls_and_clashing_columns(spark):
    loop = "one two three " * 5
    texts = [(1, loop + "end"), (1, loop + "end"), (2, None), (3, ""), (None, "\t" + loop), (4, "x" * 50_000 + " " + loop)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"runs": F.lit(1), "collapsed": F.lit(2), "start": F.lit(3)})
    got = runs.periodic_runs(df)
    assert got.columns == ["doc_id", "start", "runs", "collapsed"]
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r.doc_id, []).append(([tuple(x) for x in r.runs], r.collapsed))
    assert by_id[1] == [([(0, 15, 3)], "one two three end")] * 2
    assert by_id[2] == by_id[3] == [([], "")]
    assert by_id[None] == [([(0, 15, 3)], "one two three")]
    assert by_id[4] == [([(1, 15, 3)], "x" * 50_000 + " one two three")]
    assert runs.periodic_runs(df.limit(0)).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="driver tables not present")
def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_periodic_runs"][0](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(plain_row(r.doc_id, r.text) for r in docs)


def test_query_on_made_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(map(str, made(rng)))) for i in range(200)] + [(7, None), (None, "a " * 20), (10, ""), (5, "\n b\x0bc " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op11_periodic_runs"][0](spark, str(tmp_path)).collect()
    key = lambda r: (str(r[0]), *map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted((plain_row(*r) for r in rows), key=key)

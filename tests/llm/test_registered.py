"""The registered training-data queries, run as they are on the smallest tables, against plain versions of their results."""

import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from rankflow.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="driver tables not present")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def run(spark, name):
    return QUERIES[name][0](spark, SF_DIR).collect()


def lowered(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_op1_against_all_inner_products(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = {}
    for r in run(spark, "op1_prefix_forest"):
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in ids[ids % 20 == 0].tolist():
        score = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        hits, total = hits + len({i for _, i, _ in found[q]} & set(ids[order].tolist())), total + len(order)
        assert [rank for rank, _, _ in sorted(found[q])] == list(range(1, len(order) + 1))
    assert hits >= 0.9 * total


def test_op2_equals_the_library(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in run(spark, "op2_token_counts"):
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_op3_base_and_bounds(spark, texts):
    words = {i: [*WORD.findall(lowered(t)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in run(spark, "op3_attention_scores"):
        own = words[r.doc_id]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        known = sum(counts[w] > 0 for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and -400 * len(own) < r.score < 0


def test_op5_against_all_pairs(spark, texts):
    prints = {}
    for i, text in texts.items():
        words = WORD.findall(lowered(text))
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for r in run(spark, "op5_simhash"):
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", find(r.doc_id))


def test_op6_finds_the_labelled_toxic_documents(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect() if r.toxic is not None}
    rows = [r for r in run(spark, "op6_toxicity") if r.doc_id in labels]
    assert sum(r.toxic == bool(labels[r.doc_id]) for r in rows) >= 0.9 * len(rows) and all(0 <= r.severity <= 3 for r in rows)


def test_op7_holds_every_id_once(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, windows = {}, {}
    for r in run(spark, "op7_packing"):
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048


def test_op9_against_all_strings(spark, texts):
    import hashlib

    raw = {i: t.encode() for i, t in texts.items()}
    count = Counter(b[k : k + 400] for b in raw.values() for k in range(len(b) - 399))
    for r in run(spark, "op9_suffix_dedup"):
        own = raw[r.doc_id]
        gone, end, spans = np.zeros(len(own), bool), -1, 0
        for k in range(len(own) - 399):
            if count[own[k : k + 400]] > 1:
                spans += k > end
                gone[k : k + 400], end = True, k + 400
        kept = bytes(b for b, g in zip(own, gone.tolist()) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(own), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_op10_pieces_decode_to_the_texts(spark, texts):
    from rankflow.llm.pieces import lattices

    own = lattices(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    for r in run(spark, "op10_sentence_pieces"):
        assert r.lossless and own.decode(np.array(r.pieces, np.int64)) == texts[r.doc_id] and r.n_pieces == len(r.pieces)


def test_pipeline_packs_whole_documents(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    tokens = {}
    for r in rows:
        tokens.setdefault(r.doc_id, [r.doc_tokens, 0])[1] += r.length
    assert rows and all(whole == held for whole, held in tokens.values())
    assert len({r.sequence_id for r in rows}) >= sum(n for n, _ in tokens.values()) // 2048

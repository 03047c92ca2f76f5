"""The training-data operators against brute force, and on null, empty, repeated and clashing rows."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankflow.llm import attention, chat, forest, packing, pieces, quality, simhash, suffixes, tables, token_prefix, toxicity
from rankflow.llm.components import components
from rankflow.llm.tables import hash_sample

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string"
BITS = ["a", "The", "don't", "'ll", "  ", "\n", "\n\n", " ", "é", "É", "ß", "日本", "12", "!!", "$", "\x1c", "\t", "<|endoftext|>", "<|end", "xxxxx", "😀", "a.", "B,", "İ,", "\xa0", "▁", "ing"]


def strange(n, seed=1):
    dice = random.Random(seed)
    return ["".join(dice.choice(BITS) for _ in range(dice.randint(0, 12))) for _ in range(n)]


@pytest.fixture
def odd_docs(spark):
    """Nulls, empties, a repeated row, and columns named like the operators' own."""
    rows = [(None, None), (1, ""), (1, ""), (2, "some words, twice twice\n" * 30), (3, "x" * 5000)]
    clash = ("n_words", "failed", "fp", "severity", "pieces", "n_tokens", "root", "list", "word")
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("own") for c in clash})


# 1 -----------------------------------------------------------------------------------------------


def test_forest_finds_neighbours_and_skips_bad_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[40:60] = x[40]  # one common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(600, None), (620, [0.0] * 16), (640, [None] * 16), (660, [math.nan] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = forest.nearest(df, F.col("vec_id") % 20 == 0, k=10).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(found) == list(range(0, 600, 20))
    y, hits = x.astype(float), 0
    for q, answer in found.items():
        score = (y * y[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(600), -score)) if i != q][:10]
        hits += len({i for i, _ in answer} & set(order))
        assert all(math.isclose(s, score[i], rel_tol=1e-12) for i, s in answer)
    assert hits >= 0.9 * 10 * len(found)
    assert [i for i, _ in found[40]] == list(range(41, 51))  # ties go to smaller ids
    assert forest.nearest(df.limit(0), F.lit(True)).count() == 0


def test_forest_gives_k_neighbours_outside_a_large_tight_group(spark):
    rng = np.random.default_rng(4)
    order = [r.id for r in spark.range(3040).orderBy(F.xxhash64("id"), "id").collect()]
    alone = {order[10], *order[forest.SAMPLE : forest.SAMPLE + 39]}  # one of them among the sampled queries
    middle = rng.standard_normal(16)
    x = np.array([rng.standard_normal(16) if i in alone else middle + 1e-6 * rng.standard_normal(16) for i in range(3040)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = forest.nearest(df, F.lit(True), k=20).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {i: 20 for i in range(3040)}


# 2 -----------------------------------------------------------------------------------------------


def test_prefix_counts_equal_the_library():
    own, library = token_prefix.counter(BYTE), Tokenizer.from_file(BYTE)
    count = lambda s: len(library.encode(s, add_special_tokens=False).ids)
    for text in strange(400):
        prefixes = [count(text[: i + 1]) for i in range(len(text))]
        assert own.count(text) == count(text)
        assert own.prefix_counts(text) == prefixes
        for budget in (0, 1, 3, 7):
            assert own.fitting(text, budget) == max((i + 1 for i, n in enumerate(prefixes) if n <= budget), default=0)


def test_prefix_counts_of_the_longest_tokens_equal_the_library():
    own, library = token_prefix.counter(BYTE), Tokenizer.from_file(BYTE)
    count = lambda s: len(library.encode(s, add_special_tokens=False).ids)
    longest = sorted(own.token, key=lambda t: (-len(t), t))[:40]
    assert len(longest[0]) == own.longest
    for raw in longest:
        try:
            token = raw.decode()
        except UnicodeDecodeError:
            continue
        for text in (" " + token, token * 3, " " + token * 3, "a" + token, " " + token * 2 + token[: len(token) // 2] + " b"):
            assert own.count(text) == count(text)
            assert own.prefix_counts(text) == [count(text[: i + 1]) for i in range(len(text))]
    assert own.count(" " + "ÃÂ" * 100) == count(" " + "ÃÂ" * 100) == 5


def test_token_counts_of_odd_rows(odd_docs):
    rows = token_prefix.token_counts(odd_docs, BYTE, 100).collect()
    assert sorted((r.n_tokens == 0, r.over_limit) for r in rows) == [(False, True)] * 2 + [(True, False)] * 3
    counted = token_prefix.prefix_counts(odd_docs.filter("doc_id = 2"), BYTE)
    at = counted.withColumn("k", F.lit(10)).select(token_prefix.tokens_at("k").alias("n"), "word").first()
    library = Tokenizer.from_file(BYTE)
    assert at.n == len(library.encode("some words, twice"[:10]).ids) and at.word == "own"


# 3 -----------------------------------------------------------------------------------------------


def test_network_is_causal_proper_and_windows_score_each_id_once():
    rng = np.random.default_rng(1)
    net = attention.Network.fresh(50, np.full(50, 0.02))
    assert np.allclose(net.emission.sum(axis=0), 1, atol=1e-4)
    ids = rng.integers(0, 50, 140)
    sizes = np.array([100, 1, 39])
    p, _ = attention.id_scores(net, ids, sizes, np.ones(50, bool), 0)
    changed = ids.copy()
    changed[60] = (ids[60] + 1) % 50
    q, _ = attention.id_scores(net, changed, sizes, np.ones(50, bool), 0)
    assert np.array_equal(p[:60], q[:60]) and np.array_equal(p[100:], q[100:])
    first, _ = attention.windows_of(sizes)
    assert len(first) == sum(-(-s // attention.STRIDE) for s in sizes)
    before = p.mean()
    ids = np.tile(np.arange(10), 100)
    trained = attention.train(net, ids, np.array([1000]), np.full(50, 0.02), 0, steps=60)
    assert attention.id_scores(trained, ids, np.array([1000]), np.ones(50, bool), 0)[0].mean() > before + 1


def test_scores_count_as_the_contract_says(spark, odd_docs):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    rows = attention.score(odd_docs, BYTE, held).collect()
    texts = {None: "", 1: "", 2: "some words, twice twice\n" * 30, 3: "x" * 5000}
    train = Counter()
    for r in odd_docs.collect():
        if zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 != 1:
            train.update([*(r.text or "").split(), None])
    n, v = sum(train.values()), len(train)
    assert len(rows) == 5
    for r in rows:
        tokens = [*texts[r.doc_id].split(), None]
        base = sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(train[t] > 0 for t in tokens), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score <= 1e-9


def _first_ids(texts):
    own, tokens = attention.subwords(BYTE), attention.Tokens.of(texts)
    return own.first(tokens.words)[0][tokens.place], tokens.many


def test_the_network_learns_from_every_training_text(spark):
    own = attention.subwords(BYTE)
    texts = ["one two one two"] * 5 + ["", "three", "four five " * 40] * 3
    docs = spark.createDataFrame([*enumerate(texts)], DOCS).repartition(3)
    start = attention.Network.fresh(own.size, np.full(own.size, 1 / own.size))
    words, parts = attention._read(docs.select("text"), BYTE, start)
    learned = attention._sum_blocks(parts, start)
    ids, sizes = _first_ids(texts)
    assert learned[0] == len(ids) == words.agg(F.sum("c")).first()[0]
    expected = learned[-start.emission.size :].reshape(start.emission.shape).sum(axis=1)
    assert np.allclose(expected, np.bincount(ids, minlength=own.size), atol=1e-3)
    whole = attention.merged(start, learned, np.full(own.size, 1 / own.size))
    assert whole.weights["o"].shape == start.weights["o"].shape and not np.array_equal(whole.weights["o"], start.weights["o"])


def test_a_step_holds_the_arrays_of_one_part_only(monkeypatch):
    rng = np.random.default_rng(5)
    net = attention.Network.fresh(50, np.full(50, 0.02))
    sizes = np.full(attention.READ, attention.STRIDE)
    sizes[7] = 5
    ids = rng.integers(0, 50, sizes.sum())
    inputs, goal, exists = attention.gather(ids, sizes, *attention.windows_of(sizes), 0)
    expected, peaks, found = [np.zeros((50, attention.CLASSES)) for _ in range(2)], [], []
    for part, into in zip((attention.PART, attention.READ), expected, strict=True):
        monkeypatch.setattr(attention, "PART", part)
        tracemalloc.start()
        found.append(net.gradients(inputs, goal, exists, into))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert 2 * peaks[0] < peaks[1]
    assert np.allclose(*expected, rtol=1e-4) and math.isclose(expected[0].sum(), exists.sum(), rel_tol=1e-4)
    assert found[0].keys() == found[1].keys() == net.weights.keys()
    assert all(np.allclose(found[0][name], found[1][name], rtol=1e-3, atol=1e-6) for name in found[0])


def test_a_tasks_steps_do_not_depend_on_batches(monkeypatch):
    monkeypatch.setattr(attention, "READ", 8)
    dice = np.random.default_rng(5)
    sizes = np.array([30, 1, 200, 0, 77, 12, 13])
    ids = dice.integers(0, 50, sizes.sum())
    found = []
    for cuts in ([], [2], [1, 3, 4, 6]):
        reader = attention.Reader(attention.Network.fresh(50, np.full(50, 0.02)))
        for part in np.split(np.arange(len(sizes)), cuts):
            begin = sizes[: part[0]].sum()
            reader.learn(ids[begin : begin + sizes[part].sum()], sizes[part], 0)
        found.append(reader.learned())
        assert reader.adam.steps == -(-sum(-(-sizes // attention.STRIDE)) // 8)
    assert np.array_equal(found[0], found[1]) and np.array_equal(found[0], found[2])


def test_scoring_gets_small_batches(spark, monkeypatch):
    before, limits = spark.conf.get(tables.ARROW_BYTES, None), []
    own = attention.cut

    def noted(df, name):
        limits.append((name, int(spark.conf.get(tables.ARROW_BYTES).rstrip("b"))))
        return own(df, name)

    monkeypatch.setattr(attention, "cut", noted)
    docs = spark.createDataFrame([(i, f"word{i} " * 20) for i in range(6)], DOCS)
    assert attention.score(docs, BYTE, F.col("doc_id") == -1).count() == 6
    assert {"read", "scored"} <= {name for name, _ in limits} and all(n <= tables.CHUNK_CHARS for _, n in limits)
    assert spark.conf.get(tables.ARROW_BYTES, None) == before

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    long = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("many words "), 400).alias("text"))
    with tables.small_batches(spark):
        found = long.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in found) == 3000 and max(r.bytes for r in found) <= tables.CHUNK_CHARS and len(found) < 20
    assert spark.conf.get(tables.ARROW_BYTES, None) == before


def test_first_ids_of_whole_batches_are_the_longest_entries():
    own, dice = attention.subwords(BYTE), random.Random(8)
    words = [b"", b"a" * 300, "日本語です".encode(), b"\xff\xfe", b"th\x00", *list(own.entry)[::50]]
    words += ["".join(dice.choices("therandofing.", k=dice.randint(1, 20))).encode() for _ in range(2000)]
    first, known = own.first(words)
    for word, at, n in zip(words, first.tolist(), known.tolist(), strict=True):
        longest = max(k for k in range(len(word) + 1) if word[:k] in own.entry)
        assert (at, n) == ((own.entry[word[:longest]], longest) if word else (own.end, 0))
    assert [len(x) for x in own.first([])] == [0, 0]


def test_order_of_words_outside_the_first_texts_counts(spark, monkeypatch):
    monkeypatch.setattr(attention, "SAMPLE", 3)
    names = spark.createDataFrame([(i,) for i in range(200)], "doc_id long")
    begun = {r.doc_id for r in hash_sample(names, "doc_id", 3).collect()}
    dice, found = random.Random(3), []
    for mixed in (False, True):
        rows = [(-1, "red green blue " * 30)]
        for i in range(200):
            words = ["red", "green", "blue"] * 30
            if mixed and i not in begun:
                dice.shuffle(words)
            rows.append((i, " ".join(words)))
        scored = attention.score(spark.createDataFrame(rows, DOCS), BYTE, F.col("doc_id") == -1)
        found.append(scored.filter("doc_id = -1").first())
    assert found[0].base_score == found[1].base_score and found[0].score > found[1].score + 1


def test_mixing_weight_is_the_likeliest_over_all_words(spark):
    counts = {f"w{i}".encode(): 1 + 400 // (i + 1) for i in range(600)} | {b"": 90}
    table = spark.createDataFrame(list(counts.items()), "word binary, c long").repartition(3)
    own = attention.subwords(BYTE)
    (c_of, v_of), counted = attention._id_counts(table, BYTE, own.size)
    spelled = attention.Bytes.counted(counted)
    first = {w: own.split(w) if w else own.end << 8 for w in counts}
    for w, at in first.items():
        assert not w or max(k for k in range(len(w) + 1) if w[:k] in own.entry) == at & 255
    by_id = Counter()
    for w, at in first.items():
        by_id[at >> 8] += counts[w]
    assert {i: n for i, n in enumerate(c_of.tolist()) if n} == by_id and v_of.sum() == len(counts)

    def spelling(w):
        padded = [256, 256, 256, *w, 256]
        return [(tuple(padded[k : k + 3]), padded[k + 3]) for k in range(len(w) + 1)]

    pairs, triples = Counter(), Counter()
    for w, at in first.items():
        for before, y in spelling(w)[at & 255 :] if w else ():
            pairs[before[2], y] += 1
            triples[before, y] += 1
    every = {y: 1 + sum(n for (_, z), n in pairs.items() if z == y) for y in range(257)}
    follows = {}
    for before, x in {(b, b[2]) for b, _ in triples}:
        one = {y: pairs[x, y] + 4 * every[y] / sum(every.values()) for y in every}
        seen = sum(n for (b, _), n in triples.items() if b == before)
        follows |= {(before, y): (triples[before, y] + 4 * one[y] / sum(one.values())) / (seen + 4) for y in every}
    likely = {}
    for m in attention.MIXES:
        likely[m] = 0
        for w, c in counts.items():
            at, known = first[w] >> 8, first[w] & 255
            a = math.prod(follows[before, y] for before, y in spelling(w)[known:]) if w else 1
            seen = (max(c - 1.75, 0) + 0.75 * int(v_of[at]) * a) / int(c_of[at])
            likely[m] += c * math.log((1 - m) * seen + m * a)
    assert attention._choose_mix(table, BYTE, spelled, c_of, v_of) == max(likely, key=likely.get)


# 4 -----------------------------------------------------------------------------------------------


def test_quality_measures_and_ablations(spark):
    dice = random.Random(5)
    texts = ["".join(dice.choice(["a", "b", "A", " ", "\n", "$", "\t", "ü", "\xa0"]) for _ in range(dice.randint(0, 60))) for _ in range(150)]
    docs = spark.createDataFrame([*enumerate(texts), (-1, None)], DOCS)
    rows = quality.ledger(docs).cache()
    for r in rows.collect():
        text = r.text or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        grams = Counter(zip(words, words[1:], words[2:]))
        places = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(places))
        assert (r.n_symbols, r.n_dup_lines) == (text.count("$"), len(lines) - len(set(lines)))
        assert bool(r.failed & 1) == (len(words) < 50)
    table = {r.rule: r for r in quality.ablations(rows, quality.FULL).collect()}
    assert table["few_words"].n_failed == rows.filter("n_words < 50").count()
    assert quality.passing(rows, quality.FULL).count() == rows.filter(quality.kept(quality.FULL)).count()


def test_quality_of_odd_rows(odd_docs):
    rows = quality.ledger(odd_docs).collect()
    assert len(rows) == 5 and all(r.failed for r in rows)


# 5 -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bucket", [1024, 2])
def test_links_equal_all_pairs(spark, bucket):
    dice = random.Random(7)
    values = {0, (1 << 64) - 1}
    for _ in range(12):
        start = dice.getrandbits(64)
        for _ in range(8):
            near = start
            for bit in dice.sample(range(64), dice.randint(0, 5)):
                near ^= 1 << bit
            values.add(near)
    signed = np.array(sorted(values), np.uint64)
    fps = spark.createDataFrame([(int(x),) for x in signed.view(np.int64)], "fp long")
    edges = simhash.links(fps, bucket)
    got = {r.node: r.root for r in components(edges).collect()}
    near = np.bitwise_count(signed[:, None] ^ signed[None, :]) <= 4
    label = np.arange(len(signed))
    while True:
        least = np.where(near, label[None, :], len(signed)).min(axis=1)
        if (least == label).all():
            break
        label = least
    groups = {}
    for x, k in zip(signed.view(np.int64).tolist(), label.tolist()):
        groups.setdefault(k, set()).add(x)
    for members in groups.values():
        assert len(members) == 1 or {got[m] for m in members} == {min(members)}


def test_fingerprints_follow_the_definition(odd_docs):
    import xxhash

    def plain(text):
        words = text.split()
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    texts = ["", "one", "a b c", "a b c d", "the cat sat on the mat the cat sat on", "ünï x y z " * 9]
    assert simhash.fingerprint_of(texts).tolist() == [plain(t) for t in texts]
    rows = simhash.near_duplicates(odd_docs).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in rows) == [(-1, 1), (1, 1), (1, 1), (2, 2), (3, 3)]


# 6 -----------------------------------------------------------------------------------------------


def test_severity_orders_and_generalises_to_held_out_texts(spark):
    dice = random.Random(3)
    word = lambda: "".join(dice.choice("ka lo mi ru te".split()) for _ in range(3))
    bad = ["grumpf", "zworkel", "blargen"]

    def text(hits):
        words = [word() for _ in range(60)]
        for _ in range(hits):
            words[dice.randrange(60)] = dice.choice(bad) + dice.choice(["", "s", "ed"])
        return " ".join(words)

    rows = [(i, text(0 if i % 4 else dice.randint(1, 8))) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    scored = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert sum(scored[i].toxic == (i % 4 == 0) for i in range(200, 400)) >= 190
    assert not any(scored[i].toxic for i in range(200, 400) if i % 4)
    probe = spark.createDataFrame([(0, text(0)), (1, text(1)), (6, text(9))], DOCS)
    low, some, much = (r.severity for r in sorted(toxicity.score(probe, model).collect(), key=lambda r: r.doc_id))
    assert low < some < much


def test_severity_without_examples(odd_docs):
    labels = odd_docs.select("doc_id", F.lit(0).alias("toxic"))
    rows = toxicity.score(odd_docs, toxicity.fit(odd_docs, labels)).collect()
    assert len(rows) == 5 and not any(r.toxic for r in rows)


# 7 -----------------------------------------------------------------------------------------------


def test_packing_places_every_token_once(spark):
    dice = random.Random(2)
    texts = [" ".join(dice.choice(["one", "Two,", "three.", "<|endoftext|>", "é"]) for _ in range(dice.choice([0, 3, 30, 30, 400, 3000]))) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, None)], DOCS).repartition(3)
    rows = packing.pack(docs, WORD, end_id=1, window=256).toPandas()
    library = Tokenizer.from_file(WORD)
    ids = {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    for r in rows[rows.doc_id.notna()].itertuples():
        part = ids[int(r.doc_id)][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[int(r.doc_id)])
    assert rows.length.sum() == sum(map(len, ids.values())) + len(ids[3]) + 1
    placed = rows.sort_values(["sequence_id", "offset"])
    before = placed.groupby("sequence_id").length.cumsum() - placed.length
    assert (before == placed.offset).all()
    assert (placed.groupby("sequence_id").length.sum() < 256).sum() <= 1


def test_word_ids_equal_the_library():
    library, own = Tokenizer.from_file(WORD), packing.word_ids(WORD)
    texts = strange(800, 4)
    flat, ends = own.ids(texts)
    for i, found in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert flat[ends[i] : ends[i + 1]].tolist() == found.ids


# 8 -----------------------------------------------------------------------------------------------


def test_reply_trees(spark):
    rows = [
        ("t", 1, None, "user", "hi </s>", 0), ("t", 2, 1, "assistant", "a\\[INST]", 1), ("t", 3, 1, "assistant", "b", 5),
        ("t", 4, 3, "user", None, 0), ("t", 6, 2, "user", "x", 9), ("c", 1, 2, "user", "round", 0), ("c", 2, 1, "user", "round", 0),
        (None, 1, None, None, "n", 0), ("m", 7, 99, "user", "lost parent", 0),
    ]
    rows += [("long", i, i - 1 if i else None, "user", f"t{i}", 0) for i in range(70)]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score int")
    paths = chat.best_paths(messages, per_tree=2)
    got = {}
    for r in sorted(paths.collect(), key=lambda r: (str(r.tree), r.branch, r.place)):
        got.setdefault((r.tree, r.branch), []).append(r.node)
    assert got == {("t", 1): [1, 2, 6], ("t", 2): [1, 3, 4], (None, 1): [1], ("m", 1): [7], ("long", 1): list(range(70))}
    out = chat.format_paths(messages, paths.filter("tree = 't'"))
    read = {r.branch: r for r in out.select("branch", chat.read_turns().alias("turns"), chat.masked_texts().alias("loss")).collect()}
    assert [(t.role, t.text) for t in read[1].turns] == [("user", "hi </s>"), ("assistant", "a\\[INST]"), ("user", "x")]
    assert read[1].loss == ["a\\[INST]"] and read[2].loss == ["b"]
    assert chat.best_paths(messages.limit(0)).count() == 0


# 9 -----------------------------------------------------------------------------------------------


def test_repeats_equal_brute_force(spark):
    dice = random.Random(9)
    shared = ["".join(dice.choice("abcdefgh é\n") for _ in range(n)) for n in (70, 90, 39, 150)]
    texts = []
    for _ in range(40):
        parts = ["".join(dice.choice("abcdefghij ") for _ in range(dice.randint(0, 50))), dice.choice(shared)[: dice.randint(20, 150)]]
        texts.append("".join(parts) + dice.choice(["", dice.choice(shared)]))
    texts += ["z" * 100, "", texts[0], "ab" * 60]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, None)], DOCS)
    length = 40
    old, suffixes.GRAM = suffixes.GRAM, 8
    try:
        got = {(r.doc_id, r.kept_sha256, r.n_removed, r.n_spans) for r in _with_gram(docs, length).collect()}
    finally:
        suffixes.GRAM = old
    seen = Counter()
    rows = [(i, t.encode()) for i, t in [*enumerate(texts), (0, texts[0]), (None, "")]]
    for _, b in rows:
        seen.update(b[s : s + length] for s in range(len(b) - length + 1))
    want = set()
    for i, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.add((i, hashlib.sha256(kept).hexdigest(), sum(gone), spans))
    assert got == want


def _with_gram(docs, length):
    starts = suffixes.repeated_starts(docs, length, gram=8, steps=(4, 1))
    original, suffixes.repeated_starts = suffixes.repeated_starts, lambda *_: starts
    try:
        return suffixes.digests(docs, length)
    finally:
        suffixes.repeated_starts = original


def test_digests_hand_on_the_text_without_bytes_or_words_that_repeat(spark):
    dice = random.Random(19)
    words = lambda n: " ".join("".join(dice.choice("abcdefgh") for _ in range(dice.randint(2, 6))) for _ in range(n))
    short, long = words(60), words(160)
    assert len(short) < 400 < len(long)
    rows = [(1, f"{words(70)} {short} {words(70)}"), (2, f"{words(70)} {short}"), (3, f"{long} {words(9)}"), (4, f"é{long}"), (5, words(90)), (None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    for limit in (None, 51):
        found = {r.doc_id: r for r in suffixes.digests(docs, words=limit).collect()}
        for i, text in rows:
            cut = (text or "").replace(long, "")
            left = cut.replace(short, "") if limit else cut
            assert found[i].text == left
            assert found[i].n_bytes == len((text or "").encode())
            assert found[i].kept_sha256 == hashlib.sha256(cut.encode()).hexdigest() and (found[i].n_removed > 0) == (i in (3, 4))


def test_passages_equal_brute_force(spark):
    dice = random.Random(29)
    shared = [" ".join(dice.choices("abcd", k=n)) for n in (9, 14, 30)]
    texts = []
    for _ in range(60):
        parts = [" ".join(dice.choices("abcdefghij", k=dice.randint(0, 9))), dice.choice(shared), "\n".join(dice.choices("xyz", k=dice.randint(0, 5)))]
        texts.append(dice.choice([" ", "  "]).join(parts))
    texts += [texts[0], "", "a " * 40, "a b " * 15]
    rows = [*enumerate(texts), (0, texts[0]), (None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    spans = {(i, t): [m.span() for m in re.finditer(rb"[^\x09-\x0d\x20]+", (t or "").encode())] for i, t in rows}
    windows = [(i, t, own[k][0], own[k + 7][1]) for i, t in rows for own in [spans[i, t]] for k in range(len(own) - 7)]
    seen = Counter((t or "").encode()[a:b] for _, t, a, b in windows)
    want = {(i, a, b) for i, t, a, b in windows if seen[t.encode()[a:b]] > 1}
    # Whole stretches of windows may come as one run.
    found = set()
    for r in suffixes.passage_starts(docs, 8, length=40, gram=3).collect():
        inside = {(i, a, b) for i, t, a, b in windows if i == r.doc_id and r.first <= a and b <= r.last + 40}
        assert inside
        found |= inside
    assert found == want


def test_kept_text_keeps_whole_characters():
    text = "aé日b"
    assert suffixes.kept_text(text, [(2, 5)]) == "aé日b"
    assert suffixes.kept_text(text, [(1, 6)]) == "ab"
    assert suffixes.kept_text(text, [(1, 3)]) == "a日b"


# 10 ----------------------------------------------------------------------------------------------


def test_pieces_are_lossless_seeded_and_drawn_by_weight(spark, odd_docs):
    own = pieces.lattices(PIECE, 1.0)
    texts = strange(300, 8) + ["▁literal ▁", " ", "a" * 500]
    ids, starts = own.sample(texts, np.arange(len(texts)).astype(np.uint64))
    assert all(own.decode(ids[starts[i] : starts[i + 1]]) == t for i, t in enumerate(texts) if t)
    again, _ = own.sample(texts, np.arange(len(texts)).astype(np.uint64))
    assert np.array_equal(ids, again)
    n = 40_000
    ids, starts = own.sample(["then"] * n, np.arange(n).astype(np.uint64))
    drawn = Counter(tuple(ids[starts[i] : starts[i + 1]].tolist()) for i in range(n))
    first, second = (k for k, _ in drawn.most_common(2))
    weight = lambda k: math.prod(own.weight[list(k)])
    assert math.isclose(drawn[first] / drawn[second], weight(first) / weight(second), rel_tol=0.1)
    rows = pieces.decode(pieces.encode(odd_docs, PIECE), PIECE).collect()
    assert all((r.text or "") == r.decoded for r in rows) and all(r.word == "own" for r in rows)
    assert all(r.lossless for r in pieces.digests(odd_docs, PIECE).collect())


def test_one_long_word_is_counted_in_linear_time():
    import time

    rng = random.Random(2)
    own = token_prefix.counter(BYTE)
    library = Tokenizer.from_file(BYTE)
    for text in ("".join(rng.choice("abcdefgh") for _ in range(20_000)), "ab" * 8_000 + "é" * 3_000):
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    began = time.process_time()
    assert own.count("".join(rng.choice("abcdefgh") for _ in range(1_000_000))) > 200_000
    assert time.process_time() - began < 60


def test_repeated_ids_do_not_push_neighbours_out(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, (x[0] * 3 + 0.001 * j).tolist()) for j in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = forest.nearest(df, F.col("vec_id") == 0, k=20).orderBy("rank").collect()
    scores = {}
    for i, v in rows[1:]:
        scores[i] = max(scores.get(i, -np.inf), float(np.dot(np.array(v, np.float32).astype(float), x[0].astype(float))))
    want = sorted(scores, key=lambda i: (-scores[i], i))[:20]
    assert len(got) == 20 and got[0].vec_id == 500 and len({r.vec_id for r in got} & set(want)) >= 18


def test_packing_keeps_frequent_words_and_whole_results(spark, monkeypatch):
    own = packing.WordIds(WORD)
    monkeypatch.setattr(packing, "MEMO_IDS", 60)
    library = Tokenizer.from_file(WORD)
    rng = random.Random(5)
    for _ in range(30):
        texts = [" ".join(rng.choice(["the", "of", "and", f"w{rng.randrange(500)}x", "ß"]) for _ in range(20)) for _ in range(4)]
        flat, ends = own.ids(texts)
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
    assert {"the", "of", "and"} <= set(own.known)
    docs = spark.createDataFrame([(1, "same words again " * 900)] * 40, DOCS)
    rows = packing.pack(docs, WORD, end_id=1, window=2048).collect()
    assert sum(r.length for r in rows) == 40 * rows[0].doc_tokens

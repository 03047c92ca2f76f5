"""The pipeline's stages on a small folder of tables, and on empty, null and clashing input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankflow.llm import near_copies

PROSE = [
    " ".join("".join(dice.choice("ka lo mi ru te sa on de".split()) for _ in range(dice.randint(1, 4))) for _ in range(80))
    for dice in map(random.Random, range(24))
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    texts = {i: t for i, t in enumerate(PROSE)}
    for i in range(24, 40):
        texts[i] = PROSE[i - 24] + " stupid idiot scum " + " ".join(f"tail{i}{j}" for j in range(30))
    texts[50] = PROSE[3]  # exact copy
    texts[51] = "too short"
    texts[52] = None
    texts[53] = " ".join(f"w{j}$$$" for j in range(90))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(24 <= i < 40)) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path


def test_decisions_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = corpus_pipeline.keep_good(spark, docs, folder).cache()
    assert {r.doc_id for r in good.collect()} == set(range(40)) | {50}
    calm = corpus_pipeline.drop_toxic(spark, good, folder).cache()
    assert {r.doc_id for r in calm.collect()} == set(range(24)) | {50}
    alone = corpus_pipeline.drop_near_copies(spark, calm, folder).cache()
    assert {r.doc_id for r in alone.collect()} == set(range(24))
    assert alone.columns == docs.columns
    cut = corpus_pipeline.cut_repeats(spark, calm, folder)
    left = {r.doc_id: r for r in cut.collect()}
    assert left[3].text == left[50].text == "" and left[3].n_chars == 0
    assert left[0].text == PROSE[0]
    packed = corpus_pipeline.pack_windows(spark, alone, folder)
    assert {r.doc_id for r in packed.collect()} == set(range(24))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_and_odd_input(spark, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    empty = spark.createDataFrame([], SCHEMA)
    assert stage(spark, empty, folder).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", None, "s", 0), (7, "", None, "s", 0)], SCHEMA)
    clashing = odd.withColumns({c: F.lit(1) for c in ("_text", "fp", "failed", "list", "severity", "root", "row", "_text_hash")})
    out = stage(spark, clashing, folder)
    if name != "packing":
        assert out.columns == clashing.columns
    expected = {"quality_rules": 0, "toxicity": 3, "simhash": 1, "suffix_dedup": 3, "packing": 3}
    assert out.count() == expected[name]


def _copies(dice, similarity, words=300):
    """Two texts whose five-word shingles have about that similarity, and their exact one."""
    own = [f"w{dice.randrange(10**6)}" for _ in range(words)]
    other, changed = list(own), 0
    places = dice.sample(range(words), words)
    grams = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    while True:
        trial = list(other)
        trial[places[changed]] = f"n{dice.randrange(10**6)}"
        found = len(grams(own) & grams(trial)) / len(grams(own) | grams(trial))
        if found < similarity:
            break
        other, changed = trial, changed + 1
    return " ".join(own), " ".join(other), len(grams(own) & grams(other)) / len(grams(own) | grams(other))


def test_near_copies_of_similarity_080_to_095_go_and_others_stay(spark, folder):
    dice, rows, far = random.Random(80), [], set()
    for i in range(120):
        goal = (0.8, 0.85, 0.9, 0.95)[i % 4]
        a, b, exact = _copies(dice, goal)
        assert goal <= exact < goal + 0.05
        rows += [(2 * i, a), (2 * i + 1, b)]
    for i in range(120, 140):
        a, b, exact = _copies(dice, 0.7)
        while exact >= 0.8:
            a, b, exact = _copies(dice, 0.7)
        rows += [(2 * i, a), (2 * i + 1, b)]
        far |= {2 * i, 2 * i + 1}
    rows += [(i, " ".join([*rows[0][1].split()[:-1], f"last{i}"])) for i in range(1000, 1200)]  # a large group
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, folder).select("doc_id").collect()}
    assert left == {2 * i for i in range(120)} | far


def test_texts_of_near_fingerprints_go_whatever_their_sets_of_shingles(spark, folder):
    # A passage said 60 times outweighs the tails in a fingerprint, but not among the different shingles.
    common = " ".join([" ".join(f"w{i}" for i in range(21))] * 60)
    texts = {1: f"{common} {PROSE[0][:90]}", 2: f"{common} {PROSE[1][:90]}", 3: PROSE[2], 4: PROSE[3], 5: f"{PROSE[3]} end"}
    assert near_copies.similarity(*(set(near_copies.shingles(texts[i])) for i in (1, 2))) < near_copies.LEAST
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, folder).collect()} == {1, 3, 4}


def test_shared_passages_of_51_words_go_and_of_50_stay(spark, folder):
    dice = random.Random(51)
    words = lambda n: " ".join("".join(dice.choice("abcdefgh") for _ in range(dice.randint(2, 6))) for _ in range(n))
    parts = [words(100) for _ in range(8)]
    long, short, tiny = words(51), words(50), " ".join(dice.choice("abcdefgh") for _ in range(51))
    assert len(long) < 400 and len(tiny) == 101
    middle = [long, long, short, short, tiny, tiny]
    rows = [(i, f"{parts[i]}\n{m} {words(100)}") for i, m in enumerate(middle)]
    rows.append((6, " ".join(["again"] * 60) + " end"))  # overlapping repeats inside one text
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    left = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, folder).collect()}
    for i, t in rows[:6]:
        assert left[i] == (t if i in (2, 3) else t.replace(middle[i], ""))
    assert left[6] == " end"


def test_near_copies_are_the_components_of_all_pairs_that_meet(spark, monkeypatch):
    """Several large buckets of texts at every similarity, by pairs, by blocks, and without rounds."""
    from rankflow.llm import near_copies as nc

    rng = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(170):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(120)] = f"x{i}-{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [None, "", "one two", "one two", texts[3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    node, _, keys = nc.bands_of([t or "" for t in texts])
    sets, root = [set(nc.shingles(t or "")) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if node[i] == node[j] or ((keys[i] == keys[j]).any() and nc.similarity(sets[i], sets[j]) >= nc.LEAST):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), set()).add(i)
    want = sorted(map(sorted, groups.values()))
    for limits in ({}, {"SMALL": 2, "BLOCK": 5, "COLUMNS": 7, "ROUNDS": 0}, {"SMALL": 10**6, "LANDMARKS": 1}, {"SMALL": 0, "BLOCK": 16}):
        for name in ("SMALL", "BLOCK", "COLUMNS", "ROUNDS", "LANDMARKS"):
            monkeypatch.setattr(nc, name, limits.get(name, {"SMALL": 32, "BLOCK": 256, "COLUMNS": 1 << 13, "ROUNDS": 6, "LANDMARKS": 8}[name]))
        got = {}
        for r in nc.near_copies(docs).collect():
            got.setdefault(r.root, set()).add(r.doc_id)
        assert sorted(map(sorted, got.values())) == want

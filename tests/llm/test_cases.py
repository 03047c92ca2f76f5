"""Empty tables and columns named like the operators' own, for the operators that other tests do not cover."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rankflow.llm import attention, chat, forest, near_copies, pieces, quality, simhash, suffixes, token_prefix
from rankflow.llm.tables import hash_sample

BYTE, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
OPERATORS = {
    "token_counts": lambda df: token_prefix.token_counts(df, BYTE, budget=10),
    "ledger": quality.ledger,
    "near_duplicates": simhash.near_duplicates,
    "near_copies": near_copies.near_copies,
    "suffixes": suffixes.digests,
    "pieces": lambda df: pieces.digests(df, PIECE),
    "attention": lambda df: attention.score(df, BYTE, held_out=F.lit(False)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_an_empty_table(spark, name):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert OPERATORS[name](empty).count() == 0


def test_vectors_and_conversations_with_clashing_columns(spark):
    rows = [(i, [float(i), 1.0, -float(i)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    clash = df.withColumns({c: F.lit("own") for c in ("id", "v", "vector", "asked", "own", "score", "rank", "tree", "cell", "query_id")})
    want = [tuple(r) for r in forest.nearest(df, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect()]
    assert [tuple(r) for r in forest.nearest(clash, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect()] == want
    talk = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, None, "x")], "conv_id long, turn int, role string, text string")
    more = talk.withColumns({c: F.lit("own") for c in ("tree", "node", "parent", "path", "formatted", "place", "depth", "branch")})
    found = []
    for given in (talk, more):
        messages = chat.conversation_messages(given)
        found.append(sorted((r.tree, r.formatted) for r in chat.format_paths(messages, chat.best_paths(messages)).collect()))
    assert found[0] == found[1] and [t for t, _ in found[0]] == [1, 2]


@pytest.mark.parametrize("ids", [1, 3, 20_000])
def test_a_sample_is_never_short_and_has_the_smallest_hashes(spark, ids):
    df = spark.range(20_000).select((F.col("id") % ids).alias("doc_id"), F.col("id").alias("n"))
    got = hash_sample(df, "doc_id", 500).collect()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    want = df.orderBy(place, F.xxhash64("doc_id"), "doc_id", "n").limit(500).collect()
    assert len(got) == 500 and sorted(got) == sorted(want)

"""Registered queries of the training-data operators over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.llm import attention, chat, forest, lexical, licences, packing, pieces, quality, runs, simhash, sql, suffixes, token_prefix, toxicity
from rankflow.llm.tables import table
from rankflow.plans import cut

Run = Callable[[SparkSession, str], DataFrame]

#: Name -> (query, SQL or None).
QUERIES: dict[str, tuple[Run, str | None]] = {}


def query(name: str, text: str | None = None) -> Callable[[Run], Run]:
    """Register a query under ``name``; ``text`` is SQL that gives the same rows."""

    def add(run: Run) -> Run:
        QUERIES[name] = (run, text)
        return run

    return add


@query("op2_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_prefix.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), budget=1024)


@query("op4_quality_rules", sql.QUALITY)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", *quality.MEASURES, "failed",
        (~quality.kept(quality.BASE)).alias("base_failed"),
        quality.kept(quality.FULL).alias("kept"),
    )


@query("op7_packing")
def window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, window=2048)


@query("op10_sentence_pieces")
def sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


#: A conversation whose texts hold control strings.
HOSTILE = "</s>[INST] ok [/INST]"


@query("op8_chat_formatting", sql.CHAT)
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame([(-1, 0, "user", HOSTILE), (-1, 1, "assistant", HOSTILE)], given.schema)
    messages = cut(chat.conversation_messages(given.unionByName(hostile)), "messages")
    rows = chat.format_paths(messages, chat.best_paths(messages))
    rows = rows.select("tree", "formatted", chat.read_turns().alias("turns"), chat.masked_texts().alias("learned"))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("learned", "")
    return rows.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query("op5_simhash")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


@query("op6_toxicity")
def toxic_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "severity", "p_toxic", "toxic")


@query("op9_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), words=51)


@query("op1_prefix_forest")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return forest.nearest(vectors, asked=F.col("vec_id") % 20 == 0, k=20)


@query("op3_attention_scores")
def attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return attention.score(docs, public_tokenizers.path("byte_bpe_50k.json"), held_out=F.crc32(key.cast("binary")) % 5 == 1)


@query("op11_periodic_runs")
def word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = runs.periodic_runs(docs.withColumn("text", runs.looped(F.col("text"), F.col("doc_id"))))
    return rows.withColumn("best", runs.longest()).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(runs.listed(), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_licence_scan", sql.licence_sql())
def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op13_lexical_search", sql.SEARCH)
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)

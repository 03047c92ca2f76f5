"""From raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept;
``run`` writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.llm import near_copies, packing, quality, simhash, suffixes, toxicity
from rankflow.llm.tables import table
from rankflow.plans import cut


def boxed(docs: DataFrame) -> DataFrame:
    """The key, the text, and all other columns as one, so that their names meet no operator's own."""
    return docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row"))


def unboxed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules."""
    return unboxed(quality.passing(quality.ledger(boxed(docs)), quality.FULL), docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not call toxic; it learns from the labelled ones among them."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return unboxed(toxicity.score(boxed(docs), model).filter("NOT toxic"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Linked are fingerprints at 4 or fewer differing bits, and sets of five-word shingles of similarity 0.8 or more.
    """
    rows = boxed(docs)
    return unboxed(near_copies.one_of_each(rows, groups=simhash.near_duplicates(rows)), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of over 50 words, or of 400 bytes or more, that are found elsewhere too."""
    return suffixes.without_repeats(docs, words=51).withColumn("n_chars", F.length("text").cast("bigint"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens as pieces of windows of 2048."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, window=2048)


STAGES = [
    ("quality_rules", keep_good),
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_windows),
]

#: A fitted model, hashes and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

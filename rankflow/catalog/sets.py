"""Sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.catalog.registry import cents, query, sql_div, table
from rankflow.functions.ratios import hundredths, micros
from rankflow.operators import placement, profiles
from rankflow.operators.experiments import union_results


@query(
    "top_symbols",
    """SELECT p_brand, count(*) AS n, CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT) AS price
       FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10""",
)
def top_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.sum(hundredths("p_retailprice")).alias("price")
    )
    return counts.orderBy(F.desc("n"), "p_brand").limit(10)


@query(
    "sorted_placement",
    f"""SELECT {sql_div("s_suppkey", 16)} AS process, s_suppkey AS rank, s_name FROM supplier ORDER BY 1, 2""",
)
def sorted_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(
        placement.block_process(F.col("s_suppkey"), 16).alias("process"), F.col("s_suppkey").alias("rank"), "s_name"
    )
    return rows.orderBy("process", "rank")


@query(
    "latest_label",
    "SELECT o_orderstatus, max(strftime(o_orderdate, '%Y-%m-%d')) AS latest FROM orders GROUP BY 1",
)
def latest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The date is formatted after the aggregate: a text maximum would need a sort instead of a hash table.
    latest = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.max("o_orderdate").alias("at"))
    return latest.select("o_orderstatus", F.date_format("at", "yyyy-MM-dd").alias("latest"))


@query(
    "union_tables",
    f"""SELECT 'customer' AS role, c_name AS name, {cents("c_acctbal")} AS balance, c_mktsegment AS segment FROM customer
        UNION ALL SELECT 'supplier', s_name, {cents("s_acctbal")}, NULL FROM supplier""",
)
def union_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("role"), F.col("c_name").alias("name"), hundredths("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.lit("supplier").alias("role"), F.col("s_name").alias("name"), hundredths("s_acctbal").alias("balance")
    )
    return union_results([customers, suppliers])


@query(
    "known_symbols",
    """SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)
       AND n_nationkey IN (SELECT s_nationkey FROM supplier)""",
)
def known_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    both = customers.distinct().intersect(suppliers.distinct())
    return table(spark, sf_dir, "nation").join(both, "n_nationkey", "left_semi").select("n_name")


@query(
    "unknown_symbols",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)",
)
def unknown_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey")).distinct()
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(known, "c_custkey", "left_anti")


@query("distinct_texts", "SELECT DISTINCT md5(text) AS digest, lang FROM documents")
def distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("digest"), "lang").distinct()


@query(
    "placement_check",
    f"""WITH n AS (SELECT count(*) AS n FROM customer),
        r AS (SELECT CASE WHEN c_custkey % 50 = 7 THEN c_custkey + n ELSE c_custkey - c_custkey % 2 END AS rank,
          CASE c_custkey % 90 WHEN 11 THEN -1 WHEN 13 THEN {sql_div("c_custkey", 64)} - 1 ELSE {sql_div("c_custkey", 64)} END AS process,
          c_custkey AS position FROM customer, n),
        b AS (SELECT *, lag(process) OVER (ORDER BY position) AS before FROM r)
        SELECT count(*) AS n_ranks, count(*) FILTER (rank NOT BETWEEN 0 AND (SELECT n FROM n) - 1) AS n_foreign,
        count(*) FILTER (process NOT BETWEEN 0 AND (SELECT (n + 63) // 64 - 1 FROM n)) AS n_bad_process,
        count(*) FILTER (process < before) AS n_steps_back,
        (SELECT n FROM n) - count(DISTINCT rank) FILTER (rank BETWEEN 0 AND (SELECT n FROM n) - 1) AS n_missing,
        (SELECT count(*) FROM (SELECT rank FROM r GROUP BY rank HAVING count(*) > 1)) AS n_repeated FROM b""",
)
def placement_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every odd rank is replaced by the even one below it, some by foreign ones, and some processes are wrong."""
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    total = customers.count()
    key, process = F.col("c_custkey"), placement.block_process(F.col("c_custkey"), 64)
    ranks = customers.select(
        F.when(key % 50 == 7, key + total).otherwise(key - key % 2).alias("rank"),
        F.when(key % 90 == 11, -1).when(key % 90 == 13, process - 1).otherwise(process).alias("process"),
        key.alias("position"),
    )
    return placement.check_placement(ranks, "rank", "process", "position", total, -(-total // 64))


@query("files_missing_line", "SELECT page_id FROM pages WHERE NOT regexp_matches(html, '<article>')")
def files_missing_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return profiles.files_missing_line(pages, ["page_id"], "html", "<article>")


@query(
    "event_stamps",
    "SELECT user_id, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events GROUP BY user_id",
)
def event_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min(micros("ts")).alias("first_us"), F.max(micros("ts")).alias("last_us")
    )

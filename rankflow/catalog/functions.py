"""Scalar and shape functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.catalog.registry import cents, query, sql_div, table
from rankflow.functions.chunks import aligned_length, chunk_bounds, chunk_length, slice_of
from rankflow.functions.labels import config_label, numbered, runtime_key
from rankflow.functions.ranges import check_unique, expand_hosts, expand_ranges, range_counts
from rankflow.functions.ratios import clock, hundredths, leading_digits, percent
from rankflow.operators.tasks import with_chunks
from rankflow.sources.stats import custom_timers_long


@query(
    "percentages",
    f"""SELECT o_orderstatus, 100.0::DOUBLE * sum(CASE WHEN o_orderpriority = '1-URGENT' THEN {cents("o_totalprice")} ELSE 0 END)::DOUBLE
        / nullif(sum({cents("o_totalprice")}), 0)::DOUBLE AS urgent_percent FROM orders GROUP BY 1""",
)
def percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = hundredths("o_totalprice")
    urgent = F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", price).otherwise(0))
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(percent(urgent, F.sum(price)).alias("urgent_percent"))


@query(
    "cycle_clock",
    f"""WITH m AS (SELECT event_id, CAST(floor({cents("value")} * 100000 / CAST(2300.0 AS DOUBLE)) AS BIGINT) AS ms FROM events)
        SELECT event_id, printf('%02d:%02d:%02d:%03d', ms // 3600000 % 24, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS clock
        FROM m""",
)
def cycle_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", clock(hundredths("value") * 100000, 2.3).alias("clock"))


SQL_TOTAL = "(SELECT count(*) AS total FROM events)"


@query(
    "chunk_ranges",
    f"""SELECT least(event_id // (total // 7), 6) AS chunk_id, count(*) AS n, min(event_id) AS min_idx, max(event_id) AS max_idx
        FROM events, {SQL_TOTAL} GROUP BY 1""",
)
def chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id")
    total = events.agg(F.count(F.lit(1))).scalar()
    rows = with_chunks(events, "event_id", total, 7).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    bounds = chunk_bounds(F.col("chunk_id"), chunk_length(total, 7), total, 7)
    return rows.select("chunk_id", "n", bounds["min_idx"].alias("min_idx"), bounds["max_idx"].alias("max_idx"))


@query(
    "aligned_chunk_ranges",
    f"""SELECT least(event_id // (total // 8 // 7 * 8), 6) AS chunk_id, count(*) AS n, min(event_id) AS min_idx,
        max(event_id) AS max_idx FROM events, {SQL_TOTAL} GROUP BY 1""",
)
def aligned_chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id")
    total = events.agg(F.count(F.lit(1))).scalar()
    rows = with_chunks(events, "event_id", total, 7, element_bytes=8).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    bounds = chunk_bounds(F.col("chunk_id"), aligned_length(total, 7, 8), total, 7)
    return rows.select("chunk_id", "n", bounds["min_idx"].alias("min_idx"), bounds["max_idx"].alias("max_idx"))


@query(
    "reduce_slices",
    f"""WITH l AS (SELECT total, (total * 4 + 63) // 64 AS lines FROM {SQL_TOTAL}),
        p AS (SELECT lines, greatest(lines // 12, 1) AS per, least(lines, 12) AS active FROM l)
        SELECT least(event_id * 4 // (per * 64), active - 1) AS owner_rank, count(*) AS n, min(event_id) AS min_idx,
        max(event_id) AS max_idx FROM events, p GROUP BY 1""",
)
def reduce_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id")
    total = events.agg(F.count(F.lit(1))).scalar()
    return events.groupBy(slice_of(F.col("event_id"), total, 12, 4).alias("owner_rank")).agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("min_idx"), F.max("event_id").alias("max_idx")
    )


@query(
    "config_labels",
    """SELECT o_orderkey, concat_ws('-', CASE WHEN o_orderstatus = 'F' THEN 'asm' END,
       'chk-' || lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(6, length(CAST(o_custkey AS VARCHAR))) AS INT), '0'),
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END) AS label FROM orders""",
)
def config_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = config_label(
        F.when(F.col("o_orderstatus") == "F", "asm-"),
        numbered("chk", F.col("o_custkey"), 6),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", None).otherwise(F.col("o_orderpriority")),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"))


@query(
    "runtime_keys",
    """SELECT concat_ws('-', o_orderstatus, 'p' || (o_custkey % 4) || 't' || (o_custkey % 3),
       CASE WHEN o_custkey % 5 <> 0 THEN 'pcv46' END,
       CASE WHEN o_custkey % 5 <> 0 AND o_custkey % 7 <> 0 THEN 'qs' || lpad(CAST(o_custkey % 7 AS VARCHAR), 4, '0') END,
       o_orderpriority) AS runtime_key, count(*) AS n FROM orders GROUP BY 1""",
)
def runtime_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_custkey")
    label = runtime_key(
        F.col("o_orderstatus"), key % 4, key % 3, F.when(key % 5 != 0, F.lit(46)), F.when(key % 7 != 0, key % 7),
        F.col("o_orderpriority"),
    )
    return table(spark, sf_dir, "orders").groupBy(label.alias("runtime_key")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "custom_timers",
    f"""SELECT o_orderkey, CAST(0 AS INT) AS timer_index, 'price' AS timer_name, {cents("o_totalprice")} AS elapsed FROM orders
        UNION ALL SELECT o_orderkey, 1, 'customer', o_custkey FROM orders
        UNION ALL SELECT o_orderkey, 3, o_orderstatus, o_orderkey FROM orders""",
)
def custom_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.lit("price").alias("custom0_timer_name"), hundredths("o_totalprice").alias("custom0_elapsed_cycles"),
        F.lit("customer").alias("custom1_timer_name"), F.col("o_custkey").alias("custom1_elapsed_cycles"),
        F.lit(None).cast("string").alias("custom2_timer_name"), F.lit(None).cast("bigint").alias("custom2_elapsed_cycles"),
        F.col("o_orderstatus").alias("custom3_timer_name"), F.col("o_orderkey").alias("custom3_elapsed_cycles"),
    )
    return custom_timers_long(wide, ["o_orderkey"])


@query(
    "leading_digits",
    f"""SELECT CAST(substr(CAST({cents("o_totalprice")} AS VARCHAR), 1, 1) AS INT) AS first_digit,
        CAST(substr(CAST({cents("o_totalprice")} AS VARCHAR), 1, 2) AS INT) AS first_two, count(*) AS n FROM orders GROUP BY 1, 2""",
)
def leading_digits_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = hundredths("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy(
        leading_digits(price, 1).alias("first_digit"), leading_digits(price, 2).alias("first_two")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "expand_ranges",
    f"""SELECT s_suppkey, count(*) AS n, CAST(sum({cents("c_acctbal")}) AS BIGINT) AS balance FROM supplier JOIN customer
        ON c_custkey BETWEEN s_suppkey * 10 AND s_suppkey * 10 + 3 OR c_custkey BETWEEN s_suppkey * 10 + 6 AND s_suppkey * 10 + 8
        GROUP BY 1""",
)
def expand_ranges_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("s_suppkey") * 10
    spec = F.concat_ws(",", F.concat_ws("-", low, low + 3), F.concat_ws("-", low + 6, low + 8))
    ranks = expand_ranges(table(spark, sf_dir, "supplier").select("s_suppkey", spec.alias("spec")), "spec", "c_custkey")
    return ranks.join(table(spark, sf_dir, "customer"), "c_custkey").groupBy("s_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(hundredths("c_acctbal")).alias("balance")
    )


@query(
    "expand_hosts",
    f"""SELECT s_suppkey, 'node' || lpad(CAST(i AS VARCHAR), 2, '0') AS host
        FROM (SELECT s_suppkey, unnest(generate_series(s_nationkey, s_nationkey + 2)) AS i FROM supplier)""",
)
def expand_hosts_query(spark: SparkSession, sf_dir: str) -> DataFrame:

    def two(c):
        return F.lpad(c.cast("string"), 2, "0")

    node = F.col("s_nationkey")
    spec = F.concat(F.lit("node["), two(node), F.lit("-"), two(node + 2), F.lit("]"))
    return expand_hosts(table(spark, sf_dir, "supplier").select("s_suppkey", spec.alias("spec")), "spec", "host")


@query("unique_ranks", f"SELECT {sql_div('count(*)', 1)} AS n_unique FROM customer")
def unique_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_unique(table(spark, sf_dir, "customer"), ["c_custkey"])


SQL_LO = "CAST(s_suppkey * 1000000 AS BIGINT)"
SQL_LENGTH = "CAST(1000000000 + s_suppkey % 7 * 300000000 AS BIGINT)"


@query(
    "range_counts",
    f"""WITH r AS (SELECT s_nationkey, s_suppkey, {SQL_LO} AS lo, {SQL_LO} + {SQL_LENGTH} - 1 AS hi FROM supplier
          UNION ALL SELECT s_nationkey, s_suppkey, s_suppkey, s_suppkey FROM supplier),
        s AS (SELECT *, max(hi) OVER (PARTITION BY s_nationkey ORDER BY lo, hi, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
          AS reached FROM r)
        SELECT s_nationkey, CAST(sum(hi - lo + 1) AS BIGINT) AS n_members,
          CAST(sum(hi - lo + 1 - greatest(least(hi, coalesce(reached, lo - 1)) - lo + 1, 0)) AS BIGINT) AS n_distinct,
          CAST(sum(greatest(least(hi, coalesce(reached, lo - 1)) - lo + 1, 0)) AS BIGINT) AS n_repeated FROM s GROUP BY 1""",
)
def range_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps among ranges of a thousand million members and more."""
    low = F.col("s_suppkey").cast("bigint") * 1000000
    high = low + 1000000000 + F.col("s_suppkey") % 7 * 300000000 - 1
    spec = F.concat_ws(",", F.concat_ws("-", low, high), F.col("s_suppkey").cast("string"))
    counts = range_counts(table(spark, sf_dir, "supplier").select("s_nationkey", spec.alias("spec")), "spec", ["s_nationkey"])
    return counts.select("s_nationkey", *[F.col(c).cast("bigint").alias(c) for c in ("n_members", "n_distinct", "n_repeated")])

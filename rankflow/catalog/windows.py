"""Scans, splits, stencils, sequence numbers, placements, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.catalog.registry import cents, query, table
from rankflow.functions.ratios import hundredths, micros
from rankflow.operators import placement, profiles, timers
from rankflow.operators.collectives import split, to_elements
from rankflow.operators.experiments import newest
from rankflow.operators.scans import scan_exclusive, scan_inclusive
from rankflow.operators.stencil import stencil_arrays, stencil_rows
from rankflow.operators.traces import counter_delta
from rankflow.plans import new_path, previous_value, row_number, running_sum
from rankflow.sources.logs import read_long_lines

SQL_PRICE = cents("o_totalprice")


def order_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", hundredths("o_totalprice").alias("value"))


@query(
    "scan_inclusive",
    f"SELECT o_orderkey, CAST(sum({SQL_PRICE}) OVER (ORDER BY o_orderkey) AS BIGINT) AS prefix FROM orders",
)
def scan_inclusive_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_inclusive(order_values(spark, sf_dir), "o_orderkey", {"prefix": "value"}).drop("value")


@query(
    "scan_exclusive",
    f"""SELECT o_orderkey, CAST(coalesce(sum({SQL_PRICE}) OVER (ORDER BY o_orderkey
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix FROM orders""",
)
def scan_exclusive_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_exclusive(order_values(spark, sf_dir), "o_orderkey", {"prefix": "value"}).drop("value")


@query(
    "scan_elementwise",
    """SELECT label, vec_id, idx, round(sum(v) OVER (PARTITION BY label, idx ORDER BY vec_id), 6) AS prefix
       FROM (SELECT label, vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS idx,
             CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)""",
)
def scan_elementwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = to_elements(table(spark, sf_dir, "embeddings"), ["label", "vec_id"], "embedding")
    out = scan_inclusive(rows, "vec_id", {"prefix": "value"}, ["label", "idx"])
    return out.select("label", "vec_id", "idx", F.round("prefix", 6).alias("prefix"))


@query(
    "split_renumber",
    """SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS new_rank
       FROM customer""",
)
def split_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey")


@query(
    "split_by_key",
    """SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey
       ORDER BY CAST(round(c_acctbal * 100) AS BIGINT), c_custkey) - 1 AS new_rank FROM customer""",
)
def split_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", hundredths("c_acctbal").alias("key"))
    return split(ranks, "c_nationkey", "c_custkey", key="key", honor_key=True).drop("key")


def sql_stencil(source: str, position: str, keep: str, iterations: int) -> str:
    """Repeated three-point averages over ``(position, a)``; the work of a step is ``a * 0.5 + 1``."""
    steps = [f"s0 AS ({source})"]
    for i in range(iterations):
        w = f"OVER (ORDER BY {position})"
        steps.append(
            f"t{i} AS (SELECT *, a * 0.5::DOUBLE + 1 AS t FROM s{i}), n{i} AS (SELECT *, lag(t) {w} AS lo, lead(t) {w} AS hi FROM t{i}), "
            f"s{i + 1} AS (SELECT {keep}, {position}, "
            "CASE WHEN lo IS NULL OR hi IS NULL THEN a ELSE (lo + t + hi) / 3.0::DOUBLE END AS a "
            f"FROM n{i})"
        )
    return "WITH " + ", ".join(steps)


def work(value):
    return value * 0.5 + 1


@query(
    "halo_stencil",
    sql_stencil("SELECT event_id, event_id AS position, value AS a FROM events", "position", "event_id", 4)
    + " SELECT event_id, round(a, 9) AS value FROM s4",
)
def halo_stencil(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "events").select("event_id", "value")
    out = stencil_rows(line, "event_id", "value", 4, work=work, bits=12)
    return out.select("event_id", F.round("value", 9).alias("value"))


@query(
    "array_stencil",
    sql_stencil(
        """SELECT vec_id, vec_id * 64 + generate_subscripts(embedding, 1) - 1 AS position,
           CAST(unnest(embedding) AS DOUBLE) AS a FROM embeddings""",
        "position",
        "vec_id",
        3,
    )
    + " SELECT vec_id, CAST(position % 64 AS INT) AS idx, round(a, 9) AS value FROM s3",
)
def array_stencil(spark: SparkSession, sf_dir: str) -> DataFrame:
    buffers = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = stencil_arrays(buffers, "vec_id", "embedding", 3, work=work)
    return to_elements(out, ["vec_id"], "embedding").withColumn("value", F.round("value", 9))


@query(
    "sequence_numbers",
    """SELECT event_id, user_id, event_type,
       row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS sequence_number,
       count(*) OVER (PARTITION BY user_id, event_type) AS total_num FROM events""",
)
def sequence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return timers.sequence(rows, ["user_id", "event_type"], ["event_id"])


@query(
    "sections",
    """SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 8 AS section
       FROM events""",
)
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    return profiles.sections(rows, ["user_id"], ["event_id"], 8)


@query(
    "newest_files",
    """SELECT o_custkey, o_orderkey, place FROM (SELECT *, row_number() OVER
       (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders) WHERE place <= 3""",
)
def newest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", micros("o_orderdate").alias("stamp"))
    return newest(rows, ["o_custkey"], "stamp", "o_orderkey", 3).select("o_custkey", "o_orderkey", "place")


@query(
    "node_slots",
    """SELECT c_custkey, (row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1) % 32 AS slot FROM customer""",
)
def node_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return placement.node_slots(ranks, ["c_nationkey", "c_custkey"], 32).select("c_custkey", "slot")


@query(
    "placement_round_robin",
    """WITH n AS (SELECT 8 * (((SELECT count(*) FROM customer) + 7) // 8) AS total)
       SELECT c_custkey, c_custkey % 4 AS node, (c_custkey % 4) * 2 + least((c_custkey // 4) // (total // 8), 1) AS process
       FROM customer, n""",
)
def placement_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = table(spark, sf_dir, "customer").select("c_custkey")
    # Two tasks per node need an even number of ranks on each of the four nodes.
    total = -(-ranks.count() // 8) * 8
    return placement.round_robin(ranks, "c_custkey", total, 4, 2)


@query(
    "placement_grid",
    """SELECT CAST(c_nationkey AS BIGINT) AS node, place AS position, c_custkey AS rank,
       CAST(c_nationkey AS BIGINT) * 2 + CASE WHEN place >= ceil(n / 2.0) THEN 1 ELSE 0 END AS process
       FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place,
             count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)""",
)
def placement_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = split(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey")
    grid = ranks.select(
        F.col("c_nationkey").cast("bigint").alias("node"), F.col("new_rank").alias("position"), F.col("c_custkey").alias("rank")
    )
    return placement.grid_process(grid, 2)


@query(
    "counter_delta",
    """SELECT event_id, CASE WHEN k >= p THEN k - p ELSE k + 128 - p END AS delta
       FROM (SELECT event_id, k, lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS p
             FROM (SELECT event_id, user_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events))""",
)
def counter_delta_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("k")
    )
    before = previous_value(rows, ["user_id"], ["event_id"], {"p": "k"})
    return before.select("event_id", counter_delta(F.col("k"), F.col("p"), 7).alias("delta"))


@query(
    "interval_order",
    """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS place
       FROM events""",
)
def interval_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", micros("ts").alias("start"))
    return timers.order_intervals(rows, "user_id", "start", "event_id").select("event_id", "user_id", "place")


# Every seventh event has no key.
SQL_NULL_KEYS = "SELECT event_id, user_id, nullif(event_id % 7, 3) AS k, CAST(round(value * 100) AS BIGINT) AS v FROM events"
SQL_NULLS_FIRST = "ORDER BY k NULLS FIRST, event_id"


def null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.nullif(F.col("event_id") % 7, F.lit(3)).alias("k"), hundredths("value").alias("v"))


@query(
    "null_keys_table",
    f"""SELECT event_id, row_number() OVER w AS place, CAST(sum(v) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS prefix,
        lag(event_id) OVER w AS before FROM ({SQL_NULL_KEYS}) WINDOW w AS ({SQL_NULLS_FIRST})""",
)
def null_keys_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbering, prefix sums and previous values over the whole table, some keys null."""
    out = row_number(null_keys(spark, sf_dir), [], ["k", "event_id"], "place")
    out = running_sum(out, [], ["k", "event_id"], {"prefix": "v"})
    return previous_value(out, [], ["k", "event_id"], {"before": "event_id"}).select("event_id", "place", "prefix", "before")


@query(
    "null_keys_groups",
    f"""SELECT event_id, row_number() OVER w AS place, CAST(sum(v) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS prefix,
        lag(event_id) OVER w AS before FROM ({SQL_NULL_KEYS}) WINDOW w AS (PARTITION BY user_id {SQL_NULLS_FIRST})""",
)
def null_keys_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by user, groups of more than 20 rows being split."""
    few = {"group_rows": 20}
    out = row_number(null_keys(spark, sf_dir), ["user_id"], ["k", "event_id"], "place", **few)
    out = running_sum(out, ["user_id"], ["k", "event_id"], {"prefix": "v"}, **few)
    out = previous_value(out, ["user_id"], ["k", "event_id"], {"before": "event_id"}, **few)
    return out.select("event_id", "place", "prefix", "before")


@query(
    "newest_many",
    """SELECT event_type, event_id, place FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type
       ORDER BY nullif(event_id // 3, 5) DESC NULLS LAST, event_id DESC) AS place FROM events) WHERE place <= 1001""",
)
def newest_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = table(spark, sf_dir, "events").select(
        "event_type", "event_id", F.nullif(F.expr("event_id div 3"), F.lit(5).cast("bigint")).alias("stamp"))
    return newest(stamped, ["event_type"], "stamp", "event_id", 1001, group_rows=500).select("event_type", "event_id", "place")


@query(
    "intervals_in_order",
    """SELECT user_id, event_id, row_number() OVER (ORDER BY user_id, epoch_us(ts), event_id) - 1 AS place FROM events""",
)
def intervals_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by ranges of (rank, start): the files one after another are in order, and so are the lines in each."""
    path = new_path(spark, "ordered")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", micros("ts").alias("start"))
    # The id decides between equal starts.
    placed = timers.written_in_order(rows.withColumn("start", F.struct("start", "event_id")), "user_id", "start", 4)
    placed.select(F.concat_ws(" ", "user_id", "event_id")).write.text(path)
    part = F.regexp_extract("file", "part-([0-9]+)", 1).cast("bigint")
    lines = read_long_lines(spark, path).select(part.alias("part"), "line_no", F.split("line", " ").alias("ids"))
    numbered = row_number(lines, [], ["part", "line_no"], "place", start=0)
    return numbered.select(F.get("ids", F.lit(0)).cast("bigint").alias("user_id"), F.get("ids", F.lit(1)).cast("bigint").alias("event_id"), "place")

"""Message matching, neighbour exchange, all-to-all, broadcast, lookups, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.catalog.registry import cents, query, table
from rankflow.functions.ratios import hundredths
from rankflow.operators.collectives import all_to_all, broadcast_lowest, split, to_elements, translate
from rankflow.operators.experiments import chunked_channel, parameter_grid, star, with_common_values
from rankflow.operators.stencil import neighbours
from rankflow.operators.traces import match_messages, unmatched_endpoints
from rankflow.plans import cut, row_number


SENDS = ("click", "view", "signup")
SQL_SENDS = f"event_type IN {SENDS}"


def sides(spark: SparkSession, sf_dir: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Every event has a side: clicks, views and signups are sends, purchases and errors receives."""
    events = table(spark, sf_dir, "events").select("event_id", *columns, F.col("event_type").isin(*SENDS).alias("_send"))
    return events.filter("_send").drop("_send"), events.filter("NOT _send").drop("_send")


@query(
    "message_match",
    f"""WITH n AS (SELECT user_id, {SQL_SENDS} AS send, event_id,
                  row_number() OVER (PARTITION BY user_id, {SQL_SENDS} ORDER BY event_id) AS seq FROM events),
        s AS (SELECT * FROM n WHERE send), r AS (SELECT * FROM n WHERE NOT send)
       SELECT coalesce(s.user_id, r.user_id) AS user_id, coalesce(s.seq, r.seq) AS seq,
       s.event_id AS send_event_id, r.event_id AS recv_event_id,
       CASE WHEN r.event_id IS NULL THEN 'no_recv' WHEN s.event_id IS NULL THEN 'no_send' ELSE 'matched' END AS state
       FROM s FULL OUTER JOIN r ON s.user_id = r.user_id AND s.seq = r.seq""",
)
def message_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    sends, recvs = sides(spark, sf_dir, ["user_id"])
    return match_messages(sends, recvs, ["user_id"], ["event_id"], ["event_id"])


SQL_CHANNEL = "user_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS tag"


@query(
    "unmatched_endpoints",
    f"""WITH s AS (SELECT {SQL_CHANNEL}, count(*) AS n_messages FROM events WHERE {SQL_SENDS} GROUP BY 1, 2),
        r AS (SELECT {SQL_CHANNEL}, count(*) AS n_messages FROM events WHERE NOT {SQL_SENDS} GROUP BY 1, 2)
       SELECT *, 'send' AS side FROM s WHERE (user_id, tag) NOT IN (SELECT (user_id, tag) FROM r)
       UNION ALL SELECT *, 'recv' AS side FROM r WHERE (user_id, tag) NOT IN (SELECT (user_id, tag) FROM s)""",
)
def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = [
        df.select("user_id", F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("tag"))
        for df in sides(spark, sf_dir, ["user_id", "props"])
    ]
    return unmatched_endpoints(*tagged, ["user_id", "tag"])


@query(
    "halo_exchange",
    """SELECT vec_id, CAST(lag(embedding[64]) OVER (ORDER BY vec_id) AS DOUBLE) AS low,
       CAST(lead(embedding[1]) OVER (ORDER BY vec_id) AS DOUBLE) AS high FROM embeddings""",
)
def halo_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.get("embedding", F.lit(0)).alias("first"), F.element_at("embedding", -1).alias("last")
    )
    out = neighbours(ends, "vec_id", [], {"low": F.col("last")}, {"high": F.col("first")})
    return out.select("vec_id", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))


@query(
    "halo_rows",
    """SELECT event_id, lag(value) OVER (ORDER BY event_id) AS low, lead(value) OVER (ORDER BY event_id) AS high
       FROM events""",
)
def halo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "events").select("event_id", "value")
    out = neighbours(line, "event_id", [], {"low": F.col("value")}, {"high": F.col("value")}, bits=12)
    return out.select("event_id", "low", "high")


@query(
    "all_to_all",
    """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS v FROM embeddings)
       SELECT vec_id // 4 AS comm, i // 16 AS rank, (vec_id % 4) * 16 + i % 16 AS idx, CAST(v AS DOUBLE) AS value FROM e""",
)
def all_to_all_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = to_elements(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding")
    ranks = rows.select(F.expr("vec_id div 4").alias("comm"), (F.col("vec_id") % 4).alias("rank"), "idx", "value")
    return all_to_all(ranks, 16)


@query(
    "bcast_root",
    """SELECT c.c_custkey, c.c_nationkey, r.c_custkey AS root_c_custkey, r.c_acctbal AS root_c_acctbal
       FROM customer c JOIN (SELECT arg_min(c_acctbal, c_custkey) AS c_acctbal, min(c_custkey) AS c_custkey, c_nationkey
                             FROM customer GROUP BY c_nationkey) r USING (c_nationkey)""",
)
def bcast_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    out = broadcast_lowest(ranks, ["c_nationkey"], "c_custkey", ["c_custkey", "c_acctbal"])
    return out.select("c_custkey", "c_nationkey", "root_c_custkey", "root_c_acctbal")


@query(
    "placement_lookup",
    """SELECT s_suppkey, s_nationkey, n_name AS process, n_regionkey AS node
       FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def placement_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("process"), F.col("n_regionkey").alias("node")
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(places, "s_nationkey")


@query(
    "star_join",
    f"""SELECT r_name AS experiment, n_name AS run, count(*) AS n, CAST(sum({cents("o_totalprice")}) AS BIGINT) AS cycles
        FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey
        JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2""",
)
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Orders are added up per customer before they are joined, so a busy customer is one row.
    per_customer = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(hundredths("o_totalprice")).alias("cycles")
    )
    ranks = per_customer.join(table(spark, sf_dir, "customer"), "c_custkey").select(
        F.col("c_nationkey").alias("run_id"), "n", "cycles"
    )
    runs = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("run_id"), F.col("n_name").alias("run"), F.col("n_regionkey").alias("experiment_id")
    )
    experiments = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("experiment_id"), F.col("r_name").alias("experiment")
    )
    return star(experiments, runs, ranks, "experiment_id", "run_id").groupBy("experiment", "run").agg(
        F.sum("n").alias("n"), F.sum("cycles").alias("cycles")
    )


@query(
    "common_values",
    f"""SELECT o_orderkey, o_orderpriority, n_run, cycles_run FROM orders JOIN
        (SELECT o_orderpriority, count(*) AS n_run, CAST(sum({cents("o_totalprice")}) AS BIGINT) AS cycles_run
         FROM orders GROUP BY 1) USING (o_orderpriority)""",
)
def common_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    common = orders.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_run"), F.sum(hundredths("o_totalprice")).alias("cycles_run")
    )
    return with_common_values(orders.drop("o_totalprice"), common, ["o_orderpriority"])


@query(
    "param_grid",
    f"""WITH g AS (SELECT d.v AS min_discount, p.v AS version, c.v AS chunks
                   FROM (VALUES (2), (5), (8)) d(v), (VALUES (4), (460), (499)) p(v), (VALUES (0), (16), (64)) c(v)
                   WHERE (p.v BETWEEN 460 AND 499) = (c.v > 0)),
        f AS (SELECT {cents("l_discount")} AS discount, count(*) AS n, sum({cents("l_extendedprice")}) AS price
              FROM lineitem GROUP BY 1)
       SELECT min_discount, version, chunks, CAST(sum(n) AS BIGINT) AS n, CAST(sum(price) AS BIGINT) AS price
       FROM f JOIN g ON discount >= min_discount GROUP BY 1, 2, 3""",
)
def param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The fact table shrinks to one row per discount before it meets the grid.
    facts = table(spark, sf_dir, "lineitem").groupBy(hundredths("l_discount").alias("discount")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(hundredths("l_extendedprice")).alias("price")
    )
    grid = parameter_grid(
        facts,
        {"min_discount": [2, 5, 8], "version": [4, 460, 499]},
        "chunks",
        [16, 64],
        chunked_channel(F.col("version")),
        0,
    )
    return grid.filter("discount >= min_discount").groupBy("min_discount", "version", "chunks").agg(
        F.sum("n").alias("n"), F.sum("price").alias("price")
    )


@query(
    "rank_translation",
    """SELECT 'n' || c_nationkey || '/' || c_mktsegment AS comm,
       row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1 AS rank,
       c_custkey AS world_rank FROM customer""",
)
def rank_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    world = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = split(world, "c_nationkey", "c_custkey").withColumn("nation_comm", F.concat(F.lit("n"), "c_nationkey"))
    nations = cut(nations, "comms")
    level_1 = nations.select(
        F.col("nation_comm").alias("comm"), F.lit("world").alias("parent_comm"),
        F.col("c_custkey").alias("origin_rank"), "new_rank",
    )
    inner = nations.select("nation_comm", "c_mktsegment", F.col("new_rank").alias("origin_rank"))
    segments = split(inner, "c_mktsegment", "origin_rank", parent=["nation_comm"])
    level_2 = segments.select(
        F.concat_ws("/", "nation_comm", "c_mktsegment").alias("comm"), F.col("nation_comm").alias("parent_comm"),
        "origin_rank", "new_rank",
    )
    level_2 = cut(level_2, "comms")
    children = level_2.select("comm", F.col("new_rank").alias("rank"))
    return translate(children, "comm", "rank", level_1.unionByName(level_2))


DEPTH = 6
SQL_PATH = " || ".join(["'w'"] + [f"CAST(c_custkey // {2**i} % 2 AS VARCHAR)" for i in range(DEPTH)])


@query(
    "rank_translation_deep",
    f"""SELECT comm, row_number() OVER (PARTITION BY comm ORDER BY c_custkey) - 1 AS rank,
        row_number() OVER (ORDER BY c_custkey) - 1 AS world_rank FROM (SELECT {SQL_PATH} AS comm, c_custkey FROM customer)""",
)
def rank_translation_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six splits, each of the communicators of the one before."""
    level = row_number(table(spark, sf_dir, "customer").select("c_custkey"), [], ["c_custkey"], "rank", start=0)
    level, tables = level.withColumn("comm", F.lit("w")), []
    for i in range(DEPTH):
        colored = level.withColumn("color", F.call_function("div", F.col("c_custkey"), F.lit(2**i)) % 2)
        below = split(colored, "color", "rank", parent=["comm"]).withColumn("child", F.concat("comm", "color"))
        below = cut(below, "level")
        tables.append(below.select(
            F.col("child").alias("comm"), F.col("comm").alias("parent_comm"), F.col("rank").alias("origin_rank"), "new_rank"
        ))
        level = below.select("c_custkey", F.col("child").alias("comm"), F.col("new_rank").alias("rank"))
    nested = tables[0]
    for more in tables[1:]:
        nested = nested.unionByName(more)
    return translate(level.select("comm", "rank"), "comm", "rank", nested)

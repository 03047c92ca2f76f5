"""Projections, filters and row checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.catalog.registry import cents, query, sql_div, table
from rankflow.functions.headers import FIELDS, decode_header, encode_header, header_is_good
from rankflow.functions.labels import (
    blank_commas,
    clean_zero,
    last_parts,
    padded_arguments,
    thread_fields,
    thread_name,
)
from rankflow.functions.payload import mismatches, payload_value
from rankflow.functions.ratios import band, hundredths, micros, percent, span_ns
from rankflow.operators.collectives import all_to_all
from rankflow.operators.placement import block_process, ranks_per_process
from rankflow.operators.profiles import match_lines
from rankflow.operators.timers import rebase, within_run
from rankflow.plans import attach, cut
from rankflow.sources.traces import row_is_good


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timer intervals: rank, timer, start and end."""
    start = micros("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", start.alias("start"), (start + hundredths("value")).alias("end")
    )


@query(
    "interval_rebase",
    f"""SELECT event_id, user_id, epoch_us(ts) - o AS start_from_origin,
        epoch_us(ts) + {cents("value")} - o AS end_from_origin, {cents("value")} AS duration
        FROM events JOIN (SELECT user_id, min(epoch_us(ts)) AS o FROM events GROUP BY user_id) USING (user_id)""",
)
def interval_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir)
    origins = rows.groupBy("user_id").agg(F.min("start").alias("origin"))
    out = rebase(rows, origins, ["user_id"], "start", "end", "origin")
    return out.select("event_id", "user_id", "start_from_origin", "end_from_origin", "duration")


@query(
    "interval_rebase_ns",
    """SELECT event_id, (epoch_us(ts) - o) * 1000 AS elapsed_ns
       FROM events JOIN (SELECT event_type, min(epoch_us(ts)) AS o FROM events GROUP BY event_type) USING (event_type)""",
)
def interval_rebase_ns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", micros("ts").alias("us"))
    rows = rows.select(
        "event_id", "event_type", F.expr("us div 1000000").alias("sec"), (F.col("us") % 1000000 * 1000).alias("nsec")
    )
    origins = rows.groupBy("event_type").agg(F.min(F.struct("sec", "nsec")).alias("o"))
    joined = attach(rows, origins, ["event_type"])
    elapsed = span_ns(F.col("sec"), F.col("nsec"), F.col("o.sec"), F.col("o.nsec"))
    return joined.select("event_id", elapsed.alias("elapsed_ns"))


@query(
    "interval_filter",
    f"""WITH i AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + {cents("value")} AS e FROM events),
        r AS (SELECT user_id, min(CASE WHEN event_type = 'signup' THEN s END) AS o,
              max(CASE WHEN event_type = 'purchase' THEN e END) AS t FROM i GROUP BY user_id)
        SELECT event_id, user_id, s - o AS start_from_origin FROM i JOIN r USING (user_id)
        WHERE NOT (o > e OR t < s)""",
)
def interval_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir)
    runs = rows.groupBy("user_id").agg(
        F.min(F.when(F.col("event_type") == "signup", F.col("start"))).alias("origin"),
        F.max(F.when(F.col("event_type") == "purchase", F.col("end"))).alias("termination"),
    )
    joined = attach(rows, runs, ["user_id"], "inner")
    kept = joined.filter(within_run(*[F.col(c) for c in ("start", "end", "origin", "termination")]))
    return kept.select("event_id", "user_id", (F.col("start") - F.col("origin")).alias("start_from_origin"))


@query(
    "thread_names",
    """SELECT c_custkey, CAST(regexp_extract(c_name, '#0*([0-9]+)$', 1) AS BIGINT) AS name_number,
       CAST(c_custkey AS INT) AS rank, c_nationkey AS process, CAST(c_custkey % 16 AS INT) AS thread FROM customer""",
)
def thread_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = thread_name(F.col("c_custkey"), F.col("c_nationkey"), F.col("c_custkey") % 16)
    fields = thread_fields(name)
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.regexp_extract("c_name", "#0*([0-9]+)$", 1).cast("bigint").alias("name_number"),
        *[fields[f].alias(f) for f in ("rank", "process", "thread")],
    )


@query(
    "message_headers",
    """SELECT l_linestatus AS kind, count(*) AS n_good, CAST(sum(q) AS BIGINT) AS elements, CAST(sum(q * 8 + CAST(l_linenumber = 7 AS INT)) AS BIGINT) AS bytes,
       CAST(sum(l_suppkey % 100000) AS BIGINT) AS receivers, CAST(sum(l_partkey % 100000) AS BIGINT) AS senders, any_value(bad) AS n_bad
       FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q,
             count(*) FILTER (l_linenumber = 7 AND l_quantity > 1) OVER (PARTITION BY l_linestatus) AS bad FROM lineitem)
       WHERE NOT (l_linenumber = 7 AND q > 1) GROUP BY l_linestatus""",
)
def message_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = F.col("l_quantity").cast("bigint")
    torn = (F.col("l_linenumber") == 7).cast("bigint")
    header = encode_header(
        count=count,
        count_bytes=count * 8 + torn,
        datatype=F.lit(1275070475),
        receiver=F.col("l_suppkey") % 100000,
        tag=F.col("l_linenumber"),
        sender=F.col("l_partkey") % 100000,
        seq_id=F.col("l_orderkey") % 100000,
    )
    log = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("kind"), header.alias("header"))
    rows = log.withColumn("good", header_is_good(F.col("header"))).withColumn("f", decode_header(F.col("header")))
    fields = {name: F.when(F.col("good"), F.col(f"f.{name}")) for name, _ in FIELDS}
    return rows.groupBy("kind").agg(
        F.count_if("good").alias("n_good"),
        F.sum(fields["count"]).alias("elements"),
        F.sum(fields["count_bytes"]).alias("bytes"),
        F.sum(fields["receiver"]).alias("receivers"),
        F.sum(fields["sender"]).alias("senders"),
        F.count_if(~F.col("good")).alias("n_bad"),
    )


@query(
    "line_match",
    """SELECT page_id, regexp_extract(html, '<!-- ad ([0-9]+) -->', 1) AS ad FROM pages
       WHERE regexp_matches(html, '<!-- ad ([0-9]+) -->')""",
)
def line_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_lines(table(spark, sf_dir, "pages").select("page_id", "html"), "html", "<!-- ad ([0-9]+) -->", ["ad"])


@query(
    "strict_rows",
    """WITH t AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'send' WHEN 'O' THEN 'recv' ELSE 'other' END AS direction,
                  o_custkey % 10 <> 0 AS numeric_ranks FROM orders)
       SELECT direction, CASE WHEN numeric_ranks AND direction <> 'other' THEN 'good' ELSE 'rejected' END AS state,
       count(*) AS n FROM t GROUP BY 1, 2""",
)
def strict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    raw = table(spark, sf_dir, "orders").select(
        F.when(status == "F", "send").when(status == "O", "recv").otherwise("other").alias("direction"),
        F.when(F.col("o_custkey") % 10 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("sender_rank"),
        F.col("o_orderkey").cast("string").alias("receiver_rank"),
    )
    state = F.when(row_is_good(), "good").otherwise("rejected")
    return raw.groupBy("direction", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("placement_block", f"SELECT {sql_div('c_custkey', 64)} AS process, count(*) AS n_ranks FROM customer GROUP BY 1")
def placement_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = table(spark, sf_dir, "customer").select(block_process(F.col("c_custkey"), 64).alias("process"))
    return ranks_per_process(ranks, "process")


@query(
    "payload_check",
    "SELECT count(*) AS n_elements, count(*) FILTER (o_orderkey % 97 = 5 OR o_orderkey % 64 = 63) AS n_wrong FROM orders",
)
def payload_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = table(spark, sf_dir, "orders").select(
        F.expr("o_orderkey div 64").alias("sender"), (F.col("o_orderkey") % 64).alias("at"), F.col("o_orderkey").alias("key")
    )
    value = payload_value(F.lit(0), F.col("sender"), F.col("at"), "positional")
    sent = sent.withColumn("value", value)
    # One all-to-all among 64 ranks with one-element blocks, and the way back.
    there = sent.select(
        F.expr("sender div 64").alias("comm"), (F.col("sender") % 64).alias("rank"), F.col("at").alias("idx"), "value", "key"
    )
    # On the way one element of a hundred is damaged, and one place of every buffer takes that of the next rank.
    damaged = F.when(F.col("key") % 97 == 5, F.col("value") + 1).when(F.col("key") % 64 == 63, F.col("value") + 100).otherwise(F.col("value"))
    back = all_to_all(all_to_all(there, 1).withColumn("value", damaged), 1)
    expected = payload_value(F.lit(0), F.col("comm") * 64 + F.col("rank"), F.col("idx"), "positional")
    return mismatches(back, F.col("value"), expected)


@query(
    "share_bands",
    f"""WITH t AS (SELECT user_id, event_type, sum({cents("value")}) AS v FROM events GROUP BY 1, 2),
        s AS (SELECT event_type, 100.0::DOUBLE * v::DOUBLE / (sum(v) OVER (PARTITION BY user_id))::DOUBLE AS p FROM t)
        SELECT event_type, CASE WHEN p < 5 THEN 'under_5' WHEN p < 25 THEN 'under_25' WHEN p < 50 THEN 'under_50'
        ELSE '50_or_more' END AS band, count(*) AS n FROM s GROUP BY 1, 2""",
)
def share_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum(hundredths("value")).alias("v"))
    sums = cut(sums)
    totals = sums.groupBy("user_id").agg(F.sum("v").alias("total"))
    shares = attach(sums, totals, ["user_id"])
    share = percent(F.col("v"), F.col("total"))
    return shares.groupBy("event_type", band(share).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "url_parts",
    """SELECT page_id, array_to_string(list_slice(string_split(url, '/'), -2, -1), '/') AS last_two,
       replace(url, ',', ' ') AS one_field,
       nullif(nullif(regexp_extract(url, 'page=([0-9]+)', 1), ''), '0') AS page FROM pages""",
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id",
        last_parts(F.col("url")).alias("last_two"),
        blank_commas(F.col("url")).alias("one_field"),
        clean_zero(F.regexp_extract("url", "page=([0-9]+)", 1)).alias("page"),
    )


@query(
    "run_arguments",
    """SELECT p_partkey, string_split(p_name, ' ')[1] AS run_args_0, string_split(p_name, ' ')[2] AS run_args_1,
       string_split(p_name, ' ')[3] AS run_args_2 FROM part""",
)
def run_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", *padded_arguments(F.col("p_name"), 3))

"""Reduces, timer statistics, matrices, profiles, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.catalog.files import EVENT_TYPES, SQL_LINES
from rankflow.catalog.registry import cents, query, sql_div, sql_exact_sum, table
from rankflow.functions.ratios import hundredths, percent
from rankflow.operators import experiments, profiles, timers, traces
from rankflow.operators.collectives import all_reduce, reduce, reduce_to_root, reduce_value, to_elements
from rankflow.operators.placement import ranks_per_process
from rankflow.plans import attach, cut
from rankflow.sources.logs import lines_of

SQL_ELEMENTS = """SELECT label AS comm, vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS idx,
    CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("label", "comm")
    return to_elements(rows, ["comm", "vec_id"], "embedding")


@query(
    "reduce_elementwise",
    f"""SELECT comm, idx, {sql_exact_sum("v", 60)} AS sum_v, min(v) AS min_v, max(v) AS max_v,
        round(product(1 + v), 6) AS prod_v FROM ({SQL_ELEMENTS}) GROUP BY comm, idx""",
)
def reduce_elementwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements(spark, sf_dir).withColumn("above_one", F.col("value") + 1)
    ops = {"sum_v": "sum", "min_v": "min", "max_v": "max", "prod_v": ("prod", "above_one")}
    return reduce(rows, ["comm"], ops).withColumn("prod_v", F.round("prod_v", 6))


@query(
    "reduce_exact",
    f"""SELECT l_returnflag, l_linestatus, {sql_exact_sum("l_extendedprice * (1 - l_discount)", 44)} AS revenue,
        {sql_exact_sum("l_extendedprice * (1 - l_discount) - l_extendedprice", 44)} AS given, max(l_tax) AS most_tax
        FROM lineitem GROUP BY 1, 2""",
)
def reduce_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of doubles with all bits in use: the same for every order and partitioning of the rows."""
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_tax", paid.alias("paid"), (paid - F.col("l_extendedprice")).alias("less")
    )
    ops = {"revenue": ("sum", "paid"), "given": ("sum", "less"), "most_tax": ("max", "l_tax")}
    return reduce_value(rows, ["l_returnflag", "l_linestatus"], ops)


@query(
    "reduce_root",
    f"SELECT comm, CAST(0 AS INT) AS rank, idx, max(v) AS value FROM ({SQL_ELEMENTS}) GROUP BY comm, idx",
)
def reduce_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce_to_root(elements(spark, sf_dir), ["comm"], "max", root=0)


@query(
    "allreduce_share",
    f"""SELECT l_orderkey, l_returnflag, 100.0::DOUBLE * v::DOUBLE / t::DOUBLE AS share
        FROM (SELECT l_orderkey, l_returnflag, {cents("l_extendedprice")} AS v,
              sum({cents("l_extendedprice")}) OVER (PARTITION BY l_returnflag) AS t FROM lineitem)""",
)
def allreduce_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag", F.lit(0).alias("idx"), hundredths("l_extendedprice").alias("value")
    )
    out = all_reduce(rows, ["l_returnflag"], {"total": "sum"})
    return out.select("l_orderkey", "l_returnflag", percent(F.col("value"), F.col("total")).alias("share"))


@query(
    "reduce_value",
    f"""SELECT l_returnflag, CAST(sum({cents("l_extendedprice")}) AS BIGINT) AS total, min(strftime(l_shipdate, '%Y-%m-%d')) AS first_day,
        max(l_quantity) AS most FROM lineitem GROUP BY l_returnflag""",
)
def reduce_value_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_quantity", "l_shipdate", hundredths("l_extendedprice").alias("v")
    )
    ops = {"total": ("sum", "v"), "first_day": ("min", "l_shipdate"), "most": ("max", "l_quantity")}
    out = reduce_value(rows, ["l_returnflag"], ops)
    return out.withColumn("first_day", F.date_format("first_day", "yyyy-MM-dd"))


@query(
    "timer_stats",
    f"""SELECT event_type, min({cents("value")}) AS min_elapsed, max({cents("value")}) AS max_elapsed,
        round(avg({cents("value")}), 6) AS mean_elapsed FROM events GROUP BY event_type""",
)
def timer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", hundredths("value").alias("elapsed"))
    return timers.timer_stats(rows, ["event_type"], "elapsed").withColumn("mean_elapsed", F.round("mean_elapsed", 6))


def user_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time of each timer and in total per user: one row per (user, timer)."""
    sums = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum(hundredths("value")).alias("elapsed"))
    sums = cut(sums)
    return attach(sums, sums.groupBy("user_id").agg(F.sum("elapsed").alias("total")), ["user_id"])


SQL_USER_TIMERS = f"""SELECT user_id, event_type, CAST(sum({cents("value")}) AS BIGINT) AS elapsed,
    CAST(sum(sum({cents("value")})) OVER (PARTITION BY user_id) AS BIGINT) AS total FROM events GROUP BY 1, 2"""
SQL_BAND = """CASE WHEN {0} < 5 THEN 'under_5' WHEN {0} < 25 THEN 'under_25' WHEN {0} < 50 THEN 'under_50'
    ELSE '50_or_more' END"""


@query(
    "slowest_rank",
    f"""WITH t AS ({SQL_USER_TIMERS}),
        p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY elapsed DESC, user_id) AS place,
              CAST(round(avg(nullif(elapsed, 0)) OVER (PARTITION BY event_type)) AS BIGINT) AS mean_nonzero FROM t),
        s AS (SELECT *, round(100.0::DOUBLE * elapsed::DOUBLE / total::DOUBLE, 2) AS share FROM p WHERE place = 1)
        SELECT event_type, elapsed AS max_elapsed, user_id AS max_rank, mean_nonzero, share,
        {SQL_BAND.format("share")} AS band FROM s""",
)
def slowest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timers.slowest_rank(user_timers(spark, sf_dir), ["event_type"], "user_id", "elapsed", "total")


@query(
    "timer_share",
    f"""WITH t AS ({SQL_USER_TIMERS}),
          n AS (SELECT user_id, CASE WHEN event_type IN ('click', 'error', 'view') THEN 'a' ELSE 'b' END AS timer,
                arg_max(elapsed, event_type) AS elapsed, max(total) AS total FROM t GROUP BY 1, 2),
          s AS (SELECT *, 100.0::DOUBLE * elapsed::DOUBLE / total::DOUBLE AS share FROM n)
        SELECT user_id, timer, share, row_number() OVER (PARTITION BY user_id ORDER BY share DESC, timer) AS place FROM s""",
)
def timer_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timers named by a letter, of which the last of each name counts."""
    rows = user_timers(spark, sf_dir)
    index = F.array_position(F.array(*[F.lit(t) for t in sorted(EVENT_TYPES)]), F.col("event_type"))
    named = F.when(F.col("event_type").isin("click", "error", "view"), "a").otherwise("b").alias("timer")
    rows = rows.select("user_id", named, index.alias("index"), "elapsed", "total")
    return timers.timer_share(rows, ["user_id"], "timer", "index", "elapsed", "total")


def nation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and bytes from supplier nations to customer nations.

    Lines are added up per (supplier, customer nation) before the supplier
    join, so a busy supplier is a handful of rows there.
    """
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("recv_proc")
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    messages = lines.join(orders.join(customers, "o_custkey"), "l_orderkey")
    parts = traces.comm_matrix(messages, ["l_suppkey", "recv_proc"], F.col("l_quantity").cast("bigint"))
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("send_proc")
    )
    return traces.add_matrices(parts.join(suppliers, "l_suppkey"), ["send_proc", "recv_proc"])


@query(
    "comm_matrix",
    """SELECT s_nationkey AS send_proc, c_nationkey AS recv_proc, count(*) AS messages,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
)
def comm_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_matrix(spark, sf_dir)


@query(
    "bundle_sizes",
    f"""WITH t AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'send' ELSE 'recv' END AS direction, l_linenumber AS tag,
                   l_suppkey % 64 AS s, l_partkey % 64 AS r, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4)
        SELECT direction, tag, {sql_div("s", 4)} AS send_proc, {sql_div("r", 4)} AS recv_proc,
        CAST(sum(n) AS BIGINT) AS n_messages, count(*) AS n_pairs,
        string_agg('t' || s || ' -> t' || r || ' x' || n, '; ' ORDER BY s, r) AS pairs FROM t GROUP BY 1, 2, 3, 4""",
)
def bundle_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", "send").otherwise("recv").alias("direction"),
        F.col("l_linenumber").alias("tag"),
        (F.col("l_suppkey") % 64).alias("sender"),
        (F.col("l_partkey") % 64).alias("receiver"),
    )
    return traces.bundle_sizes(trace, 4, "direction", "tag", "sender", "receiver")


@query(
    "channel_mix",
    f"""WITH c AS (SELECT l_returnflag, count(*) FILTER ({sql_div("l_suppkey", 16)} = {sql_div("l_partkey", 16)}) AS n_process,
                   CAST(count(*) FILTER ({sql_div("l_suppkey", 16)} <> {sql_div("l_partkey", 16)}) // 2 AS BIGINT) AS n_direct
                   FROM lineitem GROUP BY 1)
        SELECT *, 100.0::DOUBLE * n_process::DOUBLE / (n_process + n_direct)::DOUBLE AS process_percent,
        100.0::DOUBLE * n_direct::DOUBLE / (n_process + n_direct)::DOUBLE AS direct_percent FROM c""",
)
def channel_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = F.expr("l_suppkey div 16 = l_partkey div 16")
    rows = table(spark, sf_dir, "lineitem").withColumn("channel_type", F.when(same, "process").otherwise("direct_mpi"))
    return traces.channel_mix(rows, ["l_returnflag"], "channel_type")


@query(
    "steal_share",
    "SELECT l_returnflag || l_linestatus AS task, count(*) FILTER (l_suppkey % 8 <> l_partkey % 8) AS steals, count(*) AS chunks, "
    + ", ".join(f"count(*) FILTER (l_partkey % 8 = {r}) AS rank_{r}" for r in range(8))
    + ", round(100.0::DOUBLE * (count(*) FILTER (l_suppkey % 8 <> l_partkey % 8))::DOUBLE / count(*)::DOUBLE, 2) AS steal_percent"
    + " FROM lineitem GROUP BY 1",
)
def steal_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("task"),
        (F.col("l_suppkey") % 8).alias("owner"),
        (F.col("l_partkey") % 8).alias("executor"),
    )
    return traces.steal_share(rows, ["task"], "executor", "owner", list(range(8)))


@query(
    "wait_mix",
    "SELECT user_id, count(*) AS n_waits, "
    + ", ".join(f"count(*) FILTER (event_type = '{t}') AS n_{t}" for t in EVENT_TYPES)
    + ", "
    + ", ".join(
        f"100.0::DOUBLE * (count(*) FILTER (event_type = '{t}'))::DOUBLE / count(*)::DOUBLE AS pct_{t}" for t in EVENT_TYPES
    )
    + " FROM events GROUP BY user_id",
)
def wait_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.wait_mix(table(spark, sf_dir, "events"), ["user_id"], "event_type", EVENT_TYPES)


@query(
    "queue_ratios",
    """SELECT event_type, CAST(sum(k) AS DOUBLE) / count(*)::DOUBLE AS spins_per_wait, max(k) AS peak_depth,
       100.0::DOUBLE * max(k)::DOUBLE / 128 AS peak_percent
       FROM (SELECT event_type, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events) GROUP BY 1""",
)
def queue_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("k"))
    return traces.queue_ratios(rows, ["event_type"], "k", "k", 128)


@query(
    "profile_summary",
    f"""WITH s AS (SELECT p_brand, year(l_shipdate) AS y, sum({cents("l_extendedprice")}) AS v
                   FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
        p AS (SELECT p_brand, y, 100.0::DOUBLE * v::DOUBLE / (sum(v) OVER (PARTITION BY y))::DOUBLE AS pct FROM s)
        SELECT p_brand, round(min(pct), 6) AS min_percent, round(avg(pct), 6) AS mean_percent, round(max(pct), 6) AS max_percent,
        count(*) AS n_reports FROM p GROUP BY 1 HAVING sum(pct) >= 0.3""",
)
def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.year("l_shipdate").alias("year")).agg(
        F.sum(hundredths("l_extendedprice")).alias("v")
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = cut(lines.join(parts, "l_partkey").groupBy("p_brand", "year").agg(F.sum("v").alias("v")))
    years = rows.groupBy("year").agg(F.sum("v").alias("total"))
    shares = attach(rows, years, ["year"]).withColumn("percent", percent(F.col("v"), F.col("total")))
    out = profiles.profile_summary(shares, "p_brand", "year", "percent")
    return out.withColumns({c: F.round(c, 6) for c in ("min_percent", "mean_percent", "max_percent")})


@query(
    "class_rollup",
    f"""WITH r AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'send' WHEN '2-HIGH' THEN 'recv'
                   WHEN '3-MEDIUM' THEN 'comm_other' ELSE 'compute' END AS mode, {cents("o_totalprice")} AS b, o_custkey AS w FROM orders)
        SELECT coalesce(mode, 'TOTAL') AS class, CAST(sum(b) AS BIGINT) AS busy, CAST(sum(w) AS BIGINT) AS wait,
        CAST(sum(b) + sum(w) AS BIGINT) AS total,
        round(100.0::DOUBLE * (sum(b) + sum(w))::DOUBLE / (SELECT sum(b) + sum(w) FROM r)::DOUBLE, 1) AS percent
        FROM r GROUP BY ROLLUP (mode)""",
)
def class_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        "o_orderpriority", hundredths("o_totalprice").alias("busy"), F.col("o_custkey").alias("wait")
    )
    classes = {"send": ["1-URGENT"], "recv": ["2-HIGH"], "comm_other": ["3-MEDIUM"]}
    return profiles.class_rollup(profiles.with_class(rows, "o_orderpriority", classes), "mode", "busy", "wait")


@query(
    "leak_totals",
    """SELECT count(*) AS n_processes, CAST(sum(length(html)) AS BIGINT) AS leaked_bytes,
       CAST(sum(page_id) AS BIGINT) AS leaked_allocations FROM pages WHERE page_id % 3 <> 0""",
)
def leak_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    summary = F.format_string(
        "SUMMARY: AddressSanitizer: %d byte(s) leaked in %d allocation(s).", F.length("html"), F.col("page_id")
    )
    log = pages.select("page_id", F.concat_ws("\n", "html", F.when(F.col("page_id") % 3 != 0, summary)).alias("log"))
    return profiles.leak_totals(lines_of(log, "log", ["page_id"]))


@query(
    "heap_footprint",
    f"""SELECT c_nationkey, CAST(sum(peak) AS BIGINT) AS footprint, count(*) AS n_files
        FROM (SELECT o_custkey, max({cents("o_totalprice")}) AS peak FROM orders GROUP BY 1)
        JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def heap_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max(hundredths("o_totalprice")).alias("heap")
    )
    rows = peaks.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return profiles.heap_footprint(rows, ["c_custkey"], "heap", ["c_nationkey"])


@query(
    "nth_line",
    f"""SELECT doc_id, CAST(len(regexp_extract_all(line, '[0-9.]+')) AS INT) AS n_numbers,
        list_extract(regexp_extract_all(line, '[0-9.]+'), 1) AS first_number FROM ({SQL_LINES}) WHERE line_no = 9""",
)
def nth_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    numbers = profiles.nth_line_numbers(lines, 9)
    return numbers.select(
        "doc_id", F.size("numbers").alias("n_numbers"), F.get("numbers", F.lit(0)).alias("first_number")
    )


@query(
    "symbol_counts",
    """SELECT symbol, count(*) AS n FROM (SELECT conv_id, string_split(arg_min(text, turn), ' ')[1] AS symbol
       FROM conversations WHERE role = 'user' GROUP BY conv_id) GROUP BY symbol""",
)
def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    words = turns.select("conv_id", "turn", F.substring_index("text", " ", 1).alias("symbol"))
    return profiles.symbol_counts(words.groupBy("conv_id").agg(F.min_by("symbol", "turn").alias("symbol")))


@query(
    "stack_frames",
    """SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS stack,
       event_type AS symbol, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) > 80 AS waiting FROM events""",
)
def stack_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    wait = F.when(k > 80, F.lit("#0  0x01 in DequeueWaitSpinWhileEmpty (this=0x0) at /lib/queue.cpp:10"))
    frame = F.format_string("#1  0x02 in %s (a=1, b=2) at /src/app.cpp:%d", F.col("event_type"), k)
    header = F.lit("Thread 1 (Thread 0x7fff (LWP 42)):")
    stacks = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file"), "event_id", F.posexplode(F.array(header, wait, frame, F.lit("#2  0x03 in main ()")))
    )
    lines = stacks.select("file", (F.col("event_id") * 4 + F.col("pos")).alias("line_no"), F.col("col").alias("line"))
    return profiles.stack_frames(lines.filter(F.col("line").isNotNull()), "app.cpp")


@query(
    "coincidence_matrix",
    """WITH e AS (SELECT event_id, event_type AS sym, value > 80 AS waiting, event_id // 10 AS section FROM events),
        w AS (SELECT section, coalesce(arg_min(sym, event_id) FILTER (waiting), 'Unknown') AS wait_symbol
              FROM e GROUP BY section HAVING count(*) = 10)
       SELECT wait_symbol, """
    + ", ".join(f"count(*) FILTER (sym = '{t}') AS {t}" for t in EVENT_TYPES)
    + " FROM e JOIN w USING (section) WHERE NOT waiting GROUP BY wait_symbol",
)
def coincidence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    stacks = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("sym"), (F.col("value") > 80).alias("waiting"))
    sectioned = profiles.sections(stacks, [], ["event_id"], 10)
    pairs = profiles.coincidences(sectioned, [], "event_id", "sym", "waiting", 10)
    return profiles.coincidence_matrix(pairs, EVENT_TYPES)


@query(
    "duplicate_configs",
    """SELECT l_orderkey || '-' || l_linenumber AS config, count(*) AS n FROM lineitem
       GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def duplicate_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.duplicate_configs(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], 1)


@query(
    "completeness",
    """WITH f AS (SELECT l_orderkey, count(*) AS found FROM lineitem GROUP BY 1),
        e AS (SELECT o_orderkey AS job, 4 AS expected FROM orders)
       SELECT job, expected, coalesce(found, 0) AS found,
       CASE WHEN coalesce(found, 0) < 4 THEN 'failed' WHEN found > 4 THEN 'surplus' ELSE 'ok' END AS status,
       coalesce(found, 0) IN (4, 8, 16) AS accepted FROM e LEFT JOIN f ON job = l_orderkey""",
)
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.lit(4).alias("expected"))
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(F.count(F.lit(1)).alias("found"))
    return experiments.completeness(expected, found, ["job"], "expected", "found")


@query(
    "size_tolerance",
    """WITH s AS (SELECT count(*) AS rows, count(DISTINCT o_orderstatus) AS files FROM orders),
       c AS (SELECT unnest([0, 5, 9, 11, 20]) AS permille)
       SELECT CAST(permille AS INT) AS permille, CAST(rows + rows * permille // 1000 AS BIGINT) AS actual, rows + files AS lines, files,
       (rows + rows * permille // 1000 - (rows + 1)) / (rows + 1) <= 0.01 AS within FROM s, c""",
)
def size_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each status is one input file with a header; combined files with up to 2 percent too many rows are judged."""
    files = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"))
    sums = files.agg(F.sum("rows").alias("rows"), F.sum(F.col("rows") + 1).alias("lines"), F.count(F.lit(1)).alias("files"))
    sums = sums.select("*", F.explode(F.array(*[F.lit(p) for p in (0, 5, 9, 11, 20)])).alias("permille"))
    actual = F.col("rows") + F.call_function("div", F.col("rows") * F.col("permille"), F.lit(1000))
    sums = sums.select("permille", actual.alias("actual"), "lines", "files")
    return sums.withColumn("within", experiments.within_tolerance(F.col("actual"), F.col("lines"), F.col("files")))


@query(
    "distinct_counts",
    f"""SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n_colors, count(DISTINCT {sql_div("c_custkey", 64)}) AS n_processes
        FROM customer GROUP BY 1""",
)
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(
        F.count_distinct("c_nationkey").alias("n_colors"), F.count_distinct(F.expr("c_custkey div 64")).alias("n_processes")
    )


@query("ranks_per_process", f"SELECT {sql_div('c_custkey', 48)} AS process, count(*) AS n_ranks FROM customer GROUP BY 1")
def ranks_per_process_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = table(spark, sf_dir, "customer").select(F.expr("c_custkey div 48").alias("process"))
    return ranks_per_process(ranks, "process")


@query(
    "config_median",
    f"""SELECT event_type, median(m) AS median_elapsed, count(*) AS n_runs
        FROM (SELECT event_type, user_id, max({cents("value")}) AS m FROM events GROUP BY 1, 2) GROUP BY 1""",
)
def config_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", hundredths("value").alias("elapsed"))
    return experiments.config_median(rows, ["event_type"], ["user_id"], "elapsed")


@query(
    "speedup",
    f"""WITH r AS (SELECT o_orderpriority, o_orderstatus, o_custkey, max({cents("o_totalprice")}) AS m FROM orders GROUP BY 1, 2, 3),
        m AS (SELECT o_orderpriority, o_orderstatus, median(m) AS e FROM r GROUP BY 1, 2)
        SELECT o_orderpriority, max(e) FILTER (o_orderstatus = 'F') AS baseline, max(e) FILTER (o_orderstatus = 'O') AS tested,
        max(e) FILTER (o_orderstatus = 'F') / max(e) FILTER (o_orderstatus = 'O') AS speed_up FROM m GROUP BY 1""",
)
def speed_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        "o_orderpriority", "o_orderstatus", "o_custkey", hundredths("o_totalprice").alias("elapsed")
    )
    medians = experiments.config_median(rows, ["o_orderpriority", "o_orderstatus"], ["o_custkey"], "elapsed")
    return experiments.speed_up(medians, ["o_orderpriority"], "o_orderstatus", "F", "O", "median_elapsed")


@query(
    "line_counts",
    f"SELECT doc_id, count(*) AS n_lines, count(*) > 55 AS has_errors FROM ({SQL_LINES}) GROUP BY doc_id",
)
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return profiles.line_counts(lines, ["doc_id"])


@query(
    "median_missing_times",
    f"""WITH runs AS (SELECT event_type, user_id, max(CASE WHEN user_id % 5 <> 0 THEN {cents("value")} END) AS slowest
                      FROM events GROUP BY ALL)
        SELECT event_type, median(slowest) AS median_elapsed, count(*) AS n_runs FROM runs GROUP BY event_type""",
)
def median_missing_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians where a fifth of the runs has no time."""
    elapsed = F.when(F.col("user_id") % 5 != 0, hundredths("value")).alias("elapsed")
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", elapsed)
    return experiments.config_median(rows, ["event_type"], ["user_id"], "elapsed")


@query(
    "config_median_counted",
    f"""WITH runs AS (SELECT o_orderpriority, o_orderstatus, o_custkey,
                      max(CASE WHEN o_custkey % 11 <> 0 THEN {cents("o_totalprice")} END) AS slowest FROM orders GROUP BY ALL)
        SELECT o_orderpriority, o_orderstatus, median(slowest) AS median_elapsed, count(*) AS n_runs FROM runs GROUP BY 1, 2""",
)
def config_median_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    elapsed = F.when(F.col("o_custkey") % 11 != 0, hundredths("o_totalprice")).alias("elapsed")
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", "o_custkey", elapsed)
    return experiments.config_median_counted(rows, ["o_orderpriority", "o_orderstatus"], ["o_custkey"], "elapsed")

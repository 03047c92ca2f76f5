"""Sources and sinks: the tables are written in each layout and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow import schemas
from rankflow.catalog.registry import cents, query, sql_div, table
from rankflow.functions.payload import payload_value
from rankflow.functions.ratios import hundredths, micros
from rankflow.operators.experiments import star
from rankflow.operators.profiles import coincidence_matrix, with_class
from rankflow.plans import new_path, row_number
from rankflow.sources import commits, logs, results, sinks, stats, traces

ORIGIN = 1704067200000000
EVENT_TYPES = ["click", "view", "purchase", "signup", "error"]
K = "CAST(regexp_extract(props, '[0-9]+') AS BIGINT)"
PROPS = T.StructType([T.StructField("k", T.LongType())])


def layout_columns(schema: T.StructType, **columns: Column) -> list[Column]:
    """All columns of a layout in order; those not given are null."""
    return [columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]


def in_layout(df: DataFrame, schema: T.StructType, **columns: Column) -> DataFrame:
    return df.select(*layout_columns(schema, **columns))


@query(
    "rank_stats_json",
    f"SELECT user_id, count(*) AS n, CAST(sum({K}) AS BIGINT) AS sum_k, max({K}) AS max_k FROM events GROUP BY user_id",
)
def rank_stats_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stats.parse_rank_stats(table(spark, sf_dir, "events").select("user_id", "props"), "props", PROPS)
    return docs.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k")
    )


@query(
    "rank_stats_union",
    f"""SELECT event_type AS hostname, user_id AS thread_rank, count(*) AS n,
       CAST(sum(CASE WHEN event_type NOT IN ('view', 'signup') THEN {cents("value")} END) AS BIGINT) AS cycles,
       CAST(sum(CASE WHEN event_type IN ('view', 'signup') THEN {cents("value")} * 10 END) AS BIGINT) AS ns,
       CAST(sum(CASE WHEN event_type IN ('view', 'signup') THEN {K} * 4096 END) AS BIGINT) AS footprint
       FROM events GROUP BY event_type, user_id""",
)
def rank_stats_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", PROPS)["k"])
    common = {"hostname": F.col("event_type"), "job_thread_rank": F.col("user_id")}
    cycles = stats.document_json({**common, "elapsed_cycles": hundredths("value")})
    ns = stats.document_json({
        **common, "elapsed_ns_monotonic": hundredths("value") * 10, "memory_footprint_bytes": F.col("k") * 4096
    })
    by_cycles = events.filter("event_type NOT IN ('view', 'signup')").select(cycles.alias("doc"))
    by_ns = events.filter("event_type IN ('view', 'signup')").select(ns.alias("doc"))
    both = stats.union_layouts(
        stats.parse_rank_stats(by_cycles, "doc", schemas.rank_stats_cycles("job_"), "job_"),
        stats.parse_rank_stats(by_ns, "doc", schemas.rank_stats_ns("job_"), "job_"),
    )
    return both.groupBy("hostname", F.col("thread_rank").cast("bigint").alias("thread_rank")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("elapsed_cycles").alias("cycles"),
        F.sum("elapsed_ns_monotonic").alias("ns"),
        F.sum("memory_footprint_bytes").alias("footprint"),
    )


@query(
    "timer_intervals",
    f"""SELECT CAST(user_id AS BIGINT) AS thread_rank, event_type AS timer_name, count(*) AS n,
       CAST(sum({cents("value")}) AS BIGINT) AS duration, min(epoch_us(ts) - {ORIGIN}) AS first_start,
       max(epoch_us(ts) - {ORIGIN} + {cents("value")}) AS last_end
       FROM events GROUP BY user_id, event_type""",
)
def timer_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "intervals")
    start = micros("ts") - ORIGIN
    in_layout(
        table(spark, sf_dir, "events"),
        schemas.TIMER_INTERVALS_CYCLES,
        thread_rank=F.col("user_id"),
        timer_name=F.col("event_type"),
        start_cycles_from_beginning=start,
        end_cycles_from_beginning=start + hundredths("value"),
        duration_cycles=hundredths("value"),
        thread_comm_partner_rank=F.lit(-1),
        sequence_number=F.col("event_id"),
        program_origin_cycles=F.lit(ORIGIN),
    ).write.csv(path, header=True)
    return stats.read_intervals(spark, path).groupBy(
        F.col("thread_rank").cast("bigint").alias("thread_rank"), "timer_name"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("duration_cycles").alias("duration"),
        F.min("start_cycles_from_beginning").alias("first_start"),
        F.max("end_cycles_from_beginning").alias("last_end"),
    )


def line_direction() -> Column:
    """Lines in status F count as sends."""
    return F.when(F.col("l_linestatus") == "F", "send").otherwise("recv")


SQL_DIRECTION = "CASE WHEN l_linestatus = 'F' THEN 'send' ELSE 'recv' END"


@query(
    "comm_trace",
    f"""SELECT {SQL_DIRECTION} AS direction, CAST(l_linenumber AS BIGINT) AS channel_endpoint_id, count(*) AS n,
       CAST(sum(l_suppkey) AS BIGINT) AS senders, CAST(sum(l_orderkey) AS BIGINT) AS seqs
       FROM lineitem GROUP BY 1, 2""",
)
def comm_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "trace")
    in_layout(
        table(spark, sf_dir, "lineitem"),
        schemas.COMM_TRACE,
        direction=line_direction(),
        **{"from": F.col("l_suppkey"), "to": F.col("l_partkey")},
        channel_endpoint_id=F.col("l_linenumber"),
        seq_num=F.col("l_orderkey"),
        channel_type=F.lit("process"),
        mpi_called=F.lit("MPI_NO"),
    ).write.csv(path, header=True)
    trace = traces.read_comm_trace(spark, path)
    return trace.groupBy("direction", F.col("channel_endpoint_id").cast("bigint").alias("channel_endpoint_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("sender_rank").alias("senders"), F.sum("seq_num").alias("seqs")
    )


@query(
    "comm_trace_wide",
    f"""SELECT {SQL_DIRECTION} AS direction, l_returnflag AS channel_type, count(*) AS n,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS elements,
       CAST(sum(CAST(l_quantity AS BIGINT) * 8) AS BIGINT) AS total_bytes
       FROM lineitem GROUP BY 1, 2""",
)
def comm_trace_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "trace")
    count = F.col("l_quantity").cast("bigint")
    in_layout(
        table(spark, sf_dir, "lineitem"),
        schemas.COMM_TRACE_WIDE,
        direction=line_direction(),
        sender_rank=F.col("l_suppkey"),
        receiver_rank=F.col("l_partkey"),
        msg_len=count,
        tag=F.col("l_linenumber"),
        datatype_bytes=F.lit(8),
        total_bytes=count * 8,
        channel_type=F.col("l_returnflag"),
        mpi_called=F.lit("MPI_YES"),
    ).write.csv(path, header=True)
    return traces.read_comm_trace_wide(spark, path).groupBy("direction", "channel_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("msg_len").alias("elements"), F.sum("total_bytes").alias("total_bytes")
    )


@query(
    "call_trace",
    """SELECT CASE WHEN l_returnflag = 'A' THEN 'MPI_Send' WHEN l_returnflag = 'N' THEN 'MPI_Isend'
       ELSE 'MPI_Irecv' END AS call, CASE WHEN l_returnflag = 'R' THEN 'recv' ELSE 'send' END AS direction,
       count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS elements
       FROM lineitem GROUP BY 1, 2""",
)
def call_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "calls")
    flag = F.col("l_returnflag")
    call = F.when(flag == "A", "MPI_Send").when(flag == "N", "MPI_Isend").otherwise("MPI_Irecv")
    in_layout(
        table(spark, sf_dir, "lineitem"),
        schemas.CALL_TRACE,
        file_line=F.concat(F.lit("main.c:"), F.col("l_linenumber")),
        function=F.lit("main"),
        call=call,
        sender_rank=F.col("l_suppkey"),
        receiver_rank=F.col("l_partkey"),
        msg_len=F.col("l_quantity").cast("bigint"),
        tag=F.col("l_linenumber"),
        datatype_bytes=F.lit(8),
    ).write.csv(path)
    return traces.read_call_trace(spark, path).groupBy("call", "direction").agg(
        F.count(F.lit(1)).alias("n"), F.sum("msg_len").alias("elements")
    )


@query(
    "channel_list",
    f"""SELECT CASE WHEN {sql_div("l_suppkey", 16)} = {sql_div("l_partkey", 16)} THEN 'process' ELSE 'direct_mpi'
       END AS channel_type, {sql_div("l_suppkey", 16)} AS send_process, count(*) AS n,
       count(DISTINCT l_partkey) AS n_recv_ranks FROM lineitem GROUP BY 1, 2""",
)
def channel_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "channels")
    send, recv = F.expr("l_suppkey div 16"), F.expr("l_partkey div 16")
    in_layout(
        table(spark, sf_dir, "lineitem"),
        schemas.CHANNELS,
        channel_type=F.when(send == recv, "process").otherwise("direct_mpi"),
        process=send,
        send_process=send,
        recv_process=recv,
        send_rank=F.col("l_suppkey"),
        recv_rank=F.col("l_partkey"),
    ).toDF(*schemas.channel_headers("app ")).write.csv(path, header=True)
    rows = traces.read_channels(spark, path, "app ")
    # Ranks are counted as bits of words of 64, so that a task holds a row for each word, not for each rank.
    rank = F.col("recv_rank").cast("bigint")
    words = rows.groupBy(
        "channel_type", F.col("send_process").cast("bigint").alias("send_process"), F.shiftright(rank, 6).alias("word")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(rank, F.lit(64)).cast("int"))).alias("bits"),
    )
    return words.groupBy("channel_type", "send_process").agg(
        F.sum("n").alias("n"), F.sum(F.coalesce(F.bit_count("bits").cast("bigint"), F.lit(0))).alias("n_recv_ranks")
    )


@query(
    "wait_log",
    """SELECT event_type AS process_channel, count(*) AS n,
       max(CAST(epoch_us(ts) // 1000000 AS BIGINT)) AS last_s,
       CAST(sum(CAST(epoch_us(ts) % 1000000 * 1000 AS BIGINT)) AS BIGINT) AS sum_ns FROM events GROUP BY event_type""",
)
def wait_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "waits")
    in_layout(
        table(spark, sf_dir, "events"),
        schemas.WAIT_LOG,
        wait_call_s=F.call_function("div", micros("ts"), F.lit(1000000)),
        wait_call_ns=micros("ts") % 1000000 * 1000,
        process_channel=F.col("event_type"),
    ).write.csv(path, header=True)
    return traces.read_wait_log(spark, path).groupBy("process_channel").agg(
        F.count(F.lit(1)).alias("n"), F.max("wait_call_s").alias("last_s"), F.sum("wait_call_ns").alias("sum_ns")
    )


@query(
    "chunk_log",
    """SELECT CASE WHEN l_suppkey % 8 = l_partkey % 8 THEN 'OWNER' ELSE 'THIEF' END AS thread_type,
       CAST(l_suppkey % 8 AS BIGINT) AS owner_rank, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS sum_min_idx
       FROM lineitem GROUP BY 1, 2""",
)
def chunk_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "chunks")
    owner, executor = F.col("l_suppkey") % 8, F.col("l_partkey") % 8
    fields = [
        executor, F.when(owner == executor, "OWNER").otherwise("THIEF"), owner, F.col("l_returnflag"), F.lit("CHUNK"),
        F.col("l_linenumber"), F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_orderkey") + 7,
        F.lit("main\tframe 1\tframe 2"),
    ]
    table(spark, sf_dir, "lineitem").select(F.concat_ws("\t", *fields)).write.text(path)
    return traces.read_chunk_log(spark, path).filter(F.col("backtrace") == "main\tframe 1\tframe 2").groupBy(
        "thread_type", F.col("owner_rank").cast("bigint").alias("owner_rank")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("min_idx").alias("sum_min_idx"))


def _results(orders: DataFrame) -> DataFrame:
    return orders.select(*_result_columns())


def _result_columns() -> list[Column]:
    """The columns of the results layout for orders as rank rows."""
    return layout_columns(
        schemas.results(),
        runtime=F.col("o_orderstatus"),
        config_unique_id=F.col("o_orderpriority"),
        run_num_for_config=F.lit(1),
        thread_rank=F.col("o_custkey"),
        run_unique_id=F.col("o_orderkey"),
        elapsed_cycles=hundredths("o_totalprice"),
    )


SQL_RESULTS = f"""SELECT o_orderstatus AS runtime, o_orderpriority AS config, count(*) AS n,
    CAST(sum({cents("o_totalprice")}) AS BIGINT) AS cycles FROM orders GROUP BY 1, 2"""


def _by_config(rows: DataFrame) -> DataFrame:
    return rows.groupBy("runtime", F.col("config_unique_id").alias("config")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("elapsed_cycles").alias("cycles")
    )


@query("results_table", SQL_RESULTS)
def results_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "results")
    sinks.write_tsv(_results(table(spark, sf_dir, "orders")), path)
    return _by_config(results.read_results(spark, path))


@query(
    "results_by_header",
    f"""SELECT o_orderstatus AS runtime, count(*) AS n, CAST(sum({cents("o_totalprice")}) AS BIGINT) AS cycles,
        CAST(sum(o_custkey) FILTER (o_orderkey % 3 = 1) AS BIGINT) AS instructions,
        CAST(sum(o_orderkey) FILTER (o_orderkey % 3 >= 1) AS BIGINT) AS branch_misses,
        CAST(sum(o_orderkey + o_custkey) FILTER (o_orderkey % 3 = 2) AS BIGINT) AS timer_28,
        count(*) FILTER (o_orderkey % 3 = 2 AND o_orderpriority = '1-URGENT') AS urgent_timers FROM orders GROUP BY 1""",
)
def results_by_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "results")
    orders = table(spark, sf_dir, "orders")
    extra = {
        "instructions": F.col("o_custkey"), "branch-misses": F.col("o_orderkey"),
        "custom28_timer_name": F.col("o_orderpriority"), "custom28_elapsed_cycles": F.col("o_orderkey") + F.col("o_custkey"),
    }
    # Files with the columns in another order, with other counters, and with a 29th timer.
    for part, names in enumerate([[], ["instructions", "branch-misses"], ["custom28_timer_name", "branch-misses", "custom28_elapsed_cycles"]]):
        own = orders.filter(F.col("o_orderkey") % 3 == part)
        rows = own.select(*_result_columns(), *[extra[n].alias(n) for n in names])
        sinks.write_tsv(rows.select(*[F.col(f"`{n}`") for n in (rows.columns if part else reversed(rows.columns))]), f"{path}/{part}")
    rows = results.read_results(spark, f"{path}/*")
    return rows.groupBy("runtime").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("elapsed_cycles").alias("cycles"),
        F.sum("instructions").alias("instructions"),
        F.sum("branch-misses").alias("branch_misses"),
        F.sum("custom28_elapsed_cycles").alias("timer_28"),
        F.count_if(F.col("custom28_timer_name") == "1-URGENT").alias("urgent_timers"),
    )


@query(
    "counter_file",
    "SELECT user_id, "
    + ", ".join(f"CAST(sum(CASE WHEN event_type = '{t}' THEN {cents('value')} END) AS BIGINT) AS {t}" for t in EVENT_TYPES)
    + " FROM events GROUP BY user_id",
)
def counter_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type")) - 1
    lines = table(spark, sf_dir, "events").select(
        "user_id", place.alias("pos"), F.concat_ws(";;", hundredths("value"), "event_type", F.lit("100.00")).alias("line")
    )
    rows = results.counter_rows(lines, "pos", "line", EVENT_TYPES)
    return rows.groupBy("user_id").pivot("event", EVENT_TYPES).agg(F.sum("value"))


@query(
    "counter_files",
    "SELECT 'user' || CAST(user_id % 16 AS VARCHAR) AS run, "
    + ", ".join(f"CAST(sum(CASE WHEN event_type = '{t}' THEN {cents('value')} END) AS BIGINT) AS {t}" for t in EVENT_TYPES)
    + " FROM events GROUP BY 1",
)
def counter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter file for every run, its lines in the order of the events' names; absent counters are not counted."""
    path = new_path(spark, "counters")
    run = F.concat(F.lit("user"), (F.col("user_id") % 16).cast("string")).alias("run")
    sums = table(spark, sf_dir, "events").groupBy(run).pivot("event_type", EVENT_TYPES).agg(F.sum(hundredths("value")))
    line = lambda t: F.concat_ws(";;", F.coalesce(F.col(t).cast("string"), F.lit("<not counted>")), F.lit(t), F.lit("100.00%"))
    text = F.array_join(F.array(*[line(t) for t in EVENT_TYPES]), "\n")
    sums.repartition("run").select("run", text.alias("value")).write.partitionBy("run").text(path)
    rows = results.read_counters(spark, path, EVENT_TYPES)
    return rows.select(F.regexp_extract("file", "run=([^/]+)/", 1).alias("run"), *EVENT_TYPES)


@query("load_csvs", "SELECT doc_id, n_chars, source FROM documents WHERE regexp_matches(source, '^src[0-4]$')")
def load_csvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "csvs")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    docs.write.partitionBy("source").csv(path, header=True)
    return results.read_csvs(spark, path, docs.schema, "/source=src[0-4]/")


SQL_LINES = """SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line_no,
    unnest(string_split(text, chr(10))) AS line FROM documents"""


@query(
    "text_lines",
    f"SELECT doc_id, line_no, CAST(length(line) AS BIGINT) AS n_chars FROM ({SQL_LINES})",
)
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = logs.lines_of(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return lines.select("doc_id", "line_no", F.length("line").cast("bigint").alias("n_chars"))


@query(
    "long_text_lines",
    "SELECT l_linenumber AS number, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey) AS line_no,"
    " l_orderkey || ' ' || l_partkey || ' ' || l_suppkey AS line FROM lineitem",
)
def long_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log file for each line number, its lines in the order of the keys."""
    path = new_path(spark, "lines")
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    lines = table(spark, sf_dir, "lineitem").select(*keys, F.col("l_linenumber").alias("number"), F.concat_ws(" ", *keys).alias("line"))
    # A file a number: the rows of one are in one task, sorted.
    placed = lines.repartition("number").sortWithinPartitions("number", *keys).select("number", "line")
    placed.write.partitionBy("number").text(path)
    number = F.regexp_extract("file", "number=([0-9]+)", 1).cast("int").alias("number")
    return logs.read_long_lines(spark, path).select(number, "line_no", "line")


@query(
    "profiler_report",
    f"""SELECT l_returnflag || l_linestatus AS symbol, count(*) AS n,
       CAST(sum({cents("l_extendedprice")}) AS BIGINT) AS effective, CAST(sum({cents("l_tax")}) AS BIGINT) AS wait,
       count(*) FILTER (l_linenumber = 1) AS n_with_module FROM lineitem GROUP BY 1""",
)
def profiler_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "profiler")
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("Function / Call Stack"),
        F.col("l_extendedprice").alias("Effective Time"),
        F.col("l_tax").alias("MPI Busy Wait Time"),
        F.col("l_linenumber").alias("Module"),
    )
    # One report has its columns the other way round and one more of them.
    lines.filter("Module <> 1").drop("Module").write.csv(f"{path}/a", header=True)
    lines.filter("Module = 1").select(*reversed(lines.columns)).write.csv(f"{path}/b", header=True)
    return logs.read_profiler(spark, f"{path}/*").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(hundredths("effective_time")).alias("effective"),
        F.sum(hundredths("wait_time")).alias("wait"),
        F.count("Module").alias("n_with_module"),
    )


@query(
    "placement_file",
    f"""SELECT {sql_div("c_custkey", 16)} AS process, count(*) AS n, min(c_custkey) AS first_rank,
       max(c_custkey) AS last_rank FROM customer GROUP BY 1""",
)
def placement_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "placement")
    line = F.concat_ws(":", F.col("c_custkey"), F.expr("c_custkey div 16"))
    table(spark, sf_dir, "customer").select(line).write.text(path)
    return logs.read_placement(spark, path).groupBy("process").agg(
        F.count(F.lit(1)).alias("n"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank")
    )


@query(
    "placement_grid_file",
    f"""SELECT {sql_div("c_custkey", 16)} AS node, c_custkey AS rank,
        CAST(row_number() OVER (PARTITION BY c_custkey // 16 ORDER BY c_custkey) - 1 AS INT) AS position FROM customer
        WHERE {sql_div("c_custkey", 16)} < (SELECT max({sql_div("c_custkey", 16)}) FROM customer)""",
)
def placement_grid_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid file of 16 ranks a node; a comment before each node is passed over."""
    path = new_path(spark, "grid")
    node = F.expr("c_custkey div 16")
    ranks = table(spark, sf_dir, "customer").select("c_custkey", node.alias("node"))
    last = ranks.agg(F.max("node")).first()[0]
    ranks = ranks.filter(F.col("node") < last)
    listed = ranks.groupBy("node").agg(F.array_sort(F.collect_list("c_custkey")).alias("ranks"))
    text = F.concat(F.lit("# node "), F.col("node"), F.lit("\n"), F.array_join(F.col("ranks").cast("array<string>"), ", "))
    listed.orderBy("node").coalesce(1).select(text.alias("value")).write.text(path)
    return logs.read_grid(spark, path)


@query(
    "timer_intervals_ns",
    f"""SELECT CAST(user_id AS BIGINT) AS thread_rank, event_type AS timer_name, count(*) AS n,
       CAST(sum({cents("value")} * 10) AS BIGINT) AS duration_ns, min((epoch_us(ts) - {ORIGIN}) * 1000) AS first_start_ns,
       min(epoch_us(ts) // 1000000) AS first_second FROM events GROUP BY user_id, event_type""",
)
def timer_intervals_ns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "intervals")
    start = (micros("ts") - ORIGIN) * 1000
    in_layout(
        table(spark, sf_dir, "events"),
        schemas.TIMER_INTERVALS_NS,
        thread_rank=F.col("user_id"),
        timer_name=F.col("event_type"),
        start_ns_from_beginning=start,
        end_ns_from_beginning=start + hundredths("value") * 10,
        duration_ns=hundredths("value") * 10,
        thread_comm_partner_rank=F.lit(-1),
        sequence_number=F.col("event_id"),
        program_origin_sec=F.call_function("div", micros("ts"), F.lit(1000000)),
        program_origin_nsec=micros("ts") % 1000000 * 1000,
    ).write.csv(path, header=True)
    return stats.read_intervals_ns(spark, path).groupBy(F.col("thread_rank").cast("bigint").alias("thread_rank"), "timer_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("duration_ns").alias("duration_ns"),
        F.min("start_ns_from_beginning").alias("first_start_ns"),
        F.min("program_origin_sec").alias("first_second"),
    )


@query(
    "payload_generator",
    """SELECT event_id, CAST((event_id // 1000 + 1) * 100000 + user_id * 100 + event_id % 1000 AS BIGINT) AS positional,
       CAST((event_id // 1000 + 1) * 8 + user_id * 4 + event_id % 1000 AS BIGINT) AS small,
       CAST(floor((event_id // 1000 + 1) * CAST(1.3 AS DOUBLE) + user_id + event_id % 1000) AS BIGINT) AS tiny,
       round((event_id // 1000 + 1) * CAST(1.00000001 AS DOUBLE) + user_id * CAST(1.001001 AS DOUBLE)
             + (event_id % 1000) * CAST(1.000001 AS DOUBLE), 8) AS floating FROM events""",
)
def payload_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = (F.expr("event_id div 1000"), F.col("user_id"), F.col("event_id") % 1000)
    values = [payload_value(*where, mode).alias(mode) for mode in ("positional", "small", "tiny")]
    floating = F.round(payload_value(*where, "floating"), 8).alias("floating")
    return table(spark, sf_dir, "events").select("event_id", *values, floating)


@query("append_runs", SQL_RESULTS)
def append_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "appended")
    orders = table(spark, sf_dir, "orders")
    sinks.append_results(_results(orders.filter("o_orderstatus = 'F'")), path)
    sinks.append_results(_results(orders.filter("o_orderstatus <> 'F'")), path)
    return _by_config(spark.read.parquet(path))


@query("append_runs_once", SQL_RESULTS)
def append_runs_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs appended again, and a try that failed before its record was written, change nothing."""
    path = new_path(spark, "runs")
    rows = _results(table(spark, sf_dir, "orders"))
    rows.limit(100).write.parquet(f"{path}/parts/part=p0")
    for run in ("F", "O", "F", "P", "O"):
        commits.append_run(rows.filter(F.col("runtime") == run), path, run)
    return _by_config(commits.read_runs(spark, path, rows.schema))


@query(
    "combined_refresh",
    f"""SELECT CAST(o_orderkey % 3 AS VARCHAR) AS grp, count(*) AS n, CAST(sum({cents("o_totalprice")}) AS BIGINT) AS cycles,
        CASE WHEN o_orderkey % 3 = 1 THEN '0 1' ELSE '0' END AS written_in FROM orders
        WHERE o_orderstatus = 'F' OR o_orderkey % 3 = 1 GROUP BY ALL""",
)
def combined_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups of result files combined; then one gets another file, and only that is read and written again."""
    path = new_path(spark, "refresh")
    orders = table(spark, sf_dir, "orders").withColumn("grp", F.col("o_orderkey") % 3)
    rows = orders.select(*_result_columns(), "grp", (F.col("o_orderstatus") == "F").alias("early"))

    def bring_up_to_date() -> list[str]:
        read = lambda files: results.read_results(spark, files, keep_file=True).select("elapsed_cycles", "_file")
        return commits.refresh(spark, f"{path}/in/*/*/*.csv", "/in/([^/]+)/", read, f"{path}/out")[0]

    for grp in range(3):
        sinks.write_tsv(rows.filter(f"grp = {grp} AND early").drop("grp", "early"), f"{path}/in/{grp}/early")
    written = [bring_up_to_date()]
    sinks.write_tsv(rows.filter("grp = 1 AND NOT early").drop("grp", "early"), f"{path}/in/1/late")
    written += [bring_up_to_date(), bring_up_to_date()]
    rounds = F.concat_ws(" ", *[F.when(F.col("grp").isin(*w), F.lit(str(i))) for i, w in enumerate(written) if w])
    return commits.read_combined(spark, f"{path}/out").groupBy("grp", rounds.alias("written_in")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("elapsed_cycles").alias("cycles")
    )


@query(
    "combined_tsv",
    f"""SELECT form, runtime, config, n, cycles FROM ({SQL_RESULTS})
        CROSS JOIN (SELECT unnest(['tsv', 'tsv_bz2']) AS form)""",
)
def combined_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "combined")
    sinks.write_combined(_results(table(spark, sf_dir, "orders")), path)
    forms = [
        _by_config(results.read_results(spark, f"{path}/{form}")).withColumn("form", F.lit(form))
        for form in ("tsv", "tsv_bz2")
    ]
    return forms[0].unionByName(forms[1])


PRIORITY_CLASSES = {"send": ["1-URGENT"], "recv": ["2-HIGH"], "comm_other": ["3-MEDIUM"]}
SQL_MODE = """CASE o_orderpriority WHEN '1-URGENT' THEN 'send' WHEN '2-HIGH' THEN 'recv'
    WHEN '3-MEDIUM' THEN 'comm_other' ELSE 'compute' END"""


@query(
    "classed_rows",
    f"""SELECT {SQL_MODE} AS mode, o_orderpriority AS symbol, count(*) AS n,
        CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1, 2""",
)
def classed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "classed")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("symbol"))
    sinks.write_classed(with_class(rows, "symbol", PRIORITY_CLASSES), path)
    back = spark.read.csv(path, schema="o_orderkey bigint, symbol string, mode string", header=True)
    return back.groupBy("mode", "symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


SQL_CLASS = """CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END"""


@query(
    "classed_listing",
    f"""SELECT 0 AS place, '"o_orderkey","symbol","mode"' AS line UNION ALL
        SELECT row_number() OVER (ORDER BY {SQL_CLASS}, o_orderkey),
        '"' || o_orderkey || '","' || o_orderpriority || '","' || {SQL_MODE} || '"' FROM orders""",
)
def classed_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "listing")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("symbol"))
    sinks.write_class_listing(
        with_class(rows, "symbol", PRIORITY_CLASSES), path, [*PRIORITY_CLASSES, "compute"], ["o_orderkey"]
    )
    # Files by name, then lines: the listing as it would be put together.
    part = F.regexp_extract("file", "part-([0-9]+)", 1).cast("bigint")
    lines = logs.read_long_lines(spark, path).select(part.alias("part"), "line_no", "line")
    return row_number(lines, [], ["part", "line_no"], "place", start=0).select("place", "line")


@query(
    "rank_cpu_map",
    """SELECT lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(4, length(CAST(s_suppkey AS VARCHAR))) AS INT), '0') AS thread_rank,
       s_name AS thread_name, s_nationkey AS cpu_number, 'node' || CAST(s_suppkey % 7 AS VARCHAR) AS hostname FROM supplier""",
)
def rank_cpu_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "rankmap")
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("thread_rank"),
        F.col("s_name").alias("thread_name"),
        F.col("s_nationkey").alias("cpu_number"),
        F.concat(F.lit("node"), F.col("s_suppkey") % 7).alias("hostname"),
    )
    sinks.write_rank_map(rows, path)
    layout = "thread_rank string, thread_name string, cpu_number int, hostname string"
    return spark.read.csv(path, schema=layout, header=True)


@query(
    "matrix_tsv",
    "SELECT l_returnflag AS wait_symbol, "
    + ", ".join(f"count(CASE WHEN l_linenumber = {i} THEN 1 END) AS line_{i}" for i in range(1, 8))
    + " FROM lineitem GROUP BY l_returnflag",
)
def matrix_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "matrix")
    symbols = [f"line_{i}" for i in range(1, 8)]
    pairs = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("wait_symbol"), F.concat(F.lit("line_"), F.col("l_linenumber")).alias("symbol")
    ).agg(F.count(F.lit(1)).alias("n"))
    sinks.write_matrix(coincidence_matrix(pairs, symbols), path)
    layout = "wait_symbol string, " + ", ".join(f"{s} bigint" for s in symbols)
    return spark.read.csv(path, schema=layout, sep="\t", header=True)


@query(
    "experiment_tables",
    f"""SELECT n_name AS experiment, count(DISTINCT c_custkey) AS n_runs, count(*) AS n_rank_rows,
        CAST(sum({cents("o_totalprice")}) AS BIGINT) AS cycles
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def experiment_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "experiment")
    experiments = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("experiment_id"), "n_name")
    runs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("run_id"), F.col("c_nationkey").alias("experiment_id")
    )
    ranks = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run_id"), hundredths("o_totalprice").alias("cycles")
    )
    sinks.write_experiment(experiments, runs, ranks, path)
    experiments, runs, ranks = sinks.read_experiment(spark, path)
    # One row per run before the join, however many ranks a run has.
    per_run = ranks.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cycles").alias("cycles"))
    joined = star(experiments, runs, per_run, "experiment_id", "run_id")
    return joined.groupBy(F.col("n_name").alias("experiment")).agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum("n").alias("n_rank_rows"), F.sum("cycles").alias("cycles")
    )

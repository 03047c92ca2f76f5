"""Profiler reports, sanitizer and heap logs, thread backtraces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.functions.ratios import percent
from rankflow.plans import cut, row_number, running_sum

HEAP_LINE = r"mem_heap_B=(\d+)"
# Debugger backtraces: a thread's head line, and a frame with its function, source file and line number.
STACK_HEADER = r"^Thread [0-9]+ \(Thread 0x[0-9a-f]+ \(LWP [0-9]+\)\):\s*$"
STACK_FRAME = r"^#[0-9]+ +(?:0x[0-9a-f]+ in +)?(\S.*) \(.*\) at (\S.*):([0-9]+)\s*$"
WAIT_SYMBOLS = "DequeueWaitSpinWhileEmpty|EnqueueWaitBlockingThisOnly"

SUM_THRESHOLD = 0.3


def communication_symbols(runtime: str = "") -> dict[str, list[str]]:
    """Symbols of each communication class; ``runtime`` is the class prefix of the runtime under test."""
    # Symbol names of the report classes.
    return {
        "send": [
            "process_channel_v4::ProcessChannel::EnqueueWaitBlockingThisOnly",
            "UntypedProducerConsumerQueue::writeAndCopyBuf",
            "memcpyAVX512F@",
            "MPI_Isend",
            "MPID_Isend",
        ],
        "recv": [
            "process_channel_v4::ProcessChannel::FrontMessage",
            "process_channel_v4::ProcessChannel::FinalizeMessageReceive",
            "UntypedProducerConsumerQueue::frontPtr",
            "RecvChannel::Wait",
            "MPI_Irecv",
            "MPID_Irecv",
        ],
        "comm_other": [
            "x86_pause_instruction",
            "std::__atomic_base<unsigned int>::load",
            f"{runtime}Process::Barrier",
            "std::__atomic_base<int>::load",
            "GNI_CqGetEvent.part.5",
            "GNI_SmsgGetNextWTag",
            "MPIDU_Sched_progress",
            "GNII_DlaProgress",
            "GNI_CqGetEvent",
            "MPID_nem_gni_check_localCQ",
            "MPIDU_Sched_are_pending",
            "MPIDI_CH3I_Progress",
            "MPI_Wait",
            "MPID_nem_gni_complete_rdma_put",
            "MPID_nem_gni_complete_send",
            "MPID_nem_gni_ctrl_send_smsg",
            "MPID_nem_gni_datagram_poll",
            "MPID_nem_gni_iSendContig_start",
            "MPID_nem_gni_lmt_initiate_lmt",
            "MPID_nem_gni_poll",
            "MPID_nem_gni_process_ch3_pkt_w_data",
            "MPID_nem_gni_progress_lmt_start_send",
            "MPID_nem_gni_push_sends",
            "MPID_Request_complete",
            "MPID_Request_create",
            "MPID_Request_release",
            "MPIR_Wait_impl",
            "MPIU_cray_trInitBytesOn",
            "MPIU_Handle_obj_alloc_unsafe",
            "MPL_cray_trInitBytesOn",
            "PMPI_Comm_get_attr",
        ],
    }


def match_lines(lines: DataFrame, line: str, pattern: str, names: list[str]) -> DataFrame:
    """Fields of the lines that match; other lines are skipped. An empty name drops its field."""
    hits = lines.filter(F.col(line).rlike(pattern))
    fields = [F.trim(F.regexp_extract(line, pattern, i)).alias(n) for i, n in enumerate(names, 1) if n]
    return hits.select(*[c for c in lines.columns if c != line], *fields)


def profile_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """Rows of a profile report: percentage, command, shared object, symbol.

    A row is ``percent%,command,object,[kind] symbol``; lines of another form are skipped.
    """
    row = F.col(line)
    head, tail = F.split(F.substring_index(row, ",[", 1), ",", 3), F.substring_index(row, "]", -1)
    number = F.rtrim(F.ltrim(F.get(head, F.lit(0))))
    good = row.contains(",[") & row.contains("]") & (F.size(head) == 3) & number.rlike("^[0-9]+[.][0-9]+%$")
    return lines.filter(good).select(
        *[c for c in lines.columns if c != line],
        F.rtrim(F.substring_index(number, "%", 1)).cast("double").alias("percent"),
        F.trim(F.get(head, F.lit(1))).alias("command"),
        F.trim(F.get(head, F.lit(2))).alias("shared_object"),
        F.trim(tail).alias("symbol"),
    )


def profile_summary(
    rows: DataFrame, symbol: str, report: str, share: str, threshold: float = SUM_THRESHOLD
) -> DataFrame:
    """Least, mean and greatest percentage over the reports that contain a symbol, if their sum is large enough."""
    per_report = rows.groupBy(symbol, report).agg(F.sum(share).alias("_p"))
    out = per_report.groupBy(symbol).agg(
        F.min("_p").alias("min_percent"),
        F.avg("_p").alias("mean_percent"),
        F.max("_p").alias("max_percent"),
        F.count(F.lit(1)).alias("n_reports"),
        F.sum("_p").alias("_sum"),
    )
    return out.filter(F.col("_sum") >= threshold).drop("_sum")


def with_class(rows: DataFrame, symbol: str, classes: dict[str, list[str]], rest: str = "compute") -> DataFrame:
    """Add ``mode``: the class that lists the symbol; unlisted and null symbols are ``rest``."""
    mode = F.coalesce(*[F.when(F.col(symbol).isin(*names), label) for label, names in classes.items()], F.lit(rest))
    return rows.withColumn("mode", mode)


def class_rollup(rows: DataFrame, mode: str, busy: str, wait: str) -> DataFrame:
    """Seconds, waits, their sum and percentage of the whole per class, with a TOTAL row."""
    # The roll-up and the total see one row per class, not the report's rows.
    classes = rows.groupBy(mode).agg(F.sum(busy).alias("_b"), F.sum(wait).alias("_w"))
    sums = classes.rollup(mode).agg(F.grouping(mode).alias("_all"), F.sum("_b").alias("busy"), F.sum("_w").alias("wait"))
    both = F.col("busy") + F.col("wait")
    whole = F.max(F.when(F.col("_all") == 1, both)).over(Window.partitionBy(F.lit(0)))
    return sums.select(
        F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(mode)).alias("class"),
        "busy",
        "wait",
        both.alias("total"),
        F.round(percent(both, whole), 1).alias("percent"),
    )


def leak_totals(lines: DataFrame, line: str = "line") -> DataFrame:
    """Leaked bytes and allocations over all sanitizer summaries, one line of eight words a process."""
    words = F.split(F.col(line), " ")
    word = lambda i: F.get(words, F.lit(i))
    shape = F.concat_ws(" ", *[word(i) for i in (0, 1, 3, 4, 5, 7)])
    # Fixed value: the words of a summary around its two numbers.
    summary = (F.size(words) == 8) & (shape == "SUMMARY: AddressSanitizer: byte(s) leaked in allocation(s).")
    counted = [word(i).try_cast("bigint").alias(n) for i, n in ((2, "bytes"), (6, "allocations"))]
    rows = lines.filter(summary).select(*counted).filter("bytes IS NOT NULL AND allocations IS NOT NULL")
    return rows.agg(
        F.count(F.lit(1)).alias("n_processes"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("leaked_bytes"),
        F.coalesce(F.sum("allocations"), F.lit(0)).alias("leaked_allocations"),
    )


def heap_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """Heap sizes of the snapshots."""
    rows = match_lines(lines, line, HEAP_LINE, ["heap_bytes"])
    return rows.withColumn("heap_bytes", F.col("heap_bytes").cast("bigint"))


def heap_footprint(rows: DataFrame, file: list[str], heap: str, by: list[str] | None = None) -> DataFrame:
    """Greatest heap of each file, then the sum of those."""
    peaks = rows.groupBy(*(by or []), *file).agg(F.max(heap).alias("_peak"))
    return peaks.groupBy(*(by or [])).agg(F.sum("_peak").alias("footprint"), F.count(F.lit(1)).alias("n_files"))


def nth_line_numbers(lines: DataFrame, n: int, line_no: str = "line_no", line: str = "line") -> DataFrame:
    """All numbers found in line ``n`` of each file."""
    numbers = F.regexp_extract_all(F.col(line), F.lit("[0-9.]+"), F.lit(0))
    return lines.filter(F.col(line_no) == n).withColumn("numbers", numbers).drop(line, line_no)


def line_counts(lines: DataFrame, file: list[str], threshold: int = 55) -> DataFrame:
    """Lines per file; more than ``threshold`` means the file reports errors."""
    counts = lines.groupBy(*file).agg(F.count(F.lit(1)).alias("n_lines"))
    return counts.withColumn("has_errors", F.col("n_lines") > threshold)


def files_missing_line(lines: DataFrame, file: list[str], line: str, pattern: str) -> DataFrame:
    """Files in which no line matches."""
    hits = lines.groupBy(*file).agg(F.max(F.col(line).rlike(pattern)).alias("_hit"))
    return hits.filter(~F.coalesce("_hit", F.lit(False))).select(*file)


def stack_frames(lines: DataFrame, file_filter: str, wait: str = WAIT_SYMBOLS, **limits: int) -> DataFrame:
    """The counted frame of each backtrace: ``(file, stack, symbol, waiting)`` in file order.

    ``lines`` has ``(file, line_no, line)``.  A backtrace counts at its topmost
    frame whose source file matches ``file_filter``.  It is waiting if that
    frame or a frame above it waits; a backtrace without a matching frame hands
    its waiting state on to the next one.
    """
    header = F.col("line").rlike(STACK_HEADER)
    name = F.trim(F.regexp_extract("line", STACK_FRAME, 1))
    parsed = lines.filter(header | F.col("line").rlike(STACK_FRAME)).select(
        "file", "line_no", header.cast("bigint").alias("_head"), name.alias("symbol"),
        F.regexp_extract("line", STACK_FRAME, 2).rlike(file_filter).alias("_hit"), name.rlike(wait).alias("_wait"),
    )
    # Written, because numbering reads it more than once and the text is parsed only once this way.
    marked = running_sum(cut(parsed, "frames"), ["file"], ["line_no"], {"_stack": "_head"}, **limits)
    frames = marked.filter("_head = 0 AND _stack > 0")
    hit_line = F.when(F.col("_hit"), F.col("line_no"))
    stacks = frames.groupBy("file", "_stack").agg(
        F.min(hit_line).alias("_at"),
        F.min_by(F.when(F.col("_hit"), F.col("symbol")), hit_line).alias("symbol"),
        F.min(F.when(F.col("_wait"), F.col("line_no"))).alias("_waits_at"),
    )
    counted = stacks.withColumns({
        "_counted": F.col("_at").isNotNull().cast("bigint"),
        "_waiting": F.col("_waits_at").isNotNull() & (F.col("_at").isNull() | (F.col("_waits_at") <= F.col("_at"))),
    })
    placed = running_sum(counted, ["file"], ["_stack"], {"stack": "_counted"}, inclusive=False, **limits)
    out = placed.groupBy("file", "stack").agg(F.max("symbol").alias("symbol"), F.max("_waiting").alias("waiting"))
    return out.filter(F.col("symbol").isNotNull())


def symbol_counts(frames: DataFrame, symbol: str = "symbol") -> DataFrame:
    """How often each symbol is the counted frame."""
    return frames.groupBy(symbol).agg(F.count(F.lit(1)).alias("n"))


def sections(df: DataFrame, file: list[str], order: list[str], size: int, **limits: int) -> DataFrame:
    """Section number of every row: ``size`` consecutive rows of a file form one."""
    numbered = row_number(df, file, order, "_n", start=0, **limits)
    return numbered.withColumn("section", F.call_function("div", F.col("_n"), F.lit(size))).drop("_n")


def coincidences(
    sectioned: DataFrame, file: list[str], order: str, symbol: str, waiting: str | Column, size: int
) -> DataFrame:
    """What other threads do while one waits: ``(wait_symbol, symbol, n)`` over the full sections.

    The first waiting row of a section names it, ``Unknown`` if there is none;
    waiting rows are not counted.  A section has ``size`` rows.
    """
    waiting = F.col(waiting) if isinstance(waiting, str) else waiting
    whole = Window.partitionBy(*file, "section")
    in_order = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = sectioned.withColumn("_waiting", waiting)
    rows = rows.withColumns({
        "wait_symbol": F.first(F.when(F.col("_waiting"), F.col(symbol)), ignorenulls=True).over(in_order),
        "_n": F.count(F.lit(1)).over(whole),
    })
    others = rows.filter((F.col("_n") == size) & ~F.col("_waiting")).fillna("Unknown", ["wait_symbol"])
    return others.groupBy("wait_symbol", F.col(symbol).alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


def coincidence_matrix(pairs: DataFrame, symbols: list[str]) -> DataFrame:
    """One column per symbol, 0 where two never coincide; a symbol that is not listed is an error."""
    unlisted = F.raise_error(F.concat(F.lit("symbol not listed: "), F.col("symbol"))).cast("string")
    pairs = pairs.withColumn("symbol", F.when(F.col("symbol").isin(symbols), F.col("symbol")).otherwise(unlisted))
    return pairs.groupBy("wait_symbol").pivot("symbol", symbols).agg(F.sum("n")).fillna(0, symbols)

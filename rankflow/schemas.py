"""Explicit schemas of every file layout; nothing is inferred.

Producers put a product prefix before some JSON field names.  ``prefix`` is
that text: the readers look for ``<prefix>thread_rank`` and return
``thread_rank``.
"""

from __future__ import annotations

from pyspark.sql import types as T

CUSTOM_TIMERS = 28
RUN_ARGS = 40

PREFIXED = ("thread_rank", "thread_name", "run_unique_id")


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def _custom(*measures: str, kind: T.DataType | None = None) -> list[tuple[str, T.DataType]]:
    out: list[tuple[str, T.DataType]] = []
    for i in range(CUSTOM_TIMERS):
        out.append((f"custom{i}_timer_name", T.StringType()))
        out += [(f"custom{i}_{m}", kind or T.LongType()) for m in measures]
    return out


def rank_stats_cycles(prefix: str = "", unsigned: bool = False) -> T.StructType:
    """Rank statistics document, cycle counts; ``unsigned`` also holds counts above 2**63."""
    count = T.DecimalType(20, 0) if unsigned else T.LongType()
    return _struct(
        ("hostname", T.StringType()),
        (f"{prefix}thread_rank", T.IntegerType()),
        (f"{prefix}thread_name", T.StringType()),
        ("pid", T.IntegerType()),
        ("parent_pid", T.IntegerType()),
        ("created_at", T.StringType()),
        (f"{prefix}run_unique_id", T.StringType()),
        ("json_stats_dir", T.StringType()),
        ("elapsed_cycles", count),
        *_custom("elapsed_cycles", kind=count),
        ("cpu_number", T.IntegerType()),
        ("stats_filename", T.StringType()),
    )


def rank_stats_ns(prefix: str = "") -> T.StructType:
    """Rank statistics document, three clocks in nanoseconds."""
    return _struct(
        ("hostname", T.StringType()),
        (f"{prefix}thread_rank", T.IntegerType()),
        ("created_at", T.StringType()),
        (f"{prefix}run_unique_id", T.StringType()),
        ("elapsed_ns_monotonic", T.LongType()),
        ("elapsed_ns_process_cpu", T.LongType()),
        ("elapsed_ns_thread_cpu", T.LongType()),
        *_custom("elapsed_ns_monotonic", "elapsed_ns_process", "elapsed_ns_thread"),
        ("memory_footprint_bytes", T.LongType()),
        ("cpu_number", T.IntegerType()),
        ("stats_filename", T.StringType()),
    )


TIMER_INTERVALS_CYCLES = _struct(
    ("thread_rank", T.IntegerType()),
    ("timer_name", T.StringType()),
    ("start_cycles_from_beginning", T.LongType()),
    ("end_cycles_from_beginning", T.LongType()),
    ("duration_cycles", T.LongType()),
    ("thread_comm_partner_rank", T.IntegerType()),
    ("sequence_number", T.LongType()),
    ("object_ptr", T.StringType()),
    ("total_num_this_timer", T.IntegerType()),
    ("program_origin_cycles", T.LongType()),
)

TIMER_INTERVALS_NS = _struct(
    ("thread_rank", T.IntegerType()),
    ("timer_name", T.StringType()),
    ("start_ns_from_beginning", T.LongType()),
    ("end_ns_from_beginning", T.LongType()),
    ("duration_ns", T.LongType()),
    ("thread_comm_partner_rank", T.IntegerType()),
    ("sequence_number", T.LongType()),
    ("total_num_this_timer", T.IntegerType()),
    ("program_origin_sec", T.LongType()),
    ("program_origin_nsec", T.LongType()),
)

# The names are the header line, which the reader checks.
COMM_TRACE = _struct(
    ("direction", T.StringType()),
    ("from", T.IntegerType()),
    ("to", T.IntegerType()),
    ("channel_endpoint_id", T.IntegerType()),
    ("seq_num", T.LongType()),
    ("channel_type", T.StringType()),
    ("mpi_called", T.StringType()),
)

COMM_TRACE_WIDE = _struct(
    ("file:line", T.StringType()),
    ("function", T.StringType()),
    ("direction", T.StringType()),
    ("sender_rank", T.IntegerType()),
    ("receiver_rank", T.IntegerType()),
    ("msg_len", T.LongType()),
    ("datatype", T.LongType()),
    ("tag", T.IntegerType()),
    ("datatype_bytes", T.IntegerType()),
    ("total_bytes", T.LongType()),
    ("function_subtype", T.StringType()),
    ("channel_type", T.StringType()),
    ("channel_endpoint_id", T.IntegerType()),
    ("mpi_called", T.StringType()),
)

CALL_TRACE = _struct(
    ("file_line", T.StringType()),
    ("function", T.StringType()),
    ("call", T.StringType()),
    ("sender_rank", T.IntegerType()),
    ("receiver_rank", T.IntegerType()),
    ("msg_len", T.LongType()),
    ("datatype", T.LongType()),
    ("tag", T.IntegerType()),
    ("datatype_bytes", T.IntegerType()),
)

CHANNELS = _struct(
    ("channel_type", T.StringType()),
    ("process", T.IntegerType()),
    ("endpoint_direction", T.StringType()),
    ("send_process", T.IntegerType()),
    ("recv_process", T.IntegerType()),
    ("send_rank", T.IntegerType()),
    ("recv_rank", T.IntegerType()),
)



def channel_headers(prefix: str = "") -> tuple[str, ...]:
    """Header names of the channel list's columns, in the order of ``CHANNELS``."""
    # Fixed values.
    return (
        "channel type", "mpi rank", "endpoint direction (MPI)", "send mpi rank", "recv mpi rank",
        f"{prefix}send rank", f"{prefix}recv rank",
    )


WAIT_LOG = _struct(
    ("wait_call_s", T.LongType()),
    ("wait_call_ns", T.LongType()),
    ("pending_dequeues_this_thread", T.IntegerType()),
    ("process_channel", T.StringType()),
)

CHUNK_LOG = _struct(
    ("executing_rank", T.IntegerType()),
    ("thread_type", T.StringType()),
    ("owner_rank", T.IntegerType()),
    ("task_name", T.StringType()),
    ("execution_mode", T.StringType()),
    ("start_chunk", T.IntegerType()),
    ("end_chunk", T.IntegerType()),
    ("min_idx", T.LongType()),
    ("max_idx", T.LongType()),
)


def results(counters: tuple[str, ...] = (), prefix: str = "") -> T.StructType:
    """Results table: common columns, one rank's columns, custom timers, counters."""
    text, number, long = T.StringType(), T.IntegerType(), T.LongType()
    common = [
        ("date", text), ("optimization", text), ("os", text), ("runtime", text),
        ("config_unique_id", text), ("run_num_for_config", number), ("procs", number),
        ("threads", number), ("omp_num_threads", number), ("total_threads", number),
        ("process_channel_version", number), ("pc_buffered_msg_size", number),
        ("use_jemalloc", number), ("use_asmlib", number), ("run_args", text), ("git_hash", text),
        ("branch", text), ("test_dir", text), ("bin_name", text), ("numactl_desc", text),
        ("numactl_cpus", text), ("topology", text), ("class", text), ("cxxflags", text), ("cflags", text),
    ]
    per_rank = [
        ("heap_max_total_bytes", long), ("extra_description", text), (f"{prefix}thread_rank", number),
        (f"{prefix}run_unique_id", text), ("hostname", text), ("stats_filename", text), ("elapsed_cycles", long),
    ]
    args = [(f"run_args_{i}", text) for i in range(RUN_ARGS)]
    events = [(name, long) for name in counters]
    return _struct(*common, *args, *per_rank, *_custom("elapsed_cycles"), *events)


PROFILER = _struct(
    ("Function / Call Stack", T.StringType()),
    ("Effective Time", T.DoubleType()),
    ("MPI Busy Wait Time", T.DoubleType()),
)

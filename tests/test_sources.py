"""Literal files of each layout."""

import pytest
from pyspark.sql import functions as F

from rankflow import schemas
from rankflow.operators import profiles
from rankflow.sources import logs, results, sinks, stats, traces


def test_rank_stats(spark, write):
    write("s/stats_a_rank_0.json", """{
  "hostname": "node01", "job_thread_rank": 0, "job_thread_name": "p0000m0000t0000", "pid": 11, "parent_pid": 1,
  "created_at": "2024-01-02.03:04:05", "job_run_unique_id": "r1", "elapsed_cycles": 1000,
  "custom0_timer_name": "send", "custom0_elapsed_cycles": 250, "custom1_timer_name": "send",
  "custom1_elapsed_cycles": 300, "cpu_number": 4
}""")
    path = write("s/stats_a_rank_1.json", '{"job_thread_rank": 1, "elapsed_cycles": 0, "cpu_number": 5}')
    df = stats.read_rank_stats(spark, path, prefix="job_").orderBy("thread_rank")
    first = df.first()
    assert (first.thread_rank, first.thread_name, first.run_unique_id) == (0, "p0000m0000t0000", "r1")
    assert str(first.created_at) == "2024-01-02 03:04:05"
    timers = stats.custom_timers_long(df, ["thread_rank", "elapsed_cycles"])
    assert sorted(tuple(r) for r in timers.collect()) == [(0, 1000, 0, "send", 250), (0, 1000, 1, "send", 300)]


def test_unsigned_cycles(spark, write):
    path = write("u/stats_rank_0.json", '{"thread_rank": 3, "elapsed_cycles": 18446744073709551615}')
    assert int(stats.read_rank_stats(spark, path, unsigned=True).first().elapsed_cycles) == 2**64 - 1


def test_rank_stats_ns_and_union(spark, write):
    path = write("n/stats_rank_0.json", '{"thread_rank": 3, "elapsed_ns_monotonic": 7, "memory_footprint_bytes": 99}')
    ns = stats.read_rank_stats_ns(spark, path)
    both = stats.union_layouts(ns.limit(0).select("hostname", "thread_rank"), ns)
    row = both.first()
    assert (row.thread_rank, row.elapsed_ns_monotonic, row.memory_footprint_bytes) == (3, 7, 99)


def test_intervals(spark, write):
    path = write("i/r3_all_timers.csv", (
        "thread_rank,timer_name,start_cycles_from_beginning,end_cycles_from_beginning,duration_cycles,"
        "thread_comm_partner_rank,sequence_number,object_ptr,total_num_this_timer,program_origin_cycles\n"
        "3,send,10,30,20,-1,0,0x1,2,1000\n3,send,40,45,5,2,1,0x1,2,1000\n"))
    df = stats.read_intervals(spark, path)
    assert df.agg(F.sum("duration_cycles")).first()[0] == 25
    names = ",".join(schemas.TIMER_INTERVALS_NS.fieldNames())
    path = write("j/r3_all_timers.csv", f"{names}\n3,send,10,30,20,-1,0,2,5,6\n")
    assert stats.read_intervals_ns(spark, path).first().program_origin_nsec == 6


def test_comm_trace_checks_its_header(spark, write):
    path = write("t/comm_trace_rank_0.csv", (
        "direction, from, to, channel_endpoint_id, seq_num, channel_type, mpi_called\nsend, 0, 3, 7, 1, process, MPI_NO\n"))
    row = traces.read_comm_trace(spark, path).first()
    assert (row.direction, row.sender_rank, row.receiver_rank, row.mpi_called) == ("send", 0, 3, "MPI_NO")
    bad = write("u/comm_trace_rank_0.csv", "direction, to, from, a, b, c, d\nsend, 0, 3, 7, 1, process, MPI_NO\n")
    with pytest.raises(Exception, match="header"):
        traces.read_comm_trace(spark, bad).collect()


def test_comm_trace_wide(spark, write):
    path = write("t/trace_r0.csv", (
        "file:line, function, direction, sender_rank, receiver_rank, msg_len, datatype, tag, datatype_bytes, "
        "total_bytes, function_subtype, channel_type, channel_endpoint_id, mpi_called \n"
        ", , send, 0, 1, 8, 1275070475, 4, 8, 64, Enqueue, DirectChannel, 2, MPI_YES\n"))
    row = traces.read_comm_trace_wide(spark, path).first()
    assert (row.sender_rank, row.total_bytes, row.mpi_called) == (0, 64, "MPI_YES")


def test_call_trace(spark, write):
    path = write("c/calls.csv", "a.c:10,main,MPI_Isend,0,1,8,1,4,8\na.c:12,main,MPI_Recv,0,1,8,1,4,8\n")
    assert [r.direction for r in traces.read_call_trace(spark, path).orderBy("file_line").collect()] == ["send", "recv"]


def test_other_calls_fail(spark, write):
    with pytest.raises(Exception, match="not a send or receive: MPI_Allreduce"):
        traces.read_call_trace(spark, write("o/calls.csv", "a.c:1,main,MPI_Allreduce,0,1,8,1,4,8\n")).collect()


def test_channels_and_waits(spark, write):
    path = write("ch/channels_p0000.csv", (
        "channel type, mpi rank, endpoint direction (MPI), send mpi rank, recv mpi rank, app send rank, app recv rank\n"
        "process, 0, , 0, 0, 1, 2\ndirect_mpi, 0, send, 0, 1, 1, 9\n"))
    rows = traces.read_channels(spark, path, "app ").orderBy("recv_rank").collect()
    assert [(r.channel_type, r.endpoint_direction, r.recv_rank) for r in rows] == [("process", None, 2), ("direct_mpi", "send", 9)]
    path = write("w/wait_stats_process_0.csv", "wait_call_s, wait_call_ns, pending_dequeues_this_thread, process_channel\n1, 2, 3, 0x9\n")
    assert traces.read_wait_log(spark, path).first().process_channel == "0x9"


def test_chunk_log(spark, write):
    path = write("k/cont_debug_r0001.tsv", (
        "executing rank\tthread type\towner rank\tcont name\texecution mode\tstart chunk\tend chunk\tmin idx\tmax idx\tbacktrace\n"
        "1\tTHIEF\t0\twork\tCHUNK\t2\t2\t128\t191\tmain\tcall 1\n\n"))
    rows = traces.read_chunk_log(spark, path).collect()
    assert len(rows) == 1
    assert (rows[0].owner_rank, rows[0].max_idx, rows[0].backtrace) == (0, 191, "main\tcall 1")


def test_check_trace(spark):
    raw = spark.createDataFrame(
        [("send", "1", "2"), ("recv", "1", "x"), ("peek", "1", "2"), (None, "1", "2")],
        "direction string, sender_rank string, receiver_rank string",
    )
    good, rejects = traces.check_trace(raw)
    assert (good.count(), rejects.count()) == (1, 3)
    with pytest.raises(Exception, match="bad trace row"):
        traces.check_trace(raw, strict=True)[0].collect()


def test_results(spark, tmp_path):
    schema = schemas.results(("cycles:pp", "instructions"), prefix="job_")
    row = {f.name: None for f in schema} | {"runtime": "MPI", "job_thread_rank": 3, "elapsed_cycles": 9, "instructions": 4}
    df = spark.createDataFrame([tuple(row[f.name] for f in schema)], schema)
    sinks.write_tsv(df, str(tmp_path / "r"))
    back = results.read_results(spark, str(tmp_path / "r"), schema, prefix="job_").first()
    assert (back.runtime, back.thread_rank, back.elapsed_cycles, back.instructions) == ("MPI", 3, 9, 4)


def test_counters(spark, write):
    write("p/a.csv", "96100629;;cycles:pp;19.83%;;\n<not counted>;;branches;;\n3554;;page-faults;3.52%\n")
    path = write("p/b.csv", "1;;cycles:pp\n2;;branches\n3;;page-faults\n")
    got = results.read_counters(spark, path, ["cycles", "branches", "faults"]).orderBy("cycles").collect()
    assert [tuple(r)[1:] for r in got] == [(1, 2, 3), (96100629, None, 3554)]


def test_csv_folder(spark, write):
    write("d/one.csv", "a,b\n1,x\n")
    write("d/two.csv", "a,b\n2,y\n")
    path = write("d/note.txt", "no table\n")
    schema = "a int, b string"
    assert results.read_csvs(spark, path, schema).count() == 2
    assert results.read_csvs(spark, path, schema, "two").first().b == "y"
    with pytest.raises(FileNotFoundError):
        results.read_csvs(spark, path, schema, "three")


def test_lines(spark, write):
    path = write("l/a.log", "one\ntwo\n\nfour\n")
    got = [(r.line_no, r.line) for r in logs.read_lines(spark, path).orderBy("line_no").collect()]
    assert got == [(1, "one"), (2, "two"), (3, ""), (4, "four")]


def test_long_lines_across_blocks(spark, write):
    text = "".join(f"line {i} {'x' * (i % 17)}\n" for i in range(5000))
    path = write("l/big.log", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {(r.line_no, r.line) for r in logs.read_long_lines(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == set(enumerate(text.splitlines(), 1))


def test_profiler(spark, write):
    path = write("v/report.csv", '"Function / Call Stack","Effective Time","MPI Busy Wait Time"\n"f(a, b)",1.5,0.5\n')
    assert tuple(logs.read_profiler(spark, path).first()) == ("f(a, b)", 1.5, 0.5)


def test_placement_and_grid(spark, write):
    path = write("m/map", "0:0\n2:0\n1:1\n")
    got = [tuple(r) for r in logs.read_placement(spark, path).orderBy("position").collect()]
    assert got == [(1, 0, 0), (2, 2, 0), (3, 1, 1)]
    with pytest.raises(Exception, match="bad placement line"):
        logs.read_placement(spark, write("b/map", "0-0\n")).collect()
    grid = logs.read_grid(spark, write("g/grid", "# two nodes\n0,1,2\n3,4\n"))
    assert sorted(tuple(r) for r in grid.collect()) == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 3), (1, 1, 4)]


def test_sanitizer_and_heap(spark, write):
    path = write("a/asan.log", (
        "noise\nSUMMARY: AddressSanitizer: 68540 byte(s) leaked in 74 allocation(s).\n"
        "SUMMARY: AddressSanitizer: 10 byte(s) leaked in 1 allocation(s).\n"))
    assert tuple(profiles.leak_totals(logs.read_lines(spark, path)).first()) == (2, 68550, 75)
    write("h/m.1", "snapshot=1\nmem_heap_B=10\nmem_heap_B=40\nmem_heap_extra_B=99\n")
    path = write("h/m.2", "mem_heap_B=7\n")
    heap = profiles.heap_rows(logs.read_lines(spark, path))
    assert tuple(profiles.heap_footprint(heap, ["file"], "heap_bytes").first()) == (47, 2)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "p2", 4, "h"), (1, "p1", 5, "h")], "thread_rank int, thread_name string, cpu_number int, hostname string")
    sinks.write_rank_map(df, str(tmp_path / "map"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "map")).collect()]
    assert "0001,p1,5,h" in lines and "thread_rank,thread_name,cpu_number,hostname" in lines
    sinks.write_classed(df.withColumn("mode", F.lit("send")), str(tmp_path / "classed"))
    assert (tmp_path / "classed" / "mode=send").is_dir()
    sinks.append_results(df, str(tmp_path / "all"))
    sinks.append_results(df, str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "all")).count() == 4
    sinks.write_combined(df, str(tmp_path / "both"))
    assert list((tmp_path / "both" / "tsv_bz2").glob("*.bz2"))


def test_csv_files_bind_by_header(spark, write):
    from rankflow.sources.results import read_csvs

    write("c/one.csv", "a,b\n1,x\n2,y\n")
    path = write("c/two.csv", "b,a\nz,3\n")
    got = read_csvs(spark, path, "a int, b string")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "x"), (2, "y"), (3, "z")]
    write("d/bad.csv", "a,c\n1,x\n")
    with pytest.raises(ValueError, match="columns"):
        read_csvs(spark, write("d/good.csv", "a,b\n1,x\n"), "a int, b string")
    with pytest.raises(Exception, match="MALFORMED|malformed|CANNOT_PARSE|Malformed"):
        read_csvs(spark, write("e/row.csv", "a,b\nnone,x\n"), "a int, b string").collect()


def test_surplus_counters_and_short_chunk_rows_fail(spark, write):
    from rankflow.sources import results, traces

    path = write("k/one.txt", "1;;cycles\n2;;branches\n3;;faults\n")
    with pytest.raises(Exception, match="counter without a name"):
        results.read_counters(spark, path, ["cycles", "branches"]).collect()
    with pytest.raises(Exception, match="short chunk row"):
        traces.read_chunk_log(spark, write("l/log.tsv", "1\tOWNER\t2\n")).collect()


def test_timers_of_any_number(spark):
    from rankflow.sources import stats

    df = spark.createDataFrame([(0, "t", 5)], "thread_rank int, custom31_timer_name string, custom31_elapsed_cycles bigint")
    assert [tuple(r) for r in stats.custom_timers_long(df, ["thread_rank"]).collect()] == [(0, 31, "t", 5)]


def test_results_are_united_by_header(spark, write):
    base = {"runtime": "mpi", "run_unique_id": "r", "thread_rank": 0, "elapsed_cycles": 5}

    def put(name, row):
        return write(f"r/{name}/part.tsv", "\t".join(row) + "\n" + "\t".join(map(str, row.values())) + "\n")

    put("a", base)
    put("b", dict(reversed(list((base | {"elapsed_cycles": 6}).items()))))
    put("c", base | {"elapsed_cycles": 7, "cycles:pp": 70, "custom28_timer_name": "t", "custom28_elapsed_cycles": 9})
    path = put("d", base | {"elapsed_cycles": 8, "branch-misses": "", "cycles:pp": 80}).removesuffix("/d")
    got = results.read_results(spark, f"{path}/*").orderBy("elapsed_cycles").collect()
    assert [(r.runtime, r.run_unique_id, r.thread_rank, r.elapsed_cycles) for r in got] == [("mpi", "r", 0, c) for c in (5, 6, 7, 8)]
    assert [(r["cycles:pp"], r["branch-misses"], r["custom28_elapsed_cycles"], r["custom0_timer_name"]) for r in got] == [
        (None, None, None, None), (None, None, None, None), (70, None, 9, None), (80, None, None, None)]
    put("e", base | {"colour": "red"})
    with pytest.raises(ValueError, match="unknown .'colour'"):
        results.read_results(spark, f"{path}/*")


def test_results_with_bad_headers_and_numbers_fail(spark, write):
    with pytest.raises(ValueError, match="missing .'elapsed_cycles'"):
        results.read_results(spark, write("m/a.tsv", "run_unique_id\tthread_rank\nr\t1\n"))
    with pytest.raises(ValueError, match="repeated .'runtime'"):
        results.read_results(spark, write("n/a.tsv", "runtime\truntime\trun_unique_id\tthread_rank\telapsed_cycles\na\tb\tr\t1\t2\n"))
    one = write("o/a.tsv", "run_unique_id\tthread_rank\telapsed_cycles\nr\t1\tsoon\n")
    two = write("p/b.tsv", "elapsed_cycles\trun_unique_id\tthread_rank\nx\tr\t1\n")
    write("p/a.tsv", "run_unique_id\tthread_rank\telapsed_cycles\nr\t1\t2\n")
    short = write("q/b.tsv", "elapsed_cycles\trun_unique_id\tthread_rank\n1\tr\n")
    write("q/a.tsv", "run_unique_id\tthread_rank\telapsed_cycles\nr\t1\t2\n")
    for path in (one, two, short):
        with pytest.raises(Exception, match="MALFORMED|alformed|CANNOT_PARSE"):
            results.read_results(spark, path).select("elapsed_cycles").collect()


def test_reports_in_another_order(spark, write):
    write("v/b.csv", 'Module,"MPI Busy Wait Time","Function / Call Stack","Effective Time"\nm,0.25,"g(a, b)",2.5\n')
    path = write("v/a.csv", '"Function / Call Stack","Effective Time","MPI Busy Wait Time"\n"f(a, b)",1.5,0.5\n')
    got = [tuple(r) for r in logs.read_profiler(spark, path).orderBy("symbol").collect()]
    assert got == [("f(a, b)", 1.5, 0.5, None), ("g(a, b)", 2.5, 0.25, "m")]
    head = "pending_dequeues_this_thread, process_channel, wait_call_s, wait_call_ns\n"
    assert traces.read_wait_log(spark, write("w/a.csv", head + "3, 0x9, 1, 2\n")).first() == (1, 2, 3, "0x9")
    with pytest.raises(Exception, match="MALFORMED|alformed"):
        traces.read_wait_log(spark, write("x/a.csv", head + "3, 0x9, now, 2\n")).collect()
    with pytest.raises(ValueError, match="missing"):
        traces.read_channels(spark, write("y/a.csv", "channel type, mpi rank\nprocess, 0\n"))
    bad = "direction, from, to, channel_endpoint_id, seq_num, channel_type, mpi_called\nsend, 0, zz, 7, 1, process, MPI_NO\n"
    with pytest.raises(Exception, match="MALFORMED|alformed"):
        traces.read_comm_trace(spark, write("z/a.csv", bad)).collect()


def test_a_run_is_appended_once(spark, tmp_path):
    from rankflow.sources.commits import append_run, read_runs

    path = str(tmp_path / "runs")
    one, two = (spark.createDataFrame([(r, i) for i in range(3)], "run_name string, n int") for r in ("one", "two"))
    one.write.parquet(f"{path}/parts/part=p00")  # a failed try
    assert [append_run(df, path, run) for df, run in ((one, "1"), (one, "1"), (two, "2"), (one, "1"))] == [True, False, True, False]
    for schema in (None, one.schema):
        got = sorted(map(tuple, read_runs(spark, path, schema).collect()))
        assert got == [("one", i) for i in range(3)] + [("two", i) for i in range(3)]
    # Two tries that raced: one of them counts.
    one.write.parquet(f"{path}/parts/part=p01")
    spark.createDataFrame([("1", "p01")], "run string, part string").write.mode("append").parquet(f"{path}/records")
    assert read_runs(spark, path).count() == 6


def test_only_stale_groups_are_written_again(spark, tmp_path):
    from rankflow.sources.commits import read_combined, refresh

    def put(name, rows):
        target = tmp_path / "in" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("a,b\n" + "".join(f"{a},{b}\n" for a, b in rows))
        return target

    def run():
        read = lambda files: spark.read.csv(files, schema="a int, b string", header=True).withColumn("_file", F.col("_metadata.file_path"))
        return refresh(spark, str(tmp_path / "in/*/*.csv"), "/in/([^/]+)/", read, str(tmp_path / "out"))

    def rows():
        return sorted((r.grp, r.a, r.b) for r in read_combined(spark, str(tmp_path / "out")).collect())

    put("01/x.csv", [(1, "p")])
    put("02/x.csv", [(2, "q")])
    gone = put("e5/x.csv", [(3, "r")])
    assert run() == (["01", "02", "e5"], [])
    assert rows() == [("01", 1, "p"), ("02", 2, "q"), ("e5", 3, "r")]
    parts = {p.name for p in (tmp_path / "out" / "parts").glob("part=*")}
    assert run() == ([], []) and {p.name for p in (tmp_path / "out" / "parts").glob("part=*")} == parts
    put("02/y.csv", [(4, "s")])
    assert run() == (["02"], []) and len(list((tmp_path / "out" / "parts").glob("part=*"))) == 2
    assert rows() == [("01", 1, "p"), ("02", 2, "q"), ("02", 4, "s"), ("e5", 3, "r")]
    gone.unlink()
    put("01/x.csv", [(9, "longer")])
    assert run() == (["01"], ["e5"])
    assert rows() == [("01", 9, "longer"), ("02", 2, "q"), ("02", 4, "s")]
    put("01/x.csv", [(8, "longer")])
    put("02/y.csv", [(7, "t")])
    put("03/z.csv", [(6, "u")])
    assert run() == (["01", "02", "03"], [])


def test_one_listing_in_class_order(spark, tmp_path):
    rows = [(i, f'say "{i}"', mode) for i, mode in enumerate(["b", "a", "c"] * 40)]
    df = spark.createDataFrame(rows, "n int, symbol string, mode string").repartition(5)
    sinks.write_class_listing(df, str(tmp_path / "l"), ["c", "a", "b"], ["n"])
    lines = [line for part in sorted((tmp_path / "l").glob("part-*")) for line in part.read_text().splitlines()]
    want = [r for mode in "cab" for r in rows if r[2] == mode]
    assert lines == ['"n","symbol","mode"'] + [f'"{n}","say ""{n}""","{mode}"' for n, _, mode in want]
    with pytest.raises(Exception, match="unknown class b"):
        sinks.write_class_listing(df, str(tmp_path / "m"), ["c", "a"], ["n"])


def test_lines_of_the_tools(spark):
    report = [
        "# Overhead,Command,Object,Symbol", "     3.68%  ,solver@node1,libmpi.so.12.1.1                  ,[.] progress_wait",
        "12.00%,solver,libm,[k] f(int, char[])", "3.68%,solver,libm", " 1.5%,a,b,c,[.] g", "x%,a,b,[.] g",
    ]
    rows = profiles.profile_rows(spark.createDataFrame([(r,) for r in report], "line string"))
    assert [tuple(r) for r in rows.collect()] == [
        (3.68, "solver@node1", "libmpi.so.12.1.1", "progress_wait"), (12.0, "solver", "libm", ")"), (1.5, "a", "b,c", "g")]
    trace = [
        "Thread 4 (Thread 0x7ffff50d9700 (LWP 39252)):", "#0  0x00007ffff7 in poll () from libc.so",
        "#1  0x0000555 in wait_here (n=3, f=0x5 <g>) at src/a.cpp:12", "#2  main (argc=1) at src/main.cpp:3",
        "Thread 3 (Thread 0x7ffff50d9701 (LWP 39253)):", "#0  work (x=1) at src/b.cpp:7", "Thread 9 is not a head line",
    ]
    lines = spark.createDataFrame([("f", i, line) for i, line in enumerate(trace)], "file string, line_no long, line string")
    frames = profiles.stack_frames(lines, "src/", wait="wait_here").orderBy("stack")
    assert [(r.symbol, r.waiting) for r in frames.collect()] == [("wait_here", True), ("work", False)]


def test_headers_and_ranks_are_found_without_sorting_lines_or_holding_each_rank(spark, tmp_path):
    from rankflow.catalog import files
    from rankflow.sources.headed import header_lines

    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f"a{i},b\n" + "".join(f"{j},0\n" for j in range(9, -1, -1)))
    heads = header_lines(spark.read.text(str(tmp_path)))
    assert sorted((r["_file"][-5:], r["head"]) for r in heads.collect()) == [(f"{i}.csv", f"a{i},b") for i in range(3)]
    rows = [(s, r) for s in (3, 20, None) for r in [*range(200), None, -1, -64, -65, 1 << 20]] * 2
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/t/lineitem.parquet")
    got = files.channel_list(spark, f"{tmp_path}/t")
    found, want = {(r.channel_type, r.send_process): (r.n, r.n_recv_ranks) for r in got.collect()}, {}
    for s, r in rows:
        own = "process" if s is not None and r is not None and int(s / 16) == int(r / 16) else "direct_mpi"
        n, ranks = want.get((own, s if s is None else s // 16), (0, frozenset()))
        want[own, s if s is None else s // 16] = (n + 1, ranks | ({r} - {None}))
    assert found == {k: (n, len(ranks)) for k, (n, ranks) in want.items()}
    for df in (heads, got):
        plan = df._jdf.queryExecution().toString()
        assert "SortAggregate" not in plan and "count(distinct" not in plan.lower()

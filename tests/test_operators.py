"""Operators against small literal tables and their stated properties."""

import pytest
from pyspark.sql import functions as F

from rankflow.operators import collectives, experiments, placement, profiles, stencil, tasks, timers, traces


def as_set(df, *columns):
    return {tuple(r) for r in (df.select(*columns) if columns else df).collect()}


def test_reduce_is_the_same_for_any_partitioning(spark):
    df = spark.range(1000).selectExpr("id % 3 AS comm", "id % 5 AS idx", "id AS value")
    ops = {"s": "sum", "lo": "min", "hi": "max"}
    want = as_set(collectives.reduce(df, ["comm"], ops))
    assert as_set(collectives.reduce(df.repartition(17), ["comm"], ops)) == want
    assert as_set(collectives.reduce(df.coalesce(1), ["comm"], ops)) == want


def test_max_of_negative_numbers(spark):
    df = spark.createDataFrame([(0, 0, -2.5), (0, 0, -7.0)], "comm int, idx int, value double")
    assert collectives.reduce_to_root(df, ["comm"], "max", root=3).first() == (0, 3, 0, -2.5)


def test_all_to_all_twice_is_identity(spark):
    df = spark.range(4 * 12).selectExpr("id div 12 AS rank", "id % 12 AS idx", "id AS value")
    there = collectives.all_to_all(df, 3)
    assert as_set(there.filter("rank = 1 AND idx = 2 * 3 + 1"), "value") == {(2 * 12 + 1 * 3 + 1,)}
    assert as_set(collectives.all_to_all(there, 3), "rank", "idx", "value") == as_set(df)
    buffers = collectives.to_buffers(df.withColumn("comm", F.lit(0)), ["comm"])
    assert {tuple(r.buffer) for r in buffers.collect()} == {tuple(range(i, i + 12)) for i in (0, 12, 24, 36)}


def test_a_null_communicator_is_a_group(spark):
    df = spark.createDataFrame([(None, 0, 1), (None, 0, 2), (1, 0, 5)], "comm int, idx int, value int")
    out = collectives.all_reduce(df, ["comm"], {"total": "sum"})
    assert as_set(out, "comm", "value", "total") == {(None, 1, 3), (None, 2, 3), (1, 5, 5)}


def test_broadcast(spark):
    df = spark.createDataFrame([(0, 0, 7), (0, 1, 8), (1, 0, 9)], "comm int, rank int, v int")
    out = collectives.broadcast_root(df, ["comm"], F.col("rank") == 0, ["v"])
    assert as_set(out, "comm", "rank", "root_v") == {(0, 0, 7), (0, 1, 7), (1, 0, 9)}


def test_split(spark):
    df = spark.createDataFrame([(r, r % 3, -r) for r in range(10)], "rank int, color int, key int")
    out = collectives.split(df, "color", "rank")
    sizes = out.groupBy("color").agg(F.count("*").alias("n"), F.max("new_rank").alias("last"), F.count_distinct("new_rank").alias("d"))
    assert sum(r.n for r in sizes.collect()) == 10
    assert all(r.n == r.d == r.last + 1 for r in sizes.collect())
    ignored = collectives.split(df, "color", "rank", key="key").filter("rank = 9").first().new_rank
    honored = collectives.split(df, "color", "rank", key="key", honor_key=True).filter("rank = 9").first().new_rank
    assert (ignored, honored) == (3, 0)
    with pytest.raises(Exception, match="negative color"):
        collectives.split(df.withColumn("color", -F.col("color")), "color", "rank").collect()


def plain_stencil(a, iterations):
    for _ in range(iterations):
        t = [x * 0.5 + 1 for x in a]
        a = [a[0]] + [(t[i - 1] + t[i] + t[i + 1]) / 3.0 for i in range(1, len(a) - 1)] + [a[-1]]
    return a


@pytest.mark.parametrize("bits, halo, iterations", [(3, 2, 5), (4, 8, 3), (14, 8, 4)])
def test_stencil_is_independent_of_buckets(spark, bits, halo, iterations):
    values = [float((i * 37) % 101) for i in range(100)]
    df = spark.createDataFrame(list(enumerate(values)), "i bigint, a double")
    out = stencil.stencil_rows(df, "i", "a", iterations, work=lambda v: v * 0.5 + 1, bits=bits, halo=halo)
    assert [r.a for r in out.orderBy("i").collect()] == pytest.approx(plain_stencil(values, iterations))


def test_a_straight_line_is_a_fixed_point(spark):
    line = spark.range(256).selectExpr("id AS i", "CAST(id AS double) AS a")
    out = stencil.stencil_rows(line, "i", "a", 10, bits=5)
    assert out.filter("abs(a - i) > 1e-9").count() == 0


@pytest.mark.parametrize("bits, halo", [(1, 2), (14, 8)])
def test_array_stencil(spark, bits, halo):
    values = [float((i * 37) % 101) for i in range(80)]
    df = spark.createDataFrame([(r, values[r * 8 : r * 8 + 8]) for r in range(10)], "r bigint, a array<double>")
    out = stencil.stencil_arrays(df, "r", "a", 3, work=lambda v: v * 0.5 + 1, bits=bits, halo=halo)
    got = [x for r in out.orderBy("r").collect() for x in r.a]
    assert got == pytest.approx(plain_stencil(values, 3))


def test_neighbours_stop_at_gaps_and_lines(spark):
    df = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 3, 3), (1, 4, 4)], "line int, i bigint, v int")
    out = stencil.neighbours(df, "i", ["line"], {"lo": F.col("v")}, {"hi": F.col("v")}, bits=1)
    assert as_set(out, "i", "lo", "hi") == {(0, None, 2), (1, 1, None), (3, None, None), (4, None, None)}


def test_round_robin_table(spark):
    out = placement.round_robin(spark.range(8).withColumnRenamed("id", "rank"), "rank", 8, 4, 1)
    assert {(r.node, r.rank) for r in out.collect()} == {(n, r) for n in range(4) for r in (n, n + 4)}
    two = placement.round_robin(spark.range(8).withColumnRenamed("id", "rank"), "rank", 8, 2, 2)
    assert [r.process for r in two.orderBy("rank").collect()] == [0, 2, 0, 2, 1, 3, 1, 3]
    with pytest.raises(ValueError):
        placement.round_robin(two, "rank", 9, 3, 2)


def test_grid(spark):
    grid = spark.createDataFrame([(0, 0, 5), (0, 1, 6), (0, 2, 7), (1, 0, 8)], "node bigint, position int, rank bigint")
    assert as_set(placement.grid_process(grid, 2), "rank", "process") == {(5, 0), (6, 0), (7, 1), (8, 2)}
    assert as_set(placement.grid_process(grid, 1), "rank", "process") == {(5, 0), (6, 0), (7, 0), (8, 1)}


def test_check_placement(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 2, 1), (4, 9, 0)], "position bigint, rank bigint, process bigint")
    got = placement.check_placement(df, "rank", "process", "position", 4, 2).first().asDict()
    assert got == {"n_ranks": 4, "n_foreign": 1, "n_bad_process": 0, "n_steps_back": 1, "n_missing": 2, "n_repeated": 1}


def test_slowest_rank(spark):
    df = spark.createDataFrame(
        [("t", 0, 0, 10), ("t", 1, 9, 20), ("t", 2, 9, 30), ("t", 3, 4, 40)], "timer string, rank int, e bigint, total bigint"
    )
    assert tuple(timers.slowest_rank(df, ["timer"], "rank", "e", "total").first()) == ("t", 9, 1, 7, 45.0, "under_50")
    with pytest.raises(Exception, match="above 100"):
        timers.slowest_rank(df.withColumn("total", F.lit(1)), ["timer"], "rank", "e", "total").collect()


def test_timer_share_last_name_wins(spark):
    df = spark.createDataFrame([(0, "a", 0, 10, 100), (0, "a", 3, 30, 100), (0, "b", 1, 50, 100)], "d int, name string, i int, e bigint, t bigint")
    assert as_set(timers.timer_share(df, ["d"], "name", "i", "e", "t")) == {(0, "b", 50.0, 1), (0, "a", 30.0, 2)}


def test_overlapping_intervals_are_kept_whole(spark):
    df = spark.createDataFrame([(0, 5), (5, 15), (18, 30), (21, 40)], "s int, e int")
    kept = df.filter(timers.within_run(F.col("s"), F.col("e"), F.lit(10), F.lit(20)))
    assert as_set(kept) == {(5, 15), (18, 30)}


def test_written_in_order(spark):
    df = spark.range(200).selectExpr("id % 5 AS rank", "(id * 7) % 200 AS start").repartition(6)
    out = timers.written_in_order(df, "rank", "start", 4).withColumn("p", F.spark_partition_id()).collect()
    assert len(out) == 200
    for p in {r.p for r in out}:
        rows = [(r.rank, r.start) for r in out if r.p == p]
        assert rows == sorted(rows)


def test_match_messages(spark):
    sends = spark.createDataFrame([("c", 1), ("c", 4), ("d", 2)], "ch string, id bigint")
    recvs = spark.createDataFrame([("c", 9), ("e", 3)], "ch string, id bigint")
    out = traces.match_messages(sends, recvs, ["ch"], ["id"], ["id"])
    assert as_set(out) == {
        ("c", 1, 1, 9, "matched"), ("c", 2, 4, None, "no_recv"), ("d", 1, 2, None, "no_recv"), ("e", 1, None, 3, "no_send"),
    }
    assert as_set(traces.unmatched_endpoints(sends, recvs, ["ch"])) == {("d", 1, "send"), ("e", 1, "recv")}


@pytest.mark.parametrize("width, end, start, want", [(8, 9, 4, 5), (8, 4, 250, 10), (48, 1, 2**48 - 1, 2), (64, 7, 3, 4)])
def test_counter_delta(spark, width, end, start, want):
    got = spark.range(1).select(traces.counter_delta(F.lit(end), F.lit(start), width).alias("d")).first().d
    assert int(got) == want


def test_wait_mix_checks_the_sum(spark):
    df = spark.createDataFrame([(0, "a"), (0, "b"), (0, "a")], "g int, o string")
    assert traces.wait_mix(df, ["g"], "o", ["a", "b"]).first().n_a == 2
    with pytest.raises(Exception, match="do not add up"):
        traces.wait_mix(df, ["g"], "o", ["a"]).collect()


def test_chunk_reduce(spark):
    chunked = tasks.with_chunks(spark.range(100), "id", 100, 7)
    out = tasks.chunk_reduce(chunked, F.sum("id").cast("double"), lambda a, b: a + b, F.lit(0.0)).first()
    assert tuple(out) == (4950.0, 7)
    with pytest.raises(Exception, match="not an identity"):
        tasks.chunk_reduce(chunked, F.sum("id").cast("double"), lambda a, b: a + b, F.lit(1.0)).collect()


def test_profile_rows_and_summary(spark):
    lines = spark.createDataFrame(
        [("r1", "  3.68%  ,app,lib.so   ,[.] Progress"), ("r1", "  1.00%  ,app,lib.so   ,[.] Progress"),
         ("r2", " 0.10%,app,lib.so,[k] rare"), ("r2", "2.00%,app,x,[.] Progress"), ("r2", "# header")],
        "report string, line string",
    )
    out = profiles.profile_summary(profiles.profile_rows(lines), "symbol", "report", "percent").collect()
    assert len(out) == 1
    assert (out[0].symbol, out[0].n_reports) == ("Progress", 2)
    assert (out[0].min_percent, out[0].max_percent) == pytest.approx((2.0, 4.68))


def test_class_rollup(spark):
    df = spark.createDataFrame([("MPI_Isend", 6.0, 1.0), ("work", 2.0, 0.0), (None, 1.0, 0.0)], "symbol string, busy double, wait double")
    classed = profiles.with_class(df, "symbol", profiles.communication_symbols())
    out = {r["class"]: (r.total, r.percent) for r in profiles.class_rollup(classed, "mode", "busy", "wait").collect()}
    assert out == {"send": (7.0, 70.0), "compute": (3.0, 30.0), "TOTAL": (10.0, 100.0)}


STACKS = """Thread 1 (Thread 0x7f (LWP 1)):
#0  0x01 in EnqueueWaitBlockingThisOnly (a=1) at /src/queue.cpp:10
#1  0x02 in send_all (a=1) at /src/app.cpp:20
#2  0x03 in main () at /src/app.cpp:90
Thread 2 (Thread 0x7f (LWP 2)):
#0  0x04 in compute (b=2) at /src/app.cpp:44
Thread 3 (Thread 0x7f (LWP 3)):
#0  0x05 in DequeueWaitSpinWhileEmpty () at /lib/q.cpp:1
Thread 4 (Thread 0x7f (LWP 4)):
#0  0x06 in helper () at /lib/other.cpp:1
#1  receive () at /src/app.cpp:50
Thread 5 (Thread 0x7f (LWP 5)):
#0  0x07 in compute (b=2) at /src/app.cpp:44
#1  0x08 in DequeueWaitSpinWhileEmpty () at /lib/q.cpp:1
""".splitlines()


@pytest.mark.parametrize("group_rows", [4, 1000])
def test_backtraces(spark, group_rows):
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(STACKS, 1)], "file string, line_no bigint, line string")
    frames = profiles.stack_frames(lines, "app.cpp", group_rows=group_rows)
    # Thread 3 has no frame in the filtered file and hands its waiting on to thread 4.
    assert as_set(frames) == {
        ("f", 0, "send_all", True), ("f", 1, "compute", False), ("f", 2, "receive", True), ("f", 3, "compute", False),
    }
    assert as_set(profiles.symbol_counts(frames)) == {("send_all", 1), ("compute", 2), ("receive", 1)}
    sectioned = profiles.sections(frames, ["file"], ["stack"], 2)
    pairs = profiles.coincidences(sectioned, ["file"], "stack", "symbol", "waiting", 2)
    assert as_set(pairs) == {("send_all", "compute", 1), ("receive", "compute", 1)}
    matrix = profiles.coincidence_matrix(pairs, ["compute", "send_all"])
    assert as_set(matrix) == {("send_all", 1, 0), ("receive", 1, 0)}


def test_unknown_waiter_and_partial_section(spark):
    df = spark.createDataFrame([(i, "s", False) for i in range(5)], "i bigint, sym string, waiting boolean")
    sectioned = profiles.sections(df, [], ["i"], 2)
    assert as_set(profiles.coincidences(sectioned, [], "i", "sym", "waiting", 2)) == {("Unknown", "s", 4)}


def test_config_median(spark):
    data = [(0, r, v) for r, v in enumerate([5, 1, 9, 9])] + [(1, r, v) for r, v in enumerate([2, 8, 4])]
    df = spark.createDataFrame(data, "config int, run int, e bigint")
    for limit in (2, 1000):
        out = experiments.config_median(df, ["config"], ["run"], "e", group_rows=limit)
        assert as_set(out) == {(0, 7.0, 4), (1, 4.0, 3)}


def test_completeness(spark):
    expected = spark.createDataFrame([("a", 4), ("b", 4), ("c", 4), ("d", 4)], "job string, want bigint")
    found = spark.createDataFrame([("a", 4), ("b", 3), ("c", 8)], "job string, have bigint")
    out = experiments.completeness(expected, found, ["job"], "want", "have")
    assert as_set(out) == {
        ("a", 4, 4, "ok", True), ("b", 4, 3, "failed", False), ("c", 4, 8, "surplus", True), ("d", 4, 0, "failed", False),
    }


def test_grid_uses_chunks_only_where_they_apply(spark):
    out = experiments.parameter_grid(
        spark.range(1), {"version": [4, 460]}, "chunks", [16, 32], experiments.chunked_channel(F.col("version")), -1
    )
    assert as_set(out) == {(0, 4, -1), (0, 460, 16), (0, 460, 32)}


def test_union_results(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([(2,)], "a int")
    assert as_set(experiments.union_results([a, b])) == {(1, "x"), (2, None)}
    with pytest.raises(ValueError):
        experiments.union_results([a, b.limit(0)])


def test_progress(spark):

    def left(p):
        return spark.range(1).select(experiments.minutes_left(F.lit(600), F.lit(p)).alias("m")).first().m

    assert left(25.0) == 30.0
    assert left(0.0) is None


def test_tolerance(spark):

    def ok(actual):
        return spark.range(1).select(experiments.within_tolerance(F.lit(actual), F.lit(1000), F.lit(3)).alias("x")).first().x

    assert ok(998) and ok(10) and ok(1007) and not ok(1009)


def test_newest(spark):
    df = spark.createDataFrame([("g", 5, 1), ("g", 5, 2), ("g", 3, 3)], "g string, stamp bigint, id bigint")
    assert as_set(experiments.newest(df, ["g"], "stamp", "id", 2), "id", "place") == {(2, 1), (1, 2)}
    many = spark.range(3000).selectExpr("id % 2 AS g", "id div 7 AS stamp", "id")
    got = experiments.newest(many, ["g"], "stamp", "id", 1200, group_rows=200)
    assert got.agg(F.count("*"), F.min("id"), F.max("place")).first() == (2400, 600, 1200)


def test_stencil_with_gaps_does_not_depend_on_buckets(spark):
    from rankflow.operators.stencil import stencil_rows

    df = spark.createDataFrame([(i, float(i * i % 7)) for i in range(30) if i not in (9, 16, 17)], "p bigint, a double")
    results = [
        {r.p: round(r.a, 9) for r in stencil_rows(df, "p", "a", 5, bits=bits, halo=2).collect()} for bits in (1, 3, 14)
    ]
    assert results[0] == results[1] == results[2]
    a = {r.p: r.a for r in df.collect()}
    for _ in range(5):
        a = {p: (a[p - 1] + x + a[p + 1]) / 3 if p - 1 in a and p + 1 in a else x for p, x in a.items()}
    assert results[2] == {p: round(x, 9) for p, x in a.items()}


def test_stencil_over_short_buffers(spark):
    from rankflow.operators.stencil import stencil_arrays

    values = [float(i * i % 11) for i in range(24)]
    df = spark.createDataFrame([(r, values[4 * r : 4 * r + 4]) for r in range(6)], "r bigint, b array<double>")
    got = [x for r in stencil_arrays(df, "r", "b", 10).orderBy("r").collect() for x in r.b]
    for _ in range(10):
        values = [values[0], *((values[i - 1] + values[i] + values[i + 1]) / 3 for i in range(1, 23)), values[-1]]
    assert all(abs(x - y) < 1e-9 for x, y in zip(got, values)) and len(got) == 24
    with pytest.raises(ValueError, match="buffer"):
        stencil_arrays(df.withColumn("b", F.array().cast("array<double>")), "r", "b", 1)


def test_median_ignores_runs_without_a_time(spark):
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate([10, 20, 30, None])] + [("d", 0, None)], "config string, run int, e bigint")
    out = experiments.config_median(df, ["config"], ["run"], "e")
    assert as_set(out) == {("c", 20.0, 4), ("d", None, 1)}


def test_unlisted_ranks_and_symbols_fail(spark):
    chunks = spark.createDataFrame([("t", 0, 0), ("t", 5, 0)], "task string, x bigint, o bigint")
    with pytest.raises(Exception, match="rank not listed"):
        traces.steal_share(chunks, ["task"], "x", "o", [0, 1]).collect()
    pairs = spark.createDataFrame([("w", "s", 5)], "wait_symbol string, symbol string, n bigint")
    with pytest.raises(Exception, match="symbol not listed"):
        profiles.coincidence_matrix(pairs, ["a"]).collect()


@pytest.mark.parametrize("batch", ["10", "10000"])
def test_python_chunks_may_come_in_pieces(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        chunked = spark.range(0, 100, 1, 1).selectExpr("id div 50 AS chunk_id", "double(id) AS v")
        out = tasks.chunk_reduce_python(
            chunked, lambda rows: (float(rows["v"].min()), float(rows["v"].max())), ["min", "max"], lambda low, high: high - low, "sum")
        assert tuple(out.first()) == (98.0, 2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def nested_comms(depth, top=12):
    """Rows of ``depth`` splits, each of the upper half of the ranks before, and the world rank of every rank of each."""
    rows, worlds, held = [], {}, list(range(top))
    for level in range(1, depth + 1):
        upper = held[len(held) // 2 :] if len(held) > 1 else held
        parent = f"c{level - 1}" if level > 1 else "world"
        for new, world in enumerate(upper):
            rows.append((f"c{level}", parent, held.index(world), new))
            worlds[f"c{level}", new] = world
        held = upper
    return rows, worlds


@pytest.mark.parametrize("depth", [1, 2, 3, 6, 9])
def test_ranks_are_followed_up_any_depth(spark, depth):
    from rankflow.operators.collectives import translate

    rows, worlds = nested_comms(depth)
    table = spark.createDataFrame(rows, "comm string, parent_comm string, origin_rank long, new_rank long")
    asked = spark.createDataFrame([*worlds, ("world", 5)], "comm string, rank long")
    got = {(r.comm, r.rank): r.world_rank for r in translate(asked, "comm", "rank", table).collect()}
    assert got == worlds | {("world", 5): 5}


def test_cycles_and_lost_ranks_fail(spark):
    from rankflow.operators.collectives import translate

    kinds = "comm string, parent_comm string, origin_rank long, new_rank long"
    asked = spark.createDataFrame([("a", 0)], "comm string, rank long")
    for rows in ([("a", "a", 0, 0)], [("a", "b", 0, 0), ("b", "c", 0, 0), ("c", "a", 0, 0)]):
        with pytest.raises(ValueError, match="cycle"):
            translate(asked, "comm", "rank", spark.createDataFrame(rows, kinds))
    with pytest.raises(ValueError, match="no rank 7 in communicator b"):
        translate(asked, "comm", "rank", spark.createDataFrame([("a", "b", 7, 0), ("b", "world", 0, 0)], kinds))
    empty = spark.createDataFrame([], kinds)
    assert translate(asked, "comm", "rank", empty).first().world_rank == 0


def test_a_python_reducer_does_not_depend_on_batches(spark):
    from rankflow.catalog.tasks import MOMENTS

    rows = [(i % 3 if i % 7 else None, (i * 7919) % 1000) for i in range(2000)]
    df = spark.createDataFrame(rows, "chunk_id int, v long").repartition(40)
    want = {}
    for chunk, v in rows:
        want.setdefault(chunk, []).append(v)
    want = {c: (len(v), sum(v), sum(x * x for x in v), sorted(v)[:-4:-1]) for c, v in want.items()}
    for batch, fan_in in (("10000", 64), ("7", 2)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = {r.chunk_id: (r.n, r.total, r.squares, r.top) for r in tasks.chunk_states(df, MOMENTS, fan_in).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want
    assert tasks.chunk_states(df.limit(0), MOMENTS).count() == 0


def test_merges_stay_below_the_fan_in(spark):
    largest = tasks.Reducer("n bigint, most bigint", {"n": 0, "most": 0}, lambda r: {"n": len(r), "most": 0}, lambda a, b: {
        "n": a["n"] + b["n"], "most": a["most"] + b["most"]})
    states = spark.range(500).select((F.col("id") % 2).alias("g"), F.lit(1).cast("bigint").alias("n"), F.col("id").alias("most"))
    got = sorted(map(tuple, tasks.merge_states(states, ["g"], largest, fan_in=8).collect()))
    assert got == [(0, 250, sum(range(0, 500, 2))), (1, 250, sum(range(1, 500, 2)))]
    wrong = tasks.Reducer("n bigint", {"n": 1}, lambda r: {"n": len(r)}, lambda a, b: {"n": a["n"] + b["n"]})
    with pytest.raises(Exception, match="not an identity"):
        tasks.merge_states(states.select("g", "n"), ["g"], wrong).collect()


def test_python_stages_leave_other_stages_rows_alone(spark):
    from rankflow.catalog.tasks import MOMENTS, double

    df = spark.createDataFrame([(g, v) for g in ("a", "b", None) for v in range(50)], "g string, v long").repartition(7)
    stages = [
        tasks.Stage(python=double, reducer=MOMENTS, finish=lambda n, total, squares, top: total),
        tasks.Stage(columns={"v": F.col("v") + 1}),
        tasks.Stage(python=double, reducer=MOMENTS, finish=lambda n, total, squares, top: top[0]),
        tasks.Stage(result=F.sum, of=F.col("v")),
    ]
    total = sum(range(50))
    row = (2 * total, None, 198, 4 * total + 100)
    got = tasks.run_stages(df, stages, ["g"], fan_in=2)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(g, *row) for g in ("a", "b", None)], key=str)
    assert tuple(tasks.run_stages(df.filter("g = 'a'"), stages, fan_in=2).first()) == row


def test_middle_values_by_counting_equal_the_sorted_median(spark):
    import random
    import statistics

    rng = random.Random(4)
    groups = {g: [rng.randint(-(2**g), 2**g) for _ in range(rng.randint(1, 60))] for g in range(0, 60, 3)}
    groups |= {100: [7] * 50, 101: [5], 102: [1, 2], 103: [-(2**40), 2**40], 104: [3, 3, 3, 9], None: [4, 1, 2]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [(5, None), (100, None), (200, None)]
    df = spark.createDataFrame(rows, "g int, v long")
    got = {r.g: (r.n, r.low, r.high) for r in experiments.middle_values(df, ["g"], "v").collect()}
    assert got == {g: (len(v), statistics.median_low(v), statistics.median_high(v)) for g, v in groups.items()}
    assert experiments.middle_values(df.limit(0), ["g"], "v").count() == 0
    plain = df.withColumn("run", F.monotonically_increasing_id())
    one, two = (sorted(map(tuple, f(plain, ["g"], ["run"], "v").collect()), key=str) for f in (
        experiments.config_median, experiments.config_median_counted))
    assert one == two

"""Column functions."""

import pytest
from pyspark.sql import functions as F

from rankflow.functions import chunks, headers, labels, payload, ranges, ratios


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "share, label", [(0.0, "under_5"), (4.99, "under_5"), (5.0, "under_25"), (25.0, "under_50"), (50.0, "50_or_more")]
)
def test_band(spark, share, label):
    assert one(spark, ratios.band(F.lit(share))) == label


def test_percent(spark):
    assert one(spark, ratios.percent(F.lit(1), F.lit(8))) == 12.5
    assert one(spark, ratios.percent(F.lit(1), F.lit(0))) is None


def test_clock(spark):
    assert one(spark, ratios.clock(F.lit(2_300_000_000 * 3661 + 2_300_000 * 7), 2300.0)) == "01:01:01:007"
    assert one(spark, ratios.clock(F.lit(1_000_000 * 90_000), 1.0)) == "01:00:00:000"


def test_span_ns(spark):
    assert one(spark, ratios.span_ns(F.lit(3), F.lit(5), F.lit(1), F.lit(10))) == 1_999_999_995


def test_leading_digits(spark):
    assert one(spark, ratios.leading_digits(F.lit(9876), 2)) == 98


@pytest.mark.parametrize("total, parts, offset", [(100, 7, 0), (7, 7, 0), (23, 4, 1), (1000, 64, 5)])
def test_chunks_cover_the_range_once(spark, total, parts, offset):
    rows = spark.range(offset, total + offset).select(
        "id", chunks.chunk_of(F.col("id"), F.lit(total), parts, offset).alias("c")
    )
    found = rows.groupBy("c").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"))
    length = total // parts
    for r in found.collect():
        assert r.lo == r.c * length + offset
        assert r.hi == (total + offset - 1 if r.c == parts - 1 else r.lo + length - 1)
        assert r.n == r.hi - r.lo + 1
    assert found.count() == parts


def test_aligned_chunks_start_on_lines(spark):
    rows = spark.range(1003).select("id", chunks.aligned_chunk_of(F.col("id"), F.lit(1003), 5, 8).alias("c"))
    starts = [r.lo for r in rows.groupBy("c").agg(F.min("id").alias("lo")).orderBy("c").collect()]
    assert starts == [0, 200, 400, 600, 800]


def test_too_many_chunks_fails(spark):
    with pytest.raises(Exception, match="more chunks than"):
        one(spark, chunks.chunk_of(F.lit(0), F.lit(3), 4))
    with pytest.raises(Exception, match="more chunks than"):
        one(spark, chunks.aligned_chunk_of(F.lit(0), F.lit(30), 4, 8))


@pytest.mark.parametrize("count, ranks", [(100, 4), (10, 8), (64, 3)])
def test_slices(spark, count, ranks):
    rows = spark.range(count).select("id", chunks.slice_of(F.col("id"), F.lit(count), ranks, 8).alias("r"))
    lines = -(-count * 8 // 64)
    per, active = max(1, lines // ranks), min(lines, ranks)
    for r in rows.collect():
        assert r.r == min(r.id // (per * 8), active - 1)


def test_thread_name(spark):
    name = labels.thread_name(F.lit(12), F.lit(3), F.lit(7))
    assert one(spark, name) == "p0012m0003t0007"
    assert tuple(one(spark, labels.thread_fields(name))) == (12, 3, 7)
    wide = labels.thread_name(F.lit(123456), F.lit(3), F.lit(7))
    assert tuple(one(spark, labels.thread_fields(wide))) == (123456, 3, 7)


def test_labels(spark):
    label = labels.config_label(F.lit("32t/n-"), F.lit(None).cast("string"), labels.numbered("chk", F.lit(16), 6), F.lit("je-"))
    assert one(spark, label) == "32t/n-chk-000016-je"
    key = labels.runtime_key(F.lit("RT"), F.lit(2), F.lit(4), F.lit(46), F.lit(8), F.lit("desc"))
    assert one(spark, key) == "RT-p2t4-pcv46-qs0008-desc"
    none = F.lit(None).cast("int")
    assert one(spark, labels.runtime_key(F.lit("MPI"), F.lit(2), F.lit(1), none, none, F.lit("x"))) == "MPI-p2t1-x"


def test_paths_and_cleaning(spark):
    assert one(spark, labels.last_parts(F.lit("/a/b/c"))) == "b/c"
    assert one(spark, labels.last_parts(F.lit("c"))) == "c"
    assert one(spark, labels.blank_commas(F.lit("0,16"))) == "0 16"
    assert one(spark, labels.clean_zero(F.lit("0"))) is None
    assert one(spark, labels.clean_zero(F.lit("10"))) == "10"


def test_arguments(spark):
    row = spark.range(1).select(*labels.padded_arguments(F.lit("-x 1"), 3)).first()
    assert tuple(row) == ("-x", "1", None)
    with pytest.raises(Exception, match="more than 1 arguments"):
        spark.range(1).select(*labels.padded_arguments(F.lit("-x 1"), 1)).collect()


def test_header_roundtrip(spark):
    values = dict(count=12, count_bytes=48, datatype=1275070475, receiver=2, tag=4, sender=14, seq_id=120)
    header = headers.encode_header(**{k: F.lit(v) for k, v in values.items()})
    assert one(spark, header) == "000012" "0000048" "1275070475" "00002" "00004" "00014" "00120"
    assert one(spark, headers.decode_header(header)).asDict() == values
    assert one(spark, headers.header_is_good(header)) is True
    for bad in ("000012" "0000049" "1275070475" "00002000040001400120", "short", "000000" + "0" * 37):
        assert one(spark, headers.header_is_good(F.lit(bad))) is False
    too_wide = headers.encode_header(**{k: F.lit(10**6 if k == "count" else v) for k, v in values.items()})
    assert one(spark, too_wide) is None


def test_payload(spark):
    where = (F.lit(2), F.lit(3), F.lit(5))
    assert one(spark, payload.payload_value(*where)) == 300305
    assert one(spark, payload.payload_value(*where, "small")) == 41
    assert one(spark, payload.payload_value(*where, "tiny")) == 11
    assert one(spark, payload.payload_value(*where, "floating")) == pytest.approx(3.00000003 + 3.003003 + 5.000005)
    with pytest.raises(ValueError):
        payload.payload_value(*where, "huge")
    got = payload.mismatches(spark.range(10), F.col("id"), F.when(F.col("id") == 3, 0).otherwise(F.col("id"))).first()
    assert tuple(got) == (10, 1)


def test_ranges(spark):
    df = spark.createDataFrame([(1, "0-2,5"), (2, "7"), (3, "0-40000")], "k int, spec string")
    out = ranges.expand_ranges(df, "spec")
    small = sorted(tuple(r) for r in out.filter("k < 3").collect())
    assert small == [(1, 0), (1, 1), (1, 2), (1, 5), (2, 7)]
    assert out.filter("k = 3").agg(F.count("*"), F.count_distinct("item"), F.max("item")).first() == (40001, 40001, 40000)
    hosts = spark.createDataFrame([("node[08-11]",)], "spec string")
    assert sorted(r.host for r in ranges.expand_hosts(hosts, "spec").collect()) == ["node08", "node09", "node10", "node11"]
    assert ranges.check_unique(out.filter("k = 3"), ["item"]).first().n_unique == 40001
    with pytest.raises(Exception, match="duplicate"):
        ranges.check_unique(df.unionByName(df), ["k"]).collect()


def test_ranges_are_counted_as_if_listed(spark):
    import random

    from rankflow.functions.ranges import check_ranges, range_counts

    rng = random.Random(6)
    rows, want = [], {}
    for g in range(12):
        parts = []
        for _ in range(rng.randint(1, 12)):
            lo = rng.randint(0, 60)
            parts.append((lo, lo + rng.choice([0, 0, 3, 20])))
        listed = [i for lo, hi in parts for i in range(lo, hi + 1)]
        rows.append((g % 5, ",".join(f"{lo}-{hi}" if hi > lo else f" {lo}" for lo, hi in parts)))
        want.setdefault(g % 5, []).extend(listed)
    df = spark.createDataFrame(rows, "g int, spec string")
    expected = {g: (len(v), len(set(v)), len(v) - len(set(v))) for g, v in want.items()}
    for limits in ({}, {"group_rows": 2}):
        got = {r.g: tuple(map(int, tuple(r)[1:])) for r in range_counts(df, "spec", ["g"], **limits).collect()}
        assert got == expected
    wide = spark.createDataFrame([(1, "0-999999999,1000000000-4000000000"), (2, "5-4000000000,7")], "g int, spec string")
    assert {r.g: int(r.n_repeated) for r in range_counts(wide, "spec", ["g"]).collect()} == {1: 0, 2: 1}
    assert check_ranges(wide.filter("g = 1"), "spec", ["g"]).count() == 1
    with pytest.raises(Exception, match="repeated members in ranges: 1"):
        check_ranges(wide, "spec", ["g"]).collect()

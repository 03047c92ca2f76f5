"""Exact sums against ``math.fsum``, over partitions, row orders and the whole range of doubles."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from rankflow.operators.collectives import all_reduce, reduce_value
from rankflow.plans import exact_sums


def bits(x):
    return None if x is None else struct.pack(">d", x)


def any_double(rng):
    while True:
        x = struct.unpack(">d", struct.pack(">Q", rng.getrandbits(64)))[0]
        if math.isfinite(x):
            return x


def groups():
    rng = random.Random(8)
    out = {}
    for g in range(60):
        span = rng.choice([3, 40, 600])
        out[g] = [rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randint(-span, span) for _ in range(rng.randint(1, 60))]
        if g % 3 == 0:
            out[g] += [-x for x in out[g][1:]]  # all but one value cancels
    for g in range(60, 100):
        out[g] = [any_double(rng) / 64 for _ in range(rng.randint(1, 20))]
    out[100] = [5e-324] * 7 + [-2.2250738585072014e-308]
    out[101] = [1.0, 2.0**-53, 2.0**-106]  # just above a tie
    out[102] = [1.0, 2.0**-53]  # a tie, to even
    out[103] = [1.0 + 2.0**-52, 2.0**-53]  # a tie, to even, upwards
    out[104] = [0.0, -0.0]
    out[105] = [1e308, 7e307, -1e308, -7e307, 0.1]
    out[106] = [2.0**k for k in range(-1074, 1023, 24)]
    out[107] = [-(2.0**k) for k in range(-1074, 1023, 24)] + [2.0**1023 / 2]
    return out


@pytest.fixture(scope="module")
def values(spark):
    rows = [(g, x, i) for g, xs in groups().items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "g int, x double, i int")


@pytest.mark.parametrize("parts", [1, 200])
def test_sums_are_rounded_once(values, parts):
    spread = values.repartition(parts, F.rand(seed=parts)).sortWithinPartitions(F.rand(seed=parts + 1))
    got = {r.g: r.total for r in exact_sums(spread, ["g"], {"total": "x"}).collect()}
    want = {g: math.fsum(xs) for g, xs in groups().items()}
    assert {g: bits(x) for g, x in got.items()} == {g: bits(x + 0.0) for g, x in want.items()}


def test_nulls_infinities_and_other_columns(spark):
    inf, nan = math.inf, math.nan
    rows = [(1, None, 2), (1, None, 3), (2, inf, 4), (2, 1.0, None), (3, inf, 1), (3, -inf, 1), (4, nan, 1), (5, None, None), (5, 0.25, 7), (None, 1.5, 1)]
    df = spark.createDataFrame(rows, "g int, x double, n int").withColumn("y", F.col("x") * 2)
    ops = {"total": ("sum", "x"), "twice": ("sum", "y"), "n": ("sum", "n"), "least": ("min", "x"), "most": ("max", "n"), "prod": ("prod", "n")}
    got = {r.g: tuple(r)[1:] for r in reduce_value(df, ["g"], ops).collect()}
    assert got[1] == (None, None, 5, None, 3, 6.0)
    assert got[2] == (inf, inf, 4, 1.0, 4, 4.0)
    assert math.isnan(got[3][0]) and math.isnan(got[4][1])
    assert got[5] == (0.25, 0.5, 7, 0.25, 7, 7.0) and got[None] == (1.5, 3.0, 1, 1.5, 1, 1.0)
    assert reduce_value(df.limit(0), ["g"], ops).count() == 0
    assert [tuple(r) for r in reduce_value(df.filter("g = 5"), [], {"total": ("sum", "x")}).collect()] == [(0.25,)]


def test_a_hot_element_has_the_same_bits_everywhere(spark):
    df = spark.range(20_000).select(F.lit(0).alias("comm"), (F.col("id") % 2).alias("idx"), (F.rand(3) * 1e6 - 4e5).alias("value"), "id")
    rows = df.collect()
    seen = set()
    for parts in (1, 7, 64):
        shuffled = spark.createDataFrame(random.Random(parts).sample(rows, len(rows)), df.schema).repartition(parts)
        seen |= {(r.idx, bits(r.total)) for r in all_reduce(shuffled, ["comm"], {"total": "sum"}).select("idx", "total").distinct().collect()}
    assert seen == {(i, bits(math.fsum(r.value for r in rows if r.idx == i))) for i in (0, 1)}

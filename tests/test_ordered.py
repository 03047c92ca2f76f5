"""Numbering, prefix sums and previous values, with groups forced apart, against plain Python."""

import random
from collections import defaultdict

import pytest

from rankflow.plans import previous_value, row_number, running_sum, split_groups


def make(seed, groups, n, keys):
    rnd = random.Random(seed)
    # One group holds about a third of all rows.

    def pick():
        return 0 if rnd.random() < 0.34 else rnd.randrange(groups)

    return [(pick(), k, rnd.randrange(-50, 50)) for k in rnd.sample(keys, n)]


def expected(data):
    by = defaultdict(list)
    for g, k, v in data:
        by[g].append((k, v))
    out = []
    for g, items in by.items():
        total, before = 0, None
        for i, (k, v) in enumerate(sorted(items), 1):
            out.append((g, k, i, total + v, total, before))
            total, before = total + v, v
    return sorted(out)


SPREADS = {
    "dense": range(0, 600),
    "negative": range(-300, 300),
    "sparse": range(-(2**62), 2**62, 2**54),
    "clustered": list(range(300)) + list(range(2**40, 2**40 + 300)),
}


@pytest.mark.parametrize("spread", SPREADS)
def test_groups_of_any_size(spark, spread):
    data = make(spread, 7, 400, list(SPREADS[spread]))
    df = spark.createDataFrame(data, "g bigint, k bigint, v bigint")
    want = expected(data)
    numbered = row_number(df, ["g"], ["k"], "n", group_rows=20, total="size")
    assert {tuple(r) for r in numbered.select("g", "k", "n").collect()} == {w[:3] for w in want}
    sizes = {r.g: r.size for r in numbered.select("g", "size").distinct().collect()}
    assert sizes == {g: sum(w[0] == g for w in want) for g in {w[0] for w in want}}
    inclusive = running_sum(df, ["g"], ["k"], {"s": "v"}, group_rows=20)
    assert {tuple(r) for r in inclusive.select("g", "k", "s").collect()} == {(w[0], w[1], w[3]) for w in want}
    exclusive = running_sum(df, ["g"], ["k"], {"s": "v"}, inclusive=False, group_rows=20)
    assert {tuple(r) for r in exclusive.select("g", "k", "s").collect()} == {(w[0], w[1], w[4]) for w in want}
    before = previous_value(df, ["g"], ["k"], {"b": "v"}, group_rows=20)
    assert {tuple(r) for r in before.select("g", "k", "b").collect()} == {(w[0], w[1], w[5]) for w in want}


def test_pieces_stay_below_the_limit(spark):
    data = make(1, 3, 500, list(SPREADS["clustered"]))
    df = spark.createDataFrame(data, "g bigint, k bigint, v bigint")
    out = split_groups(df, ["g"], ["k"], group_rows=10)
    assert out.df.groupBy(*out.groups).count().agg({"count": "max"}).first()[0] <= 10


def test_one_order_value_for_a_third_of_the_rows(spark):
    data = [(0, 5 if i % 3 == 0 else i, i) for i in range(300)]
    df = spark.createDataFrame(data, "g int, stamp bigint, id bigint")
    got = {r.id: r.n for r in row_number(df, ["g"], ["stamp", "id"], "n", group_rows=12).collect()}
    want = {row[2]: i for i, row in enumerate(sorted(data), 1)}
    assert got == want


def test_one_group_has_only_equal_first_keys(spark):
    data = [(0, 7, i) for i in range(200)] + [(1, i // 2, i) for i in range(200)] + [(2, 3, i) for i in range(5)]
    df = spark.createDataFrame(data, "g int, stamp bigint, id bigint")
    got = {(r.g, r.id): (r.n, r.s) for r in running_sum(
        row_number(df, ["g"], ["stamp", "id"], "n", group_rows=30), ["g"], ["stamp", "id"], {"s": "id"}, group_rows=30
    ).collect()}
    assert got == {(g, i): (i + 1, i * (i + 1) // 2) for g, _, i in data}
    before = {(r.g, r.id): r.b for r in previous_value(df, ["g"], ["stamp", "id"], {"b": "id"}, group_rows=30).collect()}
    assert before == {(g, i): (i - 1 if i else None) for g, _, i in data}


def test_whole_table_and_null_groups(spark):
    data = [(None if i % 2 else 1, i) for i in range(200)]
    df = spark.createDataFrame(data, "g int, k bigint")
    whole = {(r.k, r.n, r.size) for r in row_number(df, [], ["k"], "n", start=0, total="size").collect()}
    assert whole == {(i, i, 200) for i in range(200)}
    split = {r.k: r.n for r in row_number(df, ["g"], ["k"], "n", start=0, group_rows=9).collect()}
    assert split == {i: i // 2 for i in range(200)}


def test_previous_null_is_not_skipped(spark):
    data = [(k, None if k % 5 == 4 else k) for k in range(100)]
    df = spark.createDataFrame(data, "k bigint, v bigint")
    got = {r.k: r.b for r in previous_value(df, [], ["k"], {"b": "v"}, group_rows=5).collect()}
    assert got == {k: (None if k == 0 else data[k - 1][1]) for k in range(100)}


@pytest.mark.parametrize("group_rows", [6, 1000])
def test_nulls_add_nothing(spark, group_rows):
    data = [(0, k, None if k % 3 or k < 20 else k) for k in range(60)]
    df = spark.createDataFrame(data, "g int, k bigint, v bigint")
    got = {r.k: r.s for r in running_sum(df, ["g"], ["k"], {"s": "v"}, group_rows=group_rows).collect()}
    assert got == {k: sum(v or 0 for _, at, v in data if at <= k) for k in range(60)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "g int, k bigint, v bigint")
    assert row_number(df, [], ["k"]).count() == 0
    assert running_sum(df, ["g"], ["k"], {"s": "v"}).count() == 0


def test_inclusive_less_value_is_exclusive(spark):
    df = spark.range(0, 3000, 7).selectExpr("id", "(id * 37) % 101 - 50 AS v")
    both = running_sum(running_sum(df, [], ["id"], {"i": "v"}), [], ["id"], {"e": "v"}, inclusive=False, group_rows=40)
    assert both.filter("i - v <> e").count() == 0


@pytest.mark.parametrize("limit", [5, 1_000_000])
@pytest.mark.parametrize("group", [[], ["g"]])
def test_null_keys_come_first(spark, limit, group):
    rows = [(i % 2, None if i % 5 == 0 else i % 3, i) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, k int, v bigint")
    out = row_number(df, group, ["k", "v"], "place", group_rows=limit)
    out = running_sum(out, group, ["k", "v"], {"prefix": "v"}, group_rows=limit)
    out = previous_value(out, group, ["k", "v"], {"before": "v"}, group_rows=limit)
    got = {r.v: (r.place, r.prefix, r.before) for r in out.collect()}
    for g in (0, 1) if group else (None,):
        mine = sorted((r for r in rows if g is None or r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        total = 0
        for at, r in enumerate(mine):
            total += r[2]
            assert got[r[2]] == (at + 1, total, mine[at - 1][2] if at else None)


@pytest.mark.parametrize("limit", [1 << 20, 16, 3])
def test_running_maximum_in_split_groups(spark, limit):
    import random

    from rankflow.plans import running_max

    rng = random.Random(limit)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), i, rng.choice([None, *range(1000)])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, at long, tie long, v long")
    want = {}
    for g in ("a", "b", None):
        most = None
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        for _, _, tie, v in own:
            want[tie] = most
            most = v if most is None else most if v is None else max(most, v)
    got = running_max(df, ["g"], ["at", "tie"], "v", "before", group_rows=limit)
    assert {r.tie: r.before for r in got.collect()} == want

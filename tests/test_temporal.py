"""Joins and windows over time against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lumenlit.operators import ranges, temporal

T0 = dt.datetime(2024, 1, 1)


def minutes(n):
    return None if n is None else T0 + dt.timedelta(minutes=n)


@pytest.mark.parametrize("ranges", ["4", "23"])
def test_as_of_with_a_hot_key(spark, ranges):
    """Most rows have one key, so it spans many ranges; ties, nulls, and rows before the first."""
    r = random.Random(7)
    key = lambda: r.choice(("hot", "hot", "hot", "a", "b", None))
    left = [(i, key(), r.choice((None, r.randrange(400)))) for i in range(900)]
    right = [(key(), r.choice((None, r.randrange(50, 400))), r.randrange(9), r.choice(("x", None))) for _ in range(60)]
    at = "timestamp_ntz"
    a = spark.createDataFrame([(i, k, minutes(t)) for i, k, t in left], f"id int, k string, t {at}")
    b = spark.createDataFrame([(k, minutes(t), v, s) for k, t, v, s in right], f"k string, t {at}, v int, s string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {x.id: (x.v, x.s) for x in temporal.as_of(a, b, "k", "t", ["v", "s"]).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for i, k, t in left:
        held = [(u, v, s or "") for kk, u, v, s in right if k is not None and kk == k and None not in (t, u) and u <= t]
        want = max(held, default=None)
        assert got[i] == ((want[1], want[2] or None) if want else (None, None))
    assert len(got) == 900 and sum(v is not None for v, _ in got.values()) > 200
    assert temporal.as_of(a, b.limit(0), "k", "t", ["v"]).where("v is not null").count() == 0 and temporal.as_of(a.limit(0), b, "k", "t", ["v"]).count() == 0


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_spans_of_all_lengths_hold_their_points(spark, kind):
    r = random.Random(8)
    points = [(i, r.choice("ab"), r.choice((None, r.randrange(5000)))) for i in range(400)]
    spans = [(j, r.choice("ab"), s, s + r.choice((0, -3, 1, 7, 100, 4000))) for j, s in enumerate(r.randrange(5000) for _ in range(120))] + [(500, "a", None, 3), (501, "a", 2, None)]
    p = spark.createDataFrame([(i, k, minutes(t)) for i, k, t in points], f"p int, k string, t {kind}")
    q = spark.createDataFrame([(j, k, minutes(a), minutes(b)) for j, k, a, b in spans], f"q int, k string, a {kind}, b {kind}")
    want = lambda keyed: sorted((i, j) for i, k, t in points for j, kk, a, b in spans if None not in (t, a, b) and a <= t < b and (k == kk or not keyed))
    assert sorted((x.p, x.q) for x in temporal.within(p, q.drop("k"), "t", "a", "b").collect()) == want(False)
    assert sorted((x.p, x.q) for x in temporal.within(p, q, "t", "a", "b", ["k"]).collect()) == want(True)
    assert temporal.within(p, q.limit(0), "t", "a", "b", ["k"]).count() == 0
    bins = temporal.within(p, q.drop("k"), "t", "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in bins


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_totals_of_spans_need_no_pairs(spark, kind):
    """Totals are those of the pairs, also where every span holds every point; what the plan joins are spans and edges."""
    r = random.Random(9)
    points = [(i, r.choice((None, r.randrange(300)))) for i in range(500)]
    spans = [(s, s + r.choice((0, -3, 1, 7, 100, 4000))) for s in (r.randrange(-20, 320) for _ in range(90))] + [(-50, 400)] * 3 + [(None, 3), (2, None), (5, 6)]
    p = spark.createDataFrame([(i, minutes(t)) for i, t in points], f"p long, t {kind}")
    q = spark.createDataFrame([(minutes(a), minutes(b)) for a, b in spans], f"a {kind}, b {kind}")
    want = {}
    for a, b in {x for x in spans if None not in x}:
        held = [(t, i) for i, t in points if t is not None and a <= t < b]
        if held:
            want[minutes(a), minutes(b)] = (len(held), minutes(min(held)[0]), sum(i for _, i in held))
    totals = temporal.held_totals(p, q, "t", "a", "b", "p")
    assert {(x.a, x.b): (x.n, x.earliest, x.total) for x in totals.collect()} == want and totals.count() == len(want) > 40
    assert temporal.held_totals(p, q.limit(0), "t", "a", "b", "p").count() == 0 and temporal.held_totals(p.limit(0), q, "t", "a", "b", "p").count() == 0


def test_levels_keep_nulls_of_the_data_apart(spark):
    df = spark.createDataFrame([("x", 1, 2.0), (None, 1, 3.0), ("x", 2, 4.0)], "s string, n int, v double")
    got = {(r.s, r.n, r.level): r.v for r in temporal.levels(df, ["s", "n"], [F.sum("v").alias("v")]).collect()}
    assert got[None, 1, 0] == 3.0 and got[None, 1, 2] == 5.0 and got[None, None, 1] == 3.0 and got[None, None, 3] == 9.0
    assert {r.level for r in temporal.levels(df, ["s", "n"], [F.sum("v").alias("v")], drill=True).collect()} == {0, 1, 3}


def test_numbers_of_a_hot_group_and_of_a_whole_table(spark):
    rows = [("hot" if i % 3 else None if i % 2 else "b", i * 7 % 101, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, o int, i int")
    for group in (["g"], []):
        found = {}
        for r in ranges.numbered(df, group, ["o", "i"]).collect():
            found.setdefault(r.g if group else "", []).append((r.number, r.o, r.i))
        for some in found.values():
            assert [n for n, _, _ in sorted(some)] == list(range(1, len(some) + 1)) and [x[1:] for x in sorted(some)] == sorted(x[1:] for x in some)
        assert sum(map(len, found.values())) == 1000

"""Parallel tracks on planted lines, the union of intervals against a sweep, doubling lengths told by hand."""

import random

import pytest
from pyspark.sql import functions as F

from chainage.functions import scalar
from chainage.operators import intervals, tracks

SEGMENTS = "way int, edge int, seq int, ax double, ay double, bx double, by double"


def counted(spark, points, segments, **how):
    p = spark.createDataFrame([(i, float(x), float(y), h) for i, (x, y, h) in enumerate(points)], "i int, px double, py double, heading double")
    s = spark.createDataFrame([(w, e, k, *map(float, (ax, ay, bx, by))) for w, e, k, ax, ay, bx, by in segments], SEGMENTS)
    rows = tracks.track_counts(p, tracks.near_ways(p, s, ["i"], **how), ["i"]).collect()
    return {r.i: (r.n_geom, r.n_wide, None if r.d0 is None else round(r.d0, 6), None if r.d_sister is None else round(r.d_sister, 6), r.way) for r in rows}


def test_planted_ways(spark):
    east = lambda w, y, e=None: (w, e or w, 0, 0, y, 1000, y)
    segments = [east(1, 0), east(2, 4), east(3, 12), (4, 4, 0, 500, -300, 500, 300), east(5, 60), (6, 6, 0, 0, 20, 200, 20), (6, 6, 1, 200, 20, 200, 400), (6, 7, 0, 1000, 25, 0, 25)]
    got = counted(spark, [(300, 1, 90.0), (300, 1, 270.0), (500, 1, 0.0), (505, 2, 90.0), (300, 300, 90.0), (300, 58, 100.0), (300, 1, None), (195, 24, 90.0)], segments)
    assert got[0] == got[1] == (2, 4, 1.0, 2.0, 1)
    assert got[2] == (1, 1, 0.0, None, 4)  # only the crossing line runs that way
    assert got[3] == (2, 4, 2.0, 0.0, 1)  # ties: the smaller edge
    assert got[4] == got[6] == (0, 0, None, None, None) and got[5] == (1, 1, 2.0, None, 5)
    # the edge of way 6 turns off here: its nearest place runs east still, or its second edge does
    assert got[7][4] == 6 and got[7][2] == 1.0
    assert counted(spark, [], segments) == {} and counted(spark, [(0, 0, 90.0)], []) == {0: (0, 0, None, None, None)}


@pytest.mark.parametrize("width", [None, 60.0])
def test_heading_within(spark, width):
    rows = [(1, float(s), float(s), 0.0) for s in range(0, 200, 10)] + [(2, 0.0, 0.0, 0.0), (2, 100.0, 0.0, 100.0), (3, 5.0, 1.0, 1.0)]
    out = tracks.heading_within(spark.createDataFrame(rows, "k int, s double, x double, y double"), ["k"], "s", "x", "y", 40.0, width=width).collect()
    got = {(r.k, r.s): r.heading for r in out}
    assert {h for (k, _), h in got.items() if k == 1} == {90.0}
    assert got[2, 0.0] == 0.0 and got[2, 100.0] is None and got[3, 5.0] is None


def plain_union(spans, gap):
    out = []
    for lo, hi in sorted(s for s in spans if None not in s and s[0] < s[1]):
        if out and lo <= out[-1][1] + gap:
            out[-1] = [out[-1][0], max(out[-1][1], hi), out[-1][2] + 1]
        else:
            out.append([lo, hi, 1])
    return [tuple(o) for o in out]


@pytest.mark.parametrize("width", [None, 3.0, 500.0])
def test_coalesced(spark, width):
    rng = random.Random(2)
    spans = {k: [(x := rng.randrange(400) / 2, x + rng.choice([0, 0.5, 1, 1, 3, 40])) for _ in range(90)] for k in (1, 2)}
    spans[2] += [(None, 1.0), (3.0, None), (5.0, 2.0), (7.0, 7.0)] + [(0.0, 30.0)] * 3
    df = spark.createDataFrame([(k, *s) for k, rows in spans.items() for s in rows], "k int, lo double, hi double")
    for gap in (0.0, 1.5):
        out = intervals.coalesced(df, ["k"], width, gap=gap).collect()
        for k, rows in spans.items():
            assert sorted((r.lo, r.hi, r.n) for r in out if r.k == k) == plain_union(rows, gap)


@pytest.mark.parametrize("width", [None, 3.0])
def test_coalesced_with_empty_ones(spark, width):
    """An interval of no length stands alone, or counts in the one that it touches."""
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 2.0, 2.0), (1, 1.0, 1.0), (1, 5.0, 5.0), (1, 5.0, 5.0), (2, 3.0, 3.0), (2, None, 4.0)], "k int, lo double, hi double")
    out = intervals.coalesced(df, ["k"], width, empty=True).collect()
    assert sorted((r.k, r.lo, r.hi, r.n) for r in out) == [(1, 0.0, 2.0, 3), (1, 5.0, 5.0, 2), (2, 3.0, 3.0, 1)]


def test_rounded_on_the_product(spark):
    """531.2201845 lies under the half as a double, though its decimal form doesn't."""
    got = spark.createDataFrame([(531.2201845,), (2.5,), (-0.1234567,), (None,)], "x double").select(scalar.rounded(F.col("x"), 6).alias("x")).collect()
    assert [r.x for r in got] == [531.220184, 2.5, -0.123457, None]


def test_doubling_need(spark):
    runs = [(1, 0.0, 4.0, 1, "main", False, False), (1, 4.0, 5.0, 2, None, False, True), (1, 5.0, 7.0, 1, "branch", False, False), (1, 7.0, 8.0, 1, None, True, False), (1, 8.0, 9.5, 1, None, False, False), (1, 9.5, 12.0, 3, "main", True, False), (2, 0.0, 1.0, 2, None, False, False)]
    out = {r.k: r for r in tracks.doubling_need(spark.createDataFrame(runs, "k int, lo double, hi double, state int, usage string, at_station boolean, loop boolean"), ["k"]).collect()}
    one = out[1]
    assert (one.length, one.single, one.double_track, one.more, one.to_double, one.on_branches, one.at_stations, one.loops, one.runs_to_double, one.longest) == (12.0, 8.5, 1.0, 2.5, 5.5, 2.0, 1.0, 1.0, 2, 4.0)
    assert (out[2].to_double, out[2].runs_to_double, out[2].longest) == (0.0, 0, None)


def test_between_stations(spark):
    stations = spark.createDataFrame([(1, 0.0, "a"), (1, 5.0, "b"), (1, 9.0, "c")], "k int, h double, name string")
    runs = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 4.0, 6.0), (1, 2, 9.5, 12.0), (1, 3, -2.0, -1.0), (2, 0, 0.0, 1.0)], "k int, run int, lo double, hi double")
    for width in (None, 2.0):
        got = {(r.k, r.run): (r.upstream, r.downstream) for r in tracks.between_stations(runs, stations, ["k"], "h", "name", width).collect()}
        assert got == {(1, 0): ("a", "b"), (1, 1): ("a", "c"), (1, 2): ("c", "c"), (1, 3): ("a", "a"), (2, 0): (None, None)}


def test_hot_point_of_many_ways(spark):
    """A third of the segments near one place: each edge counts once for a point."""
    segments = [(w, w, k, k * 10.0, w * 0.01, k * 10.0 + 10.0, w * 0.01) for w in range(40) for k in range(20)]
    got = counted(spark, [(x * 2.0, 0.0, 90.0) for x in range(100)], segments)
    assert all(g[:2] == (40, 40) and g[4] == 0 for g in got.values())
    assert F is not None

"""Syntheses, lookups and sequential queries on small fixtures or against plain functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainage.functions import curves, scalar
from chainage.functions.traction import acceleration
from chainage.operators import corridor, intervals, linear, spatial
from chainage.operators import sequences as S
from chainage.plans import all as plans
from chainage.plans import engines, synthesis, travel
from chainage.plans.registry import track

SF = "/root/testdata/sf0.001"


def test_lookups(spark):
    df = spark.createDataFrame([(None, None), (0.5, "a"), (1.0, "b"), (2.5, "z"), (9.0, "")], "x double, k string")
    x, bounds = F.col("x"), [1.0, 2.0, 2.5]
    out = df.select(scalar.search_sorted(x, bounds), scalar.search_sorted(x, bounds, True), scalar.looked_up(F.col("k"), {"a": 1, "b": 2}, 0), scalar.looked_up(F.col("k"), {}, 7)).collect()
    assert [tuple(r) for r in out] == [(None, None, 0, 7), (0, 0, 1, 7), (0, 1, 2, 7), (2, 3, 0, 7), (3, 3, 0, 7)]


def test_short_curves(spark):
    rows = [(500.0, 1000.0), (900.0, 1000.0), (500.0, 3000.0), (500.0, None), (500.0, float("inf")), (None, 1000.0)]
    df = spark.createDataFrame(rows, "n double, r double").select(curves.short_curve(F.col("n"), F.col("r"), 2500.0).alias("s")).select("s.*")
    assert [tuple(r) for r in df.collect()] == [(True, 500.0), (False, 1000.0), (False, 3000.0), (False, None), (False, float("inf")), (False, 1000.0)]


def test_near_segments_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    points, ends = rng.uniform(-3, 3, (60, 2)), rng.uniform(-3, 3, (40, 4))
    ends[:20, 2:] = ends[:20, :2] + rng.uniform(-0.2, 0.2, (20, 2))
    ends[0, 2:] = ends[0, :2]
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(points)], "i long, px double, py double")
    s = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(ends)] + [(99, None, 0.0, 0.0, 0.0)], "k long, ax double, ay double, bx double, by double")
    got = {(r.i, r.k): r.dist for r in spatial.near_segments(p, s, 0.5, 0.7).collect()}
    want = {}
    for i, q in enumerate(points):
        for k, e in enumerate(ends):
            d = e[2:] - e[:2]
            t = min(max(float((q - e[:2]) @ d / (d @ d)), 0.0), 1.0) if d.any() else 0.0
            if (dist := float(np.hypot(*(q - e[:2] - t * d)))) <= 0.5:
                want[i, k] = dist
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_step_values(spark):
    steps = spark.createDataFrame([(1, 0.0, 5.0, "a"), (1, 4.0, 30.0, "b"), (2, 0.0, 1.0, None)], "s int, lo double, hi double, v string")
    points = spark.createDataFrame([(1, 0, 0.0), (1, 1, 4.5), (1, 2, 5.0), (1, 3, 30.0), (2, 4, 0.5), (3, 5, 1.0), (1, 6, None)], "s int, i int, x double")
    got = {r.i: r.v for r in intervals.step_value(points, steps, ["s"], ["i"], "x", "v", 3.0, "none").collect()}
    assert got == {0: "a", 1: "a", 2: "b", 3: "none", 4: None, 5: "none", 6: "none"}


def test_gradient(spark):
    x = np.cumsum([0.0, 1.0, 0.5, 2.0, 1.5, 0.3])
    y = np.array([1.0, 3.0, 2.0, 2.5, 7.0, 6.0])
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(2, 0.0, 5.0)], "s int, x double, y double")
    got = {(r.s, r.x): r.g for r in linear.gradient(df, ["s"], ["x"], "x", "y", "g").collect()}
    assert np.allclose([got[1, a] for a in x.tolist()], np.gradient(y, x)) and got[2, 0.0] == 0.0


def test_grades_and_a_train_uphill(spark):
    flat = spark.createDataFrame([(1, 1, i * 0.1, 120.0) for i in range(201)], "t int, stretch long, x double, v double").withColumn("rest", F.lit(False))
    level = spark.createDataFrame([(1, x, 0.0) for x in (0.0, 20.0)], "t int, x double, grade double")
    steep = level.withColumn("grade", F.lit(0.015))
    minutes = lambda p: travel.minutes(travel.graded(flat, p, ["t"]), ["t"], travel.LOCO, 160.0).collect()[0].minutes
    without = travel.minutes(flat, ["t"], travel.LOCO, 160.0).collect()[0].minutes
    plain = plain_minutes([i * 0.1 for i in range(201)], [120.0] * 201, [False] * 201, travel.LOCO, 160.0, 0.015)
    assert abs(minutes(level) - without) < 1e-9
    assert abs(minutes(steep) - plain) < 1e-9 and plain > without
    hill = spark.createDataFrame([(1, 1000.0 * i, 10.0 * i + (500.0 if i == 15 else 0.0)) for i in range(30)], "t int, x double, z double")
    got = {r.x: r.grade for r in travel.grades(hill, ["t"], "x", "z").collect()}
    x, z = np.arange(30) * 1000.0, np.array([10.0 * i + (500.0 if i == 15 else 0.0) for i in range(30)])
    median = np.array([np.median(z[max(0, i - 2) : i + 3]) for i in range(30)])
    want = np.gradient(np.convolve(np.pad(median, 3, mode="edge"), np.ones(7) / 7, mode="valid"), x)
    assert np.allclose([got[a] for a in x.tolist()], want)


def test_frozen_minutes(spark):
    free = spark.createDataFrame([("a", 10.0), ("a", 5.0), ("b", 7.0), ("c", 1.0)], "t string, minutes double")
    blocks = spark.createDataFrame([("a", "x", "y"), ("a", "y", "z"), ("c", "x", "q")], "t string, from_stop string, to_stop string")
    pairs = spark.createDataFrame([("x", "y", 3.0), ("x", "y", 5.0), ("y", "z", 2.0)], "from_stop string, to_stop string, minutes double")
    got = {r.t: (r.free, r.frozen, r.minutes) for r in travel.with_frozen(free, blocks, pairs, ["t"]).collect()}
    assert got == {"a": (15.0, 6.0, 21.0), "b": (7.0, 0.0, 7.0), "c": (1.0, None, None)}


def test_bodies(spark):
    """The span between the sharp ends counts, with what lies between; fewer than five rows have no circle."""
    a = np.linspace(0, 1, 9)
    arc = [(1, i, float(500 * math.cos(t)), float(500 * math.sin(t)), 900.0 if i == 4 else 500.0) for i, t in enumerate(a)]
    rows = arc + [(1, 9, 0.0, 0.0, 5000.0), (1, -1, 9.0, 9.0, 720.0)] + [(2, i, float(i), 2.0 * i, 100.0) for i in range(6)] + [(3, 0, 0.0, 0.0, 50.0), (3, 1, 1.0, 0.0, 50.0)]
    df = spark.createDataFrame(rows, "s int, i int, x double, y double, r double")
    got = {r.s: (r.lo, r.hi, r.n_body, r.r_min, r.fitted) for r in corridor.bodies(df, ["s"], "i", "x", "y", "r").collect()}
    assert got[1][:4] == (0, 8, 9, 500.0) and abs(got[1][4] - 500) < 1e-6
    assert got[2] == (0, 5, 6, 100.0, float("inf")) and got[3] == (0, 1, 2, 50.0, None)


def _arcs(spark):
    """Bodies of seven rows on circles of 3e7, 9e6 and 4,000 m."""
    rows = [(s, i, float(40 * i), float((40 * i) ** 2 / (2 * r)), 2000.0) for s, r in ((1, 3e7), (2, 9e6), (3, 4000.0)) for i in range(7)]
    return corridor.bodies(spark.createDataFrame(rows, "s int, i int, x double, y double, r double"), ["s"], "i", "x", "y", "r")


def test_bodies_beyond_the_straight_are_lines(spark):
    """As in the SQL of short_curve_bias: a circle of more than 1e7 m is a line, so its curve has no factor."""
    got = {r.s: r.fitted for r in _arcs(spark).collect()}
    assert got[1] == float("inf") and abs(got[2] / 9e6 - 1) < 1e-3 and abs(got[3] / 4000 - 1) < 1e-2


def test_lines_have_no_bias(spark):
    """As in the SQL of bias_by_length: curves whose body is a line don't count."""
    told = corridor.bias(_arcs(spark).withColumns({"published": F.lit(2000.0), "length": F.lit(500.0)}), "published", "fitted")
    assert [(r.band, r.n, r.km) for r in corridor.bias_by_length(told, "length").collect()] == [(450.0, 2, 1.0)]


def test_bias_by_length(spark):
    rows = [(100.0, 600.0, 500.0), (299.0, 800.0, 400.0), (450.0, 500.0, float("inf")), (500.0, 500.0, 400.0), (2000.0, 900.0, 900.0), (2000.0, 900.0, None), (None, 900.0, 450.0), (10.0, 900.0, 300.0)]
    df = corridor.bias(spark.createDataFrame(rows, "length double, published double, body double"), "published", "body")
    got = {r.band: (r.n, r.km, r.median, r.q75) for r in corridor.bias_by_length(df, "length").collect()}
    assert got == {0.0: (3, 0.409, 2.0, 2.5), 450.0: (1, 0.5, 1.25, 1.25), 900.0: (1, 2.0, 1.0, 1.0)}


def test_planted_bottleneck(spark):
    codes = ["C"] * 12 + ["F"] + ["C"] * 12 + ["F", "F", "F"]
    length = [10.0] * 12 + [1.0] + [10.0] * 12 + [0.1, 6.0, 1.0]
    df = spark.createDataFrame([(1, i, c, n) for i, (c, n) in enumerate(zip(codes, length, strict=True))], "s int, i int, code string, length double")
    got = sorted((r.i, r.drop_classes, r.class_around) for r in synthesis.bottlenecks_of(df, ["s"], ["i"]).collect())
    assert got == [(12, 3, "C"), (27, 3, "C")]


def test_pair_profile_and_cells(spark):
    pairs = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 8.0, 20.0), (1, 3, 90.0, 99.0)], "t int, p int, a_lo double, a_hi double")
    tracks = spark.createDataFrame([(1, 0.0, 8.0, 80.0, "single", "x"), (1, 8.0, 10.0, 200.0, "double", "x"), (1, 10.0, 20.0, 100.0, "multiple", "y")], "t int, b_lo double, b_hi double, v double, state string, owner string")
    out = synthesis.pair_profile(pairs, tracks, ["t"], ["p"], 5.0, 160.0).withColumn("cell", synthesis.cell(F.col("owner"), F.col("single"), F.col("double")))
    got = {r.p: (r.cell, r.owner, round(r.owner_share, 6), round(r.base, 6)) for r in out.collect()}
    assert got == {1: ("single-x", "x", 1.0, 6.75), 2: ("double-y", "y", round(10 / 12, 6), 6.75)}


@pytest.mark.parametrize("name", ["absorbed_short_runs", "despeckled_states"])
def test_rules_on_runs(spark, name):
    rows = track(spark, SF).toPandas().sort_values(["user_id", "us"])
    got = {}
    for r in plans.QUERIES[name](spark, SF).collect():
        got.setdefault(r.user_id, {})[r.segment] = (r["class"] if name == "absorbed_short_runs" else r.state, r.n)
    for user, g in rows.groupby("user_id"):
        mark = g["class"] if name == "absorbed_short_runs" else 1 + np.floor(g["value"] / 170).astype(int)
        run = (mark != mark.shift()).cumsum()
        kind, size = mark.groupby(run).first().tolist(), mark.groupby(run).size().tolist()
        if name == "absorbed_short_runs":
            groups = S.absorb_short_runs(["ABCDEF".index(c) for c in kind], size, 3)
            want = [(kind[i[0]], sum(size[j] for j in i)) for i in groups]
        else:
            want = S.despeckle(kind, size, 3)
        assert [got[user][i] for i in range(len(got[user]))] == want
        assert sum(n for _, n in want) == len(g)


def plain_minutes(x, v, rest, train, cap, grade=0.0):
    """One stretch by a plain loop in km and km/h."""
    x = np.asarray(x) * 1000
    limit = [min(s, cap) / 3.6 for s in v]
    tail = int(round(train.length_m / ((x[-1] - x[0]) / (len(x) - 1))))
    limit = [min(limit[max(0, i - tail) : i + 1]) for i in range(len(x))]
    speed = [0.0 if r or i in (0, len(x) - 1) else s for i, (s, r) in enumerate(zip(limit, rest, strict=True))]
    for i in range(1, len(x)):
        a = acceleration(train, speed[i - 1], grade)
        speed[i] = min(speed[i], max(1.0, speed[i - 1] ** 2 + 2 * a * (x[i] - x[i - 1])) ** 0.5)
    for i in range(len(x) - 2, -1, -1):
        speed[i] = min(speed[i], (speed[i + 1] ** 2 + 2 * train.brake_ms2 * (x[i + 1] - x[i])) ** 0.5)
    return sum((x[i + 1] - x[i]) / max((speed[i] + speed[i + 1]) / 2, 0.5) for i in range(len(x) - 1)) / 60


def test_travel_time_variants(spark):
    got = {(r.user_id, r.variant): (r.minutes, r.gain) for r in plans.QUERIES["travel_time_variants"](spark, SF).collect()}
    parts, blocks, stops = travel.tables_of(spark, SF)
    want = {}
    for free in (True, False):
        pieces = travel.free_pieces(parts, blocks, ["user_id"], 24.0) if free else parts.select("user_id", "lo", "hi", "v")
        rows = travel.stopped(travel.samples(travel.stretches(pieces, ["user_id"], 0.05), ["user_id"], 0.5), stops, ["user_id"]).toPandas().sort_values("x")
        for name, train, cap, own, stopping in travel.variants():
            for (user, _), g in rows.groupby(["user_id", "stretch"]) if own == free else ():
                rest = g["rest"].tolist() if stopping else [False] * len(g)
                want[user, name] = want.get((user, name), 0.0) + plain_minutes(g["x"], g["v"], rest, train, cap)
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k]) < 2e-4 for k in want)
    assert all(abs(g - (want[u, "base"] - want[u, n])) < 3e-4 for (u, n), (_, g) in got.items())


def test_acceleration_of_a_train_has_one_form():
    import duckdb

    for t in (engines.COUPLED, engines.LOCO, engines.TILTING):
        for v, grade in ((0.2, 0.0), (5.0, 0.01), (40.0, -0.02), (70.0, 0.0)):
            ((sql,),) = duckdb.sql(f"SELECT {engines._acceleration_sql(t, f'{v}::DOUBLE', f'{grade}::DOUBLE')}").fetchall()
            assert abs(sql - acceleration(t, v, grade)) < 1e-12


def test_track_states(spark):
    rows = [(1, None, None), (1, 2, 1), (1, 2, 2), (3, 1, 2), (7, 0, 0), (0, 9, 5)]
    df = spark.createDataFrame([(g, t, w) for g, t, w in rows] + [(None, 2, 3)], "g int, t int, w int")
    assert [r[0] for r in df.select(synthesis.reconciled(F.col("g"), F.col("t"), F.col("w"))).collect()] == [1, 1, 2, 3, 3, 3, 2]
    line = [(1, i, float(i), s, u, i < 2) for i, (s, u) in enumerate([(1, "a"), (1, None), (2, "b"), (2, "a"), (1, None), (1, None), (2, "z"), (2, "z"), (2, "y"), (1, "q"), (2, "q")])]
    runs = synthesis.state_runs(spark.createDataFrame(line, "k int, i int, h double, s int, u string, near boolean"), ["k"], ["i"], "h", "s", "u", "near")
    got = [(r.lo, r.hi, r.state, r.usage, r.at_station, r.loop) for r in runs.orderBy("run").collect()]
    assert got == [(0.0, 1.0, 1, "a", True, False), (2.0, 3.0, 2, "a", False, True), (4.0, 5.0, 1, None, False, False), (6.0, 8.0, 2, "z", False, False), (9.0, 9.0, 1, "q", False, False), (10.0, 10.0, 2, "q", False, False)]


def test_unique_network(spark):
    points = [(1, "a", 0, 1), (2, "a", 1, 2), (3, "b", 0, 3), (4, "b", 2, 1), (5, "b", 2, 2), (6, "c", 1, 3), (7, "c", 9, 1), (8, "c", 9, 1)]
    out = synthesis.unique_network(spark.createDataFrame(points, "i int, section string, cell int, state int"), ["cell"], "section", "state")
    assert sorted((r.i, r.cell_state) for r in out.collect()) == [(3, 3), (4, 2), (5, 2), (6, 3), (7, 1), (8, 1)]


@pytest.mark.parametrize("name", ["absorbed_short_runs", "despeckled_states"])
def test_rules_on_runs_stream(spark, name):
    """Sections are cut from sorted partitions; none pays for a pandas group of its own."""
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan

import numpy as np
from pyspark.sql import functions as F

from chainage.functions.traction import Train
from chainage.operators import corridor, linear
from chainage.plans import travel

#: No resistance and endless power: acceleration and braking are constant.
PLAIN = Train("plain", 1e9, 1.0, 0.0, 1.0, 0.0, 0.0, 0.5, 0.5, 1.0, 1.0, 0.0, 0.0)


def closed_form(km, kmh, a=0.5, b=0.5):
    v = kmh / 3.6
    reach = v * v / 2 * (1 / a + 1 / b)
    if reach > km * 1000:
        v = (2 * km * 1000 / (1 / a + 1 / b)) ** 0.5
        reach = km * 1000
    return (v / a + v / b + (km * 1000 - reach) / v) / 60


def run(spark, segments, blocks=(), stops=(), train=PLAIN, cap=300.0, step=0.025):
    s = spark.createDataFrame([(1, i, *x) for i, x in enumerate(segments)], "t int, segment int, lo double, hi double, v double")
    b = spark.createDataFrame([(1, *x) for x in blocks], "t int, b_lo double, b_hi double")
    stop = spark.createDataFrame([(1, x) for x in stops], "t int, stop double")
    pieces = travel.stretches(travel.free_pieces(s, b, ["t"], 5.0), ["t"], 0.05)
    sampled = travel.samples(pieces, ["t"], step)
    return {r.stretch: r.minutes for r in travel.minutes(travel.stopped(sampled, stop, ["t"]), ["t"], train, cap).collect()}


def test_one_stretch_has_the_closed_form(spark):
    for km, kmh in ((20.0, 100.0), (2.0, 200.0)):
        got = run(spark, [(0.0, km, kmh)])
        assert abs(got[1] - closed_form(km, kmh)) < 0.02 * got[1] + 0.05


def test_stops_caps_blocks_and_gaps(spark):
    assert abs(run(spark, [(0.0, 20.0, 100.0)], stops=[10.0])[1] - 2 * closed_form(10.0, 100.0)) < 0.2
    assert abs(run(spark, [(0.0, 20.0, 100.0)], cap=50.0)[1] - closed_form(20.0, 50.0)) < 0.2
    split = run(spark, [(0.0, 20.0, 100.0)], blocks=[(8.0, 12.0), (11.0, 12.5)])
    assert len(split) == 2 and abs(sum(split.values()) - closed_form(8.0, 100.0) - closed_form(7.5, 100.0)) < 0.2
    assert len(run(spark, [(0.0, 5.0, 100.0), (5.04, 10.0, 100.0)])) == 1
    assert len(run(spark, [(0.0, 5.0, 100.0), (5.06, 10.0, 100.0)])) == 2


def test_a_train_must_leave_a_restriction_whole(spark):
    long = PLAIN._replace(length_m=500)
    segments = [(0.0, 10.0, 120.0), (10.0, 10.5, 40.0), (10.5, 20.0, 120.0)]
    assert run(spark, segments, train=long)[1] > run(spark, segments)[1] + 0.3


def test_corridor(spark):
    points = spark.createDataFrame([("s1", i, float(i), 0.0) for i in range(5)] + [("s2", i, float(9 - i), 1.0) for i in range(9)], "shape_id string, n int, x double, y double")
    trips = spark.createDataFrame([("r", "s1"), ("r", "s2"), ("q", "s1")], "route_id string, shape_id string")
    got = {r.route_id: (r.shape_id, r.n) for r in corridor.representative_shapes(points, trips).collect()}
    assert got == {"r": ("s2", 9), "q": ("s1", 5)}
    starts = spark.createDataFrame([("s1", 0.0, 0.0), ("s2", 0.0, 0.0)], "shape_id string, sx double, sy double")
    turned = corridor.oriented(points, "shape_id", "n", starts)
    assert {r.shape_id: r.x for r in turned.where("i = 0").collect()} == {"s1": 0.0, "s2": 1.0}
    stations = spark.createDataFrame([("a", 2.2, 0.1), ("b", 50.0, 50.0)], "station string, px double, py double")
    vertices = points.where("shape_id = 's1'").select(F.col("n").alias("vertex"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    assert [(r.station, r.vertex) for r in corridor.stations_along(stations, vertices, 1.0).collect()] == [("a", 2)]


def test_heading_and_gate(spark):
    t = np.linspace(0, np.pi / 2, 50)
    rows = [(1, float(i), float(100 * np.sin(a)), float(100 * (1 - np.cos(a))), float(np.degrees(a)), 100.0) for i, a in enumerate(t)]
    df = spark.createDataFrame(rows, "k int, s double, x double, y double, heading double, r double")
    out = {r.s: r.b for r in linear.heading_by_distance(df, ["k"], "s", "x", "y", 3.0, "b").collect()}
    assert abs(out[25.0] - (90 - np.degrees(t[25]))) < 0.01 and abs(out[0.0] - (90 - np.degrees(t[3]) / 2)) < 0.01
    gate = linear.deflection_gate(df, ["k"], ["s"], "heading", "r", 5, 15.0, "g")
    got = {r.s: r.g for r in gate.collect()}
    assert got[25.0] == 100.0 and got[0.0] == float("inf")


def test_speeds_in_both_directions(spark):
    """A hill is climbed slower than it is run down; on the flat both directions mirror each other."""
    from pyspark.sql import functions as F

    from chainage.functions.traction import TILTING, acceleration
    from chainage.plans import engines

    rows = [(s, i * 100.0, 700.0 if 40 <= i <= 60 else 40_000.0, (0.012 if s == 2 else 0.0)) for s in (1, 2) for i in range(101)] + [(3, 0.0, 500.0, 0.0), (3, 50.0, 500.0, 0.0)]
    df = spark.createDataFrame(rows, "s int, x double, r double, g double")
    profile = engines.speed_profiles(df, ["s"], "x", "r", 4.824, 201.0, TILTING, "g")
    got = {}
    for r in sorted(profile.collect(), key=lambda r: (r.s, r.x)):
        got.setdefault(r.s, []).append((r.out_ms, r.back_ms))
    flat, hill = got[1], got[2]
    assert all(abs(a[0] - b[1]) < 1e-9 for a, b in zip(flat, flat[::-1], strict=True)) and flat[0] == (0.0, 0.0)
    assert all(v <= 4.824 * 700**0.5 / 3.6 + 1e-9 for v, _ in flat[40:61])
    assert sum(v for v, _ in hill) < sum(v for v, _ in flat) and max(v for _, v in hill) > max(v for v, _ in hill)
    # braking and power hold between samples, on the way back with the other sign of the gradient
    for rows, grade in ((hill, 0.012), (flat, 0.0)):
        for way, rise in ((0, grade), (1, -grade)):
            v = [r[way] for r in rows][:: 1 - 2 * way]
            for a, b in zip(v, v[1:], strict=False):
                assert b * b <= max(1.0, a * a + 200 * acceleration(TILTING, max(a, 0.0), rise)) + 1e-6 and a * a <= b * b + 200 * TILTING.brake_ms2 + 1e-6
    places = spark.createDataFrame([(1, "m", 5050.0), (2, "e", -5.0), (2, "f", 99_999.0), (9, "n", 1.0)], "s int, name string, x double")
    at = {r.name: r for r in engines.speeds_at(places, profile, ["s"], "x", 3000.0).collect()}
    assert abs(at["m"].out_ms - (flat[50][0] + flat[51][0]) / 2) < 1e-9 and at["m"].top_ms == max(at["m"].out_ms, at["m"].back_ms)
    assert at["e"].out_ms == hill[0][0] and at["f"].back_ms == hill[-1][1] and at["n"].top_ms is None
    assert F is not None


def test_pieces_stand_for_their_samples(spark):
    """Minutes from pieces are those from all samples: gaps, pieces of no length, equal starts, stops on and between samples and outside."""
    import random

    rng, pieces, stops = random.Random(4), [], []
    for line in range(12):
        at = rng.uniform(0, 3)
        for k in range(rng.randint(1, 25)):
            end = at + rng.choice((0.0, 0.2, 0.5, 1.0, 7.3, 20.0))
            pieces.append((line, at, end, float(rng.randint(40, 220))))
            if k % 6 == 5:
                pieces.append((line, at, end, 90.0))
            at = end + rng.choice((0.0, 0.0, 0.01, 0.4))
        stops += [(line, x) for x in (-1.0, 0.5, at / 2, rng.uniform(0, at), rng.uniform(0, at), at + 5)]
    p = travel.stretches(spark.createDataFrame(pieces, "t long, lo double, hi double, v double"), ["t"], 0.05).localCheckpoint()
    s = spark.createDataFrame(stops, "t long, stop double")
    runs = [("a", travel.LOCO, 153.0, True), ("b", travel.TILTING, 177.0, False)]
    plain = travel.minutes_of(travel.stopped(travel.samples(p, ["t"], 0.5), s, ["t"]), ["t"], runs).collect()
    short = travel.minutes_of(travel.with_rests(travel.sampled_pieces(p, ["t"], 0.5), s, ["t"], 5.0), ["t"], runs).collect()
    assert len(plain) > 30 and sorted(plain) == sorted(short)


def test_samples_are_not_shuffled(spark):
    """Samples are made where trains are moved: between the two no rows are exchanged."""
    plan = travel.travel_time_variants(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    moved = plan.split("MapInPandas")[1:]
    assert moved and all(0 < part.find("Generate explode") < part.find("Exchange") for part in moved)

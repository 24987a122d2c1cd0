"""The curvature chain on lines of known radii."""

import math

import numpy as np
import pytest

from chainage.operators import curvature as C
from chainage.sources import shared

LINE = "s int, v int, x double, y double, i string, radius string"


def drawn(pieces, spacing=25.0, noise=0.0, seed=0):
    """Vertices of straights (length, inf) and arcs (length, radius; negative: to the right)."""
    rng = np.random.default_rng(seed)
    x = y = heading = 0.0
    out = [(x, y)]
    for length, radius in pieces:
        n = round(length / spacing)
        for _ in range(n):
            turn = 0.0 if math.isinf(radius) else spacing / radius
            x, y = x + spacing * math.cos(heading + turn / 2), y + spacing * math.sin(heading + turn / 2)
            heading += turn
            out.append((x, y))
    return [(a + noise * rng.normal(), b + noise * rng.normal()) for a, b in out]


def table(spark, lines):
    rows = [(s, v, None if p is None else float(p[0]), None if p is None else float(p[1]), "i", "r") for s, line in lines.items() for v, p in enumerate(line)]
    return spark.createDataFrame(rows, LINE)


def measure(spark, lines, **how):
    out = {}
    for r in sorted(C.measured(table(spark, lines), ["s"], ["v"], "x", "y", **how).collect(), key=lambda r: (r.s, r.i)):
        out.setdefault(r.s, []).append(r.radius)
    return {s: np.array(r) for s, r in out.items()}


@pytest.mark.parametrize("radius", [450.0, 800.0, 1500.0, 3000.0])
def test_arc_between_straights(spark, radius):
    line = drawn([(1500, math.inf), (1800, radius), (1500, math.inf)], 10.0)
    r = measure(spark, {1: line})[1]
    assert len(r) == pytest.approx(481, abs=1)
    assert np.allclose(r[200:280], radius, rtol=0.02)
    assert (r[:90] == 50_000).all() and (r[-90:] == 50_000).all()
    assert r.min() > 0.95 * radius


def test_opposite_arcs_are_fitted_apart(spark):
    lines = {1: drawn([(600, math.inf), (800, 500.0), (800, -500.0), (600, math.inf)], 10.0), 2: drawn([(700, 700.0)] + [(500, -400.0), (500, 400.0)] * 3, 10.0, 1.0), 3: drawn([(3000, math.inf)], 10.0, 1.0)}
    points = C.checkpoint(C.resampled(table(spark, lines), ["s"], ["v"], "x", "y", 10.0))
    cuts = {}
    for r in C.splits(points, ["s"]).collect():
        cuts.setdefault(r.s, []).append(r.i)
    assert len(cuts[1]) == 1 and abs(cuts[1][0] - 140) <= 10
    assert len(cuts[2]) == 6 and 3 not in cuts
    r = measure(spark, lines)
    assert np.all(np.abs(r[1][100:130] / 500 - 1) < 0.15) and np.all(np.abs(r[1][150:180] / 500 - 1) < 0.15)
    assert r[2].min() > 0.6 * 400 and (r[3] == 50_000).mean() > 0.95
    # without the cut, fits reach over both arcs and read them too wide
    none = C.splits(points.limit(0), ["s"])
    blurred = np.array([x.radius for x in sorted(C.along(points.where("s = 1"), ["s"], cuts=none).collect(), key=lambda x: x.i)])
    assert (blurred[130:150] > 1.18 * 500).all() and (np.abs(r[1][130:150] / 500 - 1) < 0.05).all()


def test_chunks_and_blocks_change_nothing(spark, monkeypatch):
    lines = {1: drawn([(900, 600.0), (700, -900.0), (1500, math.inf), (500, 400.0), (600, -700.0)], 17.0, 0.5), 2: drawn([(300, 500.0), (250, -400.0)], 17.0, 0.5, 1)}
    want = measure(spark, lines)
    monkeypatch.setattr(C, "ROWS", 60)
    got = measure(spark, lines)
    assert got.keys() == want.keys() and all(np.allclose(got[s], want[s], rtol=1e-6) for s in want)
    rows = table(spark, lines).withColumn("block", C.F.floor(C.F.col("v") / 20))
    again = {}
    for r in sorted(C.measured(rows, ["s"], ["v"], "x", "y", block="block").collect(), key=lambda r: (r.s, r.i)):
        again.setdefault(r.s, []).append(r.radius)
    assert all(np.allclose(again[s], want[s], rtol=1e-6) for s in want)


def test_even_points(spark):
    lines = {1: [(0, 0), (0, 0), (3, 4), None, (3, 4.001), (3, 30)], 2: [(5, 5)], 3: [None], 4: [(0, 0), (20, 0)]}
    got = sorted(tuple(r) for r in C.resampled(table(spark, lines), ["s"], ["v"], "x", "y", 10.0).collect())
    want = [(1, 0, 0, 0), (1, 1, 3, 9), (1, 2, 3, 19), (1, 3, 3, 29), (2, 0, 5, 5), (4, 0, 0, 0), (4, 1, 10, 0), (4, 2, 20, 0)]
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2:] for g in got], [w[2:] for w in want], atol=0.002)
    assert C.resampled(table(spark, {}), ["s"], ["v"], "x", "y", 10.0).count() == 0


def test_defined_edges(spark):
    assert measure(spark, {}) == {}
    r = measure(spark, {1: [(0, 0)], 2: [(0, 0), (15, 0)], 3: drawn([(300, 200.0)], 10.0), 4: drawn([(100, 50.0)], 10.0), 5: [None, (1, 1)]})
    assert r[1].tolist() == [50_000] and r[2].tolist() == [50_000] * 2 and r[5].tolist() == [50_000]
    assert np.allclose(r[3][5:-5], 200, rtol=0.05) and len(r[4]) == 11 and (r[4] >= 100).all()
    with pytest.raises(ValueError):
        C.along(C.resampled(table(spark, {}), ["s"], ["v"], "x", "y", 10.0), ["s"], C.Survey(window=5000.0))


def test_partitions_grow_with_the_points(spark, monkeypatch):
    """What a task sorts is bounded, however few shuffle partitions the session has."""
    monkeypatch.setattr(shared, "ROWS_A_TASK", 100)
    points = C.checkpoint(spark.range(4000).selectExpr("id div 400 as s", "id % 400 as i", "cast(id % 400 as double) * 10 as x", "0.0D as y"))
    rows = C.chunked(points, ["s"], points.count())
    assert rows.rdd.getNumPartitions() == 40
    assert C.along(points, ["s"]).count() == 4000


def test_radii_stay_in_bounded_partitions(spark, monkeypatch):
    """Fits, too, run in as many partitions as the points need."""
    monkeypatch.setattr(shared, "ROWS_A_TASK", 100)
    points = C.checkpoint(spark.range(2000).selectExpr("id div 400 as s", "id % 400 as i", "cast(id % 400 as double) * 10 as x", "0.0D as y"))
    cuts = spark.createDataFrame([(1, 200)], "s long, i long")
    out = C.along(points, ["s"], cuts=cuts)
    assert out.rdd.getNumPartitions() == 20 and {r.radius for r in out.collect()} == {50_000.0}


def test_few_steps_run_in_as_many_tasks_as_points_need(spark, monkeypatch):
    """The merging of splits, too, and no row is broadcast because its file is small."""
    monkeypatch.setattr(shared, "ROWS_A_TASK", 100)
    points = C.checkpoint(spark.range(2000).selectExpr("id div 400 as s", "id % 400 as i", "cast(id % 400 as double) * 10 as x", "200 * sin(id % 400 / 20) as y"))
    assert C.splits(points, ["s"]).rdd.getNumPartitions() == 20
    rows = spark.range(2000).selectExpr("id div 400 as s", "id % 400 as i", "id % 400 div 50 as b")
    out = C.linear.numbered(rows, ["s"], ["i"], "n", "b")
    assert out.where("n <> i").count() == 0 and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_two_surveys_in_one_pass(spark):
    """Radii of several surveys are those of each alone, and the points are shuffled once for all of them."""
    from pyspark.sql import functions as F

    t = F.col("i") / 40.0
    points = spark.range(2600).select(F.lit(1).alias("s"), F.col("id").alias("i")).select("s", "i", (F.col("i") * 10 + 200 * F.sin(t)).alias("x"), (900 * F.cos(t / 3)).alias("y")).localCheckpoint()
    wide, fine = C.Survey(), C.Survey(window=300.0)
    cuts = C.splits(points, ["s"], wide).localCheckpoint()
    both = C.along_each(points, ["s"], {"a": wide, "b": fine}, cuts)
    assert cuts.count() > 5
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(both.select("i", "x", "y", "a")) == rows(C.along(points, ["s"], wide, cuts).drop("s"))
    assert rows(both.select("i", "x", "y", "b")) == rows(C.along(points, ["s"], fine, cuts).drop("s"))
    assert rows(both.select("a")) != rows(both.select("b"))
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1

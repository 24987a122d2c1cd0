"""Lines as columns against plain loops, and the inverse of the projection."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chainage.functions import scalar


def test_projection_and_back(spark):
    places = [(lat, lon) for lat in (0.0, 12.5, 45.501, 60.0, 71.2, 83.9) for lon in (-76.9, -75.0, -73.2)]
    df = spark.createDataFrame([*places, (None, 1.0)], "lat double, lon double")
    east, north = scalar.transverse_mercator(F.col("lat"), F.col("lon"), F.lit(-75.0))
    back = df.select("lat", "lon", east.alias("e"), north.alias("n")).select("lat", "lon", *[c.alias(k) for k, c in zip("ab", scalar.from_transverse_mercator(F.col("e"), F.col("n"), F.lit(-75.0)), strict=True)])
    for r in back.collect():
        assert r.a is None if r.lat is None else (r.a, r.b) == pytest.approx((r.lat, r.lon), abs=1e-8)


def plain_along(line, d):
    at, s = line[0], 0.0
    for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
        n = math.hypot(bx - ax, by - ay)
        if n > 0 and d > s:
            t = min((d - s) / n, 1)
            at = (ax + t * (bx - ax), ay + t * (by - ay))
        s += n
    return at


def plain_place(line, x, y):
    best, s = None, 0.0
    for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
        n = math.hypot(bx - ax, by - ay)
        t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / (n * n))) if n else 0
        off = math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))
        if best is None or off < best[1]:
            best = (s + t * n, off)
        s += n
    return best


def test_lines(spark):
    rng = random.Random(5)
    lines = [[(rng.randint(-9, 9) * 1.0, rng.randint(-9, 9) * 1.0) for _ in range(rng.randint(1, 8))] for _ in range(60)]
    rows = [(i, line, rng.uniform(-3, 60), rng.uniform(-12, 12), rng.uniform(-12, 12)) for i, line in enumerate(lines)]
    schema = "i long, line array<struct<x double, y double>>, d double, x double, y double"
    df = spark.createDataFrame([*rows, (60, [], 1.0, 0.0, 0.0), (61, None, 1.0, 0.0, 0.0), (62, [(1.0, 1.0), (1.0, 1.0)], None, 4.0, 5.0)], schema)
    x, y = F.col("x"), F.col("y")
    out = df.select("i", scalar.line_length("line").alias("n"), scalar.along_line("line", F.col("d")).alias("at"), scalar.place_on_line("line", x, y).alias("p"), scalar.in_buffer("line", x, y, 4.0).alias("near"))
    got = {r.i: r for r in out.collect()}
    for i, line, d, px, py in rows:
        assert tuple(got[i].at) == pytest.approx(plain_along(line, d))
        want = plain_place(line, px, py)
        assert (got[i].p is None and got[i].near is None) if want is None else (tuple(got[i].p) == pytest.approx(want) and got[i].near == (want[1] <= 4))
        assert got[i].n == pytest.approx(sum(math.dist(a, b) for a, b in zip(line, line[1:], strict=False)))
    assert (got[60].n, got[60].at, got[60].p, got[61].n, got[61].at, got[61].p) == (0.0, None, None, None, None, None)
    assert got[62].at is None and tuple(got[62].p) == (0.0, 5.0)

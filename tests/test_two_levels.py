"""Operators along a line give the same in blocks, cells and chunks as over whole sections, and a hot section is spread."""

import random

import pytest
from pyspark.sql import functions as F

from chainage.operators import linear, robust

KEYS, ORDER = ["s"], ["i"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for s, n in ((1, 700), (2, 40), (3, 1), (4, 5)):
        x = 0.0
        for i in range(n):
            x += rng.choice([0.0, 0.5, 1.0, 7.25])
            data.append((s, i, x, rng.choice([None, *[float(k) for k in range(9)]]), rng.uniform(-3, 3), rng.randrange(6)))
    rng.shuffle(data)
    return spark.createDataFrame(data, "s int, i int, x double, y double, a double, k int").withColumn("b", F.floor(F.col("i") / 16)).cache()


OPERATORS = {
    "rolling_median": lambda d, b: robust.rolling_median(d, KEYS, ORDER, "a", 4, "o", b),
    "median_filter": lambda d, b: robust.median_filter(d, KEYS, ORDER, "a", 3, "o", b),
    "moving_average": lambda d, b: robust.moving_average(d, KEYS, ORDER, "a", 3, "o", b),
    "trailing_min": lambda d, b: robust.trailing_min(d, KEYS, ORDER, "a", 5, "o", b),
    "neighbour_rank": lambda d, b: robust.neighbour_rank(d, KEYS, ORDER, "k", 4, "o", b),
    "derivative": lambda d, b: linear.derivative(d, KEYS, ORDER, "i", "a", 2, "o", b),
    "gradient": lambda d, b: linear.gradient(d, KEYS, ORDER, "x", "a", "o", b),
    "unwrapped": lambda d, b: linear.unwrapped(d, KEYS, ORDER, "a", "o", b),
    "trapezoid_time": lambda d, b: linear.trapezoid_time(d, KEYS, ORDER, "x", "a", "o", 0.5, b),
    "braking": lambda d, b: linear.braking(d, KEYS, ORDER, "x", "a", 0.5, "o", b),
    "suffix_min": lambda d, b: linear.suffix_min(d, KEYS, ORDER, "y", "o", b),
    "deflection_gate": lambda d, b: linear.deflection_gate(d, KEYS, ORDER, "a", "x", 3, 1.0, "o", b),
    "decimated": lambda d, b: linear.decimated(d, KEYS, ORDER, 3, b).withColumn("o", F.lit(1)),
    "running_sums": lambda d, b: linear.running_sums(d, KEYS, ORDER, {"o": F.col("y"), "o2": F.col("a")}, b).withColumn("o", F.col("o") + F.col("o2")),
}


def table(df):
    return sorted((r.s, r.i, None if r.o is None else round(float(r.o), 9)) for r in df.select("s", "i", "o").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_blocks(rows, monkeypatch, name):
    halo = linear.with_halo
    monkeypatch.setattr(linear, "with_halo", lambda df, keys, number, half, rows=23: halo(df, keys, number, half, 23))
    assert table(OPERATORS[name](rows, "b")) == table(OPERATORS[name](rows, None))


def plain_between(points, marks, at):
    down, up = [m for m in marks if m[0] <= at], [m for m in marks if m[0] >= at]
    return max(down, default=None), min(up, default=None)


@pytest.mark.parametrize("width", [None, 5.0, 1000.0])
def test_between_and_interpolate(spark, rows, width):
    rng = random.Random(9)
    marks = [(s, float(rng.randrange(0, 1500)) / 4, rng.randrange(5)) for s in (1, 2, 9) for _ in range(60)] + [(1, None, 3)]
    m = spark.createDataFrame(marks, "s int, x double, v int")
    points = rows.select("s", "i", F.when(F.col("i") % 50 != 7, F.col("x")).alias("x"))
    got = {(r.s, r.i): r for r in linear.between(points, m, KEYS, "x", ["v"], width).collect()}
    assert len(got) == points.count()
    for (s, _), r in got.items():
        own = [(x, v) for k, x, v in marks if k == s and x is not None]
        down, up = plain_between(points, own, r.x) if r.x is not None else (None, None)
        assert ((r.down_at, r.down_v), (r.up_at, r.up_v)) == (down or (None, None), up or (None, None))
    for side, direction in (("down", "backward"), ("up", "forward")):
        one = {(r.s, r.i): (r.mark_at, r.v) for r in linear.asof(points, m, KEYS, "x", ["v"], direction, width).collect()}
        assert one == {k: (r[f"{side}_at"], r[f"{side}_v"]) for k, r in got.items()}
    even = linear.interpolate(points, m, KEYS, "x", "v", "o", width).collect()
    for r in even:
        g = got[r.s, r.i]
        if g.down_at is None or g.up_at is None:
            assert r.o == (g.up_v if g.down_at is None else g.down_v)
        else:
            share = 0 if g.up_at == g.down_at else (r.x - g.down_at) / (g.up_at - g.down_at)
            assert abs(r.o - (g.down_v + share * (g.up_v - g.down_v))) < 1e-9 or g.up_at == g.down_at


def test_no_row_window_over_a_whole_section(spark, rows):
    """With blocks, what is sorted by section alone has one row per block."""
    for f in (lambda b: linear.braking(rows, KEYS, ORDER, "x", "a", 0.5, "o", b), lambda b: linear.interpolate(rows.drop("y"), rows.select("s", "x", F.col("a").alias("v")), KEYS, "x", "v", "o", 10.0 if b else None)):
        plan = f("b")._jdf.queryExecution().optimizedPlan().toString()
        alone = [line for line in plan.splitlines() if "Window [" in line and "], [s#" in line and ", b#" not in line.split("], [")[1] and "__cell" not in line.split("], [")[1]]
        assert all("Aggregate" in plan.splitlines()[k + 1] or "Project" in plan.splitlines()[k + 1] or "Window" in plan.splitlines()[k + 1] for k, line in enumerate(plan.splitlines()[:-1]) if line in alone)


def test_exact_quantiles(spark):
    import numpy as np

    rng = random.Random(11)
    data = {1: [rng.choice([0.0, 1.0, 1e9, -5.0, rng.uniform(0, 3)]) for _ in range(999)], 2: [7.0] * 50, 3: [2.5], 4: [None, None], 5: [1.0, 2.0, None]}
    df = spark.createDataFrame([(k, v) for k, rows in data.items() for v in rows], "k int, v double")
    shares = {"lo": 0.0, "q": 0.1, "m": 0.5, "p": 0.97, "hi": 1.0}
    got = {r.k: r for r in robust.exact_quantiles(df, ["k"], "v", shares, 8).collect()}
    assert got.keys() == {1, 2, 3, 5}
    for k, r in got.items():
        own = [v for v in data[k] if v is not None]
        assert r.n == len(own) and all(np.isclose(r[c], np.quantile(own, q)) for c, q in shares.items())

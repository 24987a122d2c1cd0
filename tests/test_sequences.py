import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from chainage.functions.traction import COUPLED, LOCO, TILTING, seconds_to
from chainage.operators import sequences as S

RUNS = st.lists(st.tuples(st.integers(0, 5), st.integers(1, 9)), min_size=1, max_size=25)


def restarting_absorb(rank, length, least):
    """The rule told plainly: one merge, then from the start again."""
    groups = [([i], n) for i, n in enumerate(length)]
    while True:
        for i in range(1, len(groups)):
            g, n = groups[i]
            if n >= least:
                continue
            r, left = rank[g[0]], rank[groups[i - 1][0][0]]
            after = groups[i + 1] if i + 1 < len(groups) else None
            if r > left and (after is None or r > rank[after[0][0]]):
                continue
            if after is not None and after[1] > groups[i - 1][1]:
                groups[i : i + 2] = [(g + after[0], n + after[1])]
            else:
                groups[i - 1 : i + 1] = [(groups[i - 1][0] + g, groups[i - 1][1] + n)]
            break
        else:
            return [g for g, _ in groups]


def restarting_despeckle(state, length, least):
    points = [s for s, n in zip(state, length, strict=True) for _ in range(n)]
    while True:
        runs = []
        for s in points:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        short = next((k for k, r in enumerate(runs) if r[1] < least), None)
        if short is None or len(runs) == 1:
            return [tuple(r) for r in runs]
        left = runs[short - 1] if short else None
        right = runs[short + 1] if short + 1 < len(runs) else None
        best = left if right is None or (left is not None and left[1] >= right[1]) else right
        runs[short][0] = best[0]
        points = [s for s, n in runs for _ in range(n)]


@settings(max_examples=300, deadline=None)
@given(RUNS, st.integers(1, 8))
def test_absorb_equals_restarting(runs, least):
    rank, length = [r for r, _ in runs], [n for _, n in runs]
    got = S.absorb_short_runs(rank, length, least)
    assert got == restarting_absorb(rank, length, least)
    assert [i for g in got for i in g] == list(range(len(runs)))


@settings(max_examples=300, deadline=None)
@given(RUNS, st.integers(1, 8))
def test_despeckle_equals_restarting(runs, least):
    state, length = [], []
    for s, n in runs:  # runs of different states
        if state and state[-1] == s:
            length[-1] += n
        else:
            state.append(s)
            length.append(n)
    assert S.despeckle(state, length, least) == restarting_despeckle(state, length, least)


def test_forward_speeds_and_braking():
    x = np.arange(0, 20_000, 25.0)
    limit = np.full(len(x), 60.0)
    v = S.forward_speeds(limit, x, np.zeros(len(x)), lambda v, g: 0.5)
    assert np.allclose(v[1:], np.minimum(np.sqrt(1.0 * x[1:]), 60.0), atol=0.6)
    assert (np.diff(v) >= 0).all() and S.forward_speeds(np.empty(0), np.empty(0), np.empty(0), lambda v, g: 1).size == 0
    rng = np.random.default_rng(1)
    limit = rng.uniform(5, 60, 500)
    x = np.arange(500) * 25.0
    back = limit.copy()
    for i in range(498, -1, -1):
        back[i] = min(back[i], math.sqrt(back[i + 1] ** 2 + 2 * 0.5 * 25))
    assert np.allclose(np.sqrt(np.minimum.accumulate((limit**2 + x)[::-1])[::-1] - x), back)


def test_calibration(spark):
    from chainage.functions import traction as T

    assert [round(seconds_to(COUPLED, mph * 1.609344)) for mph in (60, 100, 125)] == [60, 170, 312]
    assert seconds_to(LOCO, 400) == float("inf")
    # a table of trainsets gives the same law, and its balancing speeds really balance
    table = T.with_law(spark.createDataFrame([(t.name, *map(float, t[1:])) for t in (LOCO, TILTING, COUPLED)], list(T.Train._fields)))
    rows = {r.name: r for r in table.select("name", *T.Law._fields, T.accelerating(T.F.lit(30.0), 0.01).alias("a"), T.balancing_kmh().alias("top"), T.balancing_kmh(0.01).alias("uphill")).collect()}
    for t in (LOCO, TILTING, COUPLED):
        r = rows[t.name]
        assert np.allclose([r[f] for f in T.Law._fields], T.law(t)) and abs(r.a - T.acceleration(t, 30.0, 0.01)) < 1e-12
        assert abs(T.acceleration(t, r.top / 3.6)) < 1e-9 and abs(T.acceleration(t, r.uphill / 3.6, 0.01)) < 1e-9
    assert rows[TILTING.name].top > rows[LOCO.name].top > 150


def test_circles():
    rng = np.random.default_rng(12345)
    for r in (400, 800, 1500, 3000, 7000):
        t = np.arange(0, 1500, 10.0) / r
        x, y = 5e5 + r * np.sin(t), 5e6 + r * (1 - np.cos(t))
        assert np.allclose(S.circle_radii(x, y, 45)[45:-45], r, rtol=1e-3)
        got = np.median(S.circle_radii(x + rng.normal(0, 0.5, len(x)), y + rng.normal(0, 0.5, len(x)), 45)[45:-45])
        assert 0.8 * r < got < 1.3 * r
    line = np.arange(100.0)
    assert np.isinf(S.circle_radii(line, 2 * line, 5)).all() and np.isinf(S.circle_radii(line[:2], line[:2], 5)).all()


def test_inflections_of_an_s_curve():
    kappa = np.concatenate([np.full(30, 0.01), np.linspace(0.01, -0.01, 11), np.full(30, -0.01)])
    assert S.inflections(kappa, 10, 0.002) == [35]
    assert S.inflections(np.abs(kappa), 10, 0.002) == []
    assert S.merge_splits([5.0, 1.0, 1.2, 9.0], 1.0) == [1.0, 5.0, 9.0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 100), st.floats(0, 100)), max_size=30), st.floats(0.1, 20))
def test_simplified_lines_stay_near(points, tolerance):
    xy = np.array(points, np.float64).reshape(-1, 2)
    kept = S.simplify(xy, tolerance)
    assert len(kept) == 0 or (kept[0] == 0 and kept[-1] == len(xy) - 1)
    for a, b in zip(kept[:-1], kept[1:], strict=True):
        d = xy[b] - xy[a]
        for p in xy[a + 1 : b] - xy[a]:
            far = abs(d[0] * p[1] - d[1] * p[0]) / np.hypot(*d) if d.any() else np.hypot(*p)
            assert far <= tolerance + 1e-6


def test_thinning():
    assert S.thin_by_distance(np.array([0, 1, 2, 5, 6, 11.0]), 3).tolist() == [0, 3, 5]


def test_lines_advance_together():
    """Many lines of different lengths have the speeds that each has alone, at a call for each step of the longest."""
    rng = np.random.default_rng(4)
    n = [1, 2, 300, 280, 7, 290, 40] + [250] * 50
    x = [np.cumsum(rng.uniform(100, 600, k)) for k in n]
    limits, grades = [rng.uniform(5, 60, (3, k)) * (rng.random((3, k)) > 0.05) for k in n], [rng.uniform(-0.01, 0.01, k) for k in n]
    calls = []
    pull = lambda v, g: calls.append(1) or np.minimum(np.array([0.5, 0.4, 0.6]), 9 / np.maximum(v, 1.0)) - 9.81 * g
    got = S.forward_speeds_of(limits, x, grades, pull)
    assert len(calls) < 400
    for a, b, c, v in zip(limits, x, grades, got, strict=True):
        assert np.array_equal(v, S.forward_speeds(a, b, c, pull))

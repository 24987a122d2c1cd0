"""Works on fast runs: minutes against single runs, budgets in order, edge cases."""

import numpy as np
import pytest

from chainage.functions.traction import TILTING, accelerator
from chainage.operators import sequences
from chainage.plans import programme

ROWS = "section long, stretch long, x double, v double, grade double, us long, day long"


def spent(x, limit, grade):
    """Minutes of one run, step by step."""
    limit = np.array(limit) / 3.6
    limit[[0, -1]] = 0
    v = sequences.forward_speeds(limit, x, grade, accelerator((TILTING,)))
    for i in range(len(x) - 2, -1, -1):
        v[i] = min(v[i], np.sqrt(v[i + 1] ** 2 + 2 * TILTING.brake_ms2 * (x[i + 1] - x[i])))
    return sum((b - a) / max((p + q) / 2, 0.5) for a, b, p, q in zip(x, x[1:], v, v[1:], strict=False)) / 60


def line(section, n, fast):
    """A sample each 500 m; fast holds the numbers of samples that allow 230 km/h, others allow 150."""
    return [(section, 1, 500.0 * i, 230.0 if i in fast else 150.0, 0.002 * (i % 3 - 1), i, i // 10) for i in range(n)]


@pytest.fixture(scope="module")
def found(spark):
    data = [*line(1, 60, {*range(10, 30), *range(40, 44)}), *line(2, 20, set()), *line(3, 40, set(range(5, 35))), *line(4, 1, {0})]
    samples = spark.createDataFrame(data, ROWS)
    crossings = spark.createDataFrame([(1, 1, 10_250.0, False), (1, 1, 10_250.0, False), (1, 1, 10_700.0, True), (1, 1, 20_750.0, True), (2, 1, 3000.0, False), (3, 1, 100.0, False), (9, 1, 5.0, False)], "section long, stretch long, x double, private boolean")
    works, rows = programme.works(samples, crossings, ["section", "stretch"], "x", ["us"], "day", 5000.0)
    return data, works.cache(), rows


def test_minutes_of_each_run(found):
    data, works, _ = found
    got = {(w.section, w.run): w for w in works.collect()}
    assert sorted(got) == [(1, 2), (1, 4), (3, 2), (4, 1)]
    for (section, _), w in got.items():
        own = [r for r in data if r[0] == section]
        x, v, g = (np.array([r[k] for r in own]) for k in (2, 3, 4))
        base = np.minimum(v, programme.CAP)
        high = np.where((x >= w.lo) & (x <= w.hi), np.minimum(v, programme.RAISED), base)
        assert w.minutes == pytest.approx(spent(x, base, g) - spent(x, high, g), abs=1e-6)
    assert got[3, 2].minutes > got[1, 4].minutes >= 0 == got[4, 1].minutes


def test_only_crossings_that_are_really_too_fast_cost(found):
    got = {(w.section, w.run): (w.bridges, w.private, w.cost) for w in found[1].collect()}
    assert got[1, 2] == (2, 1, 2 * programme.BRIDGE + programme.PRIVATE)
    assert got[1, 4] == got[3, 2] == got[4, 1] == (0, 0, 0)


def test_budgets_buy_the_best_first(found):
    _, works, rows = found
    keys = ["section", "stretch"]
    chosen = programme.chosen(works, keys, (0, 111, 112))
    ids = {b: sorted((w.section, w.run) for w in chosen.where(f"budget = {b}").collect()) for b in (0, 111, 112)}
    # works without minutes come last, so budgets that the one before them doesn't fit have none of them
    assert ids[0] == ids[111] == [(3, 2)] and ids[112] == [(1, 2), (1, 4), (3, 2), (4, 1)]
    told = {int(r.budget): r for r in programme.bought(chosen, rows, keys, "x").collect()}
    assert [told[b].cost for b in (0, 112)] == [0, 112] and told[112].works == 4
    alone = sum(w.minutes for w in works.collect())
    assert told[0].minutes < told[112].minutes == pytest.approx(alone, rel=0.2)


def test_many_groups_advance_in_parts(spark):
    data = [(*r, i // 2) for i, r in enumerate(line(1, 90, set(range(90))))]
    df = spark.createDataFrame(data, ROWS + ", g long")
    df = df.selectExpr("*", "150.0D as low", "190.0D as top")
    parts = [sorted((r.g, round(r.minutes, 9)) for r in programme.gains(df, ["section"], "x", "low", "top", "g", TILTING, None, n).collect()) for n in (1, 7, 64)]
    assert parts[0] == parts[1] == parts[2] and len(parts[0]) == 45


def test_no_samples_no_works(spark):
    samples = spark.createDataFrame([], ROWS)
    crossings = spark.createDataFrame([], "section long, stretch long, x double, private boolean")
    works, rows = programme.works(samples, crossings, ["section", "stretch"], "x", ["us"], "day", 5000.0)
    assert works.count() == 0 and programme.bought(programme.chosen(works, ["section", "stretch"]), rows, ["section", "stretch"], "x").count() == 0

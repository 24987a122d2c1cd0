"""Gains of frozen blocks: parts against plain arithmetic, runs against single steps."""

import numpy as np
import pytest

from chainage.functions.traction import LOCO, TILTING, accelerator
from chainage.operators import sequences
from chainage.plans import blocks


def parts(g, a, b, c, m):
    gain, sharing, bends, signals, surplus = g - c * m, g - a * m, (a - b) * m, (b - c) * m, 0.0
    if sharing < 0:
        f = gain / max(bends + signals, 1e-9)
        bends, signals, surplus, sharing = bends * f, signals * f, -sharing, 0.0
    return gain, sharing, bends, signals, surplus


def test_parts_of_a_gain(spark):
    data = [(1, 30.0, 20.0, 18.0, 15.0), (2, 20.0, 20.0, 18.0, 15.0), (3, 10.0, 20.0, 18.0, 15.0), (4, 5.0, 7.0, 7.0, 7.0), (5, 21.4, 20.0, 18.0, 15.0)]
    df = spark.createDataFrame([*data, (6, None, 1.0, 1.0, 1.0)], "i long, g double, a double, b double, c double")
    got = {r.i: (r.gain, r.gain_sharing, r.gain_curves, r.gain_signals, r.surplus) for r in blocks.told_apart(df, "g", "a", "b", "c", 1.07).collect()}
    for i, *x in data:
        assert got[i] == pytest.approx(parts(*x, 1.07))
        if i != 4:
            assert sum(got[i][1:4]) == pytest.approx(got[i][0])
    assert got[6][0] is got[6][1] is got[6][4] is None


def one(train, cap, x, v, rest):
    limit = np.minimum(v, cap) / 3.6
    tail = round(train.length_m / (x[1] - x[0]))
    limit = np.array([limit[max(0, i - tail) : i + 1].min() for i in range(len(x))])
    limit[[0, -1]] = 0
    limit[rest] = 0
    s = sequences.forward_speeds(limit, x, np.zeros(len(x)), accelerator((train,)))
    for i in range(len(x) - 2, -1, -1):
        s[i] = min(s[i], np.sqrt(s[i + 1] ** 2 + 2 * train.brake_ms2 * (x[i + 1] - x[i])))
    return sum((b - a) / max((p + q) / 2, 0.5) for a, b, p, q in zip(x, x[1:], s, s[1:], strict=False)) / 60


def test_runs_inside_blocks(spark):
    segments = spark.createDataFrame([(1, 0.0, 6.0, 180.0), (1, 6.0, 14.0, 120.0), (1, 14.0, 30.0, 230.0), (2, 0.0, 5.0, 100.0)], "line long, lo double, hi double, v double")
    spans = spark.createDataFrame([(1, 1, 2.0, 12.0), (1, 2, 12.0, 28.0), (2, 1, 6.0, 9.0)], "line long, block long, b_lo double, b_hi double")
    stops = spark.createDataFrame([(1, 7.0), (1, 7.0), (1, 12.05), (1, 20.0), (1, 29.0), (2, 1.0)], "line long, stop double")
    got = {(r.line, r.block): r for r in blocks.runs_inside(segments, spans, stops, ["line"], 0.9, 0.5, 10.0).collect()}
    assert sorted(got) == [(1, 1), (1, 2)] and got[1, 1].stops == got[1, 2].stops == 1
    for (lo, hi, stop), r in zip([(2.0, 12.0, 7.0), (12.0, 28.0, 20.0)], [got[1, 1], got[1, 2]], strict=True):
        km = np.linspace(lo, hi, int((hi - lo) / 0.5) + 1)
        v = np.where(km < 6, 180.0, np.where(km < 14, 120.0, 230.0))
        x, rest = km * 1000, np.flatnonzero(km == stop)
        want = [one(LOCO, blocks.CAP, x, v * 0.9, rest), one(TILTING, blocks.CAP, x, v, rest), one(TILTING, blocks.RAISED, x, v, rest)]
        assert [r.now, r.curves, r.raised] == pytest.approx([w + blocks.DWELL for w in want])
        assert r.now > r.curves >= r.raised
    assert blocks.runs_inside(segments.limit(0), spans, stops, ["line"], 0.9, 0.5, 10.0).count() == 0

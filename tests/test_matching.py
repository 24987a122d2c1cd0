"""Map matching against a plain loop over whole polylines, and on planted tracks."""

import math
import os

import numpy as np
import pytest

from chainage.operators import matching as M

SF = "/root/testdata/sf0.001"
POINTS = "section int, i long, px double, py double"
SEGMENTS = "edge long, seq int, u long, v long, ax double, ay double, bx double, by double"


class Polyline:
    def __init__(self, edge, u, v, xy):
        self.edge, self.u, self.v, self.xy = edge, u, v, np.array(xy, np.float64)
        self.step = np.diff(self.xy, axis=0)
        self.size = np.hypot(*self.step.T)
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        self.length = self.at[-1]

    def foot(self, p):
        """(distance, offset, bearing) of the nearest place."""
        share = np.clip(((p - self.xy[:-1]) * self.step).sum(1) / self.size**2, 0, 1)
        d = np.hypot(*(self.xy[:-1] + share[:, None] * self.step - p).T)
        k = int(np.lexsort((np.arange(len(d)), d))[0])
        return d[k], self.at[k] + share[k] * self.size[k], bearing(self.step[k])

    def leaving(self, node):
        return bearing(self.step[0]) if node == self.u else bearing(-self.step[-1])


def bearing(d):
    return (math.degrees(math.atan2(d[0], d[1])) + 360) % 360


def plain_match(track, edges, rules):
    """One track, point by point, every edge looked at."""
    track = np.array(track, np.float64)
    feet = [[e.foot(p) for e in edges] for p in track]
    n, out, lock = len(track), [], None

    def fit(i, k):
        near = [feet[j][k][0] if feet[j][k][0] <= rules.reach else math.inf for j in range(i, min(n, i + rules.ahead))]
        return float(np.median(near)) if len(near) >= rules.least_ahead and sorted(near)[len(near) // 2] < math.inf else (math.inf if len(near) >= rules.least_ahead else None)

    def enter(i, k, heading):
        d, off, b = feet[i][k]
        same = abs((b - heading + 180) % 360 - 180) <= 90
        return [k, 1 if same else -1, off if same else edges[k].length - off]

    def line_angle(a, b):
        d = abs((a - b + 180) % 360 - 180)
        return min(d, 180 - d)

    for i, p in enumerate(track):
        a, b = track[max(0, i - 1)], track[min(n - 1, i + 1)]
        heading = bearing(b - a)
        near = sorted((feet[i][k][0], edges[k].edge, k) for k in range(len(edges)) if feet[i][k][0] <= rules.reach)
        aligned = [x for x in near if line_angle(feet[i][x[2]][2], heading) <= rules.align]
        told = None
        if lock is not None:
            for _ in range(rules.switches):
                k, way, before = lock
                d, off, _ = feet[i][k]
                if d > rules.reach:
                    break
                off = off if way == 1 else edges[k].length - off
                if d <= rules.stay and off <= edges[k].length - 0.01 and off >= before - rules.backtrack:
                    lock = [k, way, off]
                    told = ("locked", "high", d)
                    break
                if off <= edges[k].length - rules.end:
                    break
                node = edges[k].v if way == 1 else edges[k].u
                onward = []
                for _, e, c in near:
                    if c != k and node in (edges[c].u, edges[c].v):
                        turn = line_angle(edges[c].leaving(node), heading)
                        if turn <= rules.junction:
                            f = fit(i, c)
                            onward.append((turn, math.inf if f is None else f, e, c))
                if not onward:
                    break
                straight, close = min(onward, key=lambda o: (o[0], o[2])), min(onward, key=lambda o: (o[1], o[2]))
                best = close if close[1] < math.inf and (straight[1] == math.inf or close[1] + rules.margin < straight[1]) else straight
                lock = [best[3], 1 if edges[best[3]].u == node else -1, 0.0]
        if told is None:
            first = lock is None
            follow = [(fit(i, k), d, e, k) for d, e, k in aligned if fit(i, k) is not None and fit(i, k) < math.inf]
            if not near:
                lock, told = None, ("none", "low", 0.0)
            elif not first and follow:
                _, d, _, k = min(follow)
                lock, told = enter(i, k, heading), ("forced", "med", d)
            else:
                d, _, k = (aligned or near)[0]
                lock = enter(i, k, heading)
                ratio = near[1][0] / max(near[0][0], 0.1) if len(near) > 1 else 99
                sure = ratio >= rules.ambiguous and line_angle(feet[i][k][2], heading) <= rules.align / 2
                told = ("forced", "med", d) if not first else ("bootstrap", "high" if sure else "med", d)
        out.append((edges[lock[0]].edge if lock else None, lock[1] if lock else 0, lock[2] if lock else None, told[2], *told[:2]))
    return out


def tables(spark, tracks, edges):
    points = [(s, i, None if p is None else float(p[0]), None if p is None else float(p[1])) for s, t in tracks.items() for i, p in enumerate(t)]
    segments = [(e.edge, k, e.u, e.v, *map(float, a), *map(float, b)) for e in edges for k, (a, b) in enumerate(zip(e.xy, e.xy[1:], strict=False))]
    return spark.createDataFrame(points, POINTS), spark.createDataFrame(segments, SEGMENTS)


def run(spark, tracks, edges, rules=M.Rules(), **how):
    out = {}
    for r in sorted(M.match(*tables(spark, tracks, edges), ["section"], "i", rules, **how).collect(), key=lambda r: (r.section, r.i)):
        out.setdefault(r.section, []).append((r.edge, r.direction, r.off, r.dist, r.source, r.confidence))
    return out


def same(got, want):
    assert [g[:2] + g[4:] for g in got] == [w[:2] + w[4:] for w in want]
    for g, w in zip(got, want, strict=True):
        assert (g[2] is None) == (w[2] is None) and abs(g[3] - w[3]) < 1e-6 and (g[2] is None or abs(g[2] - w[2]) < 1e-6)


#: A line that forks at (1000, 0): the main track goes on, a siding turns off and comes back at (2000, 0).
FORK = [
    Polyline(1, 10, 11, [(0, 0), (500, 0), (1000, 0)]),
    Polyline(2, 12, 11, [(2000, 0), (1500, 0), (1000, 0)]),
    Polyline(3, 11, 12, [(1000, 0), (1200, 40), (1800, 40), (2000, 0)]),
    Polyline(4, 12, 13, [(2000, 0), (3000, 0)]),
    Polyline(5, 20, 21, [(900, -300), (1100, 300)]),
]


def test_goes_on_over_junctions(spark):
    main = [(x, 3.0) for x in range(0, 3000, 50)]
    siding = [(x, 0.0 if x < 1000 or x > 2000 else min(40, (x - 1000) / 5, (2000 - x) / 5) + 1.0) for x in range(0, 3000, 50)]
    back = main[::-1]
    got = run(spark, {1: main, 2: siding, 3: back}, FORK)
    order = lambda rows: list(dict.fromkeys(r[0] for r in rows))
    assert order(got[1]) == [1, 2, 4] and order(got[2]) == [1, 3, 4] and order(got[3]) == [4, 2, 1]
    assert {(r[0], r[1]) for r in got[1]} == {(1, 1), (2, -1), (4, 1)} and {(r[0], r[1]) for r in got[3]} == {(4, -1), (2, 1), (1, -1)}
    # offsets grow along the edge in the direction of travel
    for rows in got.values():
        assert all(b[2] > a[2] for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0])
        assert [r[4] for r in rows].count("locked") >= len(rows) - 2
    for s, t in {1: main, 2: siding, 3: back}.items():
        same(got[s], plain_match(t, FORK, M.Rules()))


def test_lost_and_found(spark):
    track = [(x, 0.0) for x in range(0, 400, 50)] + [(x, 900.0) for x in range(400, 700, 50)] + [(x, 5.0) for x in range(700, 1000, 50)] + [(400.0, 0.0), (450.0, 0.0)]
    rules = M.Rules(reach=200.0)
    got = run(spark, {1: track, 2: [(0.0, 5000.0)], 3: [(500.0, 10.0)], 4: [None, (500.0, 1.0), (550.0, 1.0)]}, FORK, rules)
    same(got[1], plain_match(track, FORK, rules))
    assert [r[4] for r in got[1][8:14]] == ["none"] * 6 or "forced" in {r[4] for r in got[1]}
    assert got[2] == [(None, 0, None, 0.0, "none", "low")] and got[3][0][0] == 1
    assert got[4][0][4] == "none" and got[4][1][0] == 1
    assert run(spark, {}, FORK) == {} and run(spark, {1: track[:2]}, []) == {1: [(None, 0, None, 0.0, "none", "low")] * 2}


def test_random_networks(spark):
    rng = np.random.default_rng(5)
    nodes = rng.uniform(0, 1500, (25, 2))
    edges = []
    for k in range(45):
        a, b = rng.choice(25, 2, replace=False)
        middle = [(nodes[a] * (1 - t) + nodes[b] * t + rng.normal(0, 20, 2)) for t in (0.3, 0.6)]
        edges.append(Polyline(k, int(a), int(b), [nodes[a], *middle, nodes[b]]))
    tracks = {}
    for s in range(12):
        e = [edges[i] for i in rng.choice(45, 4)]
        tracks[s] = [tuple(p + rng.normal(0, 8, 2)) for x in e for p in (x.xy[0] + (x.xy[-1] - x.xy[0]) * t for t in np.linspace(0, 1, 14))]
    rules = M.Rules(reach=150.0)
    got = run(spark, tracks, edges, rules, cell=200.0)
    for s, t in tracks.items():
        same(got[s], plain_match(t, edges, rules))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_matched_edges_query(spark):
    from chainage.plans import geometry

    line = geometry.lines(spark, SF)
    got = {(r.section, r.i): (r.edge, r.direction, r.off, r.dist, r.source, r.confidence) for r in geometry.matched_edges(spark, SF).collect()}
    parts = {}
    for r in sorted(geometry.network(line).collect(), key=lambda r: (r.edge, r.seq)):
        parts.setdefault(r.edge, []).append(r)
    edges = [Polyline(e, rows[0].u, rows[0].v, [(rows[0].ax, rows[0].ay)] + [(r.bx, r.by) for r in rows]) for e, rows in parts.items()]
    tracks = {}
    for r in sorted(geometry.wandering(line).collect(), key=lambda r: (r.section, r.i)):
        tracks.setdefault(r.section, []).append((r.px, r.py))
    assert sum(map(len, tracks.values())) == len(got)
    for s, t in tracks.items():
        near = [e for e in edges if np.hypot(*(e.xy[:, None] - np.array(t)[None]).T).min() < 1000]
        want = plain_match(t, near, geometry.RULES)
        assert [got[s, i][:2] + got[s, i][4:] for i in range(len(t))] == [w[:2] + w[4:] for w in want]
    assert {"bootstrap", "locked", "forced"} <= {g[4] for g in got.values()}
    # most points are on their own line's way or the one beside it
    assert sum(g[0] is not None and g[0] // 2_000_000 == s for (s, _), g in got.items()) > 0.8 * len(got)


def test_options_are_sent_as_rows_once(spark):
    """No array of options is built and shuffled again; a point's options may be cut anywhere by batches."""
    segments = spark.createDataFrame([(e, k, 10 * e + k, 10 * e + k + 1, 50.0 * k, 4.0 * e, 50.0 * k + 50, 4.0 * e) for e in range(7) for k in range(6)], "edge long, seq long, u long, v long, ax double, ay double, bx double, by double")
    points = spark.createDataFrame([(s, i, 10.0 * i, 3.0 * s + (i % 3)) for s in range(3) for i in range(28)] + [(9, 0, 1e6, 1e6), (9, 1, None, 1.0)], "section long, i long, px double, py double")
    rules = M.Rules(reach=60.0)
    out = M.match(points, segments, ["section"], "i", rules)
    assert "options" not in out._jdf.queryExecution().optimizedPlan().toString()
    whole = sorted(out.collect(), key=lambda r: (r.section, r.i))
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        assert sorted(M.match(points, segments, ["section"], "i", rules).collect(), key=lambda r: (r.section, r.i)) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert len(whole) == 86 and {r.source for r in whole if r.section == 9} == {"none"} and all(r.edge is not None for r in whole if r.section < 9)

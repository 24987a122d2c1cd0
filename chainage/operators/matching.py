"""Map matching: a track of points locked to the edges of a network, one after the other.

`candidates` finds, in DataFrame operations, every edge near a point with the foot on it
(distance, offset along the edge, bearing there) and how well it follows the track's next
points. `match` then walks along each section: the lock of a point depends on that of the
point before, so sorted rows are streamed through a small state (edge, direction, offset).

Edges are tables of segments: edge, seq, u, v (nodes at its ends), ax, ay, bx, by.
"""

from __future__ import annotations

from math import inf
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainage.functions.scalar import bearing_deg
from chainage.operators import linear, sequences
from chainage.operators.spatial import near_segments


class Rules(NamedTuple):
    """Distances in metres, angles in degrees. Defaults are fixed values of the surveyed method."""

    reach: float = 500.0  # an edge further away is no candidate
    align: float = 35.0  # of a candidate and the track, directions aside
    ambiguous: float = 1.2  # second distance over first, under which a first lock is doubtful
    stay: float = 30.0
    backtrack: float = 5.0
    end: float = 5.0  # so near its end an edge may be left for the next one
    junction: float = 60.0
    switches: int = 5  # at most, for one point
    ahead: int = 5  # points, the own one included, that tell how well an edge follows the track
    least_ahead: int = 4
    margin: float = 6.0  # by which an edge has to follow the track better than the one that fits the bearing best


def edge_table(segments: DataFrame) -> DataFrame:
    """(edge, seq, u, v, ax, ay, bx, by, before, length, out_u, out_v): each segment with the length of the edge before it, the edge's length and the bearings in which it leaves its ends."""
    w = Window.partitionBy("edge").orderBy("seq")
    whole = Window.partitionBy("edge")
    own = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    rows = segments.withColumn("own", own).where("own > 0")
    out = bearing_deg(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    back = bearing_deg(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    ends = {"before": F.sum("own").over(w) - F.col("own"), "length": F.sum("own").over(whole), "out_u": F.min_by(out, "seq").over(whole), "out_v": F.max_by(back, "seq").over(whole)}
    return rows.withColumns(ends)


def headed(points: DataFrame, keys: list[str], order: str, x: str = "px", y: str = "py", out: str = "heading", block: str | None = None) -> DataFrame:
    """points with the bearing from the point before to the point after (the point itself at the ends and beside points without coordinates)."""
    here = points.withColumn("__p", F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))
    both = linear.previous(here, keys, [order], "__p", "__a", block)
    # the point after is the point before in reverse order
    both = linear.previous(both.withColumns({"__o": -F.col(order), **({"__b": -F.col(block)} if block else {})}), keys, ["__o"], "__p", "__n", "__b" if block else None)
    a, b = F.coalesce("__a", "__p"), F.coalesce("__n", "__p")
    return both.withColumn(out, bearing_deg(b["x"] - a["x"], b["y"] - a["y"])).drop("__p", "__a", "__n", "__o", "__b")


def candidates(points: DataFrame, edges: DataFrame, keys: list[str], order: str, rules: Rules = Rules(), cell: float | None = None) -> DataFrame:
    """(keys, order, options): the edges within reach of each point, by edge.

    points: (keys, order, px, py, last), order counting from 0 without gaps to last in each
    section; edges: see edge_table. An option has edge, dist, off (along the edge from u),
    bearing (of the edge at the foot), fit, u, v, length, out_u, out_v. fit is the median
    distance of the next points from the edge (infinite if half of them are out of reach),
    null if too few points follow.
    """
    option = F.struct("edge", *_OPTION)
    return near_edges(points, edges, keys, order, rules, cell).groupBy(*keys, order).agg(F.array_sort(F.collect_list(option)).alias("options"))


#: What is told of an edge near a point.
_OPTION = ("dist", "off", "bearing", "fit", "u", "v", "length", "out_u", "out_v")


def near_edges(points: DataFrame, edges: DataFrame, keys: list[str], order: str, rules: Rules = Rules(), cell: float | None = None) -> DataFrame:
    """The options of `candidates` as rows: (keys, order, edge, dist, off, bearing, fit, u, v, length, out_u, out_v)."""
    met = near_segments(points, edges, rules.reach, cell)
    own = F.struct("dist", "seq", (F.col("before") + F.col("share") * F.col("own")).alias("off"), bearing_deg(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("bearing"), "u", "v", "length", "out_u", "out_v")
    # one foot for each point and edge, combined before the shuffle; the first of equally near segments
    near = met.groupBy(*keys, order, "edge").agg(F.min(own).alias("o"), F.first("last").alias("__last"))
    w = Window.partitionBy(*keys, "edge").orderBy(order).rangeBetween(0, rules.ahead - 1)
    asked = F.least(F.lit(rules.ahead).cast("long"), F.col("__last") - F.col(order) + 1)
    near = near.withColumns({"__d": F.array_sort(F.collect_list("o.dist").over(w)), "__m": asked})
    nth = lambda k: F.coalesce(F.get("__d", k.cast("int")), F.lit(inf))
    half = F.floor(F.col("__m") / 2)
    median = F.when(F.col("__m") % 2 == 1, nth(half)).otherwise((nth(half - 1) + nth(half)) / 2)
    near = near.withColumn("fit", F.when(F.col("__m") >= rules.least_ahead, median))
    return near.select(*keys, order, "edge", *["fit" if c == "fit" else F.col(f"o.{c}").alias(c) for c in _OPTION])


def unfolded(a: float, b: float) -> float:
    """Angle of two directions, 0 to 180."""
    d = abs(a - b) % 360.0
    return min(d, 360.0 - d)


def folded(a: float, b: float) -> float:
    """Angle of two lines, 0 to 90."""
    d = unfolded(a, b)
    return min(d, 180.0 - d)


class Lock(NamedTuple):
    edge: int
    direction: int  # 1 from u to v, -1 from v to u
    off: float  # along the edge in this direction


class Fix(NamedTuple):
    """What is told of one point."""

    edge: int | None
    direction: int
    off: float | None
    dist: float
    source: str  # bootstrap, locked, forced or none
    confidence: str  # high, med or low


_NONE = Fix(None, 0, None, 0.0, "none", "low")


def _entered(o: dict, heading: float) -> Lock:
    """The lock on an option, in the direction of the track."""
    forward = unfolded(o["bearing"], heading) <= 90.0
    return Lock(o["edge"], 1 if forward else -1, o["off"] if forward else o["length"] - o["off"])


def _first_lock(options: list[dict], heading: float, rules: Rules) -> tuple[Lock | None, Fix]:
    """The nearest aligned edge, else the nearest."""
    if not options:
        return None, _NONE
    near = sorted(options, key=lambda o: (o["dist"], o["edge"]))
    best = next((o for o in near if folded(o["bearing"], heading) <= rules.align), near[0])
    ratio = near[1]["dist"] / max(near[0]["dist"], 0.1) if len(near) > 1 else 99.0
    sure = ratio >= rules.ambiguous and folded(best["bearing"], heading) <= rules.align / 2
    lock = _entered(best, heading)
    return lock, Fix(*lock, best["dist"], "bootstrap", "high" if sure else "med")


def _onward(lock: Lock, own: dict, options: list[dict], heading: float, rules: Rules) -> Lock | None:
    """The edge on which the track goes on at the end of the lock's edge.

    That of the best bearing, unless another follows the next points better by the margin.
    """
    node = own["v"] if lock.direction == 1 else own["u"]
    found = []
    for o in options:
        if o["edge"] == lock.edge or node not in (o["u"], o["v"]):
            continue
        direction = 1 if o["u"] == node else -1
        off = folded(o["out_u"] if direction == 1 else o["out_v"], heading)
        if off <= rules.junction:
            found.append((off, inf if o["fit"] is None else o["fit"], o["edge"], direction))
    if not found:
        return None
    straight = min(found, key=lambda f: (f[0], f[2]))
    close = min(found, key=lambda f: (f[1], f[2]))
    best = close if close[1] < inf and (straight[1] == inf or close[1] + rules.margin < straight[1]) else straight
    return Lock(best[2], best[3], 0.0)


def _again(options: list[dict], heading: float, rules: Rules) -> tuple[Lock | None, Fix]:
    """A new lock where the old one is lost: the aligned edge that follows the next points best, else as a first lock."""
    fit = [o for o in options if o["fit"] is not None and o["fit"] < inf and folded(o["bearing"], heading) <= rules.align]
    if fit:
        best = min(fit, key=lambda o: (o["fit"], o["dist"], o["edge"]))
        lock, dist = _entered(best, heading), best["dist"]
    else:
        lock, first = _first_lock(options, heading, rules)
        dist = first.dist
    return (lock, Fix(*lock, dist, "forced", "med")) if lock else (None, _NONE)


def advance(lock: Lock | None, options: list[dict], heading: float, rules: Rules = Rules()) -> tuple[Lock | None, Fix]:
    """The lock after one point and what is told of the point."""
    if lock is None:
        return _first_lock(options, heading, rules)
    by = {o["edge"]: o for o in options}
    for _ in range(rules.switches):
        own = by.get(lock.edge)
        if own is None:
            break
        off = own["off"] if lock.direction == 1 else own["length"] - own["off"]
        if own["dist"] <= rules.stay and off <= own["length"] - 0.01 and off >= lock.off - rules.backtrack:
            lock = lock._replace(off=off)
            return lock, Fix(*lock, own["dist"], "locked", "high")
        onward = _onward(lock, own, options, heading, rules) if off > own["length"] - rules.end else None
        if onward is None:
            break
        lock = onward
    return _again(options, heading, rules)


def match(points: DataFrame, segments: DataFrame, keys: list[str], order: str, rules: Rules = Rules(), cell: float | None = None, block: str | None = None) -> DataFrame:
    """(keys, order, edge, direction, off, dist, source, confidence) for each point of each section.

    points: (keys, order, px, py), order counting from 0 without gaps; segments: (edge, seq,
    u, v, ax, ay, bx, by), edge as whole number. A point stays on its edge while it is near,
    not past the edge's end and not going back; at the end it goes on to an edge at that
    node; else it locks anew on the edge that follows the next points best; without an edge
    in reach the lock is lost. Defined edge cases: points without coordinates have no edge
    in reach; ties go to the smaller edge; an empty network locks nothing; segments without
    length or coordinates are left out.
    """
    last = points.groupBy(*keys).agg(F.max(order).alias("last"))
    known = points.join(last, keys)
    found = near_edges(known.select(*keys, order, "px", "py", "last"), edge_table(segments), keys, order, rules, cell)
    # a point's heading and then its options, as rows: they are sent once, and those of one edge lie beside each other when they are
    own = headed(points, keys, order, block=block).select(*keys, order, "heading", *[F.lit(0).cast(t).alias(c) for c, t in found.dtypes if c in ("edge", *_OPTION)])
    rows = own.withColumn("__option", F.lit(0)).unionByName(found.withColumns({"heading": F.lit(0.0), "__option": F.lit(1)}))
    types = dict(points.dtypes)
    named = [*keys, order]
    schema = ", ".join(f"{c} {types[c]}" for c in named) + ", edge long, direction int, off double, dist double, source string, confidence string"

    def walk(state, p, last):
        lock, point = state or (None, None)
        told, out = [], []

        def done():
            nonlocal lock
            name, heading, options = point
            lock, fix = advance(lock, [] if heading != heading else options, heading, rules)
            told.append(name)
            out.append(fix)

        columns = {c: p[c].tolist() for c in ("edge", *_OPTION)}
        for k, (option, heading, *name) in enumerate(zip(p["__option"].tolist(), p["heading"].tolist(), *[p[c] for c in named], strict=True)):
            if option:
                o = {c: x[k] for c, x in columns.items()}
                o["fit"] = None if o["fit"] is None or o["fit"] != o["fit"] else o["fit"]
                point[2].append(o)
            else:
                if point:
                    done()
                point = (name, float("nan") if heading is None else heading, [])
        if last:
            done()
        frame = pd.DataFrame(told, columns=named)
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        frame["edge"] = pd.array(columns[0], dtype="Int64")
        frame["direction"] = np.array(columns[1], np.int32)
        frame["off"] = pd.array(columns[2], dtype="Float64")
        return (lock, point), frame.assign(dist=columns[3], source=columns[4], confidence=columns[5])

    return sequences.in_order(rows, keys, [order, "__option", "edge"], schema, walk)


def runs_of(matched: DataFrame, keys: list[str], order: str, block: str | None = None) -> DataFrame:
    """(keys, run, edge, direction, lo, hi, n, weakest): consecutive points on one edge in one direction, with the offsets between u and v that they cover."""
    state = F.struct("edge", "direction")
    rows = linear.islands(matched.withColumn("__state", F.to_json(state)), keys, [order], "__state", "run", block)
    return rows.groupBy(*keys, "run").agg(F.first("edge").alias("edge"), F.first("direction").alias("direction"), F.min("off").alias("lo"), F.max("off").alias("hi"), F.count("*").alias("n"), _weakest().alias("weakest"))


def _weakest() -> Column:
    """Aggregate: the least confidence."""
    rank = F.max(F.when(F.col("confidence") == "low", 2).when(F.col("confidence") == "med", 1).otherwise(0))
    return F.when(rank == 2, "low").when(rank == 1, "med").otherwise("high")

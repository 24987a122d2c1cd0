"""Lines in the plane made from the events: their curvature chain, and what is measured along them."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainage.functions.scalar import micros
from chainage.operators import corridor, curvature, linear, matching, spatial, tracks
from chainage.plans.registry import query, table
from chainage.sources.shared import checkpoint, drop, release, spread, stored

SURVEY = curvature.Survey()


def path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as vertices of a line for each user: section user_id, number v, x and y in metres, block.

    From one vertex to the next the line runs 40 to 77 m and turns on a radius of 400 m and
    more that grows with the event's value: eighteen vertices to the left, eighteen to the
    right, eighteen almost straight.
    """
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "value", micros(F.col("ts")).alias("us")).withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    n = ev.count()
    rows = linear.numbered(spread(ev, n, "user_id", "day"), ["user_id"], ["us", "event_id"], "v", block="day")
    sense = F.floor((F.col("v") + F.col("user_id") % 18) / 18) % 3
    length = 40 + F.col("event_id") % 37 + F.lit(0.31415926)
    bend = F.when(sense == 0, 1.0).when(sense == 1, -1.0).otherwise(0.03) / (400 + 20 * F.col("value"))
    rows = rows.select("user_id", "event_id", "v", "value", length.alias("len"), bend.alias("k"), F.floor(F.col("v") / 5000).alias("block"))
    rows = checkpoint(linear.running_sums(spread(checkpoint(rows), n, "user_id", "block"), ["user_id"], ["v"], {"heading": F.col("len") * F.col("k")}, "block"))
    rows = linear.running_sums(spread(rows, n, "user_id", "block"), ["user_id"], ["v"], {"x": F.col("len") * F.cos("heading"), "y": F.col("len") * F.sin("heading"), "s": F.col("len")}, "block")
    return checkpoint(rows.select("user_id", "event_id", "v", "value", "block", "x", "y", "s"))


#: The same as `path`, as SQL text to start a query with.
PATH = """WITH RECURSIVE ev AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS v FROM events),
tn AS (SELECT *, 40 + event_id % 37 + 0.31415926::DOUBLE AS len, CASE ((v + user_id % 18) // 18) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN -1.0::DOUBLE ELSE 0.03::DOUBLE END / (400 + 20 * value) AS k FROM ev),
hd AS (SELECT *, sum(len * k) OVER (PARTITION BY user_id ORDER BY v) AS heading FROM tn),
path AS (SELECT user_id, event_id, v, value, sum(len * cos(heading)) OVER w AS x, sum(len * sin(heading)) OVER w AS y, sum(len) OVER w AS s FROM hd WINDOW w AS (PARTITION BY user_id ORDER BY v))
"""


def even_sql(step: float, source: str = "path") -> str:
    """Even and smoothed points (pt: user_id, i, x, y, n) of a table of vertices, as SQL."""
    return f""", e0 AS (SELECT user_id, v, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM {source} WINDOW w AS (PARTITION BY user_id ORDER BY v)),
e1 AS (SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS d FROM e0), e2 AS (SELECT *, sum(coalesce(d, 0)) OVER (PARTITION BY user_id ORDER BY v) AS s FROM e1),
e3 AS (SELECT *, unnest(CASE WHEN d IS NULL THEN [0] ELSE range(CAST(floor((s - d) / {step}) AS BIGINT) + 1, CAST(floor(s / {step}) AS BIGINT) + 1) END) AS i FROM e2),
e4 AS (SELECT user_id, i, coalesce(px + (i * {step} - (s - d)) / d * (x - px), x) AS x, coalesce(py + (i * {step} - (s - d)) / d * (y - py), y) AS y FROM e3),
pt AS (SELECT user_id, i, (coalesce(lag(x) OVER w, x) + x + coalesce(lead(x) OVER w, x)) / 3 AS x, (coalesce(lag(y) OVER w, y) + y + coalesce(lead(y) OVER w, y)) / 3 AS y, count(*) OVER (PARTITION BY user_id) AS n FROM e4 WINDOW w AS (PARTITION BY user_id ORDER BY i))
"""


def _turn_sql(a: str, b: str) -> str:
    return f"coalesce(({a} - {b}) - {2 * pi!r}::DOUBLE * round_even(({a} - {b}) / {2 * pi!r}::DOUBLE, 0), 0)"


def splits_sql(survey: curvature.Survey = SURVEY) -> str:
    """Inflections (cut: user_id, i) of pt, as SQL."""
    out, union = "", []
    for n, scale in enumerate(survey.scales):
        b, w = survey.half_chord(scale), "WINDOW w AS (PARTITION BY user_id ORDER BY i)"
        out += f""", a{n} AS (SELECT user_id, i, n, atan2(lead(y, {b}) OVER w - lag(y, {b}) OVER w, lead(x, {b}) OVER w - lag(x, {b}) OVER w) AS h FROM pt {w}),
b{n} AS (SELECT user_id, i, n, {_turn_sql("h", "lag(h) OVER w")} AS t FROM a{n} {w}), c{n} AS (SELECT user_id, i, n, sum(t) OVER (PARTITION BY user_id ORDER BY i) AS p FROM b{n}),
d{n} AS (SELECT user_id, i, n, CASE WHEN i BETWEEN {2 * b} AND n - 1 - {2 * b} THEN (lead(p, {b}) OVER w - lag(p, {b}) OVER w) / {2 * b * survey.step} END AS k FROM c{n} {w}),
f{n} AS (SELECT user_id, i, CASE WHEN n < {4 * b + 1} THEN 0.0 WHEN i < {2 * b} THEN max(CASE WHEN i = {2 * b} THEN k END) OVER (PARTITION BY user_id) ELSE coalesce(k, max(CASE WHEN i = n - 1 - {2 * b} THEN k END) OVER (PARTITION BY user_id)) END AS k FROM d{n}),
g{n} AS (SELECT user_id, i, abs(k) AS k, CASE WHEN abs(k) >= {1 / survey.sharpest_straight(scale)!r}::DOUBLE THEN sign(k) ELSE 0 END AS s FROM f{n}),
h{n} AS (SELECT *, CAST(s IS DISTINCT FROM lag(s) OVER w OR i = 0 AS INTEGER) AS f FROM g{n} {w}), j{n} AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY i) AS run FROM h{n}),
k{n} AS (SELECT user_id, run, any_value(s) AS s, min(i) AS lo, max(i) AS hi FROM j{n} GROUP BY user_id, run HAVING any_value(s) <> 0 AND count(*) >= {max(3, round(scale / survey.step))}),
l{n} AS (SELECT user_id, lag(hi) OVER w AS lo, lo AS hi, s, lag(s) OVER w AS s0 FROM k{n} WINDOW w AS (PARTITION BY user_id ORDER BY lo)),
m{n} AS (SELECT l.user_id, arg_min(g.i, (g.k, g.i)) AS i FROM l{n} l JOIN g{n} g ON g.user_id = l.user_id AND g.i BETWEEN l.lo AND l.hi WHERE l.s <> l.s0 GROUP BY l.user_id, l.lo)"""
        union.append(f"SELECT user_id, i FROM m{n}")
    return f"""{out}, sp AS ({" UNION ALL ".join(union)}),
cut AS (SELECT user_id, min(i) AS i FROM sp GROUP BY user_id UNION ALL SELECT c.user_id, min(s.i) AS i FROM cut c JOIN sp s ON s.user_id = c.user_id AND s.i >= c.i + {survey.merge / survey.step} GROUP BY c.user_id)
"""


_TERMS = {"u": "u", "v": "v", "z": "z", "uu": "u * u", "uv": "u * v", "vv": "v * v", "uz": "u * z", "vz": "v * z"}


def _fit_sql(t: str, m: str) -> str:
    """Radius from columns <t>u, <t>v, ... of a row, as SQL."""
    u, v, z, uu, uv, vv, uz, vz = (f"{t}{x}" for x in _TERMS)
    c = {"xx": f"({uu} - {u} * {u} / {m})", "xy": f"({uv} - {u} * {v} / {m})", "yy": f"({vv} - {v} * {v} / {m})", "xz": f"({uz} - {u} * {z} / {m})", "yz": f"({vz} - {v} * {z} / {m})"}
    det = f"({c['xx']} * {c['yy']} - {c['xy']} * {c['xy']})"
    a, b = f"(({c['xz']} * {c['yy']} - {c['yz']} * {c['xy']}) / {det} / 2)", f"(({c['yz']} * {c['xx']} - {c['xz']} * {c['xy']}) / {det} / 2)"
    r = f"sqrt(greatest({z} / {m} - 2 * {a} * {u} / {m} - 2 * {b} * {v} / {m} + {a} * {a} + {b} * {b}, 0.0))"
    return f"CASE WHEN {m} < 3 OR {det} <= 1e-12 * greatest({c['xx']} * {c['yy']}, 1e-300) THEN 'inf'::DOUBLE WHEN {r} > 1e7 THEN 'inf'::DOUBLE ELSE {r} END"


def radii_sql(survey: curvature.Survey = SURVEY, name: str = "radii", q: str = "q") -> str:
    """Radii (name: user_id, i, x, y, radius) of pt between the rows of cut, as SQL; q starts the names of its steps."""
    half, least, chord, top = survey.half_window(), survey.half_least(), survey.half_chord(survey.chord), survey.r_max
    w, every = "PARTITION BY user_id, seg ORDER BY i", "PARTITION BY user_id, seg"
    frame = f"({w} ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    five = "[coalesce(lag(r, 2) OVER w, lag(r) OVER w, r), coalesce(lag(r) OVER w, r), r, coalesce(lead(r) OVER w, r), coalesce(lead(r, 2) OVER w, lead(r) OVER w, r)]"
    return f""", {q}0 AS (SELECT pt.user_id, pt.i, x, y, count(cut.i) OVER (PARTITION BY pt.user_id ORDER BY pt.i) AS seg FROM pt LEFT JOIN cut ON cut.user_id = pt.user_id AND cut.i = pt.i),
{q}1 AS (SELECT *, count(*) OVER ({every}) AS n, row_number() OVER ({w}) - 1 AS j, x - avg(x) OVER ({every}) AS u, y - avg(y) OVER ({every}) AS v, atan2(lead(y, {chord}) OVER w - lag(y, {chord}) OVER w, lead(x, {chord}) OVER w - lag(x, {chord}) OVER w) AS h FROM {q}0 WINDOW w AS ({w})),
{q}2 AS (SELECT *, u * u + v * v AS z, {_turn_sql("h", "lag(h) OVER w")} AS t FROM {q}1 WINDOW w AS ({w})),
{q}3 AS (SELECT *, {", ".join(f"sum({e}) OVER {frame} AS w{t}, sum({e}) OVER ({every}) AS o{t}" for t, e in _TERMS.items())}, sum(t) OVER ({w}) AS a FROM {q}2),
{q}4 AS (SELECT *, CASE WHEN n > {2 * half} AND j BETWEEN {half} AND n - 1 - {half} THEN {_fit_sql("w", f"{2 * half + 1}.0::DOUBLE")} END AS inner_r, CASE WHEN n <= {2 * half} THEN {_fit_sql("o", "n::DOUBLE")} END AS one,
 CASE WHEN n > {2 * half} THEN {half} WHEN n > {2 * least} THEN (n - 1) // 2 ELSE {least} END AS reach FROM {q}3),
{q}5 AS (SELECT z.*, max(CASE WHEN j = {half} THEN inner_r END) OVER ({every}) AS head, max(CASE WHEN j = n - 1 - {half} THEN inner_r END) OVER ({every}) AS tail FROM {q}4 z),
{q}6 AS (SELECT z.*, abs(b.a - c.a) AS turned FROM {q}5 z JOIN {q}5 b ON b.user_id = z.user_id AND b.seg = z.seg AND b.j = least(z.j + z.reach, z.n - 1) JOIN {q}5 c ON c.user_id = z.user_id AND c.seg = z.seg AND c.j = greatest(z.j - z.reach, 0)),
{q}7 AS (SELECT user_id, i, x, y, CASE WHEN n > 4 AND turned < {survey.least_turn * pi / 180!r}::DOUBLE THEN {top} ELSE least(CASE WHEN n <= {2 * half} THEN one WHEN j < {half} THEN head ELSE coalesce(inner_r, tail) END, {top}) END AS r FROM {q}6),
{name} AS (SELECT user_id, i, x, y, greatest(least(list_sort({five})[3], {top}), {survey.r_min}) AS radius FROM {q}7 WINDOW w AS (PARTITION BY user_id ORDER BY i))
"""


@query(PATH + even_sql(SURVEY.step) + splits_sql() + "SELECT user_id, CAST(i AS BIGINT) AS i FROM cut")
def curve_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the lines' curves change their sense, seen at three scales."""
    p = path(spark, sf_dir)
    return curvature.splits(checkpoint(curvature.resampled(p, ["user_id"], ["v"], "x", "y", SURVEY.step, "block")), ["user_id"])


@query(PATH + even_sql(SURVEY.step) + splits_sql() + radii_sql() + "SELECT user_id, CAST(i AS BIGINT) AS i, i * 10 / 1000.0::DOUBLE AS km, round(x, 3) AS x, round(y, 3) AS y, round(radius, 0) AS radius FROM radii")
def curvature_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From vertices to radii: even points, smoothing, inflections, fits that stop there, gate, median."""
    out = curvature.measured(path(spark, sf_dir), ["user_id"], ["v"], "x", "y", SURVEY, "block")
    return out.select("user_id", "i", (F.col("i") * 10 / 1000.0).alias("km"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("radius", 0).alias("radius"))


#: Vertices of an edge of the network, and how far the second track lies beside the first.
EDGE = 9
BESIDE = 4.5


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`path` with each ten users' lines around one place: they cross and run beside each other like the tracks of a yard."""
    p = path(spark, sf_dir)
    return p.withColumns({"x": F.col("x") + F.col("user_id") % 10 * 300.0, "y": F.col("y") + F.floor(F.col("user_id") / 10) * 20_000.0})


def network(line: DataFrame) -> DataFrame:
    """Segments of tracks from lines: each line is a way, every third one has a second way beside it; EDGE segments make an edge.

    Columns: way, edge, seq, u, v, ax, ay, bx, by. Nodes and edges are numbered by way and place.
    """
    rows = linear.with_halo(line.withColumnRenamed("v", "i"), ["user_id"], "i", 1, 5000)
    w = Window.partitionBy("user_id", "chunk").orderBy("i")
    ends = rows.withColumns({"bx": F.lead("x").over(w), "by": F.lead("y").over(w)}).where("own and bx is not null")
    one = ends.select("user_id", "i", F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by", F.lit(0).alias("side"))
    two = one.where("user_id % 3 = 0").withColumns({"ay": F.col("ay") + BESIDE, "by": F.col("by") + BESIDE, "side": F.lit(1)})
    place = F.floor(F.col("i") / EDGE)
    way = F.col("user_id") * 2 + F.col("side")
    number = lambda k: (way * 1_000_000 + k).cast("long")
    return one.unionByName(two).select(way.cast("long").alias("way"), number(place).alias("edge"), F.col("i").alias("seq"), number(place).alias("u"), number(place + 1).alias("v"), "ax", "ay", "bx", "by")


def wandering(line: DataFrame) -> DataFrame:
    """A surveyed track along each line: its vertices moved by up to 12 m, every fortieth one by 90 m."""
    e = F.col("event_id")
    off = F.when(e % 40 == 7, 90.0).otherwise((e % 9 - 4) * 3.0)
    return line.select(F.col("user_id").alias("section"), F.col("v").alias("i"), F.col("block"), (F.col("x") + off * 0.6).alias("px"), (F.col("y") - off * 0.8).alias("py"))


#: Reach of the matching in the query: edges further away can't be meant on these lines.
RULES = matching.Rules(reach=120.0)


@query()
def matched_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge, direction, offset and confidence of each point of the surveyed tracks (sequential rule: no SQL)."""
    line = lines(spark, sf_dir)
    out = matching.match(wandering(line), network(line), ["section"], "i", RULES, 120.0, "block")
    return out.withColumns({"off": F.round("off", 4), "dist": F.round("dist", 4)})


_LINES = PATH.removesuffix("\n") + f""", line AS (SELECT user_id, event_id, v, s, x + user_id % 10 * 300.0::DOUBLE AS x, y + user_id // 10 * 20000.0::DOUBLE AS y FROM path),
one AS (SELECT user_id, v AS i, x AS ax, y AS ay, lead(x) OVER w AS cx, lead(y) OVER w AS cy, 0 AS side FROM line WINDOW w AS (PARTITION BY user_id ORDER BY v)),
two AS (SELECT * FROM one WHERE cx IS NOT NULL UNION ALL SELECT user_id, i, ax, ay + {BESIDE}::DOUBLE, cx, cy + {BESIDE}::DOUBLE, 1 FROM one WHERE cx IS NOT NULL AND user_id % 3 = 0),
seg AS (SELECT user_id // 10 AS yard, user_id * 2 + side AS way, (user_id * 2 + side) * 1000000 + i // {EDGE} AS edge, i AS seq, ax, ay, cx, cy, cx - ax AS dx, cy - ay AS dy FROM two)
"""
_OFF = "CASE WHEN event_id % 40 = 7 THEN 90.0::DOUBLE ELSE (event_id % 9 - 4) * 3.0::DOUBLE END"


def _angle_sql(a: str, b: str) -> str:
    """Angle of two lines in degrees, 0 to 90, as SQL."""
    d = f"abs({a} - {b}) % 180"
    return f"least({d}, 180 - {d})"


@query(_LINES + f""", pt AS (SELECT user_id, event_id, v AS i, s, x + {_OFF} * 0.6 AS px, y - {_OFF} * 0.8 AS py FROM line),
e AS (SELECT user_id, max(s) AS s1 FROM pt GROUP BY user_id),
h AS (SELECT pt.user_id, pt.event_id, pt.i, pt.px, pt.py, CASE WHEN a.s < b.s THEN degrees(atan2(b.px - a.px, b.py - a.py)) END AS h
 FROM (SELECT *, s - 40 AS s0, s + 40 AS s2 FROM pt) pt JOIN e USING (user_id) ASOF LEFT JOIN pt a ON a.user_id = pt.user_id AND pt.s0 <= a.s ASOF LEFT JOIN pt c ON c.user_id = pt.user_id AND pt.s2 <= c.s JOIN pt b ON b.user_id = pt.user_id AND b.s = coalesce(c.s, e.s1)),
m AS (SELECT h.user_id, h.i, h.h, g.*, least(greatest(((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy), 0), 1) AS t, px, py FROM h JOIN seg g ON g.yard = h.user_id // 10 AND px BETWEEN least(ax, cx) - 30 AND greatest(ax, cx) + 30 AND py BETWEEN least(ay, cy) - 30 AND greatest(ay, cy) + 30),
d AS (SELECT *, sqrt((px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2) AS dist, {_angle_sql("degrees(atan2(dx, dy))", "h")} AS off FROM m),
f AS (SELECT user_id, i, way, edge, arg_min(off, (dist, seq)) AS off, min(dist) AS dist FROM d WHERE dist <= 30 GROUP BY ALL),
w AS (SELECT user_id, i, way, min(dist) AS dist, arg_min(edge, (dist, edge)) AS edge FROM f WHERE off <= 25 GROUP BY ALL),
r AS (SELECT *, row_number() OVER k AS n, min(dist) OVER (PARTITION BY user_id, i) AS best FROM w WINDOW k AS (PARTITION BY user_id, i ORDER BY dist, edge)),
c AS (SELECT user_id, i, count(*) FILTER (dist - best <= 7) AS n_geom, count(*) AS n_wide, min(dist) AS d0, max(dist) FILTER (n = 2) - min(dist) AS d_sister, max(way) FILTER (n = 1) AS way FROM r GROUP BY user_id, i),
st AS (SELECT user_id // 10 AS yard, px, py FROM pt WHERE event_id % 200 = 0)
SELECT h.user_id, h.event_id, CAST(coalesce(n_geom, 0) AS INTEGER) AS n_geom, CAST(coalesce(n_wide, 0) AS INTEGER) AS n_wide, round(d0, 5) AS d0, round(d_sister, 5) AS d_sister, way,
 EXISTS (SELECT 1 FROM st WHERE st.yard = h.user_id // 10 AND (st.px - h.px) * (st.px - h.px) + (st.py - h.py) * (st.py - h.py) <= 150.0 * 150.0) AS near_station
FROM h LEFT JOIN c ON c.user_id = h.user_id AND c.i = h.i""")
def parallel_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways beside each surveyed point that run in its direction, the distance of the nearest and of its sister, and whether a station is near."""
    line = checkpoint(lines(spark, sf_dir))
    places = wandering(line.withColumnRenamed("s", "at").withColumnRenamed("value", "worth")).join(line.select(F.col("user_id").alias("section"), F.col("v").alias("i"), "s", "event_id"), ["section", "i"])
    points = checkpoint(tracks.heading_within(places, ["section"], "s", "px", "py", 40.0, "heading", 20_000.0))
    ways = tracks.near_ways(points, network(line), ["section", "i"], cell=120.0)
    counted = tracks.track_counts(points, ways, ["section", "i"])
    stations = points.where("event_id % 200 = 0").select(F.col("px").alias("ox"), F.col("py").alias("oy"))
    out = spatial.exists_within(counted, stations, 150.0, ["section", "i"])
    return out.select(F.col("section").alias("user_id"), "event_id", "n_geom", "n_wide", F.round("d0", 5).alias("d0"), F.round("d_sister", 5).alias("d_sister"), "way", F.col("near").alias("near_station"))


#: Windows of 300 m: what a short curve is held against, never told as a radius.
FINE = curvature.Survey(window=300.0)
_CURVES = PATH + even_sql(SURVEY.step) + splits_sql() + radii_sql() + radii_sql(FINE, "fine", "t") + f""", n0 AS (SELECT a.user_id, a.i, a.x, a.y, a.radius, b.radius AS r, CASE WHEN a.radius >= {SURVEY.r_max} THEN 'straight' WHEN a.radius >= 2000 THEN 'wide' WHEN a.radius >= 900 THEN 'middle' ELSE 'sharp' END AS class
 FROM radii a JOIN fine b ON a.user_id = b.user_id AND a.i = b.i), n1 AS (SELECT *, CAST(class IS DISTINCT FROM lag(class) OVER w AS INTEGER) AS f FROM n0 WINDOW w AS (PARTITION BY user_id ORDER BY i)),
n2 AS (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY i) AS BIGINT) AS run FROM n1), n3 AS (SELECT user_id, run, any_value(class) AS class, min(radius) AS published, (max(i) - min(i) + 1) * {SURVEY.step} AS length FROM n2 GROUP BY user_id, run),
n4 AS (SELECT *, 1 / greatest(r, 1) >= 0.7 * max(1 / greatest(r, 1)) OVER (PARTITION BY user_id, run) AS sharp FROM n2),
n5 AS (SELECT *, i BETWEEN min(i) FILTER (sharp) OVER (PARTITION BY user_id, run) AND max(i) FILTER (sharp) OVER (PARTITION BY user_id, run) AS body FROM n4),
n6 AS (SELECT user_id, run, x - avg(x) OVER w AS u, y - avg(y) OVER w AS v FROM n5 WHERE body WINDOW w AS (PARTITION BY user_id, run)), n7 AS (SELECT *, u * u + v * v AS z FROM n6),
n8 AS (SELECT user_id, run, count(*) AS n, {", ".join(f"sum({e}) AS s{t}" for t, e in _TERMS.items())} FROM n7 GROUP BY user_id, run),
n9 AS (SELECT user_id, run, n, CASE WHEN n >= 5 THEN {_fit_sql("s", "n::DOUBLE")} END AS fitted FROM n8),
bias AS (SELECT n3.*, n AS n_body, fitted, CASE WHEN fitted < 'inf'::DOUBLE THEN published / fitted END AS factor FROM n3 JOIN n9 USING (user_id, run) WHERE class <> 'straight')
"""


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves (runs of one class of radius) with their published radius, that of their body by fine fits, and the factor between them."""
    points, first = stored(curvature.resampled(path(spark, sf_dir), ["user_id"], ["v"], "x", "y", SURVEY.step, "block"))
    release(spark)
    cuts = checkpoint(curvature.splits(points, ["user_id"]))
    release(spark)
    rows, second = stored(curvature.along_each(points, ["user_id"], {"radius": SURVEY, "r": FINE}, cuts))
    drop(spark, first)
    release(spark)
    r = F.col("radius")
    kind = F.when(r >= SURVEY.r_max, "straight").when(r >= 2000, "wide").when(r >= 900, "middle").otherwise("sharp")
    rows = rows.withColumns({"class": kind, "piece": F.floor(F.col("i") / 5000)})
    rows = checkpoint(linear.islands(rows, ["user_id"], ["i"], "class", "run", "piece").where("class <> 'straight'").drop("piece"))
    drop(spark, second)
    release(spark)
    told = rows.groupBy("user_id", "run").agg(F.first("class").alias("class"), F.min("radius").alias("published"), ((F.max("i") - F.min("i") + 1) * SURVEY.step).alias("length"))
    body = corridor.bodies(rows, ["user_id", "run"], "i", "x", "y", "r").select("user_id", "run", "n_body", "fitted")
    return corridor.bias(told.join(body, ["user_id", "run"]), "published", "fitted")


@query(_CURVES + "SELECT user_id, run, class, published_r AS published, length, n_body, factor_r AS factor FROM (SELECT *, round(published, 0) AS published_r, round(factor, 3) AS factor_r FROM bias)")
def short_curve_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much wider than its body each curve is read."""
    out = _curves(spark, sf_dir)
    return out.select("user_id", "run", "class", F.round("published", 0).alias("published"), "length", "n_body", F.round("factor", 3).alias("factor"))


@query(_CURVES + """SELECT band, count(*) AS n, round(sum(length) / 1000, 2) AS km, round(quantile_cont(factor, 0.5), 3) AS median, round(quantile_cont(factor, 0.75), 3) AS q75, round(quantile_cont(factor, 0.9), 3) AS q90
FROM (SELECT *, CASE WHEN length < 300 THEN 0.0::DOUBLE WHEN length < 450 THEN 300.0 WHEN length < 600 THEN 450.0 WHEN length < 900 THEN 600.0 ELSE 900.0 END AS band FROM bias WHERE factor IS NOT NULL) GROUP BY band""")
def bias_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of the bias of curves by their length."""
    out = corridor.bias_by_length(_curves(spark, sf_dir), "length")
    return out.select("band", "n", F.round("km", 2).alias("km"), *[F.round(c, 3).alias(c) for c in ("median", "q75", "q90")])

"""Domain engines: segmentation, synthesis, target speeds, travel times, margins, crossings, graphs, matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainage.functions import curves
from chainage.functions.traction import COUPLED, LOCO, TILTING, Train, accelerating, accelerator, law, law_columns
from chainage.operators import graph, linear, robust, sequences, spatial, tables
from chainage.plans import travel
from chainage.plans.registry import TRACK, K, points, query, table, track
from chainage.sources.shared import checkpoint

#: Cant sets (cant and deficiency in mm).
CANT_SETS = (curves.CantSet("base", 100, 76), curves.CantSet("tilting", 127, 152), curves.CantSet("high", 127, 270))


def ranked_runs(tr: DataFrame) -> DataFrame:
    """Runs of equal class of each section: run, lo, hi, n, rank (larger is slower)."""
    runs = linear.runs(tr, ["user_id"], ["us"], "class", "h", block="day")
    return runs.withColumn("rank", F.instr(F.lit("ABCDEF"), F.col("class")))


@query()
def absorbed_short_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs after short ones have joined a neighbour, bottlenecks kept (sequential rule: no SQL)."""

    def rule(c: dict[str, np.ndarray]) -> list[tuple]:
        groups = sequences.absorb_short_runs(c["rank"].tolist(), c["n"].tolist(), 3)
        return [(c["user_id"][0], i, c["class"][g[0]], c["lo"][g[0]], c["hi"][g[-1]], int(c["n"][g].sum())) for i, g in enumerate(groups)]

    return sequences.per_small_key(ranked_runs(track(spark, sf_dir)), ["user_id"], ["run"], "user_id long, segment long, class string, lo double, hi double, n long", rule)


@query()
def despeckled_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a track state after short ones took a neighbour's state (sequential rule: no SQL)."""

    def rule(c: dict[str, np.ndarray]) -> list[tuple]:
        return [(c["user_id"][0], i, state, int(n)) for i, (state, n) in enumerate(sequences.despeckle(c["state"].tolist(), c["n"].tolist(), 3))]

    tr = track(spark, sf_dir).withColumn("state", (1 + F.floor(F.col("value") / 170)).cast("long"))
    return sequences.per_small_key(linear.runs(tr, ["user_id"], ["us"], "state", "h", block="day"), ["user_id"], ["run"], "user_id long, segment long, state long, n long", rule)


_RUNS = TRACK + """, a AS (SELECT *, CAST(class IS DISTINCT FROM lag(class) OVER w OR row_number() OVER w = 1 AS INTEGER) AS f FROM tr WINDOW w AS (PARTITION BY user_id ORDER BY us)),
b AS (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY us) AS BIGINT) AS run FROM a)
"""


@query(_RUNS + """SELECT user_id, run, any_value(class) AS class, round(min(h), 6) AS km_start, round(max(h), 6) AS km_end, round(min(r), 4) AS r_min, round(quantile_cont(r, 0.1), 4) AS r_p10, round(quantile_cont(r, 0.5), 4) AS r_p50, round(count(*) / sum(1 / greatest(r, 1e-6)), 4) AS r_mean FROM b GROUP BY user_id, run""")
def classified_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of equal class with their radii."""
    numbered = linear.islands(track(spark, sf_dir), ["user_id"], ["us"], "class", "run", block="day")
    return numbered.groupBy("user_id", "run").agg(
        F.first("class").alias("class"), F.round(F.min("h"), 6).alias("km_start"), F.round(F.max("h"), 6).alias("km_end"), F.round(F.min("r"), 4).alias("r_min"), F.round(F.percentile("r", F.lit(0.1)), 4).alias("r_p10"), F.round(F.percentile("r", F.lit(0.5)), 4).alias("r_p50"), F.round(robust.harmonic_mean(F.col("r")), 4).alias("r_mean")
    )


@query(TRACK + """, c AS (SELECT * FROM (VALUES (153.0::DOUBLE), (177), (201)) t(cap)), f AS (SELECT user_id, us, h, v, cap, v < cap - 1e-6 AS slow FROM tr, c),
a AS (SELECT *, CAST(slow IS DISTINCT FROM lag(slow) OVER w OR row_number() OVER w = 1 AS INTEGER) AS n FROM f WINDOW w AS (PARTITION BY cap, user_id ORDER BY us)),
b AS (SELECT *, sum(n) OVER (PARTITION BY cap, user_id ORDER BY us) AS run FROM a)
SELECT cap, user_id, CAST(run AS BIGINT) AS run, round(max(h) - min(h), 6) AS length, round(min(v), 6) AS slowest, count(*) AS points FROM b WHERE slow GROUP BY cap, user_id, run""")
def sites_below_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous sites under each target speed."""
    swept = track(spark, sf_dir).withColumn("cap", F.explode(F.array(*[F.lit(c) for c in (153.0, 177.0, 201.0)]))).withColumn("slow", F.col("v") < F.col("cap") - 1e-6)
    numbered = linear.islands(swept, ["cap", "user_id"], ["us"], "slow", "run", block="day").where("slow")
    return numbered.groupBy("cap", "user_id", "run").agg(F.round(F.max("h") - F.min("h"), 6).alias("length"), F.round(F.min("v"), 6).alias("slowest"), F.count("*").alias("points"))


@query(TRACK + """, l AS (SELECT cant_set_id, c_code AS class, c_low AS speed, (c_low / (3.6 * sqrt(9.81::DOUBLE * (cant + def) / 1524))) ** 2 AS radius FROM (VALUES ('base', 100, 76), ('tilting', 127, 152), ('high', 127, 270)) s(cant_set_id, cant, def), (VALUES ('A', 300.0::DOUBLE), ('B', 250), ('C', 200), ('D', 160), ('E', 100)) c(c_code, c_low))
SELECT cant_set_id, l.class, round(speed, 1) AS speed, round(radius, 3) AS radius, count(*) FILTER (r >= radius) AS points FROM l, tr GROUP BY ALL""")
def class_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least radius of each class under each cant set, and how many points of the lines reach it: all in one pass."""
    limits = [(s.cant_set_id, c.code, c.low, (c.low / s.coefficient) ** 2) for s in CANT_SETS for c in curves.CLASSES[:-1]]
    counted = track(spark, sf_dir).agg(*[F.count(F.when(F.col("r") >= r, 1)).alias(f"n{k}") for k, (_, _, _, r) in enumerate(limits)])
    rows = F.array(*[F.struct(F.lit(a).alias("cant_set_id"), F.lit(b).alias("class"), F.lit(float(v)).alias("speed"), F.round(F.lit(r), 3).alias("radius"), F.col(f"n{k}").alias("points")) for k, (a, b, v, r) in enumerate(limits)])
    return counted.select(F.inline(rows))


def stretches(tr: DataFrame, gap_h: float) -> DataFrame:
    """tr with a stretch number that grows where the next point is further than gap_h."""
    before = linear.previous(tr, ["user_id"], ["us"], "h", "h0", block="day")
    return linear.running_sum(before.withColumn("new", (F.coalesce(F.col("h") - F.col("h0"), F.lit(1e9)) > gap_h).cast("long")), ["user_id"], ["us"], F.col("new"), "stretch", block="day").drop("h0", "new")


def travel_times(samples: DataFrame, keys: list[str], x_m: str, radius: str, settings: list[tuple[str, float, float]], train: Train, grade: str | None = None) -> DataFrame:
    """(keys, cant_set_id, cap, minutes, top_kmh) of each stretch under each setting (id, k, cap in km/h).

    Speeds with rests at both ends, power-limited forwards and brake-limited backwards. A
    stretch is moved once, whatever the number of settings. grade: a column of rise over run.
    """
    name_types = dict(samples.dtypes)
    schema = ", ".join(f"{k} {name_types[k]}" for k in keys) + ", cant_set_id string, cap double, minutes double, top_kmh double"

    names, k, cap = zip(*settings, strict=True)
    k_of, cap_of, pull = np.array(k)[:, None], np.array(cap)[:, None], accelerator((train,) * len(names))

    def rule(p: dict[str, np.ndarray]) -> list[tuple]:
        x, own = p[x_m], [p[c][0] for c in keys]
        rise = p[grade] if grade else np.zeros(len(x))
        limit = np.minimum(np.minimum(k_of * np.sqrt(p[radius]), curves.LIMIT_KMH), cap_of) / 3.6
        limit[:, [0, -1]] = 0.0
        v = sequences.forward_speeds(limit, x, rise, pull)
        reach = 2 * train.brake_ms2 * x
        back = np.minimum.accumulate((v * v + reach)[:, ::-1], axis=1)[:, ::-1] - reach
        v = np.minimum(v, np.sqrt(np.maximum(back, 0)))
        minutes = (np.diff(x) / np.maximum((v[:, 1:] + v[:, :-1]) / 2, 0.5)).sum(axis=1) / 60
        return [(*own, *r) for r in zip(names, cap, minutes.tolist(), (v.max(axis=1) * 3.6).tolist(), strict=True)]

    return sequences.per_small_key(samples.select(*keys, x_m, radius, *([grade] if grade else [])), keys, [x_m], schema, rule)


def speed_profiles(samples: DataFrame, keys: list[str], x_m: str, radius: str, k: float, cap: float, train: Train, grade: str | None = None) -> DataFrame:
    """(keys, x_m, out_ms, back_ms): speeds of a train at each sample of each stretch, in both directions, with rests at both ends.

    On the way back positions and gradients change their sign and the order of samples.
    """
    types = dict(samples.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + f", {x_m} double, out_ms double, back_ms double"
    pull = accelerator((train,))

    def one_way(x: np.ndarray, limit: np.ndarray, rise: np.ndarray) -> np.ndarray:
        v = sequences.forward_speeds(limit[None], x, rise, pull)[0]
        reach = 2 * train.brake_ms2 * x
        back = np.minimum.accumulate((v * v + reach)[::-1])[::-1] - reach
        return np.minimum(v, np.sqrt(np.maximum(back, 0)))

    def rule(p: dict[str, np.ndarray]) -> list[tuple]:
        x, own = p[x_m], [p[c][0] for c in keys]
        rise = p[grade] if grade else np.zeros(len(x))
        limit = np.minimum(np.minimum(k * np.sqrt(p[radius]), curves.LIMIT_KMH), cap) / 3.6
        limit[[0, -1]] = 0.0
        out, back = one_way(x, limit, rise), one_way(-x[::-1], limit[::-1], -rise[::-1])[::-1]
        return [(*own, *r) for r in zip(x.tolist(), out.tolist(), back.tolist(), strict=True)]

    return sequences.per_small_key(samples.select(*keys, x_m, radius, *([grade] if grade else [])), keys, [x_m], schema, rule)


def speeds_at(places: DataFrame, profiles: DataFrame, keys: list[str], x_m: str, width: float | None = None) -> DataFrame:
    """places with out_ms, back_ms and top_ms: the speeds of both directions interpolated there, and the greater of them."""
    both = linear.interpolate(places, profiles, keys, x_m, "out_ms", "out_ms", width)
    both = linear.interpolate(both, profiles.select(*keys, x_m, "back_ms"), keys, x_m, "back_ms", "back_ms", width)
    return both.withColumn("top_ms", F.greatest("out_ms", "back_ms"))


def _acceleration_sql(t: Train, v: str, grade: str = "0") -> str:
    """Acceleration of a train at the speed v (m/s) as SQL."""
    at, c = f"greatest({v}, 1.0::DOUBLE)", {k: f"{x!r}::DOUBLE" for k, x in law(t)._asdict().items()}
    return f"least({c['start']}, {c['pull']} / {at} - {c['c0']} - {c['c1']} * {at} - {c['c2']} * {at} * {at} - {c['weight']} * ({grade}))"


_SETTINGS = ", ".join(f"('{s.cant_set_id}', {s.coefficient!r}::DOUBLE, {c}::DOUBLE)" for s in CANT_SETS for c in (153.0, 177.0, 201.0))


_GRADED = "WITH RECURSIVE" + TRACK.removeprefix("WITH") + """, z0 AS (SELECT user_id, h, h * 1000 AS x, r, median(value / 50) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m,
 row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM tr WINDOW w AS (PARTITION BY user_id ORDER BY us)),
z1 AS (SELECT a.user_id, a.i, avg(b.m) AS e FROM z0 a, (SELECT unnest(range(-3, 4)) AS d) o, z0 b WHERE b.user_id = a.user_id AND b.i = least(greatest(a.i + d, 1), a.n) GROUP BY ALL),
z2 AS (SELECT z0.user_id, i, h, x, r, e, x - lag(x) OVER w AS da, lead(x) OVER w - x AS db, (e - lag(e) OVER w) / (x - lag(x) OVER w) AS ga, (lead(e) OVER w - e) / (lead(x) OVER w - x) AS gb, coalesce(CAST(h - lag(h) OVER w > 12 AS INTEGER), 1) AS new
 FROM z0 JOIN z1 USING (user_id, i) WINDOW w AS (PARTITION BY user_id ORDER BY i)),
z3 AS (SELECT user_id, i, x, r, coalesce((da * gb + db * ga) / (da + db), gb, ga, 0) AS grade, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY i) AS BIGINT) AS stretch FROM z2),
"""


@query(_GRADED + f"""z4 AS (SELECT *, row_number() OVER (PARTITION BY user_id, stretch ORDER BY i) AS j, count(*) OVER (PARTITION BY user_id, stretch) AS n FROM z3),
s AS (SELECT user_id, stretch, j, x, grade, cant_set_id, cap, CASE WHEN j IN (1, n) THEN 0.0::DOUBLE ELSE least(least(k * sqrt(r), 360), cap) / 3.6 END AS lim FROM z4, (VALUES {_SETTINGS}) t(cant_set_id, k, cap)),
f AS (SELECT user_id, stretch, j, x, cant_set_id, cap, 0.0::DOUBLE AS v FROM s WHERE j = 1
 UNION ALL SELECT s.user_id, s.stretch, s.j, s.x, s.cant_set_id, s.cap, least(s.lim, sqrt(greatest(1.0::DOUBLE, f.v * f.v + 2 * {_acceleration_sql(TILTING, "f.v", "s.grade")} * (s.x - f.x)))) FROM f JOIN s ON s.user_id = f.user_id AND s.stretch = f.stretch AND s.cant_set_id = f.cant_set_id AND s.cap = f.cap AND s.j = f.j + 1),
g AS (SELECT *, min(v * v + 2 * {TILTING.brake_ms2}::DOUBLE * x) OVER (PARTITION BY user_id, stretch, cant_set_id, cap ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 2 * {TILTING.brake_ms2}::DOUBLE * x AS back FROM f),
b AS (SELECT user_id, stretch, cant_set_id, cap, j, x, least(v, sqrt(greatest(back, 0))) AS v FROM g),
d AS (SELECT *, coalesce((lead(x) OVER w - x) / greatest((v + lead(v) OVER w) / 2, 0.5), 0) AS t FROM b WINDOW w AS (PARTITION BY user_id, stretch, cant_set_id, cap ORDER BY j))
SELECT user_id, stretch, cant_set_id, cap, round(sum(t) / 60, 5) AS minutes, round(max(v) * 3.6, 5) AS top_kmh FROM d GROUP BY ALL""")
def travel_time_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes of each stretch by cant set and cap over a graded line: limits, then a forward recurrence under power."""
    line = track(spark, sf_dir).select("user_id", "us", "day", "h", "r", (F.col("h") * 1000).alias("x"), (F.col("value") / 50).alias("z"))
    tr = stretches(travel.grades(line, ["user_id"], "x", "z"), 12.0)
    settings = [(s.cant_set_id, s.coefficient, c) for s in CANT_SETS for c in (153.0, 177.0, 201.0)]
    out = travel_times(tr, ["user_id", "stretch"], "x", "r", settings, TILTING, "grade")
    return out.withColumns({"minutes": F.round("minutes", 5), "top_kmh": F.round("top_kmh", 5)})


@query(_GRADED.replace("z3 AS (SELECT user_id, i, x, r,", "z3 AS (SELECT user_id, i, x, r, event_id, event_type,").replace("z2 AS (SELECT z0.user_id, i,", "z2 AS (SELECT z0.user_id, i, event_id, event_type,").replace("z0 AS (SELECT user_id, h,", "z0 AS (SELECT user_id, event_id, event_type, h,") + f"""z4 AS (SELECT *, row_number() OVER (PARTITION BY user_id, stretch ORDER BY i) AS j, count(*) OVER (PARTITION BY user_id, stretch) AS n FROM z3),
s AS (SELECT user_id, stretch, way, CASE way WHEN 1 THEN j ELSE n - j + 1 END AS j, way * x AS x, way * grade AS grade, CASE WHEN j IN (1, n) THEN 0.0::DOUBLE ELSE least(least({CANT_SETS[1].coefficient!r}::DOUBLE * sqrt(r), 360), 177) / 3.6 END AS lim FROM z4, (VALUES (1), (-1)) w(way)),
f AS (SELECT user_id, stretch, way, j, x, 0.0::DOUBLE AS v FROM s WHERE j = 1
 UNION ALL SELECT s.user_id, s.stretch, s.way, s.j, s.x, least(s.lim, sqrt(greatest(1.0::DOUBLE, f.v * f.v + 2 * {_acceleration_sql(TILTING, "f.v", "s.grade")} * (s.x - f.x)))) FROM f JOIN s ON s.user_id = f.user_id AND s.stretch = f.stretch AND s.way = f.way AND s.j = f.j + 1),
g AS (SELECT *, min(v * v + 2 * {TILTING.brake_ms2}::DOUBLE * x) OVER (PARTITION BY user_id, stretch, way ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 2 * {TILTING.brake_ms2}::DOUBLE * x AS back FROM f),
b AS (SELECT user_id, stretch, way, way * x AS x, least(v, sqrt(greatest(back, 0))) AS v FROM g),
c AS (SELECT z.user_id, z.stretch, z.event_id, z.x AS a, n.x AS b FROM z4 z JOIN z4 n ON n.user_id = z.user_id AND n.stretch = z.stretch AND n.j = z.j + 1 WHERE z.event_type = 'error'),
d AS (SELECT c.event_id, p.way, p.v + ((c.a + c.b) / 2 - c.a) / (c.b - c.a) * (q.v - p.v) AS v FROM c JOIN b p ON p.user_id = c.user_id AND p.stretch = c.stretch AND p.x = c.a JOIN b q ON q.user_id = c.user_id AND q.stretch = c.stretch AND q.x = c.b AND q.way = p.way)
SELECT event_id, round(max(v) FILTER (way = 1) * 3.6, 4) AS out_kmh, round(max(v) FILTER (way = -1) * 3.6, 4) AS back_kmh, round(max(v) * 3.6, 4) AS top_kmh FROM d GROUP BY event_id""")
def speeds_at_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real speed of the tilting train at crossings (halfway between an error and the next sample) in both directions over a graded line."""
    line = track(spark, sf_dir).select("user_id", "event_id", "event_type", "us", "day", "h", "r", (F.col("h") * 1000).alias("x"), (F.col("value") / 50).alias("z"))
    tr = checkpoint(stretches(travel.grades(line, ["user_id"], "x", "z"), 12.0))
    own = ["user_id", "stretch"]
    profiles = checkpoint(speed_profiles(tr, own, "x", "r", CANT_SETS[1].coefficient, 177.0, TILTING, "grade"))
    ahead = F.lead("x").over(Window.partitionBy(*own).orderBy("us"))
    places = tr.withColumn("b", ahead).where("event_type = 'error' and b is not null").select(*own, "event_id", ((F.col("x") + F.col("b")) / 2).alias("x"))
    out = speeds_at(places, profiles, own, "x", 240_000.0)
    return out.select("event_id", *[F.round(F.col(f"{c}_ms") * 3.6, 4).alias(f"{c}_kmh") for c in ("out", "back", "top")])


@query(_RUNS + """, s AS (SELECT user_id, run, any_value(class) AS class, min(h) AS lo, max(h) AS hi FROM b GROUP BY user_id, run),
m AS (SELECT user_id, class, max(hi - lo) AS len FROM s GROUP BY ALL)
SELECT s.user_id, s.run, s.class, round(s.hi - s.lo, 6) AS length, (s.hi - s.lo) >= 0.5 * len AS dominant FROM s JOIN m USING (user_id, class)""")
def section_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments beside the longest of their class in the section."""
    s = linear.runs(track(spark, sf_dir), ["user_id"], ["us"], "class", "h", block="day").withColumn("length", F.col("hi") - F.col("lo"))
    top = F.max("length").over(Window.partitionBy("user_id", "class"))
    return s.withColumn("dominant", F.col("length") >= 0.5 * top).select("user_id", "run", "class", F.round("length", 6).alias("length"), "dominant")


@query(TRACK + """, s AS (SELECT user_id, us, h, least(3, 1 + CAST(floor(value / 170) AS BIGINT)) AS raw FROM tr),
m AS (SELECT *, round_even(median(raw) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 0) AS state, coalesce(h - lag(h) OVER (PARTITION BY user_id ORDER BY us), 0) AS step FROM s)
SELECT user_id, round(sum(step), 6) AS length, round(coalesce(sum(step) FILTER (state = 1), 0), 6) AS single, round(coalesce(sum(step) FILTER (state = 2), 0), 6) AS double_track, round(coalesce(sum(step) FILTER (state >= 3), 0), 6) AS more FROM m GROUP BY user_id""")
def track_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length by number of tracks after a rolling median."""
    tr = track(spark, sf_dir).withColumn("raw", F.least(F.lit(3), 1 + F.floor(F.col("value") / 170)))
    m = robust.rolling_median(tr, ["user_id"], ["us"], "raw", 5, "m").withColumn("state", F.rint("m"))
    m = linear.previous(m, ["user_id"], ["us"], "h", "h0", block="day").withColumn("step", F.coalesce(F.col("h") - F.col("h0"), F.lit(0.0)))
    of = lambda cond: F.round(F.coalesce(F.sum(F.when(cond, F.col("step"))), F.lit(0.0)), 6)
    return m.groupBy("user_id").agg(F.round(F.sum("step"), 6).alias("length"), of(F.col("state") == 1).alias("single"), of(F.col("state") == 2).alias("double_track"), of(F.col("state") >= 3).alias("more"))


@query("""WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings), d AS (SELECT a.id, b.label AS seg, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist, b.id AS other FROM p a JOIN p b ON a.id <> b.id),
n AS (SELECT id, seg, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS k FROM d WHERE dist <= 0.05), m AS (SELECT id, seg, CASE WHEN 100 + seg * 12 <= 110 THEN 'to 110' WHEN 100 + seg * 12 <= 153 THEN 'to 153' WHEN 100 + seg * 12 <= 201 THEN 'to 201' ELSE 'over 201' END AS band FROM n WHERE k = 1),
g AS (SELECT * FROM (VALUES (0), (1), (2)) a(authority), (VALUES ('to 110'), ('to 153'), ('to 201'), ('over 201')) b(band)), c AS (SELECT id % 3 AS authority, band, count(*) AS n FROM m GROUP BY ALL)
SELECT CAST(authority AS BIGINT) AS authority, band, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (authority, band)""")
def crossings_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings joined to their nearest segment, by speed band and authority, zeros included."""
    p = points(spark, sf_dir)
    asked = p.select("id", F.col("x").alias("px"), F.col("y").alias("py"))
    others = p.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("label").alias("seg"))
    near = spatial.k_nearest(asked, others, 0.05, ["id"], ["other"], 1, F.col("id") != F.col("other"), cell_rows=32)
    bands = ["to 110", "to 153", "to 201", "over 201"]
    m = near.withColumn("band", curves.banded(100 + F.col("seg") * 12, [110, 153, 201], bands)).withColumn("authority", F.col("id") % 3)
    return tables.crosstab(m, "authority", "band", [0, 1, 2], bands, F.count("*"))


@query(TRACK + """, a AS (SELECT user_id, event_type AS x, lead(event_type) OVER w AS y, (lead(us) OVER w - us) / 6e7 AS m, lead(h) OVER w - h AS d FROM tr WINDOW w AS (PARTITION BY user_id ORDER BY us)),
s AS (SELECT x, y, m, d / 50 * 60 AS base FROM a WHERE y IS NOT NULL AND x <> y)
SELECT x AS from_stop, y AS to_stop, count(*) AS n, round(median(m), 4) AS scheduled, round(median(base), 6) AS base, round(100 * (median(m) - median(base)) / nullif(median(base), 0), 3) AS margin FROM s GROUP BY ALL""")
def margins_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduled against free running time between neighbouring stops."""
    w = Window.partitionBy("user_id").orderBy("us")
    s = track(spark, sf_dir).select(F.col("event_type").alias("from_stop"), F.lead("event_type").over(w).alias("to_stop"), ((F.lead("us").over(w) - F.col("us")) / 6e7).alias("m"), ((F.lead("h").over(w) - F.col("h")) / 50 * 60).alias("b"))
    s = s.where("to_stop is not null and from_stop <> to_stop")
    return s.groupBy("from_stop", "to_stop").agg(F.count("*").alias("n"), F.round(F.median("m"), 4).alias("scheduled"), F.round(F.median("b"), 6).alias("base"), F.round(F.try_divide(100 * (F.median("m") - F.median("b")), F.median("b")), 3).alias("margin"))


_TRAINS = (COUPLED, LOCO, TILTING)


@query(TRACK + ", e AS (SELECT event_id, v / 3.6 AS v, (value - 50) / 20000 AS g FROM tr)\n" + " UNION ALL ".join(f"SELECT event_id, '{t.name}' AS train, round({_acceleration_sql(t, 'v', 'g')}, 9) AS ms2 FROM e" for t in _TRAINS))
def accelerations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceleration of each trainset at each sample's speed and grade: the law of traction as a column."""
    rows = track(spark, sf_dir).select("event_id", (F.col("v") / 3.6).alias("v"), ((F.col("value") - 50) / 20000).alias("g"))
    each = F.array(*[F.struct(F.lit(t.name).alias("train"), F.round(accelerating(F.col("v"), F.col("g"), law_columns(t)), 9).alias("ms2")) for t in _TRAINS])
    return rows.select("event_id", F.inline(each))


@query(TRACK + """, n AS (SELECT event_id, h::DOUBLE AS x, value::DOUBLE AS y, list(struct_pack(x := h::DOUBLE, y := value::DOUBLE)) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM tr),
d AS (SELECT event_id, len(near)::DOUBLE AS m, [struct_pack(x := p.x - x, y := p.y - y, z := (p.x - x) * (p.x - x) + (p.y - y) * (p.y - y)) FOR p IN near] AS d FROM n),
s AS (SELECT event_id, m, list_sum([p.x FOR p IN d]) AS sx, list_sum([p.y FOR p IN d]) AS sy, list_sum([p.z FOR p IN d]) AS sz, list_sum([p.x * p.x FOR p IN d]) AS xx, list_sum([p.x * p.y FOR p IN d]) AS xy,
  list_sum([p.y * p.y FOR p IN d]) AS yy, list_sum([p.x * p.z FOR p IN d]) AS xz, list_sum([p.y * p.z FOR p IN d]) AS yz FROM d),
c AS (SELECT event_id, m, sx, sy, sz, xx - sx * sx / m AS cxx, xy - sx * sy / m AS cxy, yy - sy * sy / m AS cyy, xz - sx * sz / m AS cxz, yz - sy * sz / m AS cyz FROM s),
e AS (SELECT *, cxx * cyy - cxy * cxy AS det FROM c), f AS (SELECT *, (cxz * cyy - cyz * cxy) / det / 2 AS a, (cyz * cxx - cxz * cxy) / det / 2 AS b FROM e),
g AS (SELECT event_id, det <= 1e-12 * greatest(cxx * cyy, 1e-300) AS flat, sqrt(greatest(sz / m - 2 * a * sx / m - 2 * b * sy / m + a * a + b * b, 0.0)) AS r FROM f)
SELECT event_id, CASE WHEN flat OR r > 1e7 THEN 1e7::DOUBLE ELSE round(r, 2) END AS radius FROM g""")
def curvature_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radius at each point of a section by sliding circle fits over its path."""
    tr = track(spark, sf_dir).select("user_id", "event_id", "us", "day", "h", "value")
    fitted = linear.circle_fits(tr, ["user_id"], ["us", "event_id"], "h", "value", 5, "r", block="day")
    return fitted.select("event_id", F.round(F.least("r", F.lit(1e7)), 2).alias("radius"))


@query()
def thinned_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points kept by greedy thinning, and by line simplification of what is between the days' ends (sequential rules: no SQL)."""
    tr = track(spark, sf_dir).select("user_id", "event_id", "us", "day", "h", "value")

    def thin(state, p, last):
        kept = sequences.thin_by_distance(p["h"], 6.0, state, last)
        flag = np.zeros(len(p["h"]), bool)
        flag[kept] = True
        return float(p["h"][kept[-1]]) if len(kept) else state, pd.DataFrame({"event_id": p["event_id"], "thin": flag})

    def simple(p: dict[str, np.ndarray]) -> list[tuple]:
        flag = np.zeros(len(p["h"]), bool)
        flag[sequences.simplify(np.stack([p["h"], p["value"]], 1).astype(np.float64), 50.0)] = True
        return list(zip(p["event_id"].tolist(), flag.tolist(), strict=True))

    thinned = sequences.in_order(tr, ["user_id"], ["us", "event_id"], "event_id long, thin boolean", thin)
    return thinned.join(sequences.per_small_key(tr, ["user_id", "day"], ["us", "event_id"], "event_id long, simple boolean", simple), "event_id")


@query()
def inflection_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions between bends of opposite sign, merged over two scales (sequential rule: no SQL)."""
    tr = track(spark, sf_dir).select("user_id", "event_id", "us", "day", "h", (F.col("value") / 100 - 1).alias("k"))
    one, two = (linear.inflections(tr, ["user_id"], ["us", "event_id"], "k", "h", scale, 0.05, block="day") for scale in (2, 3))

    def merge(state, p, last):
        kept = sequences.thin_by_distance(p["at"], 1.0, state, False)
        return float(p["at"][kept[-1]]) if len(kept) else state, pd.DataFrame({"user_id": p["user_id"][kept], "at": p["at"][kept]})

    return sequences.in_order(one.union(two), ["user_id"], ["at"], "user_id long, at double", merge)


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS way_id, l_linenumber AS n, l_partkey AS node, l_partkey / 1000 AS lat, l_suppkey / 100 AS lon FROM lineitem),
i AS (SELECT *, row_number() OVER w AS i, lead(node) OVER w IS NULL AS last, lag(node) OVER w AS before, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM p WINDOW w AS (PARTITION BY way_id ORDER BY n, node, lat, lon)),
g AS (SELECT node FROM p GROUP BY node HAVING count(*) >= 2), c AS (SELECT i.*, CAST(i = 1 OR last OR g.node IS NOT NULL AS INTEGER) AS cut FROM i LEFT JOIN g USING (node)),
k AS (SELECT *, sum(cut) OVER (PARTITION BY way_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM c)
SELECT way_id, CAST(k AS BIGINT) AS k, min_by(before, i) AS u, max_by(node, i) AS v,
 round(sum(2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0, sin(radians(lat - lat0) / 2) ** 2 + cos(radians(lat0)) * cos(radians(lat)) * sin(radians(lon - lon0) / 2) ** 2)))), 3) AS length_m FROM k WHERE i > 1 GROUP BY way_id, k""")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways (orders as chains of parts) split at shared nodes into edges with lengths."""
    li = table(spark, sf_dir, "lineitem")
    place = F.struct(F.col("l_linenumber").alias("n"), "l_partkey", (F.col("l_partkey") / 1000).alias("lat"), (F.col("l_suppkey") / 100).alias("lon"))
    ways = li.groupBy(F.col("l_orderkey").alias("way_id")).agg(F.array_sort(F.collect_set(place)).alias("p"))
    ways = ways.select("way_id", F.col("p.l_partkey").alias("node_refs"), F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("coords"))
    return graph.split_at_junctions(ways).withColumn("length_m", F.round("length_m", 3))


@query("""WITH e AS (SELECT o_orderkey AS edge, o_custkey AS u, 1000000 + o_orderkey // 5 AS v FROM orders), a AS (SELECT edge, v AS node FROM e),
t AS (SELECT edge AS next_edge, u AS node, 1 AS direction FROM e UNION ALL SELECT edge, v, -1 FROM e)
SELECT a.edge, a.node, next_edge, direction FROM a JOIN t USING (node) WHERE next_edge <> a.edge""")
def junction_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge"), F.col("o_custkey").alias("u"), (1000000 + F.floor(F.col("o_orderkey") / 5)).alias("v"))
    return graph.incident(e, e.select("edge", F.col("v").alias("node"))).select("edge", "node", "next_edge", "direction")


@query(TRACK + """, a AS (SELECT user_id, min(us) FILTER (event_type = 'signup') AS s0, max(us) FILTER (event_type = 'signup') AS s1, count(DISTINCT event_type) AS stops, (max(us) - min(us)) / 6e7 AS m FROM tr GROUP BY user_id)
SELECT stops, count(*) AS n, round(median(m), 4) AS median_minutes FROM a GROUP BY stops""")
def margins_at_equal_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips grouped by their number of stops, each group evaluated once."""
    a = track(spark, sf_dir).groupBy("user_id").agg(F.count_distinct("event_type").alias("stops"), ((F.max("us") - F.min("us")) / 6e7).alias("m"))
    return a.groupBy("stops").agg(F.count("*").alias("n"), F.round(F.median("m"), 4).alias("median_minutes"))

"""The travel-time engine: free pieces, stretches, sampled limits, speeds under power and brakes, and its variants."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainage.functions.traction import COUPLED, LOCO, TILTING, Train, accelerator
from chainage.operators import intervals, linear, robust, sequences
from chainage.plans.registry import TRACK, query, track


def free_pieces(segments: DataFrame, blocks: DataFrame, keys: list[str], width: float) -> DataFrame:
    """(keys, lo, hi, v): segments (keys, segment, lo, hi, v) without the blocks (keys, b_lo, b_hi)."""
    left = segments.withColumnsRenamed({"lo": "a_lo", "hi": "a_hi"})
    return intervals.subtract(left, blocks, keys, ["segment"], width).join(segments.select(*keys, "segment", "v"), [*keys, "segment"]).select(*keys, "lo", "hi", "v")


def stretches(pieces: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """pieces with a stretch number that grows where a piece doesn't start within `gap` of the end before."""
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    new = F.coalesce((F.abs(F.col("lo") - F.lag("hi").over(w)) >= gap).cast("long"), F.lit(1).cast("long"))
    return linear.running_sum(pieces.withColumn("__new", new), keys, ["lo", "hi"], F.col("__new"), "stretch").drop("__new")


def _at(i: Column) -> Column:
    """Place of the i-th of n samples from k0 to k1."""
    return F.col("k0") + (F.col("k1") - F.col("k0")) * i / (F.col("n") - 1)


def sampled_pieces(pieces: DataFrame, keys: list[str], step: float) -> DataFrame:
    """(keys, stretch, lo, v, k0, k1, n, i0, i1): the pieces that hold samples, i0 to i1 of the n even positions from k0 to k1 of their stretch.

    A sample lies in the last piece that starts at or before it, of equal starts in that of the greatest v.
    """
    own = [*keys, "stretch"]
    whole = Window.partitionBy(*own)
    n = F.greatest(F.lit(2), F.floor((F.col("k1") - F.col("k0")) / step).cast("int") + 1)
    rows = pieces.select(*own, "lo", "v", F.min("lo").over(whole).alias("k0"), F.max("hi").over(whole).alias("k1"), F.lead("lo").over(whole.orderBy("lo", "v")).alias("next"))
    rows = rows.where("k1 > k0 and lo is not null").withColumn("n", n)

    def first(place: str) -> Column:
        """Number of the first sample at a place or beyond it."""
        near = F.ceil((F.col(place) - F.col("k0")) * (F.col("n") - 1) / (F.col("k1") - F.col("k0"))).cast("int")
        found = F.when(_at(near - 1) >= F.col(place), near - 1).when(_at(near) >= F.col(place), near).otherwise(near + 1)
        return F.when(F.col(place).isNotNull(), F.greatest(found, F.lit(0)))

    last = F.least(F.coalesce(first("next"), F.col("n")), F.col("n")) - 1
    return rows.select(*own, "lo", "v", "k0", "k1", "n", first("lo").alias("i0"), last.alias("i1")).where("i0 <= i1")


def _each(parts: DataFrame, *columns: str) -> DataFrame:
    """A row for each sample of sampled pieces, in their order."""
    rows = parts.withColumn("i", F.explode(F.sequence("i0", "i1"))).withColumn("x", _at(F.col("i")))
    rest = F.coalesce(F.array_contains("rests", F.col("i")), F.lit(False)) if "rests" in parts.columns else F.lit(False)
    return rows.withColumn("rest", rest).select(*columns)


def samples(pieces: DataFrame, keys: list[str], step: float) -> DataFrame:
    """(keys, stretch, x, v): even positions along each stretch, about `step` apart, with the limit of the piece they lie in. Each piece emits its own, so nothing is looked up."""
    return _each(sampled_pieces(pieces, keys, step), *keys, "stretch", "x", "v")


def grades(profile: DataFrame, keys: list[str], x_m: str, height: str, out: str = "grade") -> DataFrame:
    """profile with its gradient (rise over run): the height's rolling median of five, then a mean of seven, then its slope."""
    level = robust.rolling_median(profile, keys, [x_m], height, 2, "__median")
    even = robust.moving_average(level, keys, [x_m], "__median", 3, "__even")
    return linear.gradient(even, keys, [x_m], x_m, "__even", out).drop("__median", "__even")


def graded(sampled: DataFrame, profile: DataFrame, keys: list[str]) -> DataFrame:
    """sampled with the gradient of the profile (keys, x, grade), interpolated at each sample and clamped at the ends."""
    return linear.interpolate(sampled, profile.select(*keys, "x", "grade"), keys, "x", "grade", "grade")


def with_frozen(free: DataFrame, blocks: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, free, frozen, minutes): running minutes beside the scheduled median minutes of the blocks left out.

    free: (keys, minutes), any number of rows a key. blocks: (keys, from_stop, to_stop).
    pairs: (from_stop, to_stop, minutes), one row for each timetable sample; a block without
    samples has no frozen minutes and makes the sum null, so that it isn't taken for zero.
    """
    ends = ["from_stop", "to_stop"]
    medians = pairs.groupBy(*ends).agg(F.median("minutes").alias("m"))
    held = blocks.join(medians, ends, "left").groupBy(*keys).agg(F.when(F.count("*") == F.count("m"), F.sum("m")).alias("frozen"), F.lit(True).alias("__any"))
    out = free.groupBy(*keys).agg(F.sum("minutes").alias("free")).join(held, keys, "left")
    out = out.withColumn("frozen", F.when(F.col("__any"), F.col("frozen")).otherwise(0.0)).drop("__any")
    return out.withColumn("minutes", F.col("free") + F.col("frozen"))


def stopped(sampled: DataFrame, stops: DataFrame, keys: list[str]) -> DataFrame:
    """sampled with `rest`: the sample of its section nearest to each stop (keys, stop), ties to the smaller position."""
    marks = _nearest(stops, sampled, keys, ["stretch"]).select(*keys, "stretch", "x").distinct().withColumn("rest", F.lit(True))
    return sampled.join(marks, [*keys, "stretch", "x"], "left").withColumn("rest", F.coalesce("rest", F.lit(False)))


def _nearest(stops: DataFrame, sampled: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """(keys, payload, x) of the sample of its section nearest to each stop (keys, stop), ties to the smaller position."""
    asked = stops.select(*keys, "stop").distinct().withColumn("x", F.col("stop"))
    near = linear.between(asked, sampled.select(*keys, "x", *payload), keys, "x", payload)
    sides = {side: F.struct(*[F.col(f"{side}_{p}").alias(p) for p in payload], F.col(f"{side}_at").alias("x")) for side in ("down", "up")}
    first = F.col("up_at").isNull() | (F.col("stop") - F.col("down_at") <= F.col("up_at") - F.col("stop"))
    nearest = near.select(*keys, F.when(F.col("down_at").isNotNull() & first, sides["down"]).when(F.col("up_at").isNotNull(), sides["up"]).alias("s")).where("s is not null")
    return nearest.select(*keys, *[f"s.{p}" for p in payload], "s.x")


def with_rests(parts: DataFrame, stops: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Sampled pieces with `rests`, the numbers of their samples at which the stops (keys, stop) are made: those that `stopped` marks.

    Only samples that can be nearest to a stop are looked at: the first and last of each
    piece, and those on both sides of a stop inside a piece. width: about the length of the longer pieces.
    """
    own = [*keys, "stretch"]
    asked = stops.select(*keys, "stop").distinct()
    spans = parts.withColumns({"x0": _at(F.col("i0")), "x1": _at(F.col("i1"))})
    near = F.floor((F.col("stop") - F.col("k0")) * (F.col("n") - 1) / (F.col("k1") - F.col("k0"))).cast("int")
    inside = intervals.points_in(asked, spans, keys, "stop", width, ("x0", "x1"), closed=True).withColumn("is", F.sequence(F.greatest(near - 1, F.col("i0")), F.least(near + 2, F.col("i1"))))
    either = parts.withColumn("is", F.array("i0", "i1")).select(*own, "lo", "k0", "k1", "n", "is").unionByName(inside.select(*own, "lo", "k0", "k1", "n", "is"))
    seen = either.withColumn("i", F.explode("is")).select(*own, "lo", "i", _at(F.col("i")).alias("x"))
    found = _nearest(asked, seen, keys, ["stretch", "lo", "i"]).groupBy(*own, "lo").agg(F.collect_set("i").alias("rests"))
    return parts.join(found.hint("merge"), [*own, "lo"], "left")


def minutes(sampled: DataFrame, keys: list[str], train: Train, cap: float) -> DataFrame:
    """(keys, stretch, minutes) of one train under one cap, with its stops."""
    return minutes_of(sampled, keys, [("", train, cap, True)]).drop("variant")


def minutes_of(sampled: DataFrame, keys: list[str], runs: list[tuple[str, Train, float, bool]]) -> DataFrame:
    """(keys, stretch, variant, minutes) of runs (variant, train, cap, whether it stops): a stretch is moved once for all of them.

    Rests at both ends and at `rest`, the slowest limit under the whole train, power
    forwards, brakes backwards. A column `grade` counts where there is one. A task holds some stretches, which advance together.
    Sampled pieces may stand for their samples: these are then made where they are used, and only pieces are shuffled.
    """
    pieces = "i0" in sampled.columns
    kinds = dict(sampled.dtypes)
    own = [*keys, "stretch"]
    schema = ", ".join(f"{k} {kinds[k]}" for k in own) + ", variant string, minutes double"

    names, trains, caps, stopping = zip(*runs, strict=True)
    pull, brake = accelerator(trains), np.array([t.brake_ms2 for t in trains])[:, None]
    rests = np.array(stopping, bool)[:, None]

    def limits(x: np.ndarray, speed: np.ndarray) -> np.ndarray:
        """The slowest limit under the whole train at each sample, one row for each run."""
        dx = (x[-1] - x[0]) / max(1, len(x) - 1)
        out = np.minimum(speed, np.array(caps)[:, None]) / 3.6
        for row, train in zip(out, trains, strict=True):
            if tail := int(round(train.length_m / dx)) if dx else 0:
                row[:] = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.full(tail, np.inf), row)), tail + 1).min(axis=1)
        return out

    def rule(parts: list[dict[str, np.ndarray]]) -> list[tuple]:
        places, slopes, tops, out = [], [], [], []
        for c in parts:
            x = c["x"] * 1000
            rest = c["rest"] & rests
            rest[:, [0, -1]] = True
            places.append(x)
            slopes.append(c.get("grade", np.zeros(len(x))))
            tops.append(np.where(rest, 0.0, limits(x, c["v"])))
        for c, x, v in zip(parts, places, sequences.forward_speeds_of(tops, places, slopes, pull), strict=True):
            reach = 2 * brake * x
            back = np.minimum.accumulate((v * v + reach)[:, ::-1], axis=1)[:, ::-1] - reach
            v = np.minimum(v, np.sqrt(np.maximum(back, 0.0)))
            spent = (np.diff(x) / np.maximum((v[:, 1:] + v[:, :-1]) / 2, 0.5)).sum(axis=1) / 60
            out += [(*(c[k][0] for k in own), *r) for r in zip(names, spent.tolist(), strict=True)]
        return out

    extra = ["grade"] if "grade" in sampled.columns else []
    if pieces:
        return sequences.per_small_keys(sampled, own, ["i0"], schema, rule, then=lambda rows: _each(rows, *own, "x", "v", "rest"))
    return sequences.per_small_keys(sampled.select(*own, "x", "v", "rest", *extra), own, ["x"], schema, rule)


def tables_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, blocks and stops on the events' lines: runs of a class, every other span between sign-ups, the errors of high value."""
    tr = track(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("us")
    reach = tr.withColumn("hi", F.lead("h").over(w)).where("hi > h")
    segments = reach.select("user_id", F.col("event_id").alias("segment"), F.col("h").alias("lo"), "hi", "v")
    b = tr.where("event_type = 'signup'").select("user_id", F.col("h").alias("b_lo"), F.lead("h").over(w).alias("b_hi"), F.row_number().over(w).alias("i"))
    blocks = b.where("i % 2 = 1 and b_hi is not null").drop("i")
    return segments, blocks, tr.where("event_type = 'error' and value > 200").select("user_id", F.col("h").alias("stop"))


def variants() -> list[tuple[str, Train, float, bool, bool]]:
    """Name, train, cap, whether blocks are left out and whether stops are made."""
    return [("base", LOCO, 153.0, True, True), ("tilting", TILTING, 177.0, True, True), ("express", TILTING, 177.0, True, False), ("through blocks", TILTING, 177.0, False, True), ("higher cap", TILTING, 201.0, True, True), ("more power", COUPLED, 177.0, True, True)]


@query()
def travel_time_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes of each section under the variants, and what each gains on the base (sequential speeds: no SQL)."""
    segments, blocks, stops = tables_of(spark, sf_dir)
    keys, out = ["user_id"], None
    for free in (True, False):
        pieces = free_pieces(segments, blocks, keys, 24.0) if free else segments.select("user_id", "lo", "hi", "v")
        points = with_rests(sampled_pieces(stretches(pieces, keys, 0.05), keys, 0.5), stops, keys, 24.0)
        runs = [(name, train, cap, stopping) for name, train, cap, own, stopping in variants() if own == free]
        one = minutes_of(points, keys, runs).groupBy(*keys, "variant").agg(F.round(F.sum("minutes"), 4).alias("minutes"))
        out = one if out is None else out.unionByName(one)
    base = out.where("variant = 'base'").select("user_id", F.col("minutes").alias("base"))
    return out.join(base, "user_id", "left").select("user_id", "variant", "minutes", F.round(F.col("base") - F.col("minutes"), 4).alias("gain"))


_S = TRACK + """, r AS (SELECT user_id, event_id AS segment, h AS lo, lead(h) OVER w AS hi, v FROM tr WINDOW w AS (PARTITION BY user_id ORDER BY us)), s AS (SELECT * FROM r WHERE hi > lo),
b0 AS (SELECT user_id, h AS b_lo, lead(h) OVER (PARTITION BY user_id ORDER BY us) AS b_hi, row_number() OVER (PARTITION BY user_id ORDER BY us) AS i FROM tr WHERE event_type = 'signup'), b AS (SELECT * FROM b0 WHERE i % 2 = 1 AND b_hi IS NOT NULL),
c AS (SELECT s.user_id, segment, lo, hi, greatest(lo, b_lo) AS p, least(hi, b_hi) AS q FROM s JOIN b ON s.user_id = b.user_id AND lo < b_hi AND b_lo < hi UNION ALL SELECT user_id, segment, lo, hi, hi, hi FROM s),
g AS (SELECT user_id, segment, coalesce(max(q) OVER (PARTITION BY user_id, segment ORDER BY p, q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo) AS lo, p AS hi FROM c),
f AS (SELECT user_id, g.lo, g.hi, s.v FROM g JOIN s USING (user_id, segment) WHERE g.lo < g.hi),
n AS (SELECT *, coalesce(CAST(abs(lo - lag(hi) OVER (PARTITION BY user_id ORDER BY lo, hi)) >= 0.05 AS INTEGER), 1) AS new FROM f),
t AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY lo, hi) AS stretch FROM n)
"""


@query(_S + "SELECT user_id, CAST(stretch AS BIGINT) AS stretch, round(min(lo), 6) AS lo, round(max(hi), 6) AS hi, count(*) AS n, round(sum((hi - lo) / least(v, 177.0::DOUBLE)) * 60, 6) AS free_minutes FROM t GROUP BY ALL")
def free_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of free pieces with their running time without stops or acceleration."""
    segments, blocks, _ = tables_of(spark, sf_dir)
    t = stretches(free_pieces(segments, blocks, ["user_id"], 24.0), ["user_id"], 0.05)
    return t.groupBy("user_id", "stretch").agg(F.round(F.min("lo"), 6).alias("lo"), F.round(F.max("hi"), 6).alias("hi"), F.count("*").alias("n"), F.round(F.sum((F.col("hi") - F.col("lo")) / F.least(F.col("v"), F.lit(177.0))) * 60, 6).alias("free_minutes"))


@query(_S + """, p AS (SELECT user_id, sum((hi - lo) / least(v, 177.0::DOUBLE)) * 60 AS free FROM f GROUP BY user_id), k AS (SELECT user_id, count(*) AS n FROM b GROUP BY user_id),
e AS (SELECT event_type AS x, lead(event_type) OVER w AS y, (lead(us) OVER w - us) / 6e7 AS m FROM tr WINDOW w AS (PARTITION BY user_id ORDER BY us)), q AS (SELECT median(m) AS m FROM e WHERE x = 'signup' AND y = 'signup')
SELECT user_id, round(free, 4) AS free, round(coalesce(n, 0) * m, 4) AS frozen, round(free + coalesce(n, 0) * m, 4) AS minutes FROM p LEFT JOIN k USING (user_id), q""")
def minutes_with_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes of each section: free running outside the blocks, the timetable's median inside them."""
    segments, blocks, _ = tables_of(spark, sf_dir)
    free = free_pieces(segments, blocks, ["user_id"], 24.0).select("user_id", ((F.col("hi") - F.col("lo")) / F.least(F.col("v"), F.lit(177.0)) * 60).alias("minutes"))
    w = Window.partitionBy("user_id").orderBy("us")
    pairs = track(spark, sf_dir).select(F.col("event_type").alias("from_stop"), F.lead("event_type").over(w).alias("to_stop"), ((F.lead("us").over(w) - F.col("us")) / 6e7).alias("minutes"))
    ends = blocks.select("user_id", F.lit("signup").alias("from_stop"), F.lit("signup").alias("to_stop"))
    out = with_frozen(free, ends, pairs, ["user_id"])
    return out.select("user_id", *[F.round(c, 4).alias(c) for c in ("free", "frozen", "minutes")])


@query(TRACK + """, m AS (SELECT user_id, h AS p, h AS x, value AS y FROM tr), e AS (SELECT user_id, min_by(y, p) AS y0, min_by(x, p) AS x0, max_by(y, p) AS y1, max_by(x, p) AS x1 FROM m GROUP BY user_id),
q AS (SELECT user_id, event_id, h + 6 AS ahead, h - 6 AS behind FROM tr),
j AS (SELECT q.event_id, coalesce(u.x, e.x1) - coalesce(d.x, e.x0) AS dx, coalesce(u.y, e.y1) - coalesce(d.y, e.y0) AS dy FROM q JOIN e USING (user_id) ASOF LEFT JOIN m u ON q.user_id = u.user_id AND q.ahead <= u.p ASOF LEFT JOIN m d ON q.user_id = d.user_id AND q.behind >= d.p)
SELECT event_id, round(((degrees(atan2(dx, dy)) + 360) % 360 + 360) % 360, 6) AS heading FROM j""")
def heading_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bearing over at least six hours each way."""
    tr = track(spark, sf_dir).select("user_id", "event_id", "h", F.col("h").alias("x"), F.col("value").alias("y"))
    return linear.heading_by_distance(tr, ["user_id"], "h", "x", "y", 6.0, "heading", 240.0).select("event_id", F.round("heading", 6).alias("heading"))


@query(TRACK + """, s AS (SELECT event_id, r, value, coalesce(lag(value, 3) OVER w, first_value(value) OVER w) AS a, coalesce(lead(value, 3) OVER w, last_value(value) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS b FROM tr WINDOW w AS (PARTITION BY user_id ORDER BY us))
SELECT event_id, CASE WHEN abs(b - a) >= 50 THEN round(r, 4) ELSE 'inf'::DOUBLE END = 'inf'::DOUBLE AS straight, CASE WHEN abs(b - a) >= 50 THEN round(r, 4) END AS radius FROM s""")
def deflection_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radii where the line really turns, straights elsewhere."""
    g = linear.deflection_gate(track(spark, sf_dir), ["user_id"], ["us"], "value", "r", 3, 50.0, "g", block="day")
    straight = F.col("g") == float("inf")
    return g.select("event_id", straight.alias("straight"), F.when(~straight, F.round("g", 4)).alias("radius"))


@query(TRACK + """, a AS (SELECT *, CAST(class IS DISTINCT FROM lag(class) OVER w OR row_number() OVER w = 1 AS INTEGER) AS f FROM tr WINDOW w AS (PARTITION BY user_id ORDER BY us)),
b AS (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY us) AS BIGINT) AS run FROM a), r AS (SELECT user_id, run, min(h) AS lo, max(h) AS hi, CASE WHEN run % 2 = 0 THEN -1 ELSE 1 END AS direction FROM b GROUP BY user_id, run)
SELECT r.user_id AS section, r.run, CAST(row_number() OVER (PARTITION BY r.user_id, r.run ORDER BY tr.h * direction, event_id) AS INTEGER) AS seq, event_id AS vertex FROM r JOIN tr ON r.user_id = tr.user_id AND tr.h BETWEEN r.lo AND r.hi""")
def native_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices that each match run passes over, in its direction of travel."""
    from chainage.operators.corridor import native_vertices as rebuilt

    tr = track(spark, sf_dir)
    runs = linear.runs(tr, ["user_id"], ["us"], "class", "h", block="day").select("user_id", F.col("user_id").alias("section"), "run", "lo", "hi", F.when(F.col("run") % 2 == 0, -1).otherwise(1).alias("direction"))
    return rebuilt(runs, tr.select("user_id", F.col("h").alias("offset"), F.col("event_id").alias("vertex")), ["user_id"], 24.0)


@query(TRACK + """, n AS (SELECT user_id AS shape, count(*) AS n FROM tr GROUP BY user_id), u AS (SELECT DISTINCT event_type AS route, user_id AS shape FROM tr)
SELECT route, min_by(shape, (-n, shape)) AS shape, max(n) AS n FROM u JOIN n USING (shape) GROUP BY route""")
def representative_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest line of each route."""
    from chainage.operators.corridor import representative_shapes as longest

    tr = track(spark, sf_dir).select(F.col("user_id").alias("shape"), F.col("event_type").alias("route"))
    return longest(tr, tr, "route", "shape")


@query(TRACK + """, a AS (SELECT *, CAST(class IS DISTINCT FROM lag(class) OVER w OR row_number() OVER w = 1 AS INTEGER) AS f FROM tr WINDOW w AS (PARTITION BY user_id ORDER BY us)),
b AS (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY us) AS BIGINT) AS run FROM a), c0 AS (SELECT *, 1 / greatest(r, 1) >= 0.7 * max(1 / greatest(r, 1)) OVER (PARTITION BY user_id, run) AS sharp FROM b),
c AS (SELECT *, us BETWEEN min(us) FILTER (sharp) OVER (PARTITION BY user_id, run) AND max(us) FILTER (sharp) OVER (PARTITION BY user_id, run) AS body FROM c0),
d AS (SELECT user_id, run, r, h - avg(h) OVER (PARTITION BY user_id, run) AS x, value - avg(value) OVER (PARTITION BY user_id, run) AS y FROM c WHERE body), e AS (SELECT *, x * x + y * y AS z FROM d),
s AS (SELECT user_id, run, count(*) AS m, min(r) AS r_min, avg(z) AS mz, sum(x * x) AS cxx, sum(x * y) AS cxy, sum(y * y) AS cyy, sum(x * z) AS cxz, sum(y * z) AS cyz FROM e GROUP BY ALL),
f AS (SELECT *, cxx * cyy - cxy * cxy AS det, cxx * cyy - cxy * cxy <= 1e-12 * greatest(cxx * cyy, 1e-300) AS flat FROM s),
g AS (SELECT *, (cxz * cyy - cyz * cxy) / det / 2 AS p, (cyz * cxx - cxz * cxy) / det / 2 AS q FROM f)
SELECT user_id, run, m AS n_body, r_min, CASE WHEN m < 5 THEN NULL WHEN flat THEN 1e7::DOUBLE ELSE round(least(sqrt(mz + p * p + q * q), 1e7), 2) END AS fitted FROM g""")
def curve_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each segment the span between the places whose curvature reaches 0.7 of its greatest, and the circle through it."""
    from chainage.operators.corridor import bodies

    numbered = linear.islands(track(spark, sf_dir), ["user_id"], ["us"], "class", "run", block="day")
    out = bodies(numbered, ["user_id", "run"], "us", "h", "value", "r")
    return out.select("user_id", "run", "n_body", "r_min", F.when(F.col("fitted").isNotNull(), F.round(F.least("fitted", F.lit(1e7)), 2)).alias("fitted"))

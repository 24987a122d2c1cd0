"""Join queries: dictionaries, intervals, positions, the plane, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainage.functions.scalar import without_accents
from chainage.operators import intervals, linear, spatial, tables
from chainage.plans.registry import POINTS, TRACK, points, query, table, track


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, o_orderstatus, o_totalprice FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND l_linenumber % 2 = o_orderkey % 2")
def composite_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "lineitem").withColumn("half", F.col("l_linenumber") % 2).withColumn("o_orderkey", F.col("l_orderkey"))
    right = table(spark, sf_dir, "orders").withColumn("half", (F.col("o_orderkey") % 2).cast("int"))
    return left.join(right, ["o_orderkey", "half"], "left").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "o_orderstatus", "o_totalprice")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dictionary_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation and region have a fixed, small number of rows, so they may be broadcast
    nation, region = F.broadcast(table(spark, sf_dir, "nation")), F.broadcast(table(spark, sf_dir, "region"))
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return own.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS large FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def semi_anti_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "orders")
    kept = c.join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    kept = kept.join(table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_anti")
    large = o.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("large", F.lit(True))
    return kept.join(large, "c_custkey", "left").select("c_custkey", F.coalesce("large", F.lit(False)).alias("large"))


@query(TRACK + """, a AS (SELECT user_id, max(us) FILTER (event_type = 'click') AS ca, max(us) FILTER (event_type = 'purchase') AS cb FROM tr GROUP BY user_id)
SELECT user_id, round(abs(cb - ca) / 6e7, 4) AS minutes FROM a WHERE abs(cb - ca) / 6e7 > 0 AND abs(cb - ca) / 6e7 < 1440""")
def pair_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = track(spark, sf_dir).withColumn("t", F.col("us") / 6e7)
    return tables.pair_minutes(stops, "user_id", ["us"], "event_type", "t", "click", "purchase").select("user_id", F.round("minutes", 4).alias("minutes"))


@query(TRACK + """, a AS (SELECT user_id, event_type AS from_stop, lead(event_type) OVER w AS to_stop, (lead(us) OVER w - us) / 6e7 AS m FROM tr WHERE event_type IN ('click', 'signup', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT from_stop, to_stop, count(*) AS n, round(median(m), 4) AS median_minutes FROM a WHERE to_stop IS NOT NULL AND from_stop <> to_stop GROUP BY ALL""")
def adjacent_pair_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = track(spark, sf_dir).withColumn("t", F.col("us") / 6e7)
    pairs = tables.adjacent_minutes(stops, "user_id", ["us", "event_id"], "event_type", "t", ["click", "signup", "purchase"])
    return pairs.groupBy("from_stop", "to_stop").agg(F.count("*").alias("n"), F.round(F.median("minutes"), 4).alias("median_minutes"))


def _pq(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, sf_dir)
    asked = p.select("id", F.col("x").alias("px"), F.col("y").alias("py"), "label")
    return asked, p.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("label").alias("other_label"))


def _near(spark: SparkSession, sf_dir: str, radius: float) -> DataFrame:
    """All pairs of different points within the radius."""
    return spatial.within(*_pq(spark, sf_dir), radius).where("id <> other")


_PQ = POINTS + ", d AS (SELECT a.id, b.id AS other, a.label, b.label AS other_label, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist FROM p a, p b WHERE a.id <> b.id),\nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS rank FROM d WHERE dist <= 0.05)\n"


@query(_PQ + "SELECT id, other, CAST(rank AS INTEGER) AS rank, round(dist, 9) AS dist FROM n WHERE rank <= 10")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = spatial.k_nearest(*_pq(spark, sf_dir), 0.05, ["id"], ["other"], 10, F.col("id") != F.col("other"))
    return near.select("id", "other", "rank", F.round("dist", 9).alias("dist"))


@query(_PQ + "SELECT id, other, round(dist, 9) AS dist FROM n WHERE rank = 1")
def nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = spatial.k_nearest(*_pq(spark, sf_dir), 0.05, ["id"], ["other"], 1, F.col("id") != F.col("other"))
    return near.select("id", "other", F.round("dist", 9).alias("dist"))


@query(_PQ + """SELECT id, coalesce(min_by(other, rank) FILTER (abs(label - other_label) <= 1), min_by(other, rank)) AS other FROM n WHERE rank <= 10 GROUP BY id""")
def aligned_or_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = spatial.k_nearest(*_pq(spark, sf_dir), 0.05, ["id"], ["other"], 10, F.col("id") != F.col("other"))
    return spatial.aligned_or_nearest(near, ["id"], "other", F.abs(F.col("label") - F.col("other_label")), 1)


@query(_PQ + """, w AS (SELECT id, other_label, min(dist) AS d FROM d WHERE dist <= 0.05 GROUP BY ALL), b AS (SELECT *, min(d) OVER (PARTITION BY id) AS best FROM w)
SELECT id, count(*) FILTER (d <= best + 0.02) AS n_tracks FROM b GROUP BY id""")
def track_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.count_close_to_best(_near(spark, sf_dir, 0.05), ["id"], "other_label", 0.02, "n_tracks")


@query(_PQ + "SELECT id, id IN (SELECT id FROM d WHERE dist <= 0.01) AS near FROM p")
def radius_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.flagged(points(spark, sf_dir).select("id"), _near(spark, sf_dir, 0.01), ["id"])


@query(POINTS + """, e AS (SELECT id AS edge, x AS ax, y AS ay, x + 0.05 AS bx, y + 0.03 AS by1 FROM p), q AS (SELECT id, x, y FROM p),
f AS (SELECT id, edge, least(greatest(((x - ax) * 0.05::DOUBLE + (y - ay) * 0.03::DOUBLE) / (0.05::DOUBLE ** 2 + 0.03::DOUBLE ** 2), 0), 1) AS s, ax, ay, bx, by1, x, y FROM q, e WHERE id <> edge),
g AS (SELECT id, edge, s, sqrt((x - ax - s * (bx - ax)) ** 2 + (y - ay - s * (by1 - ay)) ** 2) AS dist FROM f)
SELECT id, edge, round(s, 6) AS share, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(dist, 9), edge) AS k FROM g WHERE dist <= 0.04) WHERE k = 1""")
def project_on_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    edges = p.select(F.col("id").alias("edge"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + 0.05).alias("bx"), (F.col("y") + 0.03).alias("by"))
    asked = p.select("id", F.col("x").alias("px"), F.col("y").alias("py"))
    found = spatial.nearest_segments(asked, edges, 0.04, ["id"], "edge", 0.05, 9, F.col("id") != F.col("edge"))
    return found.select("id", "edge", F.round("share", 6).alias("share"), F.round("dist", 6).alias("dist"))


_SPANS = TRACK + """, b0 AS (SELECT user_id, h AS b_lo, lead(h) OVER (PARTITION BY user_id ORDER BY us) AS b_hi, row_number() OVER (PARTITION BY user_id ORDER BY us) AS i FROM tr WHERE event_type = 'signup'),
b AS (SELECT * FROM b0 WHERE i % 2 = 1 AND b_hi IS NOT NULL),
a0 AS (SELECT user_id, event_id AS a_id, h AS a_lo, lead(h) OVER (PARTITION BY user_id ORDER BY us) AS a_hi, row_number() OVER (PARTITION BY user_id ORDER BY us) AS i FROM tr WHERE event_type = 'click'),
a AS (SELECT * FROM a0 WHERE a_hi IS NOT NULL)
"""


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("us")
    tr = track(spark, sf_dir)
    b = tr.where("event_type = 'signup'").select("user_id", F.col("h").alias("b_lo"), F.lead("h").over(w).alias("b_hi"), F.row_number().over(w).alias("i")).where("i % 2 = 1 and b_hi is not null").drop("i")
    a = tr.where("event_type = 'click'").select("user_id", F.col("event_id").alias("a_id"), F.col("h").alias("a_lo"), F.lead("h").over(w).alias("a_hi")).where("a_hi is not null")
    return a, b


@query(_SPANS + """SELECT a.user_id, a_id, round(b_lo, 6) AS b_lo, round(least(a_hi, b_hi) - greatest(a_lo, b_lo), 6) AS overlap, round((least(a_hi, b_hi) - greatest(a_lo, b_lo)) / 50, 6) AS hours_at_50 FROM a JOIN b ON a.user_id = b.user_id AND a_lo < b_hi AND b_lo < a_hi""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = intervals.overlap_join(*_spans(spark, sf_dir), ["user_id"], 12.0)
    return met.select("user_id", "a_id", F.round("b_lo", 6).alias("b_lo"), F.round("overlap", 6).alias("overlap"), F.round(F.col("overlap") / 50, 6).alias("hours_at_50"))


@query(_SPANS + """, s AS (SELECT a.user_id, a_id, sum(least(a_hi, b_hi) - greatest(a_lo, b_lo)) / any_value(a_hi - a_lo) AS share FROM a JOIN b ON a.user_id = b.user_id AND a_lo < b_hi AND b_lo < a_hi GROUP BY ALL)
SELECT a_id, round(coalesce(share, 0), 6) AS share, coalesce(share, 0) >= 0.7 AS overridden, CASE WHEN coalesce(share, 0) >= 0.7 THEN 'block' ELSE 'line' END AS kind FROM a LEFT JOIN s USING (user_id, a_id)""")
def interval_share_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _spans(spark, sf_dir)
    shares = intervals.overlap_share(a, b, ["user_id"], ["a_id"], 12.0)
    rows = intervals.override_by_share(a.select("a_id").withColumn("kind", F.lit("line")), shares, ["a_id"], "kind", "block")
    return rows.join(shares.select("a_id", F.round("share", 6).alias("share")), "a_id").select("a_id", "share", "overridden", "kind")


@query(_SPANS + """, c AS (SELECT a.user_id, a_id, a_lo, a_hi, greatest(a_lo, b_lo) AS s, least(a_hi, b_hi) AS e FROM a JOIN b ON a.user_id = b.user_id AND a_lo < b_hi AND b_lo < a_hi
 UNION ALL SELECT user_id, a_id, a_lo, a_hi, a_hi, a_hi FROM a WHERE a_lo < a_hi),
g AS (SELECT *, coalesce(max(e) OVER (PARTITION BY user_id, a_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a_lo) AS lo FROM c)
SELECT user_id, a_id, round(lo, 6) AS lo, round(s, 6) AS hi FROM g WHERE lo < s""")
def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _spans(spark, sf_dir)
    return intervals.subtract(a, b, ["user_id"], ["a_id"], 12.0).select("user_id", "a_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(_SPANS + """, q AS (SELECT user_id, event_id, h FROM tr WHERE event_type = 'error')
SELECT a_id, count(q.event_id) AS n_near FROM a LEFT JOIN q ON a.user_id = q.user_id AND q.h >= a_lo - 0.2 AND q.h <= a_hi + 0.2 GROUP BY a_id""")
def near_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = _spans(spark, sf_dir)
    errors = track(spark, sf_dir).where("event_type = 'error'").select("user_id", "h")
    return intervals.near_counts(a, errors, ["user_id"], ["a_id"], "h", 0.2, 12.0, ("a_lo", "a_hi")).select("a_id", "n_near")


@query(_SPANS + """SELECT q.event_id, b.b_lo IS NOT NULL AS inside FROM (SELECT * FROM tr WHERE event_type = 'error') q LEFT JOIN b ON q.user_id = b.user_id AND q.h >= b_lo AND q.h < b_hi""")
def step_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, b = _spans(spark, sf_dir)
    errors = track(spark, sf_dir).where("event_type = 'error'").select("user_id", "event_id", "h")
    found = intervals.points_in(errors, b, ["user_id"], "h", 12.0, ("b_lo", "b_hi")).select("event_id").distinct().withColumn("inside", F.lit(True))
    return errors.join(found, "event_id", "left").select("event_id", F.coalesce("inside", F.lit(False)).alias("inside"))


@query(TRACK + """, q AS (SELECT user_id, event_id, h + 1.5 AS at FROM tr WHERE event_type = 'error'), s AS (SELECT user_id, h AS lo, lead(h) OVER (PARTITION BY user_id ORDER BY us) AS hi, v FROM tr)
SELECT q.event_id, round(coalesce(s.v, 0), 6) AS limit_kmh FROM q LEFT JOIN s ON q.user_id = s.user_id AND q.at >= s.lo AND q.at < s.hi""")
def step_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limit in force at positions, 0 beyond the last step."""
    from pyspark.sql import Window

    tr = track(spark, sf_dir)
    steps = tr.select("user_id", F.col("h").alias("lo"), F.lead("h").over(Window.partitionBy("user_id").orderBy("us")).alias("hi"), "v")
    asked = tr.where("event_type = 'error'").select("user_id", "event_id", (F.col("h") + 1.5).alias("at"))
    out = intervals.step_value(asked, steps, ["user_id"], ["event_id"], "at", "v", 12.0, 0.0)
    return out.select("event_id", F.round("v", 6).alias("limit_kmh"))


_MARKS = TRACK + """, q AS (SELECT user_id, event_id, us, h FROM tr WHERE event_type = 'error'), m AS (SELECT user_id, event_id AS mark, us, h, v FROM tr WHERE event_type = 'signup')
"""


def _marks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tr = track(spark, sf_dir)
    return tr.where("event_type = 'error'").select("user_id", "event_id", "h"), tr.where("event_type = 'signup'").select("user_id", "h", F.col("event_id").alias("mark"), "v")


@query(_MARKS + """SELECT q.event_id, d.mark AS before, u.mark AS after FROM q ASOF LEFT JOIN m d ON q.user_id = d.user_id AND q.h >= d.h ASOF LEFT JOIN m u ON q.user_id = u.user_id AND q.h <= u.h""")
def asof_up_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, m = _marks(spark, sf_dir)
    return linear.between(q, m, ["user_id"], "h", ["mark"], width=240.0).select("event_id", F.col("down_mark").alias("before"), F.col("up_mark").alias("after"))


@query(_MARKS + """, j AS (SELECT q.event_id, q.h, d.h AS ha, d.v AS va, u.h AS hb, u.v AS vb FROM q ASOF LEFT JOIN m d ON q.user_id = d.user_id AND q.h >= d.h ASOF LEFT JOIN m u ON q.user_id = u.user_id AND q.h <= u.h)
SELECT event_id, round(CASE WHEN ha IS NULL THEN vb WHEN hb IS NULL THEN va WHEN ha = hb THEN va ELSE va + (h - ha) / (hb - ha) * (vb - va) END, 6) AS v FROM j""")
def lerp_at_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, m = _marks(spark, sf_dir)
    return linear.interpolate(q, m.select("user_id", "h", "v"), ["user_id"], "h", "v", "v", width=240.0).select("event_id", F.round("v", 6).alias("v"))


@query("""WITH s AS (SELECT l_returnflag, l_quantity AS len, least(4.824::DOUBLE * sqrt(l_extendedprice / 10), 360) AS v FROM lineitem),
c AS (SELECT * FROM (VALUES (153.0), (177.0), (201.0)) t(cap))
SELECT l_returnflag, CAST(cap AS DOUBLE) AS cap, count(*) AS n, round(sum(len), 2) AS length, min(round(v, 6)) AS slowest FROM s, c WHERE v < cap - 1e-6 GROUP BY ALL""")
def param_sweep_under_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainage.functions.curves import vmax

    s = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("len"), vmax(F.col("l_extendedprice") / 10, 4.824).alias("v"))
    swept = s.withColumn("cap", F.explode(F.array(*[F.lit(c) for c in (153.0, 177.0, 201.0)])))
    return swept.where(F.col("v") < F.col("cap") - 1e-6).groupBy("l_returnflag", "cap").agg(F.count("*").alias("n"), F.round(F.sum("len"), 2).alias("length"), F.min(F.round("v", 6)).alias("slowest"))


@query("""WITH n AS (SELECT DISTINCT replace(replace(lower(split_part(p_name, ' ', 2)), 'é', 'e'), 'è', 'e') AS w FROM part), t AS (SELECT DISTINCT p_name, p_type FROM part)
SELECT p_name, p_type, w FROM t, n WHERE contains(lower(p_name), w) OR contains(w, lower(p_name))""")
def fuzzy_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name", "p_type").distinct().withColumn("low", F.lower("p_name"))
    words = names.select(without_accents(F.get(F.split("p_name", " "), F.lit(1))).alias("w")).distinct()
    return tables.contained(names, words, "low", "w").union(tables.contained(words, names, "w", "low").select("p_name", "p_type", "low", "w")).distinct().select("p_name", "p_type", "w")


@query("""SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def keyed_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality"), F.lit(0).alias("toxic"))
    return tables.overwrite(d, table(spark, sf_dir, "labels"), ["doc_id"], ["quality", "toxic"])


@query(TRACK + """SELECT event_id, round(CASE WHEN user_id % 3 = 0 AND h > 24 THEN h - 24 ELSE h END, 6) AS h, CASE WHEN user_id % 3 = 0 AND h > 24 THEN user_id + 1 ELSE user_id END AS section FROM tr""")
def trunk_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = (F.col("user_id") % 3 == 0) & (F.col("h") > 24)
    return track(spark, sf_dir).select("event_id", F.round(F.when(shared, F.col("h") - 24).otherwise(F.col("h")), 6).alias("h"), F.when(shared, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("section"))


@query("""WITH last AS (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS p, max(o_orderkey) AS k FROM orders GROUP BY o_custkey)
SELECT c_custkey, p AS priority, k AS orderkey FROM customer JOIN last ON c_custkey = o_custkey""")
def aligned_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = tables.first_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderkey")])
    return table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("orderkey"))

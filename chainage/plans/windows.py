"""Ordered queries: chainage, islands, rolling statistics, recurrences that have a closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainage.functions.scalar import clamp
from chainage.operators import linear, robust, tables
from chainage.plans.registry import TRACK, query, table, track


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track(spark, sf_dir).withColumn("state", 1 + F.pmod("event_id", F.lit(3)))


_W = "WINDOW w AS (PARTITION BY user_id ORDER BY us)"


@query(TRACK + f", s AS (SELECT event_id, user_id, us, abs(coalesce(value - lag(value) OVER w, 0)) AS step FROM tr {_W}) SELECT event_id, round(sum(step) OVER (PARTITION BY user_id ORDER BY us), 4) AS km FROM s")
def chainage(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = linear.previous(track(spark, sf_dir), ["user_id"], ["us"], "value", "before", block="day").withColumn("step", F.abs(F.coalesce(F.col("value") - F.col("before"), F.lit(0.0))))
    return linear.running_sum(steps, ["user_id"], ["us"], F.col("step"), "km", block="day").select("event_id", F.round("km", 4).alias("km"))


@query(TRACK + f""", a AS (SELECT *, CAST(event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 AS INTEGER) AS f FROM tr {_W}),
b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY us) AS run FROM a)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, round(min(h), 6) AS lo, round(max(h), 6) AS hi, count(*) AS n FROM b GROUP BY user_id, run""")
def islands_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.runs(track(spark, sf_dir), ["user_id"], ["us"], "event_type", "h", block="day").withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


@query(TRACK + "SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING), 6) AS m, round_even(median(1 + event_id % 3) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING), 0) AS state FROM tr")
def rolling_median_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = robust.rolling_median(_wide(spark, sf_dir), ["user_id"], ["us"], "value", 12, "m", block="day")
    return robust.rolling_median(m, ["user_id"], ["us"], "state", 12, "s", block="day").select("event_id", F.round("m", 6).alias("m"), F.rint("s").alias("state"))


_PAD = """, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) AS i, count(*) OVER (PARTITION BY user_id) AS c FROM tr),
g AS (SELECT n.event_id, list(m.value) AS l FROM n CROSS JOIN (SELECT unnest(range(-{k}, {k} + 1)) AS d) JOIN n m ON m.user_id = n.user_id AND m.i = least(greatest(n.i + d, 1), n.c) GROUP BY n.event_id)
"""


@query(TRACK + _PAD.format(k=3) + "SELECT event_id, list_sort(l)[4] AS m, round(list_sum(l) / 7, 6) AS mean FROM g")
def padded_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = robust.median_filter(track(spark, sf_dir), ["user_id"], ["us"], "value", 3, "m", block="day")
    return robust.moving_average(m, ["user_id"], ["us"], "value", 3, "mean", block="day").select("event_id", "m", F.round("mean", 6).alias("mean"))


@query(TRACK + _PAD.format(k=2) + ", m AS (SELECT user_id, list_sort(l)[3] AS m FROM g JOIN tr USING (event_id)) SELECT user_id, min(m) AS sustained FROM m GROUP BY user_id")
def sustained_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.sustained_min(track(spark, sf_dir), ["user_id"], ["us"], "value", 2, "sustained")


@query(TRACK + "SELECT event_id, round(min(v) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS limit_kmh FROM tr")
def trailing_min_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.trailing_min(track(spark, sf_dir), ["user_id"], ["us"], "v", 6, "m", block="day").select("event_id", F.round("m", 6).alias("limit_kmh"))


@query(TRACK + """, s AS (SELECT event_id, user_id, us, h * 1000 AS x, (v / 3.6) ** 2 + 2 * 0.5 * h * 1000 AS e FROM tr)
SELECT event_id, round(sqrt(greatest(min(e) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 2 * 0.5 * x, 0)), 4) AS v FROM s""")
def braking_suffix_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = track(spark, sf_dir).withColumns({"x": F.col("h") * 1000, "v0": F.col("v") / 3.6})
    return linear.braking(s, ["user_id"], ["us"], "x", "v0", 0.5, "vb", block="day").select("event_id", F.round("vb", 4).alias("v"))


@query(TRACK + f""", s AS (SELECT event_id, user_id, us, coalesce((lead(h) OVER w - h) / greatest((v + lead(v) OVER w) / 2, 0.5), 0) AS t FROM tr {_W})
SELECT event_id, round(t, 8) AS t, round(sum(t) OVER (PARTITION BY user_id ORDER BY us), 6) AS cumulative FROM s""")
def trapezoid_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = linear.trapezoid_time(track(spark, sf_dir), ["user_id"], ["us"], "h", "v", "t", floor=0.5, block="day")
    return linear.running_sum(t, ["user_id"], ["us"], F.col("t"), "c", block="day").select("event_id", F.round("t", 8).alias("t"), F.round("c", 6).alias("cumulative"))


@query(TRACK + """, r AS (SELECT *, instr('ABCDEF', class) AS k FROM tr), g AS (SELECT event_id, k, list_concat(coalesce(list(k) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), []), coalesce(list(k) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), [])) AS l FROM r)
SELECT event_id, CAST(list_sort(l)[len(l) // 2 + 1] AS INTEGER) AS around, k - list_sort(l)[len(l) // 2 + 1] >= 2 AS bottleneck FROM g""")
def neighbour_drop_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = track(spark, sf_dir).withColumn("k", F.instr(F.lit("ABCDEF"), F.col("class")))
    return robust.neighbour_rank(r, ["user_id"], ["us"], "k", 10, "around", block="day").select("event_id", "around", (F.col("k") - F.col("around") >= 2).alias("bottleneck"))


@query(TRACK + f""", s AS (SELECT event_id, user_id, us, event_type = 'error' AND lag(event_type) OVER w <> 'error' AND lead(event_type) OVER w <> 'error' AS alone,
 degrees(atan2(lead(value) OVER w - lag(value) OVER w, lead(h) OVER w - lag(h) OVER w)) AS central FROM tr {_W}) SELECT event_id, alone, round(central, 6) AS central FROM s""")
def neighbours_and_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("us")
    before, after = F.lag("event_type").over(w), F.lead("event_type").over(w)
    central = F.degrees(F.atan2(F.lead("value").over(w) - F.lag("value").over(w), F.lead("h").over(w) - F.lag("h").over(w)))
    return track(spark, sf_dir).select("event_id", ((F.col("event_type") == "error") & (before != "error") & (after != "error")).alias("alone"), F.round(central, 6).alias("central"))


@query(TRACK + f""", a AS (SELECT event_id, user_id, us, value * pi() / 200 - pi() AS ang FROM tr), s AS (SELECT *, ang - lag(ang) OVER w AS d FROM a {_W})
SELECT event_id, round(ang + sum(coalesce(-2 * pi() * round_even(d / (2 * pi()), 0), 0)) OVER (PARTITION BY user_id ORDER BY us), 6) AS unwrapped FROM s""")
def phase_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = track(spark, sf_dir).withColumn("ang", F.col("value") * F.pi() / 200 - F.pi())
    return linear.unwrapped(a, ["user_id"], ["us"], "ang", "u", block="day").select("event_id", F.round("u", 6).alias("unwrapped"))


@query(TRACK + f""", s AS (SELECT event_id, user_id, us, (lead(value, 2) OVER w - lag(value, 2) OVER w) / (lead(h, 2) OVER w - lag(h, 2) OVER w) AS d FROM tr {_W})
SELECT event_id, round(coalesce(d, first_value(d IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(d IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 4) AS slope FROM s""")
def finite_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.derivative(track(spark, sf_dir), ["user_id"], ["us"], "h", "value", 2, "d", block="day").select("event_id", F.round("d", 4).alias("slope"))


@query(TRACK + """, e AS (SELECT user_id, max(h) AS hi FROM tr GROUP BY user_id), g AS (SELECT user_id, unnest(range(CAST(floor(hi / 6 + 1e-9) AS BIGINT) + 1)) * 6.0::DOUBLE AS pos FROM e)
SELECT g.user_id, pos, d.event_id AS before FROM g ASOF LEFT JOIN tr d ON g.user_id = d.user_id AND g.pos >= d.h""")
def resample_every_six_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    tr = track(spark, sf_dir)
    spans = tr.groupBy("user_id").agg(F.max("h").alias("hi")).withColumn("lo", F.lit(0.0))
    at = linear.grid(spans, "lo", "hi", 6.0, "h").select("user_id", "h")
    return linear.asof(at, tr.select("user_id", "h", F.col("event_id").alias("before")), ["user_id"], "h", ["before"], width=240.0).select("user_id", F.col("h").alias("pos"), "before")


@query(TRACK + f", s AS (SELECT event_id, event_type, lag(event_type) OVER w AS p, row_number() OVER w AS i FROM tr {_W}) SELECT event_id, event_type FROM s WHERE i = 1 OR event_type <> p")
def without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.without_repeats(track(spark, sf_dir), ["user_id"], ["us"], ["event_type"]).select("event_id", "event_type")


@query(TRACK + f", s AS (SELECT event_id, row_number() OVER w AS i, lead(1) OVER w IS NULL AS last FROM tr {_W}) SELECT event_id FROM s WHERE i % 3 = 1 OR last")
def decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.decimated(track(spark, sf_dir), ["user_id"], ["us"], 3, block="day").select("event_id")


@query("""SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey""")
def dedup_first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    first = tables.first_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("first_order"))
    last = tables.first_per_key(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("last_order"))
    return first.join(last, "o_custkey")


@query("SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) > 1 AS repeated FROM orders")
def group_max_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.max("o_totalprice").over(w).alias("top"), (F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")) > 1).alias("repeated"))


@query("""WITH s AS (SELECT p_partkey, sum(p_retailprice) OVER (ORDER BY p_size DESC, p_retailprice, p_partkey ROWS UNBOUNDED PRECEDING) AS running FROM part)
SELECT p_partkey, budget, round(running, 2) AS running FROM s, (VALUES (20000.0::DOUBLE), (60000), (150000)) b(budget) WHERE running <= budget""")
def budget_tranches(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = table(spark, sf_dir, "part").withColumn("rank", -F.col("p_size"))
    out = tables.budget_tranches(works, "p_retailprice", ["rank", "p_retailprice", "p_partkey"], [20000, 60000, 150000], block="rank")
    return out.select("p_partkey", "budget", F.round("running", 2).alias("running"))


@query(TRACK + """, e AS (SELECT user_id, unnest([10.0::DOUBLE, 50, 200]) AS stop FROM (SELECT DISTINCT user_id FROM tr))
SELECT e.user_id, stop, min_by(event_id, (abs(h - stop), us)) AS event_id FROM e JOIN tr USING (user_id) GROUP BY ALL""")
def nearest_row_for_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    tr = track(spark, sf_dir).withColumn("stop", F.explode(F.array(*[F.lit(x) for x in (10.0, 50.0, 200.0)])))
    return tr.groupBy("user_id", "stop").agg(F.min_by("event_id", F.struct(F.abs(F.col("h") - F.col("stop")), "us")).alias("event_id"))


@query(TRACK + "SELECT event_id, round(least(greatest(value, 50), 300), 6) AS clipped, round(min(v) OVER (PARTITION BY user_id ORDER BY us DESC ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS reverse_limit FROM tr")
def reverse_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = robust.trailing_min(track(spark, sf_dir), ["user_id"], [F.desc("us")], "v", 6, "m")
    return m.select("event_id", F.round(clamp(F.col("value"), 50.0, 300.0), 6).alias("clipped"), F.round("m", 6).alias("reverse_limit"))

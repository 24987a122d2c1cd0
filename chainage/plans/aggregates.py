"""Aggregation queries: cross-tabs, quantiles, weighted speeds, cells, graphs, figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainage.functions import curves, scalar
from chainage.operators import graph, linear, robust, spatial, tables
from chainage.plans.registry import POINTS, TRACK, K, points, query, table, track

_CODES = [c.code for c in curves.CLASSES]


@query(TRACK + """, s AS (SELECT user_id, class, coalesce(h - lag(h) OVER (PARTITION BY user_id ORDER BY us), 0) AS step FROM tr)
SELECT user_id, """ + ", ".join(f"round(coalesce(sum(step) FILTER (class = '{c}'), 0), 6) AS \"{c}\"" for c in _CODES) + " FROM s GROUP BY user_id")  # fmt: skip
def km_by_speed_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length by section and speed class, all classes present. Steps are taken in two levels by day."""
    steps = linear.previous(track(spark, sf_dir), ["user_id"], ["us"], "h", "h0", block="day").withColumn("step", F.coalesce(F.col("h") - F.col("h0"), F.lit(0.0)))
    wide = tables.pivoted(steps, ["user_id"], "class", _CODES, F.sum("step"))
    return wide.select("user_id", *[F.round(c, 6).alias(c) for c in _CODES])


@query("""SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS open_quantity, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS done_quantity, count(*) FILTER (l_discount > 0.05) AS discounted FROM lineitem GROUP BY l_returnflag""")
def conditional_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, status = F.col("l_quantity"), F.col("l_linestatus")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.when(status == "O", q)), 2).alias("open_quantity"), F.round(F.sum(F.when(status == "F", q)), 2).alias("done_quantity"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))


@query("""SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(median(o_totalprice), 4) AS median_price, round(avg(o_totalprice), 4) AS mean_price,
 round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderpriority""")
def named_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    orders = table(spark, sf_dir, "orders")
    counted = orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.round(F.avg(p), 4).alias("mean_price"))
    at = robust.exact_quantiles(orders, ["o_orderpriority"], "o_totalprice", {"median_price": 0.5, "p10": 0.1, "p90": 0.9}).drop("n")
    return counted.join(at.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in ("median_price", "p10", "p90")]), "o_orderpriority")


@query("""SELECT l_shipmode, round(quantile_cont(r, 0.1), 4) AS p10, round(quantile_cont(r, 0.5), 4) AS p50, round(count(*) / sum(1 / greatest(r, 1e-6)), 6) AS harmonic, round(sum(l_quantity) / sum(l_quantity / v), 6) AS mean_speed
 FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, l_quantity, l_extendedprice / 10 AS r, least(4.824::DOUBLE * sqrt(l_extendedprice / 10), 360) AS v FROM lineitem) GROUP BY ALL""")
def harmonic_and_weighted_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("l_extendedprice") / 10
    s = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("l_shipmode"), "l_quantity", r.alias("r"), curves.vmax(r, K).alias("v"))
    means = s.groupBy("l_shipmode").agg(F.round(robust.harmonic_mean(F.col("r")), 6).alias("harmonic"), F.round(robust.weighted_harmonic(F.col("l_quantity"), F.col("v")), 6).alias("mean_speed"))
    at = robust.exact_quantiles(s, ["l_shipmode"], "r", {"p10": 0.1, "p50": 0.5})
    return means.join(at.select("l_shipmode", F.round("p10", 4).alias("p10"), F.round("p50", 4).alias("p50")), "l_shipmode")


@query("""WITH s AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
a AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS a, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM s)
SELECT l_returnflag, min(v) AS lower_median FROM a WHERE a >= t / 2 GROUP BY l_returnflag""")
def weighted_lower_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.lower_weighted_median(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", "lower_median")


@query("""WITH s AS (SELECT o_custkey, list_sort(list(o_totalprice)) AS l FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN len(l) >= 4 THEN l[1 + CAST(floor(0.25 * (len(l) - 1)) AS INTEGER)] END AS low, CASE WHEN len(l) >= 4 THEN l[1 + CAST(floor(0.75 * (len(l) - 1)) AS INTEGER)] END AS high FROM s""")
def quartile_low_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    low = robust.low_index_quantile(o, ["o_custkey"], "o_totalprice", 0.25, "low")
    return low.join(robust.low_index_quantile(o, ["o_custkey"], "o_totalprice", 0.75, "high"), "o_custkey")


@query("""SELECT source, min_by(doc_id, -n_chars * 1e9 + doc_id) AS longest_doc, max(n_chars) AS n_chars FROM documents GROUP BY source""")
def arg_max_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return d.groupBy("source").agg(F.min_by("doc_id", F.struct((-F.col("n_chars")).alias("n"), "doc_id")).alias("longest_doc"), F.max("n_chars").alias("n_chars"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, min_by(event_type, (-n, event_type)) AS mode FROM c WHERE event_type IS NOT NULL GROUP BY user_id""")
def mode_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").where("event_type is not null").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("mode"))


@query(POINTS + """, s AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS rank FROM p GROUP BY label),
c AS (SELECT id, floor(x / 0.02) AS i, floor(y / 0.02) AS j, p.label, rank FROM p JOIN s USING (label)), m AS (SELECT i, j, min(rank) AS claim FROM c GROUP BY ALL)
SELECT id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, label FROM c JOIN m USING (i, j) WHERE rank = claim""")
def cells_first_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    # one row per section: the ranking window is over the list of sections
    rank = p.groupBy("label").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "label"))).select("label", "rank")
    cells = p.join(rank, "label").withColumns({"i": F.floor(F.col("x") / 0.02), "j": F.floor(F.col("y") / 0.02)})
    return spatial.first_claim(cells, ["i", "j"], "label", "rank").select("id", "i", "j", "label")


@query("""WITH d AS (SELECT * FROM (VALUES ('A'), ('N'), ('R'), ('X')) a(l_returnflag), (VALUES ('to 10'), ('to 25'), ('over 25'), ('none')) b(band)),
s AS (SELECT l_returnflag, CASE WHEN l_quantity <= 10 THEN 'to 10' WHEN l_quantity <= 25 THEN 'to 25' ELSE 'over 25' END AS band FROM lineitem),
c AS (SELECT l_returnflag, band, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 'all', band, count(*) FROM s GROUP BY ALL),
e AS (SELECT * FROM d UNION ALL SELECT DISTINCT 'all', band FROM d)
SELECT l_returnflag, band, coalesce(n, 0) AS n FROM e LEFT JOIN c USING (l_returnflag, band)""")
def crosstab_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").withColumn("band", curves.banded(F.col("l_quantity"), [10, 25], ["to 10", "to 25", "over 25"]))
    return tables.crosstab(s, "l_returnflag", "band", ["A", "N", "R", "X"], ["to 10", "to 25", "over 25", "none"], F.count("*"), total="all")


@query("""SELECT CASE WHEN l_quantity <= 5 THEN '1-5' WHEN l_quantity <= 20 THEN '6-20' ELSE '21-' END AS bin, count(*) AS n, round(avg(l_discount), 8) AS mean, round(quantile_cont(l_discount, 0.5), 6) AS median FROM lineitem GROUP BY bin""")
def binned_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = curves.banded(F.col("l_quantity"), [5, 20], ["1-5", "6-20", "21-"])
    return table(spark, sf_dir, "lineitem").groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 8).alias("mean"), F.round(F.percentile("l_discount", F.lit(0.5)), 6).alias("median"))


@query("""SELECT quality, round(100 * avg(CAST(toxic AS DOUBLE)), 6) AS share, avg(toxic) >= 0.5 AS majority, round(avg(CASE WHEN toxic = quality THEN 1.0::DOUBLE ELSE 0 END), 6) AS agreement FROM labels GROUP BY quality""")
def boolean_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.avg(F.col("toxic").cast("double"))
    return table(spark, sf_dir, "labels").groupBy("quality").agg(F.round(100 * t, 6).alias("share"), (t >= 0.5).alias("majority"), F.round(F.avg((F.col("toxic") == F.col("quality")).cast("double")), 6).alias("agreement"))


@query("""SELECT count(l.doc_id) AS covered, count(*) AS n, round(count(l.doc_id) / count(*), 6) AS coverage, round(avg(CASE WHEN l.doc_id IS NOT NULL THEN CAST((l.quality = 1) = (d.n_chars > 500) AS DOUBLE) END), 6) AS agreement FROM documents d LEFT JOIN labels l USING (doc_id)""")
def coverage_and_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").withColumn("known", F.lit(1)), "doc_id", "left")
    agree = F.when(F.col("known") == 1, ((F.col("quality") == 1) == (F.col("n_chars") > 500)).cast("double"))
    return d.agg(F.count("known").alias("covered"), F.count("*").alias("n"), F.round(F.count("known") / F.count("*"), 6).alias("coverage"), F.round(F.avg(agree), 6).alias("agreement"))


@query(TRACK + "SELECT class, round(count(*) * 0.01, 6) AS km FROM tr GROUP BY class")
def km_at_fixed_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track(spark, sf_dir).groupBy("class").agg(F.round(F.count("*") * 0.01, 6).alias("km"))


@query(TRACK + """, s AS (SELECT user_id, lag(h) OVER w AS h0, h, lag(value) OVER w AS v0, value AS v1 FROM tr WINDOW w AS (PARTITION BY user_id ORDER BY us))
SELECT user_id, round(sum(2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0, sin(radians(v1 / 100 - v0 / 100) / 2) ** 2 + cos(radians(v0 / 100)) * cos(radians(v1 / 100)) * sin(radians(h / 100 - h0 / 100) / 2) ** 2)))) FILTER (h0 IS NOT NULL), 2) AS length_m FROM s GROUP BY user_id""")
def polyline_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("us")
    s = track(spark, sf_dir).select("user_id", (F.lag("h").over(w) / 100).alias("x0"), (F.col("h") / 100).alias("x1"), (F.lag("value").over(w) / 100).alias("y0"), (F.col("value") / 100).alias("y1"))
    return s.groupBy("user_id").agg(F.round(F.sum(scalar.haversine_m(F.col("y0"), F.col("x0"), F.col("y1"), F.col("x1"))), 2).alias("length_m"))


@query("""SELECT l_returnflag, round(sum(l_quantity), 2) AS quantity, round(sum(l_quantity / nullif(l_extendedprice, 0)), 6) AS ratio FROM lineitem GROUP BY l_returnflag
 UNION ALL SELECT 'total', round(sum(l_quantity), 2), round(sum(l_quantity) / sum(l_extendedprice), 6) FROM lineitem""")
def totals_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    rows = li.groupBy("l_returnflag").agg(F.round(F.sum(q), 2).alias("quantity"), F.round(F.sum(F.try_divide(q, p)), 6).alias("ratio"))
    return rows.unionByName(li.agg(F.round(F.sum(q), 2).alias("quantity"), F.round(F.try_divide(F.sum(q), F.sum(p)), 6).alias("ratio")).withColumn("l_returnflag", F.lit("total")))


@query("""SELECT l_partkey AS node, count(*) AS degree FROM lineitem GROUP BY l_partkey HAVING count(*) >= 30""")
def junction_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = table(spark, sf_dir, "lineitem").select(F.array("l_partkey").alias("node_refs"))
    return graph.junctions(ways, least=30)


@query()
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of customers (even nodes) and parts (odd nodes) that orders join; recursion over all of them is too slow for SQL."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    e = lines.join(orders, "l_orderkey").select((2 * F.col("o_custkey")).alias("u"), (2 * F.col("l_partkey") + 1).alias("v"))
    return graph.components(e)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS u, -1 - o_custkey // 7 AS v FROM orders), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r(node, seen) AS (SELECT u, u FROM b UNION SELECT r.node, b.v FROM r JOIN b ON r.seen = b.u), c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT CAST(component AS BIGINT) AS component, count(*) AS n FROM c GROUP BY component ORDER BY n DESC, component LIMIT 3""")
def largest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("u"), (-1 - F.floor(F.col("o_custkey") / 7)).alias("v"))
    return graph.components(e).groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(3)


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_intercept(l_extendedprice, l_quantity) + regr_slope(l_extendedprice, l_quantity) * 60, 2) AS at_60 FROM lineitem GROUP BY l_returnflag""")
def regression_extrapolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    slope, cut = F.regr_slope("l_extendedprice", "l_quantity"), F.regr_intercept("l_extendedprice", "l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(slope, 4).alias("slope"), F.round(cut, 3).alias("intercept"), F.round(cut + slope * 60, 2).alias("at_60"))


@query("""WITH s AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS combo FROM orders GROUP BY o_custkey), d AS (SELECT combo, len(combo) * 10 AS cost FROM (SELECT DISTINCT combo FROM s))
SELECT o_custkey, list_aggregate(s.combo, 'string_agg', '|') AS combo, CAST(cost AS BIGINT) AS cost FROM s JOIN d ON s.combo = d.combo""")
def distinct_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("combo"))
    evaluated = s.select("combo").distinct().withColumn("cost", (F.size("combo") * 10).cast("long"))
    return s.join(evaluated, "combo").select("o_custkey", F.array_join("combo", "|").alias("combo"), "cost")


@query("""SELECT l_linestatus, CAST(median(l_extendedprice) AS DOUBLE) AS value FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_quantity >= 10 AND l_discount < 0.08 GROUP BY l_linestatus""")
def spec_filter_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    figure = tables.Figure("median price", (("l_returnflag", "in", ["A", "N"]), ("l_quantity", ">=", 10), ("l_discount", "<", 0.08)), "l_extendedprice", "median", ("l_linestatus",))
    return tables.evaluate(table(spark, sf_dir, "lineitem"), figure)


@query("""SELECT * FROM (SELECT 'rows' AS figure, CAST(count(*) AS DOUBLE) AS recomputed, 1.0::DOUBLE AS published, abs(count(*) - 1.0) <= 0.5 AS agrees FROM nation
 UNION ALL SELECT 'keys', round(sum(n_nationkey), 0)::DOUBLE, 300, abs(round(sum(n_nationkey), 0) - 300) <= 0 FROM nation UNION ALL SELECT 'second region', count(*)::DOUBLE, 5, count(*) = 5 FROM nation WHERE n_regionkey = 1)""")
def verified_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = [tables.Figure("rows", mode="count", published=1.0, tolerance=0.5), tables.Figure("keys", column="n_nationkey", published=300.0), tables.Figure("second region", (("n_regionkey", "==", 1),), mode="count", published=5.0)]
    return tables.verify(table(spark, sf_dir, "nation"), figures)


@query("""WITH s AS (SELECT o_orderkey, o_totalprice / 1000 AS g, CAST(o_custkey % 90 AS DOUBLE) AS a, CAST(o_orderkey % 200 AS DOUBLE) AS b FROM orders)
SELECT o_orderkey, round(a * CASE WHEN a + b > g THEN g / (a + b) ELSE 1 END, 6) AS a, round(b * CASE WHEN a + b > g THEN g / (a + b) ELSE 1 END, 6) AS b, round(greatest(g - a - b, 0), 6) AS rest FROM s""")
def gain_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("g"), (F.col("o_custkey") % 90).cast("double").alias("a"), (F.col("o_orderkey") % 200).cast("double").alias("b"))
    return tables.attribution(s, ["a", "b"], "g", "rest").select("o_orderkey", *[F.round(c, 6).alias(c) for c in ("a", "b", "rest")])

"""Queries on single rows: predicates, conversions, classes, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainage.functions import curves, scalar
from chainage.operators import tables
from chainage.plans.registry import TRACK, K, query, table, track
from chainage.sources import files
from chainage.sources.shared import shared_dir


@query("SELECT vec_id, label FROM embeddings WHERE embedding[1]::DOUBLE BETWEEN -0.1 AND 0.1 AND embedding[2]::DOUBLE BETWEEN -0.05 AND 0.2")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.get("embedding", F.lit(0)).cast("double").between(-0.1, 0.1) & F.get("embedding", F.lit(1)).cast("double").between(-0.05, 0.2)).select("vec_id", "label")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R') AND coalesce(l_linestatus, '') NOT IN ('O')")
def membership_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R") & ~F.coalesce("l_linestatus", F.lit("")).isin("O")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, least(greatest(value, 20), 300) AS clipped,
 TRY_CAST(event_type AS DOUBLE) AS not_a_number FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL""")
def safe_cast_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = scalar.safe_number(F.from_json("props", "k string")["k"])
    out = table(spark, sf_dir, "events").select("event_id", k.alias("k"), scalar.clamp(F.col("value"), 20.0, 300.0).alias("clipped"), scalar.safe_number(F.col("event_type")).alias("not_a_number"))
    return out.where("k is not null")


@query("""SELECT p_partkey, contains(p_name, 'red') AS has_red, starts_with(p_type, 'ECO') AS eco, upper(trim(p_name)) AS shout, ends_with(p_brand, '7') AS seven FROM part""")
def string_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.coalesce(F.contains("p_name", F.lit("red")), F.lit(False)).alias("has_red"), F.coalesce(F.startswith("p_type", F.lit("ECO")), F.lit(False)).alias("eco"), F.upper(F.trim("p_name")).alias("shout"), F.coalesce(F.endswith("p_brand", F.lit("7")), F.lit(False)).alias("seven")
    )


@query("""SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'to 10' WHEN p_size <= 25 THEN 'to 25' ELSE 'over 25' END AS band,
 CASE WHEN p_size >= 40 OR p_type = 'PROMO' OR contains(lower(p_name), 'widget') THEN 'rebuild' ELSE 'keep' END AS work FROM part""")
def rule_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rule = (size >= 40) | (F.col("p_type") == "PROMO") | F.contains(F.lower("p_name"), F.lit("widget"))
    return table(spark, sf_dir, "part").select("p_partkey", curves.banded(size, [10, 25], ["to 10", "to 25", "over 25"]).alias("band"), F.when(rule, "rebuild").otherwise("keep").alias("work"))


@query("""SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS segment, coalesce(c_acctbal, 0) AS balance FROM customer""")
def public_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumnsRenamed({"c_custkey": "customer_id", "c_name": "name", "c_mktsegment": "segment"}).select("customer_id", "name", "segment", F.coalesce("c_acctbal", F.lit(0.0)).alias("balance"))


@query("SELECT event_id, value FROM events WHERE value BETWEEN 50 AND 120 AND value < 100 - 1e-6")
def interval_and_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("value").between(50, 120) & (F.col("value") < 100 - 1e-6)).select("event_id", "value")


@query("""SELECT o_orderkey, round(o_totalprice / nullif(o_orderkey % 3, 0), 4) AS ratio, coalesce(round(o_totalprice / nullif(o_custkey % 2, 0), 4), 0) AS guarded FROM orders""")
def safe_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.round(scalar.safe_ratio(F.col("o_totalprice"), F.col("o_orderkey") % 3), 4).alias("ratio"), F.round(scalar.safe_ratio(F.col("o_totalprice"), F.col("o_custkey") % 2, 0.0), 4).alias("guarded"))


_CLASS_OF = "CASE WHEN {v} >= 300 THEN 'A' WHEN {v} >= 250 THEN 'B' WHEN {v} >= 200 THEN 'C' WHEN {v} >= 160 THEN 'D' WHEN {v} >= 100 THEN 'E' ELSE 'F' END"


@query(f"""WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, least({K}::DOUBLE * sqrt(l_quantity * 100), 360) AS v FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, {_CLASS_OF.format(v="v")} AS class FROM s""")
def speed_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = curves.vmax(F.col("l_quantity") * 100, K)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", curves.classify(v).alias("class"))


@query(f"""WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity * 100 AS r, l_quantity * 100 * (1 - 8 * l_discount) AS rmin FROM lineitem),
t AS (SELECT *, least({K}::DOUBLE * sqrt(r), 360) AS v FROM s),
u AS (SELECT *, CASE WHEN v >= 300 AND rmin >= 0.5 * (300 / {K}::DOUBLE) ** 2 THEN 'A' WHEN v >= 250 AND rmin >= 0.5 * (250 / {K}::DOUBLE) ** 2 THEN 'B'
 WHEN v >= 200 AND rmin >= 0.5 * (200 / {K}::DOUBLE) ** 2 THEN 'C' WHEN v >= 160 AND rmin >= 0.5 * (160 / {K}::DOUBLE) ** 2 THEN 'D' WHEN v >= 100 AND rmin >= 0.5 * (100 / {K}::DOUBLE) ** 2 THEN 'E' ELSE 'F' END AS code FROM t)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, code,
 round(CASE code WHEN 'A' THEN least(greatest(round(v, 1), 300), 360) WHEN 'B' THEN least(greatest(round(v, 1), 250), 299.9) WHEN 'C' THEN least(greatest(round(v, 1), 200), 249.9)
  WHEN 'D' THEN least(greatest(round(v, 1), 160), 199.9) WHEN 'E' THEN least(greatest(round(v, 1), 100), 159.9) ELSE least(greatest(round(v, 1), 0), 99.9) END, 1)::DOUBLE AS vmax FROM u""")
def published_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("l_quantity") * 100
    out = table(spark, sf_dir, "lineitem").withColumn("p", curves.published(r, r * (1 - 8 * F.col("l_discount")), K))
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "p.code", "p.vmax")


@query("""SELECT p_partkey, round(p_size / 1.609344, 6) AS mph, round(p_size * 1.609344, 6) AS kmh, round(p_size / 25.4, 6) AS inch, round(p_size * 25.4, 6) AS mm,
 round(p_retailprice / 1609.344, 6) AS miles, round(CASE WHEN p_size * 5 <= 15.24 THEN 180 ELSE 2 * degrees(asin(15.24::DOUBLE / (p_size * 5))) END, 6) AS degree FROM part""")
def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    cols = {"mph": scalar.kmh_to_mph(size), "kmh": scalar.mph_to_kmh(size), "inch": scalar.mm_to_inch(size), "mm": scalar.inch_to_mm(size), "miles": scalar.m_to_mile(F.col("p_retailprice")), "degree": scalar.degree_of_curve(size * 5)}
    return table(spark, sf_dir, "part").select("p_partkey", *[F.round(c, 6).alias(k) for k, c in cols.items()])


@query("""SELECT o_orderkey, translate(format('{:,.1f}', o_totalprice), ',.', ' ,') AS price, CAST(floor(round(o_totalprice / 1000) / 60) AS BIGINT) || ':' || lpad(CAST(CAST(round(o_totalprice / 1000) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS hm,
 o_orderstatus || '-' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS code FROM orders""")
def formatted_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", scalar.decimal_comma(F.col("o_totalprice"), 1).alias("price"), scalar.hour_minute(F.col("o_totalprice") / 1000).alias("hm"), F.format_string("%s-%06d", "o_orderstatus", "o_custkey").alias("code"))


def _published_sql(sets: tuple[curves.CantSet, ...]) -> str:
    """Class and published speed of the radius in column radius, as SQL columns of each cant set."""
    out = []
    for c in sets:
        v = f"least({c.coefficient!r}::DOUBLE * sqrt(radius), 360)"
        code = "CASE " + " ".join(f"WHEN {v} >= {k.low} THEN '{k.code}'" for k in curves.CLASSES[:-1]) + " ELSE 'F' END"
        tops = {k.code: 360.0 if k.high == float("inf") else k.high - 0.1 for k in curves.CLASSES}
        top = f"CASE {code} " + " ".join(f"WHEN '{k}' THEN {t}::DOUBLE" for k, t in tops.items()) + " END"
        out += [f"{code} AS class_{c.cant_set_id}", f"round(least(round({v}, 1), {top}), 1) AS vmax_{c.cant_set_id}"]
    return ", ".join(out)


_TILTING = (curves.CantSet("base", 100, 76), curves.CantSet("tilting", 127, 152))
_SHORT_M = (250.0 / _TILTING[1].coefficient) ** 2


@query(f"""WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity * 50 < 900 AND l_extendedprice / 10 < {_SHORT_M!r}::DOUBLE AS corrected, l_extendedprice / 10 AS r FROM lineitem),
t AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, corrected, CASE WHEN corrected THEN 0.5 * r ELSE r END AS radius FROM s)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, corrected, radius, {_published_sql(_TILTING)} FROM t""")
def short_curve_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radii of short curves corrected, then class and published speed of both cant sets anew."""
    li = table(spark, sf_dir, "lineitem")
    fixed = li.withColumn("s", curves.short_curve(F.col("l_quantity") * 50, F.col("l_extendedprice") / 10, _SHORT_M)).select("*", "s.*")
    r = F.col("radius")
    out = {}
    for c in _TILTING:
        p = curves.published(r, r, c.coefficient)
        out |= {f"class_{c.cant_set_id}": p["code"], f"vmax_{c.cant_set_id}": p["vmax"]}
    return fixed.withColumns(out).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "corrected", "radius", *out)


@query("""SELECT event_id, round(sqrt(value), 6) AS f_sqrt, round(sin(radians(value)), 6) AS f_sin, round(degrees(atan2(value, 100)), 6) AS f_atan, round(sqrt(value * value + 9), 6) AS f_hypot,
 CAST(sign(value - 100) AS DOUBLE) AS f_sign, CAST(floor(value) AS BIGINT) AS f_floor, CAST(trunc(value) AS BIGINT) AS f_trunc, CAST(((event_id - 500) % 7 + 7) % 7 AS BIGINT) AS f_pmod, round(atan2(sin(value), cos(value)), 6) AS f_wrap,
 round_even(value, 1) AS f_even, round(exp(value / 100), 6) AS f_exp, round(cbrt(value), 6) AS f_cbrt, len(string_split(event_type, 'c')) AS f_split, substr(event_type, 1, 3) AS f_left, replace(event_type, 'e', 'é') AS f_replace,
 round(2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0, sin(radians(0.1) / 2) ** 2 + cos(radians(45)) * cos(radians(45.1)) * sin(radians(value / 1000) / 2) ** 2))), 3) AS f_haversine,
 CAST(floor((value - 245 + 180) / 6) + 1 AS INTEGER) AS f_zone, round(((degrees(atan2(value - 200, 50)) + 360) % 360 + 360) % 360, 6) AS f_bearing FROM events""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(F.sqrt(v), 6).alias("f_sqrt"), F.round(F.sin(F.radians(v)), 6).alias("f_sin"), F.round(F.degrees(F.atan2(v, F.lit(100.0))), 6).alias("f_atan"), F.round(F.hypot(v, F.lit(3.0)), 6).alias("f_hypot"),
        F.signum(v - 100).alias("f_sign"), F.floor(v).alias("f_floor"), v.cast("long").alias("f_trunc"), F.pmod(F.col("event_id") - 500, F.lit(7)).cast("long").alias("f_pmod"), F.round(scalar.wrapped(v), 6).alias("f_wrap"),
        F.bround(v, 1).alias("f_even"), F.round(F.exp(v / 100), 6).alias("f_exp"), F.round(F.cbrt(v), 6).alias("f_cbrt"), F.size(F.split("event_type", "c")).cast("long").alias("f_split"), F.left("event_type", F.lit(3)).alias("f_left"), F.replace("event_type", F.lit("e"), F.lit("é")).alias("f_replace"),
        F.round(scalar.haversine_m(F.lit(45.0), F.lit(0.0), F.lit(45.1), v / 1000), 3).alias("f_haversine"), scalar.utm_zone(v - 245).alias("f_zone"), F.round(scalar.bearing_deg(v - 200, F.lit(50.0)), 6).alias("f_bearing"),
    )


@query("""SELECT event_type, len(list(DISTINCT k)) AS n_k, list_aggregate(list_sort(list(DISTINCT k))[1:3], 'string_agg', '-') AS joined, max(k) > 90 AS any_high
 FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type""")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    sets = table(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.array_sort(F.collect_set("k")).alias("s"))
    return sets.select("event_type", F.size("s").cast("long").alias("n_k"), F.array_join(F.slice("s", 1, 3).cast("array<string>"), "-").alias("joined"), F.exists("s", lambda x: x > 90).alias("any_high"))


@query("""SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS figure, regexp_matches(text, '@[a-z0-9]+\\.') AS has_mail, len(regexp_extract_all(text, '[0-9]+')) AS n_numbers FROM documents""")
def scrape_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", files.numbers_in(text, r"([0-9]+(?:\.[0-9]+)?)").alias("figure"), text.rlike(r"@[a-z0-9]+\.").alias("has_mail"), F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).cast("long").alias("n_numbers"))


@query("SELECT * FROM (VALUES ('n_nationkey', (SELECT count(*) FROM nation), 0::BIGINT, TRUE), ('n_name', (SELECT count(*) FROM nation), 0, FALSE), ('n_regionkey', (SELECT count(*) FROM nation), 0, TRUE)) t(\"column\", n_rows, n_empty, is_number)")
def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.inferred(table(spark, sf_dir, "nation"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def semicolon_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/semicolon-{abs(hash(sf_dir))}"
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    files.write_semicolon(own, path)
    return files.read_semicolon(spark, path, own.schema)


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def two_row_header_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers through files with names in one row and labels in the next."""
    path = f"{shared_dir(spark)}/labelled-{abs(hash(sf_dir))}"
    own, labels = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), ["client", "solde; net", "secteur"]
    files.write_labelled(own, path, labels)
    return files.read_labelled(spark, path, own.schema, labels)


@query(TRACK + "SELECT event_id, props, round(h, 6) AS lon, round(value, 4) AS lat FROM tr")
def feature_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section's day as a feature of collections with meta, read back in byte ranges and laid out as points again."""
    path = f"{shared_dir(spark)}/collections-{abs(hash(sf_dir))}"
    tr = track(spark, sf_dir).withColumn("p", F.struct(F.col("us"), F.col("event_id"), F.col("props"), F.struct(F.round("h", 6).alias("lon"), F.round("value", 4).alias("lat")).alias("at")))
    days = tr.groupBy("user_id", "day").agg(F.array_sort(F.collect_list("p")).alias("p"))
    days = days.select("user_id", "day", F.col("p.event_id").alias("ids"), F.col("p.props").alias("props"), F.col("p.at").alias("points"))
    files.write_collection(days, path, ["user_id", "day", "ids", "props"], {"about": "lines of events", "columns": {"ids": "{event_id}"}})
    back = files.read_features(spark, path, days.drop("points").schema)
    each = back.select(F.inline(F.arrays_zip("ids", "props", "points")))
    return each.select(F.col("ids").alias("event_id"), "props", "points.lon", "points.lat")


@query(TRACK + """, l AS (SELECT user_id, day, h AS ax, value AS ay, lead(h) OVER w AS bx, lead(value) OVER w AS yb, row_number() OVER w AS i FROM (SELECT *, us // 86400000000 AS day FROM tr) WINDOW w AS (PARTITION BY user_id, day ORDER BY us, event_id)),
d AS (SELECT *, sqrt((bx - ax) ** 2 + (yb - ay) ** 2) AS d FROM l WHERE bx IS NOT NULL), s AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY user_id, day ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0, 0.37 * sum(d) OVER (PARTITION BY user_id, day) AS q FROM d),
a AS (SELECT user_id, day, arg_max(ax + (q - s0) / d * (bx - ax), i) AS x, arg_max(ay + (q - s0) / d * (yb - ay), i) AS y FROM s WHERE d > 0 AND s0 < q GROUP BY ALL), n AS (SELECT user_id, day, sum(d) AS length FROM d GROUP BY ALL),
c AS (SELECT user_id, day, min(ax) AS cx FROM l GROUP BY ALL), t AS (SELECT d.*, cx, CASE WHEN d > 0 THEN greatest(least(((cx - ax) * (bx - ax) + (250 - ay) * (yb - ay)) / (d * d), 1), 0) ELSE 0 END AS t FROM d JOIN c USING (user_id, day)),
o AS (SELECT user_id, day, min(sqrt((cx - ax - t * (bx - ax)) ** 2 + (250 - ay - t * (yb - ay)) ** 2)) AS off FROM t GROUP BY ALL)
SELECT user_id, CAST(day AS BIGINT) AS day, round(length, 4) AS length, round(x, 4) AS x, round(y, 4) AS y, round(off, 4) AS off, off <= 60 AS near FROM n JOIN a USING (user_id, day) JOIN o USING (user_id, day)""")
def points_along_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section's day as a line: its length, the point at 0.37 of it, and how far a place is from it."""
    tr = track(spark, sf_dir).groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("us", "event_id", F.col("h").alias("x"), F.col("value").cast("double").alias("y")))).alias("p"))
    lines = tr.where(F.size("p") > 1).select("user_id", "day", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("line"))
    lines = lines.withColumn("length", scalar.line_length("line"))
    told = lines.where("length > 0").select("user_id", "day", "length", scalar.along_line("line", 0.37 * F.col("length")).alias("at"), scalar.place_on_line("line", F.get("line", F.lit(0))["x"], F.lit(250.0))["off"].alias("off"))
    return told.select("user_id", "day", F.round("length", 4).alias("length"), F.round("at.x", 4).alias("x"), F.round("at.y", 4).alias("y"), F.round("off", 4).alias("off"), (F.col("off") <= 60).alias("near"))


@query("""SELECT count(*) AS n_rows, round(sum(l_quantity), 2) AS quantity, count(DISTINCT l_suppkey) AS suppliers FROM lineitem""")
def facts_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = files.facts(table(spark, sf_dir, "lineitem"), {"n_rows": F.count("*"), "quantity": F.round(F.sum("l_quantity"), 2), "suppliers": F.count_distinct("l_suppkey")})
    return out.select(F.from_json("facts", "n_rows long, quantity double, suppliers long").alias("f")).select("f.*")


@query("SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 100")
def top_hundred_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = [F.col("o_orderpriority"), F.desc("o_totalprice"), F.col("o_orderkey")]
    top = table(spark, sf_dir, "orders").orderBy(*order).limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("o_orderkey", "o_custkey", "o_totalprice", F.col("place").cast("long").alias("place"))


@query("""SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal >= 1000 AND contains(lower(c_mktsegment), 'hous') ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 600""")
def table_explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return tables.filtered_table(own, (("c_acctbal", ">=", 1000), ("c_mktsegment", "contains", "HOUS")), "c_acctbal", descending=True)


@query("SELECT c_custkey AS key, 'customer' AS kind, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_acctbal FROM supplier")
def concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance")))


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("""SELECT n_nationkey AS nation, 'without supplier' AS side FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)
 UNION ALL SELECT DISTINCT s_nationkey, 'not registered' FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)""")
def registry_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("nation"))
    used = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("int").alias("nation")).distinct()
    return known.join(used, "nation", "left_anti").withColumn("side", F.lit("without supplier")).unionByName(used.join(known, "nation", "left_anti").withColumn("side", F.lit("not registered")))

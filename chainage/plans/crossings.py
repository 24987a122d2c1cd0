"""Crossings by speed band: white list, nearest segment of each section, scenarios, and a total in which each crossing counts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainage.functions import curves
from chainage.operators import spatial
from chainage.plans.registry import POINTS, points, query

#: Upper ends of the bands in km/h, and their names.
EDGES, BANDS = [153.0, 177.0, 201.0], ["to 153", "to 177", "to 201", "over 201"]
TOTAL = "all, once each"


def nearest_by_section(pairs: DataFrame, ident: str, section: str, dist: str, other: str, carried: list[str]) -> DataFrame:
    """(ident, section, dist, carried): each crossing's nearest segment in each section, ties to the smaller `other`.

    The nearest one is an aggregate, so pairs are reduced before they are shuffled.
    """
    best = pairs.groupBy(ident, section).agg(F.min(F.struct(dist, other, *carried)).alias("b"))
    return best.select(ident, section, f"b.{dist}", *[f"b.{c}" for c in carried])


def nearest_in_sections(points: DataFrame, others: DataFrame, ident: str, section: str, other: str, radius: float, apart: Column | None = None, cell_rows: int = 32) -> DataFrame:
    """(ident, section, dist and what others carry): as `nearest_by_section`, searched section by section from small radii on, so that dense places don't make all pairs."""
    named = others.withColumn("__of", F.coalesce(F.col(section), F.lit("")))
    each = points.crossJoin(F.broadcast(named.select("__of").distinct()))
    return spatial.k_nearest(each, named, radius, [ident, "__of"], [other], 1, apart, cell_rows=cell_rows, keys=["__of"]).drop("__of", "rank")


def counts(matched: DataFrame, ident: str, section: str, dist: str, scenarios: dict[str, Column], sections: list[str], edges: list[float] = EDGES, bands: list[str] = BANDS) -> DataFrame:
    """(scenario, section, band, n): crossings of each section by the band of each scenario's speed, zeros included.

    matched: one row per crossing and section. The section TOTAL counts each crossing once,
    with its nearest section (ties to the smaller name). A speed of null lies in no band.
    """
    spark = matched.sparkSession
    each = F.array(*[F.struct(F.lit(name).alias("scenario"), curves.banded(v, edges, bands).alias("band")) for name, v in scenarios.items()])
    placed = matched.select(ident, section, dist, each.alias("e"))
    once = placed.groupBy(ident).agg(F.min(F.struct(dist, section, "e")).alias("m")).select(F.lit(TOTAL).alias(section), F.col("m.e").alias("e"))
    n = placed.select(section, "e").unionByName(once).select(section, F.inline("e")).groupBy("scenario", section, "band").agg(F.count("*").alias("n"))
    domain = spark.createDataFrame([(a, s, b) for a in scenarios for s in [*sections, TOTAL] for b in bands], f"scenario string, {section} string, band string")
    return domain.join(n, ["scenario", section, "band"], "left").fillna(0, ["n"])


@query(POINTS + f""", d AS (SELECT a.id, 'section ' || (b.label % 3) AS section, 100 + b.label * 12 AS v, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist, b.id AS other FROM p a JOIN p b ON a.id <> b.id WHERE a.label NOT IN (4, 9)),
n AS (SELECT *, row_number() OVER (PARTITION BY id, section ORDER BY dist, other) AS k FROM d WHERE dist <= 0.05), m AS (SELECT * FROM n WHERE k = 1), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, section) AS i FROM m),
u AS (SELECT section, v FROM m UNION ALL SELECT '{TOTAL}', v FROM o WHERE i = 1),
s AS (SELECT section, unnest(['base', 'tilting', 'base, at most 160', 'tilting, at most 177']) AS scenario, unnest([v * 0.8::DOUBLE, v, least(v * 0.8::DOUBLE, 160), least(v, 177)]) AS w FROM u),
c AS (SELECT scenario, section, CASE WHEN w <= 153 THEN 'to 153' WHEN w <= 177 THEN 'to 177' WHEN w <= 201 THEN 'to 201' ELSE 'over 201' END AS band, count(*) AS n FROM s GROUP BY ALL),
g AS (SELECT * FROM (VALUES ('base'), ('tilting'), ('base, at most 160'), ('tilting, at most 177')) a(scenario), (VALUES ('section 0'), ('section 1'), ('section 2'), ('{TOTAL}')) b(section), (VALUES ('to 153'), ('to 177'), ('to 201'), ('over 201')) c(band))
SELECT scenario, section, band, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (scenario, section, band)""")
def crossings_by_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings of the white list by section and speed band under four scenarios, with a total that counts each once."""
    p = points(spark, sf_dir)
    asked = p.where(~F.col("label").isin(4, 9)).select("id", F.col("x").alias("px"), F.col("y").alias("py"))
    others = p.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.concat(F.lit("section "), F.col("label") % 3).alias("section"), (100.0 + F.col("label") * 12).alias("v"))
    near = nearest_in_sections(asked, others, "id", "section", "other", 0.05, F.col("id") != F.col("other"))
    v = F.col("v")
    speeds = {"base": v * 0.8, "tilting": v, "base, at most 160": F.least(v * 0.8, F.lit(160.0)), "tilting, at most 177": F.least(v, F.lit(177.0))}
    return counts(near, "id", "section", "dist", speeds, [f"section {k}" for k in range(3)])

"""Where queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainage.functions.curves import classify, vmax
from chainage.functions.scalar import micros

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: k of the tilting set (cant 127, deficiency 152 mm), in km/h per root metre.
K = 4.824


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as points on a line: section user_id, position h (hours since its first event), radius r, speed v, class."""
    ev = table(spark, sf_dir, "events").withColumn("us", micros(F.col("ts")))
    first = ev.groupBy("user_id").agg(F.min("us").alias("us0"))
    out = ev.join(first, "user_id").withColumn("h", (F.col("us") - F.col("us0")) / 3.6e9).withColumn("r", 10 * F.col("value") + 100)
    out = out.withColumn("v", vmax(F.col("r"), K)).withColumn("class", classify(F.col("v"))).withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    return out.select("event_id", "user_id", "event_type", "value", "props", "us", "day", "h", "r", "v", "class")


#: The same as `track`, as SQL text to start a query with.
TRACK = f"""WITH tr0 AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS us, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9 AS h, 10 * value + 100 AS r FROM events),
tr1 AS (SELECT *, least({K}::DOUBLE * sqrt(r), 360) AS v FROM tr0),
tr AS (SELECT *, CASE WHEN v >= 300 THEN 'A' WHEN v >= 250 THEN 'B' WHEN v >= 200 THEN 'C' WHEN v >= 160 THEN 'D' WHEN v >= 100 THEN 'E' ELSE 'F' END AS class FROM tr1)
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as points in the plane: id, x, y, section (label)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"), "label")


POINTS = "WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings)\n"

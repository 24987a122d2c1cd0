"""GeoJSON collections of any size: objects of a JSON document cut out in byte ranges, parts with a head and a tail written in parallel.

A document is read as text that ends at each closing brace, so Spark reads one file in
many ranges. Whether a brace lies inside a string, and how deep it is, follows from
running sums of quotes and braces: inside each range, and over one row per range.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainage.operators import linear
from chainage.sources.shared import ROWS_A_TASK, checkpoint, spread

_STRING = r'"(?:[^"\\]|\\.)*+"'
_OPEN_STRING = r'"(?:[^"\\]|\\.)*+(?:"|$)'
#: What precedes a brace: anything but braces, strings as a whole.
_LEAD = rf'(?:[^"{{]|{_STRING})*+'


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char)))


#: Pieces of a byte range, and characters of all pieces, that are worked on together.
PIECES, CHARACTERS = 4096, 16_000_000


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, at, piece): texts between closing braces; block is where the byte range begins and a part of it of at most PIECES pieces, at grows inside it."""
    cut = spark.read.option("lineSep", "}").text(path)
    at = F.monotonically_increasing_id()
    block = F.struct(F.col("_metadata.file_block_start").alias("start"), F.floor(F.col("at") / PIECES).alias("part"))
    return cut.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata"), at.alias("at"), F.col("value").alias("piece")).select("path", block.alias("block"), "at", "piece")


def members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, seq, text): each object that is a member of a document's outermost object, or lies in an array that is one.

    `seq` grows in the document. Objects may be formatted in any way and their strings may
    hold braces, quotes and brackets. Members that hold no objects, and documents without
    any, give no rows. A task sorts about CHARACTERS of text; a file may be of any size.
    """
    keys, order = ["path"], ["at"]
    cut = pieces(spark, path)
    size = cut.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("piece")), F.lit(0)).alias("text")).first()
    # as many rows as fill the partitions that the text or the pieces need
    n = max(size["n"], size["text"] * ROWS_A_TASK // CHARACTERS)
    rows = linear.running_sum(spread(cut, n, "path", "block"), keys, order, _count(F.regexp_replace("piece", r"(?s)\\.", ""), '"'), "__quotes", "block")
    own = _count(F.regexp_replace("piece", r"(?s)\\.", ""), '"')
    # a piece that begins inside a string is read from that string's end
    text = F.when((F.col("__quotes") - own) % 2 == 1, F.regexp_replace("piece", r'^(?s:[^"\\]|\\.)*+(?:"|$)', "")).otherwise(F.col("piece"))
    rows = rows.withColumns({"__text": text, "__open": F.lit(0)}).withColumn("__open", _count(F.regexp_replace("__text", f"(?s){_OPEN_STRING}", ""), "{"))
    rows = rows.withColumn("__close", (F.col("__quotes") % 2 == 0).cast("int"))
    rows = checkpoint(linear.running_sum(rows, keys, order, F.col("__open") - F.col("__close"), "__after", "block").drop("__quotes"))
    before = F.col("__after") - F.col("__open") + F.col("__close")
    begins = (before < 2) & (before + F.col("__open") >= 2)
    outer = rf"(?s)^{_LEAD}\{{({_LEAD})\{{"
    inner = rf"(?s)^({_LEAD})\{{"
    lead = F.when(before == 0, F.regexp_extract("__text", outer, 1)).otherwise(F.regexp_extract("__text", inner, 1))
    name = F.regexp_extract(lead, r'"((?:[^"\\]|\\.)*+)"\s*:\s*\[?\s*$', 1)
    rows = rows.withColumns({
        "__begins": begins,
        "__name": F.when(begins & (name != ""), F.struct("block", "at", name.alias("name"))),
        "__ends": ((F.col("__after") == 1) & (before + F.col("__open") == 2)).cast("long"),
        "__in": before >= 2,
        "__part": F.when(~begins, F.col("piece")).when(before == 0, F.regexp_replace("__text", outer, "{")).otherwise(F.regexp_replace("__text", inner, "{")),
    })
    rows = linear.running_max(spread(rows.drop("__text", "__open", "__close", "__after"), n, "path", "block"), keys, ["block", "at"], "__name", "__before", "block")
    rows = linear.running_sum(rows, keys, order, F.col("__ends"), "seq", "block").withColumn("seq", F.col("seq") - F.col("__ends"))
    kept = rows.where(F.col("__begins") | F.col("__in")).withColumn("__member", F.coalesce("__name", "__before"))
    part = F.struct("block", "at", F.col("__part").alias("part"))
    whole = spread(kept, n, "path", "seq").groupBy("path", "seq").agg(F.array_sort(F.collect_list(part)).alias("p"), F.max("__ends").alias("__ends"), F.min("__member").alias("m"))
    return whole.where("__ends = 1").select("path", F.col("m.name").alias("member"), "seq", F.concat(F.array_join("p.part", "}"), F.lit("}")).alias("text"))


def parsed_features(found: DataFrame, properties: T.StructType, kind: str | None = None) -> DataFrame:
    """Properties and `points` (array of lon and lat) of the features among members, those of one `kind` if given."""
    geometry = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
    feature = T.StructType([T.StructField("properties", properties), T.StructField("geometry", geometry)])
    rows = found.where("member = 'features'").select(F.from_json("text", feature).alias("f"))
    if kind is not None:
        rows = rows.where(F.col("f.properties.kind") == kind)
    text = F.col("f.geometry.coordinates")
    lines = F.from_json(F.when(F.col("f.geometry.type") == "Point", F.concat(F.lit("["), text, F.lit("]"))).otherwise(text), "array<array<double>>")
    points = F.transform(lines, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
    return rows.select("f.properties.*", points.alias("points"))


def meta(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """(path, meta): the member `meta` of each document that has one."""
    return members(spark, path).where("member = 'meta'").select("path", F.from_json("text", schema).alias("meta"))


def framed(lines: DataFrame, head: str, tail: str = "", between: str = "") -> DataFrame:
    """lines (column value) with a head before and a tail behind the lines of each partition, and `between` before all but the first."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        yield pd.DataFrame({"value": [head]})
        ahead = ""
        for frame in batches:
            if len(frame):
                texts = between + frame["value"]
                texts.iloc[0] = ahead + frame["value"].iloc[0]
                ahead = between
                yield pd.DataFrame({"value": texts})
        if tail:
            yield pd.DataFrame({"value": [tail]})

    return lines.select("value").mapInPandas(run, "value string")


def write_collection(features: DataFrame, path: str, about: dict) -> None:
    """A folder of GeoJSON collections, one for each partition of the features' texts (column value), each with `about` as its meta."""
    head = '{"type":"FeatureCollection","meta":' + json.dumps(about, ensure_ascii=False) + ',"features":['
    framed(features, head, "]}", ",").write.mode("overwrite").text(path)

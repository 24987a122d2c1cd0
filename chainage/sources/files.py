"""Semicolon CSV with a byte-order mark, zipped CSV, GeoJSON, figures in prose, facts."""

from __future__ import annotations

import csv
import io
import itertools
import zipfile
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainage.sources import collections
from chainage.sources.shared import opened

BOM = "﻿"


def read_semicolon(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A ';' CSV with a header; the reader drops a byte-order mark, empty cells are null."""
    return spark.read.option("sep", ";").option("header", True).option("nullValue", "").schema(schema).csv(path)


def write_semicolon(df: DataFrame, path: str) -> None:
    """A folder of ';' CSV files, each with a byte-order mark before its header (spreadsheets need one)."""
    first, *rest = df.columns
    df.withColumnRenamed(first, BOM + first).select(F.col(f"`{BOM}{first}`"), *rest).write.mode("overwrite").option("sep", ";").option("header", True).option("nullValue", "").csv(path)


def write_labelled(df: DataFrame, path: str, labels: list[str]) -> None:
    """A folder of ';' CSV files with two header rows: the columns' names (after a byte-order mark) and their labels in a second language."""
    if len(labels) != len(df.columns):
        raise ValueError("a label is needed for each column")
    line = lambda cells: ";".join('"' + c.replace('"', '""') + '"' if set(c) & set(';"\n') else c for c in cells)
    names = [f"c{i}" for i in range(len(df.columns))]
    text = F.to_csv(F.struct(*names), {"sep": ";", "nullValue": "", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    collections.framed(df.toDF(*names).select(text.alias("value")), BOM + line(df.columns) + "\n" + line(labels)).write.mode("overwrite").text(path)


def read_labelled(spark: SparkSession, path: str, schema: T.StructType, labels: list[str]) -> DataFrame:
    """Rows of files with two header rows, without the second; only a row that equals all labels is one."""
    texts = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(labels))])
    rows = spark.read.option("sep", ";").option("header", True).option("nullValue", "").option("escape", '"').option("enforceSchema", True).schema(texts).csv(path)
    is_label = reduce(lambda a, b: a & b, (F.col(f"c{i}").eqNullSafe(F.lit(x or None)) for i, x in enumerate(labels)))
    return rows.where(~is_label).select(*[F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])


def without_label_row(df: DataFrame, column: str, label: str) -> DataFrame:
    """Drops the second header row of a file with names in two languages."""
    return df.where(F.col(column).isNull() | (F.col(column) != label))


def clean_names(df: DataFrame) -> DataFrame:
    """Column names with single blanks inside and none around."""
    return df.withColumnsRenamed({c: " ".join(c.split()) for c in df.columns})


def read_zipped_csv(spark: SparkSession, path: str, name: str, columns: list[str]) -> DataFrame:
    """The named columns (strings) of a CSV file inside ZIP archives, streamed out of them; one archive is one task.

    Missing columns are null, archives without the file give no rows. Only an archive's
    directory and a part of the file are in memory, so archives may be of any size.
    Archives are opened through pyarrow's file systems.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for frame in batches:
            for uri in frame["path"]:
                with opened(uri) as archive, zipfile.ZipFile(archive) as z:
                    if name not in z.namelist():
                        continue
                    with io.TextIOWrapper(z.open(name), "utf-8-sig", newline="") as f:
                        rows = ([row.get(c) for c in columns] for row in csv.DictReader(f))
                        while part := list(itertools.islice(rows, 20_000)):
                            yield pd.DataFrame(part, columns=columns, dtype=object)

    # only paths are read here, not the archives' contents; they are spread by the archives' sizes
    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(run, schema)


POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])


def read_features(spark: SparkSession, path: str, properties: T.StructType, kind: str | None = None) -> DataFrame:
    """Features of GeoJSON collections: their properties and `points` (array of lon and lat), those of one `kind` if given.

    One file is read in many byte ranges, so a collection may be of any size.
    """
    return collections.parsed_features(collections.members(spark, path), properties, kind)


def feature_json(properties: list[str], points: str) -> Column:
    """A GeoJSON feature of a row: a Point for one position, else a LineString."""
    coordinates = F.transform(points, lambda p: F.array(p["lon"], p["lat"]))
    geometry = F.when(F.size(points) == 1, F.to_json(F.struct(F.lit("Point").alias("type"), F.get(coordinates, F.lit(0)).alias("coordinates")))).otherwise(F.to_json(F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates"))))
    return F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*properties)), F.lit(',"geometry":'), geometry, F.lit("}"))


def write_features(df: DataFrame, path: str, properties: list[str], points: str = "points") -> None:
    """One JSON feature per line, in parallel: line-delimited GeoJSON holds collections of any size."""
    df.select(feature_json(properties, points).alias("value")).write.mode("overwrite").text(path)


def write_collection(df: DataFrame, path: str, properties: list[str], about: dict, points: str = "points") -> None:
    """A folder of GeoJSON collections with meta, one for each partition."""
    collections.write_collection(df.select(feature_json(properties, points).alias("value")), path, about)


def numbers_in(text: Column, pattern: str, group: int = 1) -> Column:
    """First figure that the pattern finds in prose, with a decimal comma and blanks between thousands allowed."""
    raw = F.regexp_extract(text, pattern, group)
    return F.regexp_replace(F.regexp_replace(raw, r"[\x20\x{a0}\x{202f}]", ""), ",", ".").try_cast("double")


def facts(df: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """One row: the aggregates as a JSON object."""
    return df.agg(F.to_json(F.struct(*[c.alias(k) for k, c in aggregates.items()])).alias("facts"))


def inferred(df: DataFrame) -> DataFrame:
    """One row per column: its rows, how many are empty, and whether all others are numbers."""
    cell = F.posexplode(F.array(*[F.col(c).cast("string") for c in df.columns])).alias("i", "v")
    names = F.array(*[F.lit(c) for c in df.columns])
    held = F.col("v").isNotNull() & (F.trim("v") != "")
    return df.select(cell).groupBy("i").agg(F.count("*").alias("n_rows"), F.count(F.when(~held, 1)).alias("n_empty"), F.count(F.when(held & F.col("v").try_cast("double").isNull(), 1)).alias("n_text")).select(F.get(names, F.col("i")).alias("column"), "n_rows", "n_empty", (F.col("n_text") == 0).alias("is_number"))

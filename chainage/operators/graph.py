"""Track graphs as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainage.functions.scalar import haversine_m
from chainage.sources.shared import checkpoint


def junctions(ways: DataFrame, refs: str = "node_refs", least: int = 2) -> DataFrame:
    """(node, degree) of nodes that at least `least` places of ways use; a way's ends count like any place."""
    return ways.select(F.explode(refs).alias("node")).groupBy("node").agg(F.count("*").alias("degree")).where(F.col("degree") >= least)


def split_at_junctions(ways: DataFrame, ident: str = "way_id", refs: str = "node_refs", coords: str = "coords") -> DataFrame:
    """Edges (way, k, u, v, length_m) between consecutive junctions of each way; coords are (lat, lon) structs.

    A way's first and last node always cut it.
    """
    place = Window.partitionBy(ident).orderBy("i")
    at = ways.select(ident, F.posexplode(F.arrays_zip(F.col(refs).alias("node"), F.col(coords).alias("c"))).alias("i", "z")).select(ident, "i", "z.node", "z.c.lat", "z.c.lon")
    marked = at.join(junctions(ways, refs), "node", "left").withColumn("last", F.lead("i").over(place).isNull())
    marked = marked.withColumn("cut", F.col("degree").isNotNull() | (F.col("i") == 0) | F.col("last"))
    step = haversine_m(F.lag("lat").over(place), F.lag("lon").over(place), F.col("lat"), F.col("lon"))
    # a cut node ends one edge and starts the next: the edge of a step is the number of cuts before its end
    steps = marked.withColumn("step", step).withColumn("k", F.sum(F.col("cut").cast("int")).over(place.rowsBetween(Window.unboundedPreceding, -1)))
    steps = steps.withColumn("before", F.lag("node").over(place)).where("step is not null")
    return steps.groupBy(ident, "k").agg(F.min_by("before", "i").alias("u"), F.max_by("node", "i").alias("v"), F.sum("step").alias("length_m"))


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over edges (a, b) of whole numbers: (least, edges). least (a, m) joins each node, by its new number xxhash64(a), to its smallest neighbour or itself; the edges that are left lie between the nodes so joined.

    xxhash64 of one long is a permutation, so each round has its own order of nodes: on a
    path half of them are left, about, and far fewer where nodes have many neighbours.
    """
    new = edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    least = new.union(new.select("b", "a")).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    least = checkpoint(least)
    moved = new.join(least, "a").select("b", F.col("m").alias("x")).join(least.withColumnsRenamed({"a": "b", "m": "y"}), "b")
    left = moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return least, checkpoint(left)


def components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes of edges; component is the smallest node reachable.

    Each round joins nodes to a neighbour and goes on with the edges between the joined
    ones, so edges inside what is one already are read no more. Rounds are checkpointed:
    the plan doesn't grow and a lost executor costs one round.
    """
    known = checkpoint(edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a is not null and b is not null").distinct())
    nodes = known.select(F.col("a").alias("node")).union(known.select("b")).distinct()
    if isinstance(nodes.schema["node"].dataType, T.IntegralType):
        now = known.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
        labels = checkpoint(nodes.withColumn("label", F.col("node").cast("long")))
    else:
        labels = checkpoint(nodes.withColumn("label", F.monotonically_increasing_id()))
        numbers = labels.withColumnRenamed("node", "a")
        now = known.join(numbers, "a").select("b", F.col("label").alias("x")).join(numbers.withColumnsRenamed({"a": "b", "label": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    now = now.where("a <> b")
    for _ in range(max_rounds):
        least, now = contracted(now)
        own = labels.withColumn("a", F.xxhash64("label")).join(least, "a", "left")
        labels = checkpoint(own.select("node", F.coalesce("m", "a").alias("label")))
        if now.isEmpty():
            smallest = labels.groupBy("label").agg(F.min("node").alias("component"))
            return labels.join(smallest, "label").select("node", "component")
    raise RuntimeError("components did not settle")


def incident(edges: DataFrame, arrivals: DataFrame) -> DataFrame:
    """arrivals (edge, node) with the other edges at that node and the direction (+1, -1) in which each leaves it."""
    ends = edges.select(F.col("edge").alias("next_edge"), F.col("u").alias("node"), F.lit(1).alias("direction")).unionByName(edges.select(F.col("edge").alias("next_edge"), F.col("v").alias("node"), F.lit(-1).alias("direction")))
    return arrivals.join(ends, "node").where("next_edge <> edge")

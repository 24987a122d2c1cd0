"""Parallel tracks: which ways run beside each point of a line, how many there are, and where a line would have to be doubled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainage.functions.scalar import angle_folded, bearing_deg
from chainage.operators import linear
from chainage.operators.spatial import near_segments


def heading_within(points: DataFrame, keys: list[str], at: str, x: str, y: str, reach: float, out: str = "heading", width: float | None = None) -> DataFrame:
    """points with the bearing from the first point that lies at most `reach` before each to the first that lies at least `reach` after it (the section's last, near its end); null for a point alone."""
    marks = points.select(*keys, F.col(at).alias("__p"), F.struct(F.col(at).alias("p"), F.col(x).alias("x"), F.col(y).alias("y")).alias("__xy"))
    last = marks.groupBy(*keys).agg(F.max_by("__xy", "__p").alias("__last"))
    names = points.columns
    ahead = linear.asof(points.withColumn("__p", F.col(at) + reach), marks, keys, "__p", ["__xy"], "forward", width).withColumnRenamed("__xy", "__b").drop("mark_at")
    both = linear.asof(ahead.withColumn("__p", F.col(at) - reach), marks, keys, "__p", ["__xy"], "forward", width).withColumnRenamed("__xy", "__a").drop("mark_at").join(last, keys)
    a, b = F.col("__a"), F.coalesce("__b", "__last")
    return both.select(*names, F.when(a["p"] < b["p"], bearing_deg(b["x"] - a["x"], b["y"] - a["y"])).alias(out))


def near_ways(points: DataFrame, segments: DataFrame, ident: list[str], reach: float = 30.0, align: float = 25.0, cell: float | None = None) -> DataFrame:
    """(ident, way, dist, edge): the ways within reach of each point whose nearest edge runs in the point's direction there.

    points: (ident, px, py, heading); segments: (way, edge, seq, ax, ay, bx, by). The nearest
    place of each edge counts, then the nearest such edge of each way; both are combined
    before the shuffle, so a point sends one row for each edge at most. Points without a
    heading meet no way.
    """
    met = near_segments(points.where("heading is not null"), segments, reach, cell)
    foot = F.struct("dist", "seq", angle_folded(bearing_deg(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")), F.col("heading")).alias("off"))
    nearest = met.groupBy(*ident, "way", "edge").agg(F.min(foot).alias("f")).where(F.col("f.off") <= align)
    best = nearest.groupBy(*ident, "way").agg(F.min(F.struct("f.dist", "edge")).alias("b"))
    return best.select(*ident, "way", "b.dist", "b.edge")


def track_counts(points: DataFrame, ways: DataFrame, ident: list[str], sister: float = 7.0) -> DataFrame:
    """points with n_geom (ways at most `sister` further than the nearest), n_wide (all ways), d0 (distance of the nearest), d_sister (how much further the second is) and way (the nearest; ties to the smaller edge).

    Points without a way have 0, 0 and nulls.
    """
    best = F.array_sort(F.collect_list(F.struct("dist", "edge", "way")))
    held = ways.groupBy(*ident).agg(best.alias("__w"))
    first, second = F.get("__w", F.lit(0)), F.get("__w", F.lit(1))
    close = F.size(F.filter("__w", lambda w: w["dist"] - F.get(F.col("__w"), F.lit(0))["dist"] <= sister))
    found = held.select(*ident, close.alias("n_geom"), F.size("__w").alias("n_wide"), first["dist"].alias("d0"), (second["dist"] - first["dist"]).alias("d_sister"), first["way"].alias("way"))
    return points.join(found, ident, "left").fillna(0, ["n_geom", "n_wide"])


def between_stations(runs: DataFrame, stations: DataFrame, keys: list[str], at: str, name: str, width: float | None = None) -> DataFrame:
    """runs (lo, hi) with the last station at or before their start (upstream) and the first at or after their end (downstream); a section's first and last stations stand in beyond them."""
    ends = stations.groupBy(*keys).agg(F.min_by(name, at).alias("__first"), F.max_by(name, at).alias("__final"))
    marks = stations.select(*keys, F.col(at).alias("__p"), F.col(name).alias("__s"))
    up = linear.asof(runs.withColumn("__p", F.col("lo")), marks, keys, "__p", ["__s"], "backward", width).withColumnRenamed("__s", "upstream").drop("mark_at")
    both = linear.asof(up.withColumn("__p", F.col("hi")), marks, keys, "__p", ["__s"], "forward", width).withColumnRenamed("__s", "downstream").drop("mark_at", "__p")
    filled = both.join(ends, keys, "left")
    return filled.withColumns({"upstream": F.coalesce("upstream", "__first"), "downstream": F.coalesce("downstream", "__final")}).drop("__first", "__final")


def doubling_need(runs: DataFrame, keys: list[str], branch: str = "branch") -> DataFrame:
    """(keys, length, single, double_track, more, to_double, on_branches, at_stations, loops, runs_to_double, longest): lengths of state runs by what doubling them would mean.

    runs: (lo, hi, state, usage, at_station, loop). Single track on the main line away from
    stations is what has to be doubled.
    """
    size = F.col("hi") - F.col("lo")
    single = F.col("state") == 1
    kind = F.when(~single, None).when(F.col("at_station"), "station").when(F.coalesce(F.col("usage") == branch, F.lit(False)), "branch").otherwise("main")
    of = lambda cond: F.coalesce(F.sum(F.when(cond, size)), F.lit(0.0))
    return runs.withColumn("__k", kind).groupBy(*keys).agg(
        F.sum(size).alias("length"), of(single).alias("single"), of(F.col("state") == 2).alias("double_track"), of(F.col("state") >= 3).alias("more"),
        of(F.col("__k") == "main").alias("to_double"), of(F.col("__k") == "branch").alias("on_branches"), of(F.col("__k") == "station").alias("at_stations"), of(F.col("loop")).alias("loops"),
        F.count(F.when(F.col("__k") == "main", 1)).alias("runs_to_double"), F.max(F.when(F.col("__k") == "main", size)).alias("longest"),
    )

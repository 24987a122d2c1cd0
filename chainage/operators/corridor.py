"""From feeds to a corridor: the shape that stands for a route, its direction, stations along it, native vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainage.operators.intervals import points_in
from chainage.operators.spatial import nearest_vertex


def representative_shapes(shape_points: DataFrame, trips: DataFrame, route: str = "route_id", shape: str = "shape_id") -> DataFrame:
    """(route, shape, n): of each route's shapes that with most points, ties to the smaller id."""
    n = shape_points.groupBy(shape).agg(F.count("*").alias("n"))
    used = trips.select(route, shape).distinct().join(n, shape)
    return used.groupBy(route).agg(F.min_by(F.struct(shape, "n"), F.struct(-F.col("n"), shape)).alias("s")).select(route, f"s.{shape}", "s.n")


def oriented(points: DataFrame, key: str, order: str, starts: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Points numbered (i from 0) so that each line's first lies nearer to its start (key, sx, sy) than its last."""
    ends = points.groupBy(key).agg(F.min_by(F.struct(x, y), order).alias("a"), F.max_by(F.struct(x, y), order).alias("b")).join(starts, key)
    flip = F.hypot(F.col("a")[x] - F.col("sx"), F.col("a")[y] - F.col("sy")) > F.hypot(F.col("b")[x] - F.col("sx"), F.col("b")[y] - F.col("sy"))
    turned = points.join(ends.select(key, flip.alias("__flip")), key).withColumn("__o", F.when(F.col("__flip"), -F.col(order)).otherwise(F.col(order)))
    return turned.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("__o")) - 1).drop("__o", "__flip")


def stations_along(stations: DataFrame, vertices: DataFrame, most: float, station: str = "station", vertex: str = "vertex") -> DataFrame:
    """(station, vertex, dist): the nearest vertex of each station within `most`."""
    return nearest_vertex(stations, vertices, [station], vertex, most)


def native_vertices(match_runs: DataFrame, vertices: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Vertices (keys = edge, offset, vertex) that match runs (section, run, keys, direction, lo, hi) pass over, in order of travel (seq)."""
    met = points_in(vertices, match_runs, keys, "offset", width, closed=True)
    w = Window.partitionBy("section", "run").orderBy(F.col("offset") * F.col("direction"), "vertex")
    return met.withColumn("seq", F.row_number().over(w)).select("section", "run", "seq", "vertex")


#: Share of the greatest curvature that a body reaches at both ends, and the points that it has at least.
BODY_SHARE, BODY_POINTS = 0.7, 5
#: Radius beyond which a circle is a line, as in the fits along a line (`linear.radius_of`).
STRAIGHT = 1e7


def bodies(df: DataFrame, keys: list[str], order: str, x: str, y: str, radius: str, share: float = BODY_SHARE, least: int = BODY_POINTS) -> DataFrame:
    """(keys, lo, hi, n_body, r_min, fitted): of each curve the rows from the first to the last whose curvature reaches `share` of its greatest, their least radius and the circle (Kasa) through all of them.

    order is the rows' place in the curve; curvature is 1 over the radius, 1 at most. fitted
    is null for bodies of fewer than `least` rows and infinite for lines and radii beyond STRAIGHT. The sums are
    aggregates about the rows' centre, so no curve is held in memory.
    """
    bend = 1 / F.greatest(F.col(radius), F.lit(1.0))
    sharpest = df.groupBy(*keys).agg(F.max(bend).alias("__k"))
    ends = df.join(sharpest, keys).where(bend >= share * F.col("__k")).groupBy(*keys).agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    body = df.join(ends, keys).where(F.col(order).between(F.col("lo"), F.col("hi")))
    centre = body.groupBy(*keys).agg(F.avg(x).alias("__cx"), F.avg(y).alias("__cy"))
    at = body.join(centre, keys).withColumns({"__x": F.col(x) - F.col("__cx"), "__y": F.col(y) - F.col("__cy")})
    at = at.withColumn("__z", F.col("__x") * F.col("__x") + F.col("__y") * F.col("__y"))
    product = lambda a, b: F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}")
    sums = at.groupBy(*keys, "lo", "hi").agg(
        F.count("*").alias("n_body"), F.min(radius).alias("r_min"), F.avg("__z").alias("mz"), product("__x", "__x"), product("__x", "__y"), product("__y", "__y"), product("__x", "__z"), product("__y", "__z")
    )
    xx, xy, yy, xz, yz = (F.col(f"__{a}__{b}") for a, b in ("xx", "xy", "yy", "xz", "yz"))
    det = xx * yy - xy * xy
    p, q = F.try_divide(xz * yy - yz * xy, 2 * det), F.try_divide(yz * xx - xz * xy, 2 * det)
    flat = det <= 1e-12 * F.greatest(xx * yy, F.lit(1e-300))
    r = F.sqrt(F.col("mz") + p * p + q * q)
    fitted = F.when(F.col("n_body") < least, None).when(flat | (r > STRAIGHT), F.lit(float("inf"))).otherwise(r)
    return sums.select(*keys, "lo", "hi", "n_body", "r_min", fitted.alias("fitted"))


#: Bands of length (metres) in which the bias of short curves is told.
BANDS = (0.0, 300.0, 450.0, 600.0, 900.0)


def bias(curves: DataFrame, published: str, body: str) -> DataFrame:
    """curves with factor: the published radius over that of the body; null where either isn't that of a curve."""
    told = F.col(body).isNotNull() & (F.col(body) > 0) & (F.col(body) < float("inf")) & (F.col(published) > 0)
    return curves.withColumn("factor", F.when(told, F.col(published) / F.col(body)))


def bias_by_length(curves: DataFrame, length: str, factor: str = "factor", bands: tuple[float, ...] = BANDS) -> DataFrame:
    """(band, n, km, median, q75, q90): how much wider than their bodies curves are read, by band of length; band is its lower end. Curves without a factor don't count."""
    band = F.array_max(F.filter(F.array(*map(F.lit, bands)), lambda b: b <= F.col(length)))
    at = lambda q: F.percentile(factor, F.lit(q))
    told = curves.where(F.col(factor).isNotNull() & (F.col(length) >= bands[0])).withColumn("band", band)
    return told.groupBy("band").agg(F.count("*").alias("n"), (F.sum(length) / 1000).alias("km"), at(0.5).alias("median"), at(0.75).alias("q75"), at(0.9).alias("q90"))

"""Nearest, k-nearest and radius joins in the plane by grid cells.

With cells as wide as the radius, all partners of a point within it lie in its cell and
the eight around it: one side is emitted to nine cells and joined on the cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainage.sources.shared import checkpoint


def within(points: DataFrame, others: DataFrame, radius: float, keys: list[str] | None = None, p: tuple[str, str] = ("px", "py"), o: tuple[str, str] = ("ox", "oy"), how: str = "inner") -> DataFrame:
    """Pairs at most radius apart, with dist; as a left_semi join the points that have one, once for each cell."""
    keys = keys or []
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = points.withColumn("__d", near).withColumn("__i", cell(p[0]) + F.col("__d.i")).withColumn("__j", cell(p[1]) + F.col("__d.j")).drop("__d")
    right = others.withColumn("__i", cell(o[0])).withColumn("__j", cell(o[1]))
    dist = F.hypot(F.col(p[0]) - F.col(o[0]), F.col(p[1]) - F.col(o[1]))
    if how == "left_semi":
        named = right.select(*[F.col(c).alias(f"__r_{c}") for c in (*keys, "__i", "__j", *o)])
        met = [F.col(c) == F.col(f"__r_{c}") for c in (*keys, "__i", "__j")]
        near = F.hypot(F.col(p[0]) - F.col(f"__r_{o[0]}"), F.col(p[1]) - F.col(f"__r_{o[1]}")) <= radius
        return left.join(named, reduce(lambda a, b: a & b, [*met, near]), "left_semi").drop("__i", "__j")
    return left.join(right, [*keys, "__i", "__j"]).drop("__i", "__j").withColumn("dist", dist).where(F.col("dist") <= radius)


def ranked(pairs: DataFrame, ident: list[str], other_ident: list[str], k: int = 1) -> DataFrame:
    """The k nearest partners of each point, ranked; ties go to the smaller other_ident."""
    w = Window.partitionBy(*ident).orderBy("dist", *other_ident)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_within(points: DataFrame, others: DataFrame, radius: float, ident: list[str], other_ident: list[str], k: int = 1, **how) -> DataFrame:
    """The k nearest others of each point within radius, ranked."""
    return ranked(within(points, others, radius, **how), ident, other_ident, k)


#: Others that a cell holds, about, before smaller cells are tried first; and how often cells are halved at most.
CELL_ROWS, HALVINGS = 256, 16


def k_nearest(points: DataFrame, others: DataFrame, radius: float, ident: list[str], other_ident: list[str], k: int = 1, apart: Column | None = None, p: tuple[str, str] = ("px", "py"), o: tuple[str, str] = ("ox", "oy"), cell_rows: int = CELL_ROWS, keys: list[str] | None = None) -> DataFrame:
    """The k nearest others of each point within radius, ranked, where some places are much denser than others.

    The densest cell tells from which radius to start. A point that finds k others within a
    radius has its nearest; only those that don't go on to the doubled one, up to `radius`.
    So a dense cell never pairs all of its rows. Of others at one place only the k + 1
    smallest can be among the nearest. apart: a condition that pairs have to fulfil; it may
    leave out one other at each place (the point itself). keys: columns of both sides that
    pairs have in common; a point of several keys has them in its ident.
    """
    (ox, oy), keys = o, keys or []
    few = Window.partitionBy(*keys, *o).orderBy(*other_ident)
    kept = checkpoint(others.where(F.col(ox).isNotNull() & F.col(oy).isNotNull()).withColumn("__k", F.row_number().over(few)).where(F.col("__k") <= k + 1).drop("__k"))
    dense = lambda r: kept.groupBy(*keys, F.floor(F.col(ox) / r), F.floor(F.col(oy) / r)).count().agg(F.max("count")).first()[0] or 0
    halvings = 0
    while halvings < HALVINGS and dense(radius / 2**halvings) > cell_rows:
        halvings += 1
    left, done = points, []
    for level in range(halvings, -1, -1):
        met = within(left, kept, radius / 2**level, keys, p=p, o=o)
        found = ranked(met if apart is None else met.where(apart), ident, other_ident, k)
        if level == 0:
            done.append(found)
            break
        found = checkpoint(found)
        full = found.where(F.col("rank") == k).select(*ident)
        done.append(found.join(full, ident, "left_semi"))
        left = checkpoint(left.join(full, ident, "left_anti"))
    return reduce(DataFrame.unionByName, done)


def aligned_or_nearest(ranked: DataFrame, ident: list[str], choice: str, off: Column, most: float) -> DataFrame:
    """Of ranked candidates the first whose angle off is small enough, else the nearest."""
    fit = F.min_by(choice, F.when(off <= most, F.col("rank")))
    return ranked.groupBy(*ident).agg(F.coalesce(fit, F.min_by(choice, "rank")).alias(choice))


def flagged(points: DataFrame, pairs: DataFrame, ident: list[str]) -> DataFrame:
    """points with `near`: whether they have a partner among the pairs."""
    found = pairs.select(*ident).distinct().withColumn("near", F.lit(True))
    return points.join(found, ident, "left").withColumn("near", F.coalesce("near", F.lit(False)))


def exists_within(points: DataFrame, others: DataFrame, radius: float, ident: list[str], **how) -> DataFrame:
    """points with `near`: whether another lies within radius. A semi-join: the first other that is met settles a point, so no pairs are made."""
    return flagged(points, within(points, others, radius, how="left_semi", **how), ident)


def count_close_to_best(pairs: DataFrame, ident: list[str], group: str, margin: float, out: str) -> DataFrame:
    """Groups (tracks) of each point whose least distance is within margin of the point's best."""
    least = pairs.groupBy(*ident, group).agg(F.min("dist").alias("d"))
    best = F.min("d").over(Window.partitionBy(*ident))
    return least.withColumn("__b", best).groupBy(*ident).agg(F.count(F.when(F.col("d") <= F.col("__b") + margin, 1)).alias(out))


def nearest_vertex(points: DataFrame, vertices: DataFrame, ident: list[str], vertex_ident: str, most: float, p: tuple[str, str] = ("px", "py"), o: tuple[str, str] = ("ox", "oy")) -> DataFrame:
    """Nearest vertex of each point within `most`, ties to the smaller vertex; points without one drop."""
    met = within(points, vertices, most, p=p, o=o)
    best = F.min_by(F.struct(F.col(vertex_ident), F.col("dist")), F.struct("dist", vertex_ident)).alias("b")
    return met.groupBy(*ident).agg(best).select(*ident, f"b.{vertex_ident}", "b.dist")


def project(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """Share along the edge a-b of the point's foot, clamped to the edge, and its distance."""
    dx, dy = bx - ax, by - ay
    share = F.coalesce(F.try_divide((x - ax) * dx + (y - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    share = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    # from a's side, so that no digits go where coordinates are large
    return share, F.hypot(x - ax - share * dx, y - ay - share * dy)


def near_segments(
    points: DataFrame,
    segments: DataFrame,
    radius: float,
    cell: float | None = None,
    p: tuple[str, str] = ("px", "py"),
    a: tuple[str, str] = ("ax", "ay"),
    b: tuple[str, str] = ("bx", "by"),
) -> DataFrame:
    """Pairs of points and straight segments a-b at most radius apart, with share (of the foot) and dist.

    A segment goes to the cells within the radius of it, and a point to one cell, so a pair
    meets once. cell: about the length of the longer segments, the radius at least.
    """
    size = max(cell or radius, radius)
    share, dist = project(*[F.col(c) for c in (*p, *a, *b)])
    placed = points.withColumns({n: F.floor(F.col(c) / size).cast("long") for n, c in zip(("__i", "__j"), p, strict=True)})
    met = placed.join(_spread(segments, radius, size, a, b), ["__i", "__j"]).drop("__i", "__j")
    return met.withColumns({"share": share, "dist": dist}).where(F.col("dist") <= radius)


def _spread(segments: DataFrame, radius: float, size: float, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """segments once for each cell (__i, __j) of this size that has a place within the radius of them: cells of the widened box whose centre lies near the line."""
    def reach(one: str, other: str) -> Column:
        low = F.floor((F.least(one, other) - radius) / size).cast("long")
        return F.sequence(low, F.floor((F.greatest(one, other) + radius) / size).cast("long"))

    known = segments.where(" and ".join(f"{c} is not null" for c in (*a, *b)))
    spread = known.withColumn("__i", F.explode(reach(a[0], b[0]))).withColumn("__j", F.explode(reach(a[1], b[1])))
    off = project((F.col("__i") + 0.5) * size, (F.col("__j") + 0.5) * size, *[F.col(c) for c in (*a, *b)])[1]
    return spread.where(off <= radius + 0.7072 * size)


#: Segments within the starting radius of a point, about, at most; how often cells are halved at most, so that a segment goes to a few dozen.
NEAR_SEGMENTS, CELL_HALVINGS = 32, 3


def nearest_segments(
    points: DataFrame,
    segments: DataFrame,
    radius: float,
    ident: list[str],
    other: str,
    cell: float,
    digits: int = 9,
    apart: Column | None = None,
    p: tuple[str, str] = ("px", "py"),
    a: tuple[str, str] = ("ax", "ay"),
    b: tuple[str, str] = ("bx", "by"),
    near: int = NEAR_SEGMENTS,
) -> DataFrame:
    """Of each point the nearest segment within radius, with share and dist; distances equal to so many digits go to the smaller `other`.

    The fullest cell tells from which radius to start; only points that find nothing within
    a radius go on to four times that, so a dense place doesn't send all of its pairs.
    cell: about the length of the longer segments; it is halved up to CELL_HALVINGS times
    where cells are full. apart: a condition that pairs have to fulfil.
    """
    size, held = cell, 0
    for halvings in range(CELL_HALVINGS + 1):
        size = cell / 2**halvings
        held = _spread(segments, 0.0, size, a, b).groupBy("__i", "__j").count().agg(F.max("count")).first()[0] or 0
        if held <= CELL_ROWS:
            break
    level = 0
    while level < HALVINGS and held * 2 * (radius / 4**level) > near * size:
        level += 1
    left, done = points, []
    for power in range(level, -1, -1):
        reach = radius / 4**power
        met = near_segments(left, segments, reach, size, p, a, b)
        met = (met if apart is None else met.where(apart)).withColumn("__d", F.round("dist", digits))
        best = met.withColumn("__k", F.row_number().over(Window.partitionBy(*ident).orderBy("__d", other))).where("__k = 1").drop("__k", "__d")
        if power == 0:
            done.append(best)
            break
        # at the rim a segment just out of reach could have the same rounded distance
        found = checkpoint(best.where(F.col("dist") <= reach - 10.0**-digits))
        done.append(found)
        left = checkpoint(left.join(found.select(*ident), ident, "left_anti"))
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def first_claim(points: DataFrame, cell: list[str], section: str, rank: str) -> DataFrame:
    """Points of the section that claims their cell: that of the smallest rank in it. All of its points there stay."""
    claims = points.groupBy(*cell).agg(F.min(rank).alias("__claim"))
    return points.join(claims, cell).where(F.col(rank) == F.col("__claim")).drop("__claim")

"""Interval joins: overlaps, subtraction, point lookups. Intervals are [lo, hi).

A plain range condition makes Spark compare all pairs of a key. Here both sides are cut
into cells of a fixed width and joined on (key, cell); a pair that meets in several
cells counts in the first one only. The work per cell follows its density, and a long
or hot section is spread over its cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainage.operators import linear


def _cells(df: DataFrame, lo: str, hi: str, width: float, at: str) -> DataFrame:
    first, last = F.floor(F.col(lo) / width).cast("long"), F.floor(F.col(hi) / width).cast("long")
    return df.withColumn("__c0", first).withColumn(at, F.explode(F.sequence(first, F.greatest(first, last))))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: float, a_span: tuple[str, str] = ("a_lo", "a_hi"), b_span: tuple[str, str] = ("b_lo", "b_hi")) -> DataFrame:
    """Pairs of a and b of one key whose intervals share more than a point, with their overlap.

    Empty and null intervals meet nothing. width: about the length of the longer intervals.
    """
    (al, ah), (bl, bh) = a_span, b_span
    left = _cells(a.where(F.col(al) < F.col(ah)), al, ah, width, "__cell").withColumnRenamed("__c0", "__a0")
    right = _cells(b.where(F.col(bl) < F.col(bh)), bl, bh, width, "__cell").withColumnRenamed("__c0", "__b0")
    met = left.join(right, [*keys, "__cell"]).where((F.col(al) < F.col(bh)) & (F.col(bl) < F.col(ah))).where(F.col("__cell") == F.greatest("__a0", "__b0"))
    return met.withColumn("overlap", F.least(ah, bh) - F.greatest(al, bl)).drop("__cell", "__a0", "__b0")


def points_in(points: DataFrame, spans: DataFrame, keys: list[str], at: str, width: float, span: tuple[str, str] = ("lo", "hi"), closed: bool = False) -> DataFrame:
    """Pairs of points and the spans [lo, hi) (or [lo, hi]) that hold them."""
    lo, hi = span
    cells = _cells(spans.where(F.col(lo) <= F.col(hi)), lo, hi, width, "__cell").drop("__c0")
    inside = (F.col(at) >= F.col(lo)) & ((F.col(at) <= F.col(hi)) if closed else (F.col(at) < F.col(hi)))
    return points.withColumn("__cell", F.floor(F.col(at) / width).cast("long")).join(cells, [*keys, "__cell"]).where(inside).drop("__cell")


def overlap_share(a: DataFrame, b: DataFrame, keys: list[str], ident: list[str], width: float, a_span: tuple[str, str] = ("a_lo", "a_hi"), b_span: tuple[str, str] = ("b_lo", "b_hi")) -> DataFrame:
    """a with the share of each interval that intervals of b cover (overlapping ones count each)."""
    met = overlap_join(a, b, keys, width, a_span, b_span).groupBy(*keys, *ident).agg(F.sum("overlap").alias("__o"))
    length = F.col(a_span[1]) - F.col(a_span[0])
    return a.join(met, [*keys, *ident], "left").withColumn("share", F.coalesce(F.try_divide("__o", length), F.lit(0.0))).drop("__o")


def subtract(a: DataFrame, b: DataFrame, keys: list[str], ident: list[str], width: float, a_span: tuple[str, str] = ("a_lo", "a_hi"), b_span: tuple[str, str] = ("b_lo", "b_hi")) -> DataFrame:
    """Pieces (lo, hi) of each interval of a that no interval of b covers; none, one or several per interval.

    The overlapping blocks of one interval are ordered by their start; a gap opens where
    the furthest end so far lies before the next start. One interval's blocks are a window.
    """
    (al, ah), (bl, bh) = a_span, b_span
    met = overlap_join(a, b, keys, width, a_span, b_span)
    blocks = met.select(*keys, *ident, al, ah, F.greatest(al, bl).alias("__s"), F.least(ah, bh).alias("__e"))
    ends = a.where(F.col(al) < F.col(ah)).select(*keys, *ident, al, ah, F.col(ah).alias("__s"), F.col(ah).alias("__e"))
    w = Window.partitionBy(*keys, *ident).orderBy("__s", "__e").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("__e").over(w), F.col(al))
    return blocks.unionByName(ends).withColumn("lo", reach).withColumn("hi", F.col("__s")).where("lo < hi").select(*keys, *ident, "lo", "hi")


def near_counts(spans: DataFrame, points: DataFrame, keys: list[str], ident: list[str], at: str, margin: float, width: float, span: tuple[str, str] = ("lo", "hi")) -> DataFrame:
    """spans with the number of points within margin of them, zero included."""
    lo, hi = span
    wide = spans.select(*keys, *ident, (F.col(lo) - margin).alias("__lo"), (F.col(hi) + margin).alias("__hi"))
    met = points_in(points.select(*keys, at), wide, keys, at, width, ("__lo", "__hi"), closed=True)
    return spans.join(met.groupBy(*keys, *ident).agg(F.count("*").alias("n_near")), [*keys, *ident], "left").fillna(0, ["n_near"])


def override_by_share(df: DataFrame, shares: DataFrame, ident: list[str], column: str, value, least: float = 0.7) -> DataFrame:
    """df with column set to value where the share reaches `least`; `overridden` tells where."""
    joined = df.join(shares.select(*ident, "share"), ident, "left").withColumn("overridden", F.coalesce(F.col("share") >= least, F.lit(False)))
    return joined.withColumn(column, F.when(F.col("overridden"), F.lit(value)).otherwise(F.col(column))).drop("share")


def step_value(
    points: DataFrame,
    steps: DataFrame,
    keys: list[str],
    ident: list[str],
    at: str,
    value: str,
    width: float,
    default=None,
    span: tuple[str, str] = ("lo", "hi"),
) -> DataFrame:
    """points with the value of the step [lo, hi) that holds them, the default outside all steps.

    Of steps that overlap, the one of the smallest (lo, hi) counts.
    """
    met = points_in(points.select(*keys, *ident, at), steps.select(*keys, *span, value), keys, at, width, span)
    first = met.groupBy(*keys, *ident).agg(F.min_by(F.struct(value), F.struct(*span)).alias("__s"))
    out = points.join(first, [*keys, *ident], "left")
    return out.withColumn(value, F.when(F.col("__s").isNull(), F.lit(default)).otherwise(F.col(f"__s.{value}"))).drop("__s")


def coalesced(df: DataFrame, keys: list[str], width: float | None = None, span: tuple[str, str] = ("lo", "hi"), gap: float = 0.0, empty: bool = False) -> DataFrame:
    """(keys, lo, hi, n): the union of each key's intervals, those that touch, overlap or lie at most `gap` apart as one, and how many it is made of.

    Null intervals are left out, and empty ones (lo = hi) unless `empty` is set. With width (a length that a task can hold) a key
    is spread over blocks of so much length, and one row per block carries what reaches on.
    """
    lo, hi = span
    # equal intervals are one row, so that the order of rows is the same in each pass
    rows = df.where(F.col(lo) <= F.col(hi) if empty else F.col(lo) < F.col(hi)).groupBy(*keys, F.col(lo).alias("lo"), F.col(hi).alias("hi")).agg(F.count("*").alias("__same"))
    block = "__block" if width else None
    if width:
        rows = rows.withColumn("__block", F.floor(F.col("lo") / width))
    order = ["lo", "hi"]
    marked = linear.running_max(rows, keys, order, "hi", "__reach", block)
    opens = (F.col("__reach").isNull() | (F.col("lo") > F.col("__reach") + gap)).cast("long")
    numbered = linear.running_sum(marked, keys, order, opens, "__run", block)
    return numbered.groupBy(*keys, "__run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("__same").alias("n")).drop("__run")

"""What blocks whose minutes are frozen would gain: three runs inside each block, and the gain told apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainage.functions.traction import LOCO, TILTING
from chainage.operators import intervals
from chainage.plans import engines, travel
from chainage.plans.registry import query, track
from chainage.sources.shared import checkpoint

#: today's cap and the raised one in km/h, minutes of a stop, and how far inside a block (km) a stop has to lie.
CAP, RAISED, DWELL, INSIDE = 153.0, 201.0, 2.0, 0.1


def told_apart(runs: DataFrame, frozen: str, now: str, curves: str, raised: str, margin: float) -> DataFrame:
    """runs with gain, gain_sharing, gain_curves, gain_signals and surplus (minutes).

    frozen: scheduled minutes. now: today's train under today's cap; curves: the tilting
    train under it; raised: the tilting train under the raised cap. Margins multiply running
    times. Where running times of today with their margin exceed the schedule, the surplus
    is told and the two other parts are scaled to the gain. Nulls make all null.
    """
    f, a, b, c = (F.col(x) for x in (frozen, now, curves, raised))
    gain, sharing, bends, signals = f - c * margin, f - a * margin, (a - b) * margin, (b - c) * margin
    short = sharing < 0
    scale = F.when(short, gain / F.greatest(bends + signals, F.lit(1e-9))).otherwise(1.0)
    return runs.withColumns({
        "gain": gain,
        "gain_sharing": F.when(short, 0.0).otherwise(sharing),
        "gain_curves": bends * scale,
        "gain_signals": signals * scale,
        "surplus": F.when(short, -sharing).when(sharing.isNotNull(), 0.0),
    })


def runs_inside(segments: DataFrame, blocks: DataFrame, stops: DataFrame, keys: list[str], slower: float, step: float, width: float) -> DataFrame:
    """(keys, block, stops, now, curves, raised): minutes inside each block, from rest to rest, with the stops that lie well inside.

    segments: (keys, lo, hi, v of the tilting train). blocks: (keys, block, b_lo, b_hi).
    stops: (keys, stop). slower: today's limits over those of the tilting train. Blocks
    that no segment overlaps give no row.
    """
    own = [*keys, "block"]
    met = intervals.overlap_join(segments.select(*keys, "lo", "hi", "v"), blocks.select(*own, "b_lo", "b_hi"), keys, width, ("lo", "hi"), ("b_lo", "b_hi"))
    pieces = met.select(*own, F.lit(1).cast("long").alias("stretch"), F.greatest("lo", "b_lo").alias("lo"), F.least("hi", "b_hi").alias("hi"), "v").where("hi - lo > 1e-6")
    spans = blocks.select(*own, (F.col("b_lo") + INSIDE).alias("lo"), (F.col("b_hi") - INSIDE).alias("hi"))
    inner = intervals.points_in(stops.select(*keys, "stop").distinct(), spans, keys, "stop", width).select(*own, "stop")
    points = checkpoint(travel.with_rests(travel.sampled_pieces(pieces, own, step), inner, own, width))
    new = travel.minutes_of(points, own, [("curves", TILTING, CAP, True), ("raised", TILTING, RAISED, True)])
    old = travel.minutes_of(points.withColumn("v", F.col("v") * slower), own, [("now", LOCO, CAP, True)])
    of = lambda name: F.sum(F.when(F.col("variant") == name, F.col("minutes"))).alias(name)
    out = new.unionByName(old).groupBy(*own).agg(of("now"), of("curves"), of("raised")).join(inner.groupBy(*own).agg(F.count("*").alias("stops")), own, "left").fillna(0, ["stops"])
    return out.withColumns({c: F.col(c) + DWELL * F.col("stops") for c in ("now", "curves", "raised")})


@query()
def block_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain of each block against the timetable's median, by sharing of the line, curves and signals (sequential speeds: no SQL)."""
    segments, blocks, stops = travel.tables_of(spark, sf_dir)
    own = ["user_id", "block"]
    w = Window.partitionBy("user_id").orderBy("us")
    pairs = track(spark, sf_dir).select(F.col("event_type").alias("from_stop"), F.lead("event_type").over(w).alias("to_stop"), ((F.lead("us").over(w) - F.col("us")) / 6e7).alias("minutes"))
    numbered = blocks.where("b_hi > b_lo").withColumn("block", F.row_number().over(Window.partitionBy("user_id").orderBy("b_lo", "b_hi")).cast("long"))
    slower = engines.CANT_SETS[0].coefficient / engines.CANT_SETS[1].coefficient
    runs = runs_inside(segments, numbered, stops, ["user_id"], slower, 0.5, 24.0)
    ends = numbered.select(*own, F.lit("signup").alias("from_stop"), F.lit("signup").alias("to_stop"))
    held = travel.with_frozen(runs.select(*own, F.lit(0.0).alias("minutes")), ends, pairs, own).select(*own, "frozen")
    out = told_apart(runs.join(held, own), "frozen", "now", "curves", "raised", 1.07)
    lengths = numbered.select(*own, (F.col("b_hi") - F.col("b_lo")).alias("km"))
    return out.join(lengths, own).select(*own, F.round("km", 4).alias("km"), "stops", *[F.round(c, 4).alias(c) for c in ("frozen", "now", "curves", "raised", "gain", "gain_sharing", "gain_curves", "gain_signals", "surplus")])

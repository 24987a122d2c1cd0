"""Curvature of a surveyed line: even points, inflections seen at several scales, circle fits that stop there, gate and median.

Points are numbered along their section and worked on in chunks of ROWS with HALO rows of
their neighbours on both sides. HALO is wider than all frames together, so whatever a
chunk's own rows need is in sight, each step is a window over (section, chunk), and no
task holds a section. Moving sums are differences of running sums about the chunk's
centre: a fit costs the same for a window of any width. Partitions are as many as the
points need (`spread`); points are read more than once, so costly ones are checkpointed first.
"""

from __future__ import annotations

from math import pi, radians
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainage.operators import linear, sequences
from chainage.sources.shared import checkpoint, spread

#: Own rows of a chunk: few, so that sums of third powers about its centre keep their digits.
ROWS = 1000
#: Rows of neighbours on either side of a chunk.
HALO = 128


class Survey(NamedTuple):
    """How a line is measured; lengths in metres. Defaults are fixed values of the surveyed method."""

    step: float = 10.0  # between even points
    scales: tuple[float, ...] = (150.0, 250.0, 400.0)  # chords on which signs of curvature are judged
    noise: float = 4.62  # deviation of a position after smoothing
    signal: float = 4.0  # curvature over its noise, at least, for a sign to count
    merge: float = 150.0  # inflections nearer than this are one
    window: float = 900.0  # of a circle fit
    least_window: float = 300.0
    chord: float = 150.0  # of headings at the ends of a window
    least_turn: float = 5.0  # degrees over a window, for a radius to be told
    r_min: float = 100.0
    r_max: float = 50_000.0  # also stands for straight

    def half_chord(self, length: float) -> int:
        return max(1, round(length / self.step / 2))

    def sharpest_straight(self, scale: float) -> float:
        """The radius beyond which a chord of this scale can't tell a curve from noise."""
        return scale * scale / (self.signal * 2 * self.noise)

    def half_window(self) -> int:
        return max(3, round(self.window / self.step) + 1) // 2

    def half_least(self) -> int:
        return max(3, round(self.least_window / self.step) + 1) // 2

    def check(self) -> None:
        most = max(4 * max(self.half_chord(s) for s in self.scales) + 3, 2 * self.half_window() + 4, self.half_window() + self.half_chord(self.chord) + 4)
        if most > HALO:
            raise ValueError(f"frames of {most} rows don't fit into a halo of {HALO}: take a larger step or smaller windows")
        if self.half_least() > self.half_window():
            raise ValueError("the least window is wider than the window")


def resampled(vertices: DataFrame, keys: list[str], order: list[str], x: str, y: str, step: float, block: str | None = None) -> DataFrame:
    """(keys, i, x, y): points every `step` along each section's line, from its first vertex; i counts from 0.

    Vertices within a centimetre of the one before, and vertices without coordinates, are
    left out. Each piece between two vertices emits the points on it, so nothing is looked up.
    """
    at = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    blocks = [block] if block else []
    rows = vertices.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, *order, *[b for b in blocks if b not in order], at.alias("__at"))
    length = lambda: F.hypot(F.col("__at.x") - F.col("__from.x"), F.col("__at.y") - F.col("__from.y"))
    # each step in two levels reads its rows twice, so they are kept between
    kept = checkpoint if block else (lambda df: df)
    n = rows.count() if block else 0
    dealt = (lambda df: spread(df, n, *keys, block)) if block else (lambda df: df)
    rows = kept(linear.previous(dealt(rows), keys, order, "__at", "__from", block).where(F.col("__from").isNull() | (length() > 0.01)).drop("__from"))
    rows = kept(linear.previous(dealt(rows), keys, order, "__at", "__from", block).withColumn("__d", length()))
    rows = linear.running_sum(dealt(rows), keys, order, F.col("__d"), "__s", block).withColumn("__s0", F.col("__s") - F.coalesce("__d", F.lit(0.0)))
    first, last = (F.floor("__s0") * 0).cast("long"), F.floor(F.col("__s") / step).cast("long")
    lo = F.when(F.col("__d").isNull(), first).otherwise(F.floor(F.col("__s0") / step).cast("long") + 1)
    even = rows.withColumn("i", F.explode(F.when(last >= lo, F.sequence(lo, last))))
    share = F.coalesce((F.col("i") * step - F.col("__s0")) / F.col("__d"), F.lit(0.0))
    place = lambda c: F.coalesce(F.col(f"__from.{c}") + share * (F.col(f"__at.{c}") - F.col(f"__from.{c}")), F.col(f"__at.{c}")).alias(c)
    return even.select(*keys, "i", place("x"), place("y"))


def chunked(points: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n points in chunks with halo, each coordinate the mean of three neighbours (end points stand in beyond the ends)."""
    rows = spread(linear.with_halo(points, keys, "i", HALO, ROWS), n, *keys, "chunk")
    w = Window.partitionBy(*keys, "chunk").orderBy("i")
    mean = lambda c: (F.coalesce(F.lag(c).over(w), F.col(c)) + F.col(c) + F.coalesce(F.lead(c).over(w), F.col(c))) / 3
    return rows.withColumns({"__x": mean("x"), "__y": mean("y")}).drop("x", "y").withColumnsRenamed({"__x": "x", "__y": "y"})


def turn(heading: Column, before: Column) -> Column:
    """The step from one heading to the next, between -pi and pi."""
    d = heading - before
    return d - 2 * pi * F.rint(d / (2 * pi))


def heading(w, half: int) -> Column:
    """Of the chord from `half` rows before to `half` rows after; null near the ends."""
    return F.atan2(F.lead("y", half).over(w) - F.lag("y", half).over(w), F.lead("x", half).over(w) - F.lag("x", half).over(w))


def signed(rows: DataFrame, keys: list[str], survey: Survey) -> DataFrame:
    """chunked rows with the curvature k0, k1, ... at each scale: the turn of the chord over as many rows, its first and last values repeated to the ends; 0 on lines too short."""
    w = Window.partitionBy(*keys, "chunk").orderBy("i")
    whole = Window.partitionBy(*keys, "chunk")
    halves = [survey.half_chord(s) for s in survey.scales]
    rows = rows.withColumns({f"__h{n}": heading(w, b) for n, b in enumerate(halves)}).withColumn("__n", F.max("i").over(whole) + 1)
    rows = rows.withColumns({f"__t{n}": F.coalesce(turn(F.col(f"__h{n}"), F.lag(f"__h{n}").over(w)), F.lit(0.0)) for n in range(len(halves))})
    # headings turn by the running sum of their steps
    rows = rows.withColumns({f"__p{n}": F.sum(f"__t{n}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for n in range(len(halves))})
    inner = {}
    for n, b in enumerate(halves):
        inside = (F.col("i") >= 2 * b) & (F.col("i") <= F.col("__n") - 1 - 2 * b)
        inner[f"__k{n}"] = F.when(inside, (F.lead(f"__p{n}", b).over(w) - F.lag(f"__p{n}", b).over(w)) / (2 * b * survey.step))
    rows = rows.withColumns(inner)
    ends = {}
    for n, b in enumerate(halves):
        head, tail = F.max(F.when(F.col("i") == 2 * b, F.col(f"__k{n}"))).over(whole), F.max(F.when(F.col("i") == F.col("__n") - 1 - 2 * b, F.col(f"__k{n}"))).over(whole)
        ends[f"k{n}"] = F.when(F.col("__n") < 4 * b + 1, F.lit(0.0)).when(F.col("i") < 2 * b, head).otherwise(F.coalesce(f"__k{n}", tail))
    return rows.withColumns(ends).drop("__n", *[f"__{c}{n}" for n in range(len(halves)) for c in "htpk"])


def splits(points: DataFrame, keys: list[str], survey: Survey = Survey()) -> DataFrame:
    """(keys, i): rows at which the line's curves change their sense, seen at any scale; those nearer than `merge` to the one kept before are that one."""
    w = Window.partitionBy(*keys, "chunk").orderBy("i")
    n = points.count()
    rows = signed(chunked(points, keys, n), keys, survey)
    scales = range(len(survey.scales))
    sign = {f"__s{n}": F.when(F.abs(f"k{n}") >= 1 / survey.sharpest_straight(s), F.signum(f"k{n}")).otherwise(0.0).cast("int") for n, s in enumerate(survey.scales)}
    rows = rows.withColumns(sign)
    rows = rows.withColumns({f"__new{n}": (F.col("own") & ~F.coalesce(F.lag(f"__s{n}").over(w) == F.col(f"__s{n}"), F.lit(False))).cast("long") for n in scales})
    rows = rows.withColumns({f"__run{n}": F.sum(f"__new{n}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for n in scales}).where("own")
    seen = rows.select(*keys, "chunk", "i", F.explode(F.array(*[F.struct(F.lit(n).alias("scale"), F.abs(f"k{n}").alias("k"), F.col(f"__s{n}").alias("sign"), F.col(f"__run{n}").alias("run")) for n in scales])).alias("__e"))
    spot = F.struct("k", "i", F.col("i").alias("at"))
    # a chunk's runs first, then one row per run and chunk; a run that goes on has the number of the chunk before
    parts = seen.select(*keys, "chunk", "i", "__e.*").groupBy(*keys, "scale", "chunk", "run").agg(F.first("sign").alias("sign"), F.count("*").alias("n"), F.min(spot).alias("least"), F.min_by(spot, "i").alias("first"), F.max_by(spot, "i").alias("last"))
    parts = checkpoint(parts)
    before = Window.partitionBy(*keys, "scale").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.groupBy(*keys, "scale", "chunk").agg(F.max("run").alias("__m")).withColumn("__c", F.coalesce(F.sum("__m").over(before), F.lit(0))).drop("__m")
    numbered = parts.join(carry, [*keys, "scale", "chunk"]).withColumn("run", F.col("run") + F.col("__c"))
    every = numbered.groupBy(*keys, "scale", "run").agg(F.first("sign").alias("sign"), F.sum("n").alias("n"), F.min("least").alias("least"), F.min_by("first", "chunk").alias("first"), F.max_by("last", "chunk").alias("last"))
    supports = F.array(*[F.lit(max(3, round(s / survey.step))) for s in survey.scales])
    found = linear.turning_points(every, [*keys, "scale"], F.get(supports, F.col("scale"))).select(*keys, F.col("at").alias("i"))
    types = dict(points.dtypes)

    def merged(state, p, last):
        kept = sequences.thin_by_distance(p["i"], survey.merge / survey.step, state, False)
        return float(p["i"][kept[-1]]) if len(kept) else state, pd.DataFrame({c: p[c][kept] for c in (*keys, "i")})

    return sequences.in_order(found, keys, ["i"], ", ".join(f"{c} {types[c]}" for c in (*keys, "i")), merged, n)


_TERMS = ("u", "v", "z", "uu", "uv", "vv", "uz", "vz")


def _fit(sums: dict[str, Column], m: Column) -> Column:
    """Radius from the sums of _TERMS over m points; infinite for fewer than three."""
    su, sv, sz, suu, suv, svv, suz, svz = (sums[t] for t in _TERMS)
    parts = {"m": m, "sx": su, "sy": sv, "sz": sz, "cxx": suu - su * su / m, "cxy": suv - su * sv / m, "cyy": svv - sv * sv / m, "cxz": suz - su * sz / m, "cyz": svz - sv * sz / m}
    return F.when(m >= 3, linear.radius_of(F.struct(*[c.cast("double").alias(k) for k, c in parts.items()]))).otherwise(F.lit(float("inf")))


def fitted(rows: DataFrame, keys: list[str], survey: Survey, out: str = "r") -> DataFrame:
    """chunked rows with `__split`, and with out: the radius of the circle about each within its stretch between splits, r_max where it turns too little."""
    names = rows.columns
    half, least, chord = survey.half_window(), survey.half_least(), survey.half_chord(survey.chord)
    order = Window.partitionBy(*keys, "chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    w = Window.partitionBy(*keys, "chunk", "__seg").orderBy("i")
    whole = Window.partitionBy(*keys, "chunk", "__seg")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__seg", F.sum(F.col("__split").cast("long")).over(order))
    # a stretch that begins or ends out of sight is longer than any frame
    rows = rows.withColumns({"__n": F.count("*").over(whole), "j": F.row_number().over(w) - 1, "__u": F.col("x") - F.avg("x").over(whole), "__v": F.col("y") - F.avg("y").over(whole), "__h": heading(w, chord)})
    rows = rows.withColumn("__z", F.col("__u") * F.col("__u") + F.col("__v") * F.col("__v"))
    term = {t: F.col(f"__{t[0]}") if len(t) == 1 else F.col(f"__{t[0]}") * F.col(f"__{t[1]}") for t in _TERMS}
    rows = rows.withColumns({f"__{t}1": F.sum(term[t]).over(run) for t in _TERMS} | {f"__{t}2": F.sum(term[t]).over(whole) for t in _TERMS} | {"__t": F.coalesce(turn(F.col("__h"), F.lag("__h").over(w)), F.lit(0.0))})
    rows = rows.withColumn("__a", F.sum("__t").over(run))
    short = F.col("__n") <= 2 * half
    moved = {t: F.lead(f"__{t}1", half).over(w) - F.coalesce(F.lag(f"__{t}1", half + 1).over(w), F.lit(0.0)) for t in _TERMS}
    inside = (F.col("j") >= half) & (F.col("j") <= F.col("__n") - 1 - half)
    few = F.collect_list(F.when(short, F.col("__a"))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumns({
        **{f"__{t}3": moved[t] for t in _TERMS},
        "__ahead": F.coalesce(F.lead("__a", half).over(w), F.last("__a").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))),
        "__back": F.coalesce(F.lag("__a", half).over(w), F.lit(0.0)),
        "__few": few,
    })
    rows = rows.withColumn("__in", F.when(~short & inside, _fit({t: F.col(f"__{t}3") for t in _TERMS}, F.lit(2.0 * half + 1))))
    one = F.when(short, _fit({t: F.col(f"__{t}2") for t in _TERMS}, F.col("__n")))
    edge = lambda j: F.max(F.when(F.col("j") == j, F.col("__in"))).over(whole)
    rows = rows.withColumns({"__one": one, "__head": edge(F.lit(half)), "__tail": edge(F.col("__n") - 1 - half)})
    reach = F.when(F.col("__n") > 2 * least, F.floor((F.col("__n") - 1) / 2)).otherwise(F.lit(least)).cast("int")
    near = F.get("__few", F.least(F.col("j") + reach, F.col("__n").cast("int") - 1)) - F.get("__few", F.greatest(F.col("j") - reach, F.lit(0)))
    turned = F.abs(F.when(short, near).otherwise(F.col("__ahead") - F.col("__back")))
    r = F.when(short, F.col("__one")).when(F.col("j") < half, F.col("__head")).otherwise(F.coalesce("__in", "__tail"))
    straight = (F.col("__n") >= 5) & (turned < radians(survey.least_turn))
    return rows.select(*names, F.when(straight | (r > survey.r_max), F.lit(survey.r_max)).otherwise(r).alias(out))


def median_of_five(w, column: str) -> Column:
    """Of a row and two on either side; the end rows stand in beyond the ends."""
    c = F.col(column)
    one, two = F.coalesce(F.lag(column).over(w), c), F.coalesce(F.lead(column).over(w), c)
    five = F.array(F.coalesce(F.lag(column, 2).over(w), one), one, c, two, F.coalesce(F.lead(column, 2).over(w), two))
    return F.get(F.array_sort(five), F.lit(2))


def along(points: DataFrame, keys: list[str], survey: Survey = Survey(), cuts: DataFrame | None = None) -> DataFrame:
    """(keys, i, x, y, radius) of even points: smoothed places and radii between r_min and r_max, from fits that never reach over an inflection.

    cuts: (keys, i), those of `splits` if it isn't given.
    """
    return along_each(points, keys, {"radius": survey}, cuts)


def along_each(points: DataFrame, keys: list[str], surveys: dict[str, Survey], cuts: DataFrame | None = None) -> DataFrame:
    """As `along`, with a radius for each of several surveys, by name; points are shuffled once for all of them.

    cuts are those of `splits` by the first survey if they aren't given. A chunk's cuts, a few dozens, go to its rows as an array.
    """
    for survey in surveys.values():
        survey.check()
    cuts = splits(points, keys, next(iter(surveys.values()))) if cuts is None else cuts
    near = linear.with_halo(cuts.select(*keys, "i"), keys, "i", HALO, ROWS).groupBy(*keys, "chunk").agg(F.collect_set("i").alias("__cuts"))
    # each survey sorts in the same task, which so has the fewer rows
    rows = chunked(points, keys, points.count() * len(surveys)).join(near.hint("merge"), [*keys, "chunk"], "left")
    rows = rows.withColumn("__split", F.coalesce(F.array_contains("__cuts", F.col("i")), F.lit(False))).drop("__cuts")
    for name, survey in surveys.items():
        rows = fitted(rows, keys, survey, f"__of_{name}")
    w = Window.partitionBy(*keys, "chunk").orderBy("i")
    told = {name: F.greatest(F.least(median_of_five(w, f"__of_{name}"), F.lit(survey.r_max)), F.lit(survey.r_min)) for name, survey in surveys.items()}
    return rows.withColumns(told).where("own").select(*keys, "i", "x", "y", *surveys)


def measured(vertices: DataFrame, keys: list[str], order: list[str], x: str, y: str, survey: Survey = Survey(), block: str | None = None) -> DataFrame:
    """The whole chain from vertices: even points, smoothed; inflections; fits between them; gate; median of five.

    Defined edge cases: sections of one vertex have one point, straight; vertices without
    coordinates are left out; an empty table gives an empty result.
    """
    return along(checkpoint(resampled(vertices, keys, order, x, y, survey.step, block)), keys, survey)

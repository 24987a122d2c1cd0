"""Ordered operators along a line: running sums, islands, as-of lookups, interpolation, resampling.

Rows belong to a section (`keys`) and are ordered in it (`order`, ending in a unique
column). Where `block` is given, a column that grows with the order (a day, a
kilometre), the running operators work in two levels: inside each (section, block), and
over one row per block. No task then holds a whole section, however long it is.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chainage.sources.shared import checkpoint


def _carried(local: DataFrame, carry: DataFrame, by: list[str]) -> DataFrame:
    """local with its block's row of carry. Merged, since local is sorted by block already; rows whose file is small for their number would else be broadcast whole."""
    return local.join(carry.hint("merge"), by)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, block: str | None = None) -> DataFrame:
    """Sum of value over the section's rows up to this one; nulls count as nothing."""
    df = df.withColumn("__v", F.coalesce(value, F.lit(0)))
    if block is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum("__v").over(w)).drop("__v")
    inner = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carry = df.groupBy(*keys, block).agg(F.sum("__v").alias("__s")).withColumn("__c", F.coalesce(F.sum("__s").over(before), F.lit(0))).drop("__s")
    local = df.withColumn("__l", F.sum("__v").over(inner))
    return _carried(local, carry, [*keys, block]).withColumn(out, F.col("__l") + F.col("__c")).drop("__v", "__l", "__c")


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], block: str | None = None) -> DataFrame:
    """Several running sums together. With block the rows are read twice, so rows that are costly to make are checkpointed first."""
    zero = {out: F.coalesce(v, F.lit(0)) for out, v in values.items()}
    if block is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({out: F.sum(v).over(w) for out, v in zero.items()})
    inner = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, block).agg(*[F.sum(v).alias(f"__s_{out}") for out, v in zero.items()])
    carry = totals.select(*keys, block, *[F.coalesce(F.sum(f"__s_{out}").over(before), F.lit(0)).alias(f"__c_{out}") for out in values])
    local = df.withColumns({f"__l_{out}": F.sum(v).over(inner) for out, v in zero.items()})
    summed = _carried(local, carry, [*keys, block]).withColumns({out: F.col(f"__l_{out}") + F.col(f"__c_{out}") for out in values})
    return summed.drop(*[f"__{c}_{out}" for out in values for c in "lc"])


def running_max(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, block: str | None = None) -> DataFrame:
    """Greatest value of the rows before this one; null in the first."""
    parts = [*keys, block] if block else keys
    local = df.withColumn(out, F.max(value).over(Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    if block is None:
        return local
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carry = df.groupBy(*parts).agg(F.max(value).alias("__m")).select(*parts, F.max("__m").over(before).alias("__c"))
    return _carried(local, carry, parts).withColumn(out, F.greatest(out, "__c")).drop("__c")


def previous(df: DataFrame, keys: list[str], order: list[str], column: str, out: str, block: str | None = None) -> DataFrame:
    """The column's value in the row before (null in the first)."""
    if block is None:
        return df.withColumn(out, F.lag(column).over(Window.partitionBy(*keys).orderBy(*order)))
    inner = Window.partitionBy(*keys, block).orderBy(*order)
    ends = df.groupBy(*keys, block).agg(F.max_by(F.struct(F.col(column).alias("x")), F.struct(*order)).alias("__e"))
    edge = ends.withColumn("__pe", F.lag("__e").over(Window.partitionBy(*keys).orderBy(block))["x"]).drop("__e")
    local = df.withColumn("__first", F.row_number().over(inner) == 1).withColumn("__l", F.lag(column).over(inner))
    return _carried(local, edge, [*keys, block]).withColumn(out, F.when(F.col("__first"), F.col("__pe")).otherwise(F.col("__l"))).drop("__first", "__l", "__pe")


def islands(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "run", block: str | None = None) -> DataFrame:
    """Number of the run of equal values (nulls are equal) that a row lies in, from 1 in each section."""
    marked = previous(df.withColumn("__s", F.struct(F.col(value).alias("v"))), keys, order, "__s", "__p", block)
    marked = marked.withColumn("__new", (F.col("__p").isNull() | ~F.col("__p")["v"].eqNullSafe(F.col("__s")["v"])).cast("long"))
    return running_sum(marked, keys, order, F.col("__new"), out, block).drop("__s", "__p", "__new")


def runs(df: DataFrame, keys: list[str], order: list[str], value: str, at: str, block: str | None = None) -> DataFrame:
    """One row per run: its number, value, first and last `at` and rows."""
    numbered = islands(df, keys, order, value, "run", block)
    return numbered.groupBy(*keys, "run").agg(F.first(value).alias(value), F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("n"))


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, block: str | None = None) -> DataFrame:
    """Number of the row in its section, from 0."""
    return running_sum(df, keys, order, F.lit(1), out, block).withColumn(out, (F.col(out) - 1).cast("long"))


def with_halo(df: DataFrame, keys: list[str], number: str, half: int, rows: int = 10_000) -> DataFrame:
    """df in chunks of `rows` consecutive rows (`chunk`), each with the `half` rows before and after it.

    A row has `own` in the chunk that it belongs to. Frames of up to `half` rows, over
    (keys, chunk), are then whole for every own row, and no task holds a section.
    """
    reach = F.sequence(F.floor(F.greatest(F.col(number) - half, F.lit(0)) / rows), F.floor((F.col(number) + half) / rows))
    return df.withColumn("chunk", F.explode(reach)).withColumn("own", F.col("chunk") == F.floor(F.col(number) / rows))


def offsets(near: Column, x: Column, y: Column) -> Column:
    """The structs (x, y) of an array about (x, y), with their squared distance z."""
    return F.transform(near, lambda p: F.struct((p["x"] - x).alias("x"), (p["y"] - y).alias("y"), ((p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y)).alias("z")))


def circle_radius(d: Column) -> Column:
    """Radius of the least-squares circle (Kasa) through `d`, an array of offsets; infinite for a line."""

    def total(term) -> Column:
        return F.aggregate(d, F.lit(0.0), lambda acc, p: acc + term(p))

    m = F.size(d).cast("double")
    sx, sy, sz = (total(lambda p, c=c: p[c]) for c in "xyz")
    second = lambda a, b: total(lambda p: p[a] * p[b])
    cxx, cxy, cyy = second("x", "x") - sx * sx / m, second("x", "y") - sx * sy / m, second("y", "y") - sy * sy / m
    cxz, cyz = second("x", "z") - sx * sz / m, second("y", "z") - sy * sz / m
    return radius_of(F.struct(m.alias("m"), sx.alias("sx"), sy.alias("sy"), sz.alias("sz"), cxx.alias("cxx"), cxy.alias("cxy"), cyy.alias("cyy"), cxz.alias("cxz"), cyz.alias("cyz")))


def radius_of(moments: Column) -> Column:
    """Radius of the least-squares circle from a struct of the points' number m, sums s* and sums of products about their means c*."""

    def radius(s: Column) -> Column:
        det = s["cxx"] * s["cyy"] - s["cxy"] * s["cxy"]
        a = (s["cxz"] * s["cyy"] - s["cyz"] * s["cxy"]) / det / 2
        b = (s["cyz"] * s["cxx"] - s["cxz"] * s["cxy"]) / det / 2
        c = s["sz"] / s["m"] - 2 * a * s["sx"] / s["m"] - 2 * b * s["sy"] / s["m"]
        r = F.sqrt(F.greatest(c + a * a + b * b, F.lit(0.0)))
        flat = det <= 1e-12 * F.greatest(s["cxx"] * s["cyy"], F.lit(1e-300))
        return F.when(flat | (r > 1e7), F.lit(float("inf"))).otherwise(r)

    # once, however often they are named
    return F.transform(F.array(moments), radius)[0]


#: Frames of up to so many rows on either side are written out row by row; wider ones are held as arrays.
WRITTEN_OUT = 7


def _near_moments(rows: DataFrame, w: WindowSpec, x: str, y: str, half: int) -> tuple[DataFrame, Column]:
    """rows with the offsets of their neighbours as columns, and the moments of these."""
    each = range(-half, half + 1)
    names = {d: f"__{'m' if d < 0 else 'p'}{abs(d)}" for d in each}
    off = lambda c, d: F.lead(c, d).over(w).cast("double") - F.col(c).cast("double")
    rows = rows.withColumns({f"{names[d]}{a}": off(c, d) for d in each for a, c in (("x", x), ("y", y))})
    there = {d: F.col(f"{names[d]}x").isNotNull() & F.col(f"{names[d]}y").isNotNull() for d in each}
    held = {f"{names[d]}{a}": F.when(there[d], F.col(f"{names[d]}{a}")).otherwise(0.0) for d in each for a in "xy"}
    rows = rows.withColumn("__n", reduce(lambda a, b: a + b, [there[d].cast("int") for d in each]).cast("double")).withColumns(held)
    rows = rows.withColumns({f"{n}z": F.col(f"{n}x") * F.col(f"{n}x") + F.col(f"{n}y") * F.col(f"{n}y") for n in names.values()})
    total = lambda term: reduce(lambda a, b: a + b, [F.lit(0.0), *[term(n) for n in names.values()]])
    sums = {c: total(lambda n, c=c: F.col(n + c)) for c in "xyz"} | {a + b: total(lambda n, a=a, b=b: F.col(n + a) * F.col(n + b)) for a, b in ("xx", "xy", "yy", "xz", "yz")}
    rows = rows.withColumns({f"__s{c}": v for c, v in sums.items()})
    m, s = F.col("__n"), {c: F.col(f"__s{c}") for c in sums}
    about = [(s[a + b] - s[a] * s[b] / m).alias(f"c{a}{b}") for a, b in ("xx", "xy", "yy", "xz", "yz")]
    moments = F.struct(m.alias("m"), *[s[c].alias(f"s{c}") for c in "xyz"], *about)
    return rows, moments


def circle_fits(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, half: int, out: str, block: str | None = None) -> DataFrame:
    """df with the radius of the circle through the rows up to `half` before and after each row.

    Sums are taken about each row's own place. For wide frames over long lines see
    `curvature`, whose moving sums cost the same for any width.
    """
    chunks = with_halo(numbered(df, keys, order, "__i", block), keys, "__i", half)
    w = Window.partitionBy(*keys, "chunk").orderBy("__i")
    if half <= WRITTEN_OUT:
        rows, moments = _near_moments(chunks, w, x, y, half)
        return rows.where("own").withColumn(out, radius_of(moments)).select(*df.columns, out)
    near = F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))).over(w.rowsBetween(-half, half))
    # the offsets are a column of their own: they are named a dozen times
    own = chunks.withColumn("__n", near).where("own").withColumn("__d", offsets(F.col("__n"), F.col(x).cast("double"), F.col(y).cast("double")))
    return own.withColumn(out, circle_radius(F.col("__d"))).drop("__n", "__d", "__i", "chunk", "own")


def inflections(df: DataFrame, keys: list[str], order: list[str], kappa: str, at: str, support: int, threshold: float, block: str | None = None) -> DataFrame:
    """(keys, at): between runs of opposite curvature sign that last `support` rows, at the least |kappa| from the one's last row to the other's first.

    Rows become runs in two levels, and runs are worked on in blocks of consecutive ones.
    """
    sign = F.when(F.abs(F.col(kappa)) < threshold, 0).otherwise(F.signum(kappa).cast("int"))
    rows = islands(numbered(df.withColumn("__sign", sign), keys, order, "__i", block), keys, order, "__sign", "run", block)
    spot = F.struct(F.abs(F.col(kappa)).alias("k"), F.col("__i").alias("i"), F.col(at).alias("at"))
    ends = [F.min_by(spot, "__i").alias("first"), F.max_by(spot, "__i").alias("last")]
    every = rows.groupBy(*keys, "run").agg(F.first("__sign").alias("sign"), F.count("*").alias("n"), F.min(spot).alias("least"), *ends)
    return turning_points(every, keys, F.lit(support))


def turning_points(every: DataFrame, keys: list[str], support: Column) -> DataFrame:
    """(keys, at) from runs of one sign: run, sign, n and the spots (k, i, at) first, last and least in |kappa|."""
    every = every.withColumn("piece", F.floor(F.col("run") / 4096))
    real = (F.col("sign") != 0) & (F.col("n") >= support)
    counted = checkpoint(running_sum(every, keys, ["run"], real.cast("long"), "passed", "piece"))
    between = counted.where(~real).groupBy(*keys, "passed").agg(F.min("least").alias("gap"))
    bends = counted.where(real).select(*keys, "run", "piece", "passed", F.struct("sign", "last").alias("own"), "sign", "first")
    pairs = previous(bends, keys, ["run"], "own", "before", "piece").where("before.sign <> sign").withColumn("passed", F.col("passed") - 1)
    least = F.least("gap", F.col("before.last"), F.col("first"))
    return pairs.join(between, [*keys, "passed"], "left").select(*keys, least["at"].alias("at"))


def in_frames(df: DataFrame, keys: list[str], order: list, half: int, block: str | None, add: Callable[[DataFrame, WindowSpec], DataFrame]) -> DataFrame:
    """add(rows, w) over the section's window w; add may look at `half` rows before and after a row.

    With block, rows are worked on in chunks with so many neighbours, and no task holds a section.
    """
    if block is None:
        return add(df, Window.partitionBy(*keys).orderBy(*order))
    rows = with_halo(numbered(df, keys, order, "__i", block), keys, "__i", half)
    return add(rows, Window.partitionBy(*keys, "chunk").orderBy("__i")).where("own").drop("__i", "chunk", "own")


def _met(points: DataFrame, marks: DataFrame, keys: list[str], at: str, payload: list[str], width: float | None, sides: str) -> DataFrame:
    """(__row, __d, __u): points as structs with the nearest marks down (d) and up (u), as far as sides asks for them.

    One union, sorted by position. With width it is cut into cells of so much length; what
    lies beyond a cell comes from one row per cell.
    """
    wrapped = F.struct(F.col(at).alias("at"), *payload)
    row_type, mark_type = points.select(F.struct("*")).schema[0].dataType, marks.select(wrapped).schema[0].dataType
    both = marks.where(F.col(at).isNotNull()).select(*keys, at, wrapped.alias("__m"), F.lit(None).cast(row_type).alias("__row"))
    both = both.unionByName(points.select(*keys, at, F.lit(None).cast(mark_type).alias("__m"), F.struct("*").alias("__row")))
    parts = list(keys)
    if width:
        both, parts = both.withColumn("__cell", F.floor(F.col(at) / width)), [*keys, "__cell"]
    # marks at the point's own position count, so frames end with the rows of equal position
    seen = lambda by: Window.partitionBy(*parts).orderBy(by).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = {"__d": F.max("__m").over(seen(F.col(at)))} if "d" in sides else {}
    own |= {"__u": F.when(F.col(at).isNotNull(), F.min("__m").over(seen(F.desc(at))))} if "u" in sides else {}
    found = both.withColumns(own)
    if width:
        cells = both.groupBy(*parts).agg(F.max("__m").alias("__last"), F.min("__m").alias("__first"))
        beyond = lambda by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        carry = cells.select(*parts, F.last("__last", ignorenulls=True).over(beyond(F.col("__cell"))).alias("__d0"), F.last("__first", ignorenulls=True).over(beyond(F.desc("__cell"))).alias("__u0"))
        found = found.where("__row is not null").join(carry, parts, "left")
        found = found.withColumns({c: F.coalesce(c, f"{c}0") for c in own})
    return found.where("__row is not null").select("__row", *own)


def asof(points: DataFrame, marks: DataFrame, keys: list[str], at: str, payload: list[str], direction: str = "backward", width: float | None = None) -> DataFrame:
    """points with the payload of the nearest mark at or before them (or at or after), by one sort of the union; null where there is none.

    Marks of equal `at` count in the order of their payload; both sides name the position
    `at`; points without position meet nothing. With width (a length along the section that
    a task can hold) a section is spread over its cells.
    """
    side = "d" if direction == "backward" else "u"
    found = _met(points, marks, keys, at, payload, width, side)
    return found.select("__row.*", F.col(f"__{side}.at").alias("mark_at"), *[F.col(f"__{side}.{p}").alias(p) for p in payload])


def between(points: DataFrame, marks: DataFrame, keys: list[str], at: str, payload: list[str], width: float | None = None) -> DataFrame:
    """points with the nearest marks on both sides (as in asof): down_at, down_<payload>, up_at, up_<payload>."""
    found = _met(points, marks, keys, at, payload, width, "du")
    return found.select("__row.*", *[F.col(f"__{side[0]}.{p}").alias(f"{side}_{p}") for side in ("down", "up") for p in ("at", *payload)])


def interpolate(points: DataFrame, marks: DataFrame, keys: list[str], at: str, value: str, out: str, width: float | None = None) -> DataFrame:
    """points with the marks' value interpolated linearly at their position, clamped at both ends."""
    both = between(points, marks.select(*keys, at, F.col(value).alias("__v")), keys, at, ["__v"], width)
    a, b, va, vb = (F.col(c) for c in ("down_at", "up_at", "down___v", "up___v"))
    inside = F.when(a == b, va).otherwise(va + F.try_divide(F.col(at) - a, b - a) * (vb - va))
    return both.select(*points.columns, F.when(a.isNull(), vb).when(b.isNull(), va).otherwise(inside).alias(out))


def grid(spans: DataFrame, lo: str, hi: str, step: float, at: str) -> DataFrame:
    """Positions lo, lo + step, ... up to hi of each span; whole numbers are scaled, so that no step drifts."""
    last = F.floor((F.col(hi) - F.col(lo)) / step + 1e-9).cast("int")
    numbered = spans.where(F.col(lo).isNotNull() & (F.col(hi) >= F.col(lo))).withColumn("__i", F.explode(F.sequence(F.lit(0), last)))
    return numbered.withColumn(at, F.col(lo) + F.col("__i") * step).drop("__i")


def derivative(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, base: int, out: str, block: str | None = None) -> DataFrame:
    """(y after - y before) / (x after - x before) over `base` rows each way; rows near an end take the nearest full one."""

    def slopes(rows: DataFrame, w: WindowSpec) -> DataFrame:
        raw = F.try_divide(F.lead(y, base).over(w) - F.lag(y, base).over(w), F.lead(x, base).over(w) - F.lag(x, base).over(w))
        near = lambda f, a, b: f("__d", ignorenulls=True).over(w.rowsBetween(a, b))
        return rows.withColumn("__d", raw).withColumn(out, F.coalesce("__d", near(F.first, 0, base), near(F.last, -base, 0))).drop("__d")

    return in_frames(df, keys, order, 2 * base, block, slopes)


def gradient(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, out: str, block: str | None = None) -> DataFrame:
    """dy/dx of the second order on uneven positions, one-sided at both ends; 0 where it isn't defined."""

    def slopes(rows: DataFrame, w: WindowSpec) -> DataFrame:
        before, after = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
        down = F.try_divide(F.col(y) - F.lag(y).over(w), before)
        up = F.try_divide(F.lead(y).over(w) - F.col(y), after)
        parts = rows.withColumns({"__a": before, "__b": after, "__down": down, "__up": up})
        both = F.try_divide(F.col("__a") * F.col("__up") + F.col("__b") * F.col("__down"), F.col("__a") + F.col("__b"))
        return parts.withColumn(out, F.coalesce(both, "__up", "__down", F.lit(0.0))).drop("__a", "__b", "__down", "__up")

    return in_frames(df, keys, order, 1, block, slopes)


def unwrapped(df: DataFrame, keys: list[str], order: list[str], angle: str, out: str, block: str | None = None) -> DataFrame:
    """The angle (radians) without jumps of more than pi, from the section's first value."""
    step = F.col(angle) - F.col("__p")
    turn = F.coalesce(-2 * F.lit(3.141592653589793) * F.rint(step / (2 * 3.141592653589793)), F.lit(0.0))
    rows = previous(df, keys, order, angle, "__p", block)
    return running_sum(rows, keys, order, turn, "__turned", block).withColumn(out, F.col(angle) + F.col("__turned")).drop("__p", "__turned")


def decimated(df: DataFrame, keys: list[str], order: list[str], every: int, block: str | None = None) -> DataFrame:
    """Every n-th row of a section from its first, and its last."""
    rows = numbered(df, keys, order, "__i", block)
    last = lambda r, w: r.withColumn("__last", F.lead(F.lit(1)).over(w).isNull())
    if block is None:
        return last(rows, Window.partitionBy(*keys).orderBy("__i")).where((F.col("__i") % every == 0) | F.col("__last")).drop("__i", "__last")
    chunks = last(with_halo(rows, keys, "__i", 1), Window.partitionBy(*keys, "chunk").orderBy("__i"))
    return chunks.where("own").where((F.col("__i") % every == 0) | F.col("__last")).drop("__i", "__last", "chunk", "own")


def without_repeats(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Rows that differ from the row before in one of the columns; the first of a section stays."""
    before = previous(df.withColumn("__s", F.struct(*columns)), keys, order, "__s", "__p")
    return before.where(F.col("__p").isNull() | ~F.col("__p").eqNullSafe(F.col("__s"))).drop("__s", "__p")


def trapezoid_time(df: DataFrame, keys: list[str], order: list[str], x: str, v: str, out: str, floor: float = 0.1, block: str | None = None) -> DataFrame:
    """Hours from each row to the next at the mean of both speeds, `floor` at least; 0 in the last row."""

    def hours(rows: DataFrame, w: WindowSpec) -> DataFrame:
        mean = F.greatest((F.col(v) + F.lead(v).over(w)) / 2, F.lit(floor))
        return rows.withColumn(out, F.coalesce((F.lead(x).over(w) - F.col(x)) / mean, F.lit(0.0)))

    return in_frames(df, keys, order, 1, block, hours)


def suffix_min(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, block: str | None = None) -> DataFrame:
    """Least value of this row and all rows after it. Rows are read from the section's end, so the cost is linear."""
    backwards = [F.desc(c) for c in order]
    parts = [*keys, block] if block else keys
    local = df.withColumn(out, F.min(value).over(Window.partitionBy(*parts).orderBy(*backwards).rowsBetween(Window.unboundedPreceding, 0)))
    if block is None:
        return local
    later = Window.partitionBy(*keys).orderBy(F.desc(block)).rowsBetween(Window.unboundedPreceding, -1)
    carry = df.groupBy(*parts).agg(F.min(value).alias("__m")).select(*parts, F.min("__m").over(later).alias("__c"))
    return _carried(local, carry, parts).withColumn(out, F.least(out, "__c")).drop("__c")


def braking(df: DataFrame, keys: list[str], order: list[str], x_m: str, v_ms: str, brake: float, out: str, block: str | None = None) -> DataFrame:
    """Speeds from which each later limit is reached at constant braking: a suffix minimum of v2 + 2 b x."""
    rows = df.withColumn("__e", F.col(v_ms) * F.col(v_ms) + 2 * brake * F.col(x_m))
    least = suffix_min(rows, keys, order, "__e", "__l", block)
    return least.withColumn(out, F.sqrt(F.greatest(F.col("__l") - 2 * brake * F.col(x_m), F.lit(0.0)))).drop("__e", "__l")


def heading_by_distance(df: DataFrame, keys: list[str], at: str, x: str, y: str, reach: float, out: str, width: float | None = None) -> DataFrame:
    """Bearing (degrees) from the last point at least `reach` before a row to the first at least `reach` after it; a section's end points stand in near its ends."""
    marks = df.select(*keys, F.col(at).alias("__p"), F.struct(x, y).alias("__xy"))
    ends = marks.groupBy(*keys).agg(F.min_by("__xy", "__p").alias("__first"), F.max_by("__xy", "__p").alias("__last"))
    names = df.columns
    ahead = asof(df.withColumn("__p", F.col(at) + reach), marks, keys, "__p", ["__xy"], "forward", width).withColumnRenamed("__xy", "__b").drop("mark_at")
    both = asof(ahead.withColumn("__p", F.col(at) - reach), marks, keys, "__p", ["__xy"], width=width).withColumnRenamed("__xy", "__a").drop("mark_at").join(ends, keys)
    a, b = F.coalesce("__a", "__first"), F.coalesce("__b", "__last")
    return both.select(*names, F.pmod(F.degrees(F.atan2(b[x] - a[x], b[y] - a[y])) + 360, F.lit(360.0)).alias(out))


def deflection_gate(df: DataFrame, keys: list[str], order: list[str], heading: str, radius: str, half: int, least: float, out: str, block: str | None = None) -> DataFrame:
    """The radius where the unwrapped heading turns by `least` or more over `half` rows each way (cut at the ends), else infinite: a straight."""

    def gated(rows: DataFrame, w: WindowSpec) -> DataFrame:
        # where no row lies so far away, the section's end is in the frame
        before = F.coalesce(F.lag(heading, half).over(w), F.first(heading).over(w.rowsBetween(-half, 0)))
        after = F.coalesce(F.lead(heading, half).over(w), F.last(heading).over(w.rowsBetween(0, half)))
        return rows.withColumn(out, F.when(F.abs(after - before) >= least, F.col(radius)).otherwise(F.lit(float("inf"))))

    return in_frames(df, keys, order, half, block, gated)

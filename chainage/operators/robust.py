"""Rolling and weighted statistics that resist outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chainage.operators.linear import in_frames, running_sum
from chainage.sources.shared import checkpoint


def rolling_median(df: DataFrame, keys: list[str], order: list[str], column: str, half: int, out: str, block: str | None = None) -> DataFrame:
    """Median of the rows up to `half` before and after; frames are cut at the ends."""
    return in_frames(df, keys, order, half, block, lambda rows, w: rows.withColumn(out, F.percentile(column, F.lit(0.5)).over(w.rowsBetween(-half, half))))


def _padded(df: DataFrame, w: WindowSpec, column: str, half: int) -> tuple[DataFrame, Column]:
    """The values of a frame of 2 * half + 1 rows; the end values stand for rows beyond the ends."""
    frame = w.rowsBetween(-half, half)
    held = df.withColumn("__f", F.collect_list(F.struct(F.col(column).alias("v"))).over(frame))
    held = held.withColumn("__before", F.least(F.row_number().over(w) - 1, F.lit(half)))
    held = held.withColumn("__after", F.size("__f") - 1 - F.col("__before"))
    values = F.transform("__f", lambda s: s["v"])
    pad = F.concat(F.array_repeat(F.get(values, F.lit(0)), F.lit(half) - F.col("__before")), values, F.array_repeat(F.get(values, F.size("__f") - 1), F.lit(half) - F.col("__after")))
    return held.withColumn("__pad", pad), F.col("__pad")


_TEMPORARY = ("__f", "__before", "__after", "__pad")


def median_filter(df: DataFrame, keys: list[str], order: list[str], column: str, half: int, out: str, block: str | None = None) -> DataFrame:
    """Median of 2 * half + 1 values, the end values repeated beyond the ends."""

    def median(rows: DataFrame, w: WindowSpec) -> DataFrame:
        held, pad = _padded(rows, w, column, half)
        return held.withColumn(out, F.get(F.array_sort(pad), F.lit(half))).drop(*_TEMPORARY)

    return in_frames(df, keys, order, half, block, median)


def moving_average(df: DataFrame, keys: list[str], order: list[str], column: str, half: int, out: str, block: str | None = None) -> DataFrame:
    """Mean of 2 * half + 1 values, the end values repeated beyond the ends."""

    def mean(rows: DataFrame, w: WindowSpec) -> DataFrame:
        held, pad = _padded(rows, w, column, half)
        return held.withColumn(out, F.aggregate(pad, F.lit(0.0), lambda a, x: a + x) / (2 * half + 1)).drop(*_TEMPORARY)

    return in_frames(df, keys, order, half, block, mean)


def trailing_min(df: DataFrame, keys: list[str], order: list[str], column: str, rows: int, out: str, block: str | None = None) -> DataFrame:
    """Least value of this row and the rows before it, so many: a limit holds until a train's end has passed."""
    return in_frames(df, keys, order, rows, block, lambda r, w: r.withColumn(out, F.min(column).over(w.rowsBetween(-rows, 0))))


def neighbour_rank(df: DataFrame, keys: list[str], order: list[str], rank: str, half: int, out: str, block: str | None = None) -> DataFrame:
    """Upper median of a rank among the rows around, without the row itself; null without neighbours."""

    def around(rows: DataFrame, w: WindowSpec) -> DataFrame:
        near = F.sort_array(F.concat(F.collect_list(rank).over(w.rowsBetween(-half, -1)), F.collect_list(rank).over(w.rowsBetween(1, half))))
        return rows.withColumn("__n", near).withColumn(out, F.get("__n", F.floor(F.size("__n") / 2).cast("int"))).drop("__n")

    return in_frames(df, keys, order, half, block, around)


def harmonic_mean(x: Column, floor: float = 1e-6) -> Column:
    """Aggregate: n / sum(1 / x), with values of `floor` at least."""
    return F.try_divide(F.count(x), F.sum(1 / F.greatest(x, F.lit(floor))))


def weighted_harmonic(length: Column, speed: Column) -> Column:
    """Aggregate: whole length over whole time."""
    return F.try_divide(F.sum(length), F.sum(F.try_divide(length, speed)))


def lower_weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, out: str) -> DataFrame:
    """The first value, in ascending order, at which half of the weight is reached; one row per key.

    Weights are summed per distinct value before the window, so repeated values cost nothing.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    up = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    reached = sums.withColumn("__a", F.sum("__w").over(up)).withColumn("__t", F.sum("__w").over(whole)).where(F.col("__a") >= F.col("__t") / 2)
    return reached.groupBy(*keys).agg(F.min(value).alias(out))


def low_index_quantile(df: DataFrame, keys: list[str], column: str, share: float, out: str, least: int = 4) -> DataFrame:
    """s[int(share * (n - 1))] of the sorted values; null for fewer than `least`. By rank, so no group is held in memory."""
    w = Window.partitionBy(*keys).orderBy(column)
    ranked = df.where(F.col(column).isNotNull()).withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    at = F.floor(F.lit(share) * (F.col("__n") - 1))
    return ranked.groupBy(*keys).agg(F.max(F.when((F.col("__i") == at) & (F.col("__n") >= least), F.col(column))).alias(out))


def sustained_min(df: DataFrame, keys: list[str], order: list[str], column: str, half: int, out: str) -> DataFrame:
    """Least of the padded rolling medians of each key: a minimum that lasts."""
    return median_filter(df, keys, order, column, half, "__m").groupBy(*keys).agg(F.min("__m").alias(out))


def exact_quantiles(df: DataFrame, keys: list[str], column: str, shares: dict[str, float], bins: int = 1024) -> DataFrame:
    """(keys, n, one column for each share): quantiles, interpolated linearly, without a group in memory.

    Equal values of a key are counted first, map-side, so a key's rows never meet. The
    counts are summed up in the order of the values in two levels, inside bins of a key's
    range and over one row per bin; the values at the ranks sought are read off these sums.
    Nulls don't count; a key of nulls alone has no row.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("__value")).agg(F.count("*").alias("__count"))
    values = checkpoint(values)
    range_ = values.groupBy(*keys).agg(F.min("__value").alias("__lo"), F.max("__value").alias("__hi"), F.sum("__count").alias("n"))
    place = F.coalesce(F.floor(F.try_divide(F.col("__value") - F.col("__lo"), F.col("__hi") - F.col("__lo")) * bins), F.lit(0)).cast("long")
    upto = running_sum(values.join(range_, keys).withColumn("__bin", place), keys, ["__value"], F.col("__count"), "__upto", "__bin")
    at = {out: F.lit(q) * (F.col("n") - 1) for out, q in shares.items()}
    ends = [F.min(F.when(F.col("__upto") > f(at[out]), F.col("__value"))).alias(f"__{k}{i}") for i, out in enumerate(shares) for k, f in (("a", F.floor), ("b", F.ceil))]
    found = upto.groupBy(*keys, "n").agg(*ends)
    between = {out: F.col(f"__a{i}") + (at[out] - F.floor(at[out])) * (F.col(f"__b{i}") - F.col(f"__a{i}")) for i, out in enumerate(shares)}
    return found.select(*keys, "n", *[c.alias(out) for out, c in between.items()])

"""Tables with guaranteed shapes: cross-tabs, tranches, overwrites, timetable pairs, declared figures."""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainage.operators.linear import running_sum


def crosstab(df: DataFrame, row: str, column: str, row_values: list, column_values: list, measure: Column, total: str | None = None) -> DataFrame:
    """Long cross-tab (row, column, n) over both whole domains, zeros included; `total` names a row of whole columns."""
    spark = df.sparkSession
    domain = spark.createDataFrame([(r, c) for r in row_values for c in column_values], [row, column])
    sums = df.groupBy(row, column).agg(measure.alias("n"))
    if total is not None:
        sums = sums.unionByName(df.groupBy(column).agg(measure.alias("n")).withColumn(row, F.lit(total)))
        domain = domain.unionByName(spark.createDataFrame([(total, c) for c in column_values], [row, column]))
    return domain.join(sums, [row, column], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def pivoted(df: DataFrame, keys: list[str], column: str, values: list[str], measure: Column) -> DataFrame:
    """Wide table with a column for each value, zero where nothing is."""
    return df.groupBy(*keys).pivot(column, values).agg(measure).fillna(0, values)


def budget_tranches(df: DataFrame, cost: str, order: list[str], budgets: list[float], block: str | None = None) -> DataFrame:
    """Rows in order with their running cost, once for each budget that it fits.

    block: a column that grows with the order; the sum is then taken inside blocks and over
    one row per block, so that no task sees the whole table.
    """
    summed = running_sum(df, [], order, F.col(cost), "running", block)
    return summed.withColumn("budget", F.explode(F.array(*[F.lit(float(b)) for b in budgets]))).where("running <= budget")


def overwrite(df: DataFrame, fresh: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """df with columns replaced where fresh (one row per key) has a value."""
    new = fresh.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    return df.join(new, keys, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; order must end in a unique column."""
    return df.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__i = 1").drop("__i")


def pair_minutes(stops: DataFrame, trip: str, order: list[str], stop: str, at: str, a: str, b: str, repeats: str = "last", most: float = 1440.0) -> DataFrame:
    """(trip, minutes) between two stops of a trip, whichever comes first; of a repeated stop the first or last call counts.

    Two conditional aggregates per trip: no self-join.
    """
    pick = F.max_by if repeats == "last" else F.min_by
    call = lambda s: pick(F.struct(F.col(order[0]).alias("o"), F.col(at).alias("t")), F.when(F.col(stop) == s, F.struct(*order)))
    both = stops.where(F.col(stop).isin(a, b)).groupBy(trip).agg(call(a).alias("x"), call(b).alias("y")).where("x is not null and y is not null")
    minutes = F.when(F.col("x.o") <= F.col("y.o"), F.col("y.t") - F.col("x.t")).otherwise(F.col("x.t") - F.col("y.t"))
    return both.select(trip, minutes.alias("minutes")).where((F.col("minutes") > 0) & (F.col("minutes") < most))


def adjacent_minutes(stops: DataFrame, trip: str, order: list[str], stop: str, at: str, chosen: list[str]) -> DataFrame:
    """(trip, from_stop, to_stop, minutes) between calls that follow each other among the chosen stops."""
    w = Window.partitionBy(trip).orderBy(*order)
    own = stops.where(F.col(stop).isin(chosen))
    out = own.select(trip, F.col(stop).alias("from_stop"), F.lead(stop).over(w).alias("to_stop"), (F.lead(at).over(w) - F.col(at)).alias("minutes"))
    return out.where("to_stop is not null and from_stop <> to_stop")


class Figure(NamedTuple):
    """A declared figure: filters (column, operator, value), mode sum, count or median, and how it is published."""

    name: str
    filters: tuple[tuple[str, str, Any], ...] = ()
    column: str | None = None
    mode: str = "sum"
    group: tuple[str, ...] = ()
    published: float | None = None
    digits: int = 0
    tolerance: float = 0.0


def predicate(filters: tuple[tuple[str, str, Any], ...]) -> Column:
    """One compiler for all filters; an unknown operator is an error."""
    out = F.lit(True)
    for column, op, value in filters:
        c = F.col(f"`{column}`")
        match op:
            case "==":
                one = c == value
            case "in":
                one = c.isin(list(value))
            case "<":
                one = c < value
            case "<=":
                one = c <= value
            case ">":
                one = c > value
            case ">=":
                one = c >= value
            case "contains":
                one = F.contains(F.lower(c), F.lit(str(value).lower()))
            case _:
                raise ValueError(f"unknown operator {op!r}")
        out = out & F.coalesce(one, F.lit(False))
    return out


def evaluate(df: DataFrame, figure: Figure) -> DataFrame:
    """The figure's groups and value."""
    column = F.col(f"`{figure.column}`") if figure.column else None
    modes = {"sum": lambda: F.sum(column), "count": lambda: F.count("*"), "median": lambda: F.median(column)}
    if figure.mode not in modes:
        raise ValueError(f"unknown mode {figure.mode!r}")
    kept = df.where(predicate(figure.filters))
    value = modes[figure.mode]().cast("double").alias("value")
    return (kept.groupBy(*figure.group) if figure.group else kept).agg(value)


def verify(df: DataFrame, figures: list[Figure]) -> DataFrame:
    """One row per ungrouped figure: recomputed, published, whether they agree when rounded, within the tolerance. The table is read once for all of them."""

    def value(f: Figure) -> Column:
        kept = predicate(f.filters)
        column = F.col(f"`{f.column}`") if f.column else F.lit(1)
        modes = {"sum": lambda: F.sum(F.when(kept, column)), "count": lambda: F.count(F.when(kept, 1)), "median": lambda: F.median(F.when(kept, column))}
        if f.mode not in modes:
            raise ValueError(f"unknown mode {f.mode!r}")
        return F.round(modes[f.mode]().cast("double"), f.digits)

    once = df.agg(*[value(f).alias(f"f{k}") for k, f in enumerate(figures)])
    rows = [F.struct(F.lit(f.name).alias("figure"), F.col(f"f{k}").alias("recomputed"), F.lit(f.published).cast("double").alias("published"), (F.abs(F.col(f"f{k}") - F.lit(f.published).cast("double")) <= f.tolerance + 1e-9).alias("agrees")) for k, f in enumerate(figures)]
    return once.select(F.inline(F.array(*rows)))


def attribution(df: DataFrame, parts: list[str], total: str, rest: str) -> DataFrame:
    """Parts of a gain that add up to it: what they leave is `rest`; where they exceed the gain they shrink in proportion and nothing is left."""
    whole = sum((F.coalesce(F.col(p), F.lit(0.0)) for p in parts[1:]), F.coalesce(F.col(parts[0]), F.lit(0.0)))
    share = F.when(whole > F.col(total), F.try_divide(F.col(total), whole)).otherwise(F.lit(1.0))
    scaled = df.withColumn("__s", share).withColumn(rest, F.greatest(F.col(total) - whole, F.lit(0.0)))
    return scaled.withColumns({p: F.coalesce(F.col(p), F.lit(0.0)) * F.col("__s") for p in parts}).drop("__s")


def filtered_table(df: DataFrame, filters: tuple[tuple[str, str, Any], ...], sort: str, descending: bool = False, limit: int = 600) -> DataFrame:
    """The table explorer: filters, nulls last in both directions, and at most `limit` rows (a feature of the view)."""
    by = F.col(f"`{sort}`")
    ties = [c for c in df.columns if c != sort]
    return df.where(predicate(filters)).orderBy(by.desc_nulls_last() if descending else by.asc_nulls_last(), *ties).limit(limit)


def contained(long: DataFrame, short: DataFrame, long_col: str, short_col: str, q: int = 3) -> DataFrame:
    """Pairs of rows where long_col contains short_col; null contains nothing, and the empty string is in all.

    Candidates share the first q characters of short_col with some place of long_col, so
    only texts that have a beginning in common meet; strings under q characters meet under
    their own length.
    """
    sizes = F.sequence(F.lit(1), F.lit(q))
    n = F.length(long_col)
    places = F.flatten(F.transform(sizes, lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col(long_col), i, k))).otherwise(F.array().cast("array<string>"))))
    keyed = long.where(F.col(long_col).isNotNull()).withColumn("__g", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), places))))
    begun = short.where(F.col(short_col).isNotNull()).withColumn("__g", F.substring(F.col(short_col), 1, q))
    return keyed.join(begun, "__g").where(F.col(long_col).contains(F.col(short_col))).drop("__g")

"""Which crossings stand in the way of a higher cap: real speeds there, minutes that each fast run of a line would give back, and what budgets buy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainage.functions import curves
from chainage.functions.traction import TILTING, Train, accelerator
from chainage.operators import intervals, linear, sequences, tables
from chainage.plans import engines, travel
from chainage.plans.registry import query, track
from chainage.sources.shared import checkpoint

#: Published and raised cap in km/h, what a train must exceed the first by, millions for a bridge and a private crossing, metres around a run.
CAP, RAISED, EXCESS = 177.0, 201.0, 0.5
BRIDGE, PRIVATE, AROUND = 50, 12, 200.0
#: Budgets in millions, each with what the ones before it bought.
BUDGETS = (500, 2000, 4000, 99_000)


def gains(samples: DataFrame, keys: list[str], x_m: str, base: str, high: str, group: str, train: Train, grade: str | None = None, at_once: int = 32) -> DataFrame:
    """(keys, group, minutes): minutes that a stretch is faster by when the limits (km/h) of one group of its samples rise from base to high.

    Samples whose group is null keep their base. A train rests at both ends and is limited
    by its power forwards and its brakes backwards. A task holds one stretch, `at_once`
    times; all groups of a stretch advance together in parts of so many.
    """
    types = dict(samples.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", {group} long, minutes double"
    pull = accelerator((train,))

    def spent(limit: np.ndarray, x: np.ndarray, rise: np.ndarray) -> np.ndarray:
        limit = limit / 3.6
        limit[:, [0, -1]] = 0.0
        v = sequences.forward_speeds(limit, x, rise, pull)
        reach = 2 * train.brake_ms2 * x
        back = np.minimum.accumulate((v * v + reach)[:, ::-1], axis=1)[:, ::-1] - reach
        v = np.minimum(v, np.sqrt(np.maximum(back, 0.0)))
        return (np.diff(x) / np.maximum((v[:, 1:] + v[:, :-1]) / 2, 0.5)).sum(axis=1) / 60

    def rule(p: dict[str, np.ndarray]) -> list[tuple]:
        x, own, low, top = p[x_m], [p[c][0] for c in keys], p[base], p[high]
        rise = p[grade] if grade else np.zeros(len(x))
        found = np.unique(p["__group"][p["__named"]])
        if not len(found):
            return []
        now = spent(low[None].copy(), x, rise)[0]
        out = []
        for k in range(0, len(found), at_once):
            some = found[k : k + at_once]
            raised = (p["__group"] == some[:, None]) & p["__named"]
            out += zip(some.tolist(), (now - spent(np.where(raised, top, low), x, rise)).tolist(), strict=True)
        return [(*own, *r) for r in out]

    rows = samples.select(*keys, x_m, base, high, F.coalesce(F.col(group).cast("long"), F.lit(0)).alias("__group"), F.col(group).isNotNull().alias("__named"), *([grade] if grade else []))
    return sequences.per_small_key(rows, keys, [x_m], schema, rule)


def works(samples: DataFrame, crossings: DataFrame, keys: list[str], x_m: str, order: list[str], block: str, width: float) -> tuple[DataFrame, DataFrame]:
    """Fast runs as works, and the samples with the run that they lie in.

    samples: (keys, x_m, v = what the line allows in km/h, grade). crossings: (keys, x_m,
    private). A work is a run of samples that allow more than CAP: (keys, run, lo, hi,
    minutes, bridges, private, cost). Only crossings at which the train would really
    exceed CAP have to go; minutes are those that the run gives back alone.
    """
    rows = samples.withColumns({"base": F.least("v", F.lit(CAP)), "high": F.least("v", F.lit(RAISED)), "fast": F.col("v") > CAP})
    rows = linear.islands(rows, keys, order, "fast", "run", block).withColumn("run", F.when(F.col("fast"), F.col("run")))
    # read by five branches below; stretches that are nowhere fast have no works
    rows = checkpoint(rows.withColumn("__any", F.max("fast").over(Window.partitionBy(*keys))).where("__any").drop("__any"))
    found = rows.where("fast").groupBy(*keys, "run").agg(F.min(x_m).alias("lo"), F.max(x_m).alias("hi"))
    profiles = engines.speed_profiles(rows.withColumn("__limit", F.col("high") * F.col("high")), keys, x_m, "__limit", 1.0, RAISED, TILTING, "grade")
    met = engines.speeds_at(crossings.join(found.select(*keys).distinct(), keys, "left_semi"), checkpoint(profiles), keys, x_m, width)
    met = met.where(F.col("top_ms") * 3.6 > CAP + EXCESS).select(*keys, x_m, "private")
    spans = found.withColumns({"__lo": F.col("lo") - AROUND, "__hi": F.col("hi") + AROUND})
    counts = intervals.points_in(met, spans, keys, x_m, width, ("__lo", "__hi"), closed=True).groupBy(*keys, "run").agg(F.count(F.when(~F.col("private"), 1)).alias("bridges"), F.count(F.when(F.col("private"), 1)).alias("private"))
    out = found.join(gains(rows, keys, x_m, "base", "high", "run", TILTING, "grade"), [*keys, "run"]).join(counts, [*keys, "run"], "left").fillna(0, ["bridges", "private"])
    return out.withColumns({"minutes": F.round("minutes", 6), "cost": F.col("bridges") * BRIDGE + F.col("private") * PRIVATE}), rows


def chosen(found: DataFrame, keys: list[str], budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """Works bought by each budget: most minutes for their cost first, ties by keys and run, as long as all before fit too."""
    ratio = F.col("minutes") / F.when(F.col("cost") == 0, 1e-6).otherwise(F.col("cost") / 1000)
    ranked = found.withColumn("__rank", -ratio)
    # grows with the rank, some hundred values whatever the number of works
    ranked = ranked.withColumn("__band", F.signum("__rank") * F.floor(16 * F.log2(1 + F.abs("__rank"))))
    return tables.budget_tranches(ranked, "cost", ["__rank", *keys, "run"], list(budgets), "__band").drop("__rank", "__band")


def bought(works_of: DataFrame, rows: DataFrame, keys: list[str], x_m: str) -> DataFrame:
    """(budget, works, bridges, private, cost, minutes) of chosen works; minutes are those of all of a budget's works at once."""
    picked = works_of.select(*keys, "run", "budget")
    each = rows.join(picked.select(*keys, "budget").distinct(), keys).join(picked.withColumn("__in", F.lit(1)), [*keys, "run", "budget"], "left")
    minutes = gains(each, [*keys, "budget"], x_m, "base", "high", "__in", TILTING, "grade").groupBy("budget").agg(F.sum("minutes").alias("minutes"))
    sums = works_of.groupBy("budget").agg(F.count("*").alias("works"), *[F.sum(c).alias(c) for c in ("bridges", "private", "cost")])
    return sums.join(minutes, "budget")


_OWN = ["user_id", "stretch"]


def _works(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line = track(spark, sf_dir).select("user_id", "event_id", "event_type", "us", "day", "h", "r", (F.col("h") * 1000).alias("x"), (F.col("value") / 50).alias("z"))
    graded = travel.grades(line, ["user_id"], "x", "z").withColumn("v", F.least(engines.CANT_SETS[1].coefficient * F.sqrt("r"), F.lit(curves.LIMIT_KMH).cast("double")))
    tr = checkpoint(engines.stretches(graded, 12.0))
    ahead = F.lead("x").over(Window.partitionBy(*_OWN).orderBy("us"))
    crossings = tr.withColumn("b", ahead).where("event_type in ('error', 'signup') and b is not null").select(*_OWN, ((F.col("x") + F.col("b")) / 2).alias("x"), (F.col("event_type") == "signup").alias("private"))
    return works(tr, crossings, _OWN, "x", ["us"], "day", 240_000.0)


def _moved_sql(name: str, source: str, keys: str) -> str:
    """Recursive speeds of the rows of `source` (keys, j from 1, x, grade, lim), and with braking, as SQL."""
    same = " AND ".join(f"s.{k} = f.{k}" for k in keys.split(", "))
    listed, brake = ", ".join(f"s.{k}" for k in keys.split(", ")), f"2 * {TILTING.brake_ms2}::DOUBLE * x"
    step = engines._acceleration_sql(TILTING, "f.v", "s.grade")
    return f"""{name}0 AS (SELECT {keys}, j, x, 0.0::DOUBLE AS v FROM {source} WHERE j = 1
 UNION ALL SELECT {listed}, s.j, s.x, least(s.lim, sqrt(greatest(1.0::DOUBLE, f.v * f.v + 2 * {step} * (s.x - f.x)))) FROM {name}0 f JOIN {source} s ON {same} AND s.j = f.j + 1),
{name}1 AS (SELECT *, min(v * v + {brake}) OVER (PARTITION BY {keys} ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - {brake} AS back FROM {name}0),
{name} AS (SELECT {keys}, j, x, least(v, sqrt(greatest(back, 0))) AS v FROM {name}1),
{name}t0 AS (SELECT {keys}, coalesce((lead(x) OVER w - x) / greatest((v + lead(v) OVER w) / 2, 0.5), 0) AS t FROM {name} WINDOW w AS (PARTITION BY {keys} ORDER BY j)),
{name}t AS (SELECT {keys}, sum(t) / 60 AS minutes FROM {name}t0 GROUP BY ALL)"""


_WORKS = (
    engines._GRADED.replace("z3 AS (SELECT user_id, i, x, r,", "z3 AS (SELECT user_id, i, x, r, event_type,").replace("z2 AS (SELECT z0.user_id, i,", "z2 AS (SELECT z0.user_id, i, event_type,").replace("z0 AS (SELECT user_id, h,", "z0 AS (SELECT user_id, event_type, h,")
    + f"""y0 AS (SELECT *, row_number() OVER w AS j, count(*) OVER (PARTITION BY user_id, stretch) AS n, lead(x) OVER w AS x1, least({engines.CANT_SETS[1].coefficient!r}::DOUBLE * sqrt(r), 360) AS v FROM z3 WINDOW w AS (PARTITION BY user_id, stretch ORDER BY i)),
y1 AS (SELECT *, least(v, {CAP}) AS base, least(v, {RAISED}) AS high, v > {CAP} AS fast FROM y0), y2 AS (SELECT *, CAST(fast IS DISTINCT FROM lag(fast) OVER (PARTITION BY user_id, stretch ORDER BY j) AS INTEGER) AS f FROM y1),
y AS (SELECT * EXCLUDE (f), CASE WHEN fast THEN CAST(sum(f) OVER (PARTITION BY user_id, stretch ORDER BY j) AS BIGINT) END AS run FROM y2),
k0 AS (SELECT user_id, stretch, run, min(x) AS lo, max(x) AS hi FROM y WHERE fast GROUP BY ALL),
g0 AS (SELECT user_id, stretch, run AS g, 1 AS way FROM k0 UNION ALL SELECT DISTINCT user_id, stretch, g, way FROM k0, (VALUES (0, 1), (-1, 1), (-1, -1)) t(g, way)),
s0 AS (SELECT y.user_id, y.stretch, g, way, CASE way WHEN 1 THEN j ELSE n - j + 1 END AS j, way * x AS x, way * grade AS grade, CASE WHEN j IN (1, n) THEN 0.0::DOUBLE WHEN g = -1 OR run = g THEN high / 3.6 ELSE base / 3.6 END AS lim FROM y JOIN g0 USING (user_id, stretch)),
{_moved_sql("m", "s0", "user_id, stretch, g, way")},
c0 AS (SELECT user_id, stretch, event_type = 'signup' AS private, x AS a, x1 AS b, (x + x1) / 2 AS x FROM y WHERE event_type IN ('error', 'signup') AND x1 IS NOT NULL),
c1 AS (SELECT c0.user_id, c0.stretch, private, c0.x, c0.a, p.way, p.v + (c0.x - a) / (b - a) * (q.v - p.v) AS v FROM c0 JOIN m p ON p.g = -1 AND p.user_id = c0.user_id AND p.stretch = c0.stretch AND p.way * p.x = c0.a JOIN m q ON q.g = -1 AND q.user_id = c0.user_id AND q.stretch = c0.stretch AND q.way * q.x = c0.b AND q.way = p.way),
c AS (SELECT user_id, stretch, private, x FROM c1 GROUP BY user_id, stretch, private, x, a HAVING max(v) * 3.6 > {CAP + EXCESS}),
k1 AS (SELECT k0.user_id, k0.stretch, run, count(*) FILTER (NOT private) AS bridges, count(*) FILTER (private) AS private FROM k0 JOIN c ON c.user_id = k0.user_id AND c.stretch = k0.stretch AND c.x BETWEEN lo - {AROUND} AND hi + {AROUND} GROUP BY ALL),
k AS (SELECT k0.*, round(o.minutes - a.minutes, 6) AS minutes, coalesce(bridges, 0) AS bridges, coalesce(private, 0) AS private, coalesce(bridges, 0) * {BRIDGE} + coalesce(private, 0) * {PRIVATE} AS cost
 FROM k0 JOIN mt a ON a.user_id = k0.user_id AND a.stretch = k0.stretch AND a.g = k0.run AND a.way = 1 JOIN mt o ON o.user_id = k0.user_id AND o.stretch = k0.stretch AND o.g = 0 LEFT JOIN k1 ON k1.user_id = k0.user_id AND k1.stretch = k0.stretch AND k1.run = k0.run)
"""
)


@query(_WORKS + "SELECT user_id, stretch, run, round(lo, 3) AS lo, round(hi, 3) AS hi, minutes, bridges, private, CAST(cost AS BIGINT) AS cost FROM k")
def elimination_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that allow more than the published cap, the crossings that have to go for them, and the minutes that each gives back."""
    found, _ = _works(spark, sf_dir)
    return found.select(*_OWN, "run", F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"), "minutes", "bridges", "private", "cost")


@query(_WORKS + f""", t0 AS (SELECT *, sum(cost) OVER (ORDER BY minutes / CASE WHEN cost = 0 THEN 1e-6::DOUBLE ELSE cost / 1000 END DESC, user_id, stretch, run ROWS UNBOUNDED PRECEDING) AS running FROM k),
t AS (SELECT t0.*, budget FROM t0, (VALUES {", ".join(f"({b})" for b in BUDGETS)}) b(budget) WHERE running <= budget), q AS (SELECT DISTINCT user_id, stretch, budget FROM t),
s1 AS (SELECT y.user_id, y.stretch, q.budget, side, j, y.x, y.grade, CASE WHEN j IN (1, n) THEN 0.0::DOUBLE WHEN side = 1 AND t.run IS NOT NULL THEN high / 3.6 ELSE base / 3.6 END AS lim FROM y JOIN q USING (user_id, stretch) CROSS JOIN (VALUES (0), (1)) d(side) LEFT JOIN t ON t.user_id = y.user_id AND t.stretch = y.stretch AND t.run = y.run AND t.budget = q.budget),
{_moved_sql("b", "s1", "user_id, stretch, budget, side")}, e AS (SELECT budget, sum(CASE side WHEN 0 THEN minutes ELSE -minutes END) AS minutes FROM bt GROUP BY budget)
SELECT CAST(budget AS BIGINT) AS budget, count(*) AS works, CAST(sum(bridges) AS BIGINT) AS bridges, CAST(sum(private) AS BIGINT) AS private, CAST(sum(cost) AS BIGINT) AS cost, round(any_value(e.minutes), 4) AS minutes FROM t JOIN e USING (budget) GROUP BY budget""")
def elimination_programme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each budget buys: works in order of minutes for their cost, and the minutes that all of them give back together."""
    found, rows = _works(spark, sf_dir)
    out = bought(checkpoint(chosen(checkpoint(found), _OWN)), rows, _OWN, "x")
    return out.select(F.col("budget").cast("long").alias("budget"), "works", "bridges", "private", "cost", F.round("minutes", 4).alias("minutes"))

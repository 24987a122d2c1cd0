"""Acceleration under limited power, as one law of six coefficients per trainset.

    a = min(start, pull / v - c0 - c1 v - c2 v2 - weight * grade),   v in m/s, 1 at least

`law` works the coefficients out from a trainset's data, `with_law` does the same for a table
of trainsets; `acceleration` evaluates the law for numbers and arrays, `accelerating` and
`balancing_kmh` as columns.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Drag in N is DRAG * area (m2) * v2 (km/h); gravity in m/s2.
DRAG, GRAVITY = 0.0463, 9.81
KMH = 3.6


class Train(NamedTuple):
    """A trainset's data. rolling (N per loaded tonne) and rolling_v (the same per km/h) are its rolling resistance; load and rotating scale its mass for passengers and for rotating parts."""

    name: str
    power_kw: float
    mass_t: float
    hotel_kw: float
    efficiency: float
    drag_area_m2: float
    length_m: float
    start_ms2: float
    brake_ms2: float
    load: float = 1.06
    rotating: float = 1.04
    rolling: float = 12.0
    rolling_v: float = 0.06


class Law(NamedTuple):
    start: float
    pull: float
    c0: float
    c1: float
    c2: float
    weight: float


def _coefficients(t, lift=lambda x: x) -> dict:
    """The law from anything that has a trainset's fields as attributes or keys: numbers or columns."""
    of = t if isinstance(t, dict) else t._asdict()
    inertia = of["mass_t"] * of["load"] * of["rotating"] * 1000  # kg that are accelerated
    at_rail = (of["power_kw"] - of["hotel_kw"]) * of["efficiency"] * 1000
    return {
        "start": of["start_ms2"],
        "pull": at_rail / inertia,
        "c0": of["rolling"] / (of["rotating"] * 1000),
        "c1": of["rolling_v"] * KMH / (of["rotating"] * 1000),
        "c2": of["drag_area_m2"] * (DRAG * KMH * KMH) / inertia,
        "weight": lift(GRAVITY) / of["rotating"],
    }


def law(train: Train) -> Law:
    return Law(**_coefficients(train))


def acceleration(train: Train, v_ms: float, grade: float = 0.0) -> float:
    """Of one trainset at one speed on a grade (rise over run); negative where it slows down."""
    return float(accelerator((train,))(np.array([v_ms]), grade)[0])


def accelerator(trains: tuple[Train, ...]) -> Callable:
    """The accelerations of several trains at a time: from an array of their speeds, and the grade, to an array."""
    start, pull, c0, c1, c2, weight = np.array([law(t) for t in trains], np.float64).T

    def at(v_ms: np.ndarray, grade: float = 0.0) -> np.ndarray:
        v = np.maximum(v_ms, 1.0)
        return np.minimum(start, pull / v - c0 - c1 * v - c2 * v * v - weight * grade)

    return at


def with_law(trains: DataFrame) -> DataFrame:
    """A table of trainsets (the fields of Train as columns) with the law's coefficients."""
    return trains.withColumns(_coefficients({f: F.col(f) for f in Train._fields}, F.lit))


def law_columns(train: Train) -> dict[str, Column]:
    """The law of one trainset as literals, for tables that hold no trainsets."""
    return {k: F.lit(x) for k, x in law(train)._asdict().items()}


def accelerating(v_ms: Column, grade: Column | float = 0.0, of: dict[str, Column] | None = None) -> Column:
    """The law as a column, its coefficients those of `of` or the row's own."""
    c = of or {k: F.col(k) for k in Law._fields}
    v = F.greatest(v_ms, F.lit(1.0))
    return F.least(c["start"], c["pull"] / v - c["c0"] - c["c1"] * v - c["c2"] * v * v - c["weight"] * grade)


def balancing_kmh(grade: Column | float = 0.0, of: dict[str, Column] | None = None, top: float = 600.0, halvings: int = 60) -> Column:
    """Speed at which pull and resistance balance, by halving the range from 0 to top, as a column."""

    def half(acc: Column, _: Column) -> Column:
        mid = (acc["low"] + acc["high"]) / 2
        gains = accelerating(mid / KMH, grade, of) > 0
        return F.struct(F.when(gains, mid).otherwise(acc["low"]).alias("low"), F.when(gains, acc["high"]).otherwise(mid).alias("high"))

    ends = F.struct(F.lit(0.0).alias("low"), F.lit(top).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), ends, half, lambda acc: acc["low"])


def seconds_to(train: Train, target_kmh: float, step_s: float = 0.1, limit_s: float = 3600.0) -> float:
    """Time from rest to a speed, by steps; infinite if it isn't reached."""
    at, v, t = accelerator((train,)), 0.5, 0.0
    while v * KMH < target_kmh:
        a = float(at(np.array([v]))[0])
        if a <= 1e-4 or t > limit_s:
            return float("inf")
        v, t = v + a * step_s, t + step_s
    return t


#: A locomotive-hauled train, a tilting diesel-electric trainset, and two coupled diesel units whose times from rest are known (60, 170 and 313 s to 60, 100 and 125 mph).
LOCO = Train("locomotive and five cars", 3132, 374, 200, 0.88, 13.0, 152, 0.5, 0.5)
TILTING = Train("tilting trainset", 9.8 * 282, 282, 200, 0.88, 11.0, 116, 0.6, 0.6)
COUPLED = Train("two coupled diesel units", 5220, 564, 200, 0.88, 18.0, 232, 0.6, 0.6, load=1.0)

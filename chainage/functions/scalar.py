"""Units, angles, distances, times and safe conversions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: Exact definitions of the units.
KM_PER_MILE, MM_PER_INCH, FEET_PER_CHORD = 1.609344, 25.4, 100
CHORD_HALF_M = 15.24


def kmh_to_mph(v: Column) -> Column:
    return v / KM_PER_MILE


def mph_to_kmh(v: Column) -> Column:
    return v * KM_PER_MILE


def mm_to_inch(x: Column) -> Column:
    return x / MM_PER_INCH


def inch_to_mm(x: Column) -> Column:
    return x * MM_PER_INCH


def m_to_mile(x: Column) -> Column:
    return x / (1000 * KM_PER_MILE)


def km_to_mile(x: Column) -> Column:
    return x / KM_PER_MILE


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    """x within [low, high]; null stays null, which least and greatest alone would replace by a bound."""
    low, high = (b if isinstance(b, Column) else F.lit(b) for b in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits, halves away from zero, judged on x times the power of ten as SQL engines on doubles do (F.round judges the decimal form)."""
    return F.round(x * 10.0**digits) / 10.0**digits


def safe_number(x: Column, kind: str = "double") -> Column:
    """The number that a string holds, else null."""
    return F.trim(x).try_cast(kind)


def safe_ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """a / b, and `empty` where b is zero or either is null."""
    out = F.try_divide(a, b)
    return out if empty is None else F.coalesce(out, F.lit(empty))


def degree_of_curve(radius_m: Column) -> Column:
    """Central angle of a 100-foot chord in degrees: 0 for a straight, 180 for a radius no chord fits."""
    share = F.lit(CHORD_HALF_M) / radius_m
    return F.when(radius_m.isNull(), None).when(radius_m == float("inf"), 0.0).when(radius_m <= CHORD_HALF_M, 180.0).otherwise(2 * F.degrees(F.asin(F.least(share, F.lit(1.0)))))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    # least alone would take 1 for a null
    return F.when(a.isNotNull(), 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(a, F.lit(1.0)))))


def bearing_deg(dx: Column, dy: Column) -> Column:
    """Clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(dx, dy)) + 360, F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """Unsigned angle of two bearings, in [0, 180]."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360 - d)


def angle_folded(a: Column, b: Column) -> Column:
    """Unsigned angle of two undirected lines, in [0, 90]."""
    d = angle_between(a, b)
    return F.least(d, 180 - d)


def wrapped(rad: Column) -> Column:
    """The same angle in (-pi, pi]."""
    return F.atan2(F.sin(rad), F.cos(rad))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_epsg(lon: Column) -> Column:
    """EPSG code of the northern zone."""
    return F.lit(32600) + utm_zone(lon)


def equirectangular(lat: Column, lon: Column, lat0: float) -> tuple[Column, Column]:
    """Plane x and y in metres about the latitude lat0."""
    return F.radians(lon) * EARTH_RADIUS_M * F.cos(F.radians(F.lit(lat0))), F.radians(lat) * EARTH_RADIUS_M


def from_equirectangular(x: Column, y: Column, lat0: float) -> tuple[Column, Column]:
    return F.degrees(y / EARTH_RADIUS_M), F.degrees(x / (EARTH_RADIUS_M * F.cos(F.radians(F.lit(lat0)))))


def transverse_mercator(lat: Column, lon: Column, lon0: Column) -> tuple[Column, Column]:
    """UTM easting and northing in metres (WGS 84, northern half), by Krueger's series to the third order in n."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - lon0)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = reduce(lambda a, k: a + alpha[k - 1] * F.cos(2 * k * xi) * F.sinh(2 * k * eta), (1, 2, 3), eta)
    north = reduce(lambda a, k: a + alpha[k - 1] * F.sin(2 * k * xi) * F.cosh(2 * k * eta), (1, 2, 3), xi)
    return 500000 + 0.9996 * radius * east, 0.9996 * radius * north


def from_transverse_mercator(east: Column, north: Column, lon0: Column) -> tuple[Column, Column]:
    """Latitude and longitude of UTM metres (WGS 84, northern half): the inverse series to the third order in n."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = north / (0.9996 * radius), (east - 500000) / (0.9996 * radius)
    up = reduce(lambda a, k: a - beta[k - 1] * F.sin(2 * k * xi) * F.cosh(2 * k * eta), (1, 2, 3), xi)
    out = reduce(lambda a, k: a - beta[k - 1] * F.cos(2 * k * xi) * F.sinh(2 * k * eta), (1, 2, 3), eta)
    chi = F.asin(F.sin(up) / F.cosh(out))
    phi = reduce(lambda a, k: a + delta[k - 1] * F.sin(2 * k * chi), (1, 2, 3), chi)
    return F.degrees(phi), lon0 + F.degrees(F.atan2(F.sinh(out), F.cos(up)))


def _pieces(line: str) -> Column:
    """Pieces (a, b, d) of a column of points (x, y): both ends and the length between them."""
    ends = F.arrays_zip(F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))).alias("a"), F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))).alias("b"))
    return F.transform(ends, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"]).alias("d")))


def line_length(line: str) -> Column:
    """Length of a line (column of an array of points x, y); 0 for fewer than two points, null for null."""
    return F.aggregate(_pieces(line), F.lit(0.0), lambda s, p: s + p["d"])


def along_line(line: str, distance: Column) -> Column:
    """The point (x, y) of a line at a distance from its first point, clamped at both ends; null for lines without points or a null distance."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    first = F.get(line, F.lit(0))

    def step(s: Column, p: Column) -> Column:
        share = F.greatest(F.least(F.try_divide(distance - s["s"], p["d"]), F.lit(1.0)), F.lit(0.0))
        ahead = (p["d"] > 0) & (distance > s["s"])
        at = F.when(ahead, point(p["a"]["x"] + share * (p["b"]["x"] - p["a"]["x"]), p["a"]["y"] + share * (p["b"]["y"] - p["a"]["y"]))).otherwise(s["at"])
        return F.struct((s["s"] + p["d"]).alias("s"), at.alias("at"))

    start = F.struct(F.lit(0.0).alias("s"), point(first["x"], first["y"]).alias("at"))
    return F.when(distance.isNotNull() & first.isNotNull(), F.aggregate(_pieces(line), start, step, lambda s: s["at"]))


def place_on_line(line: str, x: Column, y: Column) -> Column:
    """(at, off): how far along a line the place nearest to (x, y) is, the first of equals, and how far away; null for lines without a piece."""

    def step(s: Column, p: Column) -> Column:
        dx, dy = p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"]
        t = F.greatest(F.least(F.coalesce(F.try_divide((x - p["a"]["x"]) * dx + (y - p["a"]["y"]) * dy, p["d"] * p["d"]), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
        off = F.hypot(x - p["a"]["x"] - t * dx, y - p["a"]["y"] - t * dy)
        nearer = s["off"].isNull() | (off < s["off"])
        return F.struct((s["s"] + p["d"]).alias("s"), F.when(nearer, s["s"] + t * p["d"]).otherwise(s["at"]).alias("at"), F.when(nearer, off).otherwise(s["off"]).alias("off"))

    nothing = F.lit(None).cast("double")
    start = F.struct(F.lit(0.0).alias("s"), nothing.alias("at"), nothing.alias("off"))
    return F.aggregate(_pieces(line), start, step, lambda s: F.when(s["off"].isNotNull(), F.struct(s["at"].alias("at"), s["off"].alias("off"))))


def in_buffer(line: str, x: Column, y: Column, radius: float) -> Column:
    """Whether (x, y) lies within a radius of a line: its round buffer as a predicate."""
    return place_on_line(line, x, y)["off"] <= radius


def minutes_of_day(hms: Column) -> Column:
    """Minutes of 'HH:MM:SS', whose hour may be 24 or more; null for anything else."""
    part = F.split(F.trim(hms), ":")
    sound = F.size(part) == 3
    h, m, s = (F.get(part, i).try_cast("double") for i in range(3))
    return F.when(sound, h * 60 + m + s / 60)


def hour_minute(minutes: Column) -> Column:
    """'h:mm', rounded to the minute before it is split."""
    whole = F.round(minutes).cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60), F.pmod(whole, F.lit(60)))


def decimal_comma(x: Column, digits: int) -> Column:
    """Fixed digits, a comma as decimal sign and blanks between thousands."""
    return F.translate(F.format_number(x, digits), ",.", " ,")


def track_number(tag: Column) -> Column:
    """Tracks named by a tag: single, multiple or several, or an integer; else null."""
    t = F.lower(F.trim(tag))
    return F.when(t == "single", 1).when(t.isin("multiple", "several"), 2).otherwise(t.try_cast("int"))


def without_accents(x: Column) -> Column:
    """Lower case, and e for its accented forms; the other letters keep their marks."""
    return F.translate(F.lower(F.trim(x)), "éè", "ee")


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp's own clock since 1970, whatever the session's zone."""
    days = F.unix_date(ts.cast("date")).cast("long")
    seconds = F.extract(F.lit("SECOND"), ts) * 1_000_000
    return days * 86_400_000_000 + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + seconds.cast("long")


def search_sorted(x: Column, bounds: list[float], right: bool = False) -> Column:
    """Number of ascending bounds below x (right: at or below x); null for null."""
    below = [(F.lit(b) <= x if right else F.lit(b) < x).cast("int") for b in bounds]
    return reduce(lambda a, b: a + b, below, F.when(x.isNotNull(), F.lit(0)))


def looked_up(x: Column, entries: dict, default=None) -> Column:
    """Value of x in a fixed dictionary, else the default; null takes the default too."""
    if not entries:
        return F.lit(default)
    pairs = F.create_map(*[F.lit(v) for kv in entries.items() for v in kv])
    return F.coalesce(F.try_element_at(pairs, F.coalesce(x, F.lit(None))), F.lit(default))

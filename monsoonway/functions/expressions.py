"""Column expressions: surfaces, speeds, rain penalties, weeks, cells and damage classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flood depth in metres from which a severity holds.
FLOOD_METRES = {"minor": 0.1, "moderate": 0.2, "severe": 0.3, "catastrophic": 0.5}
# Fixed values: (share of speed lost, days closed) of a severity.
SEVERITY_EFFECTS = {"minor": (0.05, 0), "moderate": (0.15, 0), "severe": (0.0, 7), "catastrophic": (0.0, 90)}
EARTH_KM = 6371.0088
MERCATOR_RADIUS = 6378137.0

# Base speed in km/h by highway class; any other class gets OTHER_SPEED.
HIGHWAY_SPEEDS = {"motorway": 100.0, "trunk": 80.0, "primary": 65.0, "secondary": 50.0, "tertiary": 40.0, "residential": 25.0}
OTHER_SPEED = 30.0
# Speed factor by surface.
SURFACE_FACTORS = {"unpaved": 0.75, "unknown": 0.85, "paved": 1.0}
# Fixed values: (road type, from mm, below mm, speed multiplier); no upper bound is infinity.
RAIN_RULES = (
    ("paved", 0.0, 50.0, 1.00), ("paved", 50.0, 100.0, 0.90), ("paved", 100.0, 200.0, 0.75), ("paved", 200.0, 300.0, 0.40), ("paved", 300.0, None, 0.05),
    ("unpaved", 0.0, 50.0, 1.00), ("unpaved", 50.0, 100.0, 0.70), ("unpaved", 100.0, 150.0, 0.45), ("unpaved", 150.0, 250.0, 0.20), ("unpaved", 250.0, None, 0.05),
)
LEAST_MULTIPLIER = 0.01
# Minutes of delay that start damage classes 1 to 5.
DAMAGE_MINUTES = (180, 360, 540, 720, 1440)
# Highway classes that no truck takes.
NO_TRUCKS = ("footway", "path", "steps", "pedestrian", "cycleway", "bridleway", "living_street")
# Fixed values: (from hours, below hours, name).
DELAY_BANDS = ((0, 3, "0-3h"), (3, 6, "3-6h"), (6, 12, "6-12h"), (12, 24, "12-24h"), (24, 80, "24-80h"))


def surface_group(*tags: Column) -> Column:
    """The first tag that says paved or unpaved, else unknown."""
    named = [F.when(F.lower(t).isin("paved", "unpaved"), F.lower(t)) for t in tags]
    return F.coalesce(*named, F.lit("unknown"))


def scenario_surface(surface: Column, scenario: Column) -> Column:
    """The surface under a scenario that may decide unknown ones."""
    known = F.coalesce(F.lower(surface), F.lit("unknown"))
    return (F.when((scenario == "unknown_as_paved") & (known == "unknown"), "paved")
            .when((scenario == "unknown_as_unpaved") & (known == "unknown"), "unpaved").otherwise(known))


def base_speed(highway: Column, surface: Column) -> Column:
    """Km/h of a highway class on a surface."""
    speed = F.coalesce(*(F.when(highway == k, v) for k, v in HIGHWAY_SPEEDS.items()), F.lit(OTHER_SPEED))
    return speed * F.coalesce(*(F.when(surface == k, v) for k, v in SURFACE_FACTORS.items()), F.lit(1.0))


def routable(highway: Column) -> Column:
    """Whether trucks take a highway class; a missing class is not excluded."""
    return ~F.coalesce(F.lower(highway), F.lit("")).isin(*NO_TRUCKS)


def penalised(cost: Column, multiplier: Column) -> Column:
    """Cost at a reduced speed; the multiplier is never taken below LEAST_MULTIPLIER."""
    return cost / F.greatest(multiplier, F.lit(LEAST_MULTIPLIER))


def anchored_week(day: Column, anchor: str) -> Column:
    """First day of the 7-day bucket, counted from ``anchor``, that holds ``day``."""
    start = F.lit(anchor).cast("date")
    return F.date_add(start, (F.floor(F.datediff(day.cast("date"), start) / 7) * 7).cast("int"))


def damage_class(minutes: Column) -> Column:
    """0 to 5 by DAMAGE_MINUTES, -1 for null."""
    return F.when(minutes.isNull(), -1).otherwise(sum((F.when(minutes >= m, 1).otherwise(0) for m in DAMAGE_MINUTES), F.lit(0)))


def delay_band(hours: Column) -> Column:
    """The name of the band that holds a delay; null outside all."""
    return F.coalesce(*(F.when((hours >= a) & (hours < b), name) for a, b, name in DELAY_BANDS))


def interpolated(value: Column, anchors: list[tuple[float, float]]) -> Column:
    """Piecewise linear effect between anchors; 0 below the first, the last beyond it."""
    out = F.when(value < anchors[0][0], 0.0)
    for (x0, y0), (x1, y1) in zip(anchors, anchors[1:]):
        out = out.when(value < x1, y0 + (value - x0) * ((y1 - y0) / (x1 - x0)))
    return out.when(value.isNotNull(), anchors[-1][1])


def transport_loss(rate: Column, km: Column, surface: Column, cap: float) -> Column:
    """Loss share of ``rate`` for each 10 km, a third of it on paved roads, at most ``cap``."""
    return F.least(F.lit(cap), F.when(surface == "paved", rate / 3).otherwise(rate) * km / 10)


def mercator_cell(lon: Column, lat: Column, metres: float) -> Column:
    """``ix:iy`` of a square Web Mercator cell."""
    x = F.radians(lon) * MERCATOR_RADIUS
    y = F.log(F.tan(F.radians(lat) / 2 + F.lit(3.141592653589793 / 4))) * MERCATOR_RADIUS
    return F.concat_ws(":", F.floor(x / metres).cast("string"), F.floor(y / metres).cast("string"))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * EARTH_KM)


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a ray to the right of the point crosses the outline an odd number of times."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
        if y1 != y2:
            level = (F.lit(y1) > y) != (F.lit(y2) > y)
            crossings = crossings + F.when(level & (x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1), 1).otherwise(0)
    return crossings % 2 == 1


def visibility_metres(text: Column) -> Column:
    """The first field of a visibility group; 999999, blank and unreadable ones are null."""
    metres = F.split_part(text, F.lit(","), F.lit(1)).try_cast("double")
    return F.when(metres < 999999, metres)


def normalised_url(url: Column) -> Column:
    """Lower-cased address without scheme, www., query, fragment and closing slashes."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^https?://(www\.)?", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"/+$", "")


def severity(value: Column, levels: dict[str, float | None], rising: bool = True) -> Column:
    """The gravest level that ``value`` has reached; null below all and for null. Levels without a number never hold.

    ``levels`` go from mild to grave. Where harm grows as the value falls (``rising`` false), a level holds at or below its number.
    """
    held = [F.when((value >= at) if rising else (value <= at), name) for name, at in levels.items() if at is not None]
    return F.coalesce(*reversed(held), F.lit(None).cast("string"))


def unit_vector(dx: Column, dy: Column) -> tuple[Column, Column]:
    """Direction of a road from start to end; (0, 1) for one without length or ends."""
    length = F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    return F.coalesce(dx / length, F.lit(0.0)), F.coalesce(dy / length, F.lit(1.0))


def crosswind(u: Column, v: Column, ux: Column, uy: Column) -> Column:
    """Speed of the wind (u, v) across a road of direction (ux, uy)."""
    return F.abs(v * ux - u * uy)


def hourly_mm(rate: Column, units: Column) -> Column:
    """A rain rate in mm an hour; units that name seconds count 3,600 times."""
    return F.when(F.contains(units, F.lit("s")), rate * 3600).otherwise(rate)


def celsius(kelvin: Column) -> Column:
    return kelvin - 273.15

"""Dense grids over weeks, and k nearest targets in metres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import projections as P
from .geometry import k_nearest

#: Decimals that coordinates of cells are rounded to.
DECIMALS = 4


def rounded_cells(cells: DataFrame, value: str, order: str, decimals: int = DECIMALS) -> DataFrame:
    """``cells(week_start, latitude, longitude, value)`` with rounded coordinates; of those that fall together the first by ``order`` stays."""
    at = lambda c: F.round(F.col(c).cast("double"), decimals) + F.lit(0.0)  # noqa: E731  -0.0 is 0.0
    keyed = cells.where("week_start is not null and latitude is not null and longitude is not null").withColumn("latitude", at("latitude")).withColumn("longitude", at("longitude"))
    return keyed.groupBy("week_start", "latitude", "longitude").agg(F.min_by(value, order).alias(value))


def dense_grid(weeks: DataFrame, cells: DataFrame, value: str, order: str, decimals: int = DECIMALS) -> DataFrame:
    """Rows (week_start, latitude, longitude, cell_id, value): every week of ``weeks(week_start)`` at every latitude and longitude that any cell has, null where none says.

    The axes are the unions of what the cells name, so files that cover different parts complete each other. The result has weeks times latitudes times longitudes
    rows, which is what is asked for; only the axes are distributed to make it, each as small as one side of the grid. Coordinates that are null name no cell. A value
    of a week that ``weeks`` lacks is left out.
    """
    own = rounded_cells(cells, value, order, decimals)
    lats, lons = own.select("latitude").distinct(), own.select("longitude").distinct()
    whole = weeks.select("week_start").distinct().crossJoin(lats).crossJoin(lons)
    named = whole.join(own, ["week_start", "latitude", "longitude"], "left")
    text = lambda c: F.format_string(f"%.{decimals}f", c)
    return named.select("week_start", "latitude", "longitude", F.concat(text("longitude"), F.lit(":"), text("latitude")).alias("cell_id"), value)


def metric_nearest(points: DataFrame, targets: DataFrame, k: int, reach: float = 5000.0) -> DataFrame:
    """Rows (id, rank, target, metres): the ``k`` nearest of ``targets(id, lon, lat)`` to each of ``points(id, lon, lat)``, on the plane about the middle of all.

    The plane keeps distances from its centre; elsewhere they are those of a local plane, as wide as the box that holds all rows. Ids of points and
    targets are numbers of their own. ``reach`` is the distance in metres that is searched first.
    """
    points, targets = (t.dropna(subset=["id", "lon", "lat"]) for t in (points, targets))
    both = points.select("lon", "lat").unionByName(targets.select("lon", "lat"))
    box = both.agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first()
    lon0, lat0 = P.centre(tuple(box)) if box[0] is not None else (0.0, 0.0)
    # a point is no target of its own in k_nearest; even and odd numbers keep the two tables apart
    placed = lambda t, odd: t.select((F.col("id") * 2 + odd).alias("id"), P.equidistant(F.col("lon"), F.col("lat"), lon0, lat0).alias("p")).select("id", "p.x", "p.y")
    found = k_nearest(placed(points, 0), placed(targets, 1), reach, k)
    return found.select(F.shiftright("id", 1).alias("id"), "rank", F.shiftright("target", 1).alias("target"), F.sqrt("d2").alias("metres"))

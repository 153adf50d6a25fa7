"""Rasters as tile tables: sampling at points and reducing several rasters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """North-up geometry of a raster: upper left corner, cell size, shape, tile side and missing value."""

    left: float
    top: float
    cell: float
    rows: int
    columns: int
    tile: int
    nodata: float | None = None


def sample_points(tiles: DataFrame, points: DataFrame, grid: Grid, positive_only: bool = False) -> DataFrame:
    """``points`` (x, y and more) with ``value`` of the cell that holds each; null outside and where missing.

    ``tiles`` has (tile_row, tile_column, cells array<array<double>>). Tiles are joined on their indices, so only
    tiles with points are matched.
    """
    row, column = F.floor((grid.top - F.col("y")) / grid.cell), F.floor((F.col("x") - grid.left) / grid.cell)
    inside = row.between(0, grid.rows - 1) & column.between(0, grid.columns - 1)
    placed = points.withColumn("__row", F.when(inside, row)).withColumn("__column", F.when(inside, column))
    placed = placed.withColumn("__tr", F.floor(F.col("__row") / grid.tile)).withColumn("__tc", F.floor(F.col("__column") / grid.tile))
    cells = tiles.select(F.col("tile_row").cast("long").alias("__tr"), F.col("tile_column").cast("long").alias("__tc"), F.col("cells").alias("__cells"))
    value = F.get(F.get("__cells", (F.col("__row") % grid.tile).cast("int")), (F.col("__column") % grid.tile).cast("int"))
    found = placed.join(cells, ["__tr", "__tc"], "left").withColumn("value", usable(value, grid.nodata, positive_only))
    return found.select(*points.columns, "value")


def usable(value: Column, nodata: float | None, positive_only: bool = False) -> Column:
    """Null for the missing value, NaN and infinities, and if asked for values that are not positive."""
    keep = ~F.isnan(value) & (F.abs(value) < float("inf"))
    if nodata is not None:
        keep = keep & (value != nodata)
    return F.when(keep & (value > 0) if positive_only else keep, value)


def reduce_samples(samples: DataFrame, key: str, order: str, how: str = "max") -> DataFrame:
    """One value for each ``key`` over several rasters: sum, mean, max, or the first that is not null by ``order``."""
    found = {"sum": F.sum("value"), "mean": F.avg("value"), "max": F.max("value"), "first_valid": F.min_by("value", F.when(F.col("value").isNotNull(), F.col(order)))}
    return samples.groupBy(key).agg(found[how].alias("value"))

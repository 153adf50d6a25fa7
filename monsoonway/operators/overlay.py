"""Road overlays from many sources: each factor is routed to the source that gives it, and each source is read once.

A source says which columns it gives, whether they change by week, and by which columns of a road its rows are found. Static columns are joined to the roads once;
weekly ones to road-weeks, each source by one equi-join on its key and the week, so its rows are read and moved once whatever the number of weeks. A source that is
switched off is not read; one whose data are missing gives null columns, so the overlay always has the same columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .geometry import nearest


@dataclass(frozen=True)
class Source:
    """``read(columns, weeks)`` gives at most one row (key, week_start if weekly, columns) for a key and week, or None if there are no data.

    ``columns`` are names with types; ``key`` names columns that roads and rows share.
    """

    name: str
    key: tuple[str, ...]
    columns: dict[str, str]
    read: Callable[[list[str], list[date]], DataFrame | None]
    weekly: bool = True


def planned(sources: list[Source], factors: list[str] | None = None, off: tuple[str, ...] = ()) -> list[tuple[Source, list[str]]]:
    """The sources that are read and the columns that each is asked for: those of ``factors``, all if None, each from the first source that gives it.

    A factor that no source gives is an error; one of a source that is ``off`` falls away.
    """
    known = {c: s for s in reversed(sources) for c in s.columns}
    if unknown := [f for f in factors or [] if f not in known]:
        raise ValueError(f"no source gives {', '.join(unknown)}")
    asked = [f for f in dict.fromkeys(factors if factors is not None else [c for s in sources for c in s.columns]) if known[f].name not in off]
    return [(s, own) for s in sources if (own := [f for f in asked if known[f] is s])]


def _joined(rows: DataFrame, source: Source, columns: list[str], weeks: list[date]) -> DataFrame:
    found = source.read(columns, weeks)
    if found is None:
        return rows.withColumns({c: F.lit(None).cast(source.columns[c]) for c in columns})
    by = [*source.key, *(["week_start"] if source.weekly else [])]
    return rows.join(found.select(*by, *(F.col(c).cast(source.columns[c]).alias(c) for c in columns)), by, "left")


def static_overlay(roads: DataFrame, plan: list[tuple[Source, list[str]]]) -> DataFrame:
    """``roads`` with the static columns of the plan."""
    for source, columns in plan:
        if not source.weekly:
            roads = _joined(roads, source, columns, [])
    return roads


def weekly_overlay(roads: DataFrame, plan: list[tuple[Source, list[str]]], weeks: list[date]) -> DataFrame:
    """A row for each road and each of ``weeks``, with the weekly columns of the plan; ``roads`` keep their columns."""
    spark = roads.sparkSession
    table = spark.createDataFrame([(w,) for w in weeks], "week_start date")
    rows = roads.crossJoin(F.broadcast(table))  # the weeks of a year at most, and every road in each is what is asked for
    for source, columns in plan:
        if source.weekly:
            rows = _joined(rows, source, columns, weeks)
    return rows


def weeks_at(spark: SparkSession, folder: str) -> set[date]:
    """Weeks that an overlay at ``folder`` holds."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return set()
    names = [s.getPath().getName() for s in system.listStatus(at)]
    return {date.fromisoformat(n.removeprefix("week_start=")) for n in names if n.startswith("week_start=")}


def write_weeks(roads: DataFrame, plan: list[tuple[Source, list[str]]], weeks: list[date], folder: str, again: bool = False) -> list[date]:
    """Writes the weeks that ``folder`` lacks, or all ``again``, as a partition each, and returns those; other weeks there stay as they are.

    Weeks are written together, so each source is read once for all of them, and a week appears whole when the job is committed.
    """
    spark = roads.sparkSession
    todo = list(weeks) if again else sorted(set(weeks) - weeks_at(spark, folder))
    if todo:
        weekly_overlay(roads, plan, todo).repartition("week_start").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week_start").parquet(folder)
    return todo


def by_nearest_station(roads: DataFrame, stations: DataFrame, reach: float) -> DataFrame:
    """``roads(road, x, y)`` with ``station``, the nearest of ``stations(id, x, y)``, null if there is none."""
    near = nearest(roads.select(F.col("road").alias("id"), "x", "y"), stations, reach)
    return roads.join(near.select(F.col("id").alias("road"), F.col("target").alias("station")), "road", "left")

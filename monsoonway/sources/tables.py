"""Station files, catalogs and tables whose columns may be missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import relational as R


def read_visibility(spark: SparkSession, path: str, anchor: str) -> DataFrame:
    """Rows (station file, week_start, least visibility in m) of station CSV files that hold DATE and VIS."""
    named = spark.read.option("header", True).csv(path).withColumn("station", F.input_file_name())
    rows = with_columns_of(named, {"station": "string", "DATE": "timestamp", "VIS": "string"})
    metres = rows.select("station", X.anchored_week(F.col("DATE"), anchor).alias("week_start"), X.visibility_metres(F.col("VIS")).alias("metres"))
    return metres.where("metres is not null").groupBy("station", "week_start").agg(F.min("metres").alias("metres"))


def with_columns_of(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with exactly these columns and types; missing ones are null."""
    held = {c.lower(): c for c in df.columns}
    return df.select(*((F.col(f"`{held[c.lower()]}`") if c.lower() in held else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))


def upsert_catalog(current: DataFrame, changes: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """Catalog records with those of the same keys replaced; fields are text and never null."""
    text = lambda df: with_columns_of(df, dict.fromkeys(fields, "string")).fillna("")
    return R.upsert(text(current), text(changes), keys)


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def tiles_over(boxes: DataFrame, side: int = 3) -> DataFrame:
    """``boxes`` (west, south, east, north and more) once for each tile that they meet, with its ``tile`` code.

    A tile is named after its south-west corner: N or S and two digits, E or W and three. East and north edges that
    end on a corner do not take the next tile.
    """
    starts = lambda low, high: F.sequence((F.floor(F.col(low) / side) * side).cast("long"), (F.floor((F.col(high) - 1e-9) / side) * side).cast("long"), F.lit(side).cast("long"))
    placed = boxes.where("west < east and south < north").withColumn("__lon", F.explode(starts("west", "east"))).withColumn("__lat", F.explode(starts("south", "north")))
    code = F.format_string("%s%02d%s%03d", F.when(F.col("__lat") >= 0, "N").otherwise("S"), F.abs("__lat"), F.when(F.col("__lon") >= 0, "E").otherwise("W"), F.abs("__lon"))
    return placed.withColumn("tile", code).drop("__lon", "__lat")


def select_stations(stations: DataFrame, box: tuple[float, float, float, float], begin: str, end: str, most: int, country: str | None = None) -> DataFrame:
    """The first ``most`` stations by id that lie in a (west, south, east, north) box and were active in the period.

    Stations are (station_id, lon, lat, begin, end, country). Those of ``country`` are taken alone if there are any.
    """
    west, south, east, north = box
    active = (F.col("begin") <= F.lit(end).cast("date")) & (F.col("end") >= F.lit(begin).cast("date"))
    found = stations.where(F.col("lon").between(west, east) & F.col("lat").between(south, north) & active).dropDuplicates(["station_id"])
    if country:
        own = found.where(F.upper("country") == country.upper())
        found = found if own.isEmpty() else own
    return found.orderBy("station_id").limit(most)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file; lines that cannot be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_places(spark: SparkSession, path: str, country: str, least: int = 0, most: int | None = None) -> DataFrame:
    """Rows (place_id, name, lat, lon, population) of a tab-separated gazetteer of 19 columns, one country of it.

    Rows with fewer columns or unreadable numbers are left out; population lies in ``least`` to ``most``.
    """
    fields = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(fields) >= 19).select(
        F.get(fields, F.lit(0)).try_cast("long").alias("place_id"), F.get(fields, F.lit(1)).alias("name"), F.get(fields, F.lit(4)).try_cast("double").alias("lat"),
        F.get(fields, F.lit(5)).try_cast("double").alias("lon"), F.get(fields, F.lit(14)).try_cast("long").alias("population"), F.get(fields, F.lit(8)).alias("__country"))
    kept = rows.where(F.col("__country") == country).dropna(subset=["place_id", "lat", "lon", "population"]).where(F.col("population") >= least)
    return (kept if most is None else kept.where(F.col("population") <= most)).drop("__country")


# Kinds of airport that count as destinations.
AIRPORT_KINDS = ("large_airport", "medium_airport", "small_airport")


def read_airports(spark: SparkSession, path: str, country: str) -> DataFrame:
    """Rows (ident, type, name, lat, lon, iata_code) of an airport CSV; blank texts are null, bad coordinates are left out."""
    rows = with_columns_of(spark.read.option("header", True).csv(path), dict.fromkeys(("ident", "type", "name", "latitude_deg", "longitude_deg", "iso_country", "iata_code"), "string"))
    text = lambda c: F.nullif(F.trim(c), F.lit("")).alias(c)
    kept = rows.where(F.col("type").isin(*AIRPORT_KINDS) & (F.col("iso_country") == country))
    return kept.select(text("ident"), "type", text("name"), F.col("latitude_deg").try_cast("double").alias("lat"), F.col("longitude_deg").try_cast("double").alias("lon"), text("iata_code")).dropna(subset=["lat", "lon"])


def area_code(code: Column) -> Column:
    """A statistical area code as three digits: quotes and blanks go, zeros fill."""
    return F.lpad(F.regexp_replace(code, "['\" ]", ""), 3, "0")


def missing_keys(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``expected`` still to be computed, as a resumed run takes them."""
    return expected.join(present.select(*keys).distinct(), keys, "left_anti")


def add_counts(current: DataFrame, changes: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Counters of both by key, summed; null counts as 0."""
    both = current.select(*keys, *counts).unionByName(changes.select(*keys, *counts))
    return both.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts))

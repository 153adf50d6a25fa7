"""Roads and areas from geometry files, each with the SQL that gives the same rows.

Stand-ins: parts are roads of one to three lines about a point of their number, some without geometry, written as shapefiles of at most ``FILE`` numbers
of a brand; the areas are those of ``fields``, a file for each label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import areas as A
from ..operators.network import checkpointed, scratch_folder
from ..sources import features as S
from . import fields as E
from . import queries as Q
from .accessibility import _points

#: Numbers that a file of roads spans, and the box that is read.
FILE, BOX = 20_000, (-20.0, -18.0, 25.0, 30.0)
CLASSES = ("primary", "footway", "track", "residential")


def shape_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of roads that trucks may take and that meet a box, read from shapefiles: surface and length of each part."""
    k, p = F.col("p_partkey"), Q._t(spark, sf_dir, "part")
    up = (k % 5).cast("double")
    x, y = (k * 37 % 101 - 50).cast("double"), (k * 53 % 97 - 48).cast("double")
    line = lambda j: F.struct(F.array(x + j, x + j + 3 * up, x + j + 3 * up).alias("xs"), F.array(y, y + 4 * up, y + 4 * up + j).alias("ys"))
    parts = F.when(k % 13 != 0, F.transform(F.sequence(F.lit(1), (k % 3 + 1).cast("int")), line))
    tag = lambda m, word: F.when(F.col("p_size") % m == 0, word)
    roads = p.select(F.concat_ws("_", F.translate("p_brand", "#", "_"), F.floor(k / FILE).cast("string")).alias("file"), parts.alias("parts"), k.alias("road"),
                     F.element_at(F.array(*map(F.lit, CLASSES), F.lit(None)), (k % 5 + 1).cast("int")).alias("highway"), tag(7, "Unpaved").alias("osm_surface"), tag(5, "PAVED").alias("surface_tag"))
    attributes = ["road", "highway", "osm_surface", "surface_tag"]
    folder = f"{scratch_folder(spark)}/roads"
    checkpointed(S.write_shapefiles(roads, "file", folder, 3, attributes))
    # names of fields hold ten characters
    tags = [c[:10] for c in attributes[2:]]
    found = S.roads_of(S.read_features(spark, folder, BOX, ["road", "highway", *tags]), tags)
    return S.exploded(found).select("road", "part", "highway", "surface", F.round(S.length(F.col("xs"), F.col("ys")), 6).alias("km"))


def shape_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many areas hold each point, and the greatest of them, the areas read from shapefiles as rings with holes."""
    closed = lambda c: F.concat(c, F.slice(c, 1, 1))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ring", closed("xs").alias("xs"), closed("ys").alias("ys")))), lambda r: F.struct(r["xs"].alias("xs"), r["ys"].alias("ys")))
    areas = E._rings(spark, sf_dir).groupBy("area").agg(parts.alias("parts")).withColumn("file", F.floor(F.col("area") / E.PARTS))
    folder = f"{scratch_folder(spark)}/areas"
    checkpointed(S.write_shapefiles(areas, "file", folder, 5, ["area"]))
    rings = S.rings(S.read_features(spark, folder), "area")
    points = _points(spark, sf_dir).select(F.col("vec_id").alias("id"), "x", "y")
    values = rings.select("area", F.col("area").alias("value")).distinct()
    return A.greatest_within(points, rings, values, E.CELL)


QUERIES = {f.__name__: f for f in (shape_roads, shape_areas)}

ORACLE_SQL = {
    "shape_roads": f"""WITH r AS (SELECT p_partkey AS road, p_size, p_partkey % 3 + 1 AS n, 5 * (p_partkey % 5) AS far, CAST(p_partkey * 37 % 101 - 50 AS DOUBLE) AS x, CAST(p_partkey * 53 % 97 - 48 AS DOUBLE) AS y, p_partkey % 5 AS up,
CASE p_partkey % 5 {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES))} END AS highway FROM part WHERE p_partkey % 13 <> 0)
SELECT road, CAST(j AS INT) AS part, highway, CASE WHEN p_size % 7 = 0 THEN 'unpaved' WHEN p_size % 5 = 0 THEN 'paved' ELSE 'unknown' END AS surface, CAST(far + j AS DOUBLE) AS km
FROM r, (VALUES (1), (2), (3)) v(j) WHERE j <= n AND coalesce(highway, '') <> 'footway' AND x + n + 3 * up >= {BOX[0]} AND y + 4 * up + n >= {BOX[1]} AND x + 1 <= {BOX[2]} AND y <= {BOX[3]}""",
    "shape_areas": E.ORACLE_SQL["areas_of_points"],
}

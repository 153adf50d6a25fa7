"""Projections and geodesics against published values, round trips and each other; dense grids."""

import numpy as np
from pyspark.sql import functions as F

from monsoonway.functions import projections as P
from monsoonway.operators import grids as D

#: Quarter of a meridian and of the equator of WGS 84 in metres.
MERIDIAN, EQUATOR = 10001965.7293, 10018754.1714


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_utm_of_known_places(spark):
    at = lambda lon, lat, zone, south=False: one(spark, P.utm(F.lit(lon), F.lit(lat), F.lit(zone), F.lit(south)))
    for lon, lat, zone, south, x, y in ((9.0, 45.0, 32, False, 500000.0, 4982950.400), (0.0, 0.0, 31, False, 166021.4431, 0.0), (6.0, 0.0, 31, False, 833978.5569, 0.0), (9.0, -45.0, 32, True, 500000.0, 10000000 - 4982950.400)):
        found = at(lon, lat, zone, south)
        assert abs(found["x"] - x) < 0.01 and abs(found["y"] - y) < 0.01
    tower = at(-79.387139, 43.642567, 17)
    assert abs(tower["x"] - 630084) < 1 and abs(tower["y"] - 4833438) < 1
    assert [r["z"] for r in spark.createDataFrame([(-180.0,), (0.0,), (179.9,), (180.0,)], "lon double").select(P.utm_zone(F.col("lon")).alias("z")).collect()] == [1, 31, 60, 1]
    assert (P.utm_epsg(9.0, 45.0), P.utm_epsg(-79.4, -1.0)) == (32632, 32717)


def test_utm_there_and_back(spark):
    draw = np.random.default_rng(1)
    rows = [(float(x), float(y)) for x, y in zip(draw.uniform(-180, 180, 300), draw.uniform(-80, 84, 300))]
    t = spark.createDataFrame([*rows, (None, 1.0)], "lon double, lat double").withColumn("zone", P.utm_zone(F.col("lon"))).withColumn("south", F.col("lat") < 0)
    t = t.withColumn("p", P.utm(F.col("lon"), F.col("lat"), F.col("zone"), F.col("south"))).withColumn("q", P.from_utm(F.col("p.x"), F.col("p.y"), F.col("zone"), F.col("south")))
    for r in t.collect():
        assert (r["lon"] is None and r["q"]["lon"] is None) or (abs(r["q"]["lon"] - r["lon"]) < 1e-9 and abs(r["q"]["lat"] - r["lat"]) < 1e-9)


def test_geodesic_of_known_lines(spark):
    dms = lambda d, m, s: d + m / 60 + s / 3600
    rows = [(0.0, 0.0, 0.0, 90.0, MERIDIAN), (0.0, 0.0, 90.0, 0.0, EQUATOR), (5.0, 5.0, 5.0, 5.0, 0.0), (170.0, 0.0, -170.0, 0.0, EQUATOR * 2 / 9),
            (dms(144, 25, 29.5244), -dms(37, 57, 3.7203), dms(143, 55, 35.3839), -dms(37, 39, 10.1561), 54972.271)]
    t = spark.createDataFrame([*rows, (0.0, 0.0, 179.9, 0.1, None), (None, 0.0, 1.0, 1.0, None)], "a double, b double, c double, d double, want double")
    for r in t.withColumn("m", P.geodesic_metres(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect():
        assert (r["m"] is None and r["want"] is None) or abs(r["m"] - r["want"]) < 0.1


def test_equidistant_plane(spark):
    """Known quarters, round trips, and distances from the centre equal to the geodesic."""
    t = spark.createDataFrame([(0.0, 90.0), (90.0, 0.0), (0.0, 0.0), (None, 1.0)], "lon double, lat double").select(P.equidistant(F.col("lon"), F.col("lat"), 0.0, 0.0).alias("p")).collect()
    assert abs(t[0]["p"]["y"] - MERIDIAN) < 0.1 and abs(t[1]["p"]["x"] - EQUATOR) < 0.1 and (t[2]["p"]["x"], t[2]["p"]["y"]) == (0.0, 0.0) and t[3]["p"]["x"] is None
    draw = np.random.default_rng(2)
    rows = [(float(x), float(y)) for x, y in zip(draw.uniform(-75, -35, 200), draw.uniform(-34, 6, 200))]
    lon0, lat0 = P.centre((-75.0, -34.0, -35.0, 6.0))
    t = spark.createDataFrame(rows, "lon double, lat double").withColumn("p", P.equidistant(F.col("lon"), F.col("lat"), lon0, lat0))
    t = t.withColumn("q", P.from_equidistant(F.col("p.x"), F.col("p.y"), lon0, lat0)).withColumn("m", P.geodesic_metres(F.lit(lon0), F.lit(lat0), F.col("lon"), F.col("lat")))
    for r in t.collect():
        assert abs(r["q"]["lon"] - r["lon"]) < 1e-9 and abs(r["q"]["lat"] - r["lat"]) < 1e-9 and abs(np.hypot(r["p"]["x"], r["p"]["y"]) - r["m"]) < 1e-3


def test_web_mercator(spark):
    found = one(spark, P.web_mercator(F.lit(180.0), F.lit(45.0)))
    assert abs(found["x"] - 20037508.3428) < 0.01 and abs(found["y"] - 5621521.4862) < 0.01
    assert one(spark, P.web_mercator(F.lit(0.0), F.lit(89.0)))["y"] is None


def test_metric_nearest_equals_all_distances(spark):
    draw = np.random.default_rng(3)
    place = lambda n: [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(draw.uniform(10, 12, n), draw.uniform(50, 51, n)))]
    points, targets = place(20), place(60)
    frame = lambda rows: spark.createDataFrame(rows, "id long, lon double, lat double")
    pairs = frame(points).crossJoin(frame(targets).select(F.col("id").alias("t"), F.col("lon").alias("u"), F.col("lat").alias("v")))
    far = {(r["id"], r["t"]): r["m"] for r in pairs.withColumn("m", P.geodesic_metres(F.col("lon"), F.col("lat"), F.col("u"), F.col("v"))).collect()}
    for k in (1, 4):
        found = D.metric_nearest(frame(points), frame([*targets, (99, None, 1.0)]), k).collect()
        for i in range(20):
            own = sorted((r["rank"], r["target"], r["metres"]) for r in found if r["id"] == i)
            assert [t for _, t, _ in own] == sorted(range(60), key=lambda t: far[i, t])[:k]
            assert all(abs(m - far[i, t]) < 5 for _, t, m in own)


def test_dense_grid_fills_gaps(spark):
    from datetime import date

    a, b, c = (date(2024, 1, d) for d in (1, 8, 15))
    cells = [(a, 1.00001, 10.0, 5.0, 1), (a, 1.00002, 10.0, 6.0, 0), (b, 2.0, 10.5, 7.0, 0), (b, None, 10.5, 1.0, 0), (date(2023, 1, 1), 3.0, 10.0, 9.0, 0), (a, -0.00001, 10.0, None, 0)]
    table = spark.createDataFrame(cells, "week_start date, latitude double, longitude double, v double, o int")
    weeks = spark.createDataFrame([(a,), (b,), (c,), (a,)], "week_start date")
    found = {(r["week_start"], r["cell_id"]): r["v"] for r in D.dense_grid(weeks, table, "v", "o").collect()}
    assert len(found) == 3 * 4 * 2 and {k: v for k, v in found.items() if v is not None} == {(a, "10.0000:1.0000"): 6.0, (b, "10.5000:2.0000"): 7.0} and (c, "10.5000:0.0000") in found
    assert D.dense_grid(weeks, table.limit(0), "v", "o").count() == 0

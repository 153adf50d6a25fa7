"""Geometry files that the tests write: shapefiles by the sink and GeoPackages by SQLite."""

import sqlite3
import struct
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from monsoonway.operators import areas
from monsoonway.sources import features as S

LINE = [(np.array([0.0, 3.0, 3.0]), np.array([0.0, 4.0, 5.0])), (np.array([10.0, 11.0]), np.array([10.0, 10.0]))]
SQUARE = [(np.array([0.0, 4, 4, 0, 0]), np.array([0.0, 0, 4, 4, 0])), (np.array([1.0, 1, 2, 2, 1]), np.array([1.0, 3, 3, 1, 1]))]


def put(folder, name, code, parts, attributes, dbf=None):
    folder.mkdir(exist_ok=True)
    data = list(S.encoded(code, parts, attributes))
    data[2] = dbf or data[2]
    for suffix, content in zip((".shp", ".shx", ".dbf", ".cpg"), data):
        (folder / (name + suffix)).write_bytes(content)
    return str(folder / (name + ".shp"))


def wkb(code, parts, order="<", high=0):
    """Well-known binary of points, lines and areas of one or more parts, with ``high`` as a third number if it is not 0."""
    corners = lambda p: b"".join(struct.pack(order + ("3d" if high else "2d"), *((x, y, high) if high else (x, y))) for x, y in zip(*p))
    head = struct.pack("B", order == "<") + struct.pack(order + "I", code + (1000 if high else 0))
    if code == 1:
        return head + corners(parts[0])
    if code == 2:
        return head + struct.pack(order + "I", len(parts[0][0])) + corners(parts[0])
    if code == 3:
        return head + struct.pack(order + "I", len(parts)) + b"".join(struct.pack(order + "I", len(p[0])) + corners(p) for p in parts)
    return head + struct.pack(order + "I", len(parts)) + b"".join(wkb(code - 3, [p], order, high) for p in parts)


def package(path, rows, tree=True, envelope=0):
    """A GeoPackage of a layer ``roads`` with (id, WKB or None, name, lanes, width, toll, built)."""
    base = sqlite3.connect(path)
    base.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    base.execute("INSERT INTO gpkg_geometry_columns VALUES ('roads', 'geom')")
    base.execute('CREATE TABLE roads (fid INTEGER PRIMARY KEY, geom BLOB, "na""me" TEXT, lanes MEDIUMINT, width REAL, toll BOOLEAN, built DATE)')
    for at, blob, *values in rows:
        if blob is not None:
            blob = b"GP\0" + bytes([1 | envelope << 1]) + struct.pack("<i", 4326) + bytes((0, 32, 48, 48, 64)[envelope]) + blob
        base.execute("INSERT INTO roads VALUES (?, ?, ?, ?, ?, ?, ?)", [at, blob, *values])
    if tree:
        base.execute("CREATE VIRTUAL TABLE rtree_roads_geom USING rtree(id, minx, maxx, miny, maxy)")
        for at, blob, *_ in rows:
            box = S._box(S.wkb_parts(blob)[1]) if blob else None
            if box:
                base.execute("INSERT INTO rtree_roads_geom VALUES (?, ?, ?, ?, ?)", [at, box[0], box[2], box[1], box[3]])
    base.commit()
    base.close()
    return str(path)


def test_shapefile_rows(spark, tmp_path):
    path = put(tmp_path / "a", "x", 3, [LINE, None, [], LINE[:1]], {"name": ["Straße", None, "b", "c"], "lanes": [2, 3, None, -4], "width": [1.5, None, 2.25, 1e-7], "a_very_long_name": ["p", "q", "r", "s"]})
    found = {r["feature"]: r for r in S.read_features(spark, path).collect()}
    assert [found[i]["name"] for i in range(4)] == ["Straße", None, "b", "c"] and [found[i]["lanes"] for i in range(4)] == [2, 3, None, -4]
    assert [found[i]["width"] for i in range(4)] == [1.5, None, 2.25, 1e-7] and found[3]["a_very_lon"] == "s"
    assert [found[i]["kind"] for i in range(4)] == ["line", None, None, "line"] and found[1]["parts"] is None and found[2]["west"] is None
    assert [(p["xs"], p["ys"]) for p in found[0]["parts"]] == [([0, 3, 3], [0, 4, 5]), ([10, 11], [10, 10])]
    assert tuple(found[0][b] for b in S.BOUNDS) == (0, 0, 11, 10) and tuple(found[3][b] for b in S.BOUNDS) == (0, 0, 3, 5)
    parts = S.exploded(S.read_features(spark, path)).select("feature", "part", S.length(F.col("xs"), F.col("ys")).alias("km"))
    assert sorted(map(tuple, parts.collect())) == [(0, 1, 6.0), (0, 2, 1.0), (3, 1, 6.0)]


def test_shapefile_runs_and_boxes(spark, tmp_path):
    """Any size of run gives the same rows; files and records outside of the box are not read."""
    folder = tmp_path / "many"
    for f in range(3):
        put(folder, f"f{f}", 1, [[(np.array([100.0 * f + i]), np.array([float(i)]))] for i in range(40)], {"n": list(range(40))})
    put(folder, "none", 1, [], {"n": []})
    for slab in (1, 500, 1 << 20):
        found = S.read_features(spark, str(folder), (110.0, 5.0, 119.0, 15.0), slab_bytes=str(slab))
        assert sorted((r["west"], r["n"], r["feature"]) for r in found.collect()) == [(100.0 + i, i, i) for i in range(10, 16)]
    reader = S.ShapefileReader(S.listed(str(folder), ".shp"), [("n", "bigint")], {})
    reader.limits = {**reader.limits, "east": ([110.0], []), "west": ([], [119.0])}
    runs = reader.partitions()
    assert {r.path[-6:-4] for r in runs} == {"f1"}
    assert sum(b.num_rows for r in runs for b in reader.read(r)) == 10
    assert S.read_features(spark, str(folder)).count() == 120


def test_deleted_records_and_kinds_of_fields(spark, tmp_path):
    parts = [[(np.array([1.0]), np.array([2.0]))]] * 3
    field = lambda name, kind, size, digits: name.encode().ljust(11, b"\0") + kind + bytes(4) + bytes([size, digits]) + bytes(14)
    fields = field("built", b"D", 8, 0) + field("toll", b"L", 1, 0) + field("share", b"N", 6, 2)
    rows = b" 20240229T  1.50" + b"*20240101F  2.50" + b"         ?******"
    dbf = struct.pack("<4BIHH20x", 3, 124, 1, 1, 3, 33 + len(fields), 16) + fields + b"\x0d" + rows
    path = put(tmp_path / "d", "x", 1, parts, {"n": [1, 2, 3]}, dbf)
    assert [(r["feature"], r["built"], r["toll"], r["share"]) for r in S.read_features(spark, path).collect()] == [(0, date(2024, 2, 29), True, 1.5), (2, None, None, None)]


def test_columns_of_differing_files(spark, tmp_path):
    point = [[(np.array([1.0]), np.array([2.0]))]]
    put(tmp_path / "c", "a", 1, point, {"NAME": ["Port"]})
    put(tmp_path / "c", "b", 1, point, {"ne_id": [7]})
    found = S.read_features(spark, str(tmp_path / "c"))
    ports = found.select(F.coalesce(F.col("ne_id").cast("string"), F.col("feature").cast("string")).alias("id"), F.coalesce("NAME", F.lit("")).alias("name"))
    assert sorted(map(tuple, ports.collect())) == [("0", "Port"), ("7", "")]
    assert S.read_features(spark, str(tmp_path / "c"), columns=["NAME"]).columns[8:] == ["NAME"]
    with pytest.raises(Exception, match="no files"):
        (tmp_path / "e").mkdir()
        S.read_features(spark, str(tmp_path / "e")).count()


def test_areas_of_files(spark, tmp_path):
    path = put(tmp_path / "s", "x", 5, [SQUARE, [(p[0] + 10, p[1]) for p in SQUARE[:1]]], {"code": ["A", "B"]})
    rings = S.rings(S.read_features(spark, path), "code")
    points = spark.createDataFrame([(1, 3.0, 3.0), (2, 1.5, 1.5), (3, 12.0, 1.0), (4, 9.0, 9.0)], "id long, x double, y double")
    assert sorted(map(tuple, areas.located(points, rings, 1.0).select("id", "area").collect())) == [(1, "A"), (3, "B")]
    inside = {r["area"]: (r["x"], r["y"]) for r in areas.representative_points(rings).collect()}
    assert inside["A"] == (3.0, 2.0) and inside["B"] == (12.0, 2.0)


@pytest.mark.parametrize("tree", [True, False])
@pytest.mark.parametrize("envelope", [0, 1, 4])
def test_geopackage(spark, tmp_path, tree, envelope):
    rows = [(5, wkb(5, LINE, "<", 7.0), "multi", 2, 1.5, 1, "2024-02-29"), (6, wkb(2, LINE, ">"), "line", None, None, 0, None), (7, None, None, 1, 2.0, None, None), (9, wkb(3, SQUARE), "area", 3, 0.5, 1, "2023-01-01"),
            (1000, wkb(1, [(np.array([50.0]), np.array([60.0]))]), "point", 4, 0.25, 0, None), (1001, wkb(1, [(np.array([np.nan]), np.array([np.nan]))]), "empty", 4, 0.25, 0, None)]
    path = package(tmp_path / "x.gpkg", rows, tree, envelope)
    for slab in ("1", "50000"):
        found = {r["feature"]: r for r in S.read_features(spark, path, slab_rows=slab).collect()}
        assert set(found) == {5, 6, 7, 9, 1000, 1001}
        assert [found[i]["kind"] for i in (5, 6, 7, 9, 1000)] == ["line", "line", None, "area", "point"]
        assert [(p["xs"], p["ys"]) for p in found[5]["parts"]] == [([0, 3, 3], [0, 4, 5]), ([10, 11], [10, 10])] and len(found[9]["parts"]) == 2
        assert found[7]["parts"] is None and found[1001]["parts"] is None and found[1001]["east"] is None
        assert [found[5][c] for c in ('na"me', "lanes", "width", "toll", "built")] == ["multi", 2, 1.5, True, date(2024, 2, 29)]
        near = S.read_features(spark, path, (10.5, 9.0, 55.0, 70.0), ["lanes"], slab_rows=slab)
        assert sorted((r["feature"], r["lanes"]) for r in near.collect()) == [(5, 2), (1000, 4)]
    assert S.read_features(spark, str(tmp_path), layer="roads").count() == 6


def test_roads(spark, tmp_path):
    path = put(tmp_path / "r", "x", 3, [LINE, LINE, None, LINE], {"highway": ["primary", "Footway", "primary", None], "osm": [None, "paved", "paved", "other"], "tag": ["Paved", "paved", "paved", "unpaved"]})
    found = S.roads_of(S.read_features(spark, path), ["osm", "tag"])
    assert sorted((r["feature"], r["surface"]) for r in found.collect()) == [(0, "paved"), (3, "unpaved")]

"""Files of datasets by period, and nodes and midpoints of lines."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from monsoonway.operators import geometry as G
from monsoonway.sources import datasets as S
from monsoonway.sources import geotiff

FIRST, LAST = date(2024, 1, 1), date(2024, 12, 31)
MONTHS = [f"era5/era5-land-hourly-brazil-2024-{m:02d}.nc" for m in range(1, 13)]


@pytest.mark.parametrize("target", ["era5-land-brazil.nc", "era5-land-hourly-brazil-2024-q3.nc"])
def test_months_stand_in_for_a_merged_file(target):
    there = set(MONTHS)
    assert S.climate_files("era5", {"target_filename": target}, FIRST, LAST, there.__contains__) == MONTHS
    # one that is missing, and the merged name is returned
    assert S.climate_files("era5", {"target_filename": target}, FIRST, LAST, (there - {MONTHS[4]}).__contains__) == [f"era5/{target}"]
    assert S.climate_files("era5", {"target_filename": target}, date(2024, 2, 1), date(2024, 3, 31), (there - {MONTHS[4]}).__contains__) == MONTHS[1:3]
    assert S.climate_files("era5", {"target_filename": target}, FIRST, LAST, (there | {f"era5/{target}"}).__contains__) == [f"era5/{target}"]


def test_precedence_of_climate_files():
    never = lambda p: False
    whole = {"source_files": ["a.nc", " "], "requests": [{"target_filename": "b.nc"}], "split_request_by": "weekly", "target_filename": "c.nc"}
    assert S.climate_files("r", whole, FIRST, LAST, never) == ["r/a.nc"]
    assert S.climate_files("r", {**whole, "source_files": []}, FIRST, LAST, never) == ["r/b.nc"]
    split = {"split_request_by": "weekly", "request": {"data_format": "grib"}, "target_prefix": "p", "start_date": "2024-01-03", "target_filename": "c.nc"}
    assert S.climate_files("r", split, FIRST, date(2024, 1, 12), never) == ["r/p-2024-01-03.grib", "r/p-2024-01-10.grib"]
    assert len(S.climate_files("r", {"split_request_by": "daily", "request": {"x": 1}}, FIRST, date(2024, 1, 5), never)) == 5
    for bad in ({"split_request_by": "daily"}, {**split, "start_date": "2025-01-01"}):
        with pytest.raises(ValueError):
            S.climate_files("r", bad, FIRST, LAST, never)
    assert S.climate_files("r", {}, FIRST, LAST, never) == [] and S.climate_files("r", {"target_filename": "x.nc"}, FIRST, LAST, never) == ["r/x.nc"]


def test_flood_files(spark, tmp_path):
    """By stamps without a catalog; by notes, boxes and positive cells with one."""
    def raster(name, values, left):
        path = tmp_path / name
        path.write_bytes(geotiff.encoded(np.array(values, float), left, 1.0, (1.0, 1.0), nodata=-9999.0, block=(16, 16)))
        return str(path)

    weeks = [date(2024, 1, 1), date(2024, 1, 8)]
    wet = raster("ENSEMBLE_FLOOD_20240101T092104_VV_A.tif", [[0, 1], [0, -9999]], -80.0)
    dry = raster("ENSEMBLE_FLOOD_20240102T092104_VV_B.tif", [[0, -9999], [0, 0]], -80.0)
    far = raster("ENSEMBLE_FLOOD_20240109T092104_VV_C.tif", [[5, 5], [5, 5]], 33.0)
    there = [wet, dry, far]
    assert S.flood_files(spark, there, weeks) == {weeks[0]: [wet, dry], weeks[1]: [far]} == S.flood_files(spark, there, weeks, [])
    note = "Copernicus GFM selected for weekly window 2024-01-01..2024-01-07."
    row = lambda path, box, notes=note, name="flood": {"dataset_name": name, "local_path": path, "bbox_if_known": box, "notes": notes}
    near, away = "[-80.0, -3.0, -76.0, 1.2]", "[33.0, -5.0, 42.0, 6.0]"
    catalog = [row(wet, near), row(dry, near), row(far, away), row(wet, near, "no window"), row("gone.tif", near), row(wet, near, name="roads")]
    box = (-79.9, -2.9, -76.9, 0.9)
    assert S.flood_files(spark, there, weeks, catalog, box) == {weeks[0]: [wet], weeks[1]: []}
    assert S.flood_files(spark, there, weeks, catalog) == {weeks[0]: [wet, dry, far], weeks[1]: []}
    assert S.flood_files(spark, there, weeks, [row(wet, near, "?")]) == S.flood_files(spark, there, weeks)
    with pytest.raises(ValueError):
        S.flood_files(spark, there, weeks, [{"dataset_name": "flood", "notes": ""}])
    # the positive cell lies outside of the box; a file that is none
    assert not S.has_positive(wet, (-79.9, -0.9, -79.2, 0.5)) and not S.has_positive(str(tmp_path / "none.tif"), box) and not S.has_positive(wet, (0.0, 0.0, 1.0, 1.0))


def test_flood_depth_files():
    weeks = [date(2024, 1, 1), date(2024, 1, 8)]
    there = ["d/depth_static.tif", "d/scenario_100.tif", "d/w_2024-01-01.tif", "d/w_2024_01_08.tif", "d/static.txt", "d/w_20240101.tif"]
    assert S.flood_depth_files(there, weeks) == {weeks[0]: ["d/depth_static.tif", "d/scenario_100.tif", "d/w_2024-01-01.tif"], weeks[1]: ["d/depth_static.tif", "d/scenario_100.tif", "d/w_2024_01_08.tif"]}


def test_edge_ends(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0), (2, 1.2, 0.0, 2.0, 0.0), (3, 2.0, 0.0, 2.0, 0.0), (4, None, 0.0, 1.0, 1.0)], "line_id long, x1 double, y1 double, x2 double, y2 double")
    name = lambda k: F.format_string("n%d", F.round(F.col(f"x{k}")).cast("long"))
    nodes, edges = G.edge_ends(lines, name(1), name(2))
    assert sorted(map(tuple, nodes.collect())) == [(1, "n0", 1, 0.0, 0.0), (2, "n1", 2, 1.1, 0.0), (3, "n2", 3, 2.0, 0.0)]
    assert sorted(map(tuple, edges.collect())) == [(1, 1, 2), (2, 2, 3), (3, 3, 3)]


def test_midpoints(spark):
    """Half way by length, of the longest part; on a corner; of lines without length, and without points."""
    parts = [(1, 0, [0.0, 10.0], [0.0, 0.0]), (1, 1, [0.0, 1.0, 1.0], [5.0, 5.0, 20.0]), (2, 0, [0.0, 2.0, 2.0], [0.0, 0.0, 2.0]), (3, 0, [4.0, 4.0], [1.0, 1.0]), (3, 1, [6.0], [3.0]), (4, 0, [], []), (5, 0, [0.0, 1.0, 1.0, 4.0], [0.0, 0.0, 0.0, 0.0]), (6, 0, [0.0, 2.0], [0.0, 0.0]), (6, 1, [0.0, 0.0], [0.0, 2.0])]
    found = {r["line_id"]: (r["x"], r["y"]) for r in G.midpoints(spark.createDataFrame(parts, "line_id long, part int, xs array<double>, ys array<double>")).collect()}
    assert found == {1: (1.0, 12.0), 2: (2.0, 0.0), 3: (14 / 3, 5 / 3), 5: (2.0, 0.0), 6: (1.0, 0.0)}

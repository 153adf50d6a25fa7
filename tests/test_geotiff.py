"""GeoTIFF files written by the test, of each kind that is read, and points sampled from them."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from monsoonway.functions import projections as P
from monsoonway.sources import geotiff as G

#: The literal raster: 4 by 4 cells of one degree from (0, 4), a missing value, blocks of 2 by 2.
VALUES = np.array([[1.0, 2.0, 3.0, 4.0], [5.0, -9999.0, 7.0, 8.0], [9.0, 10.0, 11.0, 12.0], [13.0, 14.0, 15.0, 16.0]])
POINTS = [(0, 0.1, 3.9), (1, 0.2, 3.8), (2, 1.1, 2.8), (3, 3.4, 1.2), (4, 9.0, 9.0), (5, None, 1.0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, lon double, lat double")


def test_points_of_the_literal_raster(spark, tmp_path):
    path = tmp_path / "a.tif"
    path.write_bytes(G.encoded(VALUES, 0.0, 4.0, (1.0, 1.0), nodata=-9999.0, block=(2, 2)))
    found = {r["id"]: r["value"] for r in G.sampled(frame(spark, POINTS), [str(path)]).collect()}
    assert found == {0: 1.0, 1: 1.0, 2: None, 3: 12.0}


def test_only_blocks_with_points_are_read(monkeypatch, tmp_path):
    import pyarrow as pa

    path = tmp_path / "a.tif"
    path.write_bytes(G.encoded(VALUES, 0.0, 4.0, (1.0, 1.0), nodata=-9999.0, block=(2, 2)))
    raster = G.header_of(str(path))
    assert (raster.width, raster.height, raster.block, raster.across, raster.epsg, raster.nodata) == (4, 4, (2, 2), 2, 4326, -9999.0)
    read = []
    inner = G.read_block
    monkeypatch.setattr(G, "read_block", lambda r, b, band=1: read.append(b) or inner(r, b, band))
    cells = pa.table({"raster": pa.array([0, 0], pa.int32()), "block": pa.array([3, 3], pa.int64()), "row": pa.array([2, 3], pa.int64()), "col": pa.array([3, 2], pa.int64())})
    assert G._read_cells([raster], 1)(cells).column("value").to_pylist() == [12.0, 15.0] and read == [3]


@pytest.mark.parametrize("block", [None, (16, 16)])
@pytest.mark.parametrize("compression, predictor", [(G.PLAIN, 1), (G.DEFLATE, 1), (G.DEFLATE, 2), (G.DEFLATE, 3)])
@pytest.mark.parametrize("kind", ["u1", "i2", "u4", "f4", "f8"])
def test_every_kind_of_file(tmp_path, block, compression, predictor, kind):
    if (predictor == 3) != (kind[0] == "f") and predictor > 1:
        pytest.skip("predictor 2 is for whole numbers, 3 for fractions")
    draw = np.random.default_rng(1)
    for bands in (1, 3):
        values = draw.uniform(0, 200, (bands, 37, 21)).astype(kind)
        path = tmp_path / f"{bands}.tif"
        path.write_bytes(G.encoded(values, 10.0, 50.0, (0.5, 0.25), block=block, compression=compression, predictor=predictor))
        raster = G.header_of(str(path))
        for band in range(1, bands + 1):
            got = np.zeros((37, 21))
            for b in range(len(raster.offsets)):
                y, x = b // raster.across * raster.block[0], b % raster.across * raster.block[1]
                piece = G.read_block(raster, b, band)[: 37 - y, : 21 - x]
                got[y : y + piece.shape[0], x : x + piece.shape[1]] = piece
            assert (got == values[band - 1]).all()


def _packed(codes):
    """Codes of growing width as the format packs them, for a table that starts empty after a clear code."""
    bits, width, size, out = "", 9, 258, b""
    for i, c in enumerate(codes):
        bits += format(c, f"0{width}b")
        if c == 256:
            size, width = 258, 9
        elif i and codes[i - 1] != 256:
            size += 1
            if size + 1 >= 1 << width and width < 12:
                width += 1
    bits += "0" * (-len(bits) % 8)
    return out + bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def test_lzw():
    """The known example, a code that names the entry it makes, and a table that outgrows nine bits."""
    assert G._lzw(_packed([256, 7, 258, 8, 8, 258, 6, 6, 257])) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert G._lzw(_packed([256, 65, 258, 259, 257])) == b"A" * 6
    data = np.random.default_rng(2).integers(0, 256, 3000).astype(np.uint8).tobytes()
    codes, table, last = [256], {bytes([i]): i for i in range(256)}, b""
    for byte in data:
        now = last + bytes([byte])
        if now in table:
            last = now
            continue
        codes.append(table[last])
        table[now] = len(table) + 2
        last = bytes([byte])
        if len(table) + 2 == 4094:
            codes += [table[last], 256]
            table, last = {bytes([i]): i for i in range(256)}, b""
    codes += [table[last]] * bool(last) + [257]
    assert G._lzw(_packed(codes)) == data


def test_big_endian_and_big_files():
    """Headers of the other byte order and of 64-bit offsets, read from memory."""
    import io

    classic = b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", 2) + struct.pack(">HHIHH", G.WIDTH, 3, 1, 7, 0) + struct.pack(">HHII", G.HEIGHT, 4, 1, 9)
    assert G._entries(io.BytesIO(classic)) == (">", {G.WIDTH: (7,), G.HEIGHT: (9,)})
    big = b"II+\0" + struct.pack("<HHQ", 8, 0, 16) + struct.pack("<Q", 1) + struct.pack("<HHQQ", G.TILES, 16, 1, 1 << 40)
    assert G._entries(io.BytesIO(big)) == ("<", {G.TILES: (1 << 40,)})
    with pytest.raises(ValueError):
        G._entries(io.BytesIO(b"GIF89a" + bytes(20)))


def test_points_are_taken_into_the_system_of_the_raster(spark, tmp_path):
    """One raster in UTM metres and one in web Mercator: each point finds the cell that its own projection names."""
    rows = [(i, 9.0 + i * 0.01, 45.0 + i * 0.005) for i in range(8)]
    values = np.arange(400.0).reshape(20, 20)
    (tmp_path / "utm.tif").write_bytes(G.encoded(values, 499000.0, 4992000.0, (500.0, 500.0), epsg=32632))
    (tmp_path / "web.tif").write_bytes(G.encoded(values, 1001000.0, 5632000.0, (600.0, 600.0), epsg=3857))
    points = frame(spark, rows)
    plane = points.select("id", P.utm(F.col("lon"), F.col("lat"), F.lit(32), F.lit(False)).alias("u"), P.web_mercator(F.col("lon"), F.col("lat")).alias("w")).collect()
    want = {}
    for r in plane:
        for k, (p, left, top, cell) in enumerate(((r["u"], 499000.0, 4992000.0, 500.0), (r["w"], 1001000.0, 5632000.0, 600.0))):
            row, col = int((top - p["y"]) // cell), int((p["x"] - left) // cell)
            if 0 <= row < 20 and 0 <= col < 20:
                want[r["id"], k] = values[row, col]
    found = {(r["id"], r["raster"]): r["value"] for r in G.sampled(points, [str(tmp_path / "utm.tif"), str(tmp_path / "web.tif")]).collect()}
    assert found == want and {k for _, k in want} == {0, 1}
    assert G.sampled(points, []).count() == 0 and G.sampled(points.limit(0), [str(tmp_path / "utm.tif")]).count() == 0
    with pytest.raises(ValueError):
        G.in_system(27700, F.lit(0.0), F.lit(0.0))


def test_cells_of_a_box_and_the_greatest_in_areas(spark, tmp_path):
    from monsoonway.operators import areas as A

    draw = np.random.default_rng(5)
    values = draw.integers(-3, 6, (40, 33)).astype("f4")
    values[5, 5] = -9999
    path = tmp_path / "a.tif"
    path.write_bytes(G.encoded(values, 100.0, 20.0, (0.5, 0.25), nodata=-9999.0, block=(16, 16)))
    every = {(r["row"], r["col"]): (r["x"], r["y"], r["value"]) for r in G.cells(spark, str(path)).collect()}
    assert len(every) == 40 * 33 - 1 and every[3, 4] == (102.25, 19.125, float(values[3, 4])) and (5, 5) not in every
    box = (103.0, 13.0, 109.2, 15.1)
    boxed = {(r["row"], r["col"]) for r in G.cells(spark, str(path), box).collect()}
    assert boxed == {k for k, (x, y, _) in every.items() if box[0] <= x <= box[2] and box[1] <= y <= box[3]} and boxed
    assert G.cells(spark, str(path), (0.0, 0.0, 1.0, 1.0)).count() == 0
    rings = spark.createDataFrame([("a", 0, [101.0, 108.0, 108.0], [12.0, 12.0, 19.0]), ("b", 0, [100.0, 101.0, 101.0], [10.1, 10.1, 10.6])], "area string, ring int, xs array<double>, ys array<double>")
    assert A.box_of(rings, 0.5) == (99.5, 9.6, 108.5, 19.5) and A.box_of(rings.limit(0)) is None
    found = [(r["area"], r["rank"], r["row"], r["col"], r["value"]) for r in A.top_cells(G.cells(spark, str(path)), rings, 4, 1.0).orderBy("area", "rank").collect()]
    inside = sorted((-v, k) for k, (x, y, v) in every.items() if v > 0 and 101 < x < 108 and 12 < y < 19 and (y - 12) < (x - 101))
    assert [(f[2:4], f[4]) for f in found if f[0] == "a"] == [(k, -v) for v, k in inside[:4]]
    assert len([f for f in found if f[0] == "b"]) <= 4

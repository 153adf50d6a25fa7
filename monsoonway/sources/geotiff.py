"""GeoTIFF rasters sampled at points, block by block, and a sink for tiles.

Spark plans over headers only: each point finds its cell and the block (strip or tile) that holds it, the distinct cells of a block go to one task, and that task
reads the block alone, once, by a ranged read. So what is read grows with the blocks that have points, and what a task holds is a block, whatever the raster or the number
of points in it. Points are taken from longitude and latitude into the raster's own system first.

Read are classic and big files of either byte order, strips and tiles, bands side by side or apart, integers and floats, uncompressed, deflated or LZW, with
differences between neighbours (predictors 2 and 3).
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projections as P
from .netcdf import _opened

#: Fixed values of the format: tags, and codes of compression, sample kinds and keys of the coordinate system.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, BANDS, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
GEOGRAPHIC_KEY, PROJECTED_KEY, RASTER_KEY = 2048, 3072, 1025
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


@dataclass
class Raster:
    """What a header says: shape, cells, blocks and how they are stored."""

    path: str
    width: int
    height: int
    block: tuple[int, int]
    left: float
    top: float
    cell: tuple[float, float]
    epsg: int
    nodata: float | None
    kind: np.dtype
    bands: int
    apart: bool
    compression: int
    predictor: int
    offsets: np.ndarray
    sizes: np.ndarray

    @property
    def across(self) -> int:
        return -(-self.width // self.block[1])


def _entries(file) -> tuple[str, dict[int, tuple]]:
    """The byte order and the tags of the first image."""
    head = file.read(16)
    if head[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF file")
    order = "<" if head[:2] == b"II" else ">"
    big = struct.unpack(order + "H", head[2:4])[0] == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    wide, count, word = (20, "Q", "Q") if big else (12, "H", "I")
    file.seek(at)
    n = struct.unpack(order + count, file.read(struct.calcsize(order + count)))[0]
    table, found = file.read(n * wide), {}
    for i in range(n):
        entry = table[i * wide : (i + 1) * wide]
        tag, kind = struct.unpack(order + "HH", entry[:4])
        many = struct.unpack(order + word, entry[4 : 4 + struct.calcsize(word)])[0]
        if kind not in _TYPES:
            continue
        form = f"{order}{many}{_TYPES[kind]}"
        size, held = struct.calcsize(form), entry[-struct.calcsize(word) :]
        if size > len(held):
            file.seek(struct.unpack(order + word, held)[0])
            held = file.read(size)
        found[tag] = struct.unpack(form, held[:size])
    return order, found


def header_of(path: str) -> Raster:
    with _opened(path) as file:
        order, tags = _entries(file)
    one = lambda tag, other=None: tags[tag][0] if tag in tags else other
    width, height = one(WIDTH), one(HEIGHT)
    tiled = TILES in tags
    block = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, height), height), width)
    kind = np.dtype(f"{order}{'uif'[one(SAMPLE_FORMAT, 1) - 1]}{one(BITS, 8) // 8}")
    keys = tags.get(GEO_KEYS, ())
    geo = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    scale, tie = tags.get(PIXEL_SCALE, (1.0, 1.0, 0.0)), tags.get(TIEPOINT, (0.0,) * 6)
    shift = 0.5 if geo.get(RASTER_KEY) == 2 else 0.0  # coordinates of cell centres
    nodata = tags[NODATA][0].decode().strip("\0 ") if NODATA in tags else None
    return Raster(path, width, height, block, tie[3] - (tie[0] + shift) * scale[0], tie[4] + (tie[1] + shift) * scale[1], (scale[0], scale[1]), geo.get(PROJECTED_KEY) or geo.get(GEOGRAPHIC_KEY) or 4326,
                  float(nodata) if nodata else None, kind, one(BANDS, 1), one(PLANAR, 1) == 2, one(COMPRESSION, 1), one(PREDICTOR, 1), np.array(tags[TILES if tiled else STRIPS], np.int64), np.array(tags[TILE_BYTES if tiled else STRIP_BYTES], np.int64))


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, that grow one code early; 256 clears the table, 257 ends."""
    out, table, width, bits, held, last = bytearray(), [], 9, 0, 0, None
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        while bits >= width:
            bits -= width
            code, held = held >> bits, held & ((1 << bits) - 1)
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
                continue
            if last is None:
                entry = table[code]
            else:
                entry = table[code] if code < len(table) else last + last[:1]
                table.append(last + entry[:1])
            out += entry
            last = entry
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
    return bytes(out)


def read_block(raster: Raster, block: int, band: int = 1) -> np.ndarray:
    """The values of a band in a block, as wide and high as the file's blocks; what lies beyond the raster is whatever the file holds there."""
    per_band = raster.across * -(-raster.height // raster.block[0])
    at = block + (per_band * (band - 1) if raster.apart else 0)
    high, wide = raster.block
    many = 1 if raster.apart else raster.bands
    with _opened(raster.path) as file:
        file.seek(int(raster.offsets[at]))
        data = file.read(int(raster.sizes[at]))
    if not data:  # a block that was never written
        return np.full((high, wide), np.nan if raster.nodata is None else raster.nodata)
    if raster.compression in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif raster.compression == LZW:
        data = _lzw(data)
    elif raster.compression != PLAIN:
        raise ValueError(f"{raster.path}: compression {raster.compression} is not read")
    size = raster.kind.itemsize
    rows = len(data) // (wide * many * size)
    data = data[: rows * wide * many * size]
    if raster.predictor == 3:
        # bytes of a row by their weight, highest first, each the difference to the one before
        planes = np.frombuffer(data, np.uint8).reshape(rows, wide * size, many).cumsum(axis=1, dtype=np.uint8)
        values = planes.reshape(rows, size, wide * many).transpose(0, 2, 1).copy().view(raster.kind.newbyteorder(">")).reshape(rows, wide, many)
    else:
        values = np.frombuffer(data, raster.kind).reshape(rows, wide, many)
        if raster.predictor == 2:
            values = values.cumsum(axis=1, dtype=raster.kind.newbyteorder("="))
    found = np.full((high, wide), np.nan)
    found[:rows] = values[:, :, 0 if raster.apart else band - 1]
    return found


def in_system(epsg: int, lon: Column, lat: Column) -> Column:
    """(x, y) of a place in a system: geographic, web Mercator or a UTM zone of WGS 84."""
    if epsg == 3857:
        return P.web_mercator(lon, lat)
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return P.utm(lon, lat, F.lit(epsg % 100), F.lit(epsg >= 32700))
    if epsg == 4326:
        return F.struct(lon.alias("x"), lat.alias("y"))
    raise ValueError(f"system EPSG:{epsg} is not known")


def _read_cells(rasters: list[Raster], band: int):
    """Cells (raster, block, row, col) of one block to their values; null for the missing value and what is not finite."""

    def run(cells: pa.Table) -> pa.Table:
        raster = rasters[cells.column("raster")[0].as_py()]
        block = read_block(raster, cells.column("block")[0].as_py(), band)
        row, col = cells.column("row").to_numpy(), cells.column("col").to_numpy()
        values = block[row % raster.block[0], col % raster.block[1]]
        gone = ~np.isfinite(values)
        if raster.nodata is not None:
            gone |= values == raster.nodata
        return pa.table([cells.column("raster"), cells.column("row"), cells.column("col"), pa.array(values, mask=gone)], names=["raster", "row", "col", "value"])

    return run


def sampled(points: DataFrame, paths: list[str], band: int = 1) -> DataFrame:
    """Rows (id, raster, value): the value of each raster, by its place in ``paths``, in the cell that holds each point (id, lon, lat).

    A point outside a raster, or without coordinates, has no row for it; a missing value is null. Rasters are few, as the days of a week are; their headers are
    sent along with the plan.
    """
    rasters = [header_of(p) for p in paths]
    if not rasters:
        return points.select("id", F.lit(0).alias("raster"), F.lit(None).cast("double").alias("value")).limit(0)
    placed = points.dropna(subset=["lon", "lat"])
    systems = sorted({r.epsg for r in rasters})
    for s in systems:
        placed = placed.withColumn(f"__{s}", in_system(s, F.col("lon").cast("double"), F.col("lat").cast("double")))

    def cell(i: int, r: Raster) -> Column:
        row, col = F.floor((r.top - F.col(f"__{r.epsg}.y")) / r.cell[1]), F.floor((F.col(f"__{r.epsg}.x") - r.left) / r.cell[0])
        inside = row.between(0, r.height - 1) & col.between(0, r.width - 1)
        block = F.floor(row / r.block[0]) * r.across + F.floor(col / r.block[1])
        return F.when(inside, F.struct(F.lit(i).alias("raster"), block.alias("block"), row.alias("row"), col.alias("col")))

    own = placed.select("id", F.explode(F.array_compact(F.array(*(cell(i, r) for i, r in enumerate(rasters))))).alias("c")).select("id", "c.*")
    cells = own.select("raster", "block", "row", "col").distinct()
    values = cells.groupBy("raster", "block").applyInArrow(_read_cells(rasters, band), "raster int, row long, col long, value double")
    return own.select("id", "raster", "row", "col").join(values, ["raster", "row", "col"]).select("id", "raster", "value")


def cells(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, band: int = 1) -> DataFrame:
    """Rows (row, col, x, y, value) of the cells of a raster that have a value, x and y their centres in its own system; with a box (west, south, east, north) of that system those whose centre it holds.

    A task reads some blocks, one after another; blocks that the box does not meet are not read.
    """
    raster = header_of(path)
    (high, wide), (w, h) = raster.block, raster.cell
    down = -(-raster.height // high)
    first = (0, 0, down, raster.across) if box is None else (
        max(0, int((raster.top - box[3]) / h // high)), max(0, int((box[0] - raster.left) / w // wide)), min(down, int((raster.top - box[1]) / h // high) + 1), min(raster.across, int((box[2] - raster.left) / w // wide) + 1))
    rows, columns = max(0, first[2] - first[0]), max(0, first[3] - first[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                by, bx = first[0] + i // columns, first[1] + i % columns
                values = read_block(raster, by * raster.across + bx, band)[: raster.height - by * high, : raster.width - bx * wide]
                there = np.isfinite(values) & (values != raster.nodata if raster.nodata is not None else True)
                r, c = np.nonzero(there)
                row, col = r + by * high, c + bx * wide
                yield pa.record_batch([pa.array(row, pa.int64()), pa.array(col, pa.int64()), pa.array(raster.left + (col + 0.5) * w), pa.array(raster.top - (row + 0.5) * h), pa.array(values[there])], ["row", "col", "x", "y", "value"])

    found = spark.range(0, rows * columns, 1, max(1, min(rows * columns, 4096))).mapInArrow(run, "row long, col long, x double, y double, value double")
    return found if box is None else found.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))


def encoded(values: np.ndarray, left: float, top: float, cell: tuple[float, float], epsg: int = 4326, nodata: float | None = None, block: tuple[int, int] | None = None, compression: int = DEFLATE, predictor: int = 1) -> bytes:
    """A little-endian file of bands (band, row, col) or one band (row, col), side by side; ``block`` makes tiles, else rows are one strip each."""
    bands = np.moveaxis(values.reshape(-1, *values.shape[-2:]), 0, 2)
    high, wide, many = bands.shape
    kind = values.dtype.newbyteorder("<")
    step = block or (1, wide)
    chunks = []
    for y in range(0, high, step[0]):
        for x in range(0, wide, step[1]):
            piece = np.zeros((*step, many), kind)
            own = bands[y : y + step[0], x : x + step[1]]
            piece[: own.shape[0], : own.shape[1]] = own
            if predictor == 2:
                piece[:, 1:] -= piece[:, :-1].copy()
            data = piece.tobytes()
            if predictor == 3:
                planes = piece.astype(kind.newbyteorder(">")).reshape(step[0], -1).view(np.uint8).reshape(step[0], -1, kind.itemsize).transpose(0, 2, 1).reshape(step[0], -1, many)
                data = np.diff(planes, axis=1, prepend=np.zeros((step[0], 1, many), np.uint8)).astype(np.uint8).tobytes()
            chunks.append(zlib.compress(data) if compression == DEFLATE else data)
    code = {"u": 1, "i": 2, "f": 3}[kind.kind]
    keys = (1, 1, 0, 2, 1024, 0, 1, 2 if epsg == 4326 else 1, GEOGRAPHIC_KEY if epsg == 4326 else PROJECTED_KEY, 0, 1, epsg)
    tags = [(WIDTH, 4, (wide,)), (HEIGHT, 4, (high,)), (BITS, 3, (kind.itemsize * 8,) * many), (COMPRESSION, 3, (compression,)), (BANDS, 3, (many,)), (PLANAR, 3, (1,)), (PREDICTOR, 3, (predictor,)), (SAMPLE_FORMAT, 3, (code,) * many),
            (PIXEL_SCALE, 12, (*cell, 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, left, top, 0.0)), (GEO_KEYS, 3, keys)]
    tags += [(TILE_WIDTH, 4, (step[1],)), (TILE_HEIGHT, 4, (step[0],))] if block else [(ROWS_PER_STRIP, 4, (1,))]
    if nodata is not None:
        text = f"{nodata:g}".encode() + b"\0"
        tags.append((NODATA, 2, (text,)))
    at = 8
    places = []
    for c in chunks:
        places.append(at)
        at += len(c) + len(c) % 2
    tags += [(TILES if block else STRIPS, 4, tuple(places)), (TILE_BYTES if block else STRIP_BYTES, 4, tuple(map(len, chunks)))]
    tags.sort()
    table, extra, spot = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, form, held in tags:
        data = held[0] if form == 2 else struct.pack(f"<{len(held)}{_TYPES[form]}", *held)
        n = len(data) if form == 2 else len(held)
        if len(data) > 4:
            table += struct.pack("<HHII", tag, form, n, spot + len(extra))
            extra += data + bytes(len(data) % 2)
        else:
            table += struct.pack("<HHI", tag, form, n) + data.ljust(4, b"\0")
    body = b"".join(c + bytes(len(c) % 2) for c in chunks)
    return b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(tags)) + table + struct.pack("<I", 0) + extra


def write_tiles(cells: DataFrame, key: str, folder: str, cell: float, size: int, nodata: float) -> DataFrame:
    """Writes ``cells(key, row, col, value)`` as one raster ``<key>.tif`` of ``size`` rows and columns for each key; rows (key, path).

    ``row`` counts cells from the top at latitude 0 downwards, ``col`` eastwards from longitude 0, both over all tiles and negative beyond; a key's cells lie in one square of ``size``
    aligned cells.
    """

    def written(table: pa.Table) -> pa.Table:
        which = table.column(key)[0].as_py()
        row, col = table.column("row").to_numpy(), table.column("col").to_numpy()
        first = int(row[0] // size * size), int(col[0] // size * size)
        values = np.full((size, size), nodata)
        values[row - first[0], col - first[1]] = table.column("value").cast(pa.float64()).fill_null(nodata).to_numpy()
        system, root = fs.FileSystem.from_uri(folder) if re.match(r"\w+:", folder) else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{which}.tif") as out:
            out.write(encoded(values, first[1] * cell, -first[0] * cell, (cell, cell), nodata=nodata, block=(16, 16), predictor=3))
        return pa.table([pa.array([str(which)]), pa.array([f"{folder}/{which}.tif"])], names=["key", "path"])

    return cells.select(key, "row", "col", "value").groupBy(key).applyInArrow(written, "key string, path string")

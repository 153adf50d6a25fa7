"""Gridded NetCDF series: a partitioned reader of classic files, a sink, and nearest-cell sampling of points.

The reader is a Python data source (``netcdf``). Headers and time axes are read where Spark plans; data only in tasks, a slab of time steps and
latitude rows each, by ranged reads. Stamps that occur twice are read from the first file only, in the order of the files' names. Filters on
``time`` and ``latitude`` prune slabs and rows of the grid; the option ``variables`` names the columns to read.

Rules for what files call things: ``valid_time`` is ``time``; coordinates without a dimension are left out, so files may differ in them; packed values are unpacked,
fill values and what is not finite are null. The formats are the three classic ones (64-bit offsets and sizes included), not HDF5.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .weeks import months_needed

TIMES, LATITUDES, LONGITUDES = ("time", "valid_time"), ("latitude", "lat", "y"), ("longitude", "lon", "x")
#: Bytes of one variable that a task reads, about.
SLAB_BYTES = 16 << 20
_KINDS = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
_STEPS = {"second": 1.0, "minute": 60.0, "hour": 3600.0, "day": 86400.0}


@dataclass
class Variable:
    dims: list[str]
    shape: list[int]
    kind: np.dtype
    begin: int
    attributes: dict
    #: Bytes from one record to the next, for variables along the unlimited dimension.
    stride: int = 0


@dataclass
class Header:
    variables: dict[str, Variable] = field(default_factory=dict)


class _Short(Exception):
    pass


class _Cursor:
    """Reads the big-endian items of a header one after another."""

    def __init__(self, data: bytes, version: int) -> None:
        self.data, self.at, self.wide = data, 4, version == 5
        self.offset = ">i" if version == 1 else ">q"

    def take(self, form: str) -> int:
        size = struct.calcsize(form)
        return struct.unpack(form, self.raw(size))[0]

    def raw(self, size: int) -> bytes:
        if self.at + size > len(self.data):
            raise _Short
        self.at += size
        return self.data[self.at - size : self.at]

    def count(self) -> int:
        return self.take(">q" if self.wide else ">i")

    def padded(self, size: int) -> bytes:
        found = self.raw(size)
        self.raw(-size % 4)
        return found

    def name(self) -> str:
        return self.padded(self.count()).decode()

    def listed(self) -> range:
        self.take(">i")
        return range(self.count())

    def attributes(self) -> dict:
        found = {}
        for _ in self.listed():
            name, kind = self.name(), _KINDS[self.take(">i")]
            n = self.count()
            held = self.padded(n * np.dtype(kind).itemsize)
            found[name] = held.decode(errors="replace").rstrip("\0") if kind == "S1" else np.frombuffer(held, kind)
        return found


def _parsed(data: bytes) -> Header:
    if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
        raise ValueError("not a classic NetCDF file")
    cursor = _Cursor(data, data[3])
    records = cursor.count()
    dims = [(cursor.name(), cursor.count()) for _ in cursor.listed()]
    cursor.attributes()
    header, stride = Header(), 0
    for _ in cursor.listed():
        name, own = cursor.name(), [dims[cursor.count()] for _ in range(cursor.count())]
        attributes, kind = cursor.attributes(), np.dtype(_KINDS[cursor.take(">i")])
        cursor.count()
        unlimited = bool(own) and own[0][1] == 0
        found = Variable([d for d, _ in own], [max(records, 0) if n == 0 else n for _, n in own], kind, cursor.take(cursor.offset), attributes)
        if unlimited:
            found.stride = int(np.prod(found.shape[1:], dtype=np.int64)) * kind.itemsize
            stride += found.stride + -found.stride % 4
        header.variables[name] = found
    along = [v for v in header.variables.values() if v.stride]
    for v in along:
        v.stride = stride if len(along) > 1 else v.stride  # a lone record variable is not padded
    return header


def _opened(path: str):
    system, at = fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def header_of(path: str) -> Header:
    size = 1 << 16
    with _opened(path) as file:
        while True:
            file.seek(0)
            data = file.read(size)
            try:
                return _parsed(data)
            except _Short:
                if len(data) < size:
                    raise ValueError(f"{path} ends within its header") from None
                size *= 4


def _numbers(file, v: Variable, at: int, n: int) -> np.ndarray:
    """``n`` values of a variable from place ``at`` on, counted over its whole array; no record is crossed."""
    own = int(np.prod(v.shape[1:], dtype=np.int64)) if v.stride else 0
    offset = v.begin + (at // own * v.stride + at % own * v.kind.itemsize if v.stride else at * v.kind.itemsize)
    file.seek(offset)
    return np.frombuffer(file.read(n * v.kind.itemsize), v.kind)


def _axis(file, header: Header, names: tuple[str, ...]) -> tuple[str, np.ndarray] | None:
    for name in names:
        v = header.variables.get(name)
        if v is not None and len(v.shape) == 1:
            values = np.concatenate([_numbers(file, v, i, 1) for i in range(v.shape[0])]) if v.stride and v.shape[0] else _numbers(file, v, 0, v.shape[0])
            return name, values
    return None


def _stamps(values: np.ndarray, units: str) -> np.ndarray:
    """Times counted as ``hours since 1900-01-01 00:00`` and the like, in microseconds since 1970."""
    found = re.match(r"\s*(second|minute|hour|day)s?\s+since\s+(\d+)-(\d+)-(\d+)(?:[T ]+(\d+):(\d+)(?::(\d+))?)?", units)
    if not found:
        raise ValueError(f"units of time not understood: {units}")
    base = datetime(*(int(x or 0) for x in found.groups()[1:]))
    start = (base - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    step = int(_STEPS[found[1]] * 1_000_000)
    return values.astype(np.int64) * step + start if values.dtype.kind in "iu" else np.round(values * step).astype(np.int64) + start


@dataclass
class Grid:
    """The axes of a file and its variables over (time, latitude, longitude) or (latitude, longitude)."""

    path: str
    times: np.ndarray | None
    latitudes: np.ndarray
    longitudes: np.ndarray
    variables: dict[str, Variable]


def grid_of(path: str) -> Grid:
    header = header_of(path)
    with _opened(path) as file:
        time, lat, lon = (_axis(file, header, names) for names in (TIMES, LATITUDES, LONGITUDES))
    if lat is None or lon is None:
        raise ValueError(f"{path} has no axes of latitude and longitude")
    full = [time[0], lat[0], lon[0]] if time else [lat[0], lon[0]]
    own = {n: v for n, v in header.variables.items() if v.dims in (full, full[-2:])}
    stamps = _stamps(time[1], header.variables[time[0]].attributes.get("units", "")) if time else None
    return Grid(path, stamps, lat[1].astype(float), lon[1].astype(float), own)


def listed(path: str) -> list[str]:
    """The files of a path: itself, those of a folder, or those of a JSON list of paths."""
    if path.startswith("["):
        return [f for p in json.loads(path) for f in listed(p)]
    system, at = fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)
    scheme = path[: path.index(":") + 1] if re.match(r"\w+:", path) else ""
    if system.get_file_info(at).type == fs.FileType.Directory:
        found = sorted(i.path for i in system.get_file_info(fs.FileSelector(at)) if i.path.endswith(".nc"))
        return [f"{scheme}//{f}" if scheme else f for f in found]
    return [path]


@dataclass
class Slab(InputPartition):
    path: str
    steps: tuple[int, ...] | None
    rows: tuple[int, int]


def _bounds(filters: list[Filter], name: str) -> tuple[list, list]:
    """Lower and upper limits of a column, each to be met; open limits are taken as closed, as rows are filtered again."""
    low, high = [], []
    for f in filters:
        if getattr(f, "attribute", None) != (name,):
            continue
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
            low.append(f.value)
        if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
            high.append(f.value)
    return low, high


class NetCDFReader(DataSourceReader):
    def __init__(self, paths: list[str], names: list[str], slab: int) -> None:
        self.paths, self.names, self.slab, self.filters = paths, names, slab, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps the filters for pruning; Spark applies them to the rows all the same."""
        self.filters = list(filters)
        yield from filters

    def partitions(self) -> list[Slab]:
        early, late = ([_micros(x) for x in limits] for limits in _bounds(self.filters, "time"))
        south, north = _bounds(self.filters, "latitude")
        seen, out = set(), []
        for path in self.paths:
            grid = grid_of(path)
            fits = np.flatnonzero([all(y >= s for s in south) and all(y <= n for n in north) for y in grid.latitudes])
            if not len(fits):
                continue
            steps = None
            if grid.times is not None:
                steps = []
                for i, t in enumerate(grid.times.tolist()):
                    if t not in seen and all(t >= e for e in early) and all(t <= x for x in late):
                        steps.append(i)
                    seen.add(t)
                if not steps:
                    continue
            line = 8 * len(grid.longitudes)
            high = max(1, min(int(fits[-1] - fits[0]) + 1, self.slab // max(line, 1)))
            many = max(1, self.slab // max(line * high, 1))
            for y in range(int(fits[0]), int(fits[-1]) + 1, high):
                rows = (y, min(y + high, int(fits[-1]) + 1))
                out += [Slab(path, None, rows)] if steps is None else [Slab(path, tuple(steps[i : i + many]), rows) for i in range(0, len(steps), many)]
        return out or [Slab("", None, (0, 0))]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        grid, (y0, y1) = grid_of(partition.path), partition.rows
        wide = len(grid.longitudes)
        n = (y1 - y0) * wide
        lats, lons = np.repeat(grid.latitudes[y0:y1], wide), np.tile(grid.longitudes, y1 - y0)
        with _opened(partition.path) as file:
            for step in partition.steps or (None,):
                when = pa.nulls(n, pa.timestamp("us")) if step is None else pa.array(np.full(n, grid.times[step]), pa.timestamp("us"))
                columns = [when, pa.array(lats), pa.array(lons)]
                for name in self.names:
                    v = grid.variables.get(name)
                    if v is None:
                        columns.append(pa.nulls(n, pa.float64()))
                        continue
                    first = 0 if len(v.shape) == 2 else step
                    columns.append(_unpacked(_numbers(file, v, (first * len(grid.latitudes) + y0) * wide, n), v.attributes))
                yield pa.record_batch(columns, ["time", "latitude", "longitude", *self.names])


def _micros(value) -> int:
    return (value.replace(tzinfo=None) - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def _unpacked(raw: np.ndarray, attributes: dict) -> pa.Array:
    values = raw.astype(np.float64)
    gone = ~np.isfinite(values)
    for name in ("_FillValue", "missing_value"):
        if name in attributes:
            gone |= raw == np.asarray(attributes[name]).ravel()[0]
    for name, apply in (("scale_factor", np.multiply), ("add_offset", np.add)):
        if name in attributes:
            values = apply(values, float(np.asarray(attributes[name]).ravel()[0]))
    return pa.array(values, mask=gone)


class NetCDF(DataSource):
    """``spark.read.format("netcdf").load(path)`` after ``register``: rows (time, latitude, longitude, a column for each variable)."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def _paths(self) -> list[str]:
        found = listed(self.options.get("paths") or self.options["path"])
        if {"from", "to"} <= set(self.options):
            found = months_needed(found, date.fromisoformat(self.options["from"]), date.fromisoformat(self.options["to"]))
        if not found:
            raise FileNotFoundError("no NetCDF files at " + self.options.get("path", ""))
        return found

    def _names(self) -> list[str]:
        asked = [x for x in self.options.get("variables", "").split(",") if x]
        return asked or sorted({n for p in self._paths() for n in grid_of(p).variables})

    def schema(self) -> str:
        return ", ".join(["time timestamp_ntz", "latitude double", "longitude double", *(f"`{n}` double" for n in self._names())])

    def reader(self, schema: StructType) -> NetCDFReader:
        return NetCDFReader(self._paths(), [f.name for f in schema][3:], int(self.options.get("slab_bytes", SLAB_BYTES)))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach it."""
    spark.dataSource.register(NetCDF)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def encoded(times: np.ndarray | None, latitudes: np.ndarray, longitudes: np.ndarray, variables: dict[str, np.ndarray], time_name: str = "time", scalars: tuple[str, ...] = (), attributes: dict | None = None) -> bytes:
    """A classic file (64-bit offsets) of variables over (time, latitude, longitude); times are microseconds since 1970.

    ``scalars`` are coordinates without a dimension; ``attributes`` holds numbers by variable and name.
    """
    pad = lambda b: b + bytes(-len(b) % 4)
    name = lambda s: struct.pack(">i", len(s.encode())) + pad(s.encode())
    codes = {np.dtype(v).newbyteorder("="): k for k, v in _KINDS.items() if k <= 6 and k != 2}
    dims = ([(time_name, len(times))] if times is not None else []) + [("latitude", len(latitudes)), ("longitude", len(longitudes))]
    at = {d: i for i, (d, _) in enumerate(dims)}
    arrays = [(n, [], np.zeros((), np.int32)) for n in scalars]
    if times is not None:
        arrays.append((time_name, [time_name], np.asarray(times, np.int64) / 1e6))
    arrays += [("latitude", ["latitude"], np.asarray(latitudes, np.float64)), ("longitude", ["longitude"], np.asarray(longitudes, np.float64))]
    arrays += [(n, [d for d, _ in dims], np.asarray(v)) for n, v in variables.items()]

    def listed_attributes(n: str) -> bytes:
        own = {"units": "seconds since 1970-01-01 00:00:00"} if n == time_name else (attributes or {}).get(n, {})
        if not own:
            return struct.pack(">ii", 0, 0)
        out = struct.pack(">ii", 12, len(own))
        for k, v in own.items():
            held = v.encode() if isinstance(v, str) else np.asarray(v).ravel().astype(np.asarray(v).dtype.newbyteorder(">")).tobytes()
            out += name(k) + struct.pack(">ii", 2 if isinstance(v, str) else codes[np.asarray(v).dtype.newbyteorder("=")], len(held) if isinstance(v, str) else np.asarray(v).size) + pad(held)
        return out

    def head(begins: list[int]) -> bytes:
        out = b"CDF\x02" + struct.pack(">i", 0) + struct.pack(">ii", 10, len(dims)) + b"".join(name(d) + struct.pack(">i", n) for d, n in dims)
        out += struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, len(arrays))
        for (n, own, v), begin in zip(arrays, begins):
            size = v.nbytes + -v.nbytes % 4
            out += name(n) + struct.pack(">i", len(own)) + b"".join(struct.pack(">i", at[d]) for d in own) + listed_attributes(n) + struct.pack(">iiq", codes[v.dtype.newbyteorder("=")], min(size, 0x7FFFFFFF), begin)
        return out

    begins, place = [], len(head([0] * len(arrays)))
    for _, _, v in arrays:
        begins.append(place)
        place += v.nbytes + -v.nbytes % 4
    return head(begins) + b"".join(pad(v.astype(v.dtype.newbyteorder(">")).tobytes()) for _, _, v in arrays)


def write_grids(cells: DataFrame, key: str, folder: str, variables: list[str]) -> DataFrame:
    """Writes ``cells(key, time, latitude, longitude, variables)`` as one file ``<key>.nc`` for each key; rows (key, path, n) tell what was written.

    A file covers all its times, latitudes and longitudes; cells that no row names are NaN. A file is made in one task, so a key is to be as much as
    a file is to hold, a month or a week.
    """

    def written(table: pa.Table) -> pa.Table:
        which = table.column(key)[0].as_py()
        axes = [np.unique(table.column(c).cast(k).to_numpy(), return_inverse=True) for c, k in (("time", pa.int64()), ("latitude", pa.float64()), ("longitude", pa.float64()))]
        shape, at = [len(a) for a, _ in axes], tuple(i for _, i in axes)
        dense = {}
        for v in variables:
            dense[v] = np.full(shape, np.nan)
            dense[v][at] = table.column(v).cast(pa.float64()).fill_null(np.nan).to_numpy()
        system, root = fs.FileSystem.from_uri(folder) if re.match(r"\w+:", folder) else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{which}.nc") as out:
            out.write(encoded(axes[0][0], axes[1][0][::-1], axes[2][0], {v: d[:, ::-1] for v, d in dense.items()}))
        return pa.table([pa.array([str(which)]), pa.array([f"{folder}/{which}.nc"]), pa.array([table.num_rows], pa.int64())], names=["key", "path", "n"])

    return cells.select(key, F.col("time").cast("timestamp_ntz").alias("time"), "latitude", "longitude", *variables).groupBy(key).applyInArrow(written, "key string, path string, n long")


def nearest_on(axis: np.ndarray, value: Column) -> Column:
    """The value of an axis that is nearest; of two as near the larger. Null stays null."""
    held = np.sort(np.asarray(axis, np.float64))

    @F.pandas_udf("double")
    def nearest(x: pd.Series) -> pd.Series:
        at = np.clip(np.searchsorted(held, x), 1, len(held) - 1) if len(held) > 1 else np.zeros(len(x), int)
        low, high = held[np.maximum(at - 1, 0)], held[at]
        return pd.Series(np.where(x - low < high - x, low, high)).where(x.notna().to_numpy())

    return nearest(value)


def sampled_series(points: DataFrame, path: str, variables: list[str], start: str | None = None, end: str | None = None, closed: bool = False) -> DataFrame:
    """Rows (id, time, variables): the series of the grid cell nearest to each point (id, longitude, latitude).

    Nearest on each axis by itself. Times from ``start`` to before ``end``, or to ``end`` itself if ``closed``. On a grid from 0 to 360 longitudes are taken
    modulo 360. Only slabs between the southernmost and the northernmost cell are read, and each cell once however many points lie in it. Points
    without coordinates have no rows; a window without times gives none.
    """
    spark = points.sparkSession
    register(spark)
    axes = grid_of(listed(path)[0])  # as many numbers as the grid has rows and columns
    east = F.col("longitude").cast("double")
    if axes.longitudes.min() >= 0 and axes.longitudes.max() > 180:
        east = F.pmod(east, F.lit(360.0))
    placed = points.dropna(subset=["longitude", "latitude"]).select("id", nearest_on(axes.latitudes, F.col("latitude").cast("double")).alias("latitude"), nearest_on(axes.longitudes, east).alias("longitude"))
    edge = placed.agg(F.min("latitude").alias("south"), F.max("latitude").alias("north")).first()
    series = spark.read.format("netcdf").option("variables", ",".join(variables)).load(path)
    if edge["south"] is None:
        return placed.join(series, ["latitude", "longitude"]).select("id", "time", *variables).limit(0)
    series = series.where(F.col("latitude").between(edge["south"], edge["north"]))
    if start is not None:
        series = series.where(F.col("time") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        series = series.where(F.col("time") <= F.lit(end).cast("timestamp_ntz") if closed else F.col("time") < F.lit(end).cast("timestamp_ntz"))
    return placed.join(series, ["latitude", "longitude"]).select("id", "time", *variables)
